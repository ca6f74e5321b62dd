"""Exact top-k retrieval that opens only the document blocks it needs.

Documents are cut into blocks of neighbours, and for each block and dimension
the greatest and least weight are kept.  With these a query gets an upper bound
for the score of any document of a block, at the price of one posting per block
instead of one per document.  Blocks are opened in rounds: first the few of
greatest bound, which give each query a k-th score, then only those whose bound
still reaches that score.  A block that can't is never read for that query, so
the result is that of scoring everything.

The postings are bucketed by block.  A query's terms meet them on (block, dim)
in measured broadcast blocks of queries, and sums by (query, block, document)
need no exchange.  If a round opens few blocks altogether their numbers are put
into the scan as a filter: other buckets are not read at all.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import products
from . import retrieve as R
from .layout import stored
from .rowids import assign_row_ids

#: documents a block, blocks opened by a query in the rounds before the last,
#: and distinct blocks that become a scan filter
BLOCK_DOCS = 256
SEEDS = (2, 16)
FILTER_BLOCKS = 1000
#: bytes of postings a bucket
BUCKET_BYTES = 128 << 20
POSTING_BYTES = 24


@dataclass
class BlockIndex:
    """``postings(block, did, dim, weight)`` and ``bounds(block, dim, most,
    least)``, both bucketed by block."""

    postings: DataFrame
    bounds: DataFrame
    did: str


def _bucketed(df: DataFrame, buckets: int, sort: list[str]) -> DataFrame:
    spark, name = df.sparkSession, f"spire_blocks_{uuid.uuid4().hex[:12]}"
    (df.repartition(buckets, "block").write.bucketBy(buckets, "block").sortBy(*sort)
     .option("path", scratch_path(spark, "blocks")).saveAsTable(name))
    return spark.table(name)


def block_index(postings: DataFrame, did: str = "did", block_docs: int = BLOCK_DOCS, order: DataFrame | None = None) -> BlockIndex:
    """Cut the documents of ``postings(did, dim, weight)`` into blocks.

    ``order(did, ...)`` names the neighbours: documents are numbered by its
    other columns.  The default puts documents of the same strongest dimension
    together, the strongest first, so that a block has few high bounds."""
    if order is None:
        lead = postings.groupBy(did).agg(F.max(F.struct("weight", "dim")).alias("_lead"))
        order = lead.select(did, F.col("_lead.dim").alias("_dim"), (-F.col("_lead.weight")).alias("_least"))
    numbered = assign_row_ids(order, [c for c in order.columns if c != did] + [did], out="_row")
    blocks = numbered.select(did, F.floor(F.col("_row") / block_docs).cast("long").alias("block"))
    tagged = stored(postings.select(did, "dim", F.col("weight").cast("double").alias("weight")).join(blocks, did), "tagged")
    n = max(1, math.ceil(tagged.count() * POSTING_BYTES / BUCKET_BYTES))
    buckets = max(n, min(int(tagged.sparkSession.conf.get("spark.sql.shuffle.partitions")), 100_000))
    rows = _bucketed(tagged.select("block", did, "dim", "weight"), buckets, ["block", "dim"])
    tops = rows.groupBy("block", "dim").agg(F.max("weight").alias("most"), F.min("weight").alias("least"))
    return BlockIndex(rows, _bucketed(tops, buckets, ["dim"]), did)


def _bounds(q: DataFrame, index: BlockIndex, qid: str) -> DataFrame:
    """(qid, block, bound): no document of the block scores more.  A dimension
    that a document lacks adds nothing, so no term counts below zero."""
    term = F.greatest(F.col("_qw") * F.col("most"), F.col("_qw") * F.col("least"), F.lit(0.0))
    return index.bounds.join(F.broadcast(q), "dim").groupBy(qid, "block").agg(F.sum(term).alias("bound"))


def _bounds_by_products(q: DataFrame, index: BlockIndex, cols: list[tuple], qid: str, most: int | None) -> DataFrame:
    """The rows of `_bounds`, with ``most`` those of the greatest bounds of a
    query.  All weights are above zero here, so the least ones bound nothing."""
    tops = index.bounds.select("block", "dim", F.col("most").alias("_dw"))
    scores = products.retrieve(q, tops, cols, qid, "block", ["dim"], most, None, "asc", None)
    return scores.select(qid, "block", F.col("score").alias("bound"))


def _only(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of the blocks that are opened, if these are few enough for a filter."""
    few = pairs.select("block").distinct().limit(FILTER_BLOCKS + 1).collect()
    return rows.where(F.col("block").isin([r[0] for r in few])) if len(few) <= FILTER_BLOCKS else rows


def _open(q: DataFrame, pairs: DataFrame, index: BlockIndex, qid: str, k: int, threshold, tie: str, digits, limit) -> DataFrame:
    """Top k of the opened blocks: ``pairs(qid, block)``."""
    terms = q.join(pairs, qid)
    postings = _only(index.postings, pairs)
    runs = []
    for part, fits in R.query_blocks(terms, qid, limit):
        scores = postings.join(F.broadcast(part) if fits else part, ["block", "dim"]).groupBy(qid, "block", index.did).agg(
            F.sum(F.col("_qw") * F.col("weight")).alias("score")).drop("block")
        runs.append(R.topk(scores, k, qid, index.did, threshold, tie, digits=digits))
    return R.united(runs)


@dataclass
class Pruned:
    """``run(qid, did, score, rank)`` and the blocks opened for it, ``opened(qid, block, round)``."""

    run: DataFrame
    opened: DataFrame


def retrieve_pruned(q_terms: DataFrame, index: BlockIndex, k: int = 1000, threshold: float | None = 0.0, qid: str = "qid",
                    tie: str = "asc", digits: int | None = None, seeds: tuple[int, ...] = SEEDS, block_bytes: int | None = None) -> Pruned:
    """X7/X8 over a block index: the rows of `retrieve.retrieve`.

    Rounds: for each of ``seeds`` a query opens that many of its unopened
    blocks of greatest bound, then all that are left; always only those whose
    bound reaches its k-th score so far and exceeds ``threshold``.  Bounds are
    compared with a margin for the order of additions and for ``digits``, by
    which scores are rounded before they are compared.  Each round's rows are
    stored; a round is a job over the opened blocks only.

    Where joins would make very many products, bounds and scores are matrix
    products (`products`): the same rounds, all queries at once."""
    q_all = q_terms.select(qid, "dim", F.col("weight").cast("double").alias("_qw"))
    margin = 0.0 if digits is None else 10.0 ** -digits
    runs, opens = [], []
    cols = products.columns(q_all, index.postings.withColumnRenamed("weight", "_dw"), qid, index.did, ["dim"])
    docs = None if cols is None else products.packed_blocks(index.postings.withColumnRenamed("weight", "_dw"), cols, index.did)
    for q, _ in R.query_blocks(q_all, qid, block_bytes) if cols is None or block_bytes else [(q_all, True)]:
        best = opened = None
        for turn, most in enumerate([*seeds, None]):
            bounds = _bounds(q, index, qid) if cols is None else _bounds_by_products(q, index, cols, qid, None if most is None else sum(seeds[:turn + 1]))
            reach: Column = F.col("bound") + F.abs("bound") * 1e-9 + margin
            if threshold is not None:
                bounds = bounds.where(reach > threshold)
            if best is not None:
                kth = best.where(F.col("rank") == k).select(qid, F.col("score").alias("_kth"))
                bounds = bounds.join(kth, qid, "left").where(F.col("_kth").isNull() | (reach >= F.col("_kth"))).drop("_kth")
                bounds = bounds.join(opened.select(qid, "block"), [qid, "block"], "left_anti")
            if most is not None:
                bounds = bounds.withColumn("_r", F.row_number().over(Window.partitionBy(qid).orderBy(F.col("bound").desc(), "block"))).where(F.col("_r") <= most)
            pairs = stored(bounds.select(qid, "block", F.lit(turn).alias("round")), "opened")
            opened = pairs if opened is None else opened.unionByName(pairs)
            if cols is None:
                found = _open(q, pairs.select(qid, "block"), index, qid, k, threshold, tie, digits, block_bytes)
            else:
                scores = products.open_blocks(q, pairs.select(qid, "block"), _only(docs, pairs), cols, qid, index.did, index.postings.schema[index.did].dataType, k, threshold, tie, digits)
                found = R.topk(scores, k, qid, index.did, threshold, tie, digits=digits)
            if best is not None:
                found = R.topk(best.drop("rank").unionByName(found.drop("rank")), k, qid, index.did, tie=tie)
            best = stored(found, "best")
        runs.append(best)
        opens.append(opened)
    return Pruned(R.united(runs), R.united(opens))
