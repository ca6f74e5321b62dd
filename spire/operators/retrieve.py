"""Retrieval: query terms meet posting lists, dot products, top-k per query.

One set-oriented plan answers every query at once (X7/X8/X14):

    postings ⋈ query terms on dim  ->  sum(qw * dw) by (qid, did)
      ->  threshold  ->  row_number() <= k per qid

Join strategy (J1), the same at every size: the postings are clustered by
document (a bucketed index already is; anything else is shuffled once, or
written bucketed once if several blocks have to scan it), and the queries go
over them in blocks.  A block holds whole queries, its size in bytes is
measured and stays under ``spark.spire.broadcastBytes``, and it is broadcast:
a hot dimension — a stop word with a third of all postings — costs nothing
extra, and candidate pairs never cross the network.  Only a block that a
single query makes larger than the limit is joined without broadcast.  Where that join would
make very many products over few dimensions, `products` computes the same
scores by matrix products.

Aggregation (A1) is map-side partial then final; when the postings come
from a table bucketed by document id, the join output is already clustered
on the document and no exchange follows the join.  Top-k (W1) is
``row_number() <= k``, which Spark plans as a partial window group limit
before the exchange on qid and a final one after it, so one query never
ships more than ``k`` rows per task.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import rounded
from ..session import scratch_path
from . import products
from .layout import cluster, clustered_on, stored
from .sparse import l2_normalize

# bytes of one broadcast block of query terms
BROADCAST_BYTES = 128 << 20
# a term row of the hash relation besides its strings: two 8-byte values, header, slot
ROW_BYTES = 48
# blocks that go into one plan; more are run one after another into scratch storage
PLAN_BLOCKS = 8


def broadcast_limit(spark, default: int = BROADCAST_BYTES) -> int:
    return int(spark.conf.get("spark.spire.broadcastBytes", str(default)))


def row_bytes(df: DataFrame) -> Column:
    """Size of a row once broadcast: a fixed part plus its strings (numbers
    count as their text, an upper bound that also holds for struct keys)."""
    return F.lit(ROW_BYTES) + sum((F.octet_length(F.col(c).cast("string")) for c in df.columns), F.lit(0))


def query_blocks(q: DataFrame, qid: str, limit: int | None = None) -> list[tuple[DataFrame, bool]]:
    """Split query terms into blocks of whole queries by a hash of the query
    id: (block, whether it fits ``limit`` bytes).  The driver sees one size per
    block.  Blocks double until all fit or none can get smaller: a block that
    holds a query larger than the limit stays as it is."""
    limit = limit or broadcast_limit(q.sparkSession)
    per = q.groupBy(qid).agg(F.sum(row_bytes(q)).alias("_b"))
    total, largest = per.agg(F.sum("_b"), F.max("_b")).first()
    if (total or 0) <= limit:
        return [(q, True)]
    blocks = max(2, math.ceil(total / max(limit, largest)))
    while True:
        blk = F.pmod(F.xxhash64(F.col(qid)), F.lit(blocks))
        sizes = {r["_k"]: r["_s"] for r in per.groupBy(blk.alias("_k")).agg(F.sum("_b").alias("_s")).collect()}
        if max(sizes.values()) <= max(limit, 2 * largest):
            return [(q.where(blk == k), sizes[k] <= limit) for k in sorted(sizes)]
        blocks *= 2


def clustered(postings: DataFrame, did: str, blocks: int) -> DataFrame:
    """Postings clustered by document; several blocks scan them, so then an
    unclustered input is written bucketed once."""
    if clustered_on(postings, [did]):
        return postings
    if blocks == 1:
        return cluster(postings, [did])
    spark = postings.sparkSession
    name = f"spire_postings_{uuid.uuid4().hex[:12]}"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    (postings.repartition(n, did).write.bucketBy(n, did).option("path", scratch_path(spark, "postings")).saveAsTable(name))
    return spark.table(name)


def score_block(q: DataFrame, p: DataFrame, qid: str, did: str, keys: list[str], fits: bool) -> DataFrame:
    """Dot products of one block with clustered postings."""
    j = p.join(F.broadcast(q) if fits else q, keys)
    return j.groupBy(qid, did).agg(F.sum(F.col("_qw") * F.col("_dw")).alias("score"))


def _sides(q_terms, postings, qid, did, extra_keys):
    keys = ["dim"] + list(extra_keys or [])
    q = q_terms.select(qid, *keys, F.col("weight").cast("double").alias("_qw"))
    p = postings.select(did, *keys, F.col("weight").cast("double").alias("_dw"))
    return keys, q, p


def score(q_terms: DataFrame, postings: DataFrame, qid: str = "qid", did: str = "did",
          extra_keys: list[str] | None = None, block_bytes: int | None = None) -> DataFrame:
    """J1 + A1: ``(qid, did, score)`` for every pair sharing a dimension.

    ``q_terms(qid, dim, weight)``, ``postings(did, dim, weight)``;
    ``extra_keys`` are further equi-join columns (the shard in X11).  Join and
    sum run in the stage that scans the clustered postings; blocks hold
    disjoint queries, so their union is final."""
    keys, q, p = _sides(q_terms, postings, qid, did, extra_keys)
    blocks = query_blocks(q, qid, block_bytes)
    p = clustered(p, did, len(blocks))
    parts = [score_block(b, p, qid, did, keys, fits) for b, fits in blocks]
    return reduce(DataFrame.unionByName, parts)


def topk(scores: DataFrame, k: int | None, qid: str = "qid", did: str = "did",
         threshold: float | None = None, tie: str = "asc", score_col: str = "score",
         digits: int | None = None) -> DataFrame:
    """R5 + W1: strict ``score > threshold``, then the k best per query in a
    total order (score desc, document id asc, or desc with ``tie='desc'``);
    adds ``rank`` (1-based).  ``digits`` rounds the scores first, for
    comparison with an engine that adds in another order; the default keeps
    them as they are."""
    s = scores
    if threshold is not None:
        s = s.where(F.col(score_col) > F.lit(threshold))
    if digits is not None:
        s = s.withColumn(score_col, rounded(score_col, digits))
    order_did = F.col(did).asc() if tie == "asc" else F.col(did).desc()
    w = Window.partitionBy(qid).orderBy(F.col(score_col).desc(), order_did)
    s = s.withColumn("rank", F.row_number().over(w))
    if k is not None:
        s = s.where(F.col("rank") <= k)
    return s


def retrieve(q_terms: DataFrame, postings: DataFrame, k: int | None = 1000, threshold: float | None = 0.0,
             qid: str = "qid", did: str = "did", tie: str = "asc", digits: int | None = None,
             extra_keys: list[str] | None = None, block_bytes: int | None = None, once: dict | None = None, keep: bool | int = True) -> DataFrame:
    """Every query -> ``(qid, did, score, rank)``.

    Each block of queries is scored and cut to its top k.  Up to
    ``PLAN_BLOCKS`` blocks are one plan; more run one after another, and only
    their top k rows are kept in scratch storage.

    Where the join would make many products over few dimensions, the same
    scores come from matrix products (`products`); a block then is a row of
    packed queries, of ``block_bytes`` at most, and all rows are one job, as no
    block is broadcast.  The run is stored, as plans that read it twice would
    make it twice, unless ``keep`` is false; with a number only its ranks up to
    that are stored (or left, without products), for what reads no more of it.
    ``once`` is a dict that keeps what the
    products need of the postings for further calls over the same."""
    keys, q, p = _sides(q_terms, postings, qid, did, extra_keys)
    cols = products.columns(q, p, qid, did, keys, once) if k is not None and k > 0 else None
    if cols is not None:
        found = products.retrieve(q, p, cols, qid, did, keys, k, threshold, tie, digits, once, block_bytes)
        run = _ranked(found, k, qid, did, threshold, tie, digits)
        return stored(_up_to(run, keep), "run") if keep else run
    blocks = query_blocks(q, qid, block_bytes)
    p = clustered(p, did, len(blocks))
    return _up_to(united([topk(score_block(b, p, qid, did, keys, fits), k, qid, did, threshold, tie, digits=digits) for b, fits in blocks]), keep)


def _up_to(run: DataFrame, keep: bool | int) -> DataFrame:
    return run if isinstance(keep, bool) else run.where(F.col("rank") <= keep)


def _ranked(scores: DataFrame, k: int, qid: str, did: str, threshold: float | None, tie: str, digits: int | None) -> DataFrame:
    """The rows of `topk`, from scores that may have their ranks."""
    return scores if "rank" in scores.columns else topk(scores, k, qid, did, threshold, tie, digits=digits)


def united(runs: list[DataFrame]) -> DataFrame:
    """The runs of disjoint queries as one: a single plan, or stored one after
    another if there are many."""
    if len(runs) <= PLAN_BLOCKS:
        return reduce(DataFrame.unionByName, runs)
    spark = runs[0].sparkSession
    path = scratch_path(spark, "blocks")
    for i, run in enumerate(runs):
        run.write.parquet(f"{path}/block={i}")
    return spark.read.schema(runs[0].schema).parquet(*[f"{path}/block={i}" for i in range(len(runs))])


def cosine_retrieve(q_terms: DataFrame, postings: DataFrame, k: int = 1000, threshold: float | None = None,
                    qid: str = "qid", did: str = "did", **kw) -> DataFrame:
    """F14 on both sides, then X7."""
    return retrieve(l2_normalize(q_terms, qid), l2_normalize(postings, did), k, threshold, qid, did, **kw)


def retrieve_many(query_sets: DataFrame, postings: DataFrame, k: int = 1000,
                  threshold: float | None = 0.0, set_col: str = "query_set",
                  qid: str = "qid", did: str = "did", **kw) -> DataFrame:
    """Several query sets in one job; the set label rides along with the
    query id so results stay per dataset."""
    q = query_sets.withColumn("_qk", F.struct(F.col(set_col), F.col(qid)))
    r = retrieve(q.select("_qk", "dim", "weight"), postings, k, threshold, "_qk", did, **kw)
    return r.select(F.col("_qk").getField(set_col).alias(set_col), F.col("_qk").getField(qid).alias(qid),
                    did, "score", "rank")


def score_pairs(pairs: DataFrame, q_vec: DataFrame, d_vec: DataFrame,
                qid: str = "qid", did: str = "did", by: str | None = None) -> DataFrame:
    """J14 (pair / list modes): dot product for given (qid, did) pairs only.

    The pair list is joined with the query terms, then with the document
    terms on ``(did, dim)``; pairs without a shared dimension score 0.  ``by``
    names a column of the pairs, small groups of queries that share their
    documents (a batch): then a vector moves once for each group, not its terms
    for each pair, and ``(by, qid, did, score)`` is returned for distinct pairs."""
    if by is not None:
        return _score_groups(pairs.select(by, qid, did).distinct(), q_vec, d_vec, qid, did, by)
    qp = pairs.select(qid, did).join(q_vec.select(qid, "dim", F.col("weight").alias("_qw")), qid)
    s = qp.join(d_vec.select(did, "dim", F.col("weight").alias("_dw")), [did, "dim"]) \
        .groupBy(qid, did).agg(F.sum(F.col("_qw") * F.col("_dw")).alias("score"))
    return pairs.select(qid, did).join(s, [qid, did], "left") \
        .select(qid, did, F.coalesce("score", F.lit(0.0)).alias("score"))


def _score_groups(pairs: DataFrame, q_vec: DataFrame, d_vec: DataFrame, qid: str, did: str, by: str) -> DataFrame:
    def vectors(terms: DataFrame, key: str) -> DataFrame:
        lists = terms.where("dim is not null and weight is not null").groupBy(key).agg(F.collect_list(F.struct("dim", "weight")).alias("_v"))
        vecs = pairs.select(by, key).distinct().join(lists, key)
        return vecs.select(F.col(by).alias(f"_by_{key}"), F.col(key).alias(f"_of_{key}"), F.col("_v.dim").alias("_dim"), F.col("_v.weight").cast("array<double>").alias("_w"))

    schema = T.StructType([pairs.schema[by], pairs.schema[qid], pairs.schema[did], T.StructField("score", T.DoubleType())])

    def matrix(vecs: pa.Table, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(vecs)), pc.list_value_length(vecs.column("_dim").combine_chunks()).to_numpy(zero_copy_only=False))
        cells = row * width + at
        size = len(vecs) * width
        weights = vecs.column("_w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return np.bincount(cells, weights=weights, minlength=size).reshape(-1, width), np.bincount(cells, minlength=size).reshape(-1, width) > 0

    def score(q: pa.Table, d: pa.Table) -> pa.Table:
        if not len(q) or not len(d):
            none = pa.array([], pa.int64())
            return pa.table({by: q.column(0).take(none), qid: q.column(1).take(none), did: d.column(1).take(none), "score": pa.array([], pa.float64())})
        dims = [t.column("_dim").combine_chunks().flatten().to_numpy(zero_copy_only=False) for t in (q, d)]
        found, at = np.unique(np.concatenate(dims), return_inverse=True)
        (a, in_a), (b, in_b) = matrix(q, at[:len(dims[0])], len(found)), matrix(d, at[len(dims[0]):], len(found))
        if np.isfinite(a).all() and np.isfinite(b).all():
            scores = a @ b.T
        else:  # a dimension that one side lacks adds nothing, whatever the other holds
            with np.errstate(invalid="ignore"):
                scores = np.stack([np.where(m & in_b, x * b, 0.0).sum(axis=1) for x, m in zip(a, in_a, strict=True)])
        of_q, of_d = np.divmod(np.arange(scores.size), len(d))
        return pa.table({by: q.column(0).take(pa.array(of_q)), qid: q.column(1).take(pa.array(of_q)), did: d.column(1).take(pa.array(of_d)), "score": scores.ravel()})

    scores = vectors(q_vec, qid).groupBy(f"_by_{qid}").cogroup(vectors(d_vec, did).groupBy(f"_by_{did}")).applyInArrow(score, schema)
    return pairs.join(scores, [by, qid, did], "left").select(by, qid, did, F.coalesce("score", F.lit(0.0)).alias("score"))


def translate_ids(run: DataFrame, id_map: DataFrame, col: str, internal: str = "row_id",
                  external: str = "id") -> DataFrame:
    """Internal ids -> external ids.  The map has the collection's size,
    so this is a shuffle join on the id, applied to the (small) top-k run."""
    m = id_map.select(F.col(internal).alias(col), F.col(external).alias("_ext"))
    return run.join(m, col).drop(col).withColumnRenamed("_ext", col)
