"""An index that grows with a stream, and retrieval against its versions.

Each micro-batch of documents writes, below ``<out>``, its postings and its id
map under ids of its own (0, 1, ... in order of the external id) and at the end
one row of ``batches``: documents, postings and the sums that make L0 and L1.
All are overwritten by batch id, so a replay changes nothing.  Rows of
``batches`` add up: a batch's documents follow those of the batches before, so
global row ids, statistics and document counts of any version come from this
table alone.

``snapshot(out, upto)`` is the index after a batch; a batch without its row is
not there yet.  ``compact`` writes the whole index up to the newest batch as one
bucketed index with a manifest and then names it in ``bases``; a snapshot takes
the newest base that is not newer than itself and the loose batches after it,
so nothing counts twice, however often a compaction is run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import retrieve as R
from ..operators import sparse as S
from ..operators.index import check_unique
from ..operators.index_files import buckets_for, exists, open_index, write_index
from ..operators.rowids import assign_row_ids
from .stream import BATCH_BYTES, _run

NOTHING = -1
#: bytes of postings that a compaction puts into one bucket, and so into one task
COMPACT_BYTES = 32 << 20


@dataclass
class Snapshot:
    """``postings(did, dim, weight)`` and ``ids(row_id, id)`` of the index after
    batch ``number``, and the totals behind its statistics."""

    number: int
    postings: DataFrame
    ids: DataFrame
    documents: int
    nnz: int
    l1_sum: float

    @property
    def stats(self) -> DataFrame:
        """A6, one row: l0, l1 (means over all documents), n_docs."""
        n = self.documents
        row = (self.nnz / n if n else None, self.l1_sum / n if n else None, n)
        return self.postings.sparkSession.createDataFrame([row], "l0 double, l1 double, n_docs long")


def _write_batch(batch: DataFrame, batch_id: int, out: str, encode: Callable[[DataFrame], DataFrame], id_col: str) -> None:
    spark, at = batch.sparkSession, f"batch_id={batch_id}"
    check_unique(batch, id_col)
    assign_row_ids(batch.select(id_col), [id_col], out="local_id").select("local_id", F.col(id_col).alias("id")) \
        .write.mode("overwrite").parquet(f"{out}/ids/{at}")
    ids = spark.read.parquet(f"{out}/ids/{at}")
    vec = encode(batch).where(F.col("weight") > 0).withColumnRenamed(id_col, "id")
    vec.join(ids, "id").select("local_id", "dim", F.col("weight").cast("float").alias("weight")).write.mode("overwrite").parquet(f"{out}/postings/{at}")
    sums = spark.read.parquet(f"{out}/postings/{at}").agg(
        F.count(F.lit(1)).alias("postings"), F.coalesce(F.sum(F.abs(F.col("weight").cast("double"))), F.lit(0.0)).alias("l1_sum")).first()
    row = [(ids.count(), sums["postings"], sums["l1_sum"])]
    spark.createDataFrame(row, "documents long, postings long, l1_sum double").coalesce(1).write.mode("overwrite").parquet(f"{out}/batches/{at}")


def stream_growing_index(spark: SparkSession, source: str, schema: StructType, out: str, id_col: str = "doc_id", text_col: str = "text",
                         encode: Callable[[DataFrame], DataFrame] | None = None, batch_bytes: int = BATCH_BYTES) -> Snapshot:
    """Z1 with ids and statistics: index what has arrived at ``source`` since
    the last run over ``out``; returns the newest snapshot.  ``encode(batch)``
    gives ``(id_col, dim, weight)``, by default the lexical encoder.  Repeated
    ids in a batch are an error, between batches `compact` finds them."""
    encode = encode or (lambda b: S.lexical_encode(b, id_col, text_col))
    _run(spark, source, schema, lambda batch, batch_id: _write_batch(batch, batch_id, out, encode, id_col), f"{out}/stream", batch_bytes)
    return snapshot(spark, out)


def _numbers(spark: SparkSession, path: str, column: str, after: int, upto: int | None) -> list:
    """The rows of a table of one row per folder, in order of the folders."""
    if not exists(spark, path):
        return []
    rows = spark.read.parquet(path).where((F.col(column) > after) & (F.lit(upto is None) | (F.col(column) <= (upto if upto is not None else 0))))
    return rows.orderBy(column).collect()


def newest(spark: SparkSession, out: str) -> int:
    """Number of the newest complete batch (`NOTHING` before the first)."""
    base = _numbers(spark, f"{out}/bases", "upto", NOTHING, None)
    after = base[-1]["upto"] if base else NOTHING
    rows = _numbers(spark, f"{out}/batches", "batch_id", after, None)
    return rows[-1]["batch_id"] if rows else after


def snapshot(spark: SparkSession, out: str, upto: int | None = None) -> Snapshot:
    """The index after batch ``upto`` (default: the newest).  The driver sees
    one row per batch since the base."""
    bases = _numbers(spark, f"{out}/bases", "upto", NOTHING, upto)
    base = open_index(spark, f"{out}/base/{bases[-1]['upto']}") if bases else None
    after = bases[-1]["upto"] if bases else NOTHING
    batches = _numbers(spark, f"{out}/batches", "batch_id", after, upto)
    docs = base.manifest["documents"] if base else 0
    nnz, l1 = (base.manifest["postings"], base.manifest["l1_sum"]) if base else (0, 0.0)
    offsets = []
    for b in batches:
        offsets.append((b["batch_id"], docs))
        docs, nnz, l1 = docs + b["documents"], nnz + b["postings"], l1 + b["l1_sum"]
    number = batches[-1]["batch_id"] if batches else after
    if not (base or batches):
        raise ValueError(f"no complete batch at {out}" + ("" if upto is None else f" up to {upto}"))
    postings, ids = (base.postings, base.ids) if base else (None, None)
    if batches:
        of = F.broadcast(spark.createDataFrame(offsets, "batch_id long, _offset long"))  # one row per batch
        span = (F.col("batch_id") > after) & (F.col("batch_id") <= number)
        moved = F.col("local_id") + F.col("_offset")
        p = spark.read.parquet(f"{out}/postings").where(span).withColumn("batch_id", F.col("batch_id").cast("long")).join(of, "batch_id").select(moved.alias("did"), "dim", "weight")
        i = spark.read.parquet(f"{out}/ids").where(span).withColumn("batch_id", F.col("batch_id").cast("long")).join(of, "batch_id").select(moved.alias("row_id"), "id")
        postings, ids = (postings.unionByName(p), ids.unionByName(i)) if base else (p, i)
    return Snapshot(number, postings, ids, docs, nnz, l1)


def compact(spark: SparkSession, out: str, buckets: int | None = None) -> Snapshot:
    """Write the index up to the newest batch as one bucketed index, in at
    least ``buckets`` buckets and as many as its postings ask for; row ids stay.  Ids that came in two batches are an error.  If a compaction is cut
    off, its base has no manifest and no row in ``bases``, and the loose
    batches go on being read; the next one starts over."""
    now = snapshot(spark, out)
    if _numbers(spark, f"{out}/bases", "upto", now.number - 1, now.number):
        return now  # done before; what it reads is not written over
    check_unique(now.ids, "id")
    write_index(now.postings, now.ids, f"{out}/base/{now.number}", max(buckets or 1, buckets_for(now.nnz, COMPACT_BYTES)), {"l1_sum": now.l1_sum})
    spark.createDataFrame([(now.number,)], "base long").coalesce(1).write.mode("overwrite").parquet(f"{out}/bases/upto={now.number}")
    return snapshot(spark, out)


def pinned(spark: SparkSession, index: str, out: str, batch_id: int) -> int:
    """The snapshot that a batch of queries reads: the newest when it first
    runs, the same when it is replayed."""
    path = f"{out}/pins/batch_id={batch_id}"
    if exists(spark, f"{path}/_SUCCESS"):
        return spark.read.parquet(path).first()["snapshot"]
    number = newest(spark, index)
    spark.createDataFrame([(number,)], "snapshot long").coalesce(1).write.mode("overwrite").parquet(path)
    return number


def stream_retrieve_growing(spark: SparkSession, source: str, schema: StructType, index: str, to_terms: Callable[[DataFrame], DataFrame],
                            out: str, k: int = 10, threshold: float | None = 0.0, batch_bytes: int = BATCH_BYTES, digits: int | None = None) -> DataFrame:
    """Z2 against a growing index: each batch of queries is answered by the
    newest snapshot at its start.  Returns the runs so far, ``(qid, id, score,
    rank, snapshot, batch_id)``, with external document ids; ties go by row id."""
    def write(batch: DataFrame, batch_id: int) -> None:
        number = pinned(spark, index, out, batch_id)
        at = f"{out}/runs/batch_id={batch_id}"
        s = snapshot(spark, index, number)
        run = R.translate_ids(R.retrieve(to_terms(batch), s.postings, k, threshold, digits=digits), s.ids, "did")
        run.select("qid", F.col("did").alias("id"), "score", "rank", F.lit(number).cast("long").alias("snapshot")).write.mode("overwrite").parquet(at)

    _run(spark, source, schema, write, f"{out}/stream", batch_bytes)
    return spark.read.parquet(f"{out}/runs")
