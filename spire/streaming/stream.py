"""Incremental indexing and retrieval with Structured Streaming.

Both are file-source streams processed with ``foreachBatch``:

* Z1 ``stream_index``: every micro-batch of whole documents is encoded
  (stateless: a document lies wholly inside one file, so its term
  frequencies are complete in its batch) and its postings are written to
  ``<out>/batch_id=<id>`` with overwrite — a replayed batch after a failure
  rewrites the same folder, so the sink is idempotent.  Row ids cannot be
  dense on a stream, so postings keep the content id.
* Z2 ``stream_retrieve``: every micro-batch of queries is retrieved against
  a static postings table (top-k windows are not allowed directly on a
  stream) and appended the same idempotent way.  Give it a bucketed index
  (``index.read_postings``): its scan is already clustered by document, so
  a batch never reshuffles the index.

The stream's checkpoint lives inside the output table
(``<out>/_checkpoint``; readers skip ``_`` folders), so running the job
again over the same output processes only files that arrived since.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import index_files as files
from ..operators import retrieve as R
from ..operators import sparse as S
from ..operators.layout import parts_for
from ..session import scratch_path


#: size of a micro-batch: enough files for every core
BATCH_BYTES = 1 << 30


def _idempotent_writer(out: str, transform: Callable[[DataFrame], DataFrame]):
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return write


def _run(spark: SparkSession, source: str, schema: StructType, writer, out: str,
         batch_bytes: int) -> None:
    # a batch takes files up to this size together, and one file at least
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(source)
    q = stream.writeStream.foreachBatch(writer) \
        .option("checkpointLocation", f"{out}/_checkpoint") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def stream_index(spark: SparkSession, source: str, schema: StructType, out: str,
                 id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Append lexical postings of newly arrived documents; returns the
    postings written so far ``(doc_id, dim, weight, batch_id)``."""
    writer = _idempotent_writer(out, lambda b: S.lexical_encode(b, id_col, text_col))
    _run(spark, source, schema, writer, out, batch_bytes)
    return spark.read.parquet(out)


def stream_retrieve(spark: SparkSession, source: str, schema: StructType, postings: DataFrame,
                    to_terms: Callable[[DataFrame], DataFrame], out: str, k: int = 10,
                    threshold: float | None = None, batch_bytes: int = BATCH_BYTES, digits: int | None = None) -> DataFrame:
    """Each micro-batch of queries -> terms -> top-k against the static
    postings; returns the accumulated run ``(qid, did, score, rank, batch_id)``."""
    once: dict = {}  # the postings do not change: packed for the first batch only
    writer = _idempotent_writer(out, lambda b: R.retrieve(to_terms(b), postings, k=k, threshold=threshold, digits=digits, once=once, keep=False))
    _run(spark, source, schema, writer, out, batch_bytes)
    return spark.read.parquet(out)


def split_into_files(df: DataFrame, key: str, n_files: int, path: str, mode: str = "overwrite") -> str:
    """Lay a table out as at most ``n_files`` parquet files (rows by ``key mod
    n``, which is hashed to a file) so that a file-source stream sees several arrivals; ``mode='append'``
    adds files next to earlier arrivals.  A table too large for that many
    tasks goes by a hash of the key into more files, which follow its size."""
    n = parts_for(df, n_files)
    dealt = df.repartition(n_files, F.pmod(F.col(key), F.lit(n_files))) if n == n_files else df.repartition(n, key)
    dealt.write.mode(mode).parquet(path)
    return path


def batch_bytes_for(spark: SparkSession, source: str, least: int, batches: int) -> int:
    """Size of a micro-batch: ``least``, or so much that what lies at
    ``source`` comes in about ``batches`` of them."""
    p, fs = files._path(spark, source)
    return max(least, -(-fs.getContentSummary(p).getLength() // batches))


def fresh_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
