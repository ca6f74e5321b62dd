"""A written index that describes itself.

``write_index`` lays an index out below one folder: ``postings`` (bucketed by
document, sorted by dim), ``ids`` (row id -> external id), ``lengths`` (document
frequency per dim, A5) and, written last, ``manifest``: format, number of
buckets, columns, document and posting counts.  ``open_index`` takes everything
from the manifest, in any session; without one, or if the files do not hold
what it says, the index is refused.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sparse import posting_lengths

FORMAT = 1
#: bytes of a bucket and of a posting before compression; Spark allows 100,000 buckets
BUCKET_BYTES, POSTING_BYTES, MOST_BUCKETS = 256 << 20, 24, 100_000


@dataclass
class WrittenIndex:
    postings: DataFrame
    ids: DataFrame
    lengths: DataFrame
    manifest: dict


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def _table_of(path: str) -> str:
    return "spire_index_" + hashlib.md5(path.rstrip("/").encode()).hexdigest()[:20]


def buckets_for(rows: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return min(MOST_BUCKETS, max(1, math.ceil(rows * POSTING_BYTES / bucket_bytes)))


def write_index(postings: DataFrame, id_map: DataFrame, path: str, buckets: int | None = None, more: dict | None = None) -> dict:
    """K4 + K5: write ``postings(did, dim, weight)`` and ``id_map(row_id, id)``;
    returns the manifest.  Buckets follow the number of postings (a count of
    the input) unless given.  A manifest that lies there goes first, so an
    index that is being written again is no index until it is whole.  ``more``
    goes into the manifest as it is."""
    spark = postings.sparkSession
    p, fs = _path(spark, f"{path}/manifest")
    fs.delete(p, True)
    n = buckets or buckets_for(postings.count())
    name = _table_of(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    cols = postings.select("did", "dim", "weight")
    (cols.repartition(n, "did").write.mode("overwrite").bucketBy(n, "did").sortBy("dim")
     .option("path", f"{path}/postings").saveAsTable(name))
    id_map.select("row_id", "id").write.mode("overwrite").parquet(f"{path}/ids")
    written = spark.table(name)
    posting_lengths(written).write.mode("overwrite").parquet(f"{path}/lengths")
    totals = spark.read.parquet(f"{path}/lengths").agg(F.coalesce(F.sum("df"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.max("df"), F.lit(0))).first()
    manifest = {"format": FORMAT, "buckets": n, "columns": [[f.name, f.dataType.simpleString()] for f in cols.schema.fields],
                "documents": spark.read.parquet(f"{path}/ids").count(), "postings": totals[0], "dims": totals[1], "longest": totals[2], **(more or {})}
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def open_index(spark: SparkSession, path: str) -> WrittenIndex:
    """The index at ``path``, its scan clustered by document as written."""
    rows = spark.read.text(f"{path}/manifest").collect() if exists(spark, f"{path}/manifest/_SUCCESS") else []
    if len(rows) != 1:
        raise ValueError(f"no complete index at {path}")
    manifest = json.loads(rows[0][0])
    if manifest.get("format") != FORMAT:
        raise ValueError(f"index format {manifest.get('format')!r} at {path}, expected {FORMAT}")
    found = {"postings": spark.read.parquet(f"{path}/postings").count(), "documents": spark.read.parquet(f"{path}/ids").count()}  # from file footers
    short = {k: (n, manifest[k]) for k, n in found.items() if n != manifest[k]}
    if short:
        raise ValueError(f"index at {path} does not hold what its manifest says (found, expected): {short}")
    name = _table_of(path)
    columns = ", ".join(f"`{c}` {t}" for c, t in manifest["columns"])
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # a name only; the files stay
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (did) SORTED BY (dim) INTO {manifest['buckets']} BUCKETS LOCATION '{path}/postings'")
    return WrittenIndex(spark.table(name), spark.read.parquet(f"{path}/ids"), spark.read.parquet(f"{path}/lengths"), manifest)
