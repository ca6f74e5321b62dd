"""Physical layout helpers: clustering and stored results.

* ``cluster(df, cols)`` hash-partitions ``df`` on ``cols`` unless its
  physical plan already is (a bucketed table scan reports its bucket
  partitioning, so a bucketed index is never reshuffled).
* ``stored(df, name)`` writes a result once to the shared folder and reads it
  back, so that several later plans share it and a lost executor does not
  bring its lineage back.
"""

from __future__ import annotations

import math
import re
import uuid

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: bytes of values that one task or file takes
PART_BYTES = 64 << 20
#: what a value of a fixed size counts
VALUE_BYTES = 8

_HASH = re.compile(r"hashpartitioning\((.*), \d+\)$")


def partition_columns(df: DataFrame) -> set[str] | None:
    """Column names of the plan's hash partitioning, or None."""
    try:
        part = df._jdf.queryExecution().sparkPlan().outputPartitioning().toString()
    except IllegalArgumentException:  # a join whose sides are not aligned yet has no partitioning
        return None
    m = _HASH.match(part)
    if not m:
        return None
    return {re.sub(r"#\d+L?$", "", e.strip()) for e in m.group(1).split(",")}


def clustered_on(df: DataFrame, cols: list[str]) -> bool:
    """True when rows equal on ``cols`` already share a partition (the plan
    is hash-partitioned on a subset of ``cols``)."""
    names = partition_columns(df)
    return bool(names) and names <= set(cols)


def cluster(df: DataFrame, cols: list[str], n: int | None = None) -> DataFrame:
    if clustered_on(df, cols):
        return df
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def parts_for(df: DataFrame, least: int, part_bytes: int | None = None) -> int:
    """Into how many parts rows go so that each takes about ``part_bytes`` of
    text and other values, and at least ``least``.  One pass over ``df``."""
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(VALUE_BYTES) for f in df.schema.fields]
    size = df.agg(F.sum(sum(sizes, F.lit(0)).cast("long"))).first()[0] or 0
    return max(least, math.ceil(size / (part_bytes or PART_BYTES)))


def bucketed(df: DataFrame, cols: list[str], name: str) -> DataFrame:
    """As `stored`, bucketed by ``cols``: joins and groups on these need no exchange."""
    spark, table = df.sparkSession, f"spire_{uuid.uuid4().hex[:12]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, *cols).write.bucketBy(n, *cols).option("compression", "zstd").option("path", scratch_path(spark, name)).saveAsTable(table))
    return spark.table(table)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    path = scratch_path(df.sparkSession, f"spire-{name}")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
