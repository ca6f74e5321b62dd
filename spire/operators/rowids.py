"""Dense row ids and positional helpers.

``assign_row_ids`` numbers rows 0..n-1 (optionally within groups) without
a single-partition window: the input is range-partitioned on the order
(so a hot group is split over many partitions), each row gets its
in-partition position from ``monotonically_increasing_id``, the frame is
checkpointed to the shared folder (positions survive executor loss), and a
small table of per-(partition, group) counts gives every partition its
offset.  The count table has one row per (partition, group) boundary, so
it grows with the number of groups, not with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir

_POS_MASK = (1 << 33) - 1


def _as_cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def assign_row_ids(df: DataFrame, order: list, group: list[str] | None = None,
                   out: str = "row_id", partitions: int | None = None) -> DataFrame:
    """Dense ids 0..n-1 in ``order`` (within ``group`` if given).

    ``order`` must be a total order (unique within a group) for the ids to
    be reproducible."""
    group = list(group or [])
    shared_dir(df.sparkSession)
    keys = _as_cols(group) + _as_cols(order)
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys) \
        .withColumn("__rid_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    pid = F.shiftright(F.col("__rid_mid"), 33).alias("__rid_pid")
    pos = (F.col("__rid_mid").bitwiseAND(F.lit(_POS_MASK))).alias("__rid_pos")
    tagged = ordered.select("*", pid, pos)
    stats = tagged.groupBy("__rid_pid", *group).agg(F.min("__rid_pos").alias("__rid_first"), F.count(F.lit(1)).alias("__rid_n"))
    w = Window.partitionBy(*group).orderBy("__rid_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = stats.withColumn("__rid_off", F.coalesce(F.sum("__rid_n").over(w), F.lit(0)))
    if not group:
        # one row per partition: bounded by the partition count
        offs = F.broadcast(offs)
    res = tagged.join(offs, ["__rid_pid", *group])
    return res.withColumn(out, (F.col("__rid_off") + F.col("__rid_pos") - F.col("__rid_first")).cast("long")) \
        .drop("__rid_mid", "__rid_pid", "__rid_pos", "__rid_first", "__rid_n", "__rid_off")


def split_round_robin(df: DataFrame, rank: int, world: int, row_id: str = "row_id") -> DataFrame:
    """R2: rows whose id modulo ``world`` equals ``rank``."""
    return df.where(F.pmod(F.col(row_id), F.lit(world)) == rank)


def take_first(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    """Exactly the first n rows by row id."""
    return df.where(F.col(row_id) < n)


def limit_queries(qrels: DataFrame, n: int, qid: str = "qid", order: list | None = None) -> DataFrame:
    """The qrels of the first n distinct queries (in ``order``)."""
    q = qrels.select(qid).distinct()
    q = assign_row_ids(q, order or [qid], out="_qr")
    return qrels.join(take_first(q, n, "_qr").select(qid), qid, "left_semi")


def cast_ids(df: DataFrame, ids: list[str], scores: list[str] | None = None) -> DataFrame:
    """Ids to string, scores to double."""
    for c in ids:
        df = df.withColumn(c, F.col(c).cast("string"))
    for c in scores or []:
        df = df.withColumn(c, F.col(c).cast("double"))
    return df


def sort_by_int_id(df: DataFrame, col: str) -> DataFrame:
    """Numeric order of string ids."""
    return df.orderBy(F.col(col).cast("long"), F.col(col))
