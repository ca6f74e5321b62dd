"""Training / evaluation log analytics.

A log is ``(run, step, value)`` ordered by step within a run.  Step
positions come from the distributed row numbering (R1 within runs), so a
run holding a third of all rows is spread over many range partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import name_flags
from .rowids import assign_row_ids

EMA_DECAY = 0.99
EMA_CHUNK = 256


def filter_metric_runs(df: DataFrame, name: str = "run_name", include: list[str] | None = None,
                       exclude: list[str] | None = None, runtime: str | None = None,
                       min_runtime: float = 10.0) -> DataFrame:
    """Keep runs whose name contains every ``include`` part and none of
    the ``exclude`` parts, and (if given) whose runtime exceeds the minimum."""
    for s in include or []:
        df = df.where(F.instr(F.col(name), s) > 0)
    for s in exclude or []:
        df = df.where(F.instr(F.col(name), s) == 0)
    if runtime:
        df = df.where(F.col(runtime) > min_runtime)
    return df


def metric_by_length(per_query: DataFrame, lengths: DataFrame, key: list[str], run: str = "run",
                     value: str = "value") -> DataFrame:
    """Mean per-query metric by conversation length."""
    j = per_query.join(lengths, key)
    return j.groupBy(run, "length").agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))


def metric_by_checkpoint(df: DataFrame, run: str = "run_name", checkpoint: str = "checkpoint",
                         value: str = "value", scale_names: bool = True) -> DataFrame:
    """A15 (+ F16): mean and sample standard deviation over seeds per run
    and checkpoint; checkpoints rescaled by the run-name flags first."""
    if scale_names:
        df = df.withColumn(checkpoint, name_flags(run, checkpoint))
    return df.groupBy(run, checkpoint).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                          F.count(F.lit(1)).alias("n"))


def log_steps(log: DataFrame, run: str, order: list, out: str = "step") -> DataFrame:
    """0-based step position of every log row within its run."""
    return assign_row_ids(log, order, group=[run], out=out)


def normalise_by_log(log: DataFrame, run: str, every: int, step: str = "step", value: str = "value") -> DataFrame:
    """Mean of the values of each logging window of ``every`` steps."""
    return log.groupBy(run, F.floor(F.col(step) / every).alias("window")).agg(
        F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))


def moving_average(log: DataFrame, run: str, step: str = "step", value: str = "value",
                   decay: float = EMA_DECAY, chunk: int = EMA_CHUNK) -> DataFrame:
    """``ema_t = decay * ema_{t-1} + (1 - decay) * x_t`` from 0.

    The recurrence is linear, so it is a two-level scan.  Inside a chunk the
    recurrence is folded over the chunk's values themselves (a bounded array:
    ``chunk`` steps at most), so any decay from 0 to 1 is stable.  Across
    chunks, chunk ends combine as (factor, value) pairs in blocks of
    ``chunk`` chunks, and blocks in turn, so no array grows with the run
    beyond its length over ``chunk`` squared."""
    a = 1.0 - decay

    def folded(values, start):
        return F.aggregate(values, F.array(start), lambda acc, x: F.concat(acc, F.array(
            F.element_at(acc, -1) * F.lit(decay) + F.lit(a) * x)))

    def carried(ends, start):
        return F.aggregate(ends, F.array(start), lambda acc, e: F.concat(acc, F.array(F.element_at(acc, -1) * e["f"] + e["v"])))

    t = log.withColumn("_c", F.floor(F.col(step) / chunk))
    rows = t.groupBy(run, "_c").agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).cast("double").alias("x")))).alias("_rows"))
    xs = F.transform("_rows", lambda r: r["x"])
    rows = rows.withColumn("_b", F.floor(F.col("_c") / chunk)).withColumn("_end", F.element_at(folded(xs, F.lit(0.0)), -1)) \
        .withColumn("_f", F.pow(F.lit(float(decay)), F.size("_rows").cast("double")))
    pair = F.struct(F.col("_c").alias("c"), F.col("_f").alias("f"), F.col("_end").alias("v"))
    blocks = rows.groupBy(run, "_b").agg(F.array_sort(F.collect_list(pair)).alias("_ends"))
    blocks = blocks.withColumn("_v", F.element_at(carried(F.col("_ends"), F.lit(0.0)), -1)) \
        .withColumn("_f", F.aggregate("_ends", F.lit(1.0), lambda acc, e: acc * e["f"]))
    whole = blocks.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(
        F.col("_b").alias("b"), F.col("_f").alias("f"), F.col("_v").alias("v")))).alias("_blocks"))
    starts = whole.select(run, F.explode(F.arrays_zip(F.transform("_blocks", lambda x: x["b"]).alias("b"), F.slice(
        carried(F.col("_blocks"), F.lit(0.0)), F.lit(1), F.size("_blocks")).alias("v"))).alias("z")) \
        .select(run, F.col("z.b").alias("_b"), F.col("z.v").alias("_start"))
    carry = blocks.join(starts, [run, "_b"]).select(run, F.explode(F.arrays_zip(
        F.transform("_ends", lambda e: e["c"]).alias("c"), F.slice(carried(F.col("_ends"), F.col("_start")), F.lit(1), F.size("_ends")).alias("v"))).alias("z")) \
        .select(run, F.col("z.c").alias("_c"), F.col("z.v").alias("_carry"))
    done = rows.join(carry, [run, "_c"]).select(run, F.explode(F.arrays_zip(
        F.transform("_rows", lambda r: r["s"]).alias("s"), F.slice(folded(xs, F.col("_carry")), F.lit(2), F.size("_rows")).alias("e"))).alias("z")) \
        .select(run, F.col("z.s").alias(step), F.col("z.e").alias("ema"))
    return log.join(done, [run, step])


def early_stop(log: DataFrame, run: str, patience: int, mode: str = "metric", step: str = "step",
               value: str = "value", chunk: int = EMA_CHUNK) -> DataFrame:
    """Best-so-far, improvement flag, steps since the last improvement
    (the counter) and the stop flag (counter > patience) at every step.
    ``mode='loss'`` improves on a strictly smaller value (best starts at
    +inf), ``'metric'`` on a strictly larger one (best starts at 0).

    Prefix maxima are associative, so this is a two-level scan like W14:
    running maxima inside chunks of ``chunk`` steps (bounded windows) plus
    the maxima of all earlier chunks from the per-run chunk table."""
    sign = -1.0 if mode == "loss" else 1.0
    floor = float("-inf") if mode == "loss" else 0.0
    t = log.withColumn("_v", F.col(value) * F.lit(sign)).withColumn("_c", F.floor(F.col(step) / chunk))
    w_in_prev = Window.partitionBy(run, "_c").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    w_in_cur = Window.partitionBy(run, "_c").orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    w_chunks = Window.partitionBy(run).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    cmax = t.groupBy(run, "_c").agg(F.max("_v").alias("_cm")) \
        .withColumn("_carry", F.max("_cm").over(w_chunks)).drop("_cm")
    t = t.join(cmax, [run, "_c"])
    prev = F.greatest(F.coalesce(F.max("_v").over(w_in_prev), F.lit(floor)),
                      F.coalesce(F.col("_carry"), F.lit(floor)), F.lit(floor))
    t = t.withColumn("_prev", prev).withColumn("improved", F.col("_v") > F.col("_prev")) \
        .withColumn("best", F.greatest("_prev", "_v") * F.lit(sign))
    imp_step = F.when(F.col("improved"), F.col(step))
    t = t.withColumn("_li", F.max(imp_step).over(w_in_cur))
    clast = t.groupBy(run, "_c").agg(F.max(imp_step).alias("_cl")) \
        .withColumn("_carry_last", F.max("_cl").over(w_chunks)).drop("_cl")
    t = t.join(clast, [run, "_c"]).withColumn("_last", F.coalesce("_li", "_carry_last"))
    t = t.withColumn("counter", F.when(F.col("_last").isNull(), F.col(step) + 1)
                     .otherwise(F.col(step) - F.col("_last")))
    return t.withColumn("stop", F.col("counter") > patience) \
        .drop("_v", "_c", "_carry", "_prev", "_li", "_carry_last", "_last")


def append_metrics(metrics: DataFrame, path: str, run: str = "run") -> None:
    """K8: append per-dataset / per-query metric rows, partitioned by run."""
    metrics.write.mode("append").partitionBy(run).parquet(path)
