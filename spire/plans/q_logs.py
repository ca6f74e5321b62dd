"""Registered queries: training-log analytics over ``events`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalar import rounded
from ..operators import conv as C
from ..operators import logs as L
from . import fixtures as fx
from .q_conv import tw
from .registry import TURNS_CTE, register

PATIENCE = 3
LOG_EVERY = 10


def _log(spark, sf):
    """Metric log stand-in: run = user, value = event value, steps ordered
    by (ts, event_id)."""
    e = fx.table(spark, sf, "events").select(F.col("user_id").alias("run"), "event_id", "ts", "value")
    return L.log_steps(e, "run", ["ts", "event_id"])


_STEPS = """ev AS (SELECT user_id AS run, event_id, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)"""


@register("moving_average", f"""WITH RECURSIVE {_STEPS},
r AS (SELECT run, event_id, step, 0.01 * value AS ema FROM ev WHERE step = 0
      UNION ALL
      SELECT ev.run, ev.event_id, ev.step, 0.99 * r.ema + 0.01 * ev.value FROM r
      JOIN ev ON ev.run = r.run AND ev.step = r.step + 1)
SELECT run, event_id, CAST(step AS BIGINT) AS step, round(ema, 6) AS ema FROM r""")
def moving_average(spark, sf):
    """Exponential moving average (0.99 / 0.01, from 0) of every run's
    log, exact, by a two-level parallel scan."""
    m = L.moving_average(_log(spark, sf), "run")
    return m.select("run", "event_id", F.col("step").cast("long"), rounded("ema").alias("ema"))


@register("early_stop", f"""WITH {_STEPS},
p AS (SELECT *, greatest(coalesce(max(value) OVER (PARTITION BY run ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS prev FROM ev),
q AS (SELECT *, value > prev AS improved, greatest(prev, value) AS best FROM p),
s AS (SELECT *, last(CASE WHEN improved THEN step END IGNORE NULLS) OVER (PARTITION BY run ORDER BY step
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS li FROM q)
SELECT run, CAST(step AS BIGINT) AS step, round(best, 6) AS best, improved,
       CAST(CASE WHEN li IS NULL THEN step + 1 ELSE step - li END AS BIGINT) AS counter,
       (CASE WHEN li IS NULL THEN step + 1 ELSE step - li END) > {PATIENCE} AS stop FROM s""")
def early_stop(spark, sf):
    """Early stopping on a metric (patience 3) along every run."""
    s = L.early_stop(_log(spark, sf), "run", PATIENCE)
    return s.select("run", F.col("step").cast("long"), rounded("best").alias("best"), "improved",
                    F.col("counter").cast("long"), "stop")


@register("normalise_by_log", f"""WITH {_STEPS}
SELECT run, CAST(floor(step / {LOG_EVERY}) AS BIGINT) AS window, round(avg(value), 6) AS mean_value,
       CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY run, floor(step / {LOG_EVERY})""")
def normalise_by_log(spark, sf):
    """Mean of each run's values per logging window of 10 steps."""
    n = L.normalise_by_log(_log(spark, sf), "run", LOG_EVERY)
    return n.select("run", F.col("window").cast("long"), rounded("mean_value").alias("mean_value"),
                    F.col("n").cast("long"))


@register("metric_by_checkpoint", """WITH e AS (
  SELECT event_type AS run_name, CAST(dayofmonth(ts) AS BIGINT) AS checkpoint,
         CAST(value AS DECIMAL(12, 2)) AS value FROM events
  WHERE strpos(event_type, 'error') = 0),
f AS (SELECT run_name, CASE WHEN strpos(run_name, '_0') > 0 THEN checkpoint * 2 ELSE checkpoint END AS checkpoint,
             value FROM e),
g AS (SELECT run_name, CASE WHEN strpos(run_name, 'standard') > 0 THEN checkpoint * 2 ELSE checkpoint END
             AS checkpoint, value FROM f)
SELECT run_name, checkpoint, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       CAST(count(*) AS BIGINT) AS n FROM g GROUP BY run_name, checkpoint""")
def metric_by_checkpoint(spark, sf):
    """R8 + F16 + A15: runs named by event type (error runs excluded),
    checkpoint = day of month, mean and sample std over users."""
    e = fx.table(spark, sf, "events").select(
        F.col("event_type").alias("run_name"), F.dayofmonth("ts").cast("long").alias("checkpoint"),
        F.col("value").cast("decimal(12,2)").alias("value"))   # cent-valued metric stored exactly
    m = L.metric_by_checkpoint(L.filter_metric_runs(e, exclude=["error"]))
    return m.select("run_name", F.col("checkpoint").cast("long"), rounded(F.col("mean").cast("double")).alias("mean"),
                    rounded("std").alias("std"), F.col("n").cast("long"))


def _wc(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({tw(x)}, '\\s+'), lambda z: z <> ''))"


@register("metric_by_length", f"""WITH {TURNS_CTE},
h AS (SELECT conv_id, turn, role, text, array_to_string(list_reverse(list(text) OVER (PARTITION BY conv_id
        ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), ' [SEP] ') AS history FROM turns),
u AS (SELECT conv_id, turn, text, history,
             CAST(floor((len(string_split(history, '[SEP]')) - 1) / 2) AS INTEGER) AS length
      FROM h WHERE role = 'user'),
m AS (SELECT 'history' AS run, length, {_wc('history')} AS value FROM u
      UNION ALL SELECT 'last' AS run, length, {_wc('text')} AS value FROM u)
SELECT run, length, round(avg(value), 6) AS mean_value, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY run, length""")
def metric_by_length(spark, sf):
    """A14 (+ F7): mean per-query measure (query word count of the history
    and of the last-utterance variants) by conversation length."""
    h = C.history(C.utterances(fx.turns(spark, sf))).where(F.col("role") == "user")
    lengths = h.select("conv_id", "turn", T.conversation_length("history").alias("length"))
    per = h.select("conv_id", "turn", F.lit("history").alias("run"), T.word_count("history").alias("value")) \
        .unionByName(h.select("conv_id", "turn", F.lit("last").alias("run"), T.word_count("text").alias("value")))
    m = L.metric_by_length(per, lengths, ["conv_id", "turn"])
    return m.select("run", "length", rounded("mean_value").alias("mean_value"), F.col("n").cast("long"))
