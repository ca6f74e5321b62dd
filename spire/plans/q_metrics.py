"""Registered queries: IR metrics over the lineitem run (M1-M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import metrics as M
from . import fixtures as fx
from .registry import JUDGED_CTE, QRELS_CTE, RUN2_CTE, RUN_CTE, register


def _pq_sql(cutoffs: list[int], select: str, run: str = "run", extra_ctes: str = "") -> str:
    """Oracle: the same per-query measures written out in SQL."""
    per_k = []
    ideal_k = []
    for k in cutoffs:
        per_k.append(f"""sum(CASE WHEN rank <= {k} THEN is_rel ELSE 0 END) AS hits_{k},
  coalesce(max(CASE WHEN is_rel = 1 AND rank <= {k} THEN 1.0 / rank END), 0) AS mrr_{k},
  sum(CASE WHEN rank <= {k} THEN dcg ELSE 0 END) AS dcg_{k},
  sum(CASE WHEN rank <= {k} AND judged THEN 1 ELSE 0 END) AS judged_{k}""")
        ideal_k.append(f"sum(CASE WHEN i <= {k} THEN rel / log2(i + 1) END) AS idcg_{k}")
    return f"""WITH {RUN_CTE}, {RUN2_CTE}, {QRELS_CTE}{extra_ctes},
ranked AS (SELECT qid, did, score,
                  row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, did ASC) AS rank
           FROM {run} WHERE qid IN (SELECT qid FROM qrels)),
j AS (SELECT r.qid, r.did, r.rank, coalesce(q.rel, 0) AS rel, q.rel IS NOT NULL AS judged
      FROM ranked r LEFT JOIN qrels q ON r.qid = q.qid AND r.did = q.did),
nr AS (SELECT qid, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) AS num_rel FROM qrels GROUP BY qid),
ideal AS (SELECT qid, sum(rel / log2(i + 1)) AS idcg, {", ".join(ideal_k)}
          FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS i
                FROM qrels WHERE rel > 0) GROUP BY qid),
j2 AS (SELECT j.*, nr.num_rel, CASE WHEN rel >= 1 THEN 1 ELSE 0 END AS is_rel,
              CASE WHEN rel > 0 THEN rel / log2(rank + 1) ELSE 0 END AS dcg,
              sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY j.qid ORDER BY rank
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rel_upto
       FROM j LEFT JOIN nr ON j.qid = nr.qid),
g AS (SELECT qid, count(*) AS num_ret, first(num_rel) AS num_rel, sum(is_rel) AS num_rel_ret,
             coalesce(max(CASE WHEN is_rel = 1 THEN 1.0 / rank END), 0) AS recip_rank,
             sum(CASE WHEN is_rel = 1 THEN rel_upto / rank END) AS ap_sum,
             sum(CASE WHEN is_rel = 1 AND rank <= num_rel THEN 1 ELSE 0 END) AS rprec_hits,
             sum(dcg) AS dcg, {", ".join(per_k)}
      FROM j2 GROUP BY qid),
pq AS (SELECT g.*, ideal.* EXCLUDE (qid) FROM g LEFT JOIN ideal ON g.qid = ideal.qid)
{select}"""


def _pq(spark, sf, cutoffs, depth=None):
    return M.per_query(fx.lineitem_run(spark, sf), fx.lineitem_qrels(spark, sf), cutoffs=cutoffs, depth=depth)


def _round(df, cols, ints=()):
    return df.select("qid", *[rounded(c).alias(c) for c in cols], *[F.col(c).cast("long") for c in ints])


@register("mrr_at_10", _pq_sql([10, 1000], """SELECT qid, round(mrr_10, 6) AS mrr_10, round(mrr_1000, 6) AS mrr_1000,
  round(recip_rank, 6) AS recip_rank FROM pq"""))
def mrr_at_10(spark, sf):
    """M1: MRR@10 and MRR@1000 (truncated reciprocal rank) per query."""
    return _round(_pq(spark, sf, [10, 1000]), ["mrr_10", "mrr_1000", "recip_rank"])


@register("recall_at_k", _pq_sql([10, 100, 1000], """SELECT qid,
  round(CASE WHEN num_rel > 0 THEN hits_10 / num_rel ELSE 0 END, 6) AS recall_10,
  round(CASE WHEN num_rel > 0 THEN hits_100 / num_rel ELSE 0 END, 6) AS recall_100,
  round(CASE WHEN num_rel > 0 THEN hits_1000 / num_rel ELSE 0 END, 6) AS recall_1000 FROM pq"""))
def recall_at_k(spark, sf):
    """M2: recall at 10, 100 and 1000 per query."""
    return _round(_pq(spark, sf, [10, 100, 1000], depth=1000), ["recall_10", "recall_100", "recall_1000"])


@register("ndcg_at_3", _pq_sql([3], """SELECT qid,
  round(CASE WHEN idcg_3 > 0 THEN dcg_3 / idcg_3 ELSE 0 END, 6) AS ndcg_cut_3 FROM pq"""))
def ndcg_at_3(spark, sf):
    """M3: nDCG@3 with linear gain on graded qrels."""
    return _round(_pq(spark, sf, [3], depth=3), ["ndcg_cut_3"])


@register("ndcg_full", _pq_sql([10], """SELECT qid,
  round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg,
  round(CASE WHEN idcg_10 > 0 THEN dcg_10 / idcg_10 ELSE 0 END, 6) AS ndcg_cut_10 FROM pq"""))
def ndcg_full(spark, sf):
    """M4: full-depth nDCG and nDCG@10."""
    return _round(_pq(spark, sf, [10]), ["ndcg", "ndcg_cut_10"])


@register("judged_at_10", _pq_sql([10, 100], """SELECT qid, CAST(judged_10 AS BIGINT) AS judged_10,
  CAST(judged_100 AS BIGINT) AS judged_100, round(judged_10 / 10.0, 6) AS judged_rate_10 FROM pq"""))
def judged_at_10(spark, sf):
    """M5: number (and rate) of judged documents in the top 10 / 100."""
    pq = _pq(spark, sf, [10, 100], depth=100)
    return pq.select("qid", F.col("judged_10").cast("long"), F.col("judged_100").cast("long"),
                     rounded("judged_rate_10").alias("judged_rate_10"))


@register("precision_map", _pq_sql([10], """SELECT qid, round(hits_10 / 10.0, 6) AS P_10,
  round(CASE WHEN num_rel > 0 THEN coalesce(ap_sum, 0) / num_rel ELSE 0 END, 6) AS map,
  round(CASE WHEN num_rel > 0 THEN rprec_hits / num_rel ELSE 0 END, 6) AS Rprec,
  CAST(CASE WHEN hits_10 > 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS success_10,
  CAST(num_ret AS BIGINT) AS num_ret, CAST(num_rel AS BIGINT) AS num_rel,
  CAST(num_rel_ret AS BIGINT) AS num_rel_ret FROM pq"""))
def precision_map(spark, sf):
    """M6: P@10, MAP, R-precision, success@10 and the count measures."""
    return _round(_pq(spark, sf, [10]), ["P_10", "map", "Rprec", "success_10"],
                  ["num_ret", "num_rel", "num_rel_ret"])


_SUMMARY_SQL = """WITH {run}, {run2}, {qrels},
runs AS (SELECT 'teacher1' AS dataset, * FROM run UNION ALL SELECT 'teacher2' AS dataset, * FROM run2),
ranked AS (SELECT r.dataset, r.qid, r.did, r.score,
                  row_number() OVER (PARTITION BY r.dataset, r.qid ORDER BY round(r.score, 6) DESC, r.did ASC) AS rank
           FROM runs r WHERE r.qid IN (SELECT qid FROM qrels)),
j AS (SELECT r.*, coalesce(q.rel, 0) AS rel FROM ranked r LEFT JOIN qrels q ON r.qid = q.qid AND r.did = q.did),
nr AS (SELECT qid, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) AS num_rel FROM qrels GROUP BY qid),
ideal AS (SELECT qid, sum(CASE WHEN i <= 3 THEN rel / log2(i + 1) END) AS idcg_3
          FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS i
                FROM qrels WHERE rel > 0) GROUP BY qid),
pq AS (SELECT j.dataset, j.qid,
         coalesce(max(CASE WHEN rel >= 1 AND rank <= 10 THEN 1.0 / rank END), 0) AS mrr_10,
         CASE WHEN first(nr.num_rel) > 0 THEN sum(CASE WHEN rel >= 1 AND rank <= 100 THEN 1 ELSE 0 END)
              / first(nr.num_rel) ELSE 0 END AS recall_100,
         CASE WHEN first(ideal.idcg_3) > 0 THEN sum(CASE WHEN rank <= 3 AND rel > 0 THEN rel / log2(rank + 1)
              ELSE 0 END) / first(ideal.idcg_3) ELSE 0 END AS ndcg_cut_3
       FROM j LEFT JOIN nr ON j.qid = nr.qid LEFT JOIN ideal ON j.qid = ideal.qid GROUP BY j.dataset, j.qid)
SELECT dataset, CAST(count(*) AS BIGINT) AS n_queries,
       round(avg(mrr_10), 6) AS mrr_10, round(stddev_pop(mrr_10) / sqrt(count(mrr_10)), 6) AS mrr_10_sem,
       round(avg(recall_100), 6) AS recall_100,
       round(stddev_pop(recall_100) / sqrt(count(recall_100)), 6) AS recall_100_sem,
       round(avg(ndcg_cut_3), 6) AS ndcg_cut_3,
       round(stddev_pop(ndcg_cut_3) / sqrt(count(ndcg_cut_3)), 6) AS ndcg_cut_3_sem
FROM pq GROUP BY dataset""".format(run=RUN_CTE, run2=RUN2_CTE, qrels=QRELS_CTE)


@register("evaluate_summary", _SUMMARY_SQL)
def evaluate_summary(spark, sf):
    """M7 + M8: MRR@10, recall@100 and nDCG@3 of two runs (datasets) in one
    plan, mean and SEM per dataset."""
    runs = fx.lineitem_run(spark, sf).withColumn("dataset", F.lit("teacher1")).unionByName(
        fx.lineitem_run2(spark, sf).withColumn("dataset", F.lit("teacher2")))
    qrels = _per_dataset(fx.lineitem_qrels(spark, sf))
    _, agg = M.evaluate_all(runs, qrels, ["MRR@10", "recall@100", "ndcg@3"])
    cols = ["mrr_10", "recall_100", "ndcg_cut_3"]
    return agg.select("dataset", F.col("n_queries").cast("long"),
                      *[rounded(c).alias(c) for c in sum(([c, f"{c}_sem"] for c in cols), [])])


def _per_dataset(qrels):
    """The same qrels apply to both datasets."""
    return qrels.withColumn("dataset", F.explode(F.array(F.lit("teacher1"), F.lit("teacher2"))))


@register("map_distributed_ranking", _pq_sql([10], """SELECT qid,
  round(CASE WHEN num_rel > 0 THEN coalesce(ap_sum, 0) / num_rel ELSE 0 END, 6) AS map,
  round(CASE WHEN num_rel > 0 THEN rprec_hits / num_rel ELSE 0 END, 6) AS Rprec,
  round(recip_rank, 6) AS recip_rank, CAST(num_ret AS BIGINT) AS num_ret FROM pq"""))
def map_distributed_ranking(spark, sf):
    """M6 full depth with ``ranking='distributed'``: the run is ranked by a
    global range sort with per-partition offsets, so a query holding a
    third of the run is split over many tasks instead of one window."""
    pq = M.per_query(fx.lineitem_run(spark, sf), fx.lineitem_qrels(spark, sf), cutoffs=[10],
                     ranking="distributed")
    return _round(pq, ["map", "Rprec", "recip_rank"], ["num_ret"])


_LEVELS = [M.level_column(x) for x in M.LEVELS]
_SETS = ["set_P", "set_recall", "set_F", "set_map", "set_relative_P"]
# per query: measures of the external evaluator besides the common ones
_EXTERNAL_CTE = f"""WITH {RUN_CTE}, {JUDGED_CTE},
n AS (SELECT qid, CAST(count(*) FILTER (rel >= 1) AS DOUBLE) AS r, CAST(count(*) FILTER (rel < 1) AS DOUBLE) AS o FROM judged GROUP BY qid),
ranked AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did ASC) AS rank FROM run),
j AS (SELECT k.qid, rel, rank, sum(CASE WHEN rel >= 1 THEN 1 ELSE 0 END) OVER w AS upto, sum(CASE WHEN rel < 1 THEN 1 ELSE 0 END) OVER w AS bad
      FROM ranked k JOIN judged d ON k.qid = d.qid AND k.did = d.did WINDOW w AS (PARTITION BY k.qid ORDER BY rank)),
ret AS (SELECT qid, CAST(count(*) AS DOUBLE) AS num_ret FROM run GROUP BY qid),
m AS (SELECT j.qid, count(*) FILTER (rel >= 1) AS hits, count(*) FILTER (rel < 1) AS misses,
        coalesce(sum(upto / rank) FILTER (rel >= 1), 0) / any_value(r) AS ap, coalesce(sum(upto / rank) FILTER (rel >= 1 AND rank <= 100), 0) / any_value(r) AS ap_100,
        coalesce(sum(1 - CASE WHEN bad > 0 THEN least(bad, r) / least(r, o) ELSE 0 END) FILTER (rel >= 1), 0) / any_value(r) AS bpref,
        count(*) FILTER (rel >= 1 AND rank <= 100) AS top, any_value(r) AS r,
        {", ".join(f"coalesce(max(upto / rank) FILTER (rel >= 1 AND upto >= floor({x}::DOUBLE * r + 0.9::DOUBLE)), 0) AS {c}" for x, c in zip(M.LEVELS, _LEVELS))}
      FROM j JOIN n ON n.qid = j.qid GROUP BY j.qid),
e AS (SELECT m.*, hits / num_ret AS set_P, hits / r AS set_recall, CASE WHEN hits > 0 THEN 2 * hits / (num_ret + r) ELSE 0 END AS set_F,
        hits / num_ret * hits / r AS set_map, hits / least(num_ret, r) AS set_relative_P, ({" + ".join(_LEVELS)}) / 11 AS "11pt_avg",
        ln(greatest(ap, 0.00001)) AS gm_map, ln(greatest(bpref, 0.00001)) AS gm_bpref, top / least(r, 100) AS relative_P_100 FROM m JOIN ret ON ret.qid = m.qid)
"""
_EXTERNAL = ["bpref", "gm_map", "gm_bpref", *_SETS, *_LEVELS, "11pt_avg", "relative_P_100"]


@register("external_measures", _EXTERNAL_CTE + f"""SELECT qid, {", ".join(f'round("{c}", 6) AS "{c}"' for c in _EXTERNAL)},
  round(ap_100, 6) AS map_cut_100, CAST(misses AS BIGINT) AS num_nonrel_judged_ret FROM e""")
def external_measures(spark, sf):
    """M6: bpref, interpolated precision at eleven recall levels, set and
    geometric measures per query, on labels with judged non-relevant pairs."""
    pq = M.per_query(fx.lineitem_run(spark, sf), fx.lineitem_judgements(spark, sf), cutoffs=[100])
    return _round(pq, [*_EXTERNAL, "map_cut_100"], ["num_nonrel_judged_ret"])


@register("external_summary", _EXTERNAL_CTE + """SELECT CAST(count(*) AS BIGINT) AS n_queries, round(exp(avg(gm_map)), 6) AS gm_map,
  round(exp(avg(gm_bpref)), 6) AS gm_bpref, round(avg(bpref), 6) AS bpref, round(avg("11pt_avg"), 6) AS "11pt_avg" FROM e""")
def external_summary(spark, sf):
    """M6: geometric and arithmetic means over queries."""
    pq = M.per_query(fx.lineitem_run(spark, sf), fx.lineitem_judgements(spark, sf), cutoffs=[10])
    s = M.summarize(pq, ["gm_map", "gm_bpref", "bpref", "11pt_avg"])
    return s.select(F.col("n_queries").cast("long"), *[rounded(c).alias(c) for c in ("gm_map", "gm_bpref", "bpref", "11pt_avg")])
