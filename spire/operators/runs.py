"""Run algebra.

A run is ``(qid, did, score)``.  Everything here is an aggregate with a
map-side partial step or a window over one query's candidates after a
group limit, so a query with a huge candidate list is never shipped whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import minmax_rescale
from .retrieve import topk


def union_runs(runs: dict[str, DataFrame], label: str = "teacher") -> DataFrame:
    """Bag union of several runs, each tagged with its name."""
    out = None
    for name, r in runs.items():
        t = r.select("qid", "did", F.col("score").cast("double").alias("score")).withColumn(label, F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


def fuse_runs(runs: list[DataFrame]) -> DataFrame:
    """A10: mean score over the runs that contain the pair (a pair missing
    from a run is not counted as 0)."""
    u = union_runs({str(i): r for i, r in enumerate(runs)})
    return u.groupBy("qid", "did").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_runs"))


def truncate_run(run: DataFrame, k: int) -> DataFrame:
    """The k best documents per query (score desc, did asc)."""
    return topk(run, k)


def rank_slice(run: DataFrame, skip: int, take: int) -> DataFrame:
    """Drop the ``skip`` best documents, keep the next ``take``."""
    r = topk(run, skip + take)
    return r.where(F.col("rank") > skip)


def score_range(run: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Min and max score per query (optionally over kept pairs only)."""
    r = run if keep is None else keep_filtered(run, keep)
    return r.groupBy("qid").agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"),
                                F.count(F.lit(1)).alias("n"))


def rescale_to_student(teacher: DataFrame, student: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """F15 (+ L3): every teacher score of a query mapped onto the student's
    score range of that query, both ranges over the kept pairs if a keep
    list is given; scores outside the keep list are dropped."""
    t = teacher if keep is None else keep_filtered(teacher, keep)
    tr = score_range(t).select("qid", F.col("min_score").alias("t_min"), F.col("max_score").alias("t_max"))
    sr = score_range(student, keep).select("qid", F.col("min_score").alias("s_min"),
                                           F.col("max_score").alias("s_max"))
    j = t.join(tr, "qid").join(sr, "qid")
    return j.select("qid", "did", minmax_rescale("score", "t_min", "t_max", "s_min", "s_max").alias("score"))


def filter_positive_qrels(qrels: DataFrame) -> DataFrame:
    """Rel >= 1."""
    return qrels.where(F.col("rel") >= 1)


def exclude_positives(samples: DataFrame, positives: DataFrame) -> DataFrame:
    """Candidates minus positives (anti join on (qid, did))."""
    return samples.join(positives.select("qid", "did"), ["qid", "did"], "left_anti")


def keep_filtered(samples: DataFrame, keep: DataFrame) -> DataFrame:
    """Only (qid, did) pairs of the per-query keep list."""
    return samples.join(keep.select("qid", "did").distinct(), ["qid", "did"], "left_semi")


def max_relevance(qrels: DataFrame, order: str) -> DataFrame:
    """One passage per query: the strictly greatest ``rel > 0``, the
    earliest in the numeric column ``order`` among equals, written with rel 1.
    An aggregate
    (max of a struct), so it combines map-side."""
    best = qrels.where(F.col("rel") > 0).groupBy("qid").agg(
        F.max(F.struct(F.col("rel"), (-F.col(order)).alias("_o"), F.col("did"))).alias("_b"))
    return best.select("qid", F.col("_b.did").alias("did"), F.lit(1).alias("rel"))


def distinct_judged_docs(qrels_list: list[DataFrame]) -> DataFrame:
    """U4: distinct documents judged in any of the qrels."""
    out = None
    for q in qrels_list:
        t = q.select("did")
        out = t if out is None else out.unionByName(t)
    return out.distinct()
