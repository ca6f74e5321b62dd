"""Distillation data and score diagnostics.

Sampling is deterministic: candidates are ordered by
``md5(seed | qid | did)`` (stable under recomputation and partitioning, and
available in SQL engines) instead of ``rand()``.  Per-query selections use
``row_number() <= n`` (a window group limit: partial per task, then final),
and per-query softmax/log-sum-exp are aggregates joined back, so a query
with a huge candidate list is combined map-side, never shipped whole.

Loss tables (L8-L13) are offline diagnostics over stored scores: no
gradients.  ``student``/``teacher`` are score columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from ..session import shared_dir
from .layout import stored
from .retrieve import score_pairs
from .runs import exclude_positives, keep_filtered, rank_slice

INFONCE_TEMPERATURE = 0.05
MARGIN_WEIGHT = 0.05


def _md5_key(seed, *cols) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def _md5_int(seed, qid: str, i: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(qid).cast("string"), i.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.log1p(F.exp(-F.abs(x))) + F.greatest(x, F.lit(0.0))


def samples_from_run(run: DataFrame, qrels: DataFrame, skip: int, take: int) -> DataFrame:
    """L1: queries with qrels, ranks skip+1 .. skip+take of each."""
    r = run.join(qrels.select("qid").distinct(), "qid", "left_semi")
    return rank_slice(r, skip, take).select("qid", "did", "score")


def samples_from_scores(scores: DataFrame, qrels: DataFrame) -> DataFrame:
    """L2: keep a query only if it is in the qrels and has more scored
    documents than positives."""
    n_s = scores.groupBy("qid").agg(F.count(F.lit(1)).alias("_ns"))
    n_p = qrels.groupBy("qid").agg(F.count(F.lit(1)).alias("_np"))
    ok = n_s.join(n_p, "qid").where(F.col("_ns") > F.col("_np")).select("qid")
    return scores.join(ok, "qid", "left_semi")


def samples_filtered(samples: DataFrame, keep: DataFrame) -> DataFrame:
    """L3 without normalisation: J9 (with it: ``runs.rescale_to_student``)."""
    return keep_filtered(samples, keep)


def explicit_positives(qrels_text: DataFrame) -> DataFrame:
    """L4: the positive's text stored with the query itself
    (``qrels[q][q]``): rows whose did equals the qid carry the text."""
    return qrels_text.where(F.col("qid") == F.col("did")).select("qid", F.col("text").alias("pos_text"))


def choose_positives(qrels: DataFrame, samples: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The pool = the query's positive qrels, padded (when fewer than n)
    with its best-scored other samples; then n drawn from the pool in md5
    order.  Returns ``(chosen(qid, slot, did), pool(qid, did))``."""
    pos = qrels.where(F.col("rel") >= 1).select("qid", "did")
    npos = pos.groupBy("qid").agg(F.count(F.lit(1)).alias("_np"))
    others = exclude_positives(samples.join(npos, "qid", "left"), pos) \
        .withColumn("_np", F.coalesce("_np", F.lit(0))).where(F.col("_np") < n)
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("did").asc())
    # the literal bound lets Spark plan a window group limit (partial top-n
    # per task before the exchange); the per-query bound is applied after
    pad = others.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n) \
        .where(F.col("_r") <= F.lit(n) - F.col("_np")).select("qid", "did")
    pool = pos.unionByName(pad)
    wc = Window.partitionBy("qid").orderBy(_md5_key(seed, "qid", "did"), F.col("did"))
    # the filter is on the rank itself, which Spark turns into a group limit
    chosen = pool.withColumn("_r", F.row_number().over(wc)).where(F.col("_r") <= n)
    return chosen.select("qid", (F.col("_r") - 1).cast("int").alias("slot"), "did"), pool


def sample_negatives(samples: DataFrame, pool: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """candidates = samples outside the positive pool.  More than n:
    n without replacement (md5 order); at most n: n with replacement
    (slot i takes candidate ``md5(seed|qid|i) mod count`` in did order);
    none: no row.  Returns ``(qid, slot, did, score)``."""
    cand = exclude_positives(samples, pool)
    # n + 1 per query tell whether there are more than n; both draws start from these, so they are stored.
    # A number of the first 60 bits, half as long as the key, goes to the exchange; ties of it stay
    head = Window.partitionBy("qid").orderBy(F.conv(F.substring(_md5_key(seed, "qid", "did"), 1, 15), 16, 10).cast("long"))
    cand = cand.withColumn("_h", F.rank().over(head)).where(F.col("_h") <= n + 1).drop("_h")
    wo = Window.partitionBy("qid").orderBy(_md5_key(seed, "qid", "did"), F.col("did"))
    near = cand.withColumn("_r", F.row_number().over(wo)).where(F.col("_r") <= n + 1)
    per = Window.partitionBy("qid")
    near = stored(near.withColumn("_c", F.count(F.lit(1)).over(per)), "near")
    without = near.where((F.col("_c") > n) & (F.col("_r") <= n)).select("qid", (F.col("_r") - 1).alias("slot"), "did", "score")
    few = near.where(F.col("_c") <= n).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("did", "score"))).alias("_all"))
    withr = few.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) \
        .withColumn("_pick", F.element_at("_all", (F.pmod(_md5_int(seed, "qid", F.col("slot")), F.size("_all")) + 1).cast("int"))) \
        .select("qid", "slot", F.col("_pick.did").alias("did"), F.col("_pick.score").alias("score"))
    return without.unionByName(withr).withColumn("slot", F.col("slot").cast("int"))


def training_rows(chosen: DataFrame, negatives: DataFrame, samples: DataFrame,
                  q_text: DataFrame, d_text: DataFrame, pos_score: str = "max") -> DataFrame:
    """L7 + J6: per query ``[q, pos.., neg..]`` texts and teacher scores
    ``[pos_score, neg scores..]``.  ``pos_score='max'`` is the reference's
    actual behaviour (the query's best sample score); ``'own'`` uses the
    first positive's own score when it has one.  All texts are stripped; a
    document without text keeps its place as a null."""
    dt = d_text.select("did", strip_ws("text").alias("_t"))
    p = chosen.join(dt, "did", "left").groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("slot", "_t", "did"))), lambda s: s["_t"]).alias("pos"),
        F.min(F.struct("slot", "did"))["did"].alias("_p0"))
    ng = negatives.join(dt, "did", "left").groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("slot", F.col("_t").alias("t"), "score"))).alias("_n"))
    mx = samples.groupBy("qid").agg(F.max("score").alias("_max"))
    r = q_text.select("qid", strip_ws("text").alias("query")).join(p, "qid").join(ng, "qid", "left").join(mx, "qid")
    if pos_score == "own":
        own = samples.select("qid", F.col("did").alias("_p0"), F.col("score").alias("_own"))
        r = r.join(own, ["qid", "_p0"], "left").withColumn("_ps", F.coalesce("_own", "_max"))
    else:
        r = r.withColumn("_ps", F.col("_max"))
    negs = F.coalesce(F.col("_n"), F.array().cast("array<struct<slot:int,t:string,score:double>>"))
    return r.select("qid", "query", "pos", F.transform(negs, lambda s: s["t"]).alias("neg"),
                    F.concat(F.array("_ps"), F.transform(negs, lambda s: s["score"])).alias("scores"))


def teacher_student(teacher: DataFrame, student: DataFrame) -> DataFrame:
    """Common candidates with both scores."""
    return teacher.select("qid", "did", F.col("score").alias("teacher")) \
        .join(student.select("qid", "did", F.col("score").alias("student")), ["qid", "did"])


def _lse(df: DataFrame, key: list[str], col: str, name: str) -> DataFrame:
    """Per-group log-sum-exp as two aggregates (max, then sum of exp)."""
    m = df.groupBy(*key).agg(F.max(col).alias("_m"))
    s = df.join(m, key).groupBy(*key).agg(
        (F.first("_m") + F.log(F.sum(F.exp(F.col(col) - F.col("_m"))))).alias(name))
    return s


def pairwise_nll(ts: DataFrame, positives: DataFrame) -> DataFrame:
    """Per positive candidate, ``-log softmax`` of its student score
    over [itself, every negative of the query]; mean over positives."""
    lab = ts.join(positives.select("qid", "did").withColumn("_pos", F.lit(True)), ["qid", "did"], "left") \
        .withColumn("_pos", F.coalesce("_pos", F.lit(False)))
    neg = _lse(lab.where(~F.col("_pos")), ["qid"], "student", "_ln")
    p = lab.where(F.col("_pos")).join(neg, "qid", "left")
    loss = F.when(F.col("_ln").isNull(), F.lit(0.0)).otherwise(softplus(F.col("_ln") - F.col("student")))
    return p.agg(F.avg(loss).alias("pairwise_nll"), F.count(F.lit(1)).alias("n_pos"))


def aligned_pairs(chosen: DataFrame, negatives: DataFrame, ts: DataFrame) -> DataFrame:
    """Training pairs as the reference batches them: the first chosen
    positive of a query against each of its negatives, with both scores."""
    s = ts.select("qid", "did", "student", "teacher")
    p = chosen.where(F.col("slot") == 0).join(s, ["qid", "did"]) \
        .select("qid", F.col("student").alias("s_pos"), F.col("teacher").alias("t_pos"))
    n = negatives.join(s, ["qid", "did"]).select("qid", "slot", F.col("student").alias("s_neg"),
                                                  F.col("teacher").alias("t_neg"))
    return p.join(n, "qid")


def bpr_bce(pairs: DataFrame) -> DataFrame:
    """BPR = mean softplus(-(pos - neg)); BCE = mean over the pos (label
    1) and neg (label 0) logits."""
    return pairs.agg(
        F.avg(softplus(-(F.col("s_pos") - F.col("s_neg")))).alias("bpr"),
        ((F.sum(softplus(-F.col("s_pos"))) + F.sum(softplus(F.col("s_neg")))) / (2 * F.count(F.lit(1))))
        .alias("bce"))


def margin_mse(pairs: DataFrame) -> DataFrame:
    """Mean squared difference of student and teacher margins."""
    d = (F.col("s_pos") - F.col("s_neg")) - (F.col("t_pos") - F.col("t_neg"))
    return pairs.agg(F.avg(d * d).alias("margin_mse"))


def listwise_margin_mse(ts: DataFrame) -> DataFrame:
    """Per query, mean over all ordered candidate pairs (a, b) of
    ``((s_a - s_b) - (t_a - t_b))^2``, which equals ``2 var_pop(d)`` with
    ``d = s - t`` — one (numerically stable) aggregation instead of a self
    join; then the mean over queries."""
    d = F.col("student") - F.col("teacher")
    per = ts.groupBy("qid").agg((2 * F.var_pop(d)).alias("_l"))
    return per.agg(F.avg("_l").alias("listwise_margin_mse"), F.count(F.lit(1)).alias("n_queries"))


def kl_divergence(ts: DataFrame) -> DataFrame:
    """Per query ``sum p_t (log p_t - log p_s)`` with softmax over the
    query's candidates, then the mean over queries.  One join with the greatest
    scores of a query; with t and s less these, the sum is that of
    ``exp(t) (t - s - log sum exp(t) + log sum exp(s))`` over ``sum exp(t)``."""
    tops = ts.groupBy("qid").agg(F.max("teacher").alias("_mt"), F.max("student").alias("_ms"))
    t, s = F.col("teacher") - F.col("_mt"), F.col("student") - F.col("_ms")
    sums = ts.select("qid", "teacher", "student").join(tops, "qid").groupBy("qid").agg(
        F.sum(F.exp(t)).alias("_t"), F.sum(F.exp(s)).alias("_s"), F.sum(F.exp(t) * (t - s)).alias("_d"),
        F.sum(F.when((t - s).isNotNull(), F.exp(t))).alias("_both"))
    per = sums.select(((F.col("_d") - (F.log("_t") - F.log("_s")) * F.col("_both")) / F.col("_t")).alias("_kl"))
    return per.agg(F.avg("_kl").alias("kl_divergence"), F.count(F.lit(1)).alias("n_queries"))


def softmax(ts: DataFrame, col: str, out: str) -> DataFrame:
    """Per-query softmax of a score column."""
    lse = _lse(ts, ["qid"], col, "_lse")
    return ts.join(lse, "qid").withColumn(out, F.exp(F.col(col) - F.col("_lse"))).drop("_lse")


def batch_rows(rows: DataFrame) -> DataFrame:
    """Candidate instances of a batch: ``rows(batch, qid, slot, did)``,
    slot 0 being the query's first positive.  Read by several branches of
    the loss plan, so it is checkpointed once to the shared folder (a
    reliable checkpoint: it survives executor loss)."""
    shared_dir(rows.sparkSession)
    return rows.select("batch", "qid", F.col("slot").cast("int"), "did").checkpoint(eager=True)


def _batch_lse_loss(allrows: DataFrame, q_vec: DataFrame, d_vec: DataFrame, scale: float) -> DataFrame:
    """Per query ``logsumexp(z) - z_pos`` over its candidate instances
    (duplicates count), ``z = score * scale``.  Scores are computed once
    for the distinct pairs of a batch (J14), whose vectors meet there; groups
    are bounded by the batch, so the max is a window over the query's instances."""
    sc = score_pairs(allrows, q_vec, d_vec, by="batch")
    z = allrows.join(sc, ["batch", "qid", "did"]).withColumn("z", F.col("score") * F.lit(scale))
    z = z.withColumn("_m", F.max("z").over(Window.partitionBy("qid")))
    return z.groupBy("qid").agg(
        (F.first("_m") + F.log(F.sum(F.exp(F.col("z") - F.col("_m"))))
         - F.max(F.when(F.col("is_pos"), F.col("z")))).alias("loss"))


def infonce(rows: DataFrame, q_vec: DataFrame, d_vec: DataFrame,
            temperature: float = INFONCE_TEMPERATURE) -> DataFrame:
    """L13 + J14: per query, cross entropy of its first positive against
    every non-first candidate of every query of its batch (scores divided
    by the temperature); mean over queries.  The score matrix is built per
    batch only, so its size is (batch size x candidates per batch)."""
    r = batch_rows(rows)
    qs = r.where(F.col("slot") == 0).select("batch", "qid", F.col("did").alias("_pos"))
    cands = r.where(F.col("slot") > 0).select("batch", "did")
    inst = qs.join(cands, "batch").select("batch", "qid", "did", F.lit(False).alias("is_pos"))
    pos = qs.select("batch", "qid", F.col("_pos").alias("did"), F.lit(True).alias("is_pos"))
    per = _batch_lse_loss(inst.unionByName(pos), q_vec, d_vec, 1.0 / temperature)
    return per.agg(F.avg("loss").alias("infonce"), F.count(F.lit(1)).alias("n_queries"))


def in_batch_nll(rows: DataFrame, q_vec: DataFrame, d_vec: DataFrame) -> DataFrame:
    """L8 (in-batch): per query, ``-log softmax`` of its own positive over
    the positives of every query of the batch plus its own negatives."""
    r = batch_rows(rows)
    qs = r.where(F.col("slot") == 0).select("batch", "qid", F.col("did").alias("_pos"))
    bpos = qs.select("batch", F.col("_pos").alias("did"))
    inst = qs.join(bpos, "batch").select("batch", "qid", "did", (F.col("did") == F.col("_pos")).alias("is_pos"))
    own_neg = r.where(F.col("slot") > 0).select("batch", "qid", "did", F.lit(False).alias("is_pos"))
    per = _batch_lse_loss(inst.unionByName(own_neg), q_vec, d_vec, 1.0)
    return per.agg(F.avg("loss").alias("in_batch_nll"), F.count(F.lit(1)).alias("n_queries"))


def combined_loss(parts: DataFrame, weight: float = 1.0, lambda_d: float = 0.0, lambda_q: float = 0.0) -> DataFrame:
    """``w * contrastive + (1 - w) * kl + 0.05 * margin_mse +
    lambda_d * flops_d + lambda_q * l1_q + anti_zero`` over a one-row table
    holding the parts."""
    return parts.select(
        (F.lit(weight) * F.col("contrastive") + F.lit(1 - weight) * F.col("kl")
         + F.lit(MARGIN_WEIGHT) * F.col("margin_mse") + F.lit(lambda_d) * F.col("flops_d")
         + F.lit(lambda_q) * F.col("l1_q") + F.col("anti_zero")).alias("loss"))


def teacher_vs_student_report(pairs: DataFrame) -> DataFrame:
    """Mean positive, negative and margin scores of student and teacher."""
    return pairs.agg(F.avg("s_pos").alias("student_pos"), F.avg("s_neg").alias("student_neg"),
                     F.avg(F.col("s_pos") - F.col("s_neg")).alias("student_margin"),
                     F.avg("t_pos").alias("teacher_pos"), F.avg("t_neg").alias("teacher_neg"),
                     F.avg(F.col("t_pos") - F.col("t_neg")).alias("teacher_margin"))


#: losses by name, as a configuration names them
LOSSES = {"pairwise_nll": pairwise_nll, "in_batch_nll": in_batch_nll, "bpr_bce": bpr_bce, "margin_mse": margin_mse,
          "listwise_margin_mse": listwise_margin_mse, "kl_divergence": kl_divergence, "infonce": infonce}


def loss(name: str):
    """The loss of that name; an unknown name is an error that lists the known."""
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name!r}; known: {', '.join(LOSSES)}")
    return LOSSES[name]
