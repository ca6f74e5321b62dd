"""Registered queries: distillation data and score diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import distill as D
from ..operators import retrieve as R
from ..operators.layout import bucketed
from ..operators.rowids import assign_row_ids
from . import fixtures as fx
from .registry import QRELS_CTE, RUN2_CTE, RUN_CTE, VEC_CTE, register

N_POS, N_NEG, SEED = 1, 16, 42
SKIP, TAKE = 10, 950
VEC_K, VEC_NEG, VEC_SEED, BATCH = 20, 3, 7, 8


def _scaled(run):
    """Prices scaled by 2^-10: exact in binary, and means of the scaled
    values never land exactly on a 6-decimal rounding tie."""
    return run.withColumn("score", F.col("score") / 1024.0)


def _ts(spark, sf):
    """Teacher = lineitem run one, student = run two (scores scaled by 2^-10),
    common candidates.  Stored once (like the reference's teacher-run files)
    in the shared folder, since every distillation plan reads it from
    several branches, in buckets of its pairs, which joins on these read as they are."""
    return bucketed(D.teacher_student(_scaled(fx.lineitem_run(spark, sf)), _scaled(fx.lineitem_run2(spark, sf))), ["qid", "did"], "teacher-student")


def _choice(spark, sf, ts=None):
    samples = (ts if ts is not None else _ts(spark, sf)).select("qid", "did", F.col("teacher").alias("score"))
    chosen, pool = D.choose_positives(fx.lineitem_qrels(spark, sf), samples, N_POS, SEED)
    negs = D.sample_negatives(samples, pool, N_NEG, SEED)
    return samples, chosen, pool, negs


def _md5(seed, a, b):
    return f"md5(concat_ws('|', '{seed}', CAST({a} AS VARCHAR), CAST({b} AS VARCHAR)))"


_BASE = f"""WITH {RUN_CTE}, {RUN2_CTE}, {QRELS_CTE},
ts AS (SELECT r.qid, r.did, r.score / 1024.0 AS teacher, r2.score / 1024.0 AS student
       FROM run r JOIN run2 r2 ON r.qid = r2.qid AND r.did = r2.did),
samples AS (SELECT qid, did, teacher AS score FROM ts),
pos AS (SELECT qid, did FROM qrels WHERE rel >= 1),
npos AS (SELECT qid, count(*) AS np FROM pos GROUP BY qid),
others AS (SELECT s.*, coalesce(n.np, 0) AS np FROM samples s LEFT JOIN npos n ON s.qid = n.qid
           WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.qid = s.qid AND p.did = s.did)),
pad AS (SELECT qid, did FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did ASC) AS r
                              FROM others WHERE np < {N_POS}) WHERE r <= {N_POS} - np),
pool AS (SELECT qid, did FROM pos UNION ALL SELECT qid, did FROM pad),
chosen AS (SELECT qid, CAST(slot AS INTEGER) AS slot, did FROM (
             SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY {_md5(SEED, 'qid', 'did')}, did) - 1 AS slot
             FROM pool) WHERE slot < {N_POS}),
cand AS (SELECT s.* FROM samples s WHERE NOT EXISTS (SELECT 1 FROM pool p WHERE p.qid = s.qid AND p.did = s.did)),
cnt AS (SELECT qid, count(*) AS c FROM cand GROUP BY qid),
negs_wo AS (SELECT qid, CAST(slot AS INTEGER) AS slot, did, score FROM (
              SELECT c.*, row_number() OVER (PARTITION BY c.qid ORDER BY {_md5(SEED, 'c.qid', 'c.did')}, c.did) - 1 AS slot
              FROM cand c JOIN cnt ON c.qid = cnt.qid WHERE cnt.c > {N_NEG}) WHERE slot < {N_NEG}),
small AS (SELECT c.*, cnt.c AS cc, row_number() OVER (PARTITION BY c.qid ORDER BY c.did) - 1 AS i
          FROM cand c JOIN cnt ON c.qid = cnt.qid WHERE cnt.c <= {N_NEG}),
slots AS (SELECT DISTINCT qid, cc, unnest(range({N_NEG})) AS slot FROM small),
negs_w AS (SELECT s.qid, CAST(s.slot AS INTEGER) AS slot, m.did, m.score FROM slots s JOIN small m
           ON s.qid = m.qid AND m.i = ((('0x' || substr({_md5(SEED, 's.qid', 's.slot')}, 1, 15))::BIGINT) % s.cc)),
negs AS (SELECT * FROM negs_wo UNION ALL SELECT * FROM negs_w),
pairs AS (SELECT p.qid, n.slot, tp.student AS s_pos, tp.teacher AS t_pos, tn.student AS s_neg, tn.teacher AS t_neg
          FROM chosen p JOIN ts tp ON p.qid = tp.qid AND p.did = tp.did
          JOIN negs n ON n.qid = p.qid JOIN ts tn ON n.qid = tn.qid AND n.did = tn.did WHERE p.slot = 0)"""


@register("samples_from_run", f"""{_BASE},
inq AS (SELECT * FROM run WHERE qid IN (SELECT qid FROM qrels)),
rk AS (SELECT qid, did, round(score, 6) AS score,
              row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, did ASC) AS rank FROM inq)
SELECT qid, did, score FROM rk WHERE rank > {SKIP} AND rank <= {SKIP + TAKE}""")
def samples_from_run(spark, sf):
    """L1: queries with qrels, ranks 11..960 of teacher one."""
    s = D.samples_from_run(fx.lineitem_run(spark, sf), fx.lineitem_qrels(spark, sf), SKIP, TAKE)
    return s.select("qid", "did", rounded("score").alias("score"))


@register("samples_from_scores", f"""{_BASE},
ns AS (SELECT qid, count(*) AS n FROM run2 GROUP BY qid),
np2 AS (SELECT qid, count(*) AS n FROM qrels GROUP BY qid),
ok AS (SELECT ns.qid FROM ns JOIN np2 ON ns.qid = np2.qid WHERE ns.n > np2.n)
SELECT qid, did, round(score, 6) AS score FROM run2 WHERE qid IN (SELECT qid FROM ok)""")
def samples_from_scores(spark, sf):
    """L2: teacher-two scores of queries with more scored docs than qrels."""
    s = D.samples_from_scores(fx.lineitem_run2(spark, sf), fx.lineitem_qrels(spark, sf))
    return s.select("qid", "did", rounded("score").alias("score"))


@register("choose_positives", f"""{_BASE}
SELECT qid, slot, did FROM chosen""")
def choose_positives(spark, sf):
    """One positive per query drawn (md5 order, seed 42) from its
    qrels positives, padded with best-scored samples when too few."""
    _, chosen, _, _ = _choice(spark, sf)
    return chosen


@register("sample_negatives", f"""{_BASE}
SELECT qid, slot, did, round(score, 6) AS score FROM negs""")
def sample_negatives(spark, sf):
    """16 negatives per query from the samples outside the positive
    pool (without replacement when enough, else with replacement)."""
    _, _, _, negs = _choice(spark, sf)
    return negs.select("qid", "slot", "did", rounded("score").alias("score"))


@register("training_rows", f"""{_BASE},
dt AS (SELECT o_orderkey AS did, o_orderpriority || ' ' || o_orderstatus AS t FROM orders),
p AS (SELECT c.qid, string_agg(dt.t, ' | ' ORDER BY c.slot) AS pos FROM chosen c JOIN dt ON c.did = dt.did GROUP BY c.qid),
ng AS (SELECT n.qid, string_agg(trim(dt.t), ' | ' ORDER BY n.slot) AS neg, sum(n.score) AS neg_sum,
              count(*) AS n_neg FROM negs n JOIN dt ON n.did = dt.did GROUP BY n.qid),
mx AS (SELECT qid, max(score) AS mx FROM samples GROUP BY qid)
SELECT s.s_suppkey AS qid, s.s_name AS query, p.pos, ng.neg, round(mx.mx, 6) AS pos_score,
       round(ng.neg_sum, 6) AS neg_score_sum, CAST(ng.n_neg AS INTEGER) AS n_neg
FROM supplier s JOIN p ON s.s_suppkey = p.qid LEFT JOIN ng ON s.s_suppkey = ng.qid JOIN mx ON s.s_suppkey = mx.qid""")
def training_rows(spark, sf):
    """L7 + J6: per query its text, positive and negative texts and the
    teacher scores (positive score = the query's best sample score)."""
    samples, chosen, _, negs = _choice(spark, sf)
    qt = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_name").alias("text"))
    dtx = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("did"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"))
    r = D.training_rows(chosen, negs, samples, qt, dtx)
    return r.select("qid", "query", F.array_join("pos", " | ").alias("pos"),
                    F.when(F.size("neg") > 0, F.array_join("neg", " | ")).alias("neg"),
                    rounded(F.col("scores")[0]).alias("pos_score"),
                    rounded(F.when(F.size("scores") > 1, F.aggregate(F.slice("scores", 2, F.size("scores")),
                                                                      F.lit(0.0), lambda a, x: a + x)))
                    .alias("neg_score_sum"),
                    F.when(F.size("neg") > 0, F.size("neg")).cast("int").alias("n_neg"))


@register("pairwise_nll", f"""{_BASE},
lab AS (SELECT ts.*, EXISTS (SELECT 1 FROM pos p WHERE p.qid = ts.qid AND p.did = ts.did) AS is_pos FROM ts),
mneg AS (SELECT qid, max(student) AS m FROM lab WHERE NOT is_pos GROUP BY qid),
lneg AS (SELECT l.qid, first(m.m) + ln(sum(exp(l.student - m.m))) AS ln_ FROM lab l JOIN mneg m ON l.qid = m.qid
         WHERE NOT l.is_pos GROUP BY l.qid),
pp AS (SELECT l.*, n.ln_ FROM lab l LEFT JOIN lneg n ON l.qid = n.qid WHERE l.is_pos)
SELECT round(avg(CASE WHEN ln_ IS NULL THEN 0.0 ELSE ln(1 + exp(-abs(ln_ - student))) + greatest(ln_ - student, 0) END), 6)
         AS pairwise_nll, CAST(count(*) AS BIGINT) AS n_pos FROM pp""")
def pairwise_nll(spark, sf):
    """-log softmax of each positive over itself and the query's
    negatives (student scores of the common candidates)."""
    ts = _ts(spark, sf)
    r = D.pairwise_nll(ts, D.samples_filtered(fx.lineitem_qrels(spark, sf), ts))
    return r.select(rounded("pairwise_nll").alias("pairwise_nll"), F.col("n_pos").cast("long"))


def _pairs(spark, sf, ts=None):
    ts = ts if ts is not None else _ts(spark, sf)
    _, chosen, _, negs = _choice(spark, sf, ts)
    return D.aligned_pairs(chosen, negs, ts)


@register("bpr_bce", f"""{_BASE}
SELECT round(avg(ln(1 + exp(-abs(s_pos - s_neg))) + greatest(-(s_pos - s_neg), 0)), 6) AS bpr,
       round((sum(ln(1 + exp(-abs(s_pos))) + greatest(-s_pos, 0)) + sum(ln(1 + exp(-abs(s_neg))) + greatest(s_neg, 0)))
             / (2 * count(*)), 6) AS bce
FROM pairs""")
def bpr_bce(spark, sf):
    """BPR and BCE losses over (first positive, negative) pairs."""
    r = D.bpr_bce(_pairs(spark, sf))
    return r.select(rounded("bpr").alias("bpr"), rounded("bce").alias("bce"))


@register("margin_mse", f"""{_BASE}
SELECT round(avg(((s_pos - s_neg) - (t_pos - t_neg)) * ((s_pos - s_neg) - (t_pos - t_neg))), 6) AS margin_mse
FROM pairs""")
def margin_mse(spark, sf):
    """Margin MSE between student and teacher over the pairs."""
    return D.margin_mse(_pairs(spark, sf)).select(rounded("margin_mse").alias("margin_mse"))


@register("teacher_student_report", f"""{_BASE}
SELECT round(avg(s_pos), 6) AS student_pos, round(avg(s_neg), 6) AS student_neg,
       round(avg(s_pos - s_neg), 6) AS student_margin, round(avg(t_pos), 6) AS teacher_pos,
       round(avg(t_neg), 6) AS teacher_neg, round(avg(t_pos - t_neg), 6) AS teacher_margin FROM pairs""")
def teacher_student_report(spark, sf):
    """Mean positive, negative and margin scores of both models."""
    r = D.teacher_vs_student_report(_pairs(spark, sf))
    return r.select(*[rounded(c).alias(c) for c in r.columns])


@register("listwise_margin_mse", f"""{_BASE},
per AS (SELECT a.qid, avg(((a.student - b.student) - (a.teacher - b.teacher))
                         * ((a.student - b.student) - (a.teacher - b.teacher))) AS l
        FROM ts a JOIN ts b ON a.qid = b.qid GROUP BY a.qid)
SELECT round(avg(l), 6) AS listwise_margin_mse, CAST(count(*) AS BIGINT) AS n_queries FROM per""")
def listwise_margin_mse(spark, sf):
    """All-pairs margin MSE per query (closed form, no self join),
    checked against the explicit self join in SQL."""
    r = D.listwise_margin_mse(_ts(spark, sf))
    return r.select(rounded("listwise_margin_mse").alias("listwise_margin_mse"), F.col("n_queries").cast("long"))


@register("kl_divergence", f"""{_BASE},
mt AS (SELECT qid, max(teacher) AS m FROM ts GROUP BY qid),
ms AS (SELECT qid, max(student) AS m FROM ts GROUP BY qid),
lt AS (SELECT ts.qid, first(mt.m) + ln(sum(exp(teacher - mt.m))) AS l FROM ts JOIN mt ON ts.qid = mt.qid GROUP BY ts.qid),
ls AS (SELECT ts.qid, first(ms.m) + ln(sum(exp(student - ms.m))) AS l FROM ts JOIN ms ON ts.qid = ms.qid GROUP BY ts.qid),
per AS (SELECT ts.qid, sum(exp(teacher - lt.l) * ((teacher - lt.l) - (student - ls.l))) AS kl
        FROM ts JOIN lt ON ts.qid = lt.qid JOIN ls ON ts.qid = ls.qid GROUP BY ts.qid)
SELECT round(avg(kl), 6) AS kl_divergence, CAST(count(*) AS BIGINT) AS n_queries FROM per""")
def kl_divergence(spark, sf):
    """KL(teacher softmax || student softmax) per query, averaged."""
    r = D.kl_divergence(_ts(spark, sf))
    return r.select(rounded("kl_divergence").alias("kl_divergence"), F.col("n_queries").cast("long"))


# -- in-batch losses over sparse vectors ---------------------------------------

def _batch_rows(spark, sf):
    """Every vector as a query: its own vector is the positive, 3 negatives
    are sampled from its top-20 retrieval; batches of 8 consecutive
    queries (dense row ids)."""
    q = fx.query_terms(spark, sf)
    samples = R.retrieve(q, fx.postings(spark, sf), k=VEC_K, threshold=None, digits=6).select("qid", "did", "score")
    chosen, pool = D.choose_positives(fx.known_item_qrels(spark, sf), samples, 1, VEC_SEED)
    negs = D.sample_negatives(samples, pool, VEC_NEG, VEC_SEED)
    rows = chosen.unionByName(negs.select("qid", (F.col("slot") + 1).alias("slot"), "did"))
    ids = assign_row_ids(fx.vector_ids(spark, sf, "qid"), ["qid"], out="_r")
    return rows.join(ids.select("qid", F.floor(F.col("_r") / BATCH).alias("batch")), "qid")


_VBASE = f"""WITH {VEC_CTE},
s0 AS (SELECT q.vec_id AS qid, d.vec_id AS did, sum(q.weight * d.weight) AS score
       FROM vec q JOIN vec d ON q.dim = d.dim GROUP BY 1, 2),
samples AS (SELECT qid, did, score FROM (SELECT qid, did, round(score, 6) AS score,
              row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, did ASC) AS rank FROM s0)
            WHERE rank <= {VEC_K}),
chosen AS (SELECT vec_id AS qid, 0 AS slot, vec_id AS did FROM embeddings),
cand AS (SELECT * FROM samples WHERE qid <> did),
cnt AS (SELECT qid, count(*) AS c FROM cand GROUP BY qid),
negs AS (SELECT qid, slot + 1 AS slot, did FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.qid ORDER BY {_md5(VEC_SEED, 'c.qid', 'c.did')}, c.did) - 1 AS slot
  FROM cand c JOIN cnt ON c.qid = cnt.qid WHERE cnt.c > {VEC_NEG}) WHERE slot < {VEC_NEG}),
rows_ AS (SELECT r.*, (row_number() OVER (ORDER BY r.qid) - 1) // {BATCH} AS batch FROM chosen r),
br AS (SELECT b.batch, x.qid, x.slot, x.did FROM (SELECT * FROM chosen UNION ALL SELECT * FROM negs) x
       JOIN rows_ b ON x.qid = b.qid),
sc AS (SELECT q.vec_id AS qid, d.vec_id AS did, sum(q.weight * d.weight) AS score
       FROM vec q JOIN vec d ON q.dim = d.dim GROUP BY 1, 2)"""


@register("infonce", f"""{_VBASE},
qs AS (SELECT batch, qid, did AS pos FROM br WHERE slot = 0),
inst AS (SELECT qs.qid, c.did FROM qs JOIN br c ON qs.batch = c.batch AND c.slot > 0
         UNION ALL SELECT qid, pos AS did FROM qs),
z AS (SELECT i.qid, coalesce(sc.score, 0) / 0.05 AS z FROM inst i LEFT JOIN sc ON i.qid = sc.qid AND i.did = sc.did),
m AS (SELECT qid, max(z) AS m FROM z GROUP BY qid),
l AS (SELECT z.qid, first(m.m) + ln(sum(exp(z.z - m.m))) AS l FROM z JOIN m ON z.qid = m.qid GROUP BY z.qid),
per AS (SELECT l.qid, l.l - coalesce(sc.score, 0) / 0.05 AS loss FROM l JOIN qs ON l.qid = qs.qid
        LEFT JOIN sc ON sc.qid = qs.qid AND sc.did = qs.pos)
SELECT round(avg(loss), 6) AS infonce, CAST(count(*) AS BIGINT) AS n_queries FROM per""")
def infonce(spark, sf):
    """L13 + J14: InfoNCE (temperature 0.05) of each vector's own positive
    against all non-first candidates of its batch of 8."""
    v = fx.vectors(spark, sf)
    r = D.infonce(_batch_rows(spark, sf), v.withColumnRenamed("vec_id", "qid"), v.withColumnRenamed("vec_id", "did"))
    return r.select(rounded("infonce").alias("infonce"), F.col("n_queries").cast("long"))


@register("in_batch_nll", f"""{_VBASE},
qs AS (SELECT batch, qid, did AS pos FROM br WHERE slot = 0),
inst AS (SELECT a.qid, b.pos AS did FROM qs a JOIN qs b ON a.batch = b.batch
         UNION ALL SELECT qid, did FROM br WHERE slot > 0),
z AS (SELECT i.qid, coalesce(sc.score, 0) AS z FROM inst i LEFT JOIN sc ON i.qid = sc.qid AND i.did = sc.did),
m AS (SELECT qid, max(z) AS m FROM z GROUP BY qid),
l AS (SELECT z.qid, first(m.m) + ln(sum(exp(z.z - m.m))) AS l FROM z JOIN m ON z.qid = m.qid GROUP BY z.qid),
per AS (SELECT l.l - coalesce(sc.score, 0) AS loss FROM l JOIN qs ON l.qid = qs.qid
        LEFT JOIN sc ON sc.qid = qs.qid AND sc.did = qs.pos)
SELECT round(avg(loss), 6) AS in_batch_nll, CAST(count(*) AS BIGINT) AS n_queries FROM per""")
def in_batch_nll(spark, sf):
    """L8 (in-batch): own positive against the batch's positives and the
    query's own negatives."""
    v = fx.vectors(spark, sf)
    r = D.in_batch_nll(_batch_rows(spark, sf), v.withColumnRenamed("vec_id", "qid"),
                       v.withColumnRenamed("vec_id", "did"))
    return r.select(rounded("in_batch_nll").alias("in_batch_nll"), F.col("n_queries").cast("long"))


@register("softmax_scores", f"""{_BASE},
m AS (SELECT qid, max(teacher) AS m FROM ts GROUP BY qid),
l AS (SELECT ts.qid, first(m.m) + ln(sum(exp(teacher - m.m))) AS l FROM ts JOIN m ON ts.qid = m.qid GROUP BY ts.qid)
SELECT ts.qid, ts.did, round(exp(teacher - l.l), 6) AS p FROM ts JOIN l ON ts.qid = l.qid""")
def softmax_scores(spark, sf):
    """Per-query softmax of the teacher scores over the candidates."""
    s = D.softmax(_ts(spark, sf), "teacher", "p")
    return s.select("qid", "did", rounded("p").alias("p"))


LOSS_W, LAMBDA_D, LAMBDA_Q = 0.5, 1e-3, 5e-3


def _scalar(name: str, col: str) -> str:
    from .registry import ORACLE
    return f"(SELECT {col} FROM ({ORACLE[name]}))"


@register("combined_loss", f"""WITH {VEC_CTE},
qv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, dim ASC) AS r FROM vec)
       WHERE r <= 8),
l1q AS (SELECT avg(l1) AS l1 FROM (SELECT e.vec_id, coalesce(sum(abs(q.weight)), 0) AS l1
        FROM embeddings e LEFT JOIN qv q ON e.vec_id = q.vec_id GROUP BY e.vec_id)),
az AS (SELECT 1 / (sum(weight) * sum(weight)) + 1 / (sum(weight) * sum(weight)) AS a FROM vec),
parts AS (SELECT {_scalar("infonce", "infonce")} AS contrastive, {_scalar("kl_divergence", "kl_divergence")} AS kl,
                 {_scalar("margin_mse", "margin_mse")} AS margin_mse, {_scalar("flops_regularizer", "flops")} AS flops_d,
                 (SELECT l1 FROM l1q) AS l1_q, (SELECT a FROM az) AS anti_zero)
SELECT round(contrastive, 6) AS contrastive, round(kl, 6) AS kl, round(margin_mse, 6) AS margin_mse,
       round(flops_d, 6) AS flops_d, round(l1_q, 6) AS l1_q,
       round({LOSS_W} * contrastive + {1 - LOSS_W} * kl + 0.05 * margin_mse + {LAMBDA_D} * flops_d
             + {LAMBDA_Q} * l1_q + anti_zero, 6) AS loss
FROM parts""")
def combined_loss(spark, sf):
    """L14 (+ A6, A7, A18): weighted sum of InfoNCE, KL, margin MSE, the
    document FLOPS and query L1 regularisers and the anti-zero term."""
    from ..operators import sparse as S
    from ..operators.sparse import _one_row_join
    v = fx.vectors(spark, sf)
    ids = fx.vector_ids(spark, sf)
    c = infonce(spark, sf).select(F.col("infonce").alias("contrastive"))
    ts = _ts(spark, sf)  # stored once for both
    k = D.kl_divergence(ts).select(F.col("kl_divergence").alias("kl"))
    m = D.margin_mse(_pairs(spark, sf, ts))
    f = S.flops_regularizer(v, ids, "vec_id").select(F.col("flops").alias("flops_d"))
    lq = S.sparsity_stats(S.encode_topk(v, "vec_id", 8), ids, "vec_id").select(F.col("l1").alias("l1_q"))
    az = S.anti_zero(v, v)
    parts = _one_row_join(_one_row_join(_one_row_join(c, k), _one_row_join(m, f)), _one_row_join(lq, az))
    total = D.combined_loss(parts, LOSS_W, LAMBDA_D, LAMBDA_Q)
    return _one_row_join(parts, total).select(
        *[rounded(x).alias(x) for x in ("contrastive", "kl", "margin_mse", "flops_d", "l1_q", "loss")])
