"""Registered queries: sparse vectors, retrieval, index statistics, shards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import dense as D
from ..operators import index as ix
from ..operators import metrics as M
from ..operators import pruned as B
from ..operators import retrieve as R
from ..operators import sparse as S
from . import fixtures as fx
from ..session import scratch_path
from .registry import ORACLE, VEC_CTE, register

TOP_K = 10
DEEP_K = 1000
THRESHOLD = 0.2
QUERY_TOP_DIMS = 8
N_SHARDS = 4
SHARD_TOP_DIMS = 100
ROUTE_M = 2


def _r(df, *cols):
    return df.select(*[rounded(c).alias(c) if c in ("weight", "score", "value") else F.col(c) for c in df.columns])


@register("sparse_vectors", f"""WITH {VEC_CTE}
SELECT vec_id, dim, round(weight, 6) AS weight FROM vec""")
def sparse_vectors(spark, sf):
    """embeddings -> non-zero ``(vec_id, dim, weight)``."""
    return _r(fx.vectors(spark, sf))


@register("prune_topk", f"""WITH {VEC_CTE}
SELECT vec_id, dim, round(weight, 6) AS weight FROM (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, dim ASC) AS r FROM vec)
WHERE r <= {QUERY_TOP_DIMS}""")
def prune_topk(spark, sf):
    """The 8 strongest dimensions of every vector."""
    return _r(S.prune_topk(fx.vectors(spark, sf), QUERY_TOP_DIMS, "vec_id"))


@register("l2_normalize", f"""WITH {VEC_CTE}
SELECT vec_id, dim, round(weight / (sqrt(sum(weight * weight) OVER (PARTITION BY vec_id)) + 1e-9), 6) AS weight
FROM vec""")
def l2_normalize(spark, sf):
    """every vector scaled to unit length (eps 1e-9)."""
    return _r(S.l2_normalize(fx.vectors(spark, sf), "vec_id"))


def _topk_sql(score_cte: str, k: int, threshold: str = "") -> str:
    return f"""{score_cte},
r AS (SELECT qid, did, round(score, 6) AS score,
             row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, did ASC) AS rank
      FROM s {threshold})
SELECT qid, did, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


_SCORE_CTE = f"""WITH {VEC_CTE},
s AS (SELECT q.vec_id AS qid, d.vec_id AS did, sum(q.weight * d.weight) AS score
      FROM vec q JOIN vec d ON q.dim = d.dim GROUP BY 1, 2)"""


@register("retrieve_topk", _topk_sql(_SCORE_CTE, TOP_K))
def retrieve_topk(spark, sf):
    """Every vector as a query against every vector as a document, top 10."""
    return R.retrieve(fx.query_terms(spark, sf), fx.postings(spark, sf), k=TOP_K, threshold=None, digits=6)


@register("retrieve_pruned_blocks", ORACLE["retrieve_topk"])
def retrieve_pruned_blocks(spark, sf):
    """X7 over a block index: blocks of documents are opened only while their
    bound reaches the query's tenth score."""
    index = B.block_index(fx.postings(spark, sf))
    return B.retrieve_pruned(fx.query_terms(spark, sf), index, k=TOP_K, threshold=None, digits=6).run


@register("retrieve_threshold", _topk_sql(_SCORE_CTE, DEEP_K, f"WHERE score > {THRESHOLD}"))
def retrieve_threshold(spark, sf):
    """R5 + W1: strict score threshold, then top 1000 per query.  The run is the
    result, so it is not stored on the way."""
    return R.retrieve(fx.query_terms(spark, sf), fx.postings(spark, sf), k=DEEP_K, threshold=THRESHOLD, digits=6, keep=False)


_COS_CTE = f"""WITH {VEC_CTE},
n AS (SELECT vec_id, dim, weight / (sqrt(sum(weight * weight) OVER (PARTITION BY vec_id)) + 1e-9) AS weight
      FROM vec),
s AS (SELECT q.vec_id AS qid, d.vec_id AS did, sum(q.weight * d.weight) AS score
      FROM n q JOIN n d ON q.dim = d.dim GROUP BY 1, 2)"""


@register("cosine_retrieve", _topk_sql(_COS_CTE, TOP_K))
def cosine_retrieve(spark, sf):
    """L2-normalised vectors on both sides, then top 10."""
    return R.cosine_retrieve(fx.query_terms(spark, sf), fx.postings(spark, sf), k=TOP_K, digits=6)


_DENSE_CTE = """WITH d0 AS (
  SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
s AS (SELECT q.vec_id AS qid, d.vec_id AS did, sum(q.x * d.x) AS score
      FROM d0 q JOIN d0 d ON q.dim = d.dim GROUP BY 1, 2)"""


@register("dense_retrieve", _topk_sql(_DENSE_CTE, TOP_K))
def dense_retrieve(spark, sf):
    """Exact dense dot product of the raw embeddings, top 10."""
    e = fx.table(spark, sf, "embeddings")
    q = e.select(F.col("vec_id").alias("qid"), "embedding")
    d = e.select(F.col("vec_id").alias("did"), "embedding")
    return D.dense_retrieve(q, d, TOP_K, digits=6)


@register("retrieve_pruned_queries", _topk_sql(f"""WITH {VEC_CTE},
qv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, dim ASC) AS r
                      FROM vec) WHERE r <= {QUERY_TOP_DIMS}),
s AS (SELECT q.vec_id AS qid, d.vec_id AS did, sum(q.weight * d.weight) AS score
      FROM qv q JOIN vec d ON q.dim = d.dim GROUP BY 1, 2)""", TOP_K))
def retrieve_pruned_queries(spark, sf):
    """X4 + X7: queries pruned to their 8 strongest dimensions, top 10."""
    q = S.encode_topk(fx.query_terms(spark, sf), "qid", QUERY_TOP_DIMS)
    return R.retrieve(q, fx.postings(spark, sf), k=TOP_K, threshold=None, digits=6)


@register("evaluate_retrieval", f"""{_SCORE_CTE},
r AS (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, did ASC) AS rank
      FROM s WHERE score > 0)
SELECT qid,
       round(coalesce(max(CASE WHEN qid = did AND rank <= 10 THEN 1.0 / rank END), 0), 6) AS mrr_10,
       round(sum(CASE WHEN qid = did AND rank <= 10 THEN 1 ELSE 0 END) / 1.0, 6) AS recall_10,
       round(sum(CASE WHEN qid = did AND rank <= 10 THEN 1.0 / log2(rank + 1) ELSE 0 END), 6) AS ndcg_cut_10
FROM r WHERE rank <= 1000 GROUP BY qid""")
def evaluate_retrieval(spark, sf):
    """X7 + M1-M3: retrieve the top 1000 for every vector and score the run
    against known-item qrels (each vector's own id).  The measures are at 10, so
    of the run of 1000 only ranks up to it are stored and joined with the qrels."""
    run = R.retrieve(fx.query_terms(spark, sf), fx.postings(spark, sf), k=DEEP_K, threshold=0.0, digits=6, keep=10)
    pq = M.per_query(run, fx.known_item_qrels(spark, sf), cutoffs=[10], rank_col="rank", depth=10)
    return pq.select("qid", *[rounded(c).alias(c) for c in ("mrr_10", "recall_10", "ndcg_cut_10")])


# -- index statistics ---------------------------------------------------------

@register("posting_lengths", f"""WITH {VEC_CTE},
dims AS (SELECT CAST(unnest(range(max(len(embedding)))) AS INTEGER) AS dim FROM embeddings)
SELECT dims.dim, CAST(count(vec.vec_id) AS BIGINT) AS df FROM dims LEFT JOIN vec ON dims.dim = vec.dim
GROUP BY dims.dim""")
def posting_lengths(spark, sf):
    """A5: document frequency per dimension, zero-filled to the embedding width."""
    width = fx.table(spark, sf, "embeddings").select(F.max(F.size("embedding"))).first()[0]
    return S.posting_lengths(fx.vectors(spark, sf).withColumnRenamed("vec_id", "did"), int(width))


@register("l0_l1_sparsity", f"""WITH {VEC_CTE},
per AS (SELECT e.vec_id, count(v.dim) AS l0, coalesce(sum(abs(v.weight)), 0) AS l1
        FROM embeddings e LEFT JOIN vec v ON e.vec_id = v.vec_id GROUP BY e.vec_id)
SELECT round(avg(l0), 6) AS l0, round(avg(l1), 6) AS l1, round(1 - avg(l0) / (SELECT CAST(max(len(embedding)) AS DOUBLE) FROM embeddings), 6) AS sparsity,
       CAST(count(*) AS BIGINT) AS n_docs FROM per""")
def l0_l1_sparsity(spark, sf):
    """Exact per-document L0, L1 and sparsity ratio over all vectors."""
    width = fx.table(spark, sf, "embeddings").select(F.max(F.size("embedding"))).first()[0]
    st = S.sparsity_stats(fx.vectors(spark, sf), fx.vector_ids(spark, sf), "vec_id", int(width))
    return st.select(*[rounded(c).alias(c) for c in ("l0", "l1", "sparsity")], F.col("n_docs").cast("long"))


@register("flops_regularizer", f"""WITH {VEC_CTE},
s AS (SELECT dim, sum(abs(weight)) AS s FROM vec GROUP BY dim)
SELECT round(sum(s * s) / (SELECT CAST(count(*) AS DOUBLE) * count(*) FROM embeddings), 6) AS flops FROM s""")
def flops_regularizer(spark, sf):
    """Sum over dims of the squared mean absolute weight."""
    f = S.flops_regularizer(fx.vectors(spark, sf), fx.vector_ids(spark, sf), "vec_id")
    return f.select(rounded("flops").alias("flops"))


@register("retrieval_flops", f"""WITH {VEC_CTE},
qv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, dim ASC) AS r
                      FROM vec) WHERE r <= {QUERY_TOP_DIMS}),
dd AS (SELECT dim, count(*) AS df FROM vec GROUP BY dim),
qd AS (SELECT dim, count(*) AS df FROM qv GROUP BY dim)
SELECT round(sum(CAST(dd.df AS DOUBLE) * qd.df) / ((SELECT CAST(count(*) AS DOUBLE) FROM embeddings)
       * (SELECT count(*) FROM embeddings)), 6) AS flops
FROM dd JOIN qd ON dd.dim = qd.dim""")
def retrieval_flops(spark, sf):
    """Expected FLOPs of pruned queries against full documents."""
    d = fx.vectors(spark, sf)
    q = S.encode_topk(fx.vectors(spark, sf), "vec_id", QUERY_TOP_DIMS)
    ids = fx.vector_ids(spark, sf)
    f = S.retrieval_flops(d, ids, "vec_id", q, ids, "vec_id")
    return f.select(rounded("flops").alias("flops"))


@register("posting_distribution", f"""WITH {VEC_CTE},
dd AS (SELECT dim, count(*) AS df FROM vec GROUP BY dim)
SELECT CAST(row_number() OVER (ORDER BY df DESC, dim ASC) - 1 AS BIGINT) AS rank, dim, CAST(df AS BIGINT) AS df
FROM dd""")
def posting_distribution(spark, sf):
    """Posting lengths in decreasing order with their rank."""
    return ix.posting_distribution(S.posting_lengths(fx.postings(spark, sf)))


# -- sharding -----------------------------------------------------------------

_SHARD_CTE = f"""WITH {VEC_CTE},
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, dim ASC) AS r
                       FROM vec) WHERE r <= {SHARD_TOP_DIMS}),
shard AS (SELECT vec_id, CAST(sum(dim) % {N_SHARDS} AS INTEGER) AS shard FROM top GROUP BY vec_id)"""


@register("shard_documents", f"""{_SHARD_CTE}
SELECT vec_id, shard FROM shard""")
def shard_documents(spark, sf):
    """shard = (sum of the 100 strongest dims) mod 4."""
    return ix.shard_documents(fx.vectors(spark, sf), "vec_id", N_SHARDS, SHARD_TOP_DIMS)


_SHARD_DIMS = f"""{_SHARD_CTE},
sd AS (SELECT s.shard, t.dim FROM top t JOIN shard s ON t.vec_id = s.vec_id GROUP BY 1, 2)"""


@register("shard_top_dims", f"""{_SHARD_DIMS}
SELECT shard, string_agg(CAST(dim AS VARCHAR), ',' ORDER BY dim) AS top_dims, CAST(count(*) AS BIGINT) AS n_dims
FROM sd GROUP BY shard""")
def shard_top_dims(spark, sf):
    """Sorted union of the members' top dimensions per shard."""
    v = fx.vectors(spark, sf)
    sd = ix.shard_top_dims(v, ix.shard_documents(v, "vec_id", N_SHARDS, SHARD_TOP_DIMS), "vec_id", SHARD_TOP_DIMS)
    return sd.select("shard", F.array_join("top_dims", ",").alias("top_dims"),
                     F.size("top_dims").cast("long").alias("n_dims"))


_ROUTE = f"""{_SHARD_DIMS},
qv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY weight DESC, dim ASC) AS r
                      FROM vec) WHERE r <= {QUERY_TOP_DIMS}),
ov AS (SELECT qv.vec_id AS qid, sd.shard, count(*) AS overlap FROM qv JOIN sd ON qv.dim = sd.dim GROUP BY 1, 2),
routed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, shard ASC) AS srank
                          FROM ov WHERE overlap > 0) WHERE srank <= {ROUTE_M})"""


@register("route_queries", f"""{_ROUTE}
SELECT qid, shard, CAST(overlap AS BIGINT) AS overlap, CAST(srank AS INTEGER) AS srank FROM routed""")
def route_queries(spark, sf):
    """J12 + T4: the 2 shards whose top dims overlap a pruned query most."""
    v = fx.vectors(spark, sf)
    shards = ix.shard_documents(v, "vec_id", N_SHARDS, SHARD_TOP_DIMS)
    sd = ix.shard_top_dims(v, shards, "vec_id", SHARD_TOP_DIMS)
    q = S.encode_topk(fx.query_terms(spark, sf), "qid", QUERY_TOP_DIMS)
    return ix.route(q, sd, ROUTE_M)


@register("retrieve_sharded", _topk_sql(f"""{_ROUTE},
s AS (SELECT q.vec_id AS qid, d.vec_id AS did, sum(q.weight * d.weight) AS score
      FROM vec q JOIN routed rt ON q.vec_id = rt.qid
      JOIN shard sh ON sh.shard = rt.shard
      JOIN vec d ON d.vec_id = sh.vec_id AND d.dim = q.dim GROUP BY 1, 2)""", TOP_K))
def retrieve_sharded(spark, sf):
    """X11: each query scored only against documents of its routed shards."""
    v = fx.vectors(spark, sf)
    shards = ix.shard_documents(v, "vec_id", N_SHARDS, SHARD_TOP_DIMS)
    sd = ix.shard_top_dims(v, shards, "vec_id", SHARD_TOP_DIMS)
    q = fx.query_terms(spark, sf)
    routed = ix.route(S.encode_topk(q, "qid", QUERY_TOP_DIMS), sd, ROUTE_M)
    post = ix.shard_postings(fx.postings(spark, sf), shards.withColumnRenamed("vec_id", "did"), "did")
    return ix.retrieve_sharded(q, routed, post, k=TOP_K, threshold=None, digits=6)


@register("retrieve_shard_folders", ORACLE["retrieve_sharded"])
def retrieve_shard_folders(spark, sf):
    """X11 + K9 + A12 + J12: postings written in a folder a shard, shard dims
    as bitmaps, queries routed by the bits they share, and only the folders
    read that some query is routed to."""
    v = fx.vectors(spark, sf)
    shards = ix.shard_documents(v, "vec_id", N_SHARDS, SHARD_TOP_DIMS)
    path = scratch_path(spark, "shard-folders")
    ix.write_sharded_postings(ix.shard_postings(fx.postings(spark, sf), shards.withColumnRenamed("vec_id", "did")), path)
    q = fx.query_terms(spark, sf)
    words = ix.shard_dim_words(v, shards, "vec_id", SHARD_TOP_DIMS)
    routed = ix.route_words(S.encode_topk(q, "qid", QUERY_TOP_DIMS), words, ROUTE_M)
    return ix.retrieve_shard_folders(spark, q, routed, path, k=TOP_K, threshold=None, digits=6)


@register("merge_index", f"""{_SHARD_CTE},
loc AS (SELECT vec_id, shard, row_number() OVER (PARTITION BY shard ORDER BY vec_id) - 1 AS local_id FROM shard),
sizes AS (SELECT shard, count(*) AS n FROM shard GROUP BY shard),
off AS (SELECT shard, coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS offset_ FROM sizes)
SELECT CAST(loc.local_id + off.offset_ AS BIGINT) AS row_id, v.vec_id, v.dim, round(v.weight, 6) AS weight
FROM vec v JOIN loc ON v.vec_id = loc.vec_id JOIN off ON loc.shard = off.shard""")
def merge_index(spark, sf):
    """Per-shard indexes with local row ids merged into one index with
    global ids (W13 offsets + U2 union)."""
    v = fx.vectors(spark, sf)
    shards = ix.shard_documents(v, "vec_id", N_SHARDS, SHARD_TOP_DIMS)
    parts = ix.local_indexes(v, shards, "vec_id")
    merged = ix.merge_index(parts, "vec_id")
    return merged.select(F.col("row_id").cast("long"), "vec_id", "dim", rounded("weight").alias("weight"))


@register("score_pairs", f"""WITH {VEC_CTE}
SELECT vec_id AS qid, vec_id AS did, round(sum(weight * weight), 6) AS score FROM vec GROUP BY vec_id""")
def score_pairs(spark, sf):
    """J14 (pair mode): scores of given (query, document) pairs only — here
    every vector with itself (known-item pairs)."""
    pairs = fx.known_item_qrels(spark, sf).select("qid", "did")
    s = R.score_pairs(pairs, fx.query_terms(spark, sf), fx.postings(spark, sf))
    return s.select("qid", "did", rounded("score").alias("score"))
