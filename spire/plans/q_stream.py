"""Registered queries: incremental indexing and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import index as ix
from ..operators import retrieve as R
from ..operators import sparse as S
from ..session import scratch_path
from ..streaming import growing as G
from ..streaming import stream as Z
from . import fixtures as fx
from .q_lexical import BUCKETS, _DOC_TERMS
from .q_retrieval import TOP_K, _topk_sql
from .registry import VEC_CTE, register

N_FILES = 8


@register("stream_index", f"""WITH {_DOC_TERMS}
SELECT doc_id, dim, round(weight, 6) AS weight FROM dt""")
def stream_index(spark, sf):
    """Documents arrive as files, taken in micro-batches of 4 MB, or of an
    eighth of the files if that is more; postings
    are appended per batch (idempotent) and equal the one-shot encoding."""
    docs = fx.documents(spark, sf)
    src = Z.split_into_files(docs, "doc_id", N_FILES, Z.fresh_dir(spark, "docs-stream"))
    out = Z.stream_index(spark, src, docs.schema, Z.fresh_dir(spark, "postings-stream"), batch_bytes=Z.batch_bytes_for(spark, src, 4 << 20, N_FILES))
    return out.select("doc_id", "dim", rounded("weight").alias("weight"))


@register("stream_retrieve", _topk_sql(f"""WITH {VEC_CTE},
vf AS (SELECT vec_id, dim, CAST(CAST(weight AS FLOAT) AS DOUBLE) AS weight FROM vec),
s AS (SELECT q.vec_id AS qid, d.vec_id AS did, sum(q.weight * d.weight) AS score
      FROM vec q JOIN vf d ON q.dim = d.dim GROUP BY 1, 2)""", TOP_K))
def stream_retrieve(spark, sf):
    """The documents are indexed once into a bucketed table (X5 + K4);
    embedding queries then arrive as files and each micro-batch of 1 MB is
    encoded and retrieved (top 10) against the bucketed index, which is
    never reshuffled per batch; row ids are mapped back (R9)."""
    emb = fx.table(spark, sf, "embeddings")
    postings, id_map, _ = ix.build_index(fx.vectors(spark, sf), fx.vector_ids(spark, sf), "vec_id")
    name = f"stream_postings_{uuid.uuid4().hex[:10]}"
    ix.write_postings(postings, scratch_path(spark, name), name, BUCKETS)
    index = ix.read_postings(spark, name)
    src = Z.split_into_files(emb, "vec_id", N_FILES, Z.fresh_dir(spark, "query-stream"))

    def to_terms(batch):
        return S.dense_to_sparse(batch, "vec_id", "embedding", out_id="qid")

    out = Z.stream_retrieve(spark, src, emb.schema, index, to_terms, Z.fresh_dir(spark, "run-stream"), k=TOP_K, digits=6,
                            batch_bytes=1 << 20)
    return R.translate_ids(out, id_map, "did").select("qid", "did", "score", F.col("rank").cast("int"))


_DOC_F32 = _DOC_TERMS.replace("ln(1 + count(*)) AS weight", "CAST(CAST(ln(1 + count(*)) AS FLOAT) AS DOUBLE) AS weight")


def _grown(spark, sf, compact_first: bool = False):
    docs = fx.documents(spark, sf)
    out = Z.fresh_dir(spark, "growing")
    src = Z.split_into_files(docs, "doc_id", N_FILES, Z.fresh_dir(spark, "growing-docs"))
    now = G.stream_growing_index(spark, src, docs.schema, out, batch_bytes=Z.batch_bytes_for(spark, src, 4 << 20, N_FILES))
    return G.compact(spark, out, BUCKETS) if compact_first else now


@register("stream_index_stats", f"""WITH {_DOC_F32},
per AS (SELECT d.doc_id, count(dt.dim) AS l0, coalesce(sum(dt.weight), 0) AS l1 FROM documents d LEFT JOIN dt ON dt.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT round(avg(l0), 6) AS l0, round(avg(l1), 4) AS l1, CAST(count(*) AS BIGINT) AS n_docs, CAST(count(*) AS BIGINT) AS row_ids,
  CAST(0 AS BIGINT) AS first_row, CAST(count(*) - 1 AS BIGINT) AS last_row FROM per""")
def stream_index_stats(spark, sf):
    """Z1 + A6 + R1: statistics and dense row ids of an index that grew by
    micro-batches, summed from its batches."""
    now = _grown(spark, sf)
    rows = now.ids.agg(F.countDistinct("row_id").alias("row_ids"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))
    return now.stats.select(rounded("l0").alias("l0"), rounded("l1", 4).alias("l1"), "n_docs").withColumn("_k", F.lit(1)).join(
        rows.withColumn("_k", F.lit(1)), "_k").drop("_k")


@register("stream_index_compacted", f"""WITH {_DOC_F32}
SELECT doc_id, dim, round(weight, 6) AS weight FROM dt""")
def stream_index_compacted(spark, sf):
    """Z1 + K4 + K5: the grown index compacted into buckets equals X5 over the
    union of its batches."""
    now = _grown(spark, sf, compact_first=True)
    ids = now.ids.select(F.col("row_id").alias("did"), F.col("id").alias("doc_id"))
    return now.postings.join(ids, "did").select("doc_id", "dim", rounded(F.col("weight").cast("double")).alias("weight"))
