"""Registered queries: built-in lexical encoder, index build and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalar import rounded
from ..operators import conv as C
from ..operators import index as ix
from ..operators import retrieve as R
from ..operators import sparse as S
from ..operators.layout import parts_for
from ..session import scratch_path
from . import fixtures as fx
from .registry import TURNS_CTE, register

TOP_K = 10
BUCKETS = 8
# bytes of text whose postings go into one bucket
BUCKET_TEXT = 16 << 20

SPLIT = r"[^\p{L}\p{N}]+"
_DOC_TERMS = f"""dt AS (SELECT doc_id, token AS dim, ln(1 + count(*)) AS weight
  FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '{SPLIT}')) AS token FROM documents)
  WHERE token <> '' GROUP BY doc_id, token)"""
_Q_TERMS = f"""qt AS (SELECT DISTINCT item_id, token AS dim, CAST(1.0 AS DOUBLE) AS weight
  FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '{SPLIT}')) AS token FROM benchmark)
  WHERE token <> '')"""
_LEX_RETRIEVE = f"""WITH {_DOC_TERMS}, {_Q_TERMS},
s AS (SELECT qt.item_id AS qid, dt.doc_id AS did, sum(qt.weight * dt.weight) AS score
      FROM qt JOIN dt ON qt.dim = dt.dim GROUP BY 1, 2),
r AS (SELECT qid, did, round(score, 6) AS score,
             row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, did ASC) AS rank
      FROM s WHERE score > 0)
SELECT qid, did, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {TOP_K}"""


@register("lexical_encode", f"""WITH {_DOC_TERMS}
SELECT doc_id, dim, round(weight, 6) AS weight FROM dt""")
def lexical_encode(spark, sf):
    """X1 (built-in encoder): every document, whole text, as log(1 + tf)
    term weights."""
    d = S.lexical_encode(fx.documents(spark, sf), "doc_id", "text")
    return d.select("doc_id", "dim", rounded("weight").alias("weight"))


@register("bag_of_words", f"""WITH {_Q_TERMS}
SELECT item_id, dim, weight FROM qt""")
def bag_of_words(spark, sf):
    """Binary bag of words of every benchmark passage."""
    return S.lexical_encode(fx.benchmark(spark, sf), "item_id", "text", kind="query") \
        .select("item_id", "dim", F.col("weight").cast("double"))


@register("lexical_retrieve", _LEX_RETRIEVE)
def lexical_retrieve(spark, sf):
    """X1 + X7: benchmark passages (binary queries) against every document
    (log tf), top 10 by dot product."""
    q = S.lexical_encode(fx.benchmark(spark, sf), "item_id", "text", kind="query") \
        .withColumnRenamed("item_id", "qid")
    d = S.lexical_encode(fx.documents(spark, sf), "doc_id", "text").withColumnRenamed("doc_id", "did")
    return R.retrieve(q, d, k=TOP_K, threshold=0.0, digits=6)


@register("index_retrieve", _LEX_RETRIEVE.replace("ln(1 + count(*)) AS weight",
                                                   "CAST(CAST(ln(1 + count(*)) AS FLOAT) AS DOUBLE) AS weight"))
def index_retrieve(spark, sf):
    """X5 + K4 + S18 + X7 + R9: index the documents (dense row ids, postings
    bucketed by document and sorted by dim in the shared folder), read the
    bucketed table back, retrieve the benchmark passages and map row ids
    back to document ids.  Postings store float32 weights (as the
    reference's index does), so scores are those of float32 weights."""
    docs = fx.documents(spark, sf)
    vec = S.lexical_encode(docs, "doc_id", "text")
    postings, id_map, _ = ix.build_index(vec, docs.select("doc_id"), "doc_id")
    name = f"postings_{uuid.uuid4().hex[:10]}"
    ix.write_postings(postings, scratch_path(spark, name), name, parts_for(docs, BUCKETS, BUCKET_TEXT))
    q = S.lexical_encode(fx.benchmark(spark, sf), "item_id", "text", kind="query") \
        .withColumnRenamed("item_id", "qid")
    run = R.retrieve(q, ix.read_postings(spark, name), k=TOP_K, threshold=0.0, digits=6)
    return R.translate_ids(run, id_map, "did").select("qid", "did", "score", "rank")


@register("mask_lexical", f"""WITH {TURNS_CTE},
h AS (SELECT conv_id, turn, role, text,
        array_to_string(list_reverse(list(text) OVER (PARTITION BY conv_id ORDER BY turn
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), ' [SEP] ') AS history FROM turns),
u AS (SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS qid, text, history FROM h WHERE role = 'user'),
v AS (SELECT qid, token AS dim, ln(1 + count(*)) AS weight
      FROM (SELECT qid, unnest(regexp_split_to_array(lower(history), '{SPLIT}')) AS token FROM u)
      WHERE token <> '' GROUP BY qid, token),
b AS (SELECT DISTINCT qid, token AS dim
      FROM (SELECT qid, unnest(regexp_split_to_array(lower(text), '{SPLIT}')) AS token FROM u) WHERE token <> '')
SELECT v.qid, v.dim, round(v.weight, 6) AS weight FROM v JOIN b ON v.qid = b.qid AND v.dim = b.dim""")
def mask_lexical(spark, sf):
    """The encoded newest-first history of every user turn, masked to
    the terms of the turn's own utterance."""
    h = C.history(C.utterances(fx.turns(spark, sf))).where(F.col("role") == "user") \
        .withColumn("qid", T.turn_id("conv_id", "turn"))
    vec = S.lexical_encode(h, "qid", "history")
    bow = S.lexical_encode(h, "qid", "text", kind="query")
    return S.mask_lexical(vec, bow, "qid").select("qid", "dim", rounded("weight").alias("weight"))
