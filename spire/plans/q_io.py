"""Registered queries: sinks and sources round-tripped over whole tables.

Each query writes a table in the reference's on-disk format to a fresh
folder under the shared folder and reads it back with the matching reader.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..functions.text import clean_text
from ..operators import runs as U
from ..operators.layout import parts_for
from ..session import scratch_path
from ..sources import readers as S
from ..sources import sinks as K
from . import fixtures as fx
from .registry import QRELS_CTE, RUN2_CTE, RUN_CTE, register

_CLEAN = r"regexp_replace(regexp_replace(text, '[\t\n\r]', ' ', 'g'), '^\s+|\s+$', '', 'g')"


@register("collection_roundtrip", f"""SELECT CAST(doc_id AS VARCHAR) AS id, {_CLEAN} AS text FROM documents""")
def collection_roundtrip(spark, sf):
    """K2 + S1 (+ F1): every document written as an ``id \\t text`` line
    (sorted by numeric id) and read back as a collection."""
    path = scratch_path(spark, "collection-tsv")
    docs = fx.documents(spark, sf).select(F.col("doc_id").alias("row_id"), clean_text("text").alias("text"))
    K.write_queries_tsv(docs, path)
    return S.read_collection(spark, path + "/part-*")


@register("passages_jsonl", """SELECT CAST(doc_id AS VARCHAR) AS id,
  regexp_replace(text, '[\n\r]', ' ', 'g') AS contents FROM documents""")
def passages_jsonl(spark, sf):
    """Documents stored as ``{id, contents}`` JSON lines over
    several shards (and one missing shard) read back."""
    path = scratch_path(spark, "passages-jsonl")
    docs = fx.documents(spark, sf)
    docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("contents")) \
        .repartition(parts_for(docs, 4)).write.mode("overwrite").json(path)
    return S.read_passages_jsonl(spark, [path, path + "-missing-shard"])


@register("qrels_json_roundtrip", f"""WITH {QRELS_CTE}
SELECT CAST(qid AS VARCHAR) AS qid, CAST(did AS VARCHAR) AS did, rel FROM qrels""")
def qrels_json_roundtrip(spark, sf):
    """K3 + S11: graded qrels written as nested ``{{qid: {{did: rel}}}}`` JSON
    and read back as rows (ids become strings)."""
    path = scratch_path(spark, "qrels-json")
    K.write_qrels(fx.lineitem_qrels(spark, sf), path, fmt="json")
    return S.read_nested_qrels(spark, path)


@register("run_json_roundtrip", f"""WITH {RUN_CTE}, {RUN2_CTE},
u AS (SELECT * FROM run UNION ALL SELECT * FROM run2)
SELECT CAST(qid AS VARCHAR) AS qid, CAST(did AS VARCHAR) AS did, round(avg(score), 6) AS score
FROM u GROUP BY qid, did""")
def run_json_roundtrip(spark, sf):
    """A10 + K1 + S12: the fused run written as nested JSON (one object per
    query) and read back."""
    path = scratch_path(spark, "run-json")
    fused = U.fuse_runs([fx.lineitem_run(spark, sf), fx.lineitem_run2(spark, sf)])
    K.write_run(fused, path, fmt="json")
    r = S.read_nested_run(spark, path)
    return r.select("qid", "did", rounded("score").alias("score"))


_QRELS_ROWS = f"""WITH {QRELS_CTE}
SELECT CAST(qid AS VARCHAR) AS qid, CAST(did AS VARCHAR) AS did, rel FROM qrels"""


def _text_file(df, line, name):
    path = scratch_path(df.sparkSession, name)
    df.select(line.alias("value")).write.text(path)
    return path


@register("trec_qrels_roundtrip", _QRELS_ROWS)
def trec_qrels_roundtrip(spark, sf):
    """Graded qrels as ``qid 0 did rel`` lines, read back."""
    q = fx.lineitem_qrels(spark, sf)
    return S.read_trec_qrels(spark, _text_file(q, F.concat_ws(" ", "qid", F.lit("0"), "did", "rel"), "qrels-trec"))


@register("trec_run_roundtrip", f"""WITH {RUN_CTE}
SELECT CAST(qid AS VARCHAR) AS qid, CAST(did AS VARCHAR) AS did, round(score, 6) AS score FROM run""")
def trec_run_roundtrip(spark, sf):
    """A ranked run as ``qid Q0 did rank score tag`` lines, read back."""
    r = U.truncate_run(fx.lineitem_run(spark, sf), None)
    line = F.concat_ws(" ", "qid", F.lit("Q0"), "did", "rank", F.col("score").cast("decimal(18,4)"), F.lit("run"))
    return S.read_trec_run(spark, _text_file(r, line, "run-trec")).withColumn("score", rounded("score"))


@register("json_qrels_roundtrip", f"""WITH {QRELS_CTE}
SELECT qid AS query, did AS doc, CAST(rel AS BIGINT) AS relevance FROM qrels""")
def json_qrels_roundtrip(spark, sf):
    """Qrels as JSON records under other names, renamed by their order."""
    path = scratch_path(spark, "qrels-records")
    fx.lineitem_qrels(spark, sf).select("qid", F.col("did").alias("docid"), "rel").write.json(path)
    return S.read_json_qrels_auto(spark, path)


@register("titled_collection", f"""SELECT CAST(doc_id AS VARCHAR) AS id, source || '. ' || {_CLEAN} AS text FROM documents""")
def titled_collection(spark, sf):
    """Documents as ``id, text, title`` lines under a header, the source as title."""
    path = scratch_path(spark, "collection-titled")
    docs = fx.table(spark, sf, "documents")
    docs.select(F.col("doc_id").alias("id"), clean_text("text").alias("text"), F.col("source").alias("title")) \
        .write.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return S.read_titled_collection(spark, path)


@register("quoted_collection", f"""SELECT CAST(doc_id AS VARCHAR) AS id, {_CLEAN} AS contents FROM documents""")
def quoted_collection(spark, sf):
    """Documents as CSV under a header, commas and quotes in quoted fields."""
    path = scratch_path(spark, "collection-csv")
    fx.documents(spark, sf).select(F.col("doc_id").cast("string").alias("id"), clean_text("text").alias("contents")) \
        .write.option("header", True).option("escape", '"').csv(path)
    return S.read_delimited_auto(spark, path)


@register("rewrites_in_order", """SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id,
  conv_id || '_' || turn AS id FROM conversations""")
def rewrites_in_order(spark, sf):
    """Texts in several parquet files get row ids in file order."""
    path = scratch_path(spark, "rewrites")
    fx.table(spark, sf, "conversations").orderBy("conv_id", "turn").select(
        F.concat_ws("_", "conv_id", "turn").alias("id"), "text").write.parquet(path)
    return S.read_rewrites(spark, path).select("row_id", "id")


@register("query_file", f"""SELECT doc_id AS row_id, {_CLEAN} AS question FROM documents""")
def query_file(spark, sf):
    """A two-column query file."""
    path = scratch_path(spark, "query-file")
    K.write_queries_tsv(fx.documents(spark, sf).select(F.col("doc_id").alias("row_id"), clean_text("text").alias("text")), path)
    return S.read_query_file(spark, path)
