"""Registered queries: corpus formats and recipes, positional helpers, side outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..functions.text import SEP_JOIN, clean_text
from ..operators import distill as L
from ..operators import logs as G
from ..operators import metrics as M
from ..operators import prep as P
from ..operators import recipes as X
from ..operators import rowids as W
from ..operators import sparse as S
from ..session import scratch_path
from ..sources import readers as IN
from ..sources import sinks as K
from . import fixtures as fx
from .q_io import _CLEAN, _text_file
from .registry import QRELS_CTE, RUN_CTE, TURNS_CTE, VEC_CTE, register

FILES = 4


def _json_arrays(records: DataFrame, key: str, name: str) -> str:
    """``records(key, json)`` as files that hold one JSON array each."""
    path = scratch_path(records.sparkSession, name)
    parts = records.groupBy(F.pmod(F.xxhash64(key), F.lit(FILES)).alias("_p")).agg(F.collect_list("json").alias("_j"))
    parts.select("_p", F.concat(F.lit("["), F.concat_ws(",\n", "_j"), F.lit("]")).alias("value")).write.partitionBy("_p").text(path)
    return f"{path}/*"


def _user_turns(spark, sf) -> DataFrame:
    """User turns with what was said before (oldest first), the reply, and
    their number in the conversation."""
    t = fx.turns(spark, sf).where("role <> 'system'")
    per = Window.partitionBy("conv_id").orderBy("turn")
    before = F.collect_list("text").over(per.rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("before", before).withColumn("reply", F.lead("text").over(per))
    return t.where("role = 'user'").withColumn("nth", F.row_number().over(per))


_USER = f"""WITH {TURNS_CTE},
b AS (SELECT *, coalesce(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS before,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM turns),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM b WHERE role = 'user')"""


@register("topics_nested_roundtrip", _USER + """
SELECT CAST(conv_id AS VARCHAR) AS conv, CAST(nth - 1 AS INTEGER) AS turn, text AS utterance, reply AS response, 'about ' || text AS rewrite,
  'd' || turn || ',e' || nth AS provenance FROM u""")
def topics_nested_roundtrip(spark, sf):
    """Conversations as arrays of topics with nested turns, read back as rows."""
    u = _user_turns(spark, sf)
    turn = F.struct("nth", F.struct(F.col("text").alias("utterance"), F.col("reply").alias("response"), F.concat(F.lit("about "), "text").alias("resolved_utterance"),
                                    F.array(F.concat(F.lit("d"), "turn"), F.concat(F.lit("e"), "nth")).alias("response_provenance")).alias("t"))
    topics = u.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["t"]).alias("turns"))
    path = _json_arrays(topics.select("conv_id", F.to_json(F.struct(F.col("conv_id").cast("string").alias("number"), "turns")).alias("json")), "conv_id", "topics")
    t = IN.read_topics_nested(spark, path)
    return t.select("conv", "turn", "utterance", "response", "rewrite", F.array_join("provenance", ",").alias("provenance"))


def _flat(spark, sf) -> DataFrame:
    u = _user_turns(spark, sf)
    question = F.array_join(F.concat("before", F.array("text")), SEP_JOIN).alias("question")
    found = F.when(F.col("turn") % 4 != 2, F.array(F.struct(F.concat(F.lit("p"), "conv_id").alias("passage_id")), F.struct(F.lit("second").alias("passage_id"))))
    record = F.to_json(F.struct("conv_id", F.col("turn").alias("turn_id"), question, F.coalesce(found, F.array().cast("array<struct<passage_id:string>>")).alias("positive_ctxs")))
    return IN.read_turns_flat(spark, _json_arrays(u.select("conv_id", record.alias("json")), "conv_id", "flat"))


_FLAT = _USER + """,
f AS (SELECT conv_id, turn, array_to_string(list_append(before, text), ' [SEP] ') AS question, text, before, CASE WHEN turn % 4 <> 2 THEN 'p' || conv_id END AS passage_id FROM u)"""


@register("turns_flat_roundtrip", _FLAT + """
SELECT conv_id, turn AS turn_id, question, passage_id FROM f""")
def turns_flat_roundtrip(spark, sf):
    """One record a turn with its history and passages, the first of them kept."""
    return _flat(spark, sf)


@register("recipe_flat", _FLAT + """,
r AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id FROM f)
SELECT CAST(row_id AS BIGINT) AS row_id, text AS last, array_to_string(list_reverse(list_append(before, text)), ' [SEP] ') AS history, passage_id AS did FROM r""")
def recipe_flat(spark, sf):
    """X17, flat turns: history, last utterance and labels under dense row ids."""
    out = X.topiocqa(_flat(spark, sf))
    labels = out["qrels"].select(F.col("qid").cast("long").alias("row_id"), "did")
    return out["queries_last"].withColumnRenamed("text", "last").join(out["queries_all"].withColumnRenamed("text", "history"), "row_id") \
        .join(labels, "row_id", "left").select("row_id", "last", "history", "did")


def _context(spark, sf) -> DataFrame:
    """Truth passages as a list, a string or an empty one, by conversation."""
    u = _user_turns(spark, sf)
    base = F.to_json(F.struct(F.col("conv_id").alias("Conversation_no"), F.col("nth").alias("Turn_no"), F.col("before").alias("Context"),
                              F.col("text").alias("Question"), F.concat(F.lit("about "), "text").alias("Truth_rewrite")))
    one = F.concat(F.lit('"u'), "turn", F.lit('"'))
    truth = F.when(F.col("conv_id") % 3 == 0, F.lit('""')).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("["), one, F.lit(',"v"]'))).otherwise(one)
    record = F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(',"Truth_passages":'), "t", F.lit("}"))
    rows = u.select("conv_id", base.alias("j"), truth.alias("t")).select("conv_id", record.alias("json"))
    return IN.read_turns_context(spark, _json_arrays(rows, "conv_id", "context"))


_CONTEXT = _USER + """,
c AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['u' || turn, 'v'] ELSE ['u' || turn] END AS passages FROM u)"""


@register("turns_context_roundtrip", _CONTEXT + """
SELECT conv_id, CAST(nth AS BIGINT) AS turn, text AS question, 'about ' || text AS rewrite, array_to_string(passages, ',') AS passages,
  CAST(len(before) AS BIGINT) AS n_context FROM c""")
def turns_context_roundtrip(spark, sf):
    """Context records, truth passages of three kinds made one."""
    c = _context(spark, sf)
    return c.select(F.col("Conversation_no").alias("conv_id"), F.col("Turn_no").alias("turn"), F.col("Question").alias("question"),
                    F.col("Truth_rewrite").alias("rewrite"), F.array_join("passages", ",").alias("passages"), F.size("Context").cast("long").alias("n_context"))


@register("recipe_context", _CONTEXT + """,
r AS (SELECT *, row_number() OVER (ORDER BY conv_id, nth) - 1 AS row_id FROM c WHERE len(passages) > 0),
p AS (SELECT row_id, unnest(list_distinct(passages)) AS did, CASE WHEN nth = 1 THEN 'about ' || text ELSE text END AS q FROM r)
SELECT CAST(row_id AS BIGINT) AS row_id, regexp_replace(substr(q, 1, 320), '^\\s+|\\s+$', '', 'g') AS last, did FROM p""")
def recipe_context(spark, sf):
    """X17, context records: turns without truth passages dropped, questions cut, labels by row id."""
    out = X.qrecc(_context(spark, sf))
    return out["queries_last"].withColumnRenamed("text", "last").join(out["qrels"].select(F.col("qid").cast("long").alias("row_id"), "did"), "row_id")


@register("wide_collection", f"""SELECT CAST(doc_id AS VARCHAR) AS id, regexp_replace(coalesce(lang, '') || ' ' || coalesce(source, '') || ' ' || {_CLEAN}, '^\\s+|\\s+$', '', 'g') AS text
FROM documents""")
def wide_collection(spark, sf):
    """S3: lines of an id and three fields, the fields joined by a blank."""
    d = fx.table(spark, sf, "documents")
    line = F.concat_ws("\t", "doc_id", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")), clean_text("text"))
    return IN.read_wide_collection(spark, _text_file(d, line, "wide"))


@register("triplets_roundtrip", f"""SELECT lang || ' ' || doc_id AS query, {_CLEAN} AS pos, source || ' ' || doc_id AS neg FROM documents""")
def triplets_roundtrip(spark, sf):
    """Query, positive and negative as lines of three fields."""
    d = fx.table(spark, sf, "documents")
    line = F.concat_ws("\t", F.concat_ws(" ", "lang", "doc_id"), clean_text("text"), F.concat_ws(" ", "source", "doc_id"))
    return IN.read_triplets(spark, _text_file(d, line, "triplets")).select("query", "pos", "neg")


@register("rows_of_a_rank", """SELECT row_id, doc_id FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_id, doc_id FROM documents) WHERE row_id % 4 = 1""")
def rows_of_a_rank(spark, sf):
    """R1 + R2: documents under dense row ids, those of rank 1 of 4."""
    return W.split_round_robin(W.assign_row_ids(fx.documents(spark, sf).select("doc_id"), ["doc_id"]), 1, 4).select("row_id", "doc_id")


@register("first_rows", """SELECT row_id, doc_id FROM (SELECT row_number() OVER (ORDER BY doc_id DESC) - 1 AS row_id, doc_id FROM documents) WHERE row_id < 100""")
def first_rows(spark, sf):
    """Exactly the first hundred rows of an order."""
    return W.take_first(W.assign_row_ids(fx.documents(spark, sf).select("doc_id"), [F.col("doc_id").desc()]), 100).select("row_id", "doc_id")


@register("limited_queries", f"""WITH {QRELS_CTE}
SELECT qid, did, rel FROM qrels WHERE qid IN (SELECT qid FROM qrels GROUP BY qid ORDER BY qid LIMIT 25)""")
def limited_queries(spark, sf):
    """The labels of the first 25 queries."""
    return W.limit_queries(fx.lineitem_qrels(spark, sf), 25).select("qid", "did", "rel")


@register("cast_ids", f"""WITH {RUN_CTE}
SELECT CAST(qid AS VARCHAR) AS qid, CAST(did AS VARCHAR) AS did, score FROM run""")
def cast_ids(spark, sf):
    """R10 + T1: ids as strings, in numeric order."""
    return W.sort_by_int_id(W.cast_ids(fx.lineitem_run(spark, sf), ["qid", "did"], ["score"]), "did")


@register("lookup_answer", """SELECT l.doc_id, CAST(length(coalesce(d.text, '')) AS BIGINT) AS n_chars
FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang = 'en') d ON d.doc_id = l.doc_id""")
def lookup_answer(spark, sf):
    """The text of each labelled document, empty where the collection lacks it."""
    q = fx.table(spark, sf, "labels").select("doc_id")
    docs = fx.table(spark, sf, "documents").where("lang = 'en'")
    return P.lookup_answer(q, docs, "doc_id").select("doc_id", F.length("answer").cast("long").alias("n_chars"))


@register("align_by_position", """SELECT doc_id, page_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents) d
JOIN (SELECT page_id, row_number() OVER (ORDER BY page_id DESC) AS i FROM pages) p ON p.i = d.i""")
def align_by_position(spark, sf):
    """The i-th document with the i-th page of the opposite order."""
    return P.align_by_position(fx.documents(spark, sf).select("doc_id"), fx.table(spark, sf, "pages").select("page_id"),
                               ["doc_id"], [F.col("page_id").desc()]).select("doc_id", "page_id")


@register("explicit_positives", """SELECT d.doc_id AS qid, md5(text) AS digest FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE toxic = 0""")
def explicit_positives(spark, sf):
    """L4: positives whose text is stored with the query, under its own id."""
    d = fx.documents(spark, sf).join(fx.table(spark, sf, "labels"), "doc_id")
    pairs = d.select(F.col("doc_id").alias("qid"), (F.col("doc_id") + F.col("toxic")).alias("did"), "text")
    return L.explicit_positives(pairs).select("qid", F.md5(F.col("pos_text").cast("binary")).alias("digest"))


@register("stats_log", f"""WITH {VEC_CTE},
per AS (SELECT e.vec_id, count(v.dim) AS l0 FROM embeddings e LEFT JOIN vec v ON e.vec_id = v.vec_id GROUP BY e.vec_id),
s AS (SELECT round(avg(l0), 6) AS l0, CAST(count(*) AS BIGINT) AS n_docs FROM per)
SELECT * FROM s UNION ALL SELECT * FROM s""")
def stats_log(spark, sf):
    """K6: statistics of an index appended after each of two builds."""
    path = scratch_path(spark, "stats")
    for _ in range(2):
        K.write_stats(S.sparsity_stats(fx.vectors(spark, sf), fx.vector_ids(spark, sf), "vec_id"), path)
    return spark.read.parquet(path).select(rounded("l0").alias("l0"), F.col("n_docs").cast("long"))


@register("query_reps", f"""WITH {VEC_CTE}
SELECT vec_id AS qid, string_agg(CAST(dim AS VARCHAR), ',' ORDER BY dim) AS cols, round(sum(weight), 6) AS total FROM vec GROUP BY vec_id""")
def query_reps(spark, sf):
    """K7: queries as two aligned arrays, written and read back."""
    path = scratch_path(spark, "reps")
    K.write_query_reps(fx.query_terms(spark, sf), path)
    total = F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x)
    return spark.read.parquet(path).select("qid", F.array_join("cols", ",").alias("cols"), rounded(total).alias("total"))


@register("metrics_log", f"""WITH {RUN_CTE}, {QRELS_CTE},
n AS (SELECT qid, CAST(count(*) AS BIGINT) AS num_rel FROM qrels GROUP BY qid),
r AS (SELECT run.qid, CAST(count(*) AS BIGINT) AS num_ret FROM run JOIN n ON n.qid = run.qid GROUP BY run.qid)
SELECT run, r.qid, num_ret, num_rel FROM r JOIN n ON n.qid = r.qid, (SELECT unnest(['first', 'second']) AS run)""")
def metrics_log(spark, sf):
    """K8: per-query measures of two runs appended to one log."""
    path = scratch_path(spark, "metrics")
    pq = M.per_query(fx.lineitem_run(spark, sf), fx.lineitem_qrels(spark, sf), cutoffs=[10]).select("qid", "num_ret", "num_rel")
    for name in ("first", "second"):
        G.append_metrics(pq.withColumn("run", F.lit(name)), path)
    return spark.read.parquet(path).select("run", "qid", "num_ret", "num_rel")
