"""Readers for the reference's on-disk formats.

Every reader has an explicit schema (no inference) and splits lines with
Spark's own text/CSV/JSON sources, so files are read in parallel splits.
Malformed lines are dropped the way the reference skips them.  The only
driver-side peek is S16's first line (header detection).
"""

from __future__ import annotations

import csv
import json
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text, strip_ws
from ..operators.rowids import assign_row_ids
from .json_elements import read_elements

QRELS_JSON = T.MapType(T.StringType(), T.MapType(T.StringType(), T.IntegerType()))
RUN_JSON = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))


def resolve_collection_path(path: str) -> str:
    """A path that is not a ``.tsv`` file (nor a glob pattern) names a
    folder with ``raw.tsv``."""
    return path if path.endswith(".tsv") or "*" in path else os.path.join(path, "raw.tsv")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _natural(path: Column) -> Column:
    """A path that orders by its numbers: part-2 before part-10."""
    return F.regexp_replace(F.regexp_replace(path, r"(\d+)", "0000000000000000000$1"), r"0*(\d{20})", "$1")


def _numbered(df: DataFrame, *cols: Column) -> DataFrame:
    """``cols`` and ``row_id`` 0.. in reading order: files by name (numbers as
    numbers), then place in the file.  ``df`` must be a file scan."""
    seen = df.select(*cols, _natural(F.col("_metadata.file_path")).alias("_f"),
                     F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_o"))
    return assign_row_ids(seen, ["_f", "_b", "_o"]).drop("_f", "_b", "_o")


def read_collection(spark: SparkSession, path: str, with_row_ids: bool = False) -> DataFrame:
    """``id \\t text`` lines; lines of at most one char or without a tab
    are dropped; tab/newline/CR in text -> space, trimmed."""
    t = _lines(spark, resolve_collection_path(path)).where(F.length("value") > 1)
    p = F.split("value", "\t", 2)
    t = t.where(F.size(p) == 2)
    cols = strip_ws(p[0]).alias("id"), clean_text(p[1]).alias("text")
    return _numbered(t, *cols) if with_row_ids else t.select(*cols)


def read_titled_collection(spark: SparkSession, path: str) -> DataFrame:
    """``id \\t text \\t title`` with a header line; text = "title. text"
    (the title trimmed first)."""
    schema = "id string, text string, title string"
    df = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "") \
        .option("mode", "DROPMALFORMED").csv(path)
    return df.where(F.col("text").isNotNull()).select(
        "id", F.concat(strip_ws(F.coalesce("title", F.lit(""))), F.lit(". "), clean_text("text")).alias("text"))


def read_wide_collection(spark: SparkSession, path: str) -> DataFrame:
    """S3: id then any number of tab fields joined with a space."""
    p = F.split(F.col("value"), "\t")
    return _lines(spark, path).where(F.length("value") > 1).select(
        F.element_at(p, 1).alias("id"),
        strip_ws(F.array_join(F.slice(p, 2, F.size(p)), " ")).alias("text")).where(F.col("text") != "")


def read_passages_jsonl(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``{id, contents}`` JSON lines over several shards; missing
    shards, bad JSON or null fields skipped; newlines -> space."""
    existing = [p for p in paths if _exists(spark, p)]
    if not existing:
        return spark.createDataFrame([], "id string, contents string")
    df = spark.read.schema("id string, contents string").option("mode", "DROPMALFORMED").json(existing)
    return df.dropna().select("id", F.regexp_replace("contents", "[\n\r]", " ").alias("contents"))


def read_passages_jsonl_folders(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Every ``*.jsonl`` / ``*.jsonl.gz`` in several folders; tabs and
    newlines -> space; missing fields -> ''."""
    df = spark.read.schema("id string, contents string").option("pathGlobFilter", "*.jsonl*") \
        .option("mode", "DROPMALFORMED").json(folders)
    return df.select(F.coalesce("id", F.lit("")).alias("id"),
                     clean_text(F.coalesce("contents", F.lit(""))).alias("contents"))


def _elements(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """``(file, element, e)``: the objects of arrays of objects, in splits."""
    found = read_elements(spark, path)
    broken = F.when(F.col("json") != "", F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("json", 1, 80))))
    return found.select("file", "element", F.coalesce(F.from_json("json", schema, {"mode": "FAILFAST"}), broken).alias("e"))


def _numbered_elements(spark: SparkSession, path: str, schema: T.StructType, out: str) -> DataFrame:
    """The fields of the objects, and ``out``: their number in reading order."""
    e = _elements(spark, path, schema).withColumn("_f", _natural(F.col("file")))
    files = Window.orderBy("_f").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    first = e.groupBy("_f").agg(F.count(F.lit(1)).alias("_n")).select("_f", F.coalesce(F.sum("_n").over(files), F.lit(0)).alias("_first"))
    return e.join(first, "_f").select((F.col("_first") + F.col("element")).alias(out), "e.*")


TOPIC_TURN = T.StructType([
    T.StructField("utterance", T.StringType()), T.StructField("response", T.StringType()),
    T.StructField("resolved_utterance", T.StringType()),
    T.StructField("response_provenance", T.ArrayType(T.StringType()))])
TOPIC = T.StructType([T.StructField("number", T.StringType()),
                      T.StructField("turns", T.ArrayType(TOPIC_TURN))])


def read_topics_nested(spark: SparkSession, path: str) -> DataFrame:
    """An array of conversations with nested turns -> one row per turn
    ``(conv, conv_no, turn, utterance, response, rewrite, provenance)``;
    ``conv_no`` orders conversations as the file does."""
    df = _numbered_elements(spark, path, TOPIC, "_conv")
    e = df.select("_conv", "number", F.posexplode("turns").alias("turn", "t"))
    return e.select(F.coalesce("number", F.col("_conv").cast("string")).alias("conv"), F.col("_conv").alias("conv_no"), "turn",
                    F.col("t.utterance").alias("utterance"), F.col("t.response").alias("response"),
                    F.col("t.resolved_utterance").alias("rewrite"),
                    F.coalesce(F.col("t.response_provenance"), F.array().cast("array<string>")).alias("provenance"))


FLAT_TURN = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn_id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("positive_ctxs", T.ArrayType(T.StructType([T.StructField("passage_id", T.StringType())])))])


def read_turns_flat(spark: SparkSession, path: str) -> DataFrame:
    """One record per turn with its ``[SEP]`` history and positives;
    the first positive passage becomes the qrel (null if there is none)."""
    df = _elements(spark, path, FLAT_TURN).select("e.*")
    return df.select("conv_id", "turn_id", "question",
                     F.get("positive_ctxs", F.lit(0))["passage_id"].alias("passage_id"))


CONTEXT_TURN = T.StructType([
    T.StructField("Conversation_no", T.LongType()), T.StructField("Turn_no", T.LongType()),
    T.StructField("Context", T.ArrayType(T.StringType())), T.StructField("Question", T.StringType()),
    T.StructField("Truth_rewrite", T.StringType()), T.StructField("Truth_passages", T.StringType()),
    T.StructField("Answer_URL", T.StringType())])


def read_turns_context(spark: SparkSession, path: str) -> DataFrame:
    """Context records; ``Truth_passages`` may be a string, a list or
    empty — normalised to an array (read as raw JSON text first)."""
    df = _elements(spark, path, CONTEXT_TURN).select("e.*")
    tp = F.col("Truth_passages")
    as_list = F.from_json(tp, "array<string>")
    arr = F.when(tp.isNull() | (tp == "") | (tp == "[]"), F.array().cast("array<string>")) \
        .when(tp.startswith("["), as_list).otherwise(F.array(tp))
    return df.select(*[c for c in df.columns if c != "Truth_passages"], arr.alias("passages"))


def read_trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``qid 0 did rel`` (tab or space separated)."""
    parts = F.split(strip_ws(F.col("value")), r"\s+")
    return _lines(spark, path).where(F.length(strip_ws("value")) > 0).select(parts.alias("p")) \
        .where(F.size("p") == 4).select(F.col("p")[0].alias("qid"), F.col("p")[2].alias("did"),
                                        F.col("p")[3].cast("int").alias("rel"))


def _nested_json(spark: SparkSession, path: str, mtype: T.MapType, value_name: str,
                 whole_file: bool = False) -> DataFrame:
    """One ``{qid: {did: value}}`` object per line (the reference writes
    its file as a single line; our writers write one object per query), or
    with ``whole_file=True`` one object per file, on any number of lines (read
    in splits at its top-level keys).  A line that is not an object is an error."""
    if whole_file:
        pairs = read_elements(spark, path).select(F.concat(F.lit("{"), "json", F.lit("}")).alias("value"))
    lines = (pairs if whole_file else spark.read.text(path)).where(F.length(strip_ws("value")) > 0)
    broken = F.raise_error(F.concat(F.lit("not one JSON object (a pretty-printed file needs whole_file=True): "), F.substring("value", 1, 80)))
    m = lines.select(F.coalesce(F.from_json("value", mtype), broken).alias("m"))
    a = m.select(F.explode("m").alias("qid", "inner"))
    return a.select(F.col("qid").cast("string"), F.explode("inner").alias("did", value_name))


def read_nested_qrels(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """``{qid: {did: rel}}`` JSON -> rows."""
    return _nested_json(spark, path, QRELS_JSON, "rel", whole_file)


def read_nested_run(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """``{qid: {did: score}}`` JSON -> rows."""
    return _nested_json(spark, path, RUN_JSON, "score", whole_file)


def read_trec_run(spark: SparkSession, path: str) -> DataFrame:
    """``qid Q0 did rank score tag``, separated by blanks or tabs; a line
    of another number of fields, or whose score is no number, is an error."""
    lines = _lines(spark, path).where(F.length(strip_ws("value")) > 0)
    p = F.split(strip_ws(F.col("value")), r"\s+")
    score = F.when(F.size("p") == 6, F.col("p")[4].try_cast("double"))
    broken = F.raise_error(F.concat(F.lit("not a run line of six fields: "), F.substring("value", 1, 80))).cast("double")
    return lines.select("value", p.alias("p")).select(F.col("p")[0].alias("qid"), F.get("p", F.lit(2)).alias("did"), F.coalesce(score, broken).alias("score"))


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """``query \\t pos \\t neg``, trimmed, with zero scores."""
    p = F.split("value", "\t")
    return _lines(spark, path).where(F.length("value") > 1).select(p.alias("p")).where(F.size("p") == 3) \
        .select(strip_ws(F.col("p")[0]).alias("query"), strip_ws(F.col("p")[1]).alias("pos"),
                strip_ws(F.col("p")[2]).alias("neg"), F.array(F.lit(0), F.lit(0), F.lit(0)).alias("scores"))


def read_rewrites(spark: SparkSession, path: str) -> DataFrame:
    """Parquet ``(id, text)`` with positional row ids."""
    df = spark.read.parquet(path)
    return _numbered(df, *df.columns)


def _first_line(spark: SparkSession, path: str) -> str | None:
    first = spark.read.text(path).limit(1).collect()
    return first[0][0] if first else None


def read_delimited_auto(spark: SparkSession, path: str) -> DataFrame:
    """Header present iff every field of the first line contains a
    letter; otherwise columns ``id, contents``.  Format by extension
    (tab for .tsv, comma otherwise); quoted fields may hold the separator and
    line breaks; rows with too many or too few fields are skipped.  Lines are
    first looked at for an odd number of quotes: without one no field goes over
    a line end, and the file is read in splits."""
    sep = "\t" if path.endswith(".tsv") else ","
    line = _first_line(spark, path) or ""
    fields = next(csv.reader([line], delimiter=sep), [])
    header = bool(fields) and all(re.search(r"[A-Za-z]", f) for f in fields)
    broken = not spark.read.text(path).where(F.regexp_count("value", F.lit('"')) % 2 == 1).isEmpty()
    r = spark.read.option("sep", sep).option("header", header).option("mode", "DROPMALFORMED") \
        .option("quote", '"').option("escape", '"').option("multiLine", broken)
    if header:
        return r.schema(T.StructType([T.StructField(f.strip(), T.StringType()) for f in fields])).csv(path)
    names = ["id", "contents"] + [f"c{i}" for i in range(2, len(fields))]
    return r.schema(", ".join(f"{n} string" for n in names)).csv(path)


def _first_record(spark: SparkSession, path: str, head: int = 1000) -> dict:
    """The first JSON object of a file, from its first lines."""
    text = "\n".join(r[0] for r in spark.read.text(path).limit(head).collect())
    start = text.find("{")
    return json.JSONDecoder().raw_decode(text[start:])[0] if start >= 0 else {}


def _fitting(df: DataFrame, first: dict) -> DataFrame:
    """``df`` of strings with the types of the first record's values, widened
    (integer, double, string) where a later value would not fit: one pass."""
    ways = {bool: ["boolean"], int: ["long", "double"], float: ["double"]}
    tries = {k: ways.get(type(v), []) for k, v in first.items()}
    # an integer too large for a long would lose digits as a double
    fits = {"boolean": lambda c: c.try_cast("boolean"), "long": lambda c: c.try_cast("long"),
            "double": lambda c: F.when(c.try_cast("long").isNotNull() | c.rlike("[.eE]"), c.try_cast("double"))}
    lost = [F.max(F.col(f"`{k}`").isNotNull() & fits[t](F.col(f"`{k}`")).isNull()).alias(f"{t} {k}") for k, ts in tries.items() for t in ts]
    found = df.agg(*lost).first().asDict() if lost else {}
    kind = {k: next((t for t in ts if not found[f"{t} {k}"]), "string") for k, ts in tries.items()}
    return df.select(*[F.col(f"`{k}`").cast(kind[k]).alias(k) for k in first])


def read_json_qrels_auto(spark: SparkSession, path: str) -> DataFrame:
    """JSON / JSON-lines records.  Records named query, doc, relevance
    are read by name; other records of three fields are renamed to these in
    the order of the first record's keys; more or fewer fields keep their
    names.  Types follow the first record and widen until every value fits,
    so no value is lost (nested values as JSON text)."""
    first = _first_record(spark, path)
    names = ["query", "doc", "relevance"]
    schema = T.StructType([T.StructField(k, T.StringType()) for k in first])
    df = spark.read.schema(schema).json(path, multiLine=path.endswith(".json") and not path.endswith(".jsonl"))
    df = _fitting(df, first)
    if set(first) == set(names):
        return df.select(*names)
    return df.toDF(*names) if len(first) == 3 else df


def read_query_file(spark: SparkSession, path: str) -> DataFrame:
    """One column (row ids synthesised in file order) or two columns
    ``row_id \\t question``; anything else is an error."""
    line = _first_line(spark, path)
    n = len(line.split("\t")) if line is not None else 2
    if n == 2:
        p = F.split("value", "\t", 2)
        return _lines(spark, path).select(p.alias("p")).where(F.size("p") == 2) \
            .select(F.col("p")[0].cast("long").alias("row_id"), F.col("p")[1].alias("question"))
    if n == 1:
        return _numbered(_lines(spark, path), F.col("value").alias("question")).select("row_id", "question")
    raise ValueError(f"unexpected number of columns in {path}: {n}")


def read_corpus_tables(docs: DataFrame, queries: DataFrame, qrels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CAsT-style docs ``(doc_id, text)``, queries ``(query_id,
    topic_number, raw_utterance, manual_rewritten_utterance,
    automatic_rewritten_utterance, manual_canonical_result_id)`` and qrels
    ``(query_id, doc_id, relevance)`` with their expected columns."""
    return (docs.select("doc_id", "text"),
            queries.select("query_id", "topic_number", "raw_utterance", "manual_rewritten_utterance",
                           "automatic_rewritten_utterance", "manual_canonical_result_id"),
            qrels.select("query_id", "doc_id", "relevance"))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)
