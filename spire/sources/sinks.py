"""Writers for runs, qrels, query files and statistics (K1-K3, K6, K7).

Parquet is the default everywhere; the nested JSON forms of the reference
are export formats built with ``map_from_entries`` per query (one map per
query, bounded by the run depth k).  Postings (K4, K5, K9) are in
``operators.index``, metric logs (K8) in ``operators.logs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_run(run: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K1: a run as parquet rows, or as ``{qid: {did: score}}`` JSON lines
    (one object per query)."""
    if fmt == "parquet":
        run.select("qid", "did", "score").write.mode("overwrite").parquet(path)
        return
    nested = run.groupBy(F.col("qid").cast("string").alias("qid")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("did").cast("string"), F.col("score")))).alias("docs"))
    nested.select(F.to_json(F.create_map("qid", "docs")).alias("value")).write.mode("overwrite").text(path)


def write_qrels(qrels: DataFrame, path: str, fmt: str = "parquet") -> None:
    """K3: qrels as parquet or ``{qid: {did: rel}}`` JSON lines."""
    if fmt == "parquet":
        qrels.select("qid", "did", "rel").write.mode("overwrite").parquet(path)
        return
    nested = qrels.groupBy(F.col("qid").cast("string").alias("qid")).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("did").cast("string"), F.col("rel")))).alias("docs"))
    nested.select(F.to_json(F.create_map("qid", "docs")).alias("value")).write.mode("overwrite").text(path)


def write_queries_tsv(df: DataFrame, path: str, id_col: str = "row_id", text_col: str = "text") -> None:
    """K2: ``row_id \\t text`` lines sorted by the numeric id (a range
    sort: every partition writes one ordered slice)."""
    df.select(F.col(id_col).cast("string"), F.col(text_col)) \
        .orderBy(F.col(id_col).cast("long")) \
        .write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "") \
        .option("emptyValue", "").option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)


def write_stats(stats: DataFrame, path: str) -> None:
    """K6: append one row of index statistics."""
    stats.write.mode("append").parquet(path)


def query_reps(q_vec: DataFrame, qid: str = "qid") -> DataFrame:
    """K7: per query its dims and weights as two aligned arrays in dim
    order (bounded by the query's non-zeros)."""
    s = q_vec.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("dim", "weight"))).alias("_s"))
    return s.select(qid, F.transform("_s", lambda e: e["dim"]).alias("cols"),
                    F.transform("_s", lambda e: e["weight"]).alias("values"))


def write_query_reps(q_vec: DataFrame, path: str, qid: str = "qid") -> None:
    query_reps(q_vec, qid).write.mode("overwrite").parquet(path)
