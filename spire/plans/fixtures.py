"""Stand-in inputs built from the driver's test tables.

Each function only reshapes a test table into the schema an operator
expects (FIXTURES.md §2); none of them does an operator's work.

  * sparse vectors    embeddings: position = dim, F13 applied by the encoder
  * retrieval          every embedding is both a query and a document
                       (self retrieval over the whole table)
  * known-item qrels   a query's relevant document is its own vector
  * large run          lineitem grouped by (supplier = qid, order = did),
                       score = max extended price
  * graded qrels       rel = number of returned ('R') lines of the pair
  * judgements         the same with rel = 0 for pairs whose lines were only
                       accepted ('A')
  * second teacher     greatest discount of the pair, where positive
  * conversation turns every conversation row, text cleaned
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators.sparse import dense_to_sparse


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(vec_id, dim, weight)``: the sparse vector of every embedding."""
    return dense_to_sparse(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumnRenamed("vec_id", "qid")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumnRenamed("vec_id", "did")


def vector_ids(spark: SparkSession, sf_dir: str, name: str = "vec_id") -> DataFrame:
    """The id map: every vector, including one without a positive weight."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(name))


def known_item_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("qid"), F.col("vec_id").alias("did"), F.lit(1).alias("rel"))


def lineitem_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, did, score)``: teacher one."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("qid"), F.col("l_orderkey").alias("did")) \
        .agg(F.max("l_extendedprice").cast("double").alias("score"))


def lineitem_run2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, did, score)``: teacher two, the greatest discount of the pair;
    like any run it lists positive scores only, so pairs sold without a
    discount are missing from it."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("qid"), F.col("l_orderkey").alias("did")) \
        .agg(F.max(F.col("l_extendedprice") * F.col("l_discount")).cast("double").alias("score")).where(F.col("score") > 0)


def lineitem_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, did, rel)`` graded: rel = returned lines of the pair (> 0)."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("qid"), F.col("l_orderkey").alias("did")) \
        .agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("int").alias("rel")) \
        .where(F.col("rel") > 0)


def lineitem_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(qid, did, rel)`` with judged non-relevant pairs: rel = returned
    lines, 0 where lines were only accepted; pairs with neither are unjudged."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A"))
    return li.groupBy(F.col("l_suppkey").alias("qid"), F.col("l_orderkey").alias("did")) \
        .agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("int").alias("rel"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, role, text)`` of every row, text cleaned."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", clean_text("text").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", "text")
