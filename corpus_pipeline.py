"""The corpus pipeline: quality, near duplicates, personal data, mixing, pieces.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read back as the next
stage's docs.  All stages but the last return the columns of ``documents``.
``run`` applies them to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spire.llm.common import WORD, stored, table
from spire.llm.mixing import mix_sources
from spire.llm.pieces import encode_documents
from spire.llm.pii import replace_private
from spire.llm.quality import keep_good
from spire.llm.similar import similar_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.5) go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own, stored: numbers follow the splits of a
    scan, and these follow the cores at hand, so two readings may differ.
    Whole texts lie here until the run ends, so they are packed tightly."""
    return stored(docs.withColumn("_row", F.monotonically_increasing_id()), "rows", "zstd")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of smallest doc_id (a null id
    comes last, of one id the first row stays); groups are linked by a Jaccard
    similarity of 0.8 or more on sets of five-word shingles.  Rows without
    words stay; of those equal in id and text one does."""
    keyed = _keyed(docs)
    named = similar_documents(keyed, width=5, num=80, den=100, row="_row")
    first = (named.where("component is not null").groupBy("component")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("first")).select("first._row"))
    blank = (keyed.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
             .groupBy("doc_id", F.sha2("text", 256)).agg(F.min("_row").alias("_row")).select("_row"))
    return keyed.join(first.unionByName(blank), "_row", "left_semi").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets give way to surrogates; n_chars follows the text."""
    return replace_private(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document appears as often as the mix takes it: its taken words over
    its size, rounded, so 0 to 2 times.  Documents without words are never
    taken; rows that share an id are documents of their own."""
    keyed = _keyed(docs)
    taken = (mix_sources(keyed, row="_row").where("size > 0")
             .select("_row", F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("_n")).where("_n > 0"))
    words = keyed.join(taken, "_row")
    return words.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix: doc_id, ids."""
    return encode_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data),
          ("mixing", mixing), ("pieces", pieces)]

#: SQL can't express the trained stages; the tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
