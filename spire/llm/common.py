"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import scratch_path

#: one word: a run of characters other than ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage,
    survives a lost executor, and lets several later steps share one result."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words (null text: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_bucket(digest: Column, rows: int, per_bucket: int) -> Column:
    """Leading hex digits of a hash as a bucket number, so that about
    ``per_bucket`` of ``rows`` rows share one; ascending with the hash."""
    digits = max(1, math.ceil(math.log(max(2.0, rows / per_bucket), 16)))
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def ranked(df: DataFrame, part: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """Zero-based rank inside ``part`` by (bucket, order), in two levels: a row
    number inside each bucket plus the count of the earlier buckets, so that no
    task holds a whole part.  ``df`` is read twice; pass a stored table."""
    counts = df.groupBy(*part, bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(*part, bucket).orderBy(*order)
    return (df.withColumn("_rn", F.row_number().over(own))
            .join(offsets, [*part, bucket])
            .withColumn(out, (F.col("_before") + F.col("_rn") - 1).cast("long"))
            .drop("_before", "_rn"))


def hash_words(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of a list of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix), vectorized; wraps on overflow."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive items (none if shorter)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n])
    return mix(out)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` (any orderable type, no nulls).

    Returns (node, root), root the smallest node of the component, for every
    node with an edge.  Alternates large-star and small-star steps; each is
    one map-side combined minimum per node and a join back, so a hub with any
    number of neighbours never meets in one task.  Stored after every round;
    rounds grow with the logarithm of the longest path.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        # large star: neighbours above a node point to its smallest neighbour
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: a node and its smaller neighbours point to the smallest
        large = stored(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a")
                 .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        small = stored(small, "small")
        # done when every edge points straight at a root
        chained = small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        forked = small.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if chained.isEmpty() and forked.isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        e = small


def id_crc(doc_id: Column) -> Column:
    """crc32 of an id as text (unsigned); null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def sample_labels(labels: DataFrame, label: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` labelled ids per class, the first in hash order:
    (doc_id, y, h).  Null ids and labels other than 0 and 1 are left out; of
    conflicting labels of an id the higher holds."""
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
           .groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id", F.lit(seed))))
    picks = [one.where(F.col("y") == y).orderBy("h", "doc_id").limit(rows) for y in (0, 1)]
    return picks[0].unionByName(picks[1])


def sample_texts(docs: DataFrame, picked: DataFrame, name: str) -> DataFrame:
    """The texts of ``picked(doc_id, y, h)``, stored: one row an id, so no more
    than were picked.  Of several texts of an id the one of least hash."""
    found = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(picked), "doc_id")
    one = found.groupBy("doc_id", "y", "h").agg(F.min(F.struct(F.xxhash64("text").alias("k"), "text")).alias("t"))
    return stored(one.select("doc_id", "y", "h", "t.text"), name)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 100) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; column 0 is the intercept."""
    w = np.zeros(x.shape[1])
    c = np.ones(len(y)) if weight is None else weight
    pen = np.full(x.shape[1], ridge)
    pen[0] = 1e-6

    def loss(v):
        z = x @ v
        return float((c * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (pen * v * v).sum())

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (c * (p - y)) + pen * w
        h = (x * (c * p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-9)
        d = np.linalg.solve(h, g)
        t = 1.0
        while t > 1e-6 and loss(w - t * d) > now:
            t /= 2
        new = loss(w - t * d)
        if now - new < 1e-9 * (1 + abs(now)):
            break
        w, now = w - t * d, new
    return w


def spread(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, their squares and products, and an intercept."""
    z = np.clip((x - mean) / scale, -8, 8)
    k = z.shape[1]
    both = [z[:, i] * z[:, j] for i in range(k) for j in range(i, k)]
    return np.column_stack([np.ones(len(z)), z, *both])


@F.arrow_udf(T.BinaryType())
def packed(text: pa.Array) -> pa.Array:
    """Each text as zstandard bytes, to halve what a shuffle of whole texts moves (null stays null)."""
    press = zstandard.ZstdCompressor(level=3)
    return pa.array([None if t is None else press.compress(t.encode("utf-8", "surrogatepass")) for t in text.to_pylist()], pa.binary())


def unpacked(column: pa.Array) -> list[bytes | None]:
    tool = zstandard.ZstdDecompressor()
    return [None if b is None else tool.decompress(b) for b in column.to_pylist()]
