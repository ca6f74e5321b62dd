"""Filter interaction audit: what every filter removes in every order of the filters."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD

#: the five text filters, one letter each, in the order of their bits
FILTERS = "ABCDE"
COUNTS = ("kept", "removed", "redundant", "unique_fails")


def _bits(*fails: Column) -> Column:
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def fail_masks(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` as narrow rows (doc_id, part, digest, mask):
    the digest stands for the text, and bit i of the mask says that the text
    fails filter i of A to D.

    A: under 200 words; B: distinct words under half of all; C: over 3 % of
    the code points are A-Z; D: holds any of ``#$%&*|``.  Null texts are empty,
    part is the language (null: the empty string)."""
    words = (docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
             .withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.octet_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long")
    mask = _bits(n < 200, 100 * distinct.cast("long") < 50 * n.cast("long"), 100 * capitals > 3 * F.length("text").cast("long"), F.col("text").rlike("[#$%&*|]"))
    return words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.alias("mask"))


def failure_classes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents counted by what they fail: (part, mask, good, toxic, n).

    Bit 4 (E) is set where a smaller doc_id of the whole table has the same
    text.  Texts are read once; from there on rows are a few bytes.  Copies are
    counted per (text, part, mask, labels) with the least id and how many rows
    have it, combined before each shuffle, so a text or an id that holds a
    third of all rows comes as one row a task; rows without an id have no
    labels and do not take part in the join."""
    rows = fail_masks(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    marks = (labels.where("doc_id is not null").groupBy("doc_id")
             .agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]))
    known = rows.where("doc_id is not null").join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    unknown = rows.where("doc_id is null").withColumn("good", F.lit(0)).withColumn("toxic", F.lit(0))
    group = ["digest", "part", "mask", "good", "toxic"]
    copies = (known.unionByName(unknown).groupBy(*group)
              .agg(F.sum("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("low")))
    least = F.min(F.struct("low.none", "low.doc_id")).over(Window.partitionBy("digest"))
    first = F.when(F.struct("low.none", "low.doc_id") == least, F.col("low.n")).otherwise(0)
    split = copies.withColumn("first", first).select(
        "part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("first").alias("n")),
                                                   F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("first")).alias("n")))).alias("c"))
    return (split.where("c.n > 0").groupBy("part", F.col("c.mask").cast("int").alias("mask"), "good", "toxic")
            .agg(F.sum("c.n").cast("long").alias("n")))


def removal_steps(fails: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The step at which each class goes in each order: the min-plus product of
    ``fails`` (classes x filters; failing costs 0, passing is out of reach)
    with ``places`` (orders x filters, the place of a filter in an order).
    The number of filters stands for kept."""
    cost = np.where(fails, 0, places.shape[1])
    return np.minimum((cost[:, None, :] + places[None, :, :]).min(axis=2), places.shape[1])


def _audit(filters: str, weights: tuple[str, ...]):
    k = len(filters)
    orders = np.array(list(permutations(range(k))), np.int64).reshape(-1, k)
    places = np.argsort(orders, axis=1)  # the inverse permutations
    row = np.arange(len(orders))

    def scatter(steps, weight):
        out = np.zeros((len(orders), k + 1), np.int64)
        np.add.at(out, (row[None, :], steps), weight[:, None])
        return out

    def run(key, table: pa.Table) -> pa.Table:
        column = {name: table.column(name).to_numpy().astype(np.int64) for name in ("mask", "n", *weights)}
        fails = (column["mask"][:, None] >> np.arange(k)) & 1 == 1
        n = column["n"]
        steps = removal_steps(fails, places)
        removed = scatter(steps, n)[:, :k]
        failing, only = n @ fails, n @ (fails & (fails.sum(axis=1) == 1)[:, None])
        shapley = removed[row[:, None], places].sum(axis=0)
        out = {"kept": n.sum() - removed.cumsum(axis=1), "removed": removed, "redundant": failing[orders] - removed, "unique_fails": only[orders]}
        out |= {f"{w}_lost": scatter(steps, n * column[w])[:, :k] for w in weights} | {"shapley": shapley[orders]}
        size = orders.size
        names = np.array(list(filters))
        head = [pa.array([key[0].as_py()] * size, pa.string()), pa.array(np.repeat(["".join(names[o]) for o in orders], k)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders))), pa.array(names[orders].ravel())]
        return pa.table(head + [pa.array(v.ravel(), pa.int64()) for v in out.values()], names=["part", "filter_order", "step", "filter", *out])

    return run


def audit_filters(classes: DataFrame, filters: str = FILTERS, weights: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """Effect of each filter at each step of each order of ``filters``.

    ``classes(part, mask, n, *weights)`` counts documents by the bits of the
    filters they fail; ``weights`` are 0 or 1.  A part has at most 2^(filters
    + weights) classes, so its matrices are small whatever the corpus holds.
    Returns per part, order and step: the letter of the filter, kept (after the
    step), removed (by it), redundant (fail it but went before), unique_fails
    (fail it alone), ``<weight>_lost`` (removed, of that weight) and shapley
    (what the filter removes, summed over all orders).  An empty table has no
    parts, so no rows."""
    names = [*COUNTS, *[f"{w}_lost" for w in weights], "shapley"]
    schema = "part string, filter_order string, step int, filter string, " + ", ".join(f"{c} long" for c in names)
    run = _audit(filters, tuple(weights))
    return classes.select("part", "mask", "n", *weights).groupBy("part").applyInArrow(lambda k, t: run(k, t), schema)


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters over ``docs(doc_id, text, lang)``.

    Each row is a document, also where ids or whole rows repeat; rows of one id
    are no copies of each other, a row without an id comes after all others and
    has no labels.  A document is good (toxic) if any label of its id says so.
    Null texts are empty and equal; other columns are ignored."""
    return audit_filters(failure_classes(docs, labels))
