"""Large JSON documents read in splits.

A file that holds one array of objects, or one object whose values are objects,
is one value to a JSON reader and so one task.  Here it is read as text records
that end at ``}``, which Spark splits like lines.  No escape ends in ``}``, so
a record is never cut inside one, and two running sums tell for each record
what the text before it left open:

1. the parity of quotes: whether it starts inside a string;
2. with strings taken out, the brackets: how deep it starts.

An element ends where the depth is back at one; a third running sum numbers the
elements, and the records of each are put together.  Sums are two-level: inside
a split, plus the totals of the splits before it (one row a split), so a file
of any size is scanned by as many tasks as it has splits.  One element has to
fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.layout import stored

_ESCAPE = r"\\."
_STRING = r'"[^"]*+(?:"|$)'  # once escapes are gone


def _before(df: DataFrame, value: Column, out: str) -> DataFrame:
    """``out``: sum of ``value`` over all earlier records of the file."""
    rows = df.withColumn("_v", value.cast("long"))
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("file", "split").agg(F.sum("_v").alias("_v")).select(
        "file", "split", F.coalesce(F.sum("_v").over(splits), F.lit(0)).alias("_offset"))
    return (rows.withColumn(out, F.coalesce(F.sum("_v").over(inside), F.lit(0))).join(offsets, ["file", "split"])
            .withColumn(out, F.col(out) + F.col("_offset")).drop("_v", "_offset"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """``(file, element, json)``: the top-level elements of every file at
    ``path``, numbered from 0 in the order of the file.  Of an array of objects
    each is an object, of an object a ``"key": {...}`` pair.  Elements that are
    not objects (or pairs with one) are an error; a file that ends inside an
    element too."""
    raw = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")
    rows = stored(raw, "json-records")  # places must not change between the passes
    bare = F.regexp_replace("value", _ESCAPE, "")
    quotes = F.length(F.regexp_replace(bare, r'[^"]', ""))
    rows = _before(rows, quotes, "quotes")
    held = F.col("quotes") % 2 == 1
    plain = F.regexp_replace(F.when(held, F.concat(F.lit('"'), bare)).otherwise(bare), _STRING, "")
    ends_held = (F.col("quotes") + quotes) % 2 == 1
    rows = rows.withColumn("_plain", plain).withColumn("closes", ~ends_held)
    opened = F.length(F.regexp_replace("_plain", r"[^\[{]", ""))
    closed = F.length(F.regexp_replace("_plain", r"[^\]}]", "")) + F.when(F.col("closes"), 1).otherwise(0)
    rows = rows.withColumn("_step", opened - closed).drop("_plain", "quotes")
    rows = _before(rows, F.col("_step"), "depth")
    last = F.col("closes") & (F.col("depth") + F.col("_step") == 1)
    # the last record counts as ended too, so a whole file comes out at no depth or below
    depth = rows.groupBy("file").agg((F.sum("_step") > 0).alias("open"))
    rows = _before(rows.withColumn("last", last), F.col("last"), "element").join(depth, "file")
    # a record without an end of its own: the rest of the file after the last element
    joined = rows.groupBy("file", "open", "element").agg(F.max("last").alias("whole"), F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_r"))
    text = F.concat(F.array_join(F.transform("_r", lambda r: r["value"]), "}"), F.lit("}"))
    first = F.when(F.col("element") == 0, F.regexp_replace(text, r"^\s*[\[{]", "")).otherwise(F.regexp_replace(text, r"^\s*,", ""))
    element = F.regexp_replace(first, r"^\s+", "")
    rest = F.regexp_replace(text, r"[\s\]}]+", "")
    wrong = F.raise_error(F.concat(F.lit("not an array of objects or an object of objects near: "), F.substring(text, 1, 80)))
    fine = F.when(F.col("whole") & ~F.col("open") & element.rlike(r'^(?:\{|"(?:[^"\\]|\\.)*+"\s*:\s*\{)'), element)
    # an empty document is one record without an element
    return (joined.withColumn("json", F.coalesce(fine, F.when(~F.col("open") & rest.isin("", "[", "{"), F.lit("")), wrong)).where("json <> ''")
            .select("file", "element", "json"))
