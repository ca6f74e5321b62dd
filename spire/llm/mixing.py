"""Mixing sources to target weights with a low-discrepancy schedule."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hex_bucket, ranked, stored, word_count

#: fractional part of the golden ratio: slot i of the schedule sits at frac(i * GOLDEN)
GOLDEN = 0.6180339887498949
#: slots of a mix, each drawing one block of words
SLOTS = 1 << 16


def source_targets(sizes: DataFrame, weights=(5, 2, 1), budget: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """Target tokens per source.

    ``sizes(source, source_size)`` has one row per source (null is a source,
    ordered last).  Weights repeat over the sources in code-point order and
    share ``budget`` times all tokens; a target stops at ``max_repeat`` times
    its source, and the excess is shared again by weight.  Solved in closed
    form: source s is capped when filling all sources to s's own cap-to-weight
    ratio would not spend the budget.  The windows run over the source table.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = (sizes.withColumn("sid", F.row_number().over(order))
         .withColumn("w", F.element_at(w, ((F.col("sid") - 1) % len(weights) + 1).cast("int")))
         .withColumn("cap", F.col("source_size") * max_repeat))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy()
    s = (s.withColumn("want", F.sum("source_size").over(everything) * F.lit(float(budget)))
         .withColumn("rest", F.sum("w").over(everything) - F.sum("w").over(fill))
         .withColumn("filled", F.sum("cap").over(fill) + F.col("cap") * F.col("rest") / F.col("w"))
         .withColumn("capped", F.col("filled") <= F.col("want")))
    s = (s.withColumn("given", F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)))
         .withColumn("free_w", F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything))
         .withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double"))
                     .otherwise(F.col("w") * (F.col("want") - F.col("given")) / F.col("free_w"))))
    return s.select("sid", "source", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("words"))


def schedule(sources: DataFrame, n_slots: int, golden: float = GOLDEN, cells: int = 1024) -> DataFrame:
    """The slots of the mix: (sid, rank, slot).

    Slot i is the golden-ratio point frac(i * golden), mapped through the
    cumulative target shares to a source; ``rank`` numbers the slots of a
    source.  Points meet the share intervals on a grid of ``cells``, an
    equi-join that holds for any number of sources, and ranks are two-level,
    so the largest source does not sit in one task.  A source with a target
    but no point gets one slot at the end.
    """
    spark = sources.sparkSession
    run = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("target").over(Window.partitionBy())
    hi = F.sum("target").over(run)
    s = sources.where("target > 0").withColumn("hi", hi / total).withColumn("lo", (hi - F.col("target")) / total)
    last = F.col("sid") == F.max("sid").over(Window.partitionBy())
    s = s.withColumn("hi", F.when(last, F.lit(2.0)).otherwise(F.col("hi")))
    grid = s.select("sid", "lo", "hi", F.explode(F.sequence(
        F.floor(F.col("lo") * cells), F.least(F.lit(cells - 1), F.floor(F.col("hi") * cells)))).alias("cell"))
    x = F.col("id") * F.lit(golden)
    points = spark.range(n_slots).withColumn("u", x - F.floor(x)).withColumn("cell", F.floor(F.col("u") * cells))
    hits = (points.join(grid, "cell").where("u >= lo and u < hi")
            .select("sid", F.col("id").alias("slot"), F.shiftright("id", 14).alias("chunk")))
    hits = stored(hits, "slots")
    extra = (s.join(hits.select("sid").distinct(), "sid", "left_anti")
             .select("sid", F.lit(0).cast("long").alias("rank"), (F.col("sid") + n_slots).cast("long").alias("slot")))
    return (ranked(hits, ["sid"], "chunk", ["slot"], "rank").select("sid", "rank", "slot").unionByName(extra))


def mix_sources(docs: DataFrame, weights=(5, 2, 1), budget: float = 1.5, max_repeat: int = 2,
                n_slots: int = SLOTS, seed: int = 17, row: str | None = None, golden: float = GOLDEN) -> DataFrame:
    """Mix ``docs(doc_id, text, source)`` to the target weights.

    The mix is a row of about ``n_slots`` slots, each a block of the same number of
    words: ``budget`` times all words, divided by the slots.  The schedule gives
    each slot to a source.  The documents of a source are laid out in a keyed
    shuffled order on a word axis of ``max_repeat`` passes, cut into blocks; the
    r-th slot of a source draws its r-th block.  So the points decide what is
    taken: a source's words are its slots times the block, within the
    discrepancy of the points (about 3 of ``n_slots``) from its target, and no
    document exceeds ``max_repeat`` times its size, as the axis ends there.  A
    source too small for a point gets one slot of as many words as its target.

    Returns one row per input row: doc_id, source, size, source_size, target,
    taken (words, repeats counted) and first_slot (the slot whose block the
    document begins in; null if it is never drawn).  Null and empty texts have
    size 0 and are never taken; null ids and sources are ordinary values (the
    null source is ordered last); repeated rows are separate documents; an
    empty table gives an empty result.  Other columns are ignored, but with
    ``row``, the name of a column that tells rows apart, that one comes after
    the others.  The order depends on seed, doc_id, size and text (and then
    ``row``) only, so reruns agree, and rows without an id spread.
    """
    extra = [row] if row else []
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    base = stored(docs.select(*extra, "doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key")), "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    stats = stored(sizes, "sources")
    total, rows = stats.agg(F.sum("source_size"), F.sum("rows")).first()
    block = max(1, math.ceil((total or 0) * budget / n_slots))
    n_slots = math.ceil((total or 0) * budget / block)  # whole words a block, so there may be fewer slots
    sources = stored(source_targets(stats.drop("rows"), weights, budget, max_repeat), "targets")
    slots = stored(schedule(sources, n_slots, golden), "schedule")
    drawn = slots.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.max("slot").alias("last"))
    small = F.coalesce(F.col("last") >= n_slots, F.lit(False))
    words = F.when(small, F.col("words")).otherwise(F.coalesce("n", F.lit(0)) * block)
    sources = (sources.join(drawn, "sid", "left").withColumn("step", F.when(small, F.greatest("words", F.lit(1))).otherwise(block).cast("long"))
               .withColumn("words", F.least(words, F.col("source_size") * max_repeat)).drop("n", "last"))

    laid = (base.join(sources, base["source"].eqNullSafe(sources["source"])).drop(sources["source"])
            .withColumn("bucket", hex_bucket(F.col("key"), rows or 0, 8192)))
    laid = stored(laid, "laid")
    filled, none = laid.where("size > 0"), laid.where("size = 0")
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (filled.groupBy("sid", "bucket").agg(F.sum("size").alias("s"))
               .select("sid", "bucket", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before")))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", *extra).rowsBetween(Window.unboundedPreceding, 0)
    placed = (filled.withColumn("upto", F.sum("size").over(inside)).join(offsets, ["sid", "bucket"])
              .withColumn("lo", F.col("before") + F.col("upto") - F.col("size")))
    start = F.col("lo") + F.col("pass") * F.col("source_size")
    used = (placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
            .withColumn("start", start).withColumn("end", F.least(F.col("start") + F.col("size"), F.col("words")))
            .withColumn("rank", F.explode_outer(F.when(F.col("start") < F.col("end"), F.sequence(
                F.expr("start div step"), F.expr("(end - 1) div step"))))))
    share = F.least("end", (F.col("rank") + 1) * F.col("step")) - F.greatest("start", F.col("rank") * F.col("step"))
    taken = (used.join(slots, ["sid", "rank"], "left")
             .groupBy("sid", "lo", "doc_id", "source", "size", "source_size", "target", *extra)
             .agg(F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), share)), F.lit(0)).cast("long").alias("taken"),
                  F.min("slot").alias("first_slot")))
    cols = ["doc_id", "source", "size", "source_size", "target", "taken", "first_slot", *extra]
    return taken.select(*cols).unionByName(none.select(
        "doc_id", "source", "size", "source_size", "target",
        F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("first_slot"), *extra))
