"""Sharding by balanced label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hex_bucket, ranked, stored


#: propagation goes on until a round moves less than this share of the linked rows
SETTLED = 0.01
#: and ends after so many times its least number of rounds in any case
LONGEST = 4


def _at(values: list, index) -> F.Column:
    """values[index] for a driver-side list of one value per shard."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _per_shard(df: DataFrame, col: str, n_shards: int) -> list[int]:
    """Row counts per shard, n_shards numbers at most."""
    found = dict(df.groupBy(col).count().collect())
    return [int(found.get(s, 0)) for s in range(n_shards)]


def _admission(flow: list[list[int]], load: list[int], quota: int, steps: int = 60) -> list[float]:
    """Share of its callers that each shard admits so that none goes over its
    quota, counting the room that those leave who are admitted elsewhere."""
    n = len(load)
    callers = [sum(flow[s][t] for s in range(n)) for t in range(n)]
    admit = [1.0] * n
    for _ in range(steps):
        room = [quota - load[s] + sum(flow[s][t] * admit[t] for t in range(n)) for s in range(n)]
        admit = [min(1.0, max(0.0, room[t] / callers[t])) if callers[t] else 0.0 for t in range(n)]
    return admit


def propagate(members: DataFrame, n_shards: int, rows: int, rounds: int) -> DataFrame:
    """Label propagation over ``members(rid, link, shard)``.

    Documents with the same link are neighbours through the link's hub.  Each
    round, a hub ranks shards by how many of its members they hold, passing
    over full shards unless they hold half of the hub already, and calls its
    members to the first of them (to the first few, if the hub is larger than
    a shard).  A shard admits callers only up to its quota, less who stays;
    who is admitted is drawn by a keyed hash, so no task orders a whole shard.
    Tallies are combined before the shuffle and a hub is at most n_shards
    rows.  After ``rounds`` rounds it ends with the first that moves less than
    `SETTLED` of the members.
    """
    quota = max(1, rows // n_shards)
    for turn in range(rounds * LONGEST):
        load = _per_shard(members, "shard", n_shards)
        full = [x >= quota for x in load]
        tally = members.groupBy("link", "shard").agg(F.count(F.lit(1)).alias("n"))
        hubs = tally.groupBy("link").agg(F.sum("n").alias("size"), F.collect_list(F.struct("shard", "n")).alias("held"))
        span = F.greatest(F.lit(1), F.ceil(F.col("size") * n_shards * 1.15 / F.lit(rows))).cast("int")
        passed = F.transform("held", lambda x: F.struct(
            (_at(full, x["shard"]) & (x["n"] * 2 * F.col("span") < F.col("size"))).alias("skip"),
            (-x["n"]).alias("less"), F.xxhash64("link", x["shard"]).alias("tie"), x["shard"].alias("shard")))
        hubs = (hubs.withColumn("span", span).withColumn("order", F.sort_array(passed))
                .select("link", F.slice(F.col("order.shard"), 1, F.col("span")).alias("targets")))
        pick = F.element_at("targets", (F.pmod(F.xxhash64("rid", F.lit(turn)), F.size("targets")) + 1).cast("int"))
        asked = stored(members.join(hubs, "link").select(
            "rid", "link", "shard", F.when(F.array_contains("targets", F.col("shard")), F.col("shard")).otherwise(pick).alias("want")), "asked")
        flow = [[0] * n_shards for _ in range(n_shards)]
        for r in asked.where("want <> shard").groupBy("shard", "want").count().collect():  # n_shards squared at most
            flow[r["shard"]][r["want"]] = r["count"]
        if not any(map(any, flow)):
            return asked.select("rid", "link", "shard")
        admit = _admission(flow, load, quota)
        draw = F.pmod(F.xxhash64("rid", F.lit(turn + 1000)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        moved = sum(flow[s][t] * admit[t] for s in range(n_shards) for t in range(n_shards))
        members = asked.select("rid", "link", F.when(draw < _at(admit, F.col("want")), F.col("want")).otherwise(F.col("shard")).alias("shard"))
        if turn + 1 >= rounds and moved < SETTLED * sum(load):
            break
    return stored(members, "settled")


def shard_documents(docs: DataFrame, n_shards: int = 40, rounds: int = 6, seed: int = 29) -> DataFrame:
    """Put ``docs(doc_id, text)`` into shards 0 to n_shards - 1 under the law
    ``rows``: counts per shard differ by at most one.

    Documents of equal text are linked.  All rows start on a keyed random
    order dealt round robin; `propagate` moves linked rows towards their
    neighbours' shards; then shards over their quota hand rows to those below
    it, unlinked rows (which cut no edge) first.

    Returns one row per input row: doc_id, size (UTF-8 bytes of the text plus
    16), text_crc32, law, shard, slot (gapless from 0 inside the shard) and
    grown_shard (null: the law ``rows`` has none).  A null text has size 16, a
    null crc and no links; empty texts are equal texts; null and repeated ids
    are ordinary rows; an empty table gives an empty result.  Other columns
    are ignored.
    """
    text = F.col("text")
    base = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.sha2(text, 256).alias("link"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), "link"))
    base = stored(base.withColumn("key", key), "nodes")
    rows = base.count()
    dealt = base.withColumn("bucket", hex_bucket(F.col("key"), rows, 4096))
    nodes = stored(ranked(dealt, [], "bucket", ["key", "doc_id"], "rid")
                   .withColumn("shard", F.pmod("rid", F.lit(n_shards)).cast("int"))
                   .select("rid", "doc_id", "size", "text_crc32", "link", "shard"), "dealt")
    # a link is named by its first row: a number is a quarter of its hash
    groups = (nodes.where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("hub"))
              .where("n > 1").select("link", "hub"))
    linked = stored(nodes.join(groups, "link").select("rid", F.col("hub").alias("link"), "shard"), "linked")
    settled = propagate(linked, n_shards, rows, rounds).select("rid", F.col("shard").alias("moved"))

    placed = stored(nodes.join(settled, "rid", "left").select(
        "rid", "doc_id", "size", "text_crc32", F.coalesce("moved", "shard").alias("shard"),
        F.col("moved").isNotNull().cast("long").alias("tied"),
        F.expr(f"rid div {4096 * n_shards}").alias("range")), "placed")
    load = _per_shard(placed, "shard", n_shards)
    want = [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]
    over = [max(0, x - w) for x, w in zip(load, want)]
    room = [max(0, w - x) for x, w in zip(load, want)]
    before = [sum(over[:s]) for s in range(n_shards)]
    upto = [sum(room[:s + 1]) for s in range(n_shards)]
    # ties go last: order by (tied, range) as one bucket number
    stretch = placed.withColumn("bucket", F.col("tied") * F.lit(1 << 40) + F.col("range"))
    listed = ranked(stretch, ["shard"], "bucket", ["rid"], "at")
    hand = F.size(F.filter(F.array(*[F.lit(x) for x in upto]), lambda c: c <= F.col("at") + _at(before, F.col("shard"))))
    even = stored(listed.withColumn("shard", F.when(F.col("at") < _at(over, F.col("shard")), hand).otherwise(F.col("shard")).cast("int"))
                  .select("rid", "doc_id", "size", "text_crc32", "shard", "range"), "even")
    return ranked(even, ["shard"], "range", ["rid"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
