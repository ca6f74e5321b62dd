"""N-gram Jaccard join by a token-group matrix."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import MESSAGE, NO_ID, Distinct, Words, chunk_count, key_of, seen_elsewhere, seen_often
from .common import components, packed, rolled, stored

#: the screen looks at one of so many tokens first
SAMPLE = 4
#: posting lists up to this length give pairs, the classes of longer ones go to blocks of this size
FEW, BLOCK = 16, 256


def shingle_sets(words: Words, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words
    has one, of the whole sequence, a text of none has none."""
    flat = rolled(words.hashes, width)
    out, start = [], 0
    for t in words.texts:
        n = len(t)
        if n >= width:
            out.append(np.unique(flat[start:start + n - width + 1]))
        else:
            out.append(rolled(words.hashes[start:start + n], n) if n else np.empty(0, np.uint64))
        start += n
    return out


def _sign(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _describe(width: int, extra: list[str]):
    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
                sets = shingle_sets(Words.split(raw, np.zeros(len(raw)), np.arange(len(raw)), True), width)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_sign(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([int(s[:1].view(np.int64)[0]) if len(s) else None for s in sets], pa.int64()),
                    *[batch.column(c) for c in extra]],
                    ["doc_id", "n", "sig", "gid", *extra])
    return run


class _Matrix:
    """The passes over a chunk, a set of groups: the chunk's column of the
    token-group matrix is the union of its members' tokens."""

    def __init__(self, width: int, num: int, den: int, buckets: int):
        self.width, self.num, self.den, self.buckets = width, num, den, buckets

    def need(self, n):
        """Least overlap of a set of n tokens with any set that it links to."""
        return -(-self.num * n // self.den)

    def members(self, table) -> tuple[np.ndarray, list[np.ndarray]]:
        """Classes of the chunk, once each (rows of another text under a repeated id fall out)."""
        words = Words.of(table, lower=True)
        sets = shingle_sets(words, self.width)
        sig = [table.column("sig")[int(i)].as_py() for i in words.order]
        ok = [i for i, s in enumerate(sets) if len(s) and _sign(s) == sig[i] and (i == 0 or words.keys[i] != words.keys[i - 1] or sig[i - 1] != _sign(sets[i - 1]))]
        return words.keys[ok], [sets[i] for i in ok]

    def union(self, sets: list[np.ndarray]) -> tuple[np.ndarray, Distinct]:
        sizes = [len(s) for s in sets]
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        return np.repeat(np.arange(len(sets)), sizes), Distinct.among(flat, self.buckets)

    def open(self, owner: np.ndarray, found: Distinct, sizes: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Which members can still reach the threshold with any other class:
        tokens that no other class holds are lost."""
        lost = np.bincount(owner[~held[found.of]], minlength=len(sizes))
        return lost <= sizes - self.need(sizes)

    def sampled(self, sets):
        return [s[s % np.uint64(SAMPLE) == 0] for s in sets]

    def send_sample(self, key, table):
        _, sets = self.members(table)
        return self.union(self.sampled(sets))[1].messages(key[0].as_py(), short=True)

    def screen(self, key, table, replies):
        cids, sets = self.members(table)
        owner, found = self.union(self.sampled(sets))
        held = found.answered(replies) | (owner[found.first] != owner[found.last])
        keep = self.open(owner, found, np.array([len(s) for s in sets], np.int64), held)
        kept = np.flatnonzero(keep)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(kept), pa.int64()), "cid": pa.array(cids[kept], pa.int64()),
                         "tokens": pa.array([sets[i].tobytes() for i in kept], pa.binary())})

    def send_all(self, key, table):
        sets = [np.frombuffer(b, np.uint64) for b in table.column("tokens").to_pylist()]
        found = self.union(sets)[1]
        return found.messages(key[0].as_py(), np.bincount(found.of, minlength=len(found.values)), np.uint32, short=True)

    def qualify(self, key, table, replies):
        """Whole sets against all groups; for those that stay, the prefix: the
        first tokens in one order for all sets (rarest first, then by hash), one
        of which is shared by any two linked sets."""
        cids, blobs = table.column("cid").to_numpy(), table.column("tokens").to_pylist()
        sets = [np.frombuffer(b, np.uint64) for b in blobs]
        sizes = np.array([len(s) for s in sets], np.int64)
        owner, found = self.union(sets)
        grade = found.answered(replies, graded=True)
        kept = np.flatnonzero(self.open(owner, found, sizes, grade > 0))
        mine, starts = grade[found.of], np.cumsum(sizes) - sizes
        prefix = []
        for i in kept:
            n = int(sizes[i])
            rare = np.lexsort((sets[i], mine[starts[i]:starts[i] + n]))[:n - self.need(n) + 1]
            prefix.append(sets[i][rare].view(np.int64))
        return pa.table({"cid": pa.array(cids[kept], pa.int64()), "n": pa.array(sizes[kept], pa.int64()),
                         "prefix": pa.array(prefix, pa.list_(pa.int64())), "tokens": pa.array([sets[i].view(np.int64) for i in kept], pa.list_(pa.int64()))})

    def block(self, table):
        """Links between two blocks of classes (or within one), as a spanning
        forest: as many edges as members at most.  A member is opened
        against the other block only if the block's token union holds enough
        of its tokens, and pairs that are connected already are passed over."""
        cid, side = table.column("cid").to_numpy(), table.column("side").to_numpy()
        column = table.column("tokens").combine_chunks()
        every, ends = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy() - column.offsets[0].as_py()
        sets = [every[a:b] for a, b in zip(ends[:-1], ends[1:])]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        union = np.unique(np.concatenate([sets[j] for j in right])) if len(right) else np.empty(0, np.uint64)
        root = list(range(len(sets)))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        flat = np.concatenate([sets[j] for j in right]) if len(right) else union
        whose = np.repeat(np.arange(len(right)), [len(sets[j]) for j in right])
        sizes = np.array([len(sets[j]) for j in right], np.int64)
        order = np.argsort(flat, kind="stable")
        flat, whose = flat[order], whose[order]
        edges = []
        for i in left:
            n = len(sets[i])
            if np.isin(sets[i], union, assume_unique=True).sum() < self.need(n):
                continue
            lo, hi = np.searchsorted(flat, sets[i]), np.searchsorted(flat, sets[i], side="right")
            spans = [whose[x:y] for x, y in zip(lo, hi) if y > x]
            both = np.bincount(np.concatenate(spans), minlength=len(right)) if spans else np.zeros(len(right), np.int64)
            for j in np.flatnonzero(self.den * both >= self.num * (n + sizes - both)):
                x, y = top(int(i)), top(int(right[j]))
                if x != y:
                    root[x] = y
                    edges.append((int(cid[i]), int(cid[right[j]])))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def similar_documents(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, row: str | None = None) -> DataFrame:
    """Link documents of ``docs(doc_id, text)`` whose sets of ``width``-word
    shingles have Jaccard similarity num / den or more, and name components.

    Equal sets are one class.  Classes with the same least shingle hash form a
    group (large groups are split); a chunk holds some groups and its union of
    tokens is a column of the token-group matrix.  A class is opened only if
    enough of its tokens occur in the union of any group, bounded first on a
    quarter of the tokens and then, among those that stay, on all.  Half a hash
    is sent for that: two tokens taken for one open a class too many.  Opened
    classes meet on the tokens of their prefixes: in pairs where few share a
    token, in blocks with unions of their own where many do; every pair is
    decided by its exact intersection.  Connected pairs in a block give a
    spanning forest, so a large group of near copies gives no pair per pair.

    Returns one row per input row: doc_id, n_shingles and component_id (the
    smallest doc_id reachable by links, itself included).  A-Z are lowered;
    words are runs of other than ASCII white space.  Texts without words
    (null, empty) have 0 shingles and link with nothing.  A null id orders
    after all others; rows with a repeated id are documents of their own;
    repeated rows are equal sets; an empty table gives an empty result.  Extra
    columns are ignored, but with ``row``, the name of a long column, that one
    and ``component`` (a number of its own for each component, null without
    words) come after the others.
    """
    extra = [row] if row else []
    passed = [*extra, "_h"]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *extra).withColumn("_h", F.xxhash64("text"))
    told = stored(docs.mapInArrow(_describe(width, passed), "doc_id long, n long, sig binary, gid long" + "".join(f", `{c}` long" for c in passed)), "shingles")
    # the text of a class is found by its id and hash: an id, or none, may have many texts
    classes = (told.where("n > 0").groupBy("sig", "gid", "n").agg(F.min(F.struct(key_of().alias("rep"), "_h")).alias("first"))
               .select("sig", "gid", "n", "first.rep", "first._h"))
    # small tables that meet a hot key are stored: Spark splits a join whose sides it has dealt itself
    sizes = stored(classes.groupBy("gid").agg(F.count(F.lit(1)).alias("members")), "groups")
    chunks = chunk_count(docs, 4 << 20)
    part = F.pmod(F.xxhash64("sig"), F.ceil(F.col("members") / F.lit(512)))
    classes = stored(classes.join(sizes, "gid").select(
        F.monotonically_increasing_id().alias("cid"), "sig", "rep", "_h", "n",
        F.pmod(F.xxhash64("gid", part), F.lit(chunks)).alias("chunk")), "classes")
    texts = docs.select(key_of().alias("rep"), "_h", packed("text").alias("z")).dropDuplicates(["rep", "_h"])
    table = texts.join(classes, ["rep", "_h"]).select("chunk", F.col("cid").alias("key"), "sig", "z")

    # asking and reading the answers is one plan: the exchange by chunk serves both passes
    run = _Matrix(width, num, den, max(1, chunks // 4))
    sample = seen_elsewhere(table.groupBy("chunk").applyInArrow(lambda k, t: run.send_sample(k, t), MESSAGE), short=True)
    opened = stored(table.groupBy("chunk").cogroup(sample.groupBy("chunk"))
                    .applyInArrow(lambda k, t, r: run.screen(k, t, r), "chunk long, cid long, tokens binary"), "opened")
    every = seen_often(opened.groupBy("chunk").applyInArrow(lambda k, t: run.send_all(k, t), MESSAGE))
    sets = stored(opened.groupBy("chunk").cogroup(every.groupBy("chunk"))
                  .applyInArrow(lambda k, t, r: run.qualify(k, t, r), "cid long, n long, prefix array<long>, tokens array<long>"), "qualified")

    posts = sets.select("cid", "n", F.explode("prefix").alias("token"))
    lists = posts.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    posts = stored(posts.join(lists, "token"), "posts")
    few = posts.where(F.col("c") <= FEW)
    a, b = (few.select("token", F.col("cid").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    pairs = (a.join(b, "token").where((F.col("a") < F.col("b")) & (F.least("na", "nb") * den >= F.greatest("na", "nb") * num))
             .select("a", "b").distinct())
    body = sets.select("cid", "tokens")
    both = F.size(F.array_intersect("ta", "tb"))
    checked = (pairs.join(body.toDF("a", "ta"), "a").join(body.toDF("b", "tb"), "b")
               .where(both * den >= (F.size("ta") + F.size("tb") - both) * num).select("a", "b"))

    # many: groups of like size and first long list, in blocks; blocks that hold
    # a token in common, by the matrix of these blocks, are opened to each other
    many = posts.where(F.col("c") > FEW)
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num))).alias("band")
    home = many.groupBy("cid", "n").agg(F.min("token").alias("first")).select("cid", "n", "first", band)
    sizes = home.groupBy("first", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).alias("blocks"))
    home = stored(home.join(sizes, ["first", "band"]).select("cid", "n", F.xxhash64(
        "first", "band", F.pmod(F.xxhash64("cid"), F.col("blocks"))).alias("block")), "blocks")
    matrix = stored(many.select("token", "cid").join(home, "cid").groupBy("token", "block").agg(
        F.min("n").alias("least"), F.max("n").alias("most")), "matrix")
    i, j = (matrix.select("token", F.col("block").alias(x), F.col("least").alias(f"l{x}"), F.col("most").alias(f"m{x}")) for x in "ij")
    near = (i.join(j, "token").where((F.col("i") <= F.col("j")) & (F.col("li") * num <= F.col("mj") * den) & (F.col("lj") * num <= F.col("mi") * den))
            .select("i", "j").distinct())
    member = home.select("cid", "block").join(body, "cid")
    side = F.when(F.col("i") == F.col("j"), 2)
    spread = (member.join(near, F.col("block") == F.col("i")).withColumn("side", side.otherwise(0))
              .unionByName(member.join(near.where("i < j"), F.col("block") == F.col("j")).withColumn("side", F.lit(1))))
    forest = spread.select("i", "j", "cid", "side", "tokens").groupBy("i", "j").applyInArrow(lambda t: run.block(t), "a long, b long")

    roots = components(checked.unionByName(forest)).withColumnsRenamed({"node": "cid"})
    named = classes.join(roots, "cid", "left").select("sig", "rep", F.coalesce("root", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    named = stored(named.join(least, "root").select("sig", "root", F.when(F.col("least") < NO_ID, F.col("least")).alias("least")), "named")
    return told.join(named, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        *extra, *[F.col("root").alias("component") for _ in extra])
