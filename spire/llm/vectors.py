"""Embedding near-dedup by spherical k-means cells."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

#: slack for rounding in the cell test; pairs themselves are decided without it
EPS = 1e-9


def _unit(embedding) -> tuple[np.ndarray, np.ndarray] | None:
    """(vector as stored, unit vector in double); None if it links with nothing."""
    if embedding is None or any(x is None for x in embedding):
        return None
    v = np.asarray(embedding, np.float64)
    norm = np.sqrt(v @ v) if len(v) else 0.0
    if not len(v) or not np.isfinite(v).all() or not np.isfinite(norm) or norm == 0.0:
        # a norm may overflow or vanish although all components are sound
        top = np.abs(v).max() if len(v) and np.isfinite(v).all() else 0.0
        if top == 0.0:
            return None
        u = v / top
        return v, u / np.sqrt(u @ u)
    return v, v / norm


def _read(batches):
    """Unit vectors of the sound rows, with a digest of the vector as given."""
    for batch in batches:
        ids, labels = batch.column("vec_id").to_pylist(), batch.column("label").to_pylist()
        rows = []
        for i, label, e in zip(ids, labels, batch.column("embedding").to_pylist()):
            got = _unit(e)
            if got is not None and label is not None:
                v, u = got
                rows.append((i, label, len(u), hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest(), u.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
            (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary()))], ["vec_id", "label", "dim", "digest", "u"])


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k unit centroids of a bounded sample of unit vectors."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        home = (sample @ c.T).argmax(1)
        for j in range(len(c)):
            mine = sample[home == j]
            if len(mine):
                m = mine.sum(0)
                n = np.sqrt(m @ m)
                c[j] = m / n if n else c[j]
    return c


def _assign(centroids: np.ndarray, least: float):
    """Home cell of each vector, and the earlier cells in which a partner may live.

    A vector x at home in cell a has x.(c_a - c_b) >= 0 for every b.  If y, at
    home in b, is within the angle t of x, then y.(c_a - c_b) is at least
    -|c_a - c_b| sin t; where it is less, no partner of y lives in a.  Of two
    cells the later sends its vectors to the earlier."""
    sine = math.sqrt(max(0.0, 1 - least * least)) if least > 0 else 1.0
    gap = np.sqrt(((centroids[:, None] - centroids[None]) ** 2).sum(2)) if len(centroids) else np.zeros((0, 0))

    def run(batches):
        for batch in batches:
            out = []
            for cid, u in zip(batch.column("cid").to_pylist(), batch.column("u").to_pylist()):
                v = np.frombuffer(u, np.float64)
                if not len(centroids) or len(v) != centroids.shape[1]:
                    out.append((cid, 0, True))
                    continue
                dots = centroids @ v
                b = int(dots.argmax())
                out.append((cid, b, True))
                if least <= 0:
                    out.extend((cid, a, False) for a in range(b))
                else:
                    out.extend((cid, a, False) for a in range(b) if dots[a] - dots[b] >= -gap[a, b] * sine - EPS)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(
                (pa.int64(), pa.int32(), pa.bool_()))], ["cid", "cell", "home"])
    return run


def _compare(least: float):
    """Links of two blocks of a cell: how many vectors each vector links to,
    and a spanning forest of the links."""
    def run(table):
        cid, copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        home, side = table.column("home").to_numpy(zero_copy_only=False), table.column("side").to_numpy()
        u = np.vstack([np.frombuffer(b, np.float64) for b in table.column("u").to_pylist()])
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        count = np.zeros(len(cid), np.int64)
        root = np.arange(len(cid))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        edges = []
        for start in range(0, len(left), 512):
            rows = left[start:start + 512]
            near = u[rows] @ u[right].T >= least
            near &= home[rows][:, None] | home[right][None]      # two visitors meet elsewhere
            if side[0] == 2:
                near &= rows[:, None] < right[None]              # one block against itself: each pair once
            for a, b in zip(*np.nonzero(near)):
                i, j = int(rows[a]), int(right[b])
                count[i] += copies[j]
                count[j] += copies[i]
                x, y = top(i), top(j)
                if x != y:
                    root[x] = y
                    edges.append((int(cid[i]), int(cid[j])))
        hit = np.flatnonzero(count)
        return pa.table({"a": pa.array([*cid[hit].tolist(), *(e[0] for e in edges)], pa.int64()),
                         "b": pa.array([None] * len(hit) + [e[1] for e in edges], pa.int64()),
                         "n": pa.array([*count[hit].tolist(), *([None] * len(edges))], pa.int64())})
    return run


def near_vectors(vectors: DataFrame, least: float = 0.93, cell_rows: int = 2048, block: int = 1024,
                 sample_rows: int = 20_000, max_cells: int = 256) -> DataFrame:
    """Link ``vectors(vec_id, embedding, label)`` of equal, non-null label
    whose cosine, in double precision, is ``least`` or more; keep one per group.

    Equal vectors of a label are one class with a number of copies.  Spherical
    k-means on a bounded sample (the first ``sample_rows`` in hash order) gives
    cells; every vector joins its nearest cell and visits each earlier cell in
    which a partner may live, by an exact bound, so no link is lost.  Cells
    are cut into blocks of about ``block`` vectors, block products compare
    them, and a task returns counts and a spanning forest, not pairs.

    Returns one row per input row: vec_id, n_links (other vectors linked
    directly), component_id (smallest vec_id reachable, itself included), kept
    (vec_id = component_id).  Rows with a null label, a null, empty or zero
    vector, or null or non-finite components link with nothing; vectors of
    different length don't link; rows of an equal id are vectors of their own;
    a null id orders last; an empty table gives an empty result.  Extra
    columns are ignored.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label"))
    read = stored(base.mapInArrow(_read, "vec_id long, label string, dim int, digest binary, u binary"), "units")
    key = ["label", "dim", "digest"]
    classes = stored(read.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.first("u").alias("u"))
                     .withColumn("cid", F.monotonically_increasing_id()), "vectors")
    largest = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim", "label").first()
    cells = 1 if largest is None else min(max_cells, max(1, math.ceil(largest.n / cell_rows)))
    centroids = np.empty((0, 0))
    if cells > 1:
        drawn = classes.where(F.col("dim") == largest.dim).orderBy(F.xxhash64("digest", "label")).limit(sample_rows).select("u").toArrow()
        centroids = spherical_kmeans(np.vstack([np.frombuffer(b, np.float64) for b in drawn.column("u").to_pylist()]), cells)
    placed = stored(classes.select("cid", "u").mapInArrow(_assign(centroids, least), "cid long, cell int, home boolean"), "cells")
    placed = placed.join(classes.select("cid", "label", "dim", "copies", "u"), "cid")
    sizes = (placed.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int")).drop("n"))
    spread = (placed.join(sizes, ["label", "dim", "cell"]).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int")
    spread = spread.select("label", "dim", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                           side.alias("side"), "cid", "copies", "home", "u")
    found = stored(spread.groupBy("label", "dim", "cell", "i", "j").applyInArrow(_compare(least), "a long, b long, n long"), "links")
    links = found.where("n is not null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("n is null").select("a", "b")).withColumnsRenamed({"node": "cid"})
    named = classes.join(links, "cid", "left").join(roots, "cid", "left").select(
        *key, "least", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(firsts, "root").select(*key, "n_links", "component_id")
    sound = read.select("vec_id", *key).join(named, key).select("vec_id", "n_links", "component_id")

    @F.arrow_udf("boolean")
    def alone(embedding: pa.Array) -> pa.Array:
        return pa.array([_unit(e) is None for e in embedding.to_pylist()], pa.bool_())

    rest = base.where(F.col("label").isNull() | alone("embedding")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return sound.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
