"""Retrieval by matrix products, for vectors over few dimensions.

Where most queries and documents share dimensions, a join on the dimension
makes some rows per pair, and the pairs are quadratic.  Here vectors over at
most ``WIDEST`` dimensions are packed, some hundred a row, as the bytes of one
matrix.  The packed documents are stored once and broadcast compressed, in chunks
whose size is measured; the queries, spread over the cluster, stream past them.  Rows of
both sides are large, as each meeting of two rows moves both.  One product, in
single precision where weights allow, screens a block of queries against a
block of documents, and a task holds only the best ``k`` documents of each query
of its row, so neither its memory nor what it writes grows with the pairs.
Where the documents are one chunk, it ranks them too.  Exact: every query meets
every document, and what can be among the ``k`` best, by a bound on the error of
the screen, is summed again term by term in double precision, so equal documents
score equally wherever they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .layout import stored

#: columns of a matrix, bytes of a matrix, bytes of documents broadcast at once (before they are compressed)
WIDEST = 1024
BLOCK_BYTES = 512 << 10
CHUNK_BYTES = 384 << 20
#: matrices in a row of documents and in a row of queries, bytes of the scores that a task holds
DOC_BLOCKS, QUERY_BLOCKS, SCORE_BYTES = 8, 4, 32 << 20
#: for a large ``k``: bytes of documents that a task holds at once, and of the best of all queries of a row; of one of the best
HELD_BYTES, BEST_BYTES, PAIR_BYTES = 64 << 20, 16 << 20, 24
#: products of a join below which it is done within seconds
FEW_PRODUCTS = 200_000_000
#: about the cost of a product of the join, of a pair of vectors, and of a column of such a pair
JOIN_NS, PAIR_NS, COLUMN_NS = 50.0, 4.0, 0.1
#: of the bytes of packed documents
ZIP = "zstd"
#: weights between these have products and sums above zero and below infinity
LEAST, MOST = 1e-140, 1e140
#: the same in single precision
LEAST_SINGLE, MOST_SINGLE = 1e-15, 1e15
LEAST_BITS = np.float32(LEAST_SINGLE).view(np.uint32) - np.uint32(1)


class Best:
    """The ``k`` best documents so far of each of ``n`` queries: score
    descending (NaN first, as Spark orders), then document id."""

    def __init__(self, n: int, k: int, digits: int | None, tie: str):
        self.n, self.k, self.digits, self.tie = n, k, digits, tie
        self.cut = np.full(n, -np.inf)
        self.most = max(4 * k * n, 1 << 14)
        self.rows, self.scores, self.ids, self.held, self.cut_at = [], [], [], 0, -1

    def slack(self, cut: np.ndarray, error: float = 1e-9) -> np.ndarray:
        """What rounding and the ``error`` of a product can add to a score."""
        with np.errstate(invalid="ignore"):
            return np.where(np.isfinite(cut), np.abs(cut) * error + (0.0 if self.digits is None else 10.0 ** -self.digits), 0.0)

    def order(self, scores: np.ndarray) -> np.ndarray:
        """Scores as they are compared: rounded like `scalar.rounded`, NaN above all."""
        if self.digits is not None:
            scale = 10.0 ** self.digits
            with np.errstate(invalid="ignore", over="ignore"):
                size = np.abs(scores) * scale
                whole = np.floor(size)
                scores = np.copysign(whole + (size - whole >= 0.5), scores) / scale
        top = np.finfo(np.float64).max
        return np.nan_to_num(scores, nan=np.inf, posinf=top, neginf=-top)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: pa.Array) -> None:
        if len(rows):
            self.rows.append(rows)
            self.scores.append(scores)
            self.ids.append(ids)
            self.held += len(rows)
            if self.held > self.most or (self.held >= self.k * self.n and not np.isfinite(self.cut).any()):
                self.trim()

    def trim(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        if self.held == self.cut_at and len(self.rows) == 1:  # nothing came since
            return self.rows[0], self.scores[0], self.ids[0]
        rows, scores, ids = np.concatenate(self.rows), np.concatenate(self.scores), pa.concat_arrays(self.ids)
        order, k = self.order(scores), self.k
        counts = np.bincount(rows, minlength=self.n)
        if counts.max() >= k:
            by_row = np.argsort(rows, kind="stable")
            r, width = rows[by_row], int(counts.max())
            start = np.cumsum(counts) - counts
            kth = np.full(self.n, -np.inf)
            if self.n * width <= 4 * len(r) + (1 << 20):
                table = np.full((self.n, width), -np.inf)
                table[r, np.arange(len(r)) - start[r]] = order[by_row]
                kth = np.partition(table, width - k, axis=1)[:, width - k]
            else:
                falling = order[by_row][np.lexsort((-order[by_row], r))]
                full = counts >= k
                kth[full] = falling[start[full] + k - 1]
            self.cut = kth
            keep = order > kth[rows]
            room = k - np.bincount(rows[keep], minlength=self.n)
            tied = np.flatnonzero(order == kth[rows])
            spare = np.bincount(rows[tied], minlength=self.n) <= room
            keep[tied[spare[rows[tied]]]] = True
            tied = tied[~spare[rows[tied]]]
            if pa.types.is_nested(ids.type):  # no order here
                keep[tied] = True
            elif len(tied):  # by id, as many as there is room for
                sort = tied[np.lexsort((codes(ids.take(pa.array(tied)), self.tie), rows[tied]))]
                first = np.r_[True, rows[sort][1:] != rows[sort][:-1]]
                place = np.arange(len(sort)) - np.maximum.accumulate(np.where(first, np.arange(len(sort)), 0))
                keep[sort[place < room[rows[sort]]]] = True
            if not keep.all():
                at = np.flatnonzero(keep)
                rows, scores, ids = rows[at], scores[at], ids.take(pa.array(at))
        self.rows, self.scores, self.ids, self.held, self.cut_at = [rows], [scores], [ids], len(rows), len(rows)
        self.most = max(self.most, 2 * self.held)  # ties may all stay
        return rows, scores, ids

    def batch(self, queries: pa.Array, ranked: bool = False) -> pa.RecordBatch | None:
        if not self.held:
            return None
        rows, scores, ids = self.trim()
        if not ranked:
            return pa.RecordBatch.from_arrays([queries.take(pa.array(rows)), ids, pa.array(scores)], names=["q", "d", "score"])
        order = self.order(scores)
        sort = np.lexsort((codes(ids, self.tie), -order, rows))
        rows = rows[sort]
        if self.digits is not None:  # finite, as the weights are
            scores = order
        counts = np.bincount(rows, minlength=self.n)
        rank = np.arange(1, len(rows) + 1) - (np.cumsum(counts) - counts)[rows]
        return pa.RecordBatch.from_arrays([queries.take(pa.array(rows)), ids.take(pa.array(sort)), pa.array(scores[sort]), pa.array(rank, pa.int32())],
                                          names=["q", "d", "score", "rank"])


def codes(ids: pa.Array, tie: str) -> np.ndarray:
    """Numbers in the order of the ids, null first, or last with ``tie='desc'``."""
    if pa.types.is_signed_integer(ids.type) and not ids.null_count:
        numbers = ids.to_numpy(zero_copy_only=False).astype(np.int64)
        return numbers if tie == "asc" else ~numbers
    numbers = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    return numbers if tie == "asc" else -numbers


def _reached(p: DataFrame, cols: list[tuple], keys: list[str]) -> DataFrame:
    """A partition filter, where the postings are partitioned by a further key."""
    for i, c in enumerate(keys[1:], 1):
        p = p.where(F.col(c).isin(sorted({x[i] for x in cols})))
    return p


def columns(q: DataFrame, p: DataFrame, qid: str, did: str, keys: list[str], once: dict | None = None) -> list[tuple] | None:
    """The columns of the matrices: dimensions (and further keys) that queries ``(qid, *keys, _qw)`` and postings ``(did, *keys, _dw)``
    share.  None if the join on the keys is the better way: few products, many
    dimensions, vectors that share little, or weights whose sums could be zero,
    null or not finite.  The driver sees one row per column.  With ``once``, kept
    from one call to the next over the same postings, these are looked at once
    and give all columns, if they have no more than a matrix."""
    spark = q.sparkSession
    if not isinstance(p.schema[did].dataType, (T.IntegralType, T.StringType)) or isinstance(q.schema["dim"].dataType, T.StringType):
        return None

    def counts(df, weight):
        found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(weight).alias("given"), F.min(weight).alias("least"), F.max(weight).alias("most"))
        rows = found.dropna(subset=keys).limit(WIDEST + 1).collect()
        plain = all(r["n"] == r["given"] and r["least"] > LEAST and r["most"] < MOST for r in rows)
        return {tuple(r[c] for c in keys): r["n"] for r in rows} if plain and len(rows) <= WIDEST else None

    asked = counts(q, "_qw")
    if not asked:
        return None
    if once is not None and "counts" not in once:
        once["counts"] = counts(p, "_dw")
    if once and once["counts"]:
        found = once["counts"]
    else:
        kept = spark.createDataFrame(list(asked), T.StructType([q.schema[c] for c in keys]))
        p = _reached(p, list(asked), keys)
        found = counts(p.join(F.broadcast(kept), keys, "left_semi"), "_dw")
    few = int(spark.conf.get("spark.spire.fewProducts", str(FEW_PRODUCTS)))
    products = sum(n * asked.get(k, 0) for k, n in (found or {}).items())
    if not products or products < few:
        return None
    pairs = q.agg(F.approx_count_distinct(qid)).first()[0] * p.agg(F.approx_count_distinct(did)).first()[0]
    if few and pairs * (PAIR_NS + COLUMN_NS * len(found)) > products * JOIN_NS:
        return None
    return sorted(found)


def packed(df: DataFrame, cols: list[tuple], id_col: str, keys: list[str], weight: str, side: str, most: int) -> DataFrame:
    """``df(id, *keys, weight)`` as rows of many vectors, ``most`` at most: ids
    and the bytes of their matrix (of documents compressed); ``df`` is clustered
    by id, repeated entries add up."""
    rows, schema, width = _vectors(df, cols, [id_col], keys, weight), _schema(df.schema[id_col], side), len(cols)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, matrix = batch.column(0), _matrices(batch.column(1), width)
            ends = np.linspace(0, len(ids), math.ceil(len(ids) / most) + 1).astype(int).tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                data = matrix(a, b)
                if side == "d":
                    data = pa.array([pa.compress(data[0].as_buffer(), ZIP, asbytes=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([_one(ids.slice(a, b - a)), data], names=schema.fieldNames())

    return rows.mapInArrow(pack, schema)


def _schema(id_field: T.StructField, side: str, *more: T.StructField) -> T.StructType:
    return T.StructType([T.StructField(f"{side}_ids", T.ArrayType(id_field.dataType)), T.StructField(f"{side}_data", T.BinaryType()), *more])


def _vectors(df: DataFrame, cols: list[tuple], ids: list[str], keys: list[str], weight: str) -> DataFrame:
    """``(*ids, v)``: the entries of a vector as a list of column and weight."""
    numbered = df.sparkSession.createDataFrame([(*c, i) for i, c in enumerate(cols)], T.StructType([*(df.schema[c] for c in keys), T.StructField("_col", T.IntegerType())]))
    return df.join(F.broadcast(numbered), keys).groupBy(*ids).agg(F.collect_list(F.struct("_col", weight)).alias("v"))


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _matrices(lists: pa.ListArray, width: int):
    """Gives the matrix of rows a to b of a list of columns and weights, as one binary value."""
    ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
    at, w = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())

    def matrix(a: int, b: int) -> pa.Array:
        row, here = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1])), slice(ends[a], ends[b])
        return pa.array([np.bincount(row * width + at[here], weights=w[here], minlength=(b - a) * width).tobytes()], pa.binary())

    return matrix


def _dots(q: np.ndarray, d: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Sums of products of pairs of rows, each in the order of the columns."""
    out, step = np.empty(len(at)), max(1, (4 << 20) // (8 * q.shape[1]))
    for a in range(0, len(at), step):
        out[a:a + step] = np.einsum("ij,ij->i", q[at[a:a + step]], d[of[a:a + step]])
    return out


def _matrix(batch: pa.RecordBatch, side: str, i: int, width: int, zipped: bool = False) -> np.ndarray:
    data = batch.column(f"{side}_data")[i].as_buffer()
    if zipped:
        data = pa.decompress(data, len(batch.column(f"{side}_ids")[i]) * width * 8, ZIP)
    return np.frombuffer(data, np.float64).reshape(-1, width)


class _Block:
    """A matrix, and its values in single precision where that holds their products."""

    def __init__(self, values: np.ndarray):
        self.values = values
        with np.errstate(over="ignore"):
            single = values.astype(np.float32)
        # none is below zero, so values order like their bits, and zero less one is the greatest of these
        held = len(values) and single.max() <= MOST_SINGLE and (single.view(np.uint32) - np.uint32(1)).min() >= LEAST_BITS
        self.single = single if held and np.count_nonzero(single) == np.count_nonzero(values) else None

    def __len__(self) -> int:
        return len(self.values)

    def part(self, rows) -> _Block:
        out = object.__new__(_Block)
        out.values, out.single = self.values[rows], None if self.single is None else self.single[rows]
        return out


def _screen(q: _Block, d: _Block) -> tuple[np.ndarray, float, float]:
    """Scores of all pairs, their greatest relative error (terms are not below
    zero, so no sum loses more than its terms), and a bound below any score but zero."""
    if q.single is None or d.single is None:
        return q.values @ d.values.T, 1e-9, LEAST * LEAST * 0.5
    return q.single @ d.single.T, (q.values.shape[1] + 4) * 2.4e-7, LEAST_SINGLE * LEAST_SINGLE * 0.5


def _meet(best: Best, q: _Block, d: _Block, ids: pa.Array, threshold: float | None, rows: np.ndarray | None = None) -> None:
    """A block of documents for (some ``rows`` of) a block of queries."""
    cut, k = best.cut, best.k
    if rows is not None:
        q, cut = q.part(rows), cut[rows]
    scores, error, nothing = _screen(q, d)
    floor = _floor(cut - best.slack(cut, error), threshold, error, nothing)
    known = np.isfinite(cut)
    if len(d) > k and not known.any():  # nothing to go by yet: the k-th of these is at most that of all
        kth = np.partition(scores, len(d) - k, axis=1)[:, len(d) - k].astype(np.float64)
        floor = np.maximum(floor, kth - best.slack(kth, error))
    above = scores >= floor.astype(scores.dtype)[:, None]
    if len(d) > k and known.any() and not known.all():
        many = np.flatnonzero(np.count_nonzero(above, axis=1) > k)
        if len(many):
            kth = np.partition(scores[many], len(d) - k, axis=1)[:, len(d) - k].astype(np.float64)
            floor = np.maximum(floor[many], kth - best.slack(kth, error))
            above[many] = scores[many] >= floor.astype(scores.dtype)[:, None]
    at, of, exact = _exact(above, q, d, threshold)
    best.add(at if rows is None else rows[at], exact, ids.take(pa.array(of)))


def _floor(floor: np.ndarray, threshold: float | None, error: float, nothing: float) -> np.ndarray:
    """No shared dimension: no pair; nothing that cannot exceed ``threshold``."""
    return np.maximum(floor, nothing if threshold is None else max(nothing, threshold * (1 - error)))


def _places(above: np.ndarray) -> np.ndarray:
    """`np.flatnonzero` of a mask of which little is set: eight at a time."""
    flat = above.reshape(-1)
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    eight, bit = np.nonzero(flat[:whole].reshape(-1, 8)[some])
    return np.concatenate((some[eight] * 8 + bit, whole + np.flatnonzero(flat[whole:])))


def _exact(above: np.ndarray, q: _Block, d: _Block, threshold: float | None):
    """Pairs that passed the screen with their scores, if these exceed ``threshold``."""
    at, of = np.divmod(_places(above), above.shape[1])
    exact = _dots(q.values, d.values, at, of)
    if threshold is not None:
        over = exact > threshold
        at, of, exact = at[over], of[over], exact[over]
    return at, of, exact


def _find(k: int | None, threshold: float | None, digits: int | None, tie: str, width: int, ranked: bool = False, zipped: bool = False):
    """Without ``k`` every pair leaves at once.  Where documents come with their
    ``block``, a query meets the blocks it opens (``q_bits`` of ``q_open``).  For
    a large ``k`` some documents are held and a few queries at a time meet them
    all, as most documents of a block would be among the best so far."""
    step = max(1, BLOCK_BYTES // (8 * width))
    large = k is not None and 4 * k >= step

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held = None, [], []
        for batch in batches:
            numbers = batch.column("q_no").to_pylist()
            blocks = batch.column("block") if "block" in batch.schema.names else None
            for i in range(batch.num_rows):
                if numbers[i] != number:
                    _at_once(parts, held, threshold)
                    yield from _told(parts, ranked)
                    number, q, queries = numbers[i], _matrix(batch, "q", i, width).copy(), batch.column("q_ids")[i].values
                    many = max(1, len(q)) if blocks is not None else math.ceil(len(q) / math.ceil(len(q) / step))
                    parts = [(_Block(q[a:a + many]), queries.slice(a, many), None if k is None else Best(min(many, len(q) - a), k, digits, tie)) for a in range(0, len(q), many)]
                    if blocks is not None:
                        opened = batch.column("q_open")[i].values.to_numpy(zero_copy_only=False)
                        bits = np.frombuffer(batch.column("q_bits")[i].as_buffer(), np.uint8).reshape(len(opened), -1).copy()
                whole, every = _matrix(batch, "d", i, width, zipped), batch.column("d_ids")[i].values
                if blocks is not None:
                    _meet_opened(parts, whole, every, blocks[i].values.to_numpy(zero_copy_only=False), opened, bits, threshold, step)
                    continue
                if large:
                    held.append((whole, every))
                    if sum(len(m) for m, _ in held) * 8 * width >= HELD_BYTES:
                        _at_once(parts, held, threshold)
                    continue
                for a in range(0, len(whole), step):
                    d, ids = _Block(whole[a:a + step]), every.slice(a, step)
                    for part, asked, best in parts:
                        if best is None:
                            scores, error, nothing = _screen(part, d)
                            at, of, exact = _exact(scores >= _floor(np.zeros(1), threshold, error, nothing).astype(scores.dtype), part, d, threshold)
                            yield pa.RecordBatch.from_arrays([asked.take(pa.array(at)), ids.take(pa.array(of)), pa.array(exact)], names=["q", "d", "score"])
                        else:
                            _meet(best, part, d, ids, threshold)
        _at_once(parts, held, threshold)
        yield from _told(parts, ranked)
    return run


def _meet_opened(parts: list[tuple], whole: np.ndarray, every: pa.Array, blocks: np.ndarray, opened: np.ndarray, bits: np.ndarray, threshold: float | None, step: int) -> None:
    """A row of documents of some ``blocks`` for the queries that open these."""
    turns = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1, len(blocks)]
    for first, end in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):
        at = int(np.searchsorted(opened, blocks[first]))
        if at == len(opened) or opened[at] != blocks[first]:
            continue
        for part, _, best in parts:
            rows = np.flatnonzero(np.unpackbits(bits[at], count=len(part)))
            for a in range(first, end, step):
                b = min(a + step, end)
                _meet(best, part, _Block(whole[a:b]), every.slice(a, b - a), threshold, None if len(rows) == len(part) else rows)


def _at_once(parts: list[tuple], held: list[tuple], threshold: float | None) -> None:
    """All held documents for a few queries at a time; none is held any longer."""
    if not held:
        return
    d, ids = _Block(np.concatenate([m for m, _ in held])), pa.concat_arrays([i for _, i in held])
    held.clear()
    step = max(1, SCORE_BYTES // (8 * max(1, len(d))))
    for part, _, best in parts:
        for a in range(0, len(part), step):
            _meet(best, part, d, ids, threshold, None if step >= len(part) else np.arange(a, min(a + step, len(part))))


def _told(parts: list[tuple], ranked: bool) -> Iterator[pa.RecordBatch]:
    for _, queries, best in parts:
        if best is not None and (found := best.batch(queries, ranked)) is not None:
            yield found


def retrieve(q: DataFrame, p: DataFrame, cols: list[tuple], qid: str, did: str, keys: list[str], k: int | None, threshold: float | None,
             tie: str, digits: int | None, once: dict | None = None, block_bytes: int | None = None) -> DataFrame:
    """Scores ``(qid, did, score)`` of queries with all documents, at least the
    ``k`` best of a query in each chunk of documents; all of them without ``k``.
    With one chunk just the ``k`` best, rounded, and their ``rank``.  Queries go
    past the documents in rows, blocks of whole queries; with ``block_bytes`` a
    row is no larger than that (but holds one query).  ``once`` keeps the packed
    documents for the next call."""
    n = int(p.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, BLOCK_BYTES // (8 * len(cols)))
    held = {} if once is None else once
    if held.get("cols") != cols:
        rows = packed(_reached(p, cols, keys), cols, did, keys, "_dw", "d", DOC_BLOCKS * step)
        held["docs"], held["cols"] = stored(rows.withColumn("d_no", F.monotonically_increasing_id()), "documents", compression="zstd"), cols
        held["chunks"] = _chunks(held["docs"], len(cols))
    most = step * (1 if k is None else QUERY_BLOCKS)
    if k is not None and 4 * k >= step:
        most = max(1, min(most, BEST_BYTES // (PAIR_BYTES * k)))
    if block_bytes:
        most = max(1, min(most, block_bytes // (8 * len(cols))))
    find = _find(k, threshold, digits, tie, len(cols), k is not None and held["chunks"] == 1, zipped=True)
    # always dealt anew: partitions of another exchange may be made fewer, down to one task
    return _past(packed(q.repartition(n, qid), cols, qid, keys, "_qw", "q", most), held["docs"], held["chunks"], find, qid, did, q.schema[qid].dataType,
                 p.schema[did].dataType, k is not None and held["chunks"] == 1)


def _chunks(docs: DataFrame, width: int) -> int:
    return max(1, math.ceil((docs.agg(F.sum(F.size("d_ids").cast("long"))).first()[0] or 0) * 8 * width / CHUNK_BYTES))


def _past(q: DataFrame, docs: DataFrame, chunks: int, find, qid: str, did: str, qid_type: T.DataType, did_type: T.DataType, ranked: bool = False,
          width: int | None = None) -> DataFrame:
    """Packed queries stream past the packed, stored documents, broadcast in
    chunks; documents of one block a row (of that ``width``) as larger rows."""
    fields = [T.StructField("q", qid_type), T.StructField("d", did_type), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    schema = T.StructType(fields if ranked else fields[:3])
    q = q.withColumn("q_no", F.monotonically_increasing_id())
    parts = [docs.where(F.pmod(F.xxhash64("d_no"), F.lit(chunks)) == i).drop("d_no") for i in range(chunks)]
    if width is not None:
        parts = [_gathered(part, width) for part in parts]
    return reduce(DataFrame.unionByName, [q.crossJoin(F.broadcast(part)).mapInArrow(find, schema).withColumnsRenamed({"q": qid, "d": did}) for part in parts])


def _gathered(docs: DataFrame, width: int) -> DataFrame:
    """Matrices of one block each as rows of some blocks, as each meeting of a
    row with queries moves these; ``block`` then is that of each document."""
    most = DOC_BLOCKS * max(1, BLOCK_BYTES // (8 * width))
    schema = T.StructType([f if f.name != "block" else T.StructField("block", T.ArrayType(f.dataType)) for f in docs.schema])

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.list_value_length(batch.column("d_ids")).to_numpy(zero_copy_only=False)
            group = (np.cumsum(sizes) - sizes) // most
            turns = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
            for a, b in zip(turns[:-1].tolist(), turns[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                data = b"".join(x.as_buffer() for x in part.column("d_data"))
                blocks = pa.array(np.repeat(part.column("block").to_numpy(zero_copy_only=False), sizes[a:b]))
                yield pa.RecordBatch.from_arrays([_one(part.column("d_ids").flatten()), pa.array([data], pa.binary()), _one(blocks)], names=schema.fieldNames())

    return docs.mapInArrow(gather, schema)


def packed_blocks(p: DataFrame, cols: list[tuple], did: str) -> DataFrame:
    """Postings ``(block, did, dim, _dw)``, clustered by block, as stored
    matrices of documents of one block each."""
    schema = _schema(p.schema[did], "d", p.schema["block"])
    rows, width = _vectors(p, cols, ["block", did], ["dim"], "_dw"), len(cols)
    step = max(1, BLOCK_BYTES // (8 * width))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, ids, matrix = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), _matrices(batch.column(2), width)
            turns = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
            for first, end in zip(turns[:-1], turns[1:], strict=True):
                for a in range(first, end, step):
                    b = min(a + step, end)
                    yield pa.RecordBatch.from_arrays([_one(ids.slice(a, b - a)), matrix(a, b), pa.array(block[a:a + 1])], names=schema.fieldNames())

    return stored(rows.sortWithinPartitions("block").mapInArrow(pack, schema).withColumn("d_no", F.monotonically_increasing_id()), "block-matrices")


def open_blocks(q: DataFrame, pairs: DataFrame, docs: DataFrame, cols: list[tuple], qid: str, did: str, did_type: T.DataType, k: int,
                threshold: float | None, tie: str, digits: int | None) -> DataFrame:
    """Scores ``(qid, did, score)`` of queries with the documents of the blocks
    they open, ``pairs(qid, block)``: at least the ``k`` best of a query.  A row
    of queries names the blocks that some of them open, and has one bit for each
    query and block: it moves with every row of documents."""
    more = [T.StructField("q_open", T.ArrayType(pairs.schema["block"].dataType)), T.StructField("q_bits", T.BinaryType())]
    schema, width = _schema(q.schema[qid], "q", *more), len(cols)
    step = max(1, BLOCK_BYTES // (8 * width))
    n = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = _vectors(q, cols, [qid], ["dim"], "_qw")
    opened = pairs.groupBy(qid).agg(F.collect_list("block").alias("_open"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, matrix = batch.column(0), _matrices(batch.column(1), width)
            ends = np.linspace(0, len(ids), math.ceil(len(ids) / step) + 1).astype(int).tolist()
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                some = batch.column(2).slice(a, b - a)
                blocks, at = np.unique(some.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
                bits = np.zeros((len(blocks), b - a), bool)
                bits[at, np.repeat(np.arange(b - a), pc.list_value_length(some).to_numpy(zero_copy_only=False))] = True
                yield pa.RecordBatch.from_arrays([_one(ids.slice(a, b - a)), matrix(a, b), _one(pa.array(blocks)), pa.array([np.packbits(bits, axis=1).tobytes()], pa.binary())], names=schema.fieldNames())

    packed_q = vectors.join(opened, qid).select(qid, "v", "_open").repartition(n, qid).mapInArrow(pack, schema)
    return _past(packed_q, docs, _chunks(docs, width), _find(k, threshold, digits, tie, width), qid, did, q.schema[qid].dataType, did_type, width=width)
