"""SentencePiece encoding and decoding on a relational lattice."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import chunk_count, key_of
from .common import hash_words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: a word of the lattice: a run of letters or of signs with the blank before
#: it, or one other character; runs are cut at a bounded length
WORD = re.compile(r" ?[^\W\d_]{1,47}| ?[^\s\w]{1,16}|.", re.DOTALL)
#: cost of a piece: PIECE + ln(rank + 2); of a byte of a character without a piece: BYTE
PIECE, BYTE = 8.0, 20.0

#: a list of words for a bucket (place: the bucket, from 0), or the texts of a
#: chunk as numbers of its words (place: the chunk, below 0)
SENT = "place long, chunk long, words binary, texts binary"
REPLY = "place long, bucket long, ids binary"
ENCODED = "doc_id long, ids array<int>"
_SENT = pa.schema([("place", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("texts", pa.binary())])
_REPLY = pa.schema([("place", pa.int64()), ("bucket", pa.int64()), ("ids", pa.binary())])
_WORDS = pa.schema([("place", pa.int64()), ("w", pa.int64()), ("word", pa.string())])
_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def load_pieces(path: str = MODEL) -> tuple[list[tuple[str, int, float]], list[bytes], int]:
    """(piece with blanks for the space mark, id, cost) of the ordinary pieces;
    the bytes of every id; the id of byte 0.  A vocabulary has a fixed size."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table, raw, zero = [], [], 0
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i).replace("▁", " ")
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            zero = i - value
            raw.append(bytes([value]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            raw.append(b"")
        else:
            table.append((piece, i, PIECE + math.log(2.0 - model.get_score(i))))
            raw.append(piece.encode())
    return table, raw, zero


def words_of(text: str) -> list[str]:
    """The text after the leading blank that the model adds, in lattice words."""
    return WORD.findall(" " + text) if text else []


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """Edges of the lattices of distinct ``words(place, w, word)``: (place, edge, id).

    Substrings of at most ``longest`` code points are exploded and joined to
    the piece table (broadcast: a vocabulary of fixed size).  An edge is the
    number of its word, its start and its end in one number; the edges of a
    place stay where its words are.
    """
    size = F.length("word")
    starts = words.withColumn("start", F.explode(F.sequence(F.lit(0), size - 1)))
    spans = starts.withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("start")))))
    spans = spans.withColumn("piece", F.substr("word", F.col("start") + 1, F.col("len")))
    edge = F.shiftleft("w", 16) + F.shiftleft(F.col("start").cast("long"), 8) + F.col("start") + F.col("len")
    return spans.join(F.broadcast(pieces), "piece").select("place", edge.alias("edge"), "id")


def best_paths(words: pa.Array, edge: np.ndarray, piece: np.ndarray, cost: np.ndarray, byte_zero: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best segmentation of each word, one after another, and how
    many each word has.  The `lattice` edges of all words are taken by their
    ends: of the ways to a place the one of least cost stays, then of earliest
    start.  A character without a piece is an edge of its own, spelt in bytes.
    """
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(pc.cast(words, pa.binary()).to_pylist()), np.uint8)
    first = np.flatnonzero((raw & 0xC0) != 0x80)  # byte of each character
    width = np.diff(first, append=len(raw))
    char = np.cumsum(size) - size  # of each word
    base = char + np.arange(len(size))  # its place 0; it has one place more than characters
    w, start, end = edge >> 16, edge >> 8 & 255, edge & 255
    one = end - start == 1
    bare = np.ones(len(first), bool)
    bare[char[w[one]] + start[one]] = False
    bare = np.flatnonzero(bare)
    own = np.repeat(np.arange(len(size)), size)[bare]
    at = bare - char[own]
    w, start, end = np.concatenate((w, own)), np.concatenate((start, at)), np.concatenate((end, at + 1))
    price = np.concatenate((cost[piece], width[bare] * BYTE))
    piece = np.concatenate((piece.astype(np.int64), np.full(len(bare), -1)))
    order = np.argsort(end << 48 | w << 8 | start)
    w, start, end, price, piece = w[order], start[order], end[order], price[order], piece[order]

    places = len(first) + len(size)
    best, back, by = np.zeros(places), np.zeros(places, np.int64), np.zeros(places, np.int64)
    cuts = np.searchsorted(end, np.arange(1, size.max(initial=0) + 2))
    for stop, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]), 1):
        of = w[a:b]
        heads = np.flatnonzero(np.diff(of, prepend=-1))
        way = best[base[of] + start[a:b]] + price[a:b]
        least = np.minimum.reduceat(way, heads)
        group = np.repeat(np.arange(len(heads)), np.diff(heads, append=b - a))
        hit = np.flatnonzero(way == least[group])
        hit = hit[np.diff(group[hit], prepend=-1) > 0]
        to = base[of[heads]] + stop
        best[to], back[to], by[to] = least, start[a:b][hit], piece[a:b][hit]

    on, here, live = np.zeros(places, bool), size.copy(), np.flatnonzero(size)
    while len(live):
        to = base[live] + here[live]
        on[to] = True
        here[live] = back[to]
        live = live[here[live] > 0]
    path = np.flatnonzero(on)
    own = np.repeat(np.arange(len(size)), size + 1)[path]
    ids = by[path]
    char = np.minimum(path - own - 1, len(first) - 1)  # the last one of each edge
    many = np.where(ids < 0, width[char], 1)
    out = np.repeat(ids, many)
    spelt = np.flatnonzero(out < 0)
    inner = np.arange(len(out)) - np.repeat(np.cumsum(many) - many, many)
    out[spelt] = byte_zero + raw[np.repeat(first[char], many)[spelt] + inner[spelt]]
    return out, np.bincount(own, weights=many, minlength=len(size)).astype(np.int64)


def _gather(flat: np.ndarray, lengths: np.ndarray, index: np.ndarray, step: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``index`` of ``flat`` (run i has ``lengths[i]`` items) one after
    another, and the places where they end, 0 first; in steps, to keep the
    index arrays small."""
    starts = np.cumsum(lengths) - lengths
    end = np.concatenate(([0], np.cumsum(lengths[index], dtype=np.int64)))
    out = np.empty(end[-1], flat.dtype)
    for a in range(0, len(index), step):
        w = index[a:a + step]
        at = np.arange(end[a], end[a + len(w)])
        out[end[a]:end[a + len(w)]] = flat[at - np.repeat(end[a:a + len(w)] - starts[w], lengths[w])]
    return out, end


def pack_words(words: pa.Array, cuts: np.ndarray) -> list[bytes]:
    """Runs of words, cut at ``cuts``, as bytes; a word has fewer than 256."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]
    raw, long = memoryview(words.buffers()[2] or b""), np.diff(ends).astype(np.uint8)
    press = zstandard.ZstdCompressor(level=3)
    return [press.compress(np.uint32(b - a).tobytes() + long[a:b].tobytes() + raw[ends[a]:ends[b]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def unpack_words(blob: bytes) -> pa.Array:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(np.frombuffer(raw, np.uint8, n, 4), out=ends[1:])
    return pa.StringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(raw[4 + n:]))


def pack_numbers(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers under 2 ** 32; equal bytes of all numbers stand together, as high ones are mostly 0."""
    flat = np.concatenate([a.astype("<u4") for a in arrays])
    head = np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + flat.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_numbers(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    flat = np.frombuffer(raw, np.uint8, offset=8 + 8 * n).reshape(4, -1).T.copy().view("<u4").ravel()
    return np.split(flat, np.cumsum(sizes)[:-1])


def _groups(batches, limit: int):
    """The rows of all batches in tables of about ``limit`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        long = 16 + pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(long), 0
        while at < batch.num_rows:
            before = ends[at] - long[at]
            to = min(batch.num_rows, int(np.searchsorted(ends, before + limit - size)) + 1)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1] - before)
            at = to
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _release() -> None:
    """Memory that a pass has freed goes back to the system: workers stay for
    later passes, and what they keep counts beside those at work."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # and numpy's


class _Coder:
    """The passes over a chunk of texts and over a bucket of words."""

    def __init__(self, buckets: int, chunk_bytes: int, cost: np.ndarray, byte_zero: int):
        self.buckets, self.chunk_bytes, self.cost, self.zero = buckets, chunk_bytes, cost, byte_zero
        self.kind = np.uint16 if len(cost) <= 1 << 16 else np.uint32  # of an id on the way

    def send(self, batches):
        task = TaskContext.get().partitionId()
        for number, rows in enumerate(_groups(batches, self.chunk_bytes)):
            yield from self.chunk(task, number, rows).to_batches()
            _release()

    def chunk(self, task: int, number: int, rows: pa.Table) -> pa.Table:
        """The distinct words of a chunk by bucket, and its texts as their
        numbers: parts between blanks, and the words of each distinct part.  No
        word reaches over a blank but the one it starts with, so the parts are
        cut all together, once each."""
        text = rows.column("text").combine_chunks()
        full = pc.fill_null(pc.greater(pc.binary_length(text), 0), False)
        split = pc.split_pattern(text.filter(full), " ")
        counts = np.zeros(len(text), np.int64)
        counts[full.to_numpy(zero_copy_only=False)] = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        parts = coded.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(parts)], parts), " ")[0].as_py()
        found = pa.array(WORD.findall(" " + joined) if len(parts) else [], pa.string()).dictionary_encode()
        words, word = found.dictionary, found.indices.to_numpy()
        ends = np.cumsum(pc.utf8_length(words).to_numpy().astype(np.int64)[word])
        cut = np.searchsorted(ends, np.cumsum(pc.utf8_length(parts).to_numpy().astype(np.int64) + 1)) + 1
        bucket = (hash_words(pc.cast(words, pa.binary()).to_pylist()) % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        to, starts = np.unique(bucket[order], return_index=True)
        blobs = pack_words(words.take(pa.array(order)), np.append(starts, len(order)))
        keys = rows.column("key").to_numpy().view(np.uint32)
        none = rows.column("no_id").to_numpy().astype(np.uint32)
        body = pack_numbers(keys, none, counts, coded.indices.to_numpy(), np.diff(cut, prepend=0), place[word], np.array([len(words)]))
        # a name by content: if a repeated task meets other rows, its texts find no replies
        name = xxhash.xxh3_64(b"%d %d " % (task, number))
        for blob in (body, *blobs):
            name.update(blob)
        name = -1 - (name.intdigest() >> 1)
        return pa.Table.from_arrays([pa.array([*to.tolist(), name], pa.int64()), pa.array([name] * (len(to) + 1), pa.int64()),
                                     pa.array([*blobs, None], pa.binary()), pa.array([None] * len(to) + [body], pa.binary())], schema=_SENT)

    @staticmethod
    def asked(sent: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words of a bucket in order, the number of each word sent
        in this order, and where the words of each message end, 0 first."""
        lists = [unpack_words(b) for b in sent.column("words").to_pylist()]
        coded = pa.concat_arrays(lists).dictionary_encode()
        order = pc.array_sort_indices(coded.dictionary).to_numpy()
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        return coded.dictionary.take(pa.array(order)), number[coded.indices.to_numpy()], np.cumsum([0, *map(len, lists)])

    def distinct(self, key, sent):
        if key[0].as_py() < 0:
            return _WORDS.empty_table()
        words = self.asked(sent)[0]
        _release()
        return pa.Table.from_arrays([pa.array(np.full(len(words), key[0].as_py())), pa.array(np.arange(len(words))), words], schema=_WORDS)

    def answer(self, key, sent, edges):
        if key[0].as_py() < 0:
            return _REPLY.empty_table()
        words, number, cuts = self.asked(sent)
        edge, piece = edges.column("edge").to_numpy(), edges.column("id").to_numpy()
        order, step = np.argsort(edge), 4096  # words at once: arrays of all edges would be many times the edges
        edge, piece, flats, sizes = edge[order], piece[order], [], []
        for a in range(0, len(words), step):
            x, y = np.searchsorted(edge, [a << 16, (a + step) << 16])
            ids, many = best_paths(words.slice(a, step), edge[x:y] - (a << 16), piece[x:y], self.cost, self.zero)
            flats.append(ids.astype(self.kind))
            sizes.append(many)
            _release()
        sizes = np.concatenate(sizes)
        flat, ends = _gather(np.concatenate(flats), sizes, number)
        long = sizes[number].astype(np.uint8)
        press = zstandard.ZstdCompressor(level=3)
        out = [press.compress(np.uint32(b - a).tobytes() + long[a:b].tobytes() + flat[ends[a]:ends[b]].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pa.Table.from_arrays([sent.column("chunk"), sent.column("place"), pa.array(out, pa.binary())], schema=_REPLY)

    def encode(self, key, sent, replies):
        if key[0].as_py() >= 0:
            return _ENCODED.empty_table()
        tool, lengths, flats = zstandard.ZstdDecompressor(), [np.empty(0, np.int64)], [np.empty(0, self.kind)]
        for _, blob in sorted(zip(replies.column("bucket").to_pylist(), replies.column("ids").to_pylist())):
            raw = tool.decompress(blob)
            n = int(np.frombuffer(raw, np.uint32, 1)[0])
            lengths.append(np.frombuffer(raw, np.uint8, n, 4).astype(np.int64))
            flats.append(np.frombuffer(raw, self.kind, offset=4 + n))
        (body,) = sent.column("texts").to_pylist()
        keys, none, counts, part, sizes, word, n = unpack_numbers(body)
        lengths, flat = np.concatenate(lengths), np.concatenate(flats)
        if len(lengths) != n[0]:
            raise ValueError(f"{len(lengths)} of {n[0]} words of a chunk were answered: its rows were not the same when a task was repeated")
        flat, end = _gather(flat, lengths, word)
        lengths = np.diff(end[np.cumsum(np.append(0, sizes), dtype=np.int64)])
        ids, end = _gather(flat, lengths, part)
        offsets = end[np.cumsum(np.append(0, counts), dtype=np.int64)]
        del body, flat, end, word, part, lengths, flats
        _release()
        doc = pa.array(keys.view(np.int64), pa.int64(), mask=none.astype(bool))
        return pa.Table.from_arrays([doc, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))], schema=_ENCODED)


def encode_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Piece ids of every whole text of ``docs(doc_id, text)``: (doc_id, ids).

    As the model says, a text gets a leading blank, blanks belong to what
    follows, nothing else is normalised, and characters without a piece are
    spelt in bytes.  The distinct words of all texts go through `lattice`
    once each; the chunks of texts ask for the words they hold and put the
    texts together.  Texts are read once and move as numbers of their words,
    words as lists a chunk.  Words are bounded, so a text without blanks has
    bounded lattices.  Of the
    segmentations of each word the one of least cost is taken (a Zipf cost by
    the rank of the pieces), not the one of the model's merges.  Pieces that go
    over the end of a word (runs of blanks, signs with an underscore or a
    carriage return) are never chosen, so over a whole text a cheaper
    segmentation may exist.

    Null and empty texts have no ids; null ids and repeated rows are ordinary
    rows; an empty table gives an empty result.  Extra columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    table, raw, zero = load_pieces(model)
    schema = T.StructType([T.StructField("piece", T.StringType()), T.StructField("id", T.IntegerType())])
    cost, least = np.full(len(raw), np.inf), {}
    for piece, i, c in sorted(table, key=lambda row: (row[2], row[1])):
        cost[least.setdefault(piece, i)] = c  # of pieces of one spelling the cheapest
    pieces = spark.createDataFrame(list(least.items()), schema)
    chunk_bytes = 3 << 20
    parts = min(20_000, chunk_count(docs, chunk_bytes))
    run = _Coder((parts + 1) // 2, chunk_bytes, cost, zero)
    texts = docs.select(key_of().alias("key"), F.col("doc_id").isNull().alias("no_id"), "text")
    # one plan: one exchange serves three passes, so texts are cut once
    sent = texts.mapInArrow(lambda b: run.send(b), SENT).repartition(parts, "place")
    words = sent.groupBy("place").applyInArrow(lambda k, t: run.distinct(k, t), "place long, w long, word string").repartition(parts, "place")
    edges = lattice(words, pieces, max(map(len, least)))
    told = sent.groupBy("place").cogroup(edges.groupBy("place")).applyInArrow(lambda k, a, b: run.answer(k, a, b), REPLY).repartition(parts, "place")
    return sent.groupBy("place").cogroup(told.groupBy("place")).applyInArrow(lambda k, t, r: run.encode(k, t, r), ENCODED)


def decoder(model: str = MODEL):
    """A column function ids -> text.  Null ids give null; control ids give nothing."""
    raw = load_pieces(model)[1]
    spelt, sizes = np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw])

    @F.arrow_udf(T.StringType())
    def decode(ids: pa.Array) -> pa.Array:
        flat, ends, valid = ids.values.to_numpy(), ids.offsets.to_numpy(), ids.is_valid().to_pylist()
        out, step = [], 256  # a whole batch at once would be many times its size
        for a in range(0, len(ids), step):
            at = ends[a:a + step + 1]
            text, to = _gather(spelt, sizes, flat[at[0]:at[-1]])
            text, to = text.tobytes(), to[at - at[0]].tolist()
            for x, y, ok in zip(to[:-1], to[1:], valid[a:a + step]):
                one = text[x:y].decode("utf-8", "replace") if ok else None
                out.append(one[1:] if one and one[0] == " " else one)
        _release()
        return pa.array(out, pa.string())

    return decode
