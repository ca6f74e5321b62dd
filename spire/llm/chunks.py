"""Whole texts in chunks, and keyed look-ups between all chunks.

Several operators ask, of millions of hashes in one text, which of them occur
elsewhere.  A row per hash and place would be several times the input, so:
texts are stored once, compressed, bucketed by chunk; a pass over a chunk sends
each distinct hash of the chunk once, packed by hash bucket; the task of a
bucket answers each chunk with one bit a hash; the next pass over the chunk
derives the same hashes in the same order and reads the bits.  A hash that
occurs in a third of all texts is one entry a chunk.  Chunks and buckets grow
in number with the input, not in size.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import hash_words, packed, rolled, unpacked

MESSAGE = "chunk long, bucket long, hashes binary, keys binary"
REPLY = "chunk long, bucket long, mask binary"
_MESSAGE = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("keys", pa.binary())])
_REPLY = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("mask", pa.binary())])
#: a null id orders after all others
NO_ID = (1 << 63) - 1


def bucketed(rows: DataFrame, chunks: int) -> DataFrame:
    """Store ``rows(chunk, ...)`` bucketed by chunk; reading the table back
    grouped by chunk needs no shuffle."""
    spark = rows.sparkSession
    files = min(max(1, math.ceil(chunks / 3)), 50_000)  # Spark allows 100,000 buckets a table
    name = f"llm_chunks_{uuid.uuid4().hex[:12]}"
    (rows.repartition(files, "chunk").write.bucketBy(files, "chunk")
     .option("path", scratch_path(spark, "llm-chunks")).saveAsTable(name))
    return spark.table(name)


def chunk_count(docs: DataFrame, chunk_bytes: int = 8 << 20) -> int:
    """How many chunks of about ``chunk_bytes`` of text the documents make."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, math.ceil(total / chunk_bytes))


def key_of(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs(doc_id, text)`` as a stored (chunk, key, no_id, z), and the number of chunks."""
    n = chunk_count(docs)
    # by id and text, so that rows of one id, or of none, spread
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("chunk"), key_of().alias("key"),
                       F.col("doc_id").isNull().alias("no_id"), packed("text").alias("z"))
    return bucketed(rows, n), n


@dataclass
class Words:
    """The texts of a chunk in order of their keys, as one run of words."""

    keys: np.ndarray      # of each text, ascending
    order: np.ndarray     # rows of the chunk in this order
    texts: list[list[bytes]]
    hashes: np.ndarray    # of each word
    text: np.ndarray      # its text
    at: np.ndarray        # its place in the text
    left: np.ndarray      # words from it to the end of its text

    @staticmethod
    def of(table: pa.Table, lower: bool = False) -> Words:
        keys = table.column("key").to_numpy()
        order = np.argsort(keys, kind="stable")
        raw = unpacked(table.column("z"))
        return Words.split([raw[i] or b"" for i in order], keys[order], order, lower)

    @staticmethod
    def split(raw: list[bytes], keys: np.ndarray, order: np.ndarray, lower: bool = False) -> Words:
        texts = [(t.lower() if lower else t).split() for t in raw]
        sizes = np.array([len(t) for t in texts], np.int64)
        n = int(sizes.sum())
        hashes = hash_words([w for t in texts for w in t])
        text = np.repeat(np.arange(len(texts)), sizes)
        at = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return Words(keys, order, texts, hashes, text, at, sizes[text] - at)

    def runs(self, width: int, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (of the whole run) in ``where`` that start ``width`` words of
        one text, and the hashes of these."""
        places = np.flatnonzero(where & (self.left >= width))
        return places, (rolled(self.hashes, width)[places] if len(places) else np.empty(0, np.uint64))


@dataclass
class Distinct:
    """The distinct hashes of a chunk in the order in which they are sent."""

    values: np.ndarray    # by (bucket, value)
    bucket: np.ndarray
    first: np.ndarray     # first and last occurrence
    last: np.ndarray
    of: np.ndarray        # occurrence -> index in values

    @staticmethod
    def among(hashes: np.ndarray, buckets: int) -> Distinct:
        bucket = (hashes >> np.uint64(1)) % np.uint64(buckets)
        order = np.lexsort((np.arange(len(hashes)), hashes, bucket))
        h = hashes[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        starts = np.flatnonzero(new)
        of = np.empty(len(h), np.int64)
        of[order] = np.cumsum(new) - 1
        ends = np.append(starts[1:], len(h)) - 1
        return Distinct(h[starts], bucket[order][starts].astype(np.int64), order[starts], order[ends], of)

    def messages(self, chunk: int, keys: np.ndarray | None = None, kind: type = np.int64, short: bool = False) -> pa.Table:
        """One row per bucket that has hashes here; ``keys`` of a ``kind`` go
        with the hashes.  ``short`` sends the upper halves, where an answer may
        take two hashes of a bucket for one."""
        buckets, starts = np.unique(self.bucket, return_index=True)
        ends = np.append(starts[1:], len(self.bucket))
        sent = (self.values >> np.uint64(32)).astype(np.uint32) if short else self.values
        blobs = [sent[a:b].tobytes() for a, b in zip(starts, ends)]
        more = [None if keys is None else keys[a:b].astype(kind).tobytes() for a, b in zip(starts, ends)]
        return pa.Table.from_arrays([pa.array(np.full(len(buckets), chunk, np.int64)), pa.array(buckets), pa.array(blobs, pa.binary()),
                                     pa.array(more, pa.binary())], schema=_MESSAGE)

    def answered(self, replies: pa.Table, graded: bool = False) -> np.ndarray:
        """The bit (or the grade) of each value; a bucket without a reply says no."""
        out = np.zeros(len(self.values), np.uint8 if graded else bool)
        buckets, starts = np.unique(self.bucket, return_index=True)
        ends = np.append(starts[1:], len(self.bucket))
        span = {int(b): (s, e) for b, s, e in zip(buckets, starts, ends)}
        for b, mask in zip(replies.column("bucket").to_pylist(), replies.column("mask").to_pylist()):
            s, e = span[b]
            got = np.frombuffer(mask, np.uint8)
            out[s:e] = got if graded else np.unpackbits(got, count=e - s).astype(bool)
        return out


def _answer(table: pa.Table, judge, kind: type = np.uint64) -> pa.Table:
    """``judge(hashes, keys)`` says one bit for each hash sent to a bucket."""
    blobs = [np.frombuffer(b, kind) for b in table.column("hashes").to_pylist()]
    sizes = [len(b) for b in blobs]
    keys = table.column("keys").to_pylist()
    flat = np.concatenate([np.frombuffer(k, np.int64) for k in keys]) if keys[0] is not None else None
    bits = np.split(judge(np.concatenate(blobs), flat), np.cumsum(sizes)[:-1])
    chunks, buckets = table.column("chunk").to_pylist(), table.column("bucket").to_pylist()
    told = [(c, b, np.packbits(x).tobytes()) for c, b, x in zip(chunks, buckets, bits) if x.any()]
    return pa.Table.from_arrays([pa.array([t[i] for t in told], f.type) for i, f in enumerate(_REPLY)], schema=_REPLY)


def _grade(table):
    """How often each (short) hash occurs in all chunks, one byte a hash: 0 for
    once, else a step of the logarithm; ``keys`` are the counts of the chunks."""
    blobs = [np.frombuffer(b, np.uint32) for b in table.column("hashes").to_pylist()]
    flat, n = np.concatenate(blobs), np.concatenate([np.frombuffer(k, np.uint32) for k in table.column("keys").to_pylist()])
    _, of = np.unique(flat, return_inverse=True)
    total = np.bincount(of, weights=n)[of]
    grade = np.where(total < 2, 0, np.minimum(255, 1 + 4 * np.log2(np.maximum(total, 1)))).astype(np.uint8)
    parts = np.split(grade, np.cumsum([len(b) for b in blobs])[:-1])
    return pa.Table.from_arrays([table.column("chunk"), table.column("bucket"), pa.array([g.tobytes() for g in parts], pa.binary())], schema=_REPLY)


def _elsewhere(hashes: np.ndarray, _) -> np.ndarray:
    order = np.argsort(hashes)
    h = hashes[order]
    twice = np.zeros(len(h), bool)
    same = h[1:] == h[:-1]
    twice[1:] |= same
    twice[:-1] |= same
    out = np.empty(len(h), bool)
    out[order] = twice
    return out


def _smaller(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    order = np.lexsort((keys, hashes))
    h, k = hashes[order], keys[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    least = k[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(h), bool)
    out[order] = least < k
    return out


def seen_elsewhere(messages: DataFrame, short: bool = False) -> DataFrame:
    """Which of the hashes another chunk has sent too; of ``short`` ones a few more."""
    kind = np.uint32 if short else np.uint64
    return messages.groupBy("bucket").applyInArrow(lambda t: _answer(t, _elsewhere, kind), REPLY)


def seen_smaller(messages: DataFrame) -> DataFrame:
    """For which of the hashes another chunk has sent a smaller key."""
    return messages.groupBy("bucket").applyInArrow(lambda t: _answer(t, _smaller), REPLY)


def seen_often(messages: DataFrame) -> DataFrame:
    """How often each of the short hashes occurs, by the counts sent as keys."""
    return messages.groupBy("bucket").applyInArrow(_grade, REPLY)
