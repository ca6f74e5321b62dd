"""Line dedup: two Bloom filters name the lines seen twice, exact counts decide."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import REPLY, Distinct, bucketed, chunk_count
from .common import hash_words, mix, packed, stored, unpacked

BLANK = b" \t\n\v\f\r"
#: positions of a Bloom filter, probes a hash, and hashes for which it is made
PLACES, PROBES, FILLED = 1 << 24, 4, 1 << 20

RESULT = "doc_id long, n_lines long, n_dropped long, kept_text string"
_ASK = "chunk long, bucket long, hashes binary, twice binary"
_SUSPECT = "chunk long, digest binary, docs long, last long"


class SeenTwice:
    """A filter of hashes seen and a filter of hashes seen again.  Hashes added
    twice are always in the second; one added once is so with a chance of
    0.3 % if no more than ``FILLED`` hashes come."""

    def __init__(self, places: int = PLACES):
        self.once, self.again = np.zeros(places, bool), np.zeros(places, bool)

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        start, step = mix(hashes), mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        with np.errstate(over="ignore"):
            probes = start[None, :] + step[None, :] * np.arange(PROBES, dtype=np.uint64)[:, None]
        return (probes % np.uint64(len(self.once))).astype(np.int64)

    def add(self, hashes: np.ndarray, twice: np.ndarray) -> None:
        """Distinct ``hashes``; ``twice`` marks those that the sender has seen more than once."""
        at = self._at(hashes)
        self.again[at[:, self.once[at].all(axis=0) | twice]] = True
        self.once[at] = True

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        return self.again[self._at(hashes)].all(axis=0)


def _suspected(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (bucket, turn): turn 1 fills the bucket's filters, turn 2
    asks them.  Only the two filters and one batch are in memory."""
    now = filters = None
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("mask", pa.binary())])
    for batch in batches:
        told = []
        for row in batch.to_pylist():
            if row["bucket"] != now:
                now, filters = row["bucket"], SeenTwice()
            hashes = np.frombuffer(row["hashes"], np.uint64)
            if row["turn"] == 1:
                filters.add(hashes, np.unpackbits(np.frombuffer(row["twice"], np.uint8), count=len(hashes)).astype(bool))
            else:
                bits = filters.suspects(hashes)
                if bits.any():
                    told.append((row["chunk"], now, np.packbits(bits).tobytes()))
        if told:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*told), schema)], schema=schema)


class _Dedup:
    """The passes over one chunk of documents."""

    def __init__(self, least: int, buckets: int):
        self.least, self.buckets = least, buckets

    def key(self, line: bytes) -> bytes | None:
        """What is compared of a line; None for one that is too short to count."""
        key = line.strip(BLANK).lower()
        return key if len(key) >= self.least and (key.isascii() or len(key.decode("utf-8", "replace")) >= self.least) else None

    def texts(self, table: pa.Table) -> Iterator[list[bytes]]:
        return ((t or b"").split(b"\n") for t in unpacked(table.column("z")))

    def keys(self, table: pa.Table) -> tuple[list[bytes], np.ndarray]:
        """The distinct keys of each document, one document after another, and the row of each."""
        found, row = [], []
        for i, lines in enumerate(self.texts(table)):
            mine = {k for k in map(self.key, lines) if k is not None}
            found += mine
            row += [i] * len(mine)
        return found, np.array(row, np.int64)

    def ask(self, key, table: pa.Table) -> pa.Table:
        asked = Distinct.among(hash_words(self.keys(table)[0]), self.buckets)
        twice = asked.first != asked.last
        buckets, starts = np.unique(asked.bucket, return_index=True)
        parts = list(zip(starts, np.append(starts[1:], len(asked.bucket))))
        return pa.table([pa.array(np.full(len(buckets), key[0].as_py(), np.int64)), pa.array(buckets.astype(np.int64)),
                         pa.array([asked.values[a:b].tobytes() for a, b in parts], pa.binary()),
                         pa.array([np.packbits(twice[a:b]).tobytes() for a, b in parts], pa.binary())], names=["chunk", "bucket", "hashes", "twice"])

    def suspects(self, key, table: pa.Table, replies: pa.Table) -> pa.Table:
        """Each suspected key of the chunk: in how many documents, and the largest of their ids."""
        keys, row = self.keys(table)
        asked = Distinct.among(hash_words(keys), self.buckets)
        ids = table.column("doc_id").to_pylist()
        docs, last = defaultdict(int), {}
        for i in np.flatnonzero(asked.answered(replies)[asked.of]).tolist() if keys else ():
            digest, own = hashlib.sha256(keys[i]).digest(), ids[row[i]]
            docs[digest] += 1
            if own is not None:
                last[digest] = max(own, last.get(digest, own))
        return pa.table([pa.array([key[0].as_py()] * len(docs), pa.int64()), pa.array(list(docs), pa.binary()), pa.array(list(docs.values()), pa.int64()),
                         pa.array([last.get(d) for d in docs], pa.int64())], names=["chunk", "digest", "docs", "last"])

    def drop(self, key, table: pa.Table, repeats: pa.Table) -> pa.Table:
        keeper = dict(zip(repeats.column("digest").to_pylist(), repeats.column("keeper").to_pylist()))
        out: dict[str, list] = {"doc_id": [], "n_lines": [], "n_dropped": [], "kept_text": []}
        for own, lines in zip(table.column("doc_id").to_pylist(), self.texts(table)):
            kept = [line for line in lines if not self._goes(line, own, keeper)] if keeper else lines
            for name, value in zip(out, (own, len(lines), len(lines) - len(kept), b"\n".join(kept).decode())):
                out[name].append(value)
        return pa.Table.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())]))

    def _goes(self, line: bytes, own: int | None, keeper: dict) -> bool:
        key = self.key(line)
        if key is None:
            return False
        digest = hashlib.sha256(key).digest()
        return digest in keeper and keeper[digest] != own


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Drop lines of ``docs(doc_id, text)`` that at least ``min_docs`` documents
    hold, but for those in the document of largest doc_id that holds them.

    Lines are compared stripped of ASCII white space at both ends and with A-Z
    lower-cased; those under ``min_chars`` code points then always stay.

    Texts lie in chunks.  The space of line hashes is cut into buckets, their
    number from a bound on the lines that the texts can hold, so that a pair of
    Bloom filters of fixed size serves one bucket at any corpus size: no filter
    of the whole corpus has to fit a task or a broadcast.  A chunk asks for its
    distinct hashes, packed by bucket; hashes stream through the bucket's
    once-seen and twice-seen filters, and one bit each comes back.  Only lines
    so suspected are shuffled, as their SHA-256 with the number of documents
    and the largest id, one row a chunk: exact counts over these confirm the
    repeats and choose who keeps them.  A line that a third of all documents
    hold is one entry a chunk.

    Returns one row per input row: doc_id, n_lines (before dropping), n_dropped,
    kept_text (other lines, joined by a line feed).  A null or empty text is one
    empty line; rows are documents of their own also where ids repeat, and rows
    of one id keep a line alike; a row without an id comes before all others, so
    it keeps a repeated line only if no holder has an id.  An empty table gives
    an empty result; extra columns are ignored.
    """
    n = chunk_count(docs)
    most = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    run = _Dedup(min_chars, max(1, math.ceil(most / (min_chars + 1) / FILLED)))
    # dealt by id, text and place, so that equal rows and rows without an id spread
    table = bucketed(docs.select(F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n)).alias("chunk"),
                                 F.col("doc_id").cast("long").alias("doc_id"), packed("text").alias("z")), n)
    by_chunk = table.groupBy("chunk")
    asked = by_chunk.applyInArrow(lambda k, t: run.ask(k, t), _ASK).withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2))))
    asked = asked.select("bucket", "turn", "chunk", "hashes", F.when(F.col("turn") == 1, F.col("twice")).alias("twice"))
    asked = asked.repartition("bucket").sortWithinPartitions("bucket", "turn")
    replies = asked.mapInArrow(lambda batches: _suspected(batches), REPLY)
    suspects = stored(by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(lambda k, t, r: run.suspects(k, t, r), _SUSPECT), "suspects")
    repeats = suspects.groupBy("digest").agg(F.sum("docs").alias("docs"), F.max("last").alias("keeper")).where(F.col("docs") >= min_docs)
    drops = suspects.select("chunk", "digest").join(repeats.select("digest", "keeper"), "digest")
    return by_chunk.cogroup(drops.groupBy("chunk")).applyInArrow(lambda k, t, r: run.drop(k, t, r), RESULT)
