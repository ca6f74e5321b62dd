"""Substring dedup with difference-cover anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import MESSAGE, Distinct, Words, chunked, seen_elsewhere, seen_smaller
from .common import stored

#: difference covers: every residue modulo the period is a difference of two members
COVERS = {3: (0, 1), 5: (0, 1, 2), 7: (0, 1, 3), 13: (0, 1, 3, 9)}

RESULT = "doc_id long, n_words long, n_removed long, kept_text string"


class _Cover:
    """The passes over one chunk; each derives what the earlier ones did."""

    def __init__(self, window: int, period: int, buckets: int):
        self.window, self.period, self.buckets = window, period, buckets
        self.width = window - period + 1

    def anchors(self, words: Words) -> tuple[np.ndarray, Distinct]:
        on = np.isin(words.at % self.period, COVERS[self.period])
        places, hashes = words.runs(self.width, on)
        return places, Distinct.among(hashes, self.buckets)

    def windows(self, words: Words, replies: pa.Table) -> tuple[np.ndarray, Distinct]:
        """The windows around anchors that some other document shares."""
        places, found = self.anchors(words)
        shared = found.answered(replies)
        rank = words.keys[words.text[places]]
        shared |= rank[found.first] != rank[found.last]
        hit = np.zeros(len(words.at) + self.period, np.int64)
        hit[places[shared[found.of]]] = 1
        upto = np.concatenate(([0], np.cumsum(hit)))
        near = upto[self.period:self.period + len(words.at)] > upto[:len(words.at)]
        places, hashes = words.runs(self.window, near)
        return places, Distinct.among(hashes, self.buckets)

    def send_anchors(self, key, table):
        return self.anchors(Words.of(table))[1].messages(key[0].as_py())

    def send_windows(self, key, table, replies):
        words = Words.of(table)
        places, found = self.windows(words, replies)
        return found.messages(key[0].as_py(), words.keys[words.text[places[found.first]]])

    def remove(self, key, table, replies):
        words = Words.of(table)
        turn = np.array(replies.column("turn").to_pylist(), np.int64)
        places, found = self.windows(words, replies.filter(pa.array(turn == 1)))
        earlier = found.answered(replies.filter(pa.array(turn == 2)))
        own = words.keys[words.text[places]]
        gone = earlier[found.of] | (own > own[found.first][found.of])
        edge = np.zeros(len(words.at) + 1, np.int64)
        np.add.at(edge, places[gone], 1)
        np.add.at(edge, places[gone] + self.window, -1)
        keep = np.cumsum(edge)[:-1] == 0
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_text": []}
        start = 0
        no_id = table.column("no_id").to_numpy(zero_copy_only=False)[words.order]
        for k, none, text in zip(words.keys.tolist(), no_id.tolist(), words.texts):
            mine = keep[start:start + len(text)]
            start += len(text)
            kept = text if mine.all() else [text[i] for i in np.flatnonzero(mine)]
            out["doc_id"].append(None if none else k)
            out["n_words"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["kept_text"].append(b" ".join(kept).decode())
        return pa.Table.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())]))


def remove_repeats(docs: DataFrame, window: int = 13, period: int = 7) -> DataFrame:
    """Remove every word of ``docs(doc_id, text)`` that is covered by a window
    of ``window`` consecutive words which also starts in a document of smaller
    doc_id; windows are judged on the input.

    Runs of window - period + 1 words are hashed only where the place in the
    text, modulo ``period``, lies in a difference cover (3 of 7 places).  Two
    equal windows share a run at the same offset that both documents hash; so
    only windows around a run that another document has too are looked at
    again, whole, by a 64-bit hash of their words, for the smallest doc_id
    that has them.

    Returns one row per input row: doc_id, n_words, n_removed, kept_text (kept
    words joined by one space).  Words are runs of other than ASCII white
    space, unchanged.  A null or empty text has no words; a null id orders
    after all others; rows of equal id remove nothing from each other; texts
    under ``window`` words stay whole; an empty table gives an empty result.
    Extra columns are ignored.
    """
    table, n = chunked(docs.select("doc_id", "text"))
    run = _Cover(window, period, max(1, n // 2))
    anchors = table.groupBy("chunk").applyInArrow(lambda k, t: run.send_anchors(k, t), MESSAGE)
    shared = stored(seen_elsewhere(anchors), "anchors")
    windows = table.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(lambda k, t, r: run.send_windows(k, t, r), MESSAGE)
    earlier = stored(seen_smaller(windows), "windows")
    replies = shared.withColumn("turn", F.lit(1)).unionByName(earlier.withColumn("turn", F.lit(2)))
    return table.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(lambda k, t, r: run.remove(k, t, r), RESULT)
