"""Line dedup against a plain count of lines."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from spire.llm import lines
from spire.llm.lines import SeenTwice, drop_repeated_lines
from tests.llm.test_llm import SCHEMA, odd_rows

BLANK = " \t\n\v\f\r"


def key_of(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_chars=40, min_docs=5):
    held, last = defaultdict(int), {}
    for d, t in rows:
        for k in {key_of(x) for x in (t or "").split("\n")}:
            held[k] += 1
            if d is not None:
                last[k] = max(d, last.get(k, d))
    out = Counter()
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not (len(key_of(x)) >= min_chars and held[key_of(x)] >= min_docs and last.get(key_of(x)) != d)]
        out[d, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)] += 1
    return out


def got(df):
    return Counter(tuple(r) for r in df.collect())


def test_lines_odd(spark):
    long = "The quick brown fox jumps over the lazy dog, twice"
    rows = odd_rows() + [(20 + i, f" \t{long.upper() if i % 2 else long}\v\n\nown line of {i}\r\n{long}", "en", "a", 1, "x", "y", "z", "n") for i in range(5)]
    rows += [(None, long, "en", "a", 1, "x", "y", "z", "n"), (24, long, None, None, None, None, None, None, None), (30, "é" * 39 + "\n" + "é" * 40, "fr", "a", 1, "x", "y", "z", "n")]
    rows += [(40 + i, "é" * 39 + "\n" + "é" * 40 + "\n\n", "fr", "a", 1, "x", "y", "z", "n") for i in range(6)]
    rows += [(None, "only without ids " * 4, None, None, None, None, None, None, None)] * 6
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(drop_repeated_lines(docs)) == brute([r[:2] for r in rows])
    assert got(drop_repeated_lines(docs, 3, 2)) == brute([r[:2] for r in rows], 3, 2)
    assert drop_repeated_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("filled", [1 << 20, 300])
def test_lines_over_chunks(spark, monkeypatch, filled):
    """Many chunks and buckets; a third of all rows hold one line, another third one id."""
    monkeypatch.setattr(lines, "FILLED", filled)
    monkeypatch.setattr(lines, "chunk_count", lambda docs: 9)
    rng = np.random.default_rng(4)
    pool = [f"line number {i} of the pool, long enough to be compared" for i in range(150)]
    hot = "a line that a third of all documents hold, with some words"
    rows = []
    for i in range(360):
        mine = [pool[int(k)] for k in rng.integers(0, 150, int(rng.integers(0, 6)))] + [f"a line that only document {i} holds, of forty characters"]
        rows.append((int(rng.integers(10**6)) if i % 3 else 77, "\n".join(mine + [hot] * (i % 3 == 1))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert got(drop_repeated_lines(docs)) == brute(rows)


def test_equal_rows_spread(spark):
    text = "\n".join(f"the same text comes with the same id, line {i}" for i in range(50))
    rows = [(1, text)] * 300 + [(2, text)]
    assert got(drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_filters_miss_nothing():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 50_000, dtype=np.int64).astype(np.uint64)
    f = SeenTwice(1 << 20)
    none = np.zeros(10_000, bool)
    for i in range(0, 50_000, 10_000):
        f.add(hashes[i:i + 10_000], none)
    assert f.suspects(hashes).mean() < 0.01
    f.add(hashes[::5], np.zeros(10_000, bool))
    assert f.suspects(hashes[::5]).all()
    flagged = rng.integers(0, 2**63, 100, dtype=np.int64).astype(np.uint64)
    f.add(flagged, np.ones(100, bool))
    assert f.suspects(flagged).all()
