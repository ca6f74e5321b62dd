"""Conversation repair against a search over all edits, on short conversations."""

import hashlib
import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from spire.llm.repair import damaged, repair_conversations

SCHEMA = "conv_id long, turn long, role string, text string, place string, fault string"
BLANK = " \t\n\v\f\r"


def harm(rows):
    """Rows after damage, by conversation."""
    out = {r[0]: [] for r in rows}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if hit == 1:
            text = ""
        if hit == 2:
            text = "".join(x for x in text if x not in ".!?")
        out[c] += [(t, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def least(rows):
    """(cost, audit, repaired lines) by uniform-cost search over (cost, audit)."""
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append("blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else "truncated" if text.strip(BLANK)[-1] not in ".!?" else "")
        seen.add((role, text))

    def good(roles):
        s = "".join(roles)
        s = s[1:] if s.startswith("s") and len(s) > 1 else s
        return s == "ua" * (len(s) // 2)

    def begins(roles):
        return any(good(roles + more) for more in ([], ["a"], ["u", "a"]))

    heap, done = [(0, "", 0, [], [])], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = (i, len(roles) > 0 and roles[-1])
        if i == len(rows) and good(roles):
            return cost, audit, lines, faults
        if (audit, state) in done:
            continue
        done.add((audit, state))
        ways = [(5, "I", 0, name, "") for name in ("user", "assistant")] if audit.count("I") <= len(rows) + 2 else []
        if i < len(rows):
            _, role, text = rows[i]
            ways.append((2, "D", 1, None, None))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                ways.append((more, "K", 1, role, text))
                ways += [(more + 1, "R", 1, name, text) for name in ("user", "assistant")]
        for price, letter, step, role, text in ways:
            now = roles + ([] if role is None else [role[:1] or "?"])
            if role is None or begins(now):
                heapq.heappush(heap, (cost + price, audit + letter, i + step, now, lines + ([] if role is None else [f"{role}:{text}"])))


def brute(rows):
    out = {}
    for c, mine in harm(rows).items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        cost, audit, lines, faults = least(mine)
        kinds, turns = Counter(faults), [r[0] for r in mine if r[0] is not None]
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[c] = (gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def report(fixed):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in fixed.report.collect()}


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def some_rows(n, seed):
    rng = np.random.default_rng(seed)
    texts = ["Yes.", "No!", "Why?", "and then", " ", "", "Yes. \n", "ok", "Ünd so.", None]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "aide"]
    return [(c, int(rng.integers(12)) if rng.random() > 0.05 else None, roles[int(rng.integers(13))], texts[int(rng.integers(10))] if rng.random() < 0.5 else f"text {c} {k}.")
            for c in range(n) for k in range(int(rng.integers(1, 7)))]


def whole(fixed, got):
    """The edits carry out what the report says."""
    rows = defaultdict(list)
    for r in fixed.rows.collect():
        rows[r.conv_id].append((r.place, r.op, r.role, r.text))
    for c, found in got.items():
        mine = sorted(rows[c])
        assert "".join(x[1] for x in mine) == found[6] and [x[0] for x in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{x[2]}:{x[3]}" for x in mine if x[1] != "D").encode()).hexdigest() == found[7]


@pytest.mark.parametrize("block", [1 << 16, 2])
def test_repair_odd(spark, block):
    rows = some_rows(60, 3) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Yes."), (None, 1, "user", "Hi."), (900, None, None, None)]
    rows += [(901, 3, "user", "Same."), (901, 3, "user", "Same."), (901, 3, "user", "Same."), (902, 10**15, "user", "Hm."), (902, 10**15 + 1, "assistant", "x" * 50_000 + ".")]
    fixed = repair_conversations(damaged(made(spark, rows)), block)
    got = report(fixed)
    assert got == brute(rows)
    whole(fixed, got)
    none = repair_conversations(damaged(made(spark, [])))
    assert none.report.count() == 0 and none.rows.count() == 0


def test_dropped_conversation_is_named(spark):
    gone = next(c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = report(repair_conversations(damaged(made(spark, [(gone, 0, "user", "Hi.")]))))
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_giant_conversation(spark):
    """One conversation with most rows: batches, blocks and repeated rows meet in any place."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        rng = np.random.default_rng(9)
        rows = [(1, k // 3, ["user", "assistant", "user", "system"][int(rng.integers(4))], ["Yes.", f"Row {k}.", "cut", ""][int(rng.integers(4))]) for k in range(1500)]
        rows += some_rows(40, 8)
        turns = damaged(made(spark, rows))
        one, many = repair_conversations(turns), repair_conversations(turns, 37)
        got = report(one)
        assert got == report(many)
        whole(many, got)
        small = [r for r in rows if r[0] not in (1,)]
        expected = brute(small)
        assert {c: v for c, v in got.items() if c != 1} == {c: v for c, v in expected.items() if c != 1}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
