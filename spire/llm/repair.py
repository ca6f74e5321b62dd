"""Conversation structure repair: cheapest edits by a scan that never holds a conversation."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

#: costs of the edits; a truncated row that stays costs TRUNCATED more
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: edits in the order of their letters, two bits each
LETTERS = b"DIKR"
D, I, K, R = range(4)
#: states: nothing yet, after the system row, after a user row, after an assistant row
NEXT = (2, 2, 3, 2)
NAMES = ("", "system", "user", "assistant")
KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: what is left to pay after the last row; it can end in states 0 and 3
END = (0, 2 * INSERT, INSERT, 0)
LEGAL = {"su", "ua", "au"}
#: rows whose choices make one block of backpointers
BLOCK = 1 << 16
ABSENT, FINE, BLANK, DUPLICATE, CUT = -1, 0, 1, 2, 3

_NON_BLANK = r"[^\x20\x09-\x0D]"
_ENDED = r"[.!?][\x20\x09-\x0D]*\z"
_BLOCKS = "conv string, turn string, role string, digest binary, later int, seq long, pointers binary, totals array<long>"
TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def damaged(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` with faults put in, by
    crc32(``conv_id:turn``) mod 20: 0 drops the row (``present`` is false), 1
    empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it the user's.
    Nulls in the key, the role and the text are one blank."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    text = F.coalesce("text", F.lit(" "))
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault")).select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") != 0).alias("present"), F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


@lru_cache(maxsize=1 << 14)
def _choices(initial: str, fault: int, ahead: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """One row more in front: cost to the end from each state, and the edit
    whose letter comes first among the cheapest, two bits a state."""
    stay = TRUNCATED if fault == CUT else 0
    ways = []
    for state in range(4):
        way = {D: DELETE + ahead[state]}
        if fault in (FINE, CUT):
            way[R] = stay + REROLE + ahead[NEXT[state]]
            if (state, initial) in KEPT:
                way[K] = stay + ahead[KEPT[state, initial]]
        ways.append(way)
    cost = [min(w.values()) for w in ways]
    for _ in range(2):  # an insertion leads to another state before the same row
        cost = [min(c, INSERT + cost[NEXT[s]]) for s, c in enumerate(cost)]
    pointer = 0
    for state, way in enumerate(ways):
        way[I] = INSERT + cost[NEXT[state]]
        pointer |= min(op for op, c in way.items() if c == cost[state]) << 2 * state
    return tuple(cost), pointer


class _Backward:
    """Rows of one conversation from the last to the first: counts, costs to
    the end, and the choices of at most ``BLOCK`` rows."""

    def __init__(self, conv):
        self.conv, self.ahead, self.paid = conv, END, 0
        self.pointers, self.block = bytearray(), 0
        self.first = (None, "", b"", 0)
        self.faults = [0, 0, 0, 0]
        self.illegal = self.turns = 0
        self.later = self.last = self.low = None

    def add(self, turn, role, digest, later, fault) -> None:
        if fault == ABSENT:
            return
        cost, pointer = _choices(role[:1], fault, self.ahead)
        least = min(cost)
        self.paid += least  # costs ahead are kept above their least, so they repeat
        self.ahead = tuple(c - least for c in cost)
        self.pointers.append(pointer)
        self.faults[fault] += 1
        self.illegal += self.later is not None and role[:1] + self.later not in LEGAL
        self.later = role[:1]
        if turn is not None:
            self.turns += turn != self.low
            self.low = turn
            self.last = turn if self.last is None else self.last
        self.first = (turn, role, digest, later)

    def cut(self, end: bool) -> tuple:
        """The block of the rows since the last cut, first row first; the last
        block of a conversation, which begins it, has its totals."""
        totals = None
        if end:
            gaps = 0 if self.low is None else int(self.last) - int(self.low) + 1 - self.turns
            totals = [gaps, *self.faults[1:], self.illegal, self.paid + self.ahead[0]]
        row = (self.conv, *self.first, -1 - self.block, bytes(reversed(self.pointers)), totals)
        self.pointers.clear()
        self.block += 1
        return row


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}, dtype=object)


def _scan_back(batches: Iterable[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _BLOCKS.split(", ")]
    at: _Backward | None = None
    for batch in batches:
        out = []
        for conv, turn, role, digest, later, fault in batch[["conv", "turn", "role", "digest", "later", "fault"]].itertuples(index=False, name=None):
            if at is None or conv != at.conv:
                if at is not None:
                    out.append(at.cut(True))
                at = _Backward(conv)
            at.add(turn, role, digest, later, fault)
            if len(at.pointers) == block:
                out.append(at.cut(False))
        yield _frame(out, names)
    if at is not None:
        yield _frame([at.cut(True)], names)


class _Forward:
    """The edits of one conversation, from the first row on."""

    def __init__(self, conv, rows: bool):
        self.conv, self.state, self.totals = conv, 0, None
        self.blocks: deque[bytes] = deque()
        self.used = 0  # of the first block
        self.place = 0
        self.audit, self.hash, self.any = bytearray(), hashlib.sha256(), False
        self.rows: list[tuple] | None = [] if rows else None

    def block(self, pointers: bytes, totals) -> None:
        self.blocks.append(pointers)
        if totals is not None:
            self.totals = totals

    def _edit(self, op: int, turn, role: str, text: str) -> None:
        if self.rows is not None:
            self.rows.append((self.conv, self.place, chr(LETTERS[op]), turn, role, text))
            self.place += 1
            return
        self.audit.append(LETTERS[op])
        if op != D:
            self.hash.update((("\n" if self.any else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.any = True

    def _insert(self) -> None:
        self.state = NEXT[self.state]
        self._edit(I, None, NAMES[self.state], "")

    def row(self, turn, role: str, text: str) -> None:
        while self.used == len(self.blocks[0]):
            self.blocks.popleft()
            self.used = 0
        pointer = self.blocks[0][self.used]
        self.used += 1
        while (op := pointer >> 2 * self.state & 3) == I:
            self._insert()
        if op == D:
            self._edit(D, turn, role, text)
            return
        self.state = KEPT[self.state, role[:1]] if op == K else NEXT[self.state]
        self._edit(op, turn, role if op == K else NAMES[self.state], text)

    def end(self) -> None:
        while END[self.state]:
            self._insert()

    def report(self) -> tuple:
        return (self.conv, *[int(x) for x in self.totals], self.audit.decode(), self.hash.hexdigest())


def _scan_on(batches: Iterable[pd.DataFrame], names: list[str], rows: bool) -> Iterator[pd.DataFrame]:
    at: _Forward | None = None
    out: list[tuple] = []

    def done():
        if at is not None:
            at.end()
            out.extend(at.rows if rows else [at.report()])

    for batch in batches:
        for conv, turn, role, seq, pointers, totals, text in batch[["conv", "turn", "role", "seq", "pointers", "totals", "text"]].itertuples(index=False, name=None):
            if at is None or conv != at.conv:
                done()
                at = _Forward(conv, rows)
            if seq < 0:
                at.block(pointers, totals)
            else:
                at.row(turn, role, text)
        if rows and at is not None:
            out.extend(at.rows)
            at.rows = []
        yield _frame(out, names)
        out = []
    done()
    yield _frame(out, names)


@dataclass
class Repaired:
    """``report``: one row per conversation; ``rows``: one row per edit."""

    report: DataFrame
    rows: DataFrame


def repair_conversations(turns: DataFrame, block: int = BLOCK) -> Repaired:
    """Cheapest edits that give each conversation the roles ``(s?(ua)+)?``.

    ``turns(conv_id, turn, role, text[, present])``: a row that is not present
    only names its conversation.  Rows go by turn (nulls first), then role, then
    the SHA-256 of their text.  The first of these faults counts: blank (no
    character but ASCII white space), duplicate (role and text seen earlier in
    the conversation), truncated (does not end in ``.!?``).  Edits: K(eep), cost
    0; R(erole) to user or assistant, 1; D(elete), 2, the only one for blank and
    duplicate rows; I(nsert) an empty user or assistant row, 5; a truncated row
    that stays costs 5 more.  Of the cheapest edits those whose letters come
    first are taken.  A role counts by its first letter; one that is neither s,
    u nor a, or an empty role, can't be kept.

    The scan carries the cost to the end from each of four states, so rows are
    read from the last to the first, sorted inside partitions by conversation,
    and a batch continues where the one before ended.  Choices are one byte a
    row; every ``block`` rows they are written out as a row of a stored table,
    so that no task holds a conversation, however long.  A second pass reads
    rows and blocks from the first to the last, sorted together, each block
    just before its rows, and carries out the edits.  Duplicates are found
    beforehand, by (conversation, role, text).  A conversation still streams
    through one task a pass: the hash of its repaired text is a chain.

    ``report``: conv_id, gaps (greatest - least turn + 1 - distinct turns,
    nulls aside), blank, duplicate, truncated, illegal (adjacent initials other
    than su, ua, au), cost, audit, repaired_sha256 (kept and inserted rows as
    ``role:text``, joined by a line feed).  ``rows``: conv_id, place, op, turn
    (null: inserted), role, text, deleted rows included.  Null ids are one
    conversation, null roles and texts one blank; a conversation without rows
    has zeros, an empty audit and the hash of nothing; empty tables give empty
    results; other columns are ignored.
    """
    present = F.col("present") if "present" in turns.columns else F.lit(True)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                        present.alias("present")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "digest").orderBy(F.col("turn").asc_nulls_first())) > 1
    fault = (F.when(~F.col("present"), ABSENT).when(~F.col("text").rlike(_NON_BLANK), BLANK).when(earlier, DUPLICATE)
             .when(~F.col("text").rlike(_ENDED), CUT).otherwise(FINE))
    marked = stored(rows.withColumn("fault", fault).select("conv_id", "turn", "role", "digest", "fault", "text", (F.col("fault") == DUPLICATE).cast("int").alias("later")), "turns")
    order = ["turn", "role", "digest", "later"]
    by = F.col("conv_id").cast("string").alias("conv")
    back = (marked.select(by, *order, "fault").repartition("conv")
            .sortWithinPartitions("conv", F.col("turn").desc_nulls_last(), *[F.col(c).desc() for c in order[1:]])
            .withColumn("turn", F.col("turn").cast("string")))
    blocks = stored(back.mapInPandas(lambda batches: _scan_back(batches, block), _BLOCKS), "blocks")
    lines = marked.where(F.col("fault") != ABSENT).select(by, *order, F.lit(0).cast("long").alias("seq"), F.lit(None).cast("binary").alias("pointers"),
                                                          F.lit(None).cast("array<long>").alias("totals"), "text")
    both = blocks.withColumn("turn", F.col("turn").cast("long")).withColumn("text", F.lit(None).cast("string")).unionByName(lines)
    on = (both.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), *order[1:], "seq")
          .withColumn("turn", F.col("turn").cast("string")))
    kind = turns.schema["conv_id"].dataType
    heads, edits = ["conv", *TOTALS, "audit", "repaired_sha256"], ["conv", "place", "op", "turn", "role", "text"]
    report = on.mapInPandas(lambda batches: _scan_on(batches, heads, False), "conv string, " + ", ".join(f"{t} long" for t in TOTALS) + ", audit string, repaired_sha256 string")
    edited = on.mapInPandas(lambda batches: _scan_on(batches, edits, True), "conv string, place long, op string, turn string, role string, text string")
    conv = F.col("conv").cast(kind).alias("conv_id")
    return Repaired(report.select(conv, *heads[1:]), edited.select(conv, "place", "op", F.col("turn").cast("long").alias("turn"), "role", "text"))
