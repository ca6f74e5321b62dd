"""Column-level text functions.

All of them are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical output.
SEP = "[SEP]"
SEP_JOIN = " [SEP] "
REWRITE_MARKER = "# Re-written query:"
REWRITE_LABEL = "re-written query"
REWRITE_PROMPT = (
    "# Instruction: I will give you a conversation between a user and a system. "
    "You should rewrite the last question of the user into a self-contained query.  \n"
    "\n"
    "# Context: \n"
    "{ctx}\n"
    "\n"
    "# Please rewrite the following user question: \n"
    "{question}\n"
    "\n"
    "# Re-written query:\n"
)
# a history block is "user: <q>" + a literal backslash-n + "system: <a>"
BLOCK_USER = "user: "
BLOCK_SYSTEM = "\\nsystem: "
CONTEXT_BUDGET = 3000
USER_CUT = 64 * 5
OTHER_CUT = 100 * 5


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_ws(col) -> Column:
    """Trim every kind of blank, Unicode ones too, at both ends (Python ``str.strip``)."""
    return F.regexp_replace(_c(col), r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def clean_text(col) -> Column:
    """tab, newline and carriage return become spaces, then trim."""
    return strip_ws(F.regexp_replace(_c(col), r"[\t\n\r]", " "))


def truncate_words(col, limit: int, cut: int) -> Column:
    """if longer than ``limit`` chars keep the first ``cut`` chars and drop
    the trailing partial word (everything after the last space)."""
    c = _c(col)
    head = F.substring(c, 1, cut)
    dropped = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(c) > limit, dropped).otherwise(c)


def truncate_by_role(arr, user_cut: int = USER_CUT, other_cut: int = OTHER_CUT) -> Column:
    """even positions (user) cut at ``user_cut`` chars, odd at ``other_cut``."""
    return F.transform(
        _c(arr),
        lambda x, i: strip_ws(F.when(i % 2 == 0, F.substring(x, 1, user_cut))
                              .otherwise(F.substring(x, 1, other_cut))))


def split_sep(col) -> Column:
    return F.split(_c(col), r"\[SEP\]")


def last_segment(col) -> Column:
    """text after the last ``[SEP]``, trimmed."""
    return strip_ws(F.element_at(split_sep(col), -1))


def reverse_history(col) -> Column:
    """split on ``[SEP]``, trim, reverse, join with `` [SEP] ``."""
    return F.array_join(F.reverse(F.transform(split_sep(col), strip_ws)), SEP_JOIN)


def conversation_length(col) -> Column:
    """number of previous (question, answer) pairs: floor(#SEP / 2)."""
    return F.floor((F.size(split_sep(col)) - 1) / 2).cast("int")


def conv_of(col) -> Column:
    """F8: conversation part of a ``conv_turn`` id."""
    return F.substring_index(_c(col).cast("string"), "_", 1)


def turn_id(conv, turn) -> Column:
    """F8: ``conv_turn`` id."""
    return F.concat_ws("_", _c(conv).cast("string"), _c(turn).cast("string"))


# The reference's dataset-name rules, in its order.  A rule
# fires when the path contains every listed substring (case-sensitive).
DATASET_RULES = [
    (("TREC_DL_2019",), "TREC_DL_2019"),
    (("trec2020",), "TREC_DL_2020"),
    (("TREC_DL_2020",), "TREC_DL_2020"),
    (("msmarco", "train_queries"), "MSMARCO_TRAIN"),
    (("msmarco",), "MSMARCO"),
    (("MSMarco-v2", "dev_1"), "MSMARCO_v2_dev1"),
    (("MSMarco-v2", "dev_2"), "MSMARCO_v2_dev2"),
    (("toy",), "TOY"),
    (("topiocqa",), "TOPIOCQA"),
    (("ikat24",), "ikat24"),
    (("ikat",), "ikat"),
    (("cast22",), "cast22"),
    (("cast20",), "cast20"),
    (("ultrachat",), "ultrachat"),
    (("qrecc",), "QRECC"),
]
DATASET_DEFAULT = "other_dataset"


def dataset_label(col, rules=DATASET_RULES, default: str | None = DATASET_DEFAULT) -> Column:
    """label of the first rule whose substrings all occur in the path."""
    out = None
    for needles, label in rules:
        needles = (needles,) if isinstance(needles, str) else needles
        cond = None
        for n in needles:
            c = F.instr(_c(col), n) > 0
            cond = c if cond is None else cond & c
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    fallback = F.lit(default)
    return out.otherwise(fallback) if out is not None else fallback


def history_block(q, a) -> Column:
    """One prompt block of F10."""
    return F.concat(F.lit(BLOCK_USER), _c(q), F.lit(BLOCK_SYSTEM), _c(a))


def fill_prompt(ctx, question) -> Column:
    """F10 template filling."""
    head, rest = REWRITE_PROMPT.split("{ctx}")
    mid, tail = rest.split("{question}")
    return F.concat(F.lit(head), _c(ctx), F.lit(mid), _c(question), F.lit(tail))


def extract_rewrite(col) -> Column:
    """text after the last marker, its first non-empty line, an optional
    ``re-written query...:`` label removed, then matching quotes removed."""
    t = strip_ws(_c(col))
    after = F.when(F.instr(t, REWRITE_MARKER) > 0,
                   strip_ws(F.substring_index(t, REWRITE_MARKER, -1))).otherwise(t)
    lines = F.filter(F.transform(F.split(after, "\n"), strip_ws), lambda x: x != "")
    first = F.when(F.size(lines) > 0, F.element_at(lines, 1)).otherwise(F.lit(""))
    has_label = F.lower(first).startswith(REWRITE_LABEL) & (F.instr(first, ":") > 0)
    unlabelled = F.when(has_label, strip_ws(F.regexp_extract(first, r"(?s)^[^:]*:(.*)$", 1))).otherwise(first)
    quoted = ((unlabelled.startswith('"') & unlabelled.endswith('"')) |
              (unlabelled.startswith("'") & unlabelled.endswith("'")))
    # python s[1:-1]: a lone quote character gives ''
    return F.when(quoted, strip_ws(F.regexp_extract(unlabelled, r"(?s)^.(.*).$", 1))).otherwise(unlabelled)


def needs_retry(col) -> Column:
    """empty or fewer than three whitespace-separated words."""
    words = F.filter(F.split(strip_ws(_c(col)), r"\s+"), lambda x: x != "")
    return (strip_ws(_c(col)) == "") | (F.size(words) < 3)


def word_count(col) -> Column:
    return F.size(F.filter(F.split(strip_ws(_c(col)), r"\s+"), lambda x: x != ""))


def name_flags(name, checkpoint) -> Column:
    """F16: checkpoint doubled if the run name has ``_0``, doubled again if
    it has ``standard``."""
    n = _c(name)
    c = _c(checkpoint)
    c = F.when(F.instr(n, "_0") > 0, c * 2).otherwise(c)
    return F.when(F.instr(n, "standard") > 0, c * 2).otherwise(c)
