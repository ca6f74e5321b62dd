"""Conversational query building (W4-W7, F2-F7, F10-F12, X17 pieces).

A conversation is ``turns(conv_id, turn, role, text)``.  Every operator is
a window partitioned by conversation and ordered by turn; history arrays
are built with ``collect_list`` over a running frame.  The output of a
history operator is inherently quadratic in the conversation length (turn
n repeats turns 1..n-1), exactly as in the reference; ``max_turns`` bounds
the frame when a caller wants that, and is off by default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: roles that speak; a system row sets the scene and is no part of a history
SPEAKERS = ("user", "assistant")


def utterances(turns: DataFrame) -> DataFrame:
    """The turns that speak, with the scene their conversation was given
    (the first system text, null without one) in ``scene``."""
    scene = F.min(F.when(F.col("role") == "system", F.struct("turn", "text"))).over(Window.partitionBy("conv_id"))
    return turns.withColumn("scene", scene["text"]).where(F.col("role").isin(*SPEAKERS))


def _frame(conv: str, order: str, upto: int, max_turns: int | None):
    lo = Window.unboundedPreceding if max_turns is None else -max_turns
    return Window.partitionBy(conv).orderBy(order).rowsBetween(lo, upto)


def history(turns: DataFrame, conv: str = "conv_id", order: str = "turn", text: str = "text",
            newest_first: bool = True, max_turns: int | None = None, out: str = "history") -> DataFrame:
    """Every previous turn plus the current one joined with `` [SEP] ``,
    newest first (or oldest first)."""
    lst = F.collect_list(text).over(_frame(conv, order, 0, max_turns))
    arr = F.reverse(lst) if newest_first else lst
    return turns.withColumn(out, F.array_join(arr, T.SEP_JOIN))


def cast_history(turns: DataFrame, limit_cut: tuple[int, int] = (T.USER_CUT, T.OTHER_CUT),
                 answer_limit_cut: tuple[int, int] = (T.OTHER_CUT, T.USER_CUT),
                 consistent: bool = False) -> DataFrame:
    """X17 (CAsT recipe): utterances and answers word-truncated (F2), then
    W4 newest first over user rows and the answers between them.

    The reference tests utterances against 320 chars but cuts at 500, and
    answers against 500 but cuts at 320; that preset is the default,
    ``consistent=True`` tests and cuts at the same length."""
    u_lim, u_cut = limit_cut
    a_lim, a_cut = answer_limit_cut
    if consistent:
        u_cut, a_cut = u_lim, a_lim
    t = turns.withColumn("text", F.when(F.col("role") == "user", T.truncate_words("text", u_lim, u_cut))
                         .otherwise(T.truncate_words("text", a_lim, a_cut)))
    return history(t).where(F.col("role") == "user")


def answers_by_turn(turns: DataFrame) -> DataFrame:
    """User rows with the text of the assistant row that follows them
    ('' if none): pairs are made by turn number, never by position."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt_role = F.lead("role").over(w)
    nxt = F.lead("text").over(w)
    return turns.withColumn("answer", F.when(nxt_role == "assistant", nxt).otherwise(F.lit(""))) \
        .where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def rewrite_prompts(turns: DataFrame, budget: int = T.CONTEXT_BUDGET,
                    max_turns: int | None = None) -> DataFrame:
    """F10 + W7: per user turn, previous (question, answer) pairs newest
    first as ``user: q\\nsystem: a`` blocks, kept while the running length
    (+1 per newline join) fits ``budget`` — lengths are positive, so the
    kept blocks are a prefix and the filter equals the reference's early
    stop — then the template is filled with the current question."""
    qa = answers_by_turn(turns)
    usable = (F.col("question") != "") & (F.col("answer") != "")
    # a block has a character on both sides at least, so only so many fit; the
    # frame holds that many usable pairs, however many empty ones lie between
    most = budget // (len(T.BLOCK_USER) + len(T.BLOCK_SYSTEM) + 2) + 1
    ordered = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    qa = qa.withColumn("_k", F.coalesce(F.sum(usable.cast("int")).over(ordered), F.lit(0)))
    near = Window.partitionBy("conv_id").orderBy("_k").rangeBetween(-most, 0)
    if max_turns is not None:
        near = _frame("conv_id", "turn", -1, max_turns)
    pair = F.when(usable, F.struct(F.col("turn").alias("t"), F.col("question").alias("q"), F.col("answer").alias("a")))
    qa = qa.withColumn("_pairs", F.sort_array(F.collect_list(pair).over(near), asc=False))
    blocks = F.transform(F.filter("_pairs", lambda p: p["t"] < F.col("turn")), lambda p: T.history_block(p["q"], p["a"]))

    def take(state, b):
        room = state["used"] + F.length(b) + F.size(state["kept"])
        return F.when(state["open"] & (room <= budget), F.struct(
            (state["used"] + F.length(b)).alias("used"), F.concat(state["kept"], F.array(b)).alias("kept"), F.lit(True).alias("open"))
        ).otherwise(F.struct(state["used"].alias("used"), state["kept"].alias("kept"), F.lit(False).alias("open")))

    empty = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("open"))
    kept = F.aggregate(blocks, empty, take)["kept"]
    return qa.withColumn("blocks", kept).select(
        "conv_id", "turn", "question",
        F.size("blocks").alias("n_blocks"),
        T.fill_prompt(F.array_join("blocks", "\n"), F.col("question")).alias("prompt"))


def qrecc_query(turns: DataFrame, rewrite: str | None = None) -> DataFrame:
    """F6 (QReCC recipe): context = every previous row truncated by role
    (F3), newest first, joined with `` [SEP] ``; the question (the truth
    rewrite on the first turn when ``rewrite`` is given) is cut to 320
    chars and put in front."""
    w = _frame("conv_id", "turn", -1, None)
    ctx = F.reverse(T.truncate_by_role(F.collect_list("text").over(w)))
    first_turn = F.min("turn").over(Window.partitionBy("conv_id"))
    q = F.col("text") if rewrite is None else F.when(F.col("turn") == first_turn, F.col(rewrite)) \
        .otherwise(F.col("text"))
    q = T.strip_ws(F.substring(F.regexp_replace(q, "\n", " "), 1, T.USER_CUT))
    ctx_s = T.strip_ws(F.regexp_replace(F.array_join(ctx, T.SEP_JOIN), "\n", " "))
    t = turns.withColumn("_ctx", ctx).withColumn("_q", q).withColumn("_cs", ctx_s)
    return t.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("_q").alias("question"),
        F.when(F.size("_ctx") > 0, F.concat(F.col("_q"), F.lit(T.SEP_JOIN), F.col("_cs")))
        .otherwise(F.col("_q")).alias("query"))


def mine_answers(histories: DataFrame, conv: str = "conv_id", order: str = "turn",
                 text: str = "history") -> DataFrame:
    """A row's answer is the 2nd ``[SEP]`` segment of the next row's
    history when that has at least 3 segments, else ''."""
    w = Window.partitionBy(conv).orderBy(order)
    parts = T.split_sep(F.lead(text).over(w))
    ans = F.when(F.size(parts) >= 3, T.strip_ws(F.element_at(parts, 2))).otherwise(F.lit(""))
    return histories.withColumn("answer", F.coalesce(ans, F.lit("")))


def rewritten_history(rows: DataFrame, conv: str = "conv_id", order: str = "turn",
                      text: str = "text", answer: str = "answer",
                      max_turns: int | None = None) -> DataFrame:
    """Current rewrite, then for every previous turn newest first its
    answer (only if non-empty) and its rewrite, joined with `` [SEP] ``."""
    w = _frame(conv, order, -1, max_turns)
    prior = F.collect_list(F.struct(T.strip_ws(text).alias("q"), T.strip_ws(answer).alias("a"))).over(w)
    chain = F.flatten(F.transform(F.reverse(prior), lambda p: F.when(
        p["a"] != "", F.array(p["a"], p["q"])).otherwise(F.array(p["q"]))))
    return rows.withColumn("history", F.array_join(F.concat(F.array(T.strip_ws(text)), chain), T.SEP_JOIN))


def last_and_reversed(df: DataFrame, text: str = "history") -> DataFrame:
    """F4 + F5 on an oldest-first history string."""
    return df.withColumn("last", T.last_segment(text)).withColumn("reversed", T.reverse_history(text))


def extract_and_check(df: DataFrame, text: str = "generated") -> DataFrame:
    """F11 + F12: the rewrite and whether it needs a retry."""
    return df.withColumn("rewrite", T.extract_rewrite(text)) \
        .withColumn("needs_retry", T.needs_retry(F.col("rewrite")))


def length_column(text: str = "history") -> Column:
    return T.conversation_length(text)
