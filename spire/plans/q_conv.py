"""Registered queries: conversational query building over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conv as C
from . import fixtures as fx
from .registry import ORACLE, TURNS_CTE, register


def tw(x: str) -> str:
    """DuckDB spelling of the Python ``strip`` used on both sides."""
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def trunc_words_sql(x: str, limit: int, cut: int) -> str:
    head = f"substr({x}, 1, {cut})"
    return (f"CASE WHEN length({x}) > {limit} THEN (CASE WHEN strpos({head}, ' ') > 0 "
            f"THEN regexp_replace({head}, ' [^ ]*$', '') ELSE {head} END) ELSE {x} END")


_FRAME = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_PRIOR = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@register("history_queries", f"""WITH {TURNS_CTE},
t AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN {trunc_words_sql('text', 320, 500)}
                                  ELSE {trunc_words_sql('text', 500, 320)} END AS text FROM turns),
h AS (SELECT conv_id, turn, role, array_to_string(list_reverse(list(text) {_FRAME}), ' [SEP] ') AS history FROM t)
SELECT conv_id, turn, history FROM h WHERE role = 'user'""")
def history_queries(spark, sf):
    """W4 + F2 (CAsT recipe): newest-first history of every user turn."""
    return C.cast_history(C.utterances(fx.turns(spark, sf))).select("conv_id", "turn", "history")


@register("last_utterance", f"""WITH {TURNS_CTE},
h AS (SELECT conv_id, turn, role, array_to_string(list(text) {_FRAME}, ' [SEP] ') AS history FROM turns)
SELECT conv_id, turn, {tw("string_split(history, '[SEP]')[-1]")} AS last,
       array_to_string(list_reverse(list_transform(string_split(history, '[SEP]'), lambda x: {tw('x')})), ' [SEP] ')
         AS reversed
FROM h WHERE role = 'user'""")
def last_utterance(spark, sf):
    """F4 + F5: from an oldest-first history, the current utterance (last
    segment) and the newest-first history with trimmed segments."""
    h = C.history(C.utterances(fx.turns(spark, sf)), newest_first=False).where(F.col("role") == "user")
    return C.last_and_reversed(h).select("conv_id", "turn", "last", "reversed")


@register("truncate_by_role", f"""WITH {TURNS_CTE},
c AS (SELECT conv_id, turn, role, text, list(text) {_PRIOR} AS ctx FROM turns),
d AS (SELECT conv_id, turn, role,
        {tw("replace(substr(text, 1, 320), chr(10), ' ')")} AS question,
        list_reverse(list_transform(coalesce(ctx, []), lambda x, i:
            {tw("CASE WHEN (i - 1) % 2 = 0 THEN substr(x, 1, 320) ELSE substr(x, 1, 500) END")})) AS tctx
      FROM c)
SELECT conv_id, turn, question,
       CASE WHEN len(tctx) > 0
            THEN question || ' [SEP] ' || {tw("replace(array_to_string(tctx, ' [SEP] '), chr(10), ' ')")}
            ELSE question END AS query
FROM d WHERE role = 'user'""")
def truncate_by_role(spark, sf):
    """F3 + F6 (QReCC recipe): context turns cut at 320 (user positions)
    or 500 chars, newest first, behind the 320-char question."""
    return C.qrecc_query(C.utterances(fx.turns(spark, sf)))


@register("conversation_length", f"""WITH {TURNS_CTE},
h AS (SELECT conv_id, turn, role, array_to_string(list_reverse(list(text) {_FRAME}), ' [SEP] ') AS history
      FROM turns)
SELECT conv_id, turn, CAST(floor((len(string_split(history, '[SEP]')) - 1) / 2) AS INTEGER) AS length
FROM h WHERE role = 'user'""")
def conversation_length(spark, sf):
    """number of previous (question, answer) pairs of every user turn."""
    h = C.history(C.utterances(fx.turns(spark, sf))).where(F.col("role") == "user")
    return h.select("conv_id", "turn", T.conversation_length("history").alias("length"))


_MINE = f"""{TURNS_CTE},
h AS (SELECT conv_id, turn, role, array_to_string(list_reverse(list(text) {_FRAME}), ' [SEP] ') AS history
      FROM turns),
u AS (SELECT conv_id, turn, history FROM h WHERE role = 'user'),
m AS (SELECT conv_id, turn, history,
        lead(history) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM u),
a AS (SELECT conv_id, turn, history,
        coalesce(CASE WHEN len(string_split(nxt, '[SEP]')) >= 3 THEN {tw("string_split(nxt, '[SEP]')[2]")}
                 ELSE '' END, '') AS answer FROM m)"""


@register("mine_answers", f"""WITH {_MINE}
SELECT conv_id, turn, answer FROM a""")
def mine_answers(spark, sf):
    """The answer of a turn mined from the next turn's history."""
    h = C.history(C.utterances(fx.turns(spark, sf))).where(F.col("role") == "user")
    return C.mine_answers(h).select("conv_id", "turn", "answer")


@register("rewritten_history", f"""WITH {_MINE},
q AS (SELECT conv_id, turn, {tw("string_split(history, '[SEP]')[1]")} AS q, {tw('answer')} AS a FROM a),
p AS (SELECT conv_id, turn, q, list({{'q': q, 'a': a}}) {_PRIOR} AS prior FROM q)
SELECT conv_id, turn, array_to_string(list_concat([q], flatten(list_transform(list_reverse(coalesce(prior, [])),
         lambda x: CASE WHEN x.a <> '' THEN [x.a, x.q] ELSE [x.q] END))), ' [SEP] ') AS history
FROM p""")
def rewritten_history(spark, sf):
    """W5 after W6: each turn's current question, then earlier turns newest
    first as (answer if non-empty, question)."""
    h = C.history(C.utterances(fx.turns(spark, sf))).where(F.col("role") == "user")
    a = C.mine_answers(h).withColumn("text", T.strip_ws(F.element_at(T.split_sep("history"), 1)))
    return C.rewritten_history(a).select("conv_id", "turn", "history")


def _prompt_ctes() -> str:
    head, rest = T.REWRITE_PROMPT.split("{ctx}")
    mid, tail = rest.split("{question}")
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    return f"""WITH {TURNS_CTE},
n AS (SELECT conv_id, turn, role, text,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM turns),
qa AS (SELECT conv_id, turn, text AS question, CASE WHEN nr = 'assistant' THEN nt ELSE '' END AS answer
       FROM n WHERE role = 'user'),
p AS (SELECT conv_id, turn, question, list({{'q': question, 'a': answer}}) {_PRIOR} AS prior FROM qa),
b AS (SELECT conv_id, turn, question,
        list_filter(list_transform(list_reverse(coalesce(prior, [])),
            lambda x: CASE WHEN x.q <> '' AND x.a <> '' THEN 'user: ' || x.q || '\\nsystem: ' || x.a END),
            lambda x: x IS NOT NULL) AS blocks FROM p),
k AS (SELECT conv_id, turn, question,
        list_filter(blocks, lambda x, i: list_sum(list_transform(blocks[1:i], lambda y: length(y))) + i - 1
                                      <= {T.CONTEXT_BUDGET}) AS kept FROM b),
r AS (SELECT conv_id, turn, question, CAST(len(kept) AS INTEGER) AS n_blocks,
        {lit(head)} || array_to_string(kept, chr(10)) || {lit(mid)} || question || {lit(tail)} AS prompt FROM k)"""


@register("rewrite_prompts", _prompt_ctes() + "\nSELECT conv_id, turn, question, n_blocks, prompt FROM r")
def rewrite_prompts(spark, sf):
    """F10 + W7: the rewriting prompt of every user turn, history blocks
    newest first within a 3000-character budget."""
    return C.rewrite_prompts(C.utterances(fx.turns(spark, sf)))


@register("history_budget", _prompt_ctes() +
          "\nSELECT conv_id, turn, n_blocks, CAST(length(prompt) AS INTEGER) AS prompt_chars FROM r")
def history_budget(spark, sf):
    """How many history blocks fit the budget, and the prompt size."""
    p = C.rewrite_prompts(C.utterances(fx.turns(spark, sf)))
    return p.select("conv_id", "turn", "n_blocks", F.length("prompt").alias("prompt_chars"))


def _extract_sql(x: str) -> str:
    t = tw(x)
    marker = T.REWRITE_MARKER
    after = f"CASE WHEN strpos({t}, '{marker}') > 0 THEN {tw(f'string_split({t}, {chr(39)}{marker}{chr(39)})[-1]')} ELSE {t} END"
    lines = f"list_filter(list_transform(string_split({after}, chr(10)), lambda y: {tw('y')}), lambda y: y <> '')"
    first = f"(CASE WHEN len({lines}) > 0 THEN ({lines})[1] ELSE '' END)"
    unl = (f"(CASE WHEN starts_with(lower({first}), '{T.REWRITE_LABEL}') AND strpos({first}, ':') > 0 "
           f"THEN {tw(f'regexp_extract({first}, {chr(39)}^[^:]*:(.*)$' + chr(39) + ', 1)')} ELSE {first} END)")
    quoted = (f"((starts_with({unl}, '\"') AND ends_with({unl}, '\"')) OR "
              f"(starts_with({unl}, '''') AND ends_with({unl}, '''')))")
    return f"CASE WHEN {quoted} THEN {tw(f'regexp_extract({unl}, {chr(39)}^.(.*).$' + chr(39) + ', 1)')} ELSE {unl} END"


def _generated(spark, sf):
    """Stand-in decoder output: the prompt echoed, then the assistant's
    raw reply (as a causal language model returns it)."""
    raw = fx.table(spark, sf, "conversations")
    p = C.rewrite_prompts(C.utterances(fx.turns(spark, sf))).select("conv_id", "turn", "prompt")
    reply = raw.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                           F.col("text").alias("reply"))
    # a turn without a reply yields the echoed prompt alone
    return p.join(reply, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.concat("prompt", F.coalesce("reply", F.lit(""))).alias("generated"))


@register("extract_rewrite", _prompt_ctes() + f""",
g AS (SELECT r.conv_id, r.turn, r.prompt || coalesce(c.text, '') AS generated FROM r
      LEFT JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1 AND c.role = 'assistant'),
e AS (SELECT conv_id, turn, {_extract_sql('generated')} AS rewrite FROM g)
SELECT conv_id, turn, rewrite,
       ({tw('rewrite')} = '' OR len(list_filter(regexp_split_to_array({tw('rewrite')}, '\\s+'), lambda z: z <> '')) < 3)
         AS needs_retry
FROM e""")
def extract_rewrite(spark, sf):
    """F11 + F12: the rewrite extracted from decoder output (text after the
    last marker, first non-empty line, label and quotes removed) and the
    retry flag."""
    return C.extract_and_check(_generated(spark, sf)).select("conv_id", "turn", "rewrite", "needs_retry")


@register("needs_retry", f"""SELECT conv_id, turn,
  ({tw('text')} = '' OR len(list_filter(regexp_split_to_array({tw('text')}, '\\s+'), lambda z: z <> '')) < 3)
    AS needs_retry,
  CAST(len(list_filter(regexp_split_to_array({tw('text')}, '\\s+'), lambda z: z <> '')) AS INTEGER) AS n_words
FROM conversations WHERE role = 'user'""")
def needs_retry(spark, sf):
    """empty or fewer than three words, on every raw user utterance."""
    t = fx.table(spark, sf, "conversations").where(F.col("role") == "user")
    return t.select("conv_id", "turn", T.needs_retry("text").alias("needs_retry"),
                    T.word_count("text").alias("n_words"))


# -- X15: rewriting with generator callables ----------------------------------

_Q_HEAD = "# Please rewrite the following user question: \n"
_Q_TAIL = "\n\n# Re-written query:"


DECODE_BUDGET = 5  # space-separated tokens a first-pass continuation may use


def echo_decoder(retry: bool = False):
    """Deterministic stand-in for a causal language model: echoes the
    prompt and continues it with the prompt's own question — labelled,
    quoted and cut to a budget of 5 tokens on the first pass (so short
    questions come out too short), in full with a context note on the
    retry pass."""
    def fn(batches):
        for pdf in batches:
            prompts = pdf["prompt"].fillna("")
            qs = prompts.map(lambda p: p.split(_Q_HEAD)[-1].split(_Q_TAIL)[0])
            if retry:
                gen = prompts + qs + " (in context)"
            else:
                cont = ('Re-written query: "' + qs + '"').map(
                    lambda c: " ".join(c.split(" ")[:DECODE_BUDGET]))
                gen = prompts + cont
            yield pdf[["row_id"]].assign(generated=gen)
    return fn


@register("rewrite_queries", _prompt_ctes() + f""",
ids AS (SELECT r.*, row_number() OVER (ORDER BY conv_id, turn) - 1 AS row_id FROM r),
g AS (SELECT row_id, question, prompt || array_to_string(
        string_split('Re-written query: "' || question || '"', ' ')[1:{DECODE_BUDGET}], ' ') AS generated FROM ids),
e AS (SELECT row_id, question, {_extract_sql('generated')} AS rewrite FROM g),
c AS (SELECT *, ({tw('rewrite')} = '' OR len(list_filter(regexp_split_to_array({tw('rewrite')}, '\\s+'),
                 lambda z: z <> '')) < 3) AS needs FROM e),
g2 AS (SELECT ids.row_id, ids.prompt || ids.question || ' (in context)' AS generated
       FROM ids JOIN c ON ids.row_id = c.row_id WHERE c.needs)
SELECT CAST(row_id AS BIGINT) AS row_id, rewrite, false AS retried FROM c WHERE NOT needs
UNION ALL
SELECT CAST(row_id AS BIGINT) AS row_id, {_extract_sql('generated')} AS rewrite, true AS retried FROM g2""")
def rewrite_queries(spark, sf):
    """Prompts of every user turn -> decoder -> extraction -> one
    retry for empty/short rewrites, ids in conversation order."""
    from ..operators.rewrite import rewrite_queries as rq
    from ..operators.rowids import assign_row_ids
    p = assign_row_ids(C.rewrite_prompts(C.utterances(fx.turns(spark, sf))), ["conv_id", "turn"])
    return rq(p, echo_decoder(), echo_decoder(retry=True)).select("row_id", "rewrite", "retried")


ORACLE_RW = ORACLE["rewritten_history"]


@register("first_entries", f"""SELECT conv_id, turn, {tw("string_split(history, '[SEP]')[1]")} AS text FROM (
{ORACLE_RW})""")
def first_entries(spark, sf):
    """X16 on W5 output: the trimmed current question of every chained history."""
    from ..operators.prep import first_entries as fe
    return fe(rewritten_history(spark, sf), ["conv_id", "turn"], "history")
