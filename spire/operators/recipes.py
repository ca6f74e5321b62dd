"""Per-corpus dataset preparation, composed from the readers and the
conversation operators.  Every recipe returns DataFrames, never files:

* ``queries_all``  (row_id, text)   newest-first history query
* ``queries_last`` (row_id, text)   the current utterance
* ``rewrites``     (row_id, text)   human rewrite, where the corpus has one
* ``qrels``        (qid, did, rel)  qid = row id (string), rel 1

Row ids are dense and follow the input order (R1, distributed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .prep import lookup_answer, map_qrels_to_rows, resolve_provenance
from .rowids import assign_row_ids
from .runs import max_relevance


def _rows(df: DataFrame, order: list) -> DataFrame:
    return assign_row_ids(df, order)


def topiocqa(records: DataFrame) -> dict[str, DataFrame]:
    """Flat turns (S8): ``question`` is an oldest-first ``[SEP]`` history;
    last = F4, all = F5 (segments always trimmed), qrels = first positive."""
    r = _rows(records, ["conv_id", "turn_id"])
    return {
        "queries_all": r.select("row_id", T.reverse_history("question").alias("text")),
        "queries_last": r.select("row_id", T.last_segment("question").alias("text")),
        "qrels": r.where(F.col("passage_id").isNotNull()).select(
            F.col("row_id").cast("string").alias("qid"), F.col("passage_id").alias("did"), F.lit(1).alias("rel")),
    }


def qrecc(records: DataFrame) -> dict[str, DataFrame]:
    """Context records (S9): turns without truth passages dropped (R7); the
    question is the truth rewrite on turn 1; context truncated by role
    (F3), newest first, behind the 320-char question (F6)."""
    r = records.where(F.size("passages") > 0)
    r = _rows(r, ["Conversation_no", "Turn_no"])
    q = F.when(F.col("Turn_no") == 1, F.col("Truth_rewrite")).otherwise(F.col("Question"))
    q = T.strip_ws(F.substring(F.regexp_replace(q, "\n", " "), 1, T.USER_CUT))
    ctx = F.reverse(T.truncate_by_role(F.coalesce(F.col("Context"), F.array().cast("array<string>"))))
    ctx_s = T.strip_ws(F.regexp_replace(F.array_join(ctx, T.SEP_JOIN), "\n", " "))
    turn_id = F.concat_ws("_", "Conversation_no", "Turn_no")
    r = r.withColumn("_q", q).withColumn("_all", F.when(F.size(ctx) > 0, F.concat(F.col("_q"), F.lit(T.SEP_JOIN), ctx_s))
                                         .otherwise(F.col("_q")))
    return {
        "queries_all": r.select("row_id", F.col("_all").alias("text")),
        "queries_by_turn": r.select(turn_id.alias("turn_id"), F.col("_all").alias("text")),
        "qrels_by_turn": r.select(turn_id.alias("qid"), F.explode("passages").alias("did"), F.lit(1).alias("rel")).dropDuplicates(["qid", "did"]),
        "queries_last": r.select("row_id", F.col("_q").alias("text")),
        "rewrites": r.select("row_id", F.col("Truth_rewrite").alias("text")),
        "qrels": r.select(F.col("row_id").cast("string").alias("qid"), F.explode("passages").alias("did"),
                          F.lit(1).alias("rel")).dropDuplicates(["qid", "did"]),
    }


def ikat(turns: DataFrame, docs: DataFrame, keep_skipped_turns: bool = True,
         id_col: str = "doc_id") -> dict[str, DataFrame]:
    """Nested topics (S7 rows: conv, turn, utterance, response, rewrite,
    provenance): provenance resolved against the collection (J4); turns
    left without it are skipped.  The history of a kept turn is every
    earlier kept turn's utterance and response plus its own utterance,
    newest first; with ``keep_skipped_turns`` (the reference's test split)
    the utterances of skipped turns stay in the history too."""
    resolved = resolve_provenance(turns.select("conv", "turn", "provenance"), docs, ["conv", "turn"],
                                  id_col=id_col).select("conv", "turn", F.col("provenance").alias("_prov"))
    t = turns.join(resolved, ["conv", "turn"], "left").withColumn("_kept", F.col("_prov").isNotNull())
    u = F.when(F.col("_kept") | F.lit(keep_skipped_turns), F.col("utterance"))
    a = F.when(F.col("_kept"), F.coalesce(F.col("response"), F.lit("")))
    w = Window.partitionBy("conv").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.collect_list(F.struct(u.alias("u"), a.alias("a"))).over(w)
    items = F.filter(F.flatten(F.transform(prior, lambda p: F.array(p["u"], p["a"]))), lambda x: x.isNotNull())
    t = t.withColumn("_hist", F.concat(items, F.array(F.col("utterance"))))
    # conversations in file order where the reader gives one
    kept = _rows(t.where(F.col("_kept")), ["conv_no", "turn"] if "conv_no" in turns.columns else ["conv", "turn"])
    return {
        "queries_all": kept.select("row_id", F.array_join(F.reverse("_hist"), T.SEP_JOIN).alias("text")),
        "queries_last": kept.select("row_id", F.col("utterance").alias("text")),
        "rewrites": kept.select("row_id", T.clean_text(F.coalesce("rewrite", F.lit(""))).alias("text")),
        "qrels": kept.select(F.col("row_id").cast("string").alias("qid"), F.explode(F.array_distinct("_prov")).alias("did"),
                             F.lit(1).alias("rel")),
    }


def cast(docs: DataFrame, queries: DataFrame, qrels: DataFrame, consistent: bool = False) -> dict[str, DataFrame]:
    """Three-table corpus (S20): passages sorted by id get row ids (T2);
    the canonical answer text is looked up (J7) and, like the utterance,
    word-truncated with the reference's preset (F2); history newest first
    (W4); qrels mapped to row ids (J5) keeping one passage per query with
    the greatest relevance, written as 1 (A11)."""
    passages = _rows(docs.select("doc_id", T.clean_text("text").alias("text")), ["doc_id"])
    q = _rows(queries, ["topic_number", F.substring_index("query_id", "_", -1).cast("int"), "query_id"])
    q = lookup_answer(q, docs, "manual_canonical_result_id")
    u_lim, u_cut = T.USER_CUT, (T.USER_CUT if consistent else T.OTHER_CUT)
    a_lim, a_cut = T.OTHER_CUT, (T.OTHER_CUT if consistent else T.USER_CUT)
    q = q.withColumn("_u", T.truncate_words("raw_utterance", u_lim, u_cut)) \
        .withColumn("_a", T.truncate_words("answer", a_lim, a_cut))
    w = Window.partitionBy("topic_number").orderBy("row_id").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.flatten(F.collect_list(F.array("_u", "_a")).over(w))
    q = q.withColumn("_hist", F.concat(prior, F.array("_u")))
    qmap = q.select("row_id", F.col("query_id").alias("id"))
    dmap = passages.select("row_id", F.col("doc_id").alias("id"))
    mapped = map_qrels_to_rows(qrels.select(F.col("query_id").alias("qid"), F.col("doc_id").alias("did"),
                                            F.col("relevance").alias("rel"),
                                            *[c for c in qrels.columns if c == "line"]), qmap, dmap)
    # of equal relevance the first line of the file wins, where it is known
    best = max_relevance(mapped, "line" if "line" in mapped.columns else "did")
    return {
        "passages": passages.select("row_id", "text"),
        "queries_all": q.select("row_id", F.array_join(F.reverse("_hist"), T.SEP_JOIN).alias("text")),
        "queries_last": q.select("row_id", F.col("_u").alias("text")),
        "rewrites": q.select("row_id", F.col("manual_rewritten_utterance").alias("text")),
        "automatic_rewrites": q.select("row_id", F.col("automatic_rewritten_utterance").alias("text")),
        "qrels": best.select(F.col("qid").cast("string"), F.col("did").cast("string"), "rel"),
    }
