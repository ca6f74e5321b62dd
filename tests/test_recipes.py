"""X17 recipes end to end from hand-made corpus files."""

import json
import os

from spire.operators import recipes as X
from spire.session import scratch_path
from spire.sources import readers as S


def _d(spark, name):
    p = scratch_path(spark, name)
    os.makedirs(p, exist_ok=True)
    return p


def _by_row(df):
    return {r["row_id"]: r["text"] for r in df.collect()}


def test_topiocqa(spark):
    d = _d(spark, "rc-topiocqa")
    recs = [{"conv_id": 1, "turn_id": 1, "question": "who is x", "positive_ctxs": [{"passage_id": "p1"}]},
            {"conv_id": 1, "turn_id": 2, "question": "who is x [SEP] x is y [SEP]  when ", "positive_ctxs": [{"passage_id": "p2"}]}]
    json.dump(recs, open(f"{d}/t.json", "w"))
    out = X.topiocqa(S.read_turns_flat(spark, f"{d}/t.json"))
    assert _by_row(out["queries_last"]) == {0: "who is x", 1: "when"}
    assert _by_row(out["queries_all"]) == {0: "who is x", 1: "when [SEP] x is y [SEP] who is x"}
    assert sorted(tuple(r) for r in out["qrels"].collect()) == [("0", "p1", 1), ("1", "p2", 1)]


def test_qrecc(spark):
    d = _d(spark, "rc-qrecc")
    long_a = "word " * 150
    recs = [{"Conversation_no": 1, "Turn_no": 1, "Context": [], "Question": "q1?", "Truth_rewrite": "full q1",
             "Truth_passages": ["u1"], "Answer_URL": ""},
            {"Conversation_no": 1, "Turn_no": 2, "Context": ["q1?", long_a], "Question": "q2\nnext", "Truth_rewrite": "r2",
             "Truth_passages": "u2", "Answer_URL": ""},
            {"Conversation_no": 1, "Turn_no": 3, "Context": [], "Question": "q3", "Truth_rewrite": "r3",
             "Truth_passages": [], "Answer_URL": ""}]
    json.dump(recs, open(f"{d}/q.json", "w"))
    out = X.qrecc(S.read_turns_context(spark, f"{d}/q.json"))
    last = _by_row(out["queries_last"])
    assert last == {0: "full q1", 1: "q2 next"}            # turn 1 uses the rewrite; turn 3 dropped
    all_ = _by_row(out["queries_all"])
    assert all_[0] == "full q1"
    assert all_[1] == "q2 next [SEP] " + long_a[:500].strip() + " [SEP] q1?"
    assert sorted(tuple(r) for r in out["qrels"].collect()) == [("0", "u1", 1), ("1", "u2", 1)]


def test_ikat_keeps_skipped_utterances_when_asked(spark):
    d = _d(spark, "rc-ikat")
    topics = [{"number": "c1", "turns": [
        {"utterance": "u0", "response": "a0", "resolved_utterance": "r0", "response_provenance": ["d1"]},
        {"utterance": "u1", "response": "a1", "resolved_utterance": "r1", "response_provenance": ["missing"]},
        {"utterance": "u2", "response": "a2", "resolved_utterance": "r2", "response_provenance": ["d2", "missing"]}]}]
    json.dump(topics, open(f"{d}/t.json", "w"))
    turns = S.read_topics_nested(spark, f"{d}/t.json")
    docs = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    test_split = X.ikat(turns, docs, keep_skipped_turns=True)
    assert _by_row(test_split["queries_all"]) == {0: "u0", 1: "u2 [SEP] u1 [SEP] a0 [SEP] u0"}
    train_split = X.ikat(turns, docs, keep_skipped_turns=False)
    assert _by_row(train_split["queries_all"]) == {0: "u0", 1: "u2 [SEP] a0 [SEP] u0"}
    assert sorted(tuple(r) for r in test_split["qrels"].collect()) == [("0", "d1", 1), ("1", "d2", 1)]


def test_cast(spark):
    docs = spark.createDataFrame([("b", "answer b"), ("a", "answer a")], "doc_id string, text string")
    queries = spark.createDataFrame(
        [("31_1", "31", "first", "m1", "t1", "b"), ("31_2", "31", "second", "m2", "t2", "zz"),
         ("32_1", "32", "other", "m3", "t3", "a")],
        "query_id string, topic_number string, raw_utterance string, manual_rewritten_utterance string, "
        "automatic_rewritten_utterance string, manual_canonical_result_id string")
    qrels = spark.createDataFrame([("31_1", "a", 1), ("31_1", "b", 2), ("32_1", "a", 0), ("31_2", "zz", 3)],
                                  "query_id string, doc_id string, relevance int")
    out = X.cast(docs, queries, qrels)
    assert _by_row(out["passages"]) == {0: "answer a", 1: "answer b"}
    assert _by_row(out["queries_all"]) == {0: "first", 1: "second [SEP] answer b [SEP] first", 2: "other"}
    assert sorted(tuple(r) for r in out["qrels"].collect()) == [("0", "1", 1)]   # b has rel 2; zz unknown
