"""Readers and writers: round trips in fresh folders under the shared dir."""

import gzip
import json
import os

import pytest

from pyspark.sql import functions as F

from spire.session import scratch_path
from spire.sources import readers as S
from spire.sources.json_elements import read_elements
from spire.sources import sinks as K


def _dir(spark, name):
    p = scratch_path(spark, name)
    os.makedirs(p, exist_ok=True)
    return p


def _write(path, text, gz=False):
    if gz:
        with gzip.open(path, "wt", encoding="utf-8") as f:
            f.write(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return path


def test_collection_and_titled(spark):
    d = _dir(spark, "io-coll")
    _write(f"{d}/raw.tsv", "1\thello\tworld\n\n2\t  spaced text \r\nbad line\nx\n3\tlast\n")
    rows = sorted((r["id"], r["text"]) for r in S.read_collection(spark, d).collect())
    assert rows == [("1", "hello world"), ("2", "spaced text"), ("3", "last")]
    ids = S.read_collection(spark, d, with_row_ids=True).orderBy("row_id").collect()
    assert [r["row_id"] for r in ids] == [0, 1, 2]
    p = _write(f"{d}/titled.tsv", "id\ttext\ttitle\nA\tbody one\tTitle\n\nB\tbody two\t Other \n")
    t = sorted((r["id"], r["text"]) for r in S.read_titled_collection(spark, p).collect())
    assert t == [("A", "Title. body one"), ("B", "Other. body two")]
    w = _write(f"{d}/wide.tsv", "7\ta\tb\tc\n")
    assert S.read_wide_collection(spark, w).first()["text"] == "a b c"


def test_passages_jsonl(spark):
    d = _dir(spark, "io-jsonl")
    _write(f"{d}/a.jsonl", '{"id": "p1", "contents": "line\\none"}\n{bad json\n{"id": "p2"}\n')
    _write(f"{d}/b.jsonl.gz", '{"id": "p3", "contents": "tab\\there"}\n', gz=True)
    r = sorted((x["id"], x["contents"]) for x in S.read_passages_jsonl(spark, [f"{d}/a.jsonl", f"{d}/missing.jsonl"]).collect())
    assert r == [("p1", "line one")]
    r2 = sorted((x["id"], x["contents"]) for x in S.read_passages_jsonl_folders(spark, [d]).collect())
    assert ("p3", "tab here") in r2 and ("p2", "") in r2


def test_topics_and_turns(spark):
    d = _dir(spark, "io-topics")
    topics = [{"number": "c1", "turns": [
        {"utterance": "q1", "response": "a1", "resolved_utterance": "r1", "response_provenance": ["d1", "d2"]},
        {"utterance": "q2", "response": "a2", "resolved_utterance": "r2", "response_provenance": []}]}]
    _write(f"{d}/topics.json", json.dumps(topics))
    t = S.read_topics_nested(spark, f"{d}/topics.json").orderBy("turn").collect()
    assert [(r["conv"], r["turn"], r["utterance"], list(r["provenance"])) for r in t] == \
        [("c1", 0, "q1", ["d1", "d2"]), ("c1", 1, "q2", [])]
    flat = [{"conv_id": 1, "turn_id": 2, "question": "a [SEP] b", "positive_ctxs": [{"passage_id": "77"}]}]
    _write(f"{d}/flat.json", json.dumps(flat))
    assert S.read_turns_flat(spark, f"{d}/flat.json").first()["passage_id"] == "77"
    ctx = [{"Conversation_no": 1, "Turn_no": 1, "Context": [], "Question": "q", "Truth_rewrite": "r",
            "Truth_passages": "u1", "Answer_URL": "x"},
           {"Conversation_no": 1, "Turn_no": 2, "Context": ["q", "a"], "Question": "q2", "Truth_rewrite": "r2",
            "Truth_passages": ["u2", "u3"], "Answer_URL": "x"},
           {"Conversation_no": 1, "Turn_no": 3, "Context": [], "Question": "q3", "Truth_rewrite": "r3",
            "Truth_passages": [], "Answer_URL": "x"}]
    _write(f"{d}/ctx.json", json.dumps(ctx))
    got = {r["Turn_no"]: list(r["passages"]) for r in S.read_turns_context(spark, f"{d}/ctx.json").collect()}
    assert got == {1: ["u1"], 2: ["u2", "u3"], 3: []}


def test_qrels_and_runs_round_trip(spark):
    d = _dir(spark, "io-runs")
    _write(f"{d}/qrels.txt", "q1 0 d1 1\nq1\t0\td2\t0\nq2 0 d3 2\n")
    q = sorted((r["qid"], r["did"], r["rel"]) for r in S.read_trec_qrels(spark, f"{d}/qrels.txt").collect())
    assert q == [("q1", "d1", 1), ("q1", "d2", 0), ("q2", "d3", 2)]
    _write(f"{d}/qrels.json", json.dumps({"q1": {"d1": 1, "d2": 0}, "7": {"d3": 2}}))
    nq = sorted((r["qid"], r["did"], r["rel"]) for r in S.read_nested_qrels(spark, f"{d}/qrels.json").collect())
    assert nq == [("7", "d3", 2), ("q1", "d1", 1), ("q1", "d2", 0)]
    _write(f"{d}/pretty.json", json.dumps({"q1": {"d1": 1}, "q2": {"d2": 3}}, indent=2))
    pq = sorted((r["qid"], r["did"], r["rel"]) for r in S.read_nested_qrels(spark, f"{d}/pretty.json", True).collect())
    assert pq == [("q1", "d1", 1), ("q2", "d2", 3)]
    many = spark.createDataFrame([(f"q{i}", f"d{j}", float(i * j)) for i in range(20) for j in range(3)],
                                 "qid string, did string, score double")
    K.write_run(many.coalesce(1), f"{d}/many_json", fmt="json")   # many objects in one file
    assert S.read_nested_run(spark, f"{d}/many_json").count() == 60
    run = spark.createDataFrame([("q1", "d1", 1.5), ("q1", "d2", 0.5), ("q2", "d3", 2.0)],
                                "qid string, did string, score double")
    K.write_run(run, f"{d}/run_json", fmt="json")
    back = S.read_nested_run(spark, f"{d}/run_json")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in run.collect())
    K.write_run(run, f"{d}/run_pq")
    assert spark.read.parquet(f"{d}/run_pq").count() == 3
    K.write_qrels(spark.createDataFrame([("q1", "d1", 1)], "qid string, did string, rel int"), f"{d}/qj", fmt="json")
    assert S.read_nested_qrels(spark, f"{d}/qj").count() == 1
    _write(f"{d}/run.trec", "q1 Q0 d1 1 3.5 tag\nq1 Q0 d2 2 1.5 tag\n")
    assert sorted(r["did"] for r in S.read_trec_run(spark, f"{d}/run.trec").collect()) == ["d1", "d2"]


def test_triplets_queries_and_auto(spark):
    d = _dir(spark, "io-misc")
    _write(f"{d}/trip.tsv", " q \tpos\tneg \nbroken\n")
    t = S.read_triplets(spark, f"{d}/trip.tsv").collect()
    assert [(r["query"], r["pos"], r["neg"]) for r in t] == [("q", "pos", "neg")]
    _write(f"{d}/one.tsv", "first question\nsecond question\n")
    one = S.read_query_file(spark, f"{d}/one.tsv").orderBy("row_id").collect()
    assert [(r["row_id"], r["question"]) for r in one] == [(0, "first question"), (1, "second question")]
    _write(f"{d}/two.tsv", "5\thello\n6\tworld\n")
    assert S.read_query_file(spark, f"{d}/two.tsv").count() == 2
    _write(f"{d}/hdr.tsv", "docid\ttext\nA\tx\nB\ty\n")
    h = S.read_delimited_auto(spark, f"{d}/hdr.tsv")
    assert h.columns == ["docid", "text"] and h.count() == 2
    _write(f"{d}/nohdr.tsv", "1\tx\n2\ty\n")
    n = S.read_delimited_auto(spark, f"{d}/nohdr.tsv")
    assert n.columns == ["id", "contents"] and n.count() == 2
    _write(f"{d}/q.jsonl", '{"a": "q1", "b": "d1", "c": 1}\n')
    assert S.read_json_qrels_auto(spark, f"{d}/q.jsonl").columns == ["query", "doc", "relevance"]
    rw = spark.createDataFrame([("1_1", "x"), ("1_2", "y")], "id string, text string")
    rw.coalesce(1).write.parquet(f"{d}/rw")
    assert sorted(r["row_id"] for r in S.read_rewrites(spark, f"{d}/rw").collect()) == [0, 1]


def test_queries_tsv_sorted_and_query_reps(spark):
    d = _dir(spark, "io-tsv")
    df = spark.createDataFrame([("10", "b"), ("9", "a"), ("100", "c")], "row_id string, text string")
    K.write_queries_tsv(df, f"{d}/q")
    lines = []
    for f in sorted(os.listdir(f"{d}/q")):
        if f.startswith("part-"):
            lines += open(f"{d}/q/{f}").read().splitlines()
    assert lines == ["9\ta", "10\tb", "100\tc"]
    v = spark.createDataFrame([(1, 5, 0.5), (1, 2, 1.0)], "qid long, dim int, weight double")
    r = K.query_reps(v).first()
    assert list(r["cols"]) == [2, 5] and list(r["values"]) == [1.0, 0.5]


def test_sharded_postings_layout(spark):
    from spire.operators import index as ix
    d = _dir(spark, "io-shard")
    post = spark.createDataFrame([(0, 1, 0.5, 0), (1, 2, 0.7, 1)], "did long, dim int, weight double, shard int")
    ix.write_sharded_postings(post, f"{d}/s")
    assert sorted(os.path.basename(p) for p in os.listdir(f"{d}/s") if p.startswith("shard=")) == ["shard=0", "shard=1"]
    back = spark.read.parquet(f"{d}/s").where(F.col("shard") == 1)
    assert back.count() == 1


def test_row_ids_follow_files_and_lines(spark):
    d = _dir(spark, "io-order")
    os.makedirs(f"{d}/c")
    _write(f"{d}/c/part-2.tsv", "a\tfirst\n")
    _write(f"{d}/c/part-10.tsv", "".join(f"b{i}\tline {i}\n" for i in range(500)))
    rows = S.read_collection(spark, f"{d}/c/part-*.tsv", with_row_ids=True).orderBy("row_id").collect()
    assert [r["id"] for r in rows] == ["a"] + [f"b{i}" for i in range(500)]


def test_json_qrels_keep_their_meaning(spark):
    d = _dir(spark, "io-json")
    _write(f"{d}/a.jsonl", '{"qid": "Q1", "docid": "D1", "rel": 1}\n')
    _write(f"{d}/b.jsonl", '{"relevance": 2, "doc": "D1", "query": "Q1"}\n')
    _write(f"{d}/c.json", json.dumps([{"qid": "Q1", "docid": "D1", "rel": 1}], indent=1))
    for name, rel in (("a.jsonl", 1), ("b.jsonl", 2), ("c.json", 1)):
        df = S.read_json_qrels_auto(spark, f"{d}/{name}")
        assert df.columns == ["query", "doc", "relevance"] and tuple(df.first()) == ("Q1", "D1", rel)


def test_broken_nested_json_is_an_error(spark):
    d = _dir(spark, "io-broken")
    _write(f"{d}/pretty.json", json.dumps({"q1": {"d1": 1}}, indent=2))
    with pytest.raises(Exception, match="whole_file"):
        S.read_nested_qrels(spark, f"{d}/pretty.json").collect()


def test_quoted_fields_and_empty_positives(spark):
    d = _dir(spark, "io-quoted")
    _write(f"{d}/q.csv", 'id,contents\n1,"a, b"\n2,c\n')
    assert sorted(tuple(r) for r in S.read_delimited_auto(spark, f"{d}/q.csv").collect()) == [("1", "a, b"), ("2", "c")]
    _write(f"{d}/flat.json", json.dumps([{"conv_id": 1, "turn_id": 1, "question": "a", "positive_ctxs": []}]))
    assert S.read_turns_flat(spark, f"{d}/flat.json").first()["passage_id"] is None


def test_trec_run_takes_blanks_and_tabs_and_fails_on_others(spark, tmp_path):
    f = tmp_path / "run.trec"
    f.write_text("q1 Q0 d1 1 0.5 tag\nq1\tQ0\td2\t2\t0.25\ttag\n\n  q2  Q0 d3 1 1e-7 tag\n")
    assert sorted(map(tuple, S.read_trec_run(spark, str(f)).collect())) == [("q1", "d1", 0.5), ("q1", "d2", 0.25), ("q2", "d3", 1e-7)]
    for line in ("q1 Q0 d1 1 0.5", "q1 Q0 d1 1 high tag"):
        f.write_text(line + "\n")
        with pytest.raises(Exception, match="six fields"):
            S.read_trec_run(spark, str(f)).collect()


def test_quoted_fields_over_lines(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text('id,contents\n1,"two\nlines, and ""quotes"""\n2,plain\n')
    assert sorted(map(tuple, S.read_delimited_auto(spark, str(f)).collect())) == [("1", 'two\nlines, and "quotes"'), ("2", "plain")]


def test_json_values_of_another_type_are_kept(spark, tmp_path):
    f = tmp_path / "q.jsonl"
    f.write_text('{"query": 1, "doc": 5, "relevance": 1}\n{"query": "a2", "doc": 9223372036854775808, "relevance": 0.5}\n{"query": null, "doc": 7, "relevance": 2}\n')
    df = S.read_json_qrels_auto(spark, str(f))
    assert [t for _, t in df.dtypes] == ["string", "string", "double"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("1", "5", 1.0), ("a2", "9223372036854775808", 0.5), (None, "7", 2.0)], key=str)
    f.write_text('{"query": 1, "doc": 5, "relevance": 1}\n{"query": 2, "doc": 6, "relevance": 0}\n')
    assert [t for _, t in S.read_json_qrels_auto(spark, str(f)).dtypes] == ["bigint"] * 3


TRICKY = [{"a": 'brace } and { and [ ] in text', "n": [{"deep": "}"}, {}]}, {"a": 'quote \\" and \\\\', "n": []}, {"a": "lines\n\n}", "n": [{"deep": "\\u007d,{"}]},
          {"a": "", "n": None}, {"a": "last ünï", "n": [{"deep": "x" * 300}]}]


@pytest.mark.parametrize("size", ["997", "64m"])
def test_json_elements_in_splits(spark, tmp_path, size):
    """Elements are found wherever a split begins: inside strings, escapes, nested values."""
    many = [dict(x, i=i) for i, x in enumerate(TRICKY * 9)]
    (tmp_path / "one.json").write_text(json.dumps(many))
    (tmp_path / "pretty.json").write_text(json.dumps(many, indent=2, ensure_ascii=False))
    (tmp_path / "empty.json").write_text(" [ ]\n")
    (tmp_path / "map.json").write_text(json.dumps({f"q{i} }}": {f"d{k}}}": k for k in range(i % 4)} for i in range(50)}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        for name in ("one", "pretty"):
            rows = read_elements(spark, str(tmp_path / f"{name}.json")).orderBy("element").collect()
            assert [r.element for r in rows] == list(range(len(many))) and [json.loads(r.json) for r in rows] == many
        assert read_elements(spark, str(tmp_path / "empty.json")).count() == 0
        got = {(r.qid, r.did): r.rel for r in S.read_nested_qrels(spark, str(tmp_path / "map.json"), whole_file=True).collect()}
        assert got == {(f"q{i} }}", f"d{k}}}"): k for i in range(50) for k in range(i % 4)}
        if size == "997":
            assert spark.read.option("lineSep", "}").text(str(tmp_path / "one.json")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2', '[1, {"a": 2}]', '{"a": 1}'])
def test_json_elements_fail_on_others(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="not an array of objects"):
        read_elements(spark, str(tmp_path / "x.json")).collect()
