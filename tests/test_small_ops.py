"""Operators without a registered query: positional helpers, lookups, sinks."""

import os

import pytest
from pyspark.sql import functions as F

from spire.operators import distill as D
from spire.operators import index as ix
from spire.operators import logs as L
from spire.operators import prep as P
from spire.operators import rowids as RI
from spire.session import scratch_path
from spire.sources import readers as S
from spire.sources import sinks as K


def test_round_robin_take_first_limit(spark):
    df = RI.assign_row_ids(spark.range(10).withColumnRenamed("id", "k"), ["k"])
    assert sorted(r["k"] for r in RI.split_round_robin(df, 1, 3).collect()) == [1, 4, 7]
    assert sorted(r["k"] for r in RI.take_first(df, 4).collect()) == [0, 1, 2, 3]
    qrels = spark.createDataFrame([("q3", "d", 1), ("q1", "d", 1), ("q2", "d", 1), ("q1", "e", 0)],
                                  "qid string, did string, rel int")
    assert sorted(r["qid"] for r in RI.limit_queries(qrels, 2).collect()) == ["q1", "q1", "q2"]


def test_cast_ids_and_sort(spark):
    df = spark.createDataFrame([(10, 1), (9, 2), (100, 3)], "qid long, score int")
    c = RI.cast_ids(df, ["qid"], ["score"])
    assert dict(c.dtypes) == {"qid": "string", "score": "double"}
    assert [r["qid"] for r in RI.sort_by_int_id(c, "qid").collect()] == ["9", "10", "100"]


def test_lookup_answer_and_alignment(spark):
    q = spark.createDataFrame([(1, "a1"), (2, "zz")], "query_id long, answer_id string")
    docs = spark.createDataFrame([("a1", "the answer")], "doc_id string, text string")
    got = {r["query_id"]: r["answer"] for r in P.lookup_answer(q, docs, "answer_id").collect()}
    assert got == {1: "the answer", 2: ""}
    left = spark.createDataFrame([("x",), ("y",)], "q string")
    right = spark.createDataFrame([(5,), (3,)], "r long")
    al = sorted((r["q"], r["r"]) for r in P.align_by_position(left, right, ["q"], ["r"]).collect())
    assert al == [("x", 3), ("y", 5)]


def test_explicit_positives_and_corpus_tables(spark):
    qt = spark.createDataFrame([("q1", "q1", "pos text"), ("q1", "d2", "other")], "qid string, did string, text string")
    assert [r["pos_text"] for r in D.explicit_positives(qt).collect()] == ["pos text"]
    docs = spark.createDataFrame([("d", "t", "x")], "doc_id string, text string, extra string")
    queries = spark.createDataFrame([("q", "1", "r", "m", "a", "d")],
                                    "query_id string, topic_number string, raw_utterance string, "
                                    "manual_rewritten_utterance string, automatic_rewritten_utterance string, "
                                    "manual_canonical_result_id string")
    qrels = spark.createDataFrame([("q", "d", 1)], "query_id string, doc_id string, relevance int")
    d, qq, r = S.read_corpus_tables(docs, queries, qrels)
    assert d.columns == ["doc_id", "text"] and len(qq.columns) == 6 and r.count() == 1


def test_id_map_stats_and_metric_log_sinks(spark):
    base = scratch_path(spark, "small-sinks")
    ix.write_id_map(spark.createDataFrame([(0, "a")], "row_id long, id string"), f"{base}/ids")
    assert spark.read.parquet(f"{base}/ids").count() == 1
    stats = spark.createDataFrame([(1.0, 2.0, 0.5, 3)], "l0 double, l1 double, sparsity double, n_docs long")
    K.write_stats(stats, f"{base}/stats")
    K.write_stats(stats, f"{base}/stats")
    assert spark.read.parquet(f"{base}/stats").count() == 2
    m = spark.createDataFrame([("r1", "mrr_10", 0.5)], "run string, metric string, value double")
    L.append_metrics(m, f"{base}/metrics")
    L.append_metrics(m.withColumn("run", F.lit("r2")), f"{base}/metrics")
    assert sorted(p for p in os.listdir(f"{base}/metrics") if p.startswith("run=")) == ["run=r1", "run=r2"]


def test_registries_name_what_they_know():
    from spire.operators import distill, sparse
    assert distill.loss("margin_mse") is distill.margin_mse and sparse.regularizer("flops") is sparse.flops_regularizer
    for find in (distill.loss, sparse.regularizer):
        with pytest.raises(ValueError, match="known"):
            find("nothing")


def test_repeated_ids_are_an_error(spark):
    from spire.operators import index as ix
    ids = spark.createDataFrame([(1,), (1,), (2,)], "doc_id long")
    vec = spark.createDataFrame([(1, 0, 1.0)], "doc_id long, dim int, weight double")
    with pytest.raises(ValueError, match="repeated ids"):
        ix.build_index(vec, ids, "doc_id")


def test_documents_without_weight_and_token_dims(spark):
    from spire.operators import index as ix
    vec = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "doc_id long, dim string, weight double")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    got = {r.doc_id: r.shard for r in ix.shard_documents(vec, "doc_id", 4, ids=ids).collect()}
    assert got[3] == 0 and set(got) == {1, 2, 3}
    parts = spark.createDataFrame([(0, 0, 10, 1, 1.0), (1, 0, 20, 1, 1.0)], "shard int, local_id long, doc_id long, dim int, weight double")
    maps = spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "shard int, local_id long")
    assert sorted(r.row_id for r in ix.merge_index(parts, "doc_id", maps).collect()) == [0, 2]


@pytest.mark.parametrize("decay", [0.0, 0.05, 0.5, 0.99, 1.0])
def test_moving_average_for_any_decay(spark, decay):
    from spire.operators.logs import moving_average
    xs = [float((i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(xs)], "run string, step long, value double")
    got = [r.ema for r in moving_average(df, "run", decay=decay, chunk=8).orderBy("step").collect()]
    ema, want = 0.0, []
    for x in xs:
        ema = decay * ema + (1 - decay) * x
        want.append(ema)
    assert got == pytest.approx(want, rel=1e-9, abs=1e-12)


def test_pairs_of_a_group_are_scored_where_its_vectors_meet(spark):
    """``by`` gives the scores of the join by terms, and moves a vector once for each group, not for each pair."""
    from pyspark.sql import functions as F

    from spire.operators import retrieve as R
    inf = float("inf")
    terms = [(v, d, (v * 7 + d * 3) % 5 / 4 - 0.5) for v in range(30) for d in range(v % 3, 12, 3)] + [(3, 0, 0.25), (4, 1, None), (5, None, 1.0), (6, 1, inf), (None, 2, 1.0)]
    q, d = (spark.createDataFrame(terms, f"{c} long, dim int, weight double") for c in ("qid", "did"))
    pairs = spark.createDataFrame([(i // 8, i, j) for i in range(32) for j in range(i // 8, 32, 3)] + [(0, None, 3), (1, 3, None), (7, 77, 78)], "batch long, qid long, did long")
    expected = {(r["qid"], r["did"]): r["score"] for r in R.score_pairs(pairs.select("qid", "did"), q, d).collect()}
    found = R.score_pairs(pairs.unionByName(pairs), q, d, by="batch")
    rows = found.collect()
    assert len(rows) == len(expected) == pairs.count()
    assert all(str(r["score"]) == str(expected[r["qid"], r["did"]]) or abs(r["score"] - expected[r["qid"], r["did"]]) < 1e-12 for r in rows)
    assert inf in expected.values() and found.agg(F.countDistinct("batch")).first()[0] == 5


def test_divergence_reads_the_scores_twice(spark):
    """One look for the greatest scores, one joined with them; a query with a null score counts as before."""
    from spire.operators import distill as D
    ts = spark.createDataFrame([(q, d, (q * d) % 7 * 30.0, None if (q, d) == (2, 3) else (q + d) % 5 * 20.0) for q in range(5) for d in range(9)], "qid long, did long, teacher double, student double")
    out = D.kl_divergence(ts)
    import math
    kls = []
    for q in range(5):
        rows = [(r["teacher"], r["student"]) for r in ts.where(ts.qid == q).collect()]
        lt = math.log(sum(math.exp(t) for t, _ in rows))
        ls = math.log(sum(math.exp(s) for _, s in rows if s is not None))
        kls.append(sum(math.exp(t - lt) * ((t - lt) - (s - ls)) for t, s in rows if s is not None))
    got = out.first()
    assert abs(got["kl_divergence"] - sum(kls) / 5) < 1e-9 and got["n_queries"] == 5
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 2
