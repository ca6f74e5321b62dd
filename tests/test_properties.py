"""Properties from the survey's test strategy, on the driver tables."""

import math

import pytest
from pyspark.sql import functions as F

from spire.operators import distill as D
from spire.operators import index as ix
from spire.operators import logs as L
from spire.operators import metrics as M
from spire.operators import retrieve as R
from spire.operators import runs as U
from spire.operators import sparse as S
from spire.plans import fixtures as fx
from tests.conftest import SF_SMALL


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def _scores(df):
    return sorted((r["qid"], r["did"], round(r["score"], 9)) for r in df.collect())


def test_blocks_agree(spark):
    q, p = fx.query_terms(spark, SF_SMALL), fx.postings(spark, SF_SMALL)
    one = _scores(R.score(q, p))
    assert one == _scores(R.score(q, p, block_bytes=60_000))    # several blocks
    few = q.where("qid < 3")
    assert _scores(R.score(few, p)) == _scores(R.score(few, p, block_bytes=10))  # below one query: no broadcast, and it ends
    assert not any(fits for _, fits in R.query_blocks(few, "qid", 10))


def test_tiny_scores_keep_their_order(spark):
    q = spark.createDataFrame([(1, 0, 1.0)], "qid long, dim int, weight double")
    p = spark.createDataFrame([(1, 0, 1e-7), (2, 0, 2e-7), (3, 0, 3e-7)], "did long, dim int, weight double")
    assert _rows(R.retrieve(q, p, k=2), ["rank", "did", "score"]) == [(1, 3, 3e-7), (2, 2, 2e-7)]


def test_topk_is_prefix(spark):
    q, p = fx.query_terms(spark, SF_SMALL), fx.postings(spark, SF_SMALL)
    k5 = _rows(R.retrieve(q, p, k=5, threshold=None), ["qid", "did", "rank"])
    k6 = [r for r in _rows(R.retrieve(q, p, k=6, threshold=None), ["qid", "did", "rank"]) if r[2] <= 5]
    assert k5 == k6


def test_sharded_with_all_shards_equals_plain(spark):
    v = fx.vectors(spark, SF_SMALL)
    shards = ix.shard_documents(v, "vec_id", 4, 100)
    sd = ix.shard_top_dims(v, shards, "vec_id", 100)
    q = fx.query_terms(spark, SF_SMALL)
    routed = ix.route(q, sd, 4)
    assert routed.groupBy("qid").count().where("count < 4").count() == 0
    post = ix.shard_postings(fx.postings(spark, SF_SMALL), shards.withColumnRenamed("vec_id", "did"), "did")
    a = ix.retrieve_sharded(q, routed, post, k=10, threshold=None)
    b = R.retrieve(q, fx.postings(spark, SF_SMALL), k=10, threshold=None)
    assert _rows(a, ["qid", "did", "rank"]) == _rows(b, ["qid", "did", "rank"])


def test_merge_of_shards_is_whole_index(spark):
    v = fx.vectors(spark, SF_SMALL)
    shards = ix.shard_documents(v, "vec_id", 4, 100)
    merged = ix.merge_index(ix.local_indexes(v, shards, "vec_id"), "vec_id")
    ids = merged.select("row_id", "vec_id").distinct()
    n = ids.count()
    assert sorted(r["row_id"] for r in ids.collect()) == list(range(n))
    assert merged.count() == v.count()


def test_fuse_run_with_itself(spark):
    run = fx.lineitem_run(spark, SF_SMALL)
    f = U.fuse_runs([run, run])
    assert _scores(f) == _scores(run)


def test_softmax_sums_to_one(spark):
    ts = D.teacher_student(fx.lineitem_run(spark, SF_SMALL), fx.lineitem_run2(spark, SF_SMALL))
    ts = ts.withColumn("teacher", F.col("teacher") / 1000)
    sm = D.softmax(ts, "teacher", "p").groupBy("qid").agg(F.sum("p").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-9 for r in sm.collect())


def test_listwise_identity_against_self_join(spark):
    ts = D.teacher_student(fx.lineitem_run(spark, SF_SMALL), fx.lineitem_run2(spark, SF_SMALL)) \
        .withColumn("teacher", F.col("teacher") / 1000).withColumn("student", F.col("student") / 1000)
    closed = D.listwise_margin_mse(ts).first()["listwise_margin_mse"]
    a, b = ts.alias("a"), ts.alias("b")
    d = (F.col("a.student") - F.col("b.student")) - (F.col("a.teacher") - F.col("b.teacher"))
    explicit = a.join(b, "qid").groupBy("qid").agg(F.avg(d * d).alias("l")).agg(F.avg("l")).first()[0]
    assert closed == pytest.approx(explicit, rel=1e-9)


def test_moving_average_across_chunks(spark):
    e = fx.table(spark, SF_SMALL, "events").select(F.col("user_id").alias("run"), "event_id", "ts", "value")
    log = L.log_steps(e, "run", ["ts", "event_id"])
    got = {(r["run"], r["step"]): r["ema"] for r in L.moving_average(log, "run", chunk=3).collect()}
    seq = {}
    for run, rows in _group(log.select("run", "step", "value").collect()).items():
        ema = 0.0
        for r in sorted(rows, key=lambda x: x["step"]):
            ema = 0.99 * ema + 0.01 * r["value"]
            seq[(run, r["step"])] = ema
    assert got.keys() == seq.keys()
    assert all(math.isclose(got[k], seq[k], rel_tol=1e-9, abs_tol=1e-12) for k in seq)


def _group(rows):
    out = {}
    for r in rows:
        out.setdefault(r["run"], []).append(r)
    return out


def test_partitions_and_aqe_do_not_change_results(spark):
    q, p = fx.query_terms(spark, SF_SMALL), fx.postings(spark, SF_SMALL)
    base = _rows(R.retrieve(q, p, k=10, threshold=None), ["qid", "did", "rank", "score"])
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, aqe in [("1", "false"), ("2", "true"), ("8", "false")]:
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", aqe)
            assert _rows(R.retrieve(q, p, k=10, threshold=None), ["qid", "did", "rank", "score"]) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_negatives_with_replacement(spark):
    samples = spark.createDataFrame(
        [("a", f"d{i}", float(i)) for i in range(3)] + [("b", "x", 1.0)] + [("c", f"e{i}", 1.0) for i in range(9)],
        "qid string, did string, score double")
    pool = spark.createDataFrame([("b", "x")], "qid string, did string")
    negs = D.sample_negatives(samples, pool, 4, seed=1)
    per = {r["qid"]: r["count"] for r in negs.groupBy("qid").count().collect()}
    assert per == {"a": 4, "c": 4}          # b has no candidate: no row
    a = [r["did"] for r in negs.where("qid = 'a'").collect()]
    assert set(a) <= {"d0", "d1", "d2"}
    c = [r["did"] for r in negs.where("qid = 'c'").collect()]
    assert len(set(c)) == 4                 # without replacement
    again = D.sample_negatives(samples, pool, 4, seed=1)
    assert _rows(negs, ["qid", "slot", "did"]) == _rows(again, ["qid", "slot", "did"])


def test_positive_padding(spark):
    samples = spark.createDataFrame([("a", "d1", 3.0), ("a", "d2", 2.0), ("a", "d3", 1.0)],
                                    "qid string, did string, score double")
    qrels = spark.createDataFrame([("a", "d3", 1)], "qid string, did string, rel int")
    chosen, pool = D.choose_positives(qrels, samples, 2, seed=0)
    assert sorted(r["did"] for r in pool.collect()) == ["d1", "d3"]
    assert sorted(r["did"] for r in chosen.collect()) == ["d1", "d3"]


def test_metrics_in_unit_interval(spark):
    pq = M.per_query(fx.lineitem_run(spark, SF_SMALL), fx.lineitem_qrels(spark, SF_SMALL), cutoffs=[10, 100])
    cols = ["recip_rank", "map", "Rprec", "ndcg", "P_10", "recall_10", "ndcg_cut_10", "recall_100"]
    for r in pq.collect():
        assert all(0.0 <= r[c] <= 1.0 + 1e-12 for c in cols)


def test_stream_index_equals_batch(spark):
    from spire.streaming import stream as Z
    docs = fx.documents(spark, SF_SMALL)
    src = Z.split_into_files(docs, "doc_id", 4, Z.fresh_dir(spark, "t-docs"))
    out = Z.stream_index(spark, src, docs.schema, Z.fresh_dir(spark, "t-post"), batch_bytes=1024)
    assert out.select("batch_id").distinct().count() > 1
    batch = S.lexical_encode(docs, "doc_id", "text")
    assert _rows(out, ["doc_id", "dim", "weight"]) == _rows(batch, ["doc_id", "dim", "weight"])


def test_max_relevance_earliest_wins(spark):
    q = spark.createDataFrame([("a", 5, 1), ("a", 3, 2), ("a", 4, 2), ("b", 1, 0)],
                              "qid string, did long, rel int")
    r = U.max_relevance(q, "did").collect()
    assert [(x["qid"], x["did"], x["rel"]) for x in r] == [("a", 3, 1)]


@pytest.mark.parametrize("mode", ["metric", "loss"])
def test_early_stop_across_chunks(spark, mode):
    e = fx.table(spark, SF_SMALL, "events").select(F.col("user_id").alias("run"), "event_id", "ts", "value")
    log = L.log_steps(e, "run", ["ts", "event_id"])
    got = {(r["run"], r["step"]): (r["improved"], r["counter"], r["stop"], r["best"])
           for r in L.early_stop(log, "run", 3, mode=mode, chunk=4).collect()}
    want = {}
    for run, rows in _group(log.select("run", "step", "value").collect()).items():
        best, counter = (float("inf") if mode == "loss" else 0.0), 0
        for r in sorted(rows, key=lambda x: x["step"]):
            better = r["value"] < best if mode == "loss" else r["value"] > best
            if better:
                best, counter = r["value"], 0
            else:
                counter += 1
            want[(run, r["step"])] = (better, counter, counter > 3, best)
    assert got == want


def test_stream_index_is_incremental(spark):
    from spire.streaming import stream as Z
    docs = fx.documents(spark, SF_SMALL)
    src = Z.fresh_dir(spark, "t-inc-src")
    out = Z.fresh_dir(spark, "t-inc-out")
    Z.split_into_files(docs.where(F.col("doc_id") % 3 != 0), "doc_id", 3, src)
    first = Z.stream_index(spark, src, docs.schema, out)
    seen = {r["batch_id"] for r in first.select("batch_id").distinct().collect()}
    Z.split_into_files(docs.where(F.col("doc_id") % 3 == 0), "doc_id", 2, src, mode="append")
    got = Z.stream_index(spark, src, docs.schema, out)
    new_docs = {r["doc_id"] for r in got.where(~F.col("batch_id").isin(list(seen))).select("doc_id").distinct().collect()}
    arrived = {r["doc_id"] for r in docs.where(F.col("doc_id") % 3 == 0).select("doc_id").collect()}
    assert new_docs == arrived            # the rerun processed only the new files
    batch = S.lexical_encode(docs, "doc_id", "text")
    assert _rows(got, ["doc_id", "dim", "weight"]) == _rows(batch, ["doc_id", "dim", "weight"])


def test_row_ids_with_a_hot_group(spark):
    from spire.operators.rowids import assign_row_ids
    n = 3000
    df = spark.range(n).select(F.when(F.col("id") % 3 == 0, F.lit("hot"))
                               .otherwise(F.concat(F.lit("g"), (F.col("id") % 97).cast("string"))).alias("g"),
                               F.col("id").alias("k"))
    r = assign_row_ids(df, ["k"], group=["g"], partitions=8)
    per = {}
    for row in r.collect():
        per.setdefault(row["g"], []).append((row["k"], row["row_id"]))
    for g, rows in per.items():
        rows.sort()
        assert [x[1] for x in rows] == list(range(len(rows))), g
    assert len(per["hot"]) == n // 3
    # the hot group is spread over several range partitions
    spread = r.where(F.col("g") == "hot").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1


def test_query_blocks_on_bucketed_index(spark):
    import uuid
    from spire.session import scratch_path
    q = fx.query_terms(spark, SF_SMALL)
    name = f"pb_{uuid.uuid4().hex[:8]}"
    ix.write_postings(fx.postings(spark, SF_SMALL), scratch_path(spark, name), name, 4)
    p = ix.read_postings(spark, name)
    assert _scores(R.score(q, fx.postings(spark, SF_SMALL))) == _scores(R.score(q, p, block_bytes=60_000))
    assert len(R.query_blocks(q, "qid", 60_000)) >= 3
