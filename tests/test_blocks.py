"""Block retrieval: pruned top-k, dense blocks, routed shard folders."""

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from spire.operators import dense as D
from spire.operators import index as ix
from spire.operators import pruned as B
from spire.operators import retrieve as R
from spire.operators import sparse as S
from spire.plans import fixtures as fx
from spire.session import scratch_path
from tests.conftest import SF_SMALL
from tests.test_plans import _nodes, _plan


def rows(run):
    return sorted((r["qid"], r["rank"], r["did"], round(r["score"], 6)) for r in run.collect())


def skewed(spark, n_docs=3000, topics=30, seed=1):
    """Documents about one topic each, words of uneven weight, one dimension in
    every document and a third of the documents in one topic."""
    rng = random.Random(seed)
    docs, queries = [], []
    for d in range(n_docs):
        t = 0 if d % 3 == 0 else rng.randrange(topics)
        docs.append((d, 0, 0.05))
        for dim in rng.sample(range(1 + 20 * t, 21 + 20 * t), 6):
            docs.append((d, dim, rng.paretovariate(2.0)))
    for q in range(25):
        t = rng.randrange(topics)
        queries += [(q, 0, 0.1)] + [(q, dim, rng.random() + 0.2) for dim in rng.sample(range(1 + 20 * t, 21 + 20 * t), 5)]
    return (spark.createDataFrame(queries, "qid long, dim int, weight double"), spark.createDataFrame(docs, "did long, dim int, weight double"))


def test_pruned_equals_full_and_opens_few(spark):
    q, p = skewed(spark)
    index = B.block_index(p, block_docs=32)
    n_blocks = index.bounds.select("block").distinct().count()
    for k, threshold in ((10, None),):
        got = B.retrieve_pruned(q, index, k=k, threshold=threshold)
        assert rows(got.run) == rows(R.retrieve(q, p, k=k, threshold=threshold))
        opened = got.opened.count()
        # the hot dimension reaches every block, so without bounds all would be opened
        assert opened == got.opened.select("qid", "block").distinct().count()
        assert 0 < opened < 25 * n_blocks / 2, (opened, 25 * n_blocks)


def test_pruned_odd(spark):
    """Signs, ties over blocks, fewer documents than k, absent dims, many query blocks."""
    rng = random.Random(2)
    docs = [(d, dim, float(rng.choice([-2, -1, 1, 1, 2]))) for d in range(120) for dim in rng.sample(range(8), 3)] + [(500, 99, 1.0)]
    queries = [(f"q{i}", dim, float(rng.choice([-1, 1, 2]))) for i in range(12) for dim in rng.sample(range(8), 3)] + [("lone", 99, -1.0), ("none", 77, 1.0)]
    q, p = spark.createDataFrame(queries, "qid string, dim int, weight double"), spark.createDataFrame(docs, "did long, dim int, weight double")
    index = B.block_index(p, block_docs=7)
    for tie, seeds, block_bytes in (("asc", (1, 2), None), ("desc", (), 700)):
        expected = rows(R.retrieve(q, p, k=5, threshold=None, tie=tie))
        assert rows(B.retrieve_pruned(q, index, k=5, threshold=None, tie=tie, seeds=seeds, block_bytes=block_bytes).run) == expected
    assert rows(B.retrieve_pruned(q, index, k=5000, threshold=0.0, digits=6, seeds=(1,)).run) == rows(R.retrieve(q, p, k=5000, threshold=0.0, digits=6))


def test_few_blocks_prune_the_scan(spark):
    q, p = skewed(spark)
    index = B.block_index(p, block_docs=32)
    some = index.postings.where(F.col("block").isin([1, 2])).groupBy("block").count()
    text = some._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 2 out of" in text and "In(block, [1,2])" in text


def brute_dense(queries, docs, k):
    out = []
    for q, a in queries:
        if not a:
            continue
        scored = sorted(((-sum((x or 0) * (y or 0) for x, y in zip(a, b)), d) for d, b in docs if b))
        out += [(q, i, d, round(-s, 6) + 0.0) for i, (s, d) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_dense_blocks(spark):
    rng = np.random.default_rng(3)
    docs = [(d, [float(x) for x in rng.integers(-3, 4, 6)]) for d in range(300)] + [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [5.0] * 9)]
    queries = [(f"q{i}", [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(20)] + [("short", [1.0]), ("none", None)]
    d = spark.createDataFrame(docs, "did long, embedding array<float>").repartition(3)
    q = spark.createDataFrame(queries, "qid string, embedding array<double>")
    expected = brute_dense(queries, docs, 7)
    assert rows(D.dense_retrieve(q, d, 7)) == expected
    assert rows(D.dense_retrieve(q, d, 7, digits=6, block_bytes=300)) == expected
    assert rows(D.dense_retrieve(q, d, 7, query_bytes=800, block_bytes=300)) == expected
    assert D.dense_retrieve(q, d.limit(0), 7).count() == 0


def test_dense_plan_has_no_rows_of_components(spark):
    e = fx.table(spark, SF_SMALL, "embeddings")
    run = D.dense_retrieve(e.select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("did"), "embedding"), 10)
    names = [n for n, _ in _nodes(_plan(run))]
    assert "Generate" not in names and names.count("MapInArrow") == 3 and names.count("WindowGroupLimit") == 2
    shuffles = [node.toString().split("\n")[0] for n, node in _nodes(_plan(run)) if n == "Exchange"]
    assert len(shuffles) == 1 and "qid" in shuffles[0]


def test_bits_route_like_sets(spark):
    rng = random.Random(5)
    vec = spark.createDataFrame([(d, dim, rng.random()) for d in range(60) for dim in rng.sample(range(700), 12)], "vec_id long, dim int, weight double")
    shards = vec.select("vec_id").distinct().withColumn("shard", (F.col("vec_id") % 7).cast("int"))
    q = vec.select((F.col("vec_id") % 9).alias("qid"), "dim", "weight").dropDuplicates(["qid", "dim"])
    sets = ix.route(q, ix.shard_top_dims(vec, shards, "vec_id", 5), 3)
    bits = ix.route_words(q, ix.shard_dim_words(vec, shards, "vec_id", 5), 3)
    assert sorted(map(tuple, sets.collect())) == sorted(map(tuple, bits.select(*sets.columns).collect()))


def test_shard_folders_are_pruned_at_run_time(spark):
    v = fx.vectors(spark, SF_SMALL)
    shards = ix.shard_documents(v, "vec_id", 4, 100)
    path = scratch_path(spark, f"folders-{uuid.uuid4().hex[:6]}")
    ix.write_sharded_postings(ix.shard_postings(fx.postings(spark, SF_SMALL), shards.withColumnRenamed("vec_id", "did")), path)
    q = fx.query_terms(spark, SF_SMALL).where("qid < 20")
    routed = ix.route_words(S.encode_topk(q, "qid", 8), ix.shard_dim_words(v, shards, "vec_id", 100), 1)
    run = ix.retrieve_shard_folders(spark, q, routed, path, k=5, threshold=None)
    assert "dynamicpruning" in _plan(run).toString()
    post = ix.shard_postings(fx.postings(spark, SF_SMALL), shards.withColumnRenamed("vec_id", "did"))
    assert rows(run) == rows(ix.retrieve_sharded(q, routed, post, k=5, threshold=None))
    assert not math.isnan(run.agg(F.sum("score")).first()[0])
