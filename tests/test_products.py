"""Retrieval by matrix products equals retrieval by the join."""

import random
import struct

import numpy as np
import pyarrow as pa
import pytest

from spire.operators import products as X
from spire.operators import pruned as B
from spire.operators import retrieve as R
from tests.test_blocks import skewed
from tests.test_plans import _nodes, _plan


@pytest.fixture
def forms(spark, monkeypatch):
    """Runs a retrieval by the join, then by products."""
    calls, real = [], X.retrieve
    monkeypatch.setattr(X, "retrieve", lambda *a: calls.append(1) or real(*a))

    def run(make):
        out = []
        calls.clear()
        for few in ("1000000000000000", "0"):
            spark.conf.set("spark.spire.fewProducts", few)
            out.append(sorted(tuple(r[c] for c in ("qid", "rank", "did", "score")) for r in make().collect()))
        assert len(calls) == 1
        return out
    yield run
    spark.conf.unset("spark.spire.fewProducts")


def copies(spark, seed=4):
    """A third of the documents are copies of one, ids are shuffled, one is
    null, entries repeat, and some documents share nothing with some queries."""
    rng = random.Random(seed)
    docs = []
    for d in range(240):
        entries = [(1, 0.5), (2, 0.25)] if d % 3 == 0 else [(rng.randrange(30), rng.randrange(1, 9) / 8) for _ in range(4)]
        docs += [(None if d == 5 else (d * 7919) % 1000, dim, w) for dim, w in entries]
    queries = [(f"q{i}", dim, rng.randrange(1, 9) / 8) for i in range(20) for dim in rng.sample(range(32), 5)] + [("q0", 1, 0.5), (None, 1, 1.0), ("alone", 99, 1.0), ("no dim", None, 1.0)]
    return (spark.createDataFrame(queries, "qid string, dim int, weight double").repartition(3),
            spark.createDataFrame(docs, "did long, dim int, weight double").repartition(4))


def order(rows):
    return sorted(rows, key=lambda r: (str(r[0]), r[1]))


@pytest.mark.parametrize("tie", ["asc", "desc"])
@pytest.mark.parametrize("k, threshold, digits", [(7, None, None), (7, 0.4, 6), (1000, 0.0, None), (1, None, 1)])
def test_products_equal_the_join(spark, forms, monkeypatch, tie, k, threshold, digits):
    monkeypatch.setattr(X, "BLOCK_BYTES", 16 * 8 * 31)  # many blocks and chunks
    monkeypatch.setattr(X, "CHUNK_BYTES", 40_000)
    q, p = copies(spark)

    def make():
        return R.retrieve(q.fillna({"qid": "null"}), p.fillna({"did": 5000}), k, threshold, tie=tie, digits=digits)
    join, products = forms(make)
    assert order(products) == order(join) and len(join) > 20


def test_null_ids_are_one_query_and_one_document(spark, forms):
    q, p = copies(spark)
    by_id = []
    for tie in ("asc", "desc"):
        for few in ("1000000000000000", "0"):
            spark.conf.set("spark.spire.fewProducts", few)
            by_id.append(order(tuple(r) for r in R.retrieve(q, p, 300, None, tie=tie).select("qid", "rank", "did", "score").collect()))
    assert by_id[0] == by_id[1] and by_id[2] == by_id[3]
    assert any(r[0] is None for r in by_id[0]) and any(r[2] is None for r in by_id[0])


def test_shards_and_query_blocks(spark, forms):
    rng = random.Random(2)
    p = spark.createDataFrame([(d, d % 4, rng.randrange(12), rng.randrange(1, 9) / 4) for d in range(200) for _ in range(3)], "did long, shard int, dim int, weight double")
    q = spark.createDataFrame([(i, s, rng.randrange(12), rng.randrange(1, 9) / 4) for i in range(30) for s in (i % 4, (i + 1) % 4) for _ in range(3)],
                              "qid long, shard int, dim int, weight double")
    join, products = forms(lambda: R.retrieve(q, p, 5, None, extra_keys=["shard"]))
    assert join == products
    assert len(R.query_blocks(q, "qid", 2000)) > 1
    join, products = forms(lambda: R.retrieve(q, p, 5, None, extra_keys=["shard"], block_bytes=2000))
    assert join == products


def test_weights_that_products_cannot_hold_go_by_the_join(spark, forms):
    q = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.0)], "qid long, dim int, weight double")
    for odd in (0.0, -1.0, float("nan"), float("inf"), None, struct.unpack("d", struct.pack("Q", 1))[0]):
        p = spark.createDataFrame([(1, 0, odd), (2, 1, 1.0)], "did long, dim int, weight double")
        spark.conf.set("spark.spire.fewProducts", "0")
        found = R.retrieve(q, p, 5, None)
        assert "MapInArrow" not in [n for n, _ in _nodes(_plan(found))] and found.count() == 2


def test_best_holds_k_of_a_query():
    """What a task keeps does not grow with the documents, however many tie."""
    rng = np.random.default_rng(1)
    best, every = X.Best(3, 10, 6, "asc"), []
    ids = rng.permutation(60_000)
    for a in range(0, 60_000, 500):
        part = ids[a:a + 500]
        scores = rng.integers(0, 4, (3, 500)) / 4 + rng.integers(0, 2, (3, 500)) * 1e-9
        at, of = np.nonzero(scores >= 0)
        best.add(at, scores[at, of], pa.array(part[of]))
        every += [(r, -round(s, 6), int(part[o])) for r, s, o in zip(at.tolist(), scores[at, of].tolist(), of.tolist())]
        assert best.held <= best.most + 1500
    rows, scores, found = best.trim()
    got = sorted((r, -round(s, 6), i) for r, s, i in zip(rows.tolist(), scores.tolist(), found.to_pylist()))
    assert got == [x for r in range(3) for x in sorted(e for e in every if e[0] == r)[:10]]


@pytest.mark.parametrize("tie, seeds, block_bytes", [("asc", (1, 2), None), ("desc", (), 2500)])
def test_pruned_retrieval_by_products(spark, forms, monkeypatch, tie, seeds, block_bytes):
    q, p = skewed(spark, 1500)
    index = B.block_index(p, block_docs=32)
    expected = sorted((r["qid"], r["rank"], r["did"], round(r["score"], 9)) for r in R.retrieve(q, p, 5, 0.1, tie=tie).collect())
    calls, real = [], X.open_blocks
    monkeypatch.setattr(X, "open_blocks", lambda *a: calls.append(1) or real(*a))
    found = []
    for few in ("1000000000000000", "0"):
        spark.conf.set("spark.spire.fewProducts", few)
        pruned = B.retrieve_pruned(q, index, 5, 0.1, tie=tie, seeds=seeds, block_bytes=block_bytes)
        assert sorted((r["qid"], r["rank"], r["did"], round(r["score"], 9)) for r in pruned.run.collect()) == expected
        found.append(sorted(tuple(r) for r in pruned.opened.select("qid", "block", "round").collect()))
    assert calls and found[0] == found[1]
    assert len(found[0]) < 25 * index.bounds.select("block").distinct().count() / 2


@pytest.mark.parametrize("scale", [1.0, 1e-60])
@pytest.mark.parametrize("k, threshold", [(5, None), (5, 3.0), (60, None), (60, 3.0)])
def test_the_screen_loses_no_near_tie(monkeypatch, k, threshold, scale):
    """Scores that single precision cannot tell apart, or hold, are ranked as the exact ones are."""
    monkeypatch.setattr(X, "BLOCK_BYTES", 64 * 8 * 8)
    rng = np.random.default_rng(3)
    q, d = rng.random((150, 8)) + 0.5, np.repeat(rng.random((40, 8)) + 0.5, 10, axis=0) * (1 + rng.random((400, 1)) * 1e-8)
    q, ids, threshold = q * scale, pa.array(rng.permutation(400)), threshold and threshold * scale
    batches = [pa.RecordBatch.from_arrays([pa.array([0]), X._one(pa.array(range(150))), pa.array([q.tobytes()]), X._one(ids.slice(a, 100)), pa.array([d[a:a + 100].tobytes()])],
                                          names=["q_no", "q_ids", "q_data", "d_ids", "d_data"]) for a in range(0, 400, 100)]
    found = pa.Table.from_batches(X._find(k, threshold, None, "asc", 8, ranked=True)(iter(batches)))
    got = list(zip(*(found.column(c).to_pylist() for c in ("q", "rank", "d", "score"))))
    expected = []
    for i in range(150):
        scores = X._dots(q, d, np.full(400, i), np.arange(400)).tolist()
        best = sorted((-s, e) for s, e in zip(scores, ids.to_pylist()) if threshold is None or s > threshold)[:k]
        expected += [(i, r, e, -s) for r, (s, e) in enumerate(best, 1)]
    assert sorted(got) == expected


def test_postings_are_packed_once_and_runs_are_stored(spark, monkeypatch):
    """Micro-batches over the same postings, with other dimensions each, share the packed documents."""
    packs, real = [], X.packed
    monkeypatch.setattr(X, "packed", lambda *a: packs.append(a[5]) or real(*a))
    q, p = copies(spark)
    p = p.fillna({"did": 5000})
    parts = [q.where("dim < 12"), q.where("dim >= 8")]
    spark.conf.set("spark.spire.fewProducts", "1000000000000000")
    expected = [sorted(map(tuple, R.retrieve(b, p, 4, None).select("qid", "rank", "did", "score").fillna({"qid": "null"}).collect())) for b in parts]
    spark.conf.set("spark.spire.fewProducts", "0")
    try:
        once: dict = {}
        runs = [R.retrieve(b, p, 4, None, once=once) for b in parts]
    finally:
        spark.conf.unset("spark.spire.fewProducts")
    assert packs.count("d") == 1 and packs.count("q") == 2
    assert [sorted(map(tuple, r.select("qid", "rank", "did", "score").fillna({"qid": "null"}).collect())) for r in runs] == expected
    assert "MapInArrow" not in [n for n, _ in _nodes(_plan(runs[0]))]


def test_query_blocks_of_products_are_one_job(spark, monkeypatch):
    """Blocks are rows of packed queries of at most ``block_bytes``, not runs one after another."""
    q, p = copies(spark)
    names, rows, real, past = [], [], R.stored, X._past
    monkeypatch.setattr(R, "stored", lambda df, name: names.append(name) or real(df, name))
    monkeypatch.setattr(X, "_past", lambda packed, *a: rows.extend(packed.collect()) or past(packed, *a))
    spark.conf.set("spark.spire.fewProducts", "0")
    try:
        assert len(R.query_blocks(q.select("qid", "dim", "weight"), "qid", 1000)) > 1
        R.retrieve(q, p, 5, None, block_bytes=1000)
    finally:
        spark.conf.unset("spark.spire.fewProducts")
    assert names == ["run"]
    assert len(rows) > 1 and all(len(r["q_data"]) <= 1000 for r in rows)


def test_evaluation_at_ten_joins_ten_ranks(spark):
    """Of a run of 1000 a query only the ranks that are measured meet the qrels."""
    from spire.plans import QUERIES, load_all
    from tests.conftest import SF_SMALL
    load_all()
    plan = QUERIES["evaluate_retrieval"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "<= 10)" in plan


def test_best_cuts_early():
    """The cut follows the documents, so that few pairs are summed a second time."""
    best = X.Best(100, 10, 6, "asc")
    rng = np.random.default_rng(3)
    q, d = X._Block(rng.random((100, 8))), rng.random((20_000, 8))
    offered, add = [], best.add
    best.add = lambda rows, scores, ids: offered.append(len(rows)) or add(rows, scores, ids)
    for a in range(0, len(d), 500):
        X._meet(best, q, X._Block(d[a:a + 500]), pa.array(np.arange(a, a + 500)), None)
    assert sum(offered) < 100 * 10 * 20
    rows, scores, ids = best.trim()
    exact = q.values @ d.T
    assert [sorted(ids.to_numpy()[rows == i].tolist()) for i in range(100)] == np.sort(np.argsort(-exact, axis=1)[:, :10], axis=1).tolist()


@pytest.mark.parametrize("values, single", [([0.0, 1.0], True), ([0.0, 0.0], True), ([1e-15, 1e15], True), ([0.0, 1e-16], False), ([1.0, 1e16], False), ([1.0, 1e-60], False), ([1.0, 1e60], False)])
def test_single_precision_only_where_it_holds(values, single):
    assert (X._Block(np.array([values])).single is not None) == single


@pytest.mark.parametrize("rows, share", [(3, 0.0), (7, 0.01), (5, 0.5), (1, 1.0)])
def test_places_of_a_mask(rows, share):
    mask = np.random.default_rng(rows).random((rows, 37)) < share
    assert X._places(mask).tolist() == np.flatnonzero(mask).tolist()


def test_a_stream_writes_its_run_once(spark, tmp_path, monkeypatch):
    """A micro-batch goes straight to the sink: no second copy in scratch storage."""
    from spire.streaming import stream as Z
    names, real = [], R.stored
    monkeypatch.setattr(R, "stored", lambda df, name: names.append(name) or real(df, name))
    rng = random.Random(6)
    rows = [(i, dim, rng.randrange(1, 9) / 8) for i in range(40) for dim in rng.sample(range(12), 4)]
    q, p = spark.createDataFrame(rows, "qid long, dim int, weight double"), spark.createDataFrame(rows, "did long, dim int, weight double")
    expected = sorted(map(tuple, R.retrieve(q, p, 3, None).select("qid", "did", "score", "rank").collect()))
    q.repartition(2, "qid").write.parquet(f"{tmp_path}/in")
    spark.conf.set("spark.spire.fewProducts", "0")
    try:
        run = Z.stream_retrieve(spark, f"{tmp_path}/in", q.schema, p, lambda b: b, f"{tmp_path}/out", k=3)
    finally:
        spark.conf.unset("spark.spire.fewProducts")
    assert names == [] and sorted(map(tuple, run.select("qid", "did", "score", "rank").collect())) == expected


def test_opened_blocks_are_bits_and_rows_hold_many_blocks(spark, monkeypatch):
    """A row of queries moves with every row of documents, so what it opens is a bit for each query and block."""
    q, p = skewed(spark, 1500)
    index = B.block_index(p, block_docs=32)
    postings = index.postings.withColumnRenamed("weight", "_dw")
    asked = q.select("qid", "dim", q["weight"].alias("_qw"))
    cols = sorted({(r["dim"],) for r in p.select("dim").distinct().collect()})
    docs, blocks = X.packed_blocks(postings, cols, "did"), index.bounds.select("block").distinct()
    pairs, rows, past = asked.select("qid").distinct().crossJoin(blocks), [], X._past
    monkeypatch.setattr(X, "_past", lambda packed, *a, **b: rows.extend(packed.collect()) or past(packed, *a, **b))
    found = X.open_blocks(asked, pairs, docs, cols, "qid", "did", postings.schema["did"].dataType, 5, None, "asc", None)
    n = blocks.count()
    assert n > 40 and rows
    for r in rows:
        moved = sum(8 * len(v) if isinstance(v, list) else len(v) for v in r.asDict().values() if not isinstance(v, int))
        assert moved <= len(r["q_data"]) + 8 * len(r["q_ids"]) + n * (8 + (len(r["q_ids"]) + 7) // 8)
    larger = X._gathered(docs.drop("d_no").coalesce(1), len(cols)).select("d_ids", "block").collect()
    assert len(larger) < n / 2 and all(len(r["d_ids"]) == len(r["block"]) for r in larger)
    assert sorted((d, b) for r in larger for d, b in zip(r["d_ids"], r["block"])) == sorted((r["did"], r["block"]) for r in postings.select("did", "block").distinct().collect())
    got = sorted((r["qid"], r["rank"], r["did"], round(r["score"], 9)) for r in R.topk(found, 5).collect())
    assert got == sorted((r["qid"], r["rank"], r["did"], round(r["score"], 9)) for r in R.retrieve(q, p, 5, None).collect())


@pytest.mark.parametrize("threshold", [None, 3.0])
def test_documents_are_held_in_parts(monkeypatch, threshold):
    """For a large k a task holds some documents, and the best of a query over all of them."""
    monkeypatch.setattr(X, "BLOCK_BYTES", 64 * 8 * 8)
    monkeypatch.setattr(X, "HELD_BYTES", 150 * 8 * 8)
    monkeypatch.setattr(X, "SCORE_BYTES", 8 * 2000)
    rng, met, real = np.random.default_rng(5), [], X._meet
    q, d, ids = rng.random((150, 8)), np.repeat(rng.random((450, 8)), 2, axis=0), pa.array(rng.permutation(900))
    batches = [pa.RecordBatch.from_arrays([pa.array([0]), X._one(pa.array(range(150))), pa.array([q.tobytes()]), X._one(ids.slice(a, 100)), pa.array([d[a:a + 100].tobytes()])],
                                          names=["q_no", "q_ids", "q_data", "d_ids", "d_data"]) for a in range(0, 900, 100)]
    monkeypatch.setattr(X, "_meet", lambda best, part, d, *a: met.append(len(d)) or real(best, part, d, *a))
    found = pa.Table.from_batches(X._find(60, threshold, None, "asc", 8, ranked=True)(iter(batches)))
    got = sorted(zip(*(found.column(c).to_pylist() for c in ("q", "rank", "d"))))
    assert max(met) == 200
    expected = []
    for i in range(150):
        scores = X._dots(q, d, np.full(900, i), np.arange(900)).tolist()
        expected += [(i, r, e) for r, (_, e) in enumerate(sorted((-s, e) for s, e in zip(scores, ids.to_pylist()) if threshold is None or s > threshold)[:60], 1)]
    assert got == sorted(expected)


def test_a_deep_run_is_neither_exchanged_nor_kept_whole(spark, monkeypatch):
    """Documents of some chunks of 64 MB are one broadcast, ranked in the task; of a run of which ten ranks are read ten are stored."""
    q, p = copies(spark)
    p, kept, past = p.fillna({"did": 5000}), [], X._past
    monkeypatch.setattr(R, "stored", lambda df, name: kept.append(df) or df)
    monkeypatch.setattr(X, "_past", lambda q, docs, chunks, *a: past(q, docs, kept.append(chunks) or chunks, *a))
    assert X.CHUNK_BYTES >= 6 * 102_564 * 64 * 8 and X.BEST_BYTES // (X.PAIR_BYTES * 1000) >= 500
    expected = sorted((str(r["qid"]), r["rank"], r["did"]) for r in R.retrieve(q, p, 1000, None).collect() if r["rank"] <= 10)
    spark.conf.set("spark.spire.fewProducts", "0")
    try:
        run, lazy = R.retrieve(q, p, 1000, None, keep=10), R.retrieve(q, p, 1000, None, keep=False)
    finally:
        spark.conf.unset("spark.spire.fewProducts")
    assert [x for x in kept if isinstance(x, int)] == [1, 1] and len(kept) == 3
    assert sorted((str(r["qid"]), r["rank"], r["did"]) for r in run.collect()) == expected
    nodes = [(n, node.toString().split("\n")[0]) for n, node in _nodes(_plan(lazy))]
    assert all("REPARTITION_BY_NUM" in text for n, text in nodes if n == "Exchange") and "Window" not in dict(nodes)
    assert lazy.where("rank > 10").count() > 0


def test_rows_of_queries_are_small_for_a_large_k(spark, monkeypatch):
    """What a task holds of the best does not grow with the queries."""
    q, p = copies(spark)
    rows, past = [], X._past
    monkeypatch.setattr(X, "BLOCK_BYTES", 16 * 8 * 31)
    monkeypatch.setattr(X, "BEST_BYTES", 2 * X.PAIR_BYTES * 300)
    monkeypatch.setattr(X, "_past", lambda packed, *a: rows.extend(packed.collect()) or past(packed, *a))
    expected = order([tuple(r) for r in R.retrieve(q, p, 300, None).select("qid", "rank", "did", "score").collect()])
    spark.conf.set("spark.spire.fewProducts", "0")
    try:
        run = R.retrieve(q, p, 300, None)
    finally:
        spark.conf.unset("spark.spire.fewProducts")
    assert rows and max(len(r["q_ids"]) for r in rows) <= 2
    assert order([tuple(r) for r in run.select("qid", "rank", "did", "score").collect()]) == expected
