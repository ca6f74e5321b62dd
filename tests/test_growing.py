"""Indexes on disk: manifest, growth by batches, replays, versions."""

import json

import pytest
from pyspark.sql import functions as F

from spire.operators import index as ix
from spire.operators import retrieve as R
from spire.operators import sparse as S
from spire.operators.index_files import buckets_for, open_index, write_index
from spire.session import scratch_path
from spire.streaming import growing as G

DOCS = [(i, f"word{i % 7} word{i % 3} common " + "extra " * (i % 4)) for i in range(40)] + [(90, ""), (91, "?!")]
SCHEMA = "doc_id long, text string"


def made(spark, docs=DOCS):
    return spark.createDataFrame(docs, SCHEMA)


def built(spark, docs):
    d = made(spark, docs)
    return ix.build_index(S.lexical_encode(d, "doc_id", "text"), d.select("doc_id"), "doc_id")


def by_id(postings, ids):
    named = postings.join(ids.select(F.col("row_id").alias("did"), "id"), "did")
    return sorted((r["id"], r["dim"], round(r["weight"], 5)) for r in named.collect())


def test_index_opens_in_another_session_without_a_layout(spark):
    postings, ids, _ = built(spark, DOCS)
    path = scratch_path(spark, "written")
    wrote = write_index(postings, ids, path, buckets=5, more={"note": "kept"})
    other = spark.newSession()
    index = open_index(other, path)
    assert index.manifest == json.loads(json.dumps(wrote)) and index.manifest["buckets"] == 5 and index.manifest["documents"] == len(DOCS)
    assert index.manifest["note"] == "kept" and index.manifest["longest"] == 40
    assert by_id(index.postings, index.ids) == by_id(postings, ids)
    plan = index.postings.groupBy("did").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Bucketed: true" in plan
    again = write_index(postings, ids, path)  # another layout over the first
    assert again["buckets"] == 1 and by_id(open_index(spark, path).postings, ids) == by_id(postings, ids)


def test_half_written_index_is_refused(spark):
    postings, ids, _ = built(spark, DOCS)
    path = scratch_path(spark, "half")
    with pytest.raises(ValueError, match="no complete index"):
        open_index(spark, path)
    write_index(postings, ids, path, buckets=3)
    broken = ids.withColumn("id", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        write_index(postings, broken, path, buckets=2)
    with pytest.raises(ValueError, match="no complete index"):
        open_index(spark, path)
    write_index(postings, ids, path, buckets=3)
    ids.limit(3).write.mode("overwrite").parquet(f"{path}/ids")
    with pytest.raises(ValueError, match="does not hold"):
        open_index(spark, path)


def test_buckets_follow_the_size():
    assert buckets_for(0) == 1 and buckets_for(10**9) == 90 and buckets_for(10**13) == 100_000


def grow(spark, parts):
    """A stream of which each part arrives before one run."""
    src, out = scratch_path(spark, "arrivals"), scratch_path(spark, "index")
    for part in parts:
        made(spark, part).coalesce(1).write.mode("append").parquet(src)
        now = G.stream_growing_index(spark, src, made(spark).schema, out)
    return src, out, now


def test_growing_index_equals_one_index(spark):
    src, out, now = grow(spark, [DOCS[:10], DOCS[10:11], DOCS[11:]])
    postings, ids, stats = built(spark, DOCS)
    assert now.number == 2 and by_id(now.postings, now.ids) == by_id(postings, ids)
    assert sorted(r[0] for r in now.ids.select("row_id").collect()) == list(range(len(DOCS)))
    one = stats.first()
    got = now.stats.first()
    assert got["n_docs"] == one["n_docs"] and got["l0"] == pytest.approx(one["l0"]) and got["l1"] == pytest.approx(one["l1"], abs=1e-5)
    old = G.snapshot(spark, out, 0)
    assert old.documents == 10 and by_id(old.postings, old.ids) == by_id(*built(spark, DOCS[:10])[:2])


def test_replays_count_once(spark):
    src, out, now = grow(spark, [DOCS[:10], DOCS[10:20]])
    before = by_id(now.postings, now.ids), now.documents, now.nnz, now.l1_sum
    encode = lambda b: S.lexical_encode(b, "doc_id", "text")
    G._write_batch(made(spark, DOCS[10:20]), 1, out, encode, "doc_id")
    made(spark, DOCS[:3]).select(F.col("doc_id").alias("local_id"), F.lit("cut off").alias("dim"), F.lit(1.0).cast("float").alias("weight")) \
        .write.parquet(f"{out}/postings/batch_id=2")  # a batch that did not end
    for _ in range(2):
        now = G.snapshot(spark, out)
        assert (by_id(now.postings, now.ids), now.documents, now.nnz, now.l1_sum) == before
        now = G.compact(spark, out, 2)
        assert (by_id(now.postings, now.ids), now.documents, now.nnz, now.l1_sum) == before
    G._write_batch(made(spark, DOCS[20:]), 2, out, encode, "doc_id")
    after = G.snapshot(spark, out)
    assert after.documents == len(DOCS) and by_id(after.postings, after.ids) == by_id(*built(spark, DOCS)[:2])
    assert G.snapshot(spark, out, 1).documents == 20 and G.newest(spark, out) == 2


def test_repeated_ids(spark):
    out = scratch_path(spark, "repeated")
    encode = lambda b: S.lexical_encode(b, "doc_id", "text")
    with pytest.raises(ValueError, match="repeated ids"):
        G._write_batch(made(spark, [(1, "a"), (1, "b")]), 0, out, encode, "doc_id")
    with pytest.raises(ValueError, match="no complete batch"):
        G.snapshot(spark, out)
    G._write_batch(made(spark, [(1, "a")]), 0, out, encode, "doc_id")
    G._write_batch(made(spark, [(1, "b")]), 1, out, encode, "doc_id")
    with pytest.raises(ValueError, match="repeated ids"):
        G.compact(spark, out)


def test_queries_read_the_version_of_their_start(spark):
    """Documents arrive between batches of queries; a replayed batch keeps its version."""
    docs_src, index, _ = grow(spark, [DOCS[:10]])
    src, out = scratch_path(spark, "queries"), scratch_path(spark, "answers")
    terms = lambda b: S.lexical_encode(b, "doc_id", "text", kind="query").withColumnRenamed("doc_id", "qid")
    queries = [[(1, "common word1")], [(2, "common word2")], [(3, "common extra")]]
    upto = [10, 25, 25]
    for i, batch in enumerate(queries):
        made(spark, batch).coalesce(1).write.mode("append").parquet(src)
        run = G.stream_retrieve_growing(spark, src, made(spark).schema, index, terms, out, k=8, digits=6)
        if i == 0:
            made(spark, DOCS[10:25]).coalesce(1).write.mode("append").parquet(docs_src)
            G.stream_growing_index(spark, docs_src, made(spark).schema, index)
        if i == 1:
            G.compact(spark, index, 2)
    got = {}
    for r in run.collect():
        got.setdefault((r["qid"], r["snapshot"]), []).append((r["rank"], r["id"], r["score"]))
    assert sorted(got) == [(1, 0), (2, 1), (3, 1)]
    for key, batch, n in zip(sorted(got), queries, upto):
        postings, ids = built(spark, DOCS[:n])[:2]
        full = R.translate_ids(R.retrieve(terms(made(spark, batch)), postings, k=8, threshold=0.0, digits=6), ids, "did")
        assert sorted(got[key]) == sorted((r["rank"], r["did"], r["score"]) for r in full.collect())
    assert G.pinned(spark, index, out, 0) == 0 and G.pinned(spark, index, out, 1) == 1
