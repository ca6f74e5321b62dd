"""What a task takes stays small while the input grows."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from spire.operators import dense as D
from spire.operators import index_files as files
from spire.operators import layout
from spire.operators import rewrite as W
from spire.operators import sparse as S
from spire.session import scratch_path
from spire.streaming import growing as G
from spire.streaming import stream as Z


def test_files_of_a_stream_follow_its_size(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 100)").alias("text")).unionByName(
        spark.createDataFrame([(None, None), (7, "another text of this id")], "doc_id long, text string"))
    assert layout.parts_for(docs, 8) == 8
    monkeypatch.setattr(layout, "PART_BYTES", 10_000)
    path = Z.split_into_files(docs, "doc_id", 2, scratch_path(spark, "files"))
    read = spark.read.parquet(path)
    per_file = [r["count"] for r in read.groupBy(F.input_file_name()).count().collect()]
    assert read.count() == 402 and len(per_file) > 10 and max(per_file) < 60
    assert read.where("doc_id = 7").select(F.input_file_name()).distinct().count() == 1  # a document lies in one file
    size = Z.batch_bytes_for(spark, path, 1, 4)
    assert size * 4 >= sum(f.size for f in _files(path)) > size * 3 and Z.batch_bytes_for(spark, path, 4 << 20, 4) == 4 << 20


def _files(path):
    from pyarrow import fs
    return [f for f in fs.LocalFileSystem().get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith((".", "_"))]


def test_buckets_follow_the_postings():
    assert files.buckets_for(10, G.COMPACT_BYTES) == 1
    assert files.buckets_for(60_000_000, G.COMPACT_BYTES) > 40


def test_a_model_gets_few_texts_at_once(spark):
    texts = ["a b"] * 1500 + ["x" * 900_000, "y" * 900_000, None, ""]

    def encoder(batches):
        for pdf in batches:
            chars = sum(len(t or "") for t in pdf.iloc[:, 1])
            assert len(pdf) <= S.ENCODE_ROWS and (len(pdf) == 1 or chars <= S.ENCODE_CHARS)
            yield pd.DataFrame({"id": pdf.iloc[:, 0], "dim": 0, "weight": 1.0})

    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1)
    found = S.encode(df, encoder)
    assert sorted(r["id"] for r in found.collect()) == list(range(len(texts)))


def test_prompts_are_generated_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def once(batches):
        for pdf in batches:
            calls.add(len(pdf))
            yield pd.DataFrame({"row_id": pdf["row_id"], "generated": ['Re-written query: "what is this about"' if i % 2 else "" for i in pdf["row_id"]]})

    prompts = spark.range(20).select(F.col("id").alias("row_id"), F.lit("p").alias("prompt"))
    found = W.rewrite_queries(prompts, once, lambda batches: (pd.DataFrame({"row_id": b["row_id"], "generated": b["prompt"]}) for b in batches))
    assert found.count() == 20 and calls.value == 20


def test_dense_task_lets_out_k_rows_a_query():
    rng, blocks = np.random.default_rng(1), 40
    q, docs = rng.integers(-3, 4, (6, 5)).astype(np.float64), rng.integers(-3, 4, (blocks, 50, 5)).astype(np.float64)

    def ids(values):
        return pa.array([values], pa.list_(pa.int64()))

    def batches():
        for i, d in enumerate(docs):
            yield pa.RecordBatch.from_arrays([ids(list(range(i * 50, i * 50 + 50))), pa.array([d.tobytes()]), pa.array([5], pa.int32()),
                                              ids(list(range(6))), pa.array([q.tobytes()]), pa.array([5], pa.int32()), pa.array([0])],
                                             names=["d_ids", "d_data", "d_width", "q_ids", "q_data", "q_width", "q_no"])
    out = [r for b in D._best(7, 6, "asc", ("float64", "float64"))(batches()) for r in b.to_pylist()]
    scores = q @ docs.reshape(-1, 5).T
    assert len(out) == 6 * 7
    assert sorted((r["q"], -r["score"], r["d"]) for r in out) == [x for i in range(6) for x in sorted((i, -s, j) for j, s in enumerate(scores[i].tolist()))[:7]]
