"""X15 retry path and the F11/F12 functions on hand-made decoder outputs."""

from spire.functions import text as T
from spire.operators.rewrite import rewrite_queries


def _gen(outputs):
    def fn(batches):
        for pdf in batches:
            yield pdf[["row_id"]].assign(generated=pdf["row_id"].map(outputs))
    return fn


def test_retry_only_short_rewrites(spark):
    prompts = spark.createDataFrame([(0, "p0"), (1, "p1"), (2, "p2")], "row_id long, prompt string")
    first = {0: "prompt # Re-written query:\nRe-written query: \"what is spark sql\"", 1: "# Re-written query: ok",
             2: "# Re-written query:\n\n'"}
    second = {1: "# Re-written query: what does ok mean", 2: "# Re-written query: still"}
    out = {r["row_id"]: (r["rewrite"], r["retried"])
           for r in rewrite_queries(prompts, _gen(first), _gen(second)).collect()}
    assert out == {0: ("what is spark sql", False), 1: ("what does ok mean", True), 2: ("still", True)}


def test_extract_rewrite_cases(spark):
    rows = [("a # Re-written query: x\n # Re-written query:\n\n  Re-Written Query (final): 'tell me more'  \nmore",),
            ("no marker here\nsecond",), ("\"\"",), ("# Re-written query:",)]
    df = spark.createDataFrame(rows, "g string").select(T.extract_rewrite("g").alias("r"),
                                                       T.needs_retry(T.extract_rewrite("g")).alias("n"))
    got = [(r["r"], r["n"]) for r in df.collect()]
    assert got == [("tell me more", False), ("no marker here", False), ("", True), ("", True)]


def test_dataset_label(spark):
    paths = ["/data/msmarco/train_queries/raw.tsv", "/data/msmarco/dev/raw.tsv", "/x/MSMarco-v2/dev_2/q.tsv",
             "/x/ikat24/q.tsv", "/x/ikat23/q.tsv", "/x/trec2020/q", "/x/qrecc/q", "/x/other"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r["l"] for r in df.select(T.dataset_label("p").alias("l")).collect()]
    assert got == ["MSMARCO_TRAIN", "MSMARCO", "MSMARCO_v2_dev2", "ikat24", "ikat", "TREC_DL_2020", "QRECC",
                   "other_dataset"]
