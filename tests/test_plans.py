"""Physical-plan checks: the shapes the design relies on at scale."""

import uuid

from spire.operators import index as ix
from spire.operators import retrieve as R
from spire.operators import sparse as S
from spire.plans import fixtures as fx
from spire.session import scratch_path
from tests.conftest import SF_SMALL


def _nodes(plan):
    """Pre-order list of (name, node) of a JVM SparkPlan (AQE initial plan)."""
    out = []
    stack = [plan]
    while stack:
        n = stack.pop()
        name = n.nodeName()
        if name == "AdaptiveSparkPlan":
            stack.append(n.executedPlan())
            continue
        out.append((name, n))
        ch = n.children()
        for i in range(ch.size() - 1, -1, -1):
            stack.append(ch.apply(i))
    return out


def _plan(df):
    return df._jdf.queryExecution().executedPlan()


def _bucketed_run(spark):
    docs = fx.documents(spark, SF_SMALL)
    vec = S.lexical_encode(docs, "doc_id", "text")
    postings, _, _ = ix.build_index(vec, docs.select("doc_id"), "doc_id")
    name = f"postings_{uuid.uuid4().hex[:10]}"
    ix.write_postings(postings, scratch_path(spark, name), name, 4)
    q = S.lexical_encode(fx.benchmark(spark, SF_SMALL), "item_id", "text", kind="query") \
        .withColumnRenamed("item_id", "qid")
    return R.retrieve(q, ix.read_postings(spark, name), k=10, threshold=0.0)


def _path_to_scan(node):
    """Nodes from ``node`` down to the first file scan, following the
    non-broadcast (streamed) side of joins."""
    path = []
    while True:
        name = node.nodeName()
        path.append(name)
        if name.startswith("Scan"):
            return path
        ch = node.children()
        if ch.size() == 0:
            return path
        nxt = ch.apply(0)
        for i in range(ch.size()):
            if "Broadcast" not in ch.apply(i).nodeName():
                nxt = ch.apply(i)
                break
        node = nxt


def test_bucketed_retrieval_has_no_exchange_between_scan_and_aggregate(spark):
    run = _bucketed_run(spark)
    nodes = _nodes(_plan(run))
    names = [n for n, _ in nodes]
    assert names.count("WindowGroupLimit") == 2, names
    assert "BroadcastHashJoin" in names
    # the topmost aggregate is the final sum by (qid, did)
    agg = next(node for name, node in nodes if name == "HashAggregate")
    path = _path_to_scan(agg)
    assert path[-1].startswith("Scan"), path
    assert "Exchange" not in path, path
    # exactly one shuffle exchange above the aggregate: the one on qid for top-k
    shuffles = [n for n, node in nodes if n == "Exchange" and "hashpartitioning" in node.toString()]
    assert any("qid" in node.toString() for n, node in nodes if n == "Exchange")
    assert len(shuffles) >= 1


def test_parquet_scan_prunes_columns_and_pushes_filters(spark):
    run = R.retrieve(fx.query_terms(spark, SF_SMALL), fx.postings(spark, SF_SMALL), k=10, threshold=None)
    scans = [node for name, node in _nodes(_plan(run)) if name.startswith("Scan")]
    assert scans
    for s in scans:
        text = s.toString()
        assert "label" not in text  # unused column never read


def test_no_python_in_retrieval_and_metric_plans(spark):
    import __spark_entry__ as E
    for name in ["retrieve_topk", "evaluate_retrieval", "mrr_at_10", "fuse_runs", "history_queries",
                 "lexical_retrieve", "kl_divergence"]:
        df = E.queries()[name](spark, SF_SMALL)
        names = [n for n, _ in _nodes(_plan(df))]
        assert not any("Python" in n or "ArrowEval" in n or "BatchEval" in n for n in names), (name, names)


def test_top_k_uses_group_limit(spark):
    run = R.retrieve(fx.query_terms(spark, SF_SMALL), fx.postings(spark, SF_SMALL), k=10, threshold=None)
    names = [n for n, _ in _nodes(_plan(run))]
    assert names.count("WindowGroupLimit") == 2


def test_lexical_retrieval_shuffles_text_once_and_never_tokens(spark):
    import __spark_entry__ as E
    df = E.queries()["lexical_retrieve"](spark, SF_SMALL)
    exchanges = [node.toString().split("\n")[0] for name, node in _nodes(_plan(df)) if name == "Exchange"]
    keys = [e for e in exchanges if "hashpartitioning" in e]
    # documents by id, queries by id, top-k rows by qid — never by token/dim,
    # never by (qid, did) candidate pairs
    assert len(keys) == 3, keys
    assert not any("token" in e or "dim" in e for e in keys), keys
    assert not any("qid" in e and "did" in e for e in keys), keys


def test_query_blocks_never_shuffle_the_bucketed_index(spark):
    docs_q = fx.query_terms(spark, SF_SMALL)
    name = f"pb_{uuid.uuid4().hex[:10]}"
    ix.write_postings(fx.postings(spark, SF_SMALL), scratch_path(spark, name), name, 4)
    p = ix.read_postings(spark, name)
    scores = R.score(docs_q, p, block_bytes=60_000)            # several blocks
    nodes = _nodes(_plan(scores))
    aggs = [node for name_, node in nodes if name_ == "HashAggregate"]
    assert len(aggs) >= 3                                     # one final aggregate per block (and partials)
    for agg in aggs:
        path = _path_to_scan(agg)
        assert "Exchange" not in path, path


def test_no_pair_crosses_the_network_at_any_limit(spark):
    q, p = fx.query_terms(spark, SF_SMALL), fx.postings(spark, SF_SMALL)
    for limit in (None, 60_000, 100_000):
        run = R.retrieve(q, p, k=10, threshold=None, block_bytes=limit) if limit != 60_000 else R.score(q, p, block_bytes=limit)
        exchanges = [node.toString().split("\n")[0] for name, node in _nodes(_plan(run)) if name == "Exchange"]
        assert not any("qid" in e and "did" in e for e in exchanges), exchanges
