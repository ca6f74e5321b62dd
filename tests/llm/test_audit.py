"""The filter audit against a plain walk through every order."""

from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from spire.llm.audit import audit_documents, audit_filters, removal_steps
from tests.llm.test_llm import SCHEMA, odd_rows

LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    t = text or ""
    w = t.encode().split()
    return {f for f, bad in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                                         any(c in "#$%&*|" for c in t))) if bad}


def brute(rows, labels):
    """rows: (doc_id, text, lang); every document is filtered one after another."""
    top = float("inf")
    at = [top if r[0] is None else r[0] for r in rows]
    docs = []
    for i, (d, t, lang) in enumerate(rows):
        e = {"E"} if any((rows[j][1] or "") == (t or "") and at[j] < at[i] for j in range(len(rows))) else set()
        mine = [x for x in labels if d is not None and x[0] == d]
        docs.append((lang or "", fails(t) | e, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, total = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for i, f in enumerate(order, 1):
                now = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                out[part, "".join(order), i] = (f, len(left), len(now), sum(f in d[1] for d in gone),
                                                sum(d[1] == {f} for d in docs if d[0] == part), sum(d[2] for d in now), sum(d[3] for d in now))
                gone += now
                total[part, f] += len(now)
    return {k: (*v, total[k[0], v[0]]) for k, v in out.items()}


def audited(df):
    return {(r.part, r.filter_order, r.step): (r.filter, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_audit_odd(spark):
    rows = odd_rows()
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (2, 1, 1), (4, 0, 1), (None, 1, 1), (7, 1, 0), (15, None, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("score", "mask").withColumnRenamed("n", "digest")
    got = audit_documents(docs, spark.createDataFrame(labels, LABELS))
    assert audited(got) == brute([r[:3] for r in rows], labels)
    none = spark.createDataFrame([], SCHEMA)
    assert audit_documents(none, spark.createDataFrame(labels, LABELS)).count() == 0
    bare = audited(audit_documents(docs, spark.createDataFrame([], LABELS)))
    assert bare == brute([r[:3] for r in rows], [])


def test_audit_filters_meet(spark):
    """Texts that fail every mix of filters, copies across parts, a hot text, a hot id and no ids."""
    rng = np.random.default_rng(5)
    pool = []
    for code in range(16):
        w = [f"w{i if not code & 2 else i % 40}" for i in range(150 if code & 1 else 260)]
        pool.append(" ".join(w) + (" " + "ABC" * 40 if code & 4 else "") + (" 5%" if code & 8 else ""))
    assert {"".join(sorted(fails(t))) for t in pool} == {"".join(f for i, f in enumerate("ABCD") if c >> i & 1) for c in range(16)}
    rows = []
    for i in range(300):
        kind = i % 3
        rows.append((None if i % 50 == 0 else 7 if kind == 1 else i, pool[0] + f" {i % 40}" if kind == 1 else pool[int(rng.integers(16))], [None, "", "en", "de"][int(rng.integers(4))]))
    labels = [(i, int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 300, 2)] + [(7, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    assert audited(audit_documents(docs, spark.createDataFrame(labels, LABELS))) == brute(rows, labels)


@pytest.mark.parametrize("k", [1, 3, 6])
def test_removal_steps(k):
    rng = np.random.default_rng(k)
    orders = np.array(list(permutations(range(k))))
    masks = rng.random((20, k)) < 0.4
    steps = removal_steps(masks, np.argsort(orders, axis=1))
    for m, row in zip(masks, steps):
        for order, s in zip(orders, row):
            assert s == next((i for i, f in enumerate(order) if m[f]), k)


def test_other_filters(spark):
    """Any number of filters; a weight of its own."""
    classes = spark.createDataFrame([("p", 0, 5, 1), ("p", 1, 2, 0), ("p", 3, 1, 1)], "part string, mask int, n long, w int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.w_lost, r.shapley) for r in audit_filters(classes, "XY", ("w",)).collect()}
    assert got == {("XY", 1): (5, 3, 0, 2, 1, 5), ("XY", 2): (5, 0, 1, 0, 0, 1), ("YX", 1): (7, 1, 0, 0, 1, 1), ("YX", 2): (5, 2, 1, 2, 0, 5)}


