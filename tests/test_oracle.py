"""Every registered query against its DuckDB SQL (the driver's gate), on sf0.001."""

import pytest

import __spark_entry__ as E
from spire.plans import ORACLE, QUERIES, load_all
from tests.conftest import SF_SMALL
from tests.oracle import compare, duck

load_all()  # the library's own queries; the corpus operators have tests of their own
SQL = ORACLE


def test_every_query_has_sql():
    missing = sorted(set(QUERIES) - set(SQL))
    assert missing == [], f"queries without oracle SQL: {missing}"


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    got = df.toPandas()
    want = duck(SQL[name], SF_SMALL)
    ok, msg = compare(got, want)
    assert ok, msg
    types = duck(f"DESCRIBE {SQL[name]}", SF_SMALL)
    duck_types = dict(zip(types["column_name"], types["column_type"]))
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in df.schema.fields}
    assert spark_types == duck_types


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["qid", "mrr_10", "recall_10", "ndcg_cut_10"]
