"""Registry of named queries and their DuckDB oracle SQL.

Each query is ``fn(spark, sf_dir) -> DataFrame``.  Every computed column is
aliased to the same name in the SQL, doubles are rounded to 6 places on
both sides, integer ids are BIGINT, dims/ranks INTEGER.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise KeyError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# Shared oracle fragments ------------------------------------------------------

VEC_CTE = """vec AS (
  SELECT vec_id, CAST(dim AS INTEGER) AS dim, ln(1 + CAST(x AS DOUBLE)) AS weight
  FROM (SELECT vec_id, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings)
  WHERE x > 0)"""

RUN_CTE = """run AS (
  SELECT l_suppkey AS qid, l_orderkey AS did, CAST(max(l_extendedprice) AS DOUBLE) AS score
  FROM lineitem GROUP BY 1, 2)"""

RUN2_CTE = """run2 AS (
  SELECT l_suppkey AS qid, l_orderkey AS did,
         CAST(max(l_extendedprice * l_discount) AS DOUBLE) AS score
  FROM lineitem GROUP BY 1, 2 HAVING max(l_extendedprice * l_discount) > 0)"""

QRELS_CTE = """qrels AS (
  SELECT qid, did, rel FROM (
    SELECT l_suppkey AS qid, l_orderkey AS did,
           CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS rel
    FROM lineitem GROUP BY 1, 2) WHERE rel > 0)"""

JUDGED_CTE = """judged AS (
  SELECT l_suppkey AS qid, l_orderkey AS did, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS INTEGER) AS rel
  FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2)"""

# python str.strip()/split on blanks ~ regexp on \\s in both engines
TURNS_CTE = r"""turns AS (
  SELECT conv_id, turn, role,
         regexp_replace(regexp_replace(text, '[\t\n\r]', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text
  FROM conversations WHERE role <> 'system')"""
