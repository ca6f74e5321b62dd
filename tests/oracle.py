"""Side-by-side check of a registered query against its DuckDB SQL.

Usage: ``python -m tests.oracle [sf_dir] [name ...]`` from the repo root.
Compares row count, column names, and an order-insensitive multiset of
rows (doubles compared at 6 decimals), like the driver's gate.
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.execute(sql).df()


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (list, tuple)):
        try:
            v = v.item()
        except (ValueError, AttributeError):
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return tuple(_norm(x) for x in v.tolist())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(pdf) -> Counter:
    cols = sorted(pdf.columns)
    out = Counter()
    for rec in pdf[cols].itertuples(index=False, name=None):
        out[tuple(repr(_norm(x)) for x in rec)] += 1
    return out


def compare(spark_pdf, duck_pdf) -> tuple[bool, str]:
    sc, dc = sorted(spark_pdf.columns), sorted(duck_pdf.columns)
    if sc != dc:
        return False, f"columns differ: spark={sc} duck={dc}"
    if len(spark_pdf) != len(duck_pdf):
        return False, f"rows differ: spark={len(spark_pdf)} duck={len(duck_pdf)}"
    a, b = rows_of(spark_pdf), rows_of(duck_pdf)
    if a != b:
        only_a = list((a - b).items())[:3]
        only_b = list((b - a).items())[:3]
        return False, f"values differ ({sum((a - b).values())} rows): spark-only={only_a} duck-only={only_b}"
    return True, f"{len(spark_pdf)} rows"


def main(argv: list[str]) -> int:
    import os
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as E
    from spire.session import get_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = get_session("local[8]", 8)
    qs, sql = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sql:
            print(f"ROWS {name}: {len(sp)} rows (no oracle) spark={t1 - t0:.1f}s")
            continue
        try:
            dk = duck(sql[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        ok, msg = compare(sp, dk)
        bad += 0 if ok else 1
        print(f"{'OK  ' if ok else 'FAIL'} {name}: {msg} spark={t1 - t0:.1f}s")
    print(f"{len(names or qs) - bad}/{len(names or qs)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
