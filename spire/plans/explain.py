"""Print the formatted physical plan of registered queries.

``python -m spire.plans.explain NAME [NAME ...] [--sf DIR]``
"""

from __future__ import annotations

import argparse

from ..session import get_session
from . import QUERIES, load_all


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="+")
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    args = ap.parse_args()
    load_all()
    spark = get_session("local[8]", 16)
    for name in args.names:
        print(f"==== {name} ====")
        QUERIES[name](spark, args.sf).explain("formatted")


if __name__ == "__main__":
    main()
