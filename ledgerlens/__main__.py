"""Run one analysis and show it.

    python -m ledgerlens SF_DIR NAME [--rows N] [--explain]      stand-in views over test data
    python -m ledgerlens --reference ROOT NAME [...]              reference-shaped Parquet tables
    python -m ledgerlens --list
"""

from __future__ import annotations

import argparse

from ledgerlens.params import REFERENCE_PARAMS, STANDIN_PARAMS
from ledgerlens.plans.catalog import QUERIES, run


def main() -> None:
    ap = argparse.ArgumentParser(prog="ledgerlens")
    ap.add_argument("source", nargs="?", help="test-data folder (sf dir) or, with --reference, table root")
    ap.add_argument("name", nargs="?", choices=sorted(QUERIES))
    ap.add_argument("--reference", action="store_true", help="read reference-shaped tables from SOURCE")
    ap.add_argument("--rows", type=int, default=20)
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("--list", action="store_true")
    a = ap.parse_args()
    if a.list or not (a.source and a.name):
        print("\n".join(sorted(QUERIES)))
        return

    from ledgerlens.session import local_session
    from ledgerlens.sources import read_reference, standin_tables

    spark = local_session()
    if a.reference:
        df = run(a.name, read_reference(spark, a.source), REFERENCE_PARAMS)
    else:
        df = run(a.name, standin_tables(spark, a.source), STANDIN_PARAMS)
    if a.explain:
        df.explain("formatted")
    df.show(a.rows, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
