"""Run registered queries and their SQL side by side: ``python tests/check_oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

from __spark_entry__ import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return "[" + ",".join(cell(x) for x in v) + "]"
    if hasattr(v, "item"):
        return cell(v.item())
    if isinstance(v, int):
        return repr(float(v)) if abs(v) < 2**53 else str(v)
    return repr(v)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted(zip(*(map(cell, pdf[c].tolist()) for c in pdf.columns)))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = rows(got), rows(want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return "" if not bad else f"{len(bad)} of {len(a)} rows differ in {sorted(got.columns)}, e.g. {bad[0][0]} != {bad[0][1]}"


def main(argv: list[str]) -> int:
    sf = argv[0] if argv else "0.01"
    folder = f"/root/testdata/sf{sf}"
    from tests.conftest import session

    spark = session()
    con, all_queries, sql = connect(folder), queries(), oracle_sql()
    names = [n for n in all_queries if not argv[1:] or any(n == a or n.startswith(a + "_") for a in argv[1:])]
    failed = 0
    for n in names:
        t = time.time()
        try:
            got = all_queries[n](spark, folder).toPandas()
            took = time.time() - t
            if n in sql:
                t = time.time()
                msg = compare(got, con.execute(sql[n]).df())
                msg = msg and f"FAIL {msg}"
                note = f"rows {len(got)}, duckdb {time.time() - t:.1f}s"
            else:
                msg, note = ("" if len(got) else "FAIL empty"), f"rows {len(got)}, no sql"
        except Exception as e:  # noqa: BLE001
            took = time.time() - t
            msg, note = f"FAIL {type(e).__name__}: {str(e)[:900]}", ""
        failed += bool(msg)
        print(f"{'ok  ' if not msg else 'BAD '} {n:42s} {took:6.2f}s {note} {msg}", flush=True)
    print(f"{len(names) - failed} of {len(names)} ok")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
