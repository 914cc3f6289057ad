"""Run named queries against their SQL: ``python tests/compare.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from postmill.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


TIMES: dict[str, tuple[float, float]] = {}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    return str(v)


def rows(columns, data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, int]:
    """'' when equal, else what differs; and the row count."""
    t0 = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "", len(got)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    TIMES[name] = (t1 - t0, time.time() - t1)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", len(got)
    a, b = rows(df.columns, got), rows(cols, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}", len(got)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return (f"{len(diff)} rows differ, first {diff[0]}" if diff else ""), len(got)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for n in names:
        t = time.time()
        try:
            diff, count = compare(spark, con, sf_dir, n)
        except Exception as e:  # noqa: BLE001
            diff, count = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += bool(diff)
        print(f"{'DIFF' if diff else 'ok  '} {n:24s} {count:8d} rows {time.time() - t:6.1f}s {TIMES.get(n)} {diff[:900]}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
