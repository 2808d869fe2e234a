"""Runs registered queries and their SQL side by side and compares the rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    """One comparable form per value; floats to nine significant digits."""
    if value is None:
        return "<null>"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        if math.isnan(value):
            return "<nan>"
        return f"{value + 0.0:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    if isinstance(value, int):
        return f"{value}" if abs(value) < 10**9 else f"{value:.9g}"
    return str(value)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, sf_dir, name, fn, sql, con):
    started = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - started
    if sql is None:
        return len(got[1]), seconds, None
    rel = con.execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return len(got[1]), seconds, f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return len(got[1]), seconds, f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return len(got[1]), seconds, f"spark {a}\n   sql {b}"
    return len(got[1]), seconds, None


def main():
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from foldmark.session import get_spark, scratch

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    only = sys.argv[2:]
    spark = get_spark(8, "foldmark-oracle")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            with scratch():
                count, seconds, problem = compare(spark, sf_dir, name, fn, oracles.get(name), con)
        except Exception as e:  # noqa: BLE001
            count, seconds, problem = -1, 0.0, f"{type(e).__name__}: {str(e)[:1500]}"
        spark.catalog.clearCache()
        flag = "FAIL" if problem else ("ok" if name in oracles else "rows")
        if problem or count == 0 or seconds > 4 or os.environ.get("VERBOSE"):
            print(f"{flag:5} {name:45} rows={count} {seconds:.1f}s {problem or ''}", flush=True)
        bad += bool(problem)
    print(f"{bad} problems")
    spark.stop()


if __name__ == "__main__":
    main()
