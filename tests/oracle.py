"""Run queries and their SQL side by side and compare whole results."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def kind(value) -> str:
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(value), type(value).__name__)


def key(row: tuple) -> tuple:
    return tuple((v is None, "" if v is None else v) for v in row)


def compare(got: list[tuple], want: list[tuple]) -> str | None:
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        for a, b in zip(g, w):
            if kind(a) != kind(b):
                return f"types: {g} / {w}"
            if a != b and not (isinstance(a, float) and math.isnan(a) and math.isnan(b)):
                return f"{g} / {w}"
    return None


def check(spark, con, name: str, queries: dict, oracles: dict, sf_dir: str) -> tuple[str | None, int, float, float]:
    start = time.time()
    df = queries[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    mid = time.time()
    if name not in oracles:
        return None, len(got), mid - start, 0.0
    cur = con.execute(oracles[name])
    names = [c[0] for c in cur.description]
    if sorted(names) != columns:
        return f"columns {columns}, expected {sorted(names)}", len(got), mid - start, 0.0
    order = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in order) for r in cur.fetchall()]
    return compare(got, want), len(got), mid - start, time.time() - mid


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from rainspark.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in wanted:
        try:
            error, n, a, b = check(spark, con, name, entry.queries(), entry.oracle_sql(), sf_dir)
            print(f"{'OK  ' if error is None else 'FAIL'} {name} rows={n} spark={a:.1f}s sql={b:.1f}s {str(error or '')[:600]}", flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"ERR  {name} {type(e).__name__} {str(e)[:700]}", flush=True)


if __name__ == "__main__":
    main()
