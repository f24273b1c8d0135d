"""Compare a Spark query with its SQL oracle run by DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None or isinstance(v, (int, str)):
        return repr(v)
    return str(v)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql, sf_dir):
    """(ok, message)"""
    df = fn(spark, sf_dir)
    s_cols, s_rows = _sorted_rows(df.columns, [tuple(x) for x in df.collect()])
    res = con.execute(sql)
    d_cols, d_rows = _sorted_rows([c[0] for c in res.description], res.fetchall())
    if s_cols != d_cols:
        return False, f"columns differ: {s_cols} / {d_cols}"
    if len(s_rows) != len(d_rows):
        return False, f"rows differ: {len(s_rows)} / {len(d_rows)}; {s_rows[:2]} / {d_rows[:2]}"
    bad = [(a, b) for a, b in zip(s_rows, d_rows) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(s_rows)} rows differ, e.g. {s_cols} {bad[0][0]} / {bad[0][1]}"
    types = {c: t for c, t in df.dtypes}
    return True, f"{len(s_rows)} rows {types if os.environ.get('TYPES') else ''}"


def main(names):
    from spectraloom.plans.registry import ORACLES, QUERIES, load_all
    from spectraloom.session import build_session

    load_all()
    sf = os.environ.get("SF", "/root/testdata/sf0.01")
    spark, con = build_session("8"), connect(sf)
    failed = []
    for name, fn in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            if name in ORACLES:
                ok, msg = compare(spark, con, fn, ORACLES[name], sf)
            else:
                ok, msg = True, f"{len(fn(spark, sf).collect())} rows, no oracle"
        except Exception as e:  # report and go on with the next query
            ok, msg = False, f"{type(e).__name__}: {str(e)[:900]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
