"""Local twin of the driver's correctness gate: run each registered Spark
query and its DuckDB oracle on the same parquet tables and compare
row count, column names and order-insensitive values.

    python -m mixlab.plans.check [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time

import duckdb
import numpy as np

from mixlab.sources.tables import TABLE_NAMES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (np.floating,)):
        v = float(v)
        if math.isnan(v):
            return None
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (np.bool_,)):
        return bool(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.collect()]
    return cols, rows


def rows_of_duck(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    data = rel.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return cols, rows


def duck_con(sf_dir: str):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, sf_dir, names, verbose=True):
    from mixlab.plans.registry import ORACLE, QUERIES

    con = duck_con(sf_dir)
    results = {}
    for name in names:
        t0 = time.time()
        try:
            scols, srows = rows_of_spark(QUERIES[name](spark, sf_dir))
        except Exception as e:  # noqa: BLE001
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:400]}"
            print(name, results[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in ORACLE:
            results[name] = f"rows-only {len(srows)}"
            print(f"{name}: {results[name]} ({ts:.1f}s)", flush=True)
            continue
        try:
            dcols, drows = rows_of_duck(con, ORACLE[name])
        except Exception as e:  # noqa: BLE001
            results[name] = f"DUCK ERROR {type(e).__name__}: {str(e)[:400]}"
            print(name, results[name], flush=True)
            continue
        msg = "OK"
        if scols != dcols:
            msg = f"COLUMNS spark={scols} duck={dcols}"
        elif len(srows) != len(drows):
            msg = f"ROWCOUNT spark={len(srows)} duck={len(drows)}"
        else:
            key = lambda r: tuple((x is None, repr(x)) for x in r)
            a, b = sorted(srows, key=key), sorted(drows, key=key)
            diff = [(x, y) for x, y in zip(a, b) if x != y]
            if diff:
                msg = f"VALUES {len(diff)} differ; first spark={str(diff[0][0])[:300]} duck={str(diff[0][1])[:300]}"
        results[name] = msg if msg != "OK" else f"OK {len(srows)} rows"
        print(f"{name}: {results[name]} ({ts:.1f}s)", flush=True)
    return results


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args(argv)
    import mixlab.plans.catalog  # noqa: F401  (registers queries)
    from mixlab.plans.registry import QUERIES
    from mixlab.session import get_spark

    spark = get_spark()
    names = a.names or sorted(QUERIES)
    res = compare(spark, a.sf, names)
    bad = [n for n, m in res.items() if not (m.startswith("OK") or m.startswith("rows-only"))]
    print(f"{len(res) - len(bad)}/{len(res)} fine; bad: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
