"""Run registered queries on Spark and their oracle SQL on DuckDB; compare.

usage: python scripts/oracle_check.py [--sf DIR] [name-prefix ...]
Prints one line per query: OK / MISMATCH / ERROR, with row counts and time.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    import numpy as np
    import pandas as pd
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (np.floating, float)):
        return round(float(v), 6)
    if isinstance(v, (np.integer,)):
        return int(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(norm(x) for x in rec))
    return cols, sorted(out, key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    import duckdb
    from intentloom.session import get_spark
    from intentloom.registry import QUERIES, ORACLE, load_all
    load_all()
    spark = get_spark("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{a.sf}/{t}.parquet')")
    names = [n for n in QUERIES if not a.names or any(n.startswith(p) for p in a.names)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            sdf = QUERIES[n](spark, a.sf).toPandas()
            ts = time.time() - t0
            if n not in ORACLE:
                print(f"ROWS-ONLY {n}: spark {len(sdf)} rows ({ts:.1f}s)", flush=True)
                continue
            ddf = con.execute(ORACLE[n]).df()
            sc, sr = rows_of(sdf)
            dc, dr = rows_of(ddf)
            if sc != dc:
                bad += 1
                print(f"MISMATCH {n}: columns spark={sc} duck={dc}", flush=True)
                continue
            if sr != dr:
                bad += 1
                ss, ds = set(sr), set(dr)
                print(f"MISMATCH {n}: rows spark={len(sr)} duck={len(dr)}; "
                      f"only-spark e.g. {list(ss - ds)[:2]}; only-duck e.g. {list(ds - ss)[:2]}", flush=True)
                continue
            print(f"OK {n}: {len(sr)} rows ({ts:.1f}s)", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {n}: {type(e).__name__}: {str(e)[:400]}", flush=True)
            traceback.print_exc(limit=3)
    print(f"done: {len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main()
