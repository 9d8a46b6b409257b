"""Compare a registered query with its checking SQL on one data folder."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False, name=None):
        out.append(tuple("" if v is None or v is pd.NA or v != v else (repr(float(v)) if isinstance(v, float) else str(v)) for v in row))
    return sorted(out)


def compare(spark, name: str, folder: str, con=None) -> dict:
    import __spark_entry__ as entry

    con = con or connect(folder)
    t0 = time.time()
    found = entry.queries()[name](spark, folder)
    got = found.toPandas()
    for column, kind in found.dtypes:
        # Nulls would turn whole numbers into floats.
        if kind in ("int", "bigint") and got[column].isna().any():
            got[column] = got[column].astype("Int64")
    t1 = time.time()
    result = {"query": name, "rows": len(got), "spark_sec": round(t1 - t0, 2)}
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return {**result, "match": None}
    want = con.execute(sql).df()
    result["oracle_sec"] = round(time.time() - t1, 2)
    if sorted(got.columns) != sorted(want.columns):
        return {**result, "match": False, "why": f"columns {sorted(got.columns)} != {sorted(want.columns)}"}
    types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)}
    a, b = rows(got), rows(want)
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    ok = a == b
    if not ok:
        result["why"] = f"{len(a)} vs {len(b)} rows, {len(diff)} differ, first {diff[:2]}, only_spark {list(set(a) - set(b))[:2]}, only_sql {list(set(b) - set(a))[:2]}"
    if types:
        result["types"] = types
    return {**result, "match": ok}


if __name__ == "__main__":
    from colloquy.session import local_session
    from colloquy.catalog import QUERIES

    folder = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(8)
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            r = compare(spark, name, folder, con)
        except Exception as error:  # report and go on with the next query
            r = {"query": name, "match": False, "why": str(error)[:1500]}
        bad += r["match"] is False
        print(r, flush=True)
    print("FAILED" if bad else "OK", bad, "of", len(names))
