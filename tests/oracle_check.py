"""Compare each registered Spark query with its DuckDB oracle on one scale.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key: rows on both sides, schema names, and whether the
sorted rows are equal.  Used by tests/test_oracle.py and by hand.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):  # pandas holds whole numbers beside nulls as floats
        return None if math.isnan(v) else int(v) if v.is_integer() else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(_norm(v) for v in r) for r in pdf[cols].itertuples(index=False)), key=repr)


def compare(spark, sf_dir: str, key: str, query, sql: str | None, con=None) -> dict:
    t0 = time.time()
    sdf = query(spark, sf_dir)
    spdf = sdf.toPandas()
    t1 = time.time()
    out = {"key": key, "spark_rows": len(spdf), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["match"] = None
        return out
    con = con or duck(sf_dir)
    dpdf = con.sql(sql).df()
    out["duck_rows"] = len(dpdf)
    out["duck_sec"] = round(time.time() - t1, 2)
    sc, sr = rows_of(spdf)
    dc, dr = rows_of(dpdf)
    out["cols_equal"] = sc == dc
    out["match"] = sc == dc and sr == dr
    if not out["match"] and sc == dc:
        ds, dd = set(sr), set(dr)
        out["only_spark"] = list(ds - dd)[:3]
        out["only_duck"] = list(dd - ds)[:3]
    elif sc != dc:
        out["spark_cols"], out["duck_cols"] = sc, dc
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    from wayfold.session import local_session

    spark = local_session(8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    for k in keys or list(qs):
        print(compare(spark, sf_dir, k, qs[k], sqls.get(k), con), flush=True)


if __name__ == "__main__":
    main(sys.argv)
