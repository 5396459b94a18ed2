"""Differential check: a Spark query against its DuckDB oracle on the same parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return ("d", str(v.normalize()) if v != 0 else "0")
    if isinstance(v, float):
        if math.isnan(v):
            return ("f", "nan")
        return ("f", f"{v:.9g}")
    if isinstance(v, int):
        return ("d", str(v))
    if isinstance(v, dt.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    if isinstance(v, dt.date):
        return ("t", dt.datetime.combine(v, dt.time()).isoformat()) if False else ("dt", v.isoformat())
    return ("s", str(v))


def normalise(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark_df, con, sql):
    s_cols = list(spark_df.columns)
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_rows = rel.fetchall()
    report = {
        "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
        "columns_match": sorted(s_cols) == sorted(d_cols),
        "spark_only_cols": sorted(set(s_cols) - set(d_cols)),
        "oracle_only_cols": sorted(set(d_cols) - set(s_cols)),
    }
    if report["columns_match"]:
        a, b = normalise(s_rows, s_cols), normalise(d_rows, d_cols)
        report["values_match"] = a == b
        if not report["values_match"]:
            sa, sb = set(a), set(b)
            report["spark_not_oracle"] = [r for r in a if r not in sb][:3]
            report["oracle_not_spark"] = [r for r in b if r not in sa][:3]
    else:
        report["values_match"] = False
    return report
