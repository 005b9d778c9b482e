"""Compare a Spark result with the DuckDB twin: names, row count, kinds and exact values."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return float(x) + 0.0
    if isinstance(x, int):
        return float(x)
    if isinstance(x, pd.Timestamp):
        return x.isoformat()
    return str(x)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    names = sorted(pdf.columns)
    out = [tuple(_value(v) for v in r) for r in pdf[names].itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def kind(dtype) -> str:
    text = str(dtype).lower()
    for k in ("int", "float", "bool", "datetime"):
        if k in text:
            return "number" if k in ("int", "float") else k
    return "object"


def differences(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} / {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} / {len(duck_pdf)}"
    a, b = rows(spark_pdf), rows(duck_pdf)
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {sorted(spark_pdf.columns)}\n  spark {bad[0][0]}\n  duck  {bad[0][1]}"
    kinds = {
        n: (kind(spark_pdf[n].dtype), kind(duck_pdf[n].dtype))
        for n in spark_pdf.columns
        if kind(spark_pdf[n].dtype) != kind(duck_pdf[n].dtype)
    }
    if kinds and len(a):
        return f"kinds {kinds}"
    return None
