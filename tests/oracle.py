"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    if isinstance(v, float | np.floating):
        return f"{float(v):.5f}".rstrip("0").rstrip(".") if not float(v).is_integer() else str(int(v))
    if isinstance(v, int | np.integer):
        return str(int(v))
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].removesuffix("T00:00:00")
    if isinstance(v, list | np.ndarray):
        return str([_value(x) for x in v])
    try:
        return f"{float(v):.5f}".rstrip("0").rstrip(".") if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows_of(frame) -> tuple[list[str], list[tuple]]:
    names = sorted(frame.columns)
    return names, sorted(tuple(_value(v) for v in r) for r in frame[names].itertuples(index=False, name=None))


def compare(spark, con, f, sql: str, sf_dir: str) -> str:
    got_names, got = rows_of(f(spark, sf_dir).toPandas())
    want_names, want = rows_of(con.execute(sql).df())
    if got_names != want_names:
        return f"columns {got_names} {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} {len(want)}: {list(set(got) - set(want))[:2]} {list(set(want) - set(got))[:2]}"
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            if a != b:
                try:
                    if math.isclose(float(a), float(b), abs_tol=1.1e-5):
                        continue
                except ValueError:
                    pass
                return f"{len(set(got) - set(want))} of {len(got)} differ: {list(set(got) - set(want))[:2]} {list(set(want) - set(got))[:2]}"
    return ""
