"""Compares a Spark result with a DuckDB result, without regard to the order of rows and columns."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def _cell(v: object) -> str:
    if hasattr(v, "tolist") or isinstance(v, list):
        return str([str(x) for x in v])
    if v is None or pd.isna(v):
        return "<null>"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def normal(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].map(_cell)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def same(left: pd.DataFrame, right: pd.DataFrame) -> None:
    pd.testing.assert_frame_equal(normal(left), normal(right), check_dtype=False)
