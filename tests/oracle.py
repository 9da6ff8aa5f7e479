"""A query's rows beside its SQL's rows."""

from pathlib import Path

import duckdb
import pandas as pd


def connect(data: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for p in Path(data).glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return db


def _cell(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return "null"
    if isinstance(x, bool) or type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if hasattr(x, "item") and not isinstance(x, pd.Timestamp):
        x = x.item()
    return f"{x:.6g}" if isinstance(x, float) and x != int(x) else str(int(x)) if isinstance(x, float) else str(x)


def canonical(df: pd.DataFrame) -> tuple[list[str], list[tuple[str, ...]]]:
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(_cell, r)) for r in df.itertuples(index=False))
