"""Run a Spark query and its DuckDB oracle on the same parquet folder and
compare row count, column names and order-insensitive values."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from roundlearn.sources.tables import TABLES


def duck(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con.sql(sql).df()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, (int,)) or type(v).__name__.startswith("int"):
        return int(v)
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c]) for c in cols) for _, r in df[cols].iterrows()]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def duck_types(sf_dir: str, sql: str) -> dict:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    rel = con.sql(sql)
    return {n: str(t) for n, t in zip(rel.columns, rel.types)}


def compare(spark_df, sf_dir: str, sql: str, check_types: bool = True) -> tuple[bool, str]:
    if check_types:
        from type_check import spark_type
        st = {f.name: spark_type(f.dataType) for f in spark_df.schema.fields}
        dt = duck_types(sf_dir, sql)
        diff = {c: (st.get(c), dt.get(c)) for c in set(st) | set(dt) if st.get(c) != dt.get(c)}
        if diff:
            return False, f"types differ: {diff}"
    a = spark_df.toPandas()
    b = duck(sf_dir, sql)
    if sorted(a.columns) != sorted(b.columns):
        return False, f"columns differ: {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return False, f"row count {len(a)} vs {len(b)}"
    ra, rb = rows_of(a), rows_of(b)
    bad = [(x, y) for x, y in zip(ra, rb) if x != y]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. {bad[:3]}"
    return True, f"{len(a)} rows equal"
