"""Compare a query with its SQL in DuckDB, the way the driver does: columns by name, rows in any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if value else "0"
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return [normal(v) for v in value]
    if hasattr(value, "tolist"):
        return normal(value.tolist())
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([normal(r[i]) for i in order]) for r in rows)


def compare(df, con, sql: str) -> str:
    """Empty where equal, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == expected:
        return ""
    only_got, only_expected = [x for x in got if x not in set(expected)][:3], [x for x in expected if x not in set(got)][:3]
    return f"{len(got)} rows against {len(expected)}; only here {only_got}; only in SQL {only_expected}"
