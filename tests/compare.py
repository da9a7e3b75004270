"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, float):
        return "nan" if v != v else float(f"{v:.9g}")
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return v


def differences(df, c, sql: str) -> tuple[set, set]:
    """Rows of either side that the other lacks."""
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[x]) for x in columns)) for r in df.collect())
    found = c.sql(sql)
    assert sorted(found.columns) == columns, (found.columns, columns)
    at = [found.columns.index(x) for x in columns]
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in found.fetchall())
    if got == want:
        return set(), set()
    return set(got) - set(want) or {f"{len(got)} rows"}, set(want) - set(got) or {f"{len(want)} rows"}
