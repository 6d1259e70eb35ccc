"""Order-insensitive comparison of a Spark result with a DuckDB result."""

import hashlib
import math


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_duckdb(rel):
    cols = sorted(rel.columns)
    idx = [rel.columns.index(c) for c in cols]
    return cols, sorted((tuple(norm(r[i]) for i in idx) for r in rel.fetchall()), key=repr)


def digest(rows):
    return hashlib.md5(repr(rows).encode()).hexdigest()
