"""Per-session memo for large rule expressions.

Building a Column costs one JVM round trip per node; the scorecard, the
feature flags and the retention plan have hundreds of nodes. They depend on
nothing but constants, so each is built once per SparkContext and reused
(Columns are unresolved expressions and can be shared between DataFrames).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext

_MEMO: dict[tuple[int, str], object] = {}


def session_cached(key: str, build: Callable[[], object]):
    sc = SparkContext._active_spark_context
    k = (id(sc), key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]
