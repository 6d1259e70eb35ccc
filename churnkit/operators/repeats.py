"""Identical rows in two phases: a narrow hash first, full rows only where it repeats.

Grouping by every column shuffles all rows whole, although most rows of a
table are unique. Here a 128-bit hash of each row is counted (two longs and a
count are shuffled); rows whose hash occurs once cannot repeat and are left where
they are. The others are grouped by their full columns, so a collision of
hashes costs time but never changes the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

_HASH = ("__h1", "__h2")


def row_hash(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Two 64-bit hashes of the columns ``keys``; values that are equal in a grouping (0.0 and -0.0) hash alike."""
    cols = [F.col(f"`{c}`") + F.lit(0.0) if isinstance(df.schema[c].dataType, (FloatType, DoubleType)) else F.col(f"`{c}`")
            for c in keys]
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def split_repeats(df: DataFrame, keys: Sequence[str], hashes: Callable = row_hash) -> tuple[DataFrame, DataFrame]:
    """(rows whose hash is theirs alone, the others): together all rows of ``df``.

    ``df`` is read three times; where few hashes repeat their list is
    broadcast and no full row of the first part is shuffled."""
    d = df.withColumns(dict(zip(_HASH, hashes(df, keys), strict=True)))
    again = d.select(*_HASH).groupBy(*_HASH).agg(F.count(F.lit(1)).alias("__c")).where("__c > 1").select(*_HASH)
    return (d.join(again, list(_HASH), "left_anti").select(*df.columns),
            d.join(again, list(_HASH), "left_semi").select(*df.columns))


def drop_repeats(df: DataFrame, order_col: str, hashes: Callable = row_hash) -> DataFrame:
    """One row of each set of rows equal in all but ``order_col``, with its least ``order_col``."""
    keys = [c for c in df.columns if c != order_col]
    alone, others = split_repeats(df, keys, hashes)
    first = others.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.min(order_col).alias(order_col)).select(*df.columns)
    return alone.unionByName(first)


def count_repeats(df: DataFrame, keys: Sequence[str], hashes: Callable = row_hash) -> DataFrame:
    """(DuplicateRows): rows equal to an earlier row in the columns ``keys``."""
    _, others = split_repeats(df.select(*[F.col(f"`{c}`") for c in keys]), keys, hashes)
    groups = others.groupBy(*[F.col(f"`{c}`") for c in keys]).agg(F.count(F.lit(1)).alias("__c"))
    return groups.agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("long").alias("DuplicateRows"))
