"""Profiling operators (inventory D2-D4, D11-D14, D19, D23-D32).

Wide per-column statistics are computed in ONE aggregation pass and then
turned into long (column, statistic) form with ``stack``, so a profile of N
columns costs one scan, not N.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ByteType, DecimalType, DoubleType, FloatType, IntegerType,
                               LongType, NumericType, ShortType, StringType)

from churnkit.functions.numeric import half_even
from churnkit.operators import ordinal, repeats


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _stack(wide: DataFrame, names: Sequence[str], key: str, value: str, prefix: str) -> DataFrame:
    pairs = ", ".join(f"'{n}', {_q(prefix + n)}" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {pairs}) as ({key}, {value})")


# --- D2 ----------------------------------------------------------------------

def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``isnull().sum()`` for every column, long form (column, null_count)."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias("n_" + c) for c in cols])
    return _stack(wide, cols, "column_name", "null_count", "n_")


def null_count_of(df: DataFrame, c: str, alias: str = "NullCount") -> DataFrame:
    """``COUNT(*) WHERE c IS NULL``."""
    return df.agg(F.count_if(F.col(c).isNull()).alias(alias))


# --- D3, D4 -------------------------------------------------------------------

def duplicate_keys(df: DataFrame, key: str = "customerID") -> DataFrame:
    """``GROUP BY key HAVING COUNT(*) > 1``."""
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("KeyCount"))
            .filter(F.col("KeyCount") > 1))


def repeated_rows(df: DataFrame, exclude: Sequence[str] = ("row_no",)) -> DataFrame:
    """``duplicated().sum()``: rows equal to an earlier row (all but the first).

    Counted as sum(count - 1) over groups of identical rows, among the rows
    whose hash repeats (:mod:`repeats`).
    """
    return repeats.count_repeats(df, [c for c in df.columns if c not in exclude])


# --- D11, D12, D28 ---------------------------------------------------------------

def value_counts(df: DataFrame, c: str, count_col: str = "count") -> DataFrame:
    """pandas ``value_counts``: null keys dropped (S4), count descending."""
    return (df.where(F.col(c).isNotNull()).groupBy(c)
            .agg(F.count(F.lit(1)).alias(count_col))
            .orderBy(F.desc(count_col), F.asc(c)))


def value_shares(df: DataFrame, c: str, decimals: int = 6) -> DataFrame:
    """``value_counts(normalize=True) * 100``. The total is a scalar subquery
    (no single-partition window, whatever the key cardinality)."""
    base = df.where(F.col(c).isNotNull())
    counts = base.groupBy(c).agg(F.count(F.lit(1)).alias("count"))
    total = base.select(F.count(F.lit(1))).scalar()
    share = F.col("count") * F.lit(100.0) / total
    return counts.select(c, "count", half_even(share, decimals).alias("percent"))


def count_by(df: DataFrame, x: str, hue: str | None = None) -> DataFrame:
    """The counts behind a count plot (one- or two-way); nulls dropped."""
    keys = [x] + ([hue] if hue else [])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


# --- D13, D14 -----------------------------------------------------------------------

def crosstab_normalized(df: DataFrame, a: str, b: str, values: Sequence, percent: bool = True,
                        decimals: int = 6) -> DataFrame:
    """``pd.crosstab(a, b, normalize='index')`` (x100 when ``percent``).

    Pivot on the given ``values`` (stating them keeps the plan lazy: no job
    to discover levels); missing cells are 0 (S5), null keys dropped (S4).
    """
    base = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    wide = base.groupBy(a).pivot(b, list(values)).count()
    names = [str(v) for v in values]
    wide = wide.na.fill(0, subset=names)
    total = sum((F.col(_q(n)) for n in names), F.lit(0))
    scale = 100.0 if percent else 1.0
    return wide.select(a, *[half_even(F.col(_q(n)) * F.lit(scale) / total, decimals).alias(n)
                            for n in names])


def group_mean(df: DataFrame, by: str, c: str | Sequence[str], alias: str | None = None,
               decimals: int = 6) -> DataFrame:
    """``groupby(by)[c].mean()`` for one or several columns in one aggregation;
    null keys dropped."""
    cols = [c] if isinstance(c, str) else list(c)
    return (df.where(F.col(by).isNotNull()).groupBy(by)
            .agg(*[half_even(F.avg(x), decimals).alias(alias if alias and len(cols) == 1 else f"mean_{x}")
                   for x in cols]))


# --- D19 -------------------------------------------------------------------------------

def most_frequent(df: DataFrame, c: str, alias: str = "mode") -> DataFrame:
    """``mode()[0]``: the commonest value, the smallest on ties."""
    counts = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("__n"))
    return counts.agg(F.min_by(c, F.struct(-F.col("__n"), F.col(c))).alias(alias))     # no task holds all values


# --- D23, D24 --------------------------------------------------------------------------------

def numeric_columns(df: DataFrame) -> list[str]:
    """``select_dtypes(include=number)``."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    """``select_dtypes(include=object)``."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None,
                     decimals: int = 6) -> DataFrame:
    """pandas ``describe()``: count, mean, std (n-1), min, 25/50/75 %
    (exact, interpolated), max; one row per column.

    Moments come from one wide aggregation; quartiles of all columns from ONE
    distributed exact-quantile job over the long (column, value) form, so no
    column's values are gathered in one task and the input is read twice,
    not once per column.
    """
    cols = list(columns or numeric_columns(df))
    stats = df.agg(*[e for c in cols for e in (
        F.count(c).alias(f"count_{c}"), F.avg(c).alias(f"mean_{c}"),
        F.stddev_samp(c).alias(f"std_{c}"), F.min(c).cast("double").alias(f"min_{c}"),
        F.max(c).cast("double").alias(f"max_{c}"))])
    fields = ", ".join(f"'{c}', {_q('count_' + c)}, {_q('mean_' + c)}, {_q('std_' + c)}, "
                       f"{_q('min_' + c)}, {_q('max_' + c)}" for c in cols)
    long_stats = stats.selectExpr(
        f"stack({len(cols)}, {fields}) as (column_name, count, mean, std, min, max)")
    values = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols]))
        .alias("kv")).select("kv.column_name", "kv.value")
    qs = ordinal.exact_quantiles(values, "value", [0.25, 0.5, 0.75], ["column_name"])
    out = long_stats.join(qs, "column_name", "left")   # one row per column on each side
    return out.select("column_name", "count", half_even("mean", decimals).alias("mean"),
                      half_even("std", decimals).alias("std"), "min",
                      half_even("q0", decimals).alias("p25"), half_even("q1", decimals).alias("p50"),
                      half_even("q2", decimals).alias("p75"), "max")


def describe_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """pandas ``describe(include='object')``: count, unique, top, freq.

    ``top`` is the commonest value, the smallest on ties.
    """
    cols = list(columns or text_columns(df))
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("v")) for c in cols])).alias("kv")).select("kv.*")
    # one scan for all columns: (column, value) counts with map-side combine, then one row per column
    counts = cells.groupBy("column_name", "v").agg(F.count("v").alias("f"))
    out = counts.groupBy("column_name").agg(
        F.coalesce(F.sum("f"), F.lit(0)).cast("long").alias("count"), F.count("v").alias("unique"),
        F.min_by("v", F.when(F.col("v").isNotNull(), F.struct(-F.col("f"), F.col("v")))).alias("top"),
        F.max(F.when(F.col("v").isNotNull(), F.col("f"))).alias("freq"))
    return out.select("column_name", "count", "unique", "top", "freq")


# --- D25 -----------------------------------------------------------------------------

def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None,
                       decimals: int = 6) -> DataFrame:
    """``corr(numeric_only=True)`` in long form (x, y, corr); pairwise complete.

    All pairs in one aggregation; null pairs are skipped by ``corr``.
    """
    cols = list(columns or numeric_columns(df))
    aggs, names = [], []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            ca, cb = F.col(a).cast("double"), F.col(b).cast("double")
            both = ca.isNotNull() & cb.isNotNull()
            aggs.append(F.corr(F.when(both, ca), F.when(both, cb)).alias(f"c_{i}_{cols.index(b)}"))
            names.append((a, b, f"c_{i}_{cols.index(b)}"))
    wide = df.agg(*aggs)
    cells = []
    for a, b, n in names:
        cells.append(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(n).alias("corr")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("x"), F.lit(a).alias("y"), F.col(n).alias("corr")))
    out = wide.select(F.explode(F.array(*cells)).alias("c")).select("c.*")   # one row -> matrix cells
    return out.select("x", "y", half_even("corr", decimals).alias("corr"))


# --- D26, D27, D29 ----------------------------------------------------------------------------

def histogram(df: DataFrame, c: str, bins: int = 10) -> DataFrame:
    """Equal-width histogram over [min, max]; the last bin includes max.

    The range is a scalar subquery; counting is one aggregation.
    """
    lo = df.select(F.min(F.col(c).cast("double"))).scalar()
    hi = df.select(F.max(F.col(c).cast("double"))).scalar()
    x = F.col(c).cast("double")
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((x - lo) / width).cast("int"), F.lit(bins - 1)))
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bin",
                         half_even(lo + F.col("bin") * width, 6).alias("bin_start"),
                         half_even(lo + (F.col("bin") + 1) * width, 6).alias("bin_end"),
                         "count")


def density_curve(df: DataFrame, c: str, points: int = 200, cut: float = 0.0, per_bandwidth: int = 2048,
                  reach: float = 8.0, decimals: int | None = None) -> DataFrame:
    """D26's smooth curve: a Gaussian kernel density estimate as (point, x,
    density), at ``points`` places from ``cut`` bandwidths below the smallest
    value to as many above the largest. Bandwidth by Scott's rule, n^(-1/5)
    sample deviations.

    One aggregate gives the range and the bandwidth. Values are then binned
    linearly: each gives a part of its weight to the two nearest nodes of a
    grid with ``per_bandwidth`` nodes a bandwidth, which changes the curve by
    at most 1 / (8 per_bandwidth^2) of its curvature's scale. The kernel goes over
    the nodes alone (their number follows the range, not the rows), up to
    ``reach`` bandwidths. No curve (no rows) for fewer than two different values.
    """
    x = F.col(c).cast("double")
    base = df.select(x.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    n, std, low, high = base.agg(F.count("v"), F.stddev_samp("v"), F.min("v"), F.max("v")).first()
    if n < 2 or not std:
        return df.sparkSession.createDataFrame([], "point int, x double, density double")
    h = std * n ** -0.2
    cells = max(1, math.ceil((high - low) / h * per_bandwidth))
    width, first = (high - low) / cells, low - cut * h
    step = (high + cut * h - first) / (points - 1)
    place = (F.col("v") - F.lit(low)) / F.lit(width)
    cell = F.least(F.floor(place), F.lit(cells - 1))
    sums = base.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.sum(place - cell).alias("beyond"))
    nodes = (sums.select(F.explode(F.array(F.struct(F.col("cell").alias("node"), (F.col("n") - F.col("beyond")).alias("w")),
                                           F.struct((F.col("cell") + 1).alias("node"), F.col("beyond").alias("w")))).alias("s"))
             .groupBy("s.node").agg(F.sum("s.w").alias("w"))
             .select((F.lit(low) + F.col("node") * F.lit(width)).alias("v"), "w"))
    begin = F.greatest(F.ceil((F.col("v") - F.lit(reach * h + first)) / F.lit(step)), F.lit(0))
    end = F.least(F.floor((F.col("v") + F.lit(reach * h - first)) / F.lit(step)), F.lit(points - 1))
    near = nodes.where(begin <= end).select("v", "w", F.explode(F.sequence(begin.cast("int"), end.cast("int"))).alias("point"))
    off = (F.lit(first) + F.col("point") * F.lit(step) - F.col("v")) / F.lit(h)
    height = near.groupBy("point").agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * off * off)).alias("k"))
    density = F.coalesce(F.col("k"), F.lit(0.0)) / F.lit(n * h * math.sqrt(2 * math.pi))
    at = F.lit(first) + F.col("point") * F.lit(step)
    out = df.sparkSession.range(points).select(F.col("id").cast("int").alias("point")).join(height, "point", "left")
    if decimals is not None:
        at, density = half_even(at, 6), half_even(density, decimals)
    return out.select("point", at.alias("x"), density.alias("density"))


def curve_mass(curve: DataFrame) -> DataFrame:
    """(mass): the area below a curve of evenly spaced points, by trapezoids."""
    ends = F.sum(F.when(F.col("point") == 0, F.col("density")).otherwise(0.0)) + F.max_by("density", "point")
    step = (F.max("x") - F.min("x")) / (F.count("*") - 1)
    return curve.agg(((F.sum("density") - ends / 2) * step).alias("mass"))


def box_stats(df: DataFrame, c: str, by: str | None = None, decimals: int = 6) -> DataFrame:
    """Box-plot statistics (overall or per group): quartiles, whiskers at the
    furthest value inside 1.5 IQR, outlier count."""
    g = [by] if by else []
    base = df.where(F.col(c).isNotNull() & (F.col(by).isNotNull() if by else F.lit(True)))
    base = base.select(*g, F.col(c).cast("double").alias(c))
    qs = ordinal.exact_quantiles(base, c, [0.25, 0.5, 0.75], g)
    qs = qs.select(*g, "n", F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    lim = qs.select(*g, "n", "q1", "median", "q3",
                    (F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1"))).alias("lo_fence"),
                    (F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))).alias("hi_fence"))
    if g:
        # one row per group: no hint, AQE broadcasts it when the measured
        # size is small and keeps a shuffle join when the key has many groups
        joined = base.join(lim, g)
    else:
        st = lim.select(F.struct(*lim.columns)).scalar()
        joined = base.withColumns({k: st[k] for k in lim.columns})
    x = F.col(c)
    inside = (x >= F.col("lo_fence")) & (x <= F.col("hi_fence"))
    out = joined.groupBy(*g).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))
    return out.select(*g, "n", *[half_even(k, decimals).alias(k) for k in
                                 ("q1", "median", "q3", "whisker_low", "whisker_high")], "outliers")


def box_stats_all(df: DataFrame, columns: Sequence[str] | None = None, decimals: int = 6) -> DataFrame:
    """Box-plot statistics of every numeric column, one row per column, from
    two reads of the table (quartiles, then whiskers), not two per column."""
    cols = list(columns or numeric_columns(df))
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in cols])).alias("kv")).select("kv.*")
    return box_stats(long, "value", "column_name", decimals)


def scatter_bins(df: DataFrame, x: str, y: str, hue: str, x_width: float, y_width: float) -> DataFrame:
    """D29 at scale: 2-D binned counts of (x, y) per hue instead of raw points."""
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
            .groupBy(F.floor(F.col(x) / x_width).cast("long").alias("x_bin"),
                     F.floor(F.col(y) / y_width).cast("long").alias("y_bin"), F.col(hue))
            .agg(F.count(F.lit(1)).alias("count")))


# --- D30, D31 ------------------------------------------------------------------------

_TYPE_NAMES = {ByteType: "int8", ShortType: "int16", IntegerType: "int32", LongType: "int64",
               FloatType: "float32", DoubleType: "float64", StringType: "string"}


def schema_listing(spark, df: DataFrame) -> DataFrame:
    """Name, type, nullability and position of every column (from the schema,
    no data read)."""
    rows = []
    for i, f in enumerate(df.schema.fields, start=1):
        t = f.dataType
        dtype = "decimal" if isinstance(t, DecimalType) else _TYPE_NAMES.get(type(t), t.simpleString())
        rows.append((i, f.name, t.simpleString(), dtype, "YES" if f.nullable else "NO"))
    return spark.createDataFrame(rows, "ordinal_position int, column_name string, data_type string, "
                                       "pandas_dtype string, is_nullable string")


def validation_report(spark, df: DataFrame, exclude: Sequence[str] = ("row_no",)) -> DataFrame:
    """Shape, null counts, repeated rows and types as one long table
    (check, column_name, value)."""
    cols = [c for c in df.columns if c not in exclude]
    body = df.select(*cols)
    shape = body.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("rows").alias("check"), F.lit(None).cast("string").alias("column_name"),
        F.col("n").cast("string").alias("value"))
    ncols = spark.range(1).select(F.lit("columns").alias("check"),
                                  F.lit(None).cast("string").alias("column_name"),
                                  F.lit(str(len(cols))).alias("value"))
    nulls = null_counts(body).select(F.lit("missing").alias("check"), "column_name",
                                     F.col("null_count").cast("string").alias("value"))
    dups = repeated_rows(body, exclude=()).select(
        F.lit("duplicate_rows").alias("check"), F.lit(None).cast("string").alias("column_name"),
        F.col("DuplicateRows").cast("string").alias("value"))
    types = schema_listing(spark, body).select(F.lit("dtype").alias("check"), "column_name",
                                               F.col("data_type").alias("value"))
    return shape.unionByName(ncols).unionByName(nulls).unionByName(dups).unionByName(types)


def churn_by_geography(df: DataFrame, label: str = "ChurnValue", decimals: int = 6) -> DataFrame:
    """Claimed geographic analysis: customers, churned and churn rate per (State, City)."""
    return (df.where(F.col("State").isNotNull() & F.col("City").isNotNull())
            .groupBy("State", "City")
            .agg(F.count(F.lit(1)).alias("Customers"),
                 F.count_if(F.col(label) == 1).alias("Churned"),
                 half_even(F.count_if(F.col(label) == 1) * F.lit(100.0) / F.count(F.lit(1)), decimals)
                 .alias("ChurnRate")))
