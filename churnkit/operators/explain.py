"""Attribution (inventory I18-I23).

Linear scorecard: exact Shapley values with independent features are
``phi_f = w_f * (x_f - mean_f)`` in margin (log-odds) space, where the means
come from a background frame. The means are one aggregation, entering as a
single struct-valued scalar subquery, rounded to 6 decimals so the
attribution is reproducible in SQL. Everything stays in native columns.

Tree ensembles: see :mod:`churnkit.operators.tree_shap` (Arrow batches).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.functions import rules as R
from churnkit.functions.numeric import half_even

BG_DECIMALS = 6


def _f(name: str) -> Column:
    return F.col(f"`{name}`")


def background_means(background: DataFrame) -> Column:
    """A struct column (scalar subquery) of feature means, ``m0..m29``."""
    aggs = [half_even(F.avg(_f(f)), BG_DECIMALS).alias(f"m{i}") for i, f in enumerate(K.FEATURE_COLUMNS)]
    return background.select(F.struct(*aggs)).scalar()


def contributions(df: DataFrame, background: DataFrame,
                  weights: dict[str, float] = K.SCORECARD_WEIGHTS, means: Column | None = None) -> Column:
    """``array<struct<pos, feature, value, phi>>`` of per-feature attributions."""
    means = background_means(background) if means is None else means
    items = []
    for i, f in enumerate(K.FEATURE_COLUMNS):
        x = _f(f).cast("double")
        phi = F.lit(float(weights.get(f, 0.0))) * (x - means[f"m{i}"])
        items.append(F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"),
                              x.alias("value"), phi.alias("phi")))
    return F.array(*items)


def frozen_means(values) -> Column:
    """Background means known beforehand, in feature order (single records)."""
    return F.struct(*(F.lit(float(v)).alias(f"m{i}") for i, v in enumerate(values)))


def base_margin(means: Column, weights: dict[str, float] = K.SCORECARD_WEIGHTS,
                intercept: float = K.SCORECARD_INTERCEPT) -> Column:
    base = F.lit(float(intercept))
    for i, f in enumerate(K.FEATURE_COLUMNS):
        base = base + F.lit(float(weights.get(f, 0.0))) * means[f"m{i}"]
    return base


def expected_value(background: DataFrame, weights: dict[str, float] = K.SCORECARD_WEIGHTS,
                   intercept: float = K.SCORECARD_INTERCEPT) -> DataFrame:
    """Base margin ``intercept + sum(w * mean)`` and its probability."""
    base = base_margin(background_means(background), weights, intercept)
    one = background.sparkSession.range(1)
    return one.select(half_even(base, 6).alias("base_margin"),
                      half_even(F.lit(1.0) / (F.lit(1.0) + F.exp(-base)), 6).alias("base_probability"))


def top_drivers(df: DataFrame, background: DataFrame | None, n: int = K.TOP_DRIVERS,
                means: Column | None = None) -> DataFrame:
    """Up to ``n`` readable drivers with positive attribution whose
    feature is numeric (four named) or set to 1; largest first (ties in
    feature order); null when none. ``means`` replaces the background."""
    # materialise the array first: lambdas may not contain the means subquery
    df = df.withColumn("__contrib", contributions(df, background, means=means))
    contrib = F.col("__contrib")
    numeric = F.array(*[F.lit(x) for x in K.DRIVER_NUMERIC])
    kept = F.filter(contrib, lambda s: (s["phi"] > 0) & (F.array_contains(numeric, s["feature"]) | (s["value"] == 1.0)))
    ordered = F.sort_array(F.transform(kept, lambda s: F.struct((-s["phi"]).alias("k"), s["pos"].alias("pos"),
                                                                s["feature"].alias("feature"))))
    names = F.transform(F.slice(ordered, 1, n), lambda s: R.driver_name(s["feature"]))
    return df.withColumn("top_drivers", F.when(F.size(names) > 0, names)).drop("__contrib")


def attribution_long(df: DataFrame, background: DataFrame, decimals: int = 6) -> DataFrame:
    """Long table (row_no, feature, value, phi) for summary/dependence plots."""
    out = df.select("row_no", F.explode(contributions(df, background)).alias("c"))
    return out.select("row_no", F.col("c.feature").alias("feature"), F.col("c.value").alias("value"),
                      half_even(F.col("c.phi"), decimals).alias("phi"))


def global_importance(df: DataFrame, background: DataFrame, decimals: int = 6) -> DataFrame:
    """Mean |phi| per feature, in one wide aggregation then long form."""
    contrib = contributions(df, background)
    wide = df.select(contrib.alias("c")).agg(*[
        F.avg(F.abs(F.col("c")[i]["phi"])).alias(f"i{i}") for i in range(len(K.FEATURE_COLUMNS))])
    pairs = ", ".join(f"{i}, `i{i}`" for i in range(len(K.FEATURE_COLUMNS)))
    long = wide.selectExpr(f"stack({len(K.FEATURE_COLUMNS)}, {pairs}) as (pos, importance)")
    names = F.array(*[F.lit(f) for f in K.FEATURE_COLUMNS])
    return (long.select(F.get(names, F.col("pos")).alias("Feature"),
                        half_even("importance", decimals).alias("Importance"))
            .orderBy(F.desc("Importance"), F.asc("Feature")))


def waterfall(df: DataFrame, background: DataFrame, row_no, decimals: int = 6,
              weights: dict[str, float] = K.SCORECARD_WEIGHTS,
              intercept: float = K.SCORECARD_INTERCEPT) -> DataFrame:
    """One customer's contributions by size with the running margin
    from the base value (30 rows; the running sum is over one customer)."""
    from pyspark.sql import Window
    target = row_no if hasattr(row_no, "_jc") else F.lit(row_no)
    one = df.where(F.col("row_no") == target)
    means = background_means(background)            # one subquery, used twice below
    base = half_even(base_margin(means, weights, intercept), 6)
    long = one.select("row_no", F.explode(contributions(one, background, weights, means)).alias("c")).select(
        "row_no", F.col("c.pos").alias("pos"), F.col("c.feature").alias("feature"),
        F.col("c.value").alias("value"), F.col("c.phi").alias("phi"))
    w = (Window.partitionBy("row_no").orderBy(F.desc(F.abs("phi")), F.asc("pos"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return long.select("row_no", "feature", "value", half_even("phi", decimals).alias("phi"),
                       F.row_number().over(Window.partitionBy("row_no").orderBy(F.desc(F.abs("phi")), F.asc("pos")))
                       .cast("long").alias("step"),
                       half_even(base + F.sum("phi").over(w), decimals).alias("cumulative_margin"))
