"""Scaling, feature selection and cross-validation (claimed by the original, without code there).

Selection and scaling are single aggregates over the feature frame;
cross-validation deals rows to folds by a hash, so that a row's fold depends
on nothing but the row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.functions.numeric import half_even
from churnkit.operators import models
from churnkit.operators.evaluate import binary_metrics_by


def _q(name: str) -> Column:
    return F.col(f"`{name}`").cast("double")


def f_values(df: DataFrame, k: int = 15, features: Sequence[str] = K.FEATURE_COLUMNS, label: str = "ChurnValue",
             decimals: int = 4) -> DataFrame:
    """(feature, f_value, place, chosen): the one-way ANOVA F of each feature
    over the label's classes, and the ``k`` largest.

    One aggregation by label gives rows, mean and variance of all features; F is
    the variance between classes over the variance within. A feature that is
    constant has no F (null) and comes last; one that varies between classes
    only has an infinite F. F equal to ``decimals`` places: feature order. Rows without a label do not
    count; nulls in a feature count as 0, as in the feature frame.
    """
    zero = [F.coalesce(_q(f), F.lit(0.0)).alias(f"x{i}") for i, f in enumerate(features)]
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), *zero)
    wide = rows.groupBy("label").agg(F.count("*").cast("double").alias("n"), *[
        F.struct(F.avg(f"x{i}").alias("mean"), F.var_pop(f"x{i}").alias("var")).alias(f"s{i}") for i in range(len(features))])
    # one row per class from here on
    cells = wide.select("n", F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), F.col(f"s{i}.mean").alias("mean"), F.col(f"s{i}.var").alias("var"))
        for i, f in enumerate(features)])).alias("c")).select("n", "c.*")
    whole = Window.partitionBy("pos")
    grand = F.sum(F.col("n") * F.col("mean")).over(whole) / F.sum("n").over(whole)
    sums = cells.withColumn("grand", grand).groupBy("pos", "feature").agg(
        F.sum("n").alias("rows"), F.count("*").alias("classes"),
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("between"),
        F.sum(F.col("n") * F.col("var")).alias("within"))
    inside = F.col("within") / (F.col("rows") - F.col("classes"))
    value = (F.when(F.col("between") + F.col("within") == 0, None).when(F.col("within") == 0, F.lit(float("inf")))
             .otherwise(F.col("between") / (F.col("classes") - 1) / inside))
    placed = sums.select("pos", "feature", half_even(value, decimals).alias("f")).withColumn(
        "place", F.row_number().over(Window.orderBy(F.desc_nulls_last("f"), F.asc("pos"))))      # one row per feature
    return placed.select("feature", F.col("f").alias("f_value"), "place",
                         (F.col("f").isNotNull() & (F.col("place") <= k)).alias("chosen"))


def chosen_features(df: DataFrame, k: int = 15, **how) -> list[str]:
    """Names of the ``k`` chosen features, best first."""
    return [r["feature"] for r in f_values(df, k, **how).where("chosen").orderBy("place").collect()]


def standardised(df: DataFrame, fitted_on: DataFrame, features: Sequence[str] = K.FEATURE_COLUMNS,
                 keep: Sequence[str] = ("row_no",), decimals: int | None = None) -> DataFrame:
    """The features with mean 0 and sample deviation 1 on ``fitted_on``; a
    feature that is constant there gives 0. One aggregate is read as a scalar
    and every row is projected; nothing is shuffled."""
    stats = fitted_on.select(F.struct(*[
        F.struct(F.avg(_q(f)).alias("mean"), F.stddev_samp(_q(f)).alias("std")).alias(f"s{i}") for i, f in enumerate(features)])).scalar()
    d = df.withColumn("__stats", stats)
    out = []
    for i, f in enumerate(features):
        mean, std = F.col(f"__stats.s{i}.mean"), F.col(f"__stats.s{i}.std")
        x = F.when(std > 0, (_q(f) - mean) / std).otherwise(F.lit(0.0))
        out.append((half_even(x, decimals) if decimals is not None else x).alias(f))
    return d.select(*keep, *out)


def with_fold(df: DataFrame, folds: int = 5, keys: Sequence[str] = ("customerID", "row_no"), seed: int = 42,
              out: str = "fold") -> DataFrame:
    """``df`` with a fold from 0 to ``folds`` - 1 by a hash of its keys."""
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.withColumn(out, F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(folds)).cast("int"))


def out_of_fold(df: DataFrame, name: str, folds: int = 5, label: str = "ChurnValue", seed: int = 42, **how) -> DataFrame:
    """Every labelled row once, with the probability given by a model that was
    trained on the other folds: ``df`` plus fold, trained_on (rows that model
    saw), churn_probability and predicted. ``folds`` models are trained; they
    are the only thing that the driver holds."""
    dealt = with_fold(df.where(F.col(label).isNotNull()), folds, seed=seed)
    sizes = {r["fold"]: r["count"] for r in dealt.groupBy("fold").count().collect()}        # one row per fold
    out = None
    for fold in sorted(sizes):
        others = dealt.where(F.col("fold") != fold)
        n = sum(sizes.values()) - sizes[fold]
        model = models.fit(others, name, label, **({"n_train": n} if name == "logistic_regression" else {}), **how)
        scored = models.predict(model, dealt.where(F.col("fold") == fold)).withColumn("trained_on", F.lit(n).cast("long"))
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        empty = dealt.withColumns({"churn_probability": F.lit(None).cast("double"), "predicted": F.lit(None).cast("int")})
        return empty.withColumn("trained_on", F.lit(None).cast("long"))
    return out


def fold_metrics(scored: DataFrame, label: str = "ChurnValue", decimals: int = 6) -> DataFrame:
    """Accuracy, precision, recall and F1 of each fold of ``out_of_fold``, one aggregation."""
    return binary_metrics_by(scored, "fold", label, "predicted", decimals)
