"""Feature construction (inventory I1-I3, A13).

The 30-column frame is one projection of ``when`` flags and casts over the
cleaned rows: no shuffle, fully inside whole-stage codegen. Key and business
columns travel beside the features (never inside the vector, X5).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.functions.cache import session_cached


def feature_columns() -> list[str]:
    return list(K.FEATURE_COLUMNS)


def _feature_exprs() -> dict:
    cols = {}
    for feat, src in K.NUMERIC_FEATURES:
        cols[feat] = F.coalesce(F.col(src).cast("double"), F.lit(0.0))
    for feat, src, value in K.FLAG_FEATURES:
        cols[feat] = F.when(F.col(src) == F.lit(value), F.lit(1)).otherwise(F.lit(0))
    return cols


def add_features(cleaned: DataFrame) -> DataFrame:
    """Append the fixed 30 features; unknown category values give zeros."""
    return cleaned.withColumns(session_cached("features", _feature_exprs))


def feature_frame(cleaned: DataFrame, keep: Sequence[str] = ("row_no", "customerID")) -> DataFrame:
    """I2 output as the model sees it: keys, then the 30 features in order."""
    return add_features(cleaned).select(*[c for c in keep if c in cleaned.columns],
                                        *[F.col(f"`{f}`") for f in K.FEATURE_COLUMNS])


def feature_listing(spark) -> DataFrame:
    """The persisted feature order as (position, feature)."""
    return spark.createDataFrame(list(enumerate(K.FEATURE_COLUMNS, start=1)),
                                 "position int, feature string")


def category_levels(df: DataFrame, columns: Sequence[str], max_levels: int = 1000) -> dict[str, list]:
    """Sorted distinct levels per column, for I1 when the caller does not
    state them. The levels become columns, so they come to the driver; the
    guard counts them where they are and brings over one more than allowed at
    most, so a column of free text is refused without being gathered."""
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    found = cells.where(F.col("v").isNotNull()).distinct().limit(max_levels * len(columns) + 1).collect()
    out = {c: sorted(r["v"] for r in found if r["c"] == c) for c in columns}
    for c, levels in out.items():
        if len(levels) > max_levels or len(found) > max_levels * len(columns):
            raise ValueError(f"{c}: {len(levels)} levels or more exceed max_levels={max_levels}")
    return out


def one_hot_drop_first(df: DataFrame, columns: Sequence[str],
                       levels: dict[str, list] | None = None) -> DataFrame:
    """``pd.get_dummies(columns, drop_first=True)``.

    Levels are sorted; the first is dropped; a null gives all zeros. Output
    columns are named ``{column}_{level}`` and replace the source columns.
    """
    levels = levels or category_levels(df, columns)
    out = df
    for c in columns:
        lv = sorted(levels[c])
        out = out.withColumns({f"{c}_{v}": F.when(F.col(c) == F.lit(v), 1).otherwise(0) for v in lv[1:]})
    return out.drop(*columns)


def assemble(df: DataFrame, label: str | None = "ChurnValue", output: str = "features") -> DataFrame:
    """Feature vector plus label (the vector order is the fixed list)."""
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=list(K.FEATURE_COLUMNS), outputCol=output, handleInvalid="keep")
    out = va.transform(df)
    if label:
        out = out.withColumn("label", F.col(label).cast("double"))
    return out
