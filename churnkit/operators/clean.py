"""Projection, validation and cleaning operators (inventory B3-B19).

Every public function maps DataFrame -> DataFrame and uses only Catalyst
expressions. Batch statistics (the MonthlyCharges median) enter as scalar
subqueries, so the plan stays lazy and nothing is collected to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from churnkit import constants as K
from churnkit.functions.cache import session_cached
from churnkit.functions.numeric import parse_number
from churnkit.operators import ordinal, repeats


class PreprocessingError(ValueError):
    """Input cannot be cleaned (schema-level problem)."""


# --- B3 --------------------------------------------------------------------

def drop_columns(df: DataFrame, columns: Iterable[str], strict: bool = True) -> DataFrame:
    """``df.drop(columns, errors="raise"|"ignore")``."""
    columns = list(columns)
    if strict:
        absent = [c for c in columns if c not in df.columns]
        if absent:
            raise PreprocessingError(f"columns not found: {absent}")
    return df.drop(*columns)


# --- B4 --------------------------------------------------------------------

def normalize_columns(df: DataFrame, aliases: dict[str, str] = K.ALIASES) -> DataFrame:
    """Trim header text and map legacy/SQL spellings to canonical names."""
    names = [aliases.get(str(c).strip(), str(c).strip()) for c in df.columns]
    lowered = [n.lower() for n in names]
    dup = sorted({n for n in names if lowered.count(n.lower()) > 1})
    if dup:
        raise PreprocessingError(f"column names collide after normalising: {dup}")
    return df.toDF(*names)


# --- B5 --------------------------------------------------------------------

def require_columns(df: DataFrame, required: Iterable[str] = K.REQUIRED_COLUMNS,
                    check_empty: bool = False) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise PreprocessingError(
            "The uploaded CSV is missing required column(s): " + ", ".join(missing))
    if check_empty and df.isEmpty():     # one LIMIT 1 job, only when asked
        raise PreprocessingError("The uploaded CSV contains no customer rows.")
    return df


# --- B6 --------------------------------------------------------------------

def fill_customer_ids(df: DataFrame, order_col: str = "row_no", mode: str = "ordinal",
                      bucket_width: int = 1 << 20) -> DataFrame:
    """Blank ids get ``ROW-n``: the n-th blank row in input order (counting
    blanks, not rows). Without an id column every row is blank.

    ``mode="ordinal"`` reproduces the count exactly with a bucketed running
    count (no global window); ``mode="hash"`` gives a batch-independent
    ``ROW-<hash>`` for streams, where no global order exists.
    """
    if "customerID" not in df.columns:
        df = df.withColumn("customerID", F.lit(None).cast(StringType()))
    cid = F.coalesce(F.col("customerID").cast("string"), F.lit(""))
    blank = F.trim(cid) == ""
    if mode == "hash":
        # batch-independent: a hash of the record's own business fields
        fields = [F.col(c) for c in df.columns if c not in ("customerID", order_col)]
        gen = F.concat(F.lit("ROW-"), F.substring(F.sha2(F.to_json(F.struct(*fields)), 256), 1, 16))
        return df.withColumn("customerID", F.when(blank, gen).otherwise(cid))
    # Only blank rows need a number: they alone go through the bucketed
    # ranking (one shuffle of the blank rows); the rest pass through unshuffled.
    flagged = df.withColumn("__blank", blank)
    blanks = flagged.where(F.col("__blank"))
    numbered = ordinal.row_number(blanks, [F.col(order_col)],
                                  ordinal.range_bucket(F.col(order_col), bucket_width), "__nblank")
    numbered = (numbered.withColumn("customerID", F.concat(F.lit("ROW-"), F.col("__nblank").cast("string")))
                .select(*df.columns))
    rest = flagged.where(~F.col("__blank")).withColumn("customerID", cid).select(*df.columns)
    return rest.unionByName(numbered)


# --- B7-B10 -----------------------------------------------------------------

def coerce_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Text to double, unparsable to null."""
    return df.withColumns({c: parse_number(c) for c in columns})


def batch_median(df: DataFrame, c: str | Column, mode: str = "exact") -> Column:
    """Scalar-subquery median of a column (exact and interpolated by default).

    The exact form ranks the distinct values in buckets
    (:func:`ordinal.exact_quantiles`), so no task gathers them all;
    ``mode="approx"`` is one pass of ``percentile_approx``.
    """
    col = F.col(c) if isinstance(c, str) else c
    if mode != "exact":
        return df.select(F.percentile_approx(col, 0.5, 100000)).scalar()
    return ordinal.exact_quantiles(df.select(col.alias("__median_of")), "__median_of", [0.5]).select("q0").scalar()


def fill_median(df: DataFrame, c: str, fallback: float | None = None,
                median_mode: str = "exact", frozen: float | None = None) -> DataFrame:
    """Nulls get the batch median; ``fallback`` when nothing parses.

    ``frozen`` replaces the batch statistic (single records, streams).
    """
    med = F.lit(frozen) if frozen is not None else batch_median(df, c, median_mode)
    filled = F.coalesce(F.col(c), med)
    if fallback is not None:
        filled = F.coalesce(filled, F.lit(float(fallback)))
    return df.withColumn(c, filled)


def clip_int(c: str | Column, lo: int, hi: int, fill: int = 0) -> Column:
    """``fillna(fill).clip(lo, hi).astype(int)``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.least(F.greatest(F.coalesce(col, F.lit(float(fill))), F.lit(float(lo))),
                   F.lit(float(hi))).cast("int")


# --- B11, B12 --------------------------------------------------------------

def yes_no(c: str) -> Column:
    """Trimmed Yes/No kept (case-sensitive), anything else No."""
    t = F.trim(F.col(c).cast("string"))
    return F.when(t.isin("Yes", "No"), t).otherwise(F.lit("No"))


def category_default(c: str, default: str) -> Column:
    """Trim; null or blank gets the default; unknown values are kept."""
    return F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(default))


def senior_flag(c: str = "SeniorCitizen") -> Column:
    """0/1 from 1/0 or Yes/No text; other text 0; truncated, then clipped."""
    t = F.trim(F.col(c).cast("string"))
    num = F.when(t == "Yes", F.lit(1.0)).when(t == "No", F.lit(0.0)).otherwise(parse_number(c))
    return F.least(F.greatest(F.coalesce(num, F.lit(0.0)).cast("int"), F.lit(0)), F.lit(1))


# --- B13-B16 ----------------------------------------------------------------

def fill_constant(df: DataFrame, c: str, value) -> DataFrame:
    """B13."""
    return df.na.fill({c: value})


def narrow_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts in one projection."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


def drop_duplicate_rows(df: DataFrame, order_col: str | None = "row_no") -> DataFrame:
    """Remove identical rows, keeping the first occurrence's ``order_col``.

    Rows are told apart by a narrow hash first (:mod:`repeats`); only rows
    whose hash repeats are grouped by their columns.
    """
    if order_col is None or order_col not in df.columns:
        return df.dropDuplicates()
    return repeats.drop_repeats(df, order_col)


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column."""
    return df.withColumns({f.name: F.trim(F.col(f.name)) for f in df.schema.fields
                           if isinstance(f.dataType, StringType)})


# --- B17, B20 ----------------------------------------------------------------

def where_equals(df: DataFrame, c: str, value) -> DataFrame:
    """B17."""
    return df.filter(F.col(c) == F.lit(value))


def preview(df: DataFrame, columns: Iterable[str] | None = None, n: int = 5,
            order_col: str = "row_no") -> DataFrame:
    """``df[cols].head(n)`` in input order (a distributed top-n)."""
    cols = list(columns) if columns else df.columns
    if order_col in df.columns and order_col not in cols:
        cols = [order_col] + cols
    return df.select(*cols).orderBy(order_col).limit(n)


# --- B18 -----------------------------------------------------------------------

# Python float() grammar: whitespace, sign, digits with "_" groups, inf/nan.
FLOAT_TEXT = (r"(?i)^\s*[+-]?(inf|infinity|nan|(([0-9](_?[0-9])*)([.]([0-9](_?[0-9])*)?)?"
              r"|[.][0-9](_?[0-9])*)([e][+-]?[0-9](_?[0-9])*)?)\s*$")


def _py_float(c: str) -> Column:
    t = F.col(c).cast("string")
    v = F.regexp_replace(F.trim(t), "_", "").try_cast("double")
    return F.when(t.rlike(FLOAT_TEXT), v)


def validate_records(df: DataFrame) -> DataFrame:
    """Add ``validation_error`` (null when valid) with the first failing
    check, in the original order: missing fields, tenure not a whole number,
    tenure out of 0..100, MonthlyCharges not numeric."""
    req = [c for c in K.REQUIRED_COLUMNS if c != "TotalCharges"]
    present = set(df.columns)
    missing_parts = []
    for c in req:
        if c in present:
            v = F.col(c).cast("string")
            missing_parts.append(F.when(v.isNull() | (v == ""), F.lit(c)))
        else:
            missing_parts.append(F.lit(c))
    missing = F.concat_ws(", ", *missing_parts)
    ten = _py_float("tenure") if "tenure" in present else F.lit(None).cast("double")
    ten_ok = ten.isNotNull() & ~F.isnan(ten) & (F.abs(ten) != F.lit(float("inf")))
    ten_trunc = F.when(ten_ok, F.when(ten >= 0, F.floor(ten)).otherwise(F.ceil(ten)))
    monthly = _py_float("MonthlyCharges") if "MonthlyCharges" in present else F.lit(None).cast("double")
    err = (F.when(missing != "", F.concat(F.lit("Missing required field(s): "), missing))
           .when(~ten_ok, F.lit("'tenure' must be a whole number of months."))
           .when((ten_trunc < 0) | (ten_trunc > K.TENURE_MAX),
                 F.lit("'tenure' must be between 0 and 100 months."))
           .when(monthly.isNull(), F.lit("'MonthlyCharges' must be numeric.")))
    return df.withColumn("validation_error", err)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid and rejected rows of :func:`validate_records` output."""
    v = validate_records(df)
    return (v.filter(F.col("validation_error").isNull()).drop("validation_error"),
            v.filter(F.col("validation_error").isNotNull()))


# --- B19 ---------------------------------------------------------------------

def clean_accounts(df: DataFrame, id_mode: str = "ordinal", median_mode: str = "exact",
                   frozen_monthly_median: float | None = None, check_empty: bool = False,
                   order_col: str = "row_no") -> DataFrame:
    """Whole cleaning step for scoring (B4-B12), as one lazy plan.

    Output keeps every input column; the canonical ones are typed: tenure
    int, SeniorCitizen int, MonthlyCharges/TotalCharges double, categories
    trimmed string. Other business columns ride along untouched.
    """
    df = normalize_columns(df)
    df = require_columns(df, check_empty=check_empty)
    if order_col not in df.columns:
        # Input order of a single read; exact across files only with one writer.
        df = df.withColumn(order_col, F.monotonically_increasing_id())
    monthly = parse_number("MonthlyCharges")
    # The batch median reads only the raw column: a scan-and-aggregate
    # subquery, independent of the id numbering below.
    med = (F.lit(float(frozen_monthly_median)) if frozen_monthly_median is not None
           else batch_median(df, monthly, median_mode))
    df = fill_customer_ids(df, order_col, mode=id_mode)
    df = df.withColumns({
        "tenure": clip_int(parse_number("tenure"), 0, K.TENURE_MAX),
        "MonthlyCharges": F.coalesce(monthly, med, F.lit(K.MONTHLY_FALLBACK)),
        "SeniorCitizen": senior_flag("SeniorCitizen"),
    })
    df = df.withColumn("TotalCharges", F.coalesce(
        parse_number("TotalCharges") if "TotalCharges" in df.columns else F.lit(None).cast("double"),
        F.col("tenure") * F.col("MonthlyCharges")))
    return df.withColumns(session_cached("categories", lambda: {
        **{c: yes_no(c) for c in K.YES_NO_COLUMNS},
        **{c: category_default(c, d) for c, d in K.CATEGORY_DEFAULTS.items()}}))


def clean_for_analysis(df: DataFrame) -> DataFrame:
    """Offline cleaning (notebook order with X10 applied): trim strings, coerce
    and median-fill TotalCharges, fill the churn reason, narrow types, then
    drop identical rows keeping the first ``row_no``."""
    df = trim_strings(df)
    df = coerce_numeric(df, ["TotalCharges", "MonthlyCharges", "tenure"])
    df = fill_median(df, "TotalCharges")
    df = fill_constant(df, "ChurnReason", "Not Churned")
    df = narrow_types(df, {"tenure": "short", "ChurnValue": "byte", "ChurnScore": "short",
                           "CLTV": "int", "MonthlyCharges": "float", "TotalCharges": "float"})
    return drop_duplicate_rows(df)
