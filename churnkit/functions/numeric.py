"""Numeric coercion and rounding with pandas/NumPy semantics.

All functions return Columns; nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal number with optional sign and exponent. Refuses text such as
# "1d", "NaN", "inf" that Spark's cast would accept but pandas would not.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_number(c) -> Column:
    """``pd.to_numeric(errors="coerce")``: bad text becomes null (never NaN)."""
    t = F.trim(_col(c).cast("string"))
    return F.when(t.rlike(NUMBER_PATTERN), t.try_cast("double"))


def half_even(c, decimals: int) -> Column:
    """NumPy ``round``: half-even on the scaled binary value, ``rint(x*10^k)/10^k``."""
    scale = float(10 ** decimals)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def clip(c, lo, hi) -> Column:
    """``clip(lo, hi)``; nulls stay null (coalesce first when a fill is wanted)."""
    x = _col(c)
    return F.when(x.isNull(), None).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def to_int_trunc(c) -> Column:
    """``astype(int)``: truncation toward zero."""
    return _col(c).cast("int")


def sigmoid(z) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(z)))
