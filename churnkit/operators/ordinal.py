"""Row numbers and running sums without a global window.

A window with ``orderBy`` and no ``partitionBy`` moves every row into one
task. These helpers split the ordered rows
into buckets that are monotone in the sort order, count each bucket (a small
aggregate), turn the counts into per-bucket offsets over that small table, and
finish with a window per bucket. Each task therefore sees one bucket; how the
one-row-per-bucket offsets meet the rows is left to adaptive execution.

Buckets are ranges of a dense key such as ``row_no`` (``range_bucket``), or the
partitions that Spark's range partitioner makes of the values (``range_parts``):
a row finds its partition in the exchange, and its bucket is the partition's
number, so no row carries or compares a list of bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BKT, _OFF = "__bkt", "__off"


def running_sum(df: DataFrame, value: Column, order_cols: Sequence, bucket: Column,
                out: str, partition_cols: Sequence[str] = ()) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``value`` in ``order_cols`` order
    (per ``partition_cols``).

    ``bucket`` must be non-decreasing along the order within a partition; there
    is one offset row per partition key and bucket, and the rows of a bucket
    bound the work of a single task.
    """
    part = list(partition_cols)
    d = df.withColumn(_BKT, F.col(bucket) if isinstance(bucket, str) else bucket).withColumn("__v", value)
    totals = d.groupBy(*part, _BKT).agg(F.sum("__v").alias("__tot"))
    w = Window.partitionBy(*part).orderBy(_BKT)
    offsets = totals.select(*part, _BKT, (F.sum("__tot").over(w) - F.col("__tot")).alias(_OFF))
    # one row per (partition key, bucket): adaptive execution broadcasts it when
    # it is small, else the join's shuffle by bucket serves the window as well
    d = d.join(offsets, [*part, _BKT], "inner")
    wb = (Window.partitionBy(*part, _BKT).orderBy(*order_cols)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (d.withColumn(out, F.sum("__v").over(wb) + F.col(_OFF))
            .drop(_BKT, _OFF, "__v"))


def row_number(df: DataFrame, order_cols: Sequence, bucket: Column, out: str,
               partition_cols: Sequence[str] = ()) -> DataFrame:
    """1-based row number in ``order_cols`` order (per ``partition_cols``)."""
    return running_sum(df, F.lit(1).cast("long"), order_cols, bucket, out, partition_cols)


def range_bucket(c: Column, width: int) -> Column:
    """Bucket for a dense integer order key such as ``row_no``."""
    return F.floor(c / F.lit(width)).cast("long")


def range_parts(df: DataFrame, order: Sequence[Column], parts: int, out: str) -> DataFrame:
    """``df`` in ``parts`` ranges of ``order``, with the number of its range as
    ``out``: numbers rise with the order. Spark samples the order for balanced
    ranges, so the result must be written before it is used twice."""
    return df.repartitionByRange(parts, *order).withColumn(out, F.spark_partition_id())


def _bucketed(df: DataFrame, order: Sequence[Column], per_bucket: int, out: str) -> DataFrame:
    """A written ``df`` with buckets of about ``per_bucket`` rows, monotone in ``order``."""
    parts = max(1, -(-df.count() // per_bucket))
    if parts == 1:
        return df.withColumn(out, F.lit(0))
    return range_parts(df, order, parts, out).checkpoint(eager=True)


def running_sums(df: DataFrame, order: str, sums: dict[str, tuple[str, str]], descending: bool = False,
                 per_bucket: int = 100_000) -> DataFrame:
    """Several inclusive running sums over the distinct values of ``order`` in
    one pass: ``sums`` maps a column to the names of its running sum and of
    its total.

    ``df`` has one row per value. It is written to the checkpoint folder,
    counted, and cut into ranges of about ``per_bucket`` rows, so buckets
    follow the data; bucket totals become offsets over one row per bucket.
    """
    df = df.checkpoint(eager=True)
    by = F.desc(order) if descending else F.asc(order)
    d = _bucketed(df, [by], per_bucket, _BKT)
    totals = d.groupBy(_BKT).agg(*(F.sum(c).alias(f"__t_{c}") for c in sums))
    before, whole = Window.orderBy(_BKT), Window.partitionBy()
    offsets = totals.select(
        _BKT, *((F.sum(f"__t_{c}").over(before) - F.col(f"__t_{c}")).alias(f"__o_{c}") for c in sums),
        *(F.sum(f"__t_{c}").over(whole).alias(total) for c, (_, total) in sums.items()))
    inside = Window.partitionBy(_BKT).orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = d.join(offsets, _BKT)
    return out.select(*df.columns, *((F.sum(c).over(inside) + F.col(f"__o_{c}")).alias(run) for c, (run, _) in sums.items()),
                      *(total for _, total in sums.values()))


def exact_quantiles(df: DataFrame, c: str, probs: Sequence[float], group_cols: Sequence[str] = (),
                    per_bucket: int = 100_000, prefix: str = "q") -> DataFrame:
    """Exact, linearly interpolated quantiles (NumPy/pandas "linear" rule)
    without gathering a group's values in one task.

    Rows are first reduced to (group, value, count) — map-side — then a
    bucketed running count gives each distinct value its rank interval, and
    one more aggregate picks the values at the two ranks around each target
    position. Work per task is bounded by values per bucket. Output: ``group_cols`` plus
    ``{prefix}{i}`` per probability, and ``n`` (non-null count).
    """
    g = list(group_cols)
    vals = (df.where(F.col(c).isNotNull()).groupBy(*g, c)
            .agg(F.count(F.lit(1)).alias("__cnt"))).checkpoint(eager=True)
    # Ranges of (group, distinct value): each holds a similar number of them
    # whatever the skew, and a large group spreads over several.
    bucketed = _bucketed(vals, [F.asc(x) for x in (*g, c)], per_bucket, "__qb")
    ranked = running_sum(bucketed, F.col("__cnt"), [F.col(c)], "__qb", "__cum", g).drop("__qb")
    sizes = vals.groupBy(*g).agg(F.sum("__cnt").alias("__n"))
    ranked = ranked.join(sizes, g) if g else ranked.withColumn("__n", sizes.select("__n").scalar())
    aggs = [F.first("__n").alias("n")]
    for i, p in enumerate(probs):
        h = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        aggs.append(F.min(F.when(F.col("__cum") > lo, F.col(c))).alias(f"__lo{i}"))
        aggs.append(F.min(F.when(F.col("__cum") > hi, F.col(c))).alias(f"__hi{i}"))
        aggs.append(F.first(h - lo).alias(f"__t{i}"))
    out = ranked.groupBy(*g).agg(*aggs)
    cols = [*g, "n"]
    for i, _ in enumerate(probs):
        a, b, t = F.col(f"__lo{i}").cast("double"), F.col(f"__hi{i}").cast("double"), F.col(f"__t{i}")
        d = b - a
        # NumPy's lerp: a + d*t, or b - d*(1-t) when t >= 0.5
        out = out.withColumn(f"{prefix}{i}", F.when(t >= 0.5, b - d * (F.lit(1.0) - t)).otherwise(a + d * t))
        cols.append(f"{prefix}{i}")
    return out.select(*cols)
