"""Repeated rows by hash, then exactly: against grouping in plain Python."""

import pytest
from pyspark.sql import functions as F

from churnkit.operators import repeats as RP

SCHEMA = "row_no long, a string, b double, c int"


def collide(df, keys):
    """Every row hashes alike."""
    return [F.lit(1).cast("long"), F.lit(2).cast("long")]


def few(df, keys):
    return [F.coalesce(F.length("a"), F.lit(0)).cast("long"), F.lit(2).cast("long")]


def rows():
    out = [(i, f"u{i}", float(i), None) for i in range(30)] + [(100 + i, "same", 1.5, 2) for i in range(25)]
    out += [(200, None, 1.0, 3), (201, None, 1.0, 3), (202, "x", None, None), (203, None, None, None), (204, "x", None, None)]
    return out + [(300, "z", 0.0, 1), (301, "z", -0.0, 1), (302, "z", float("nan"), 1), (303, "z", float("nan"), 1)]


def plain():
    least = {}
    for n, *key in rows():
        key = tuple("nan" if x != x else x + 0.0 if isinstance(x, float) else x for x in key)
        least[key] = min(n, least.get(key, n))
    return sorted(least.values())


@pytest.mark.parametrize("hashes", [RP.row_hash, collide, few])
def test_hashes_never_change_the_result(spark, hashes):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    assert sorted(r.row_no for r in RP.drop_repeats(df, "row_no", hashes).collect()) == plain()
    assert RP.count_repeats(df, ["a", "b", "c"], hashes).first()[0] == len(rows()) - len(plain())
    assert RP.drop_repeats(df.limit(0), "row_no", hashes).count() == 0
    assert RP.count_repeats(df.limit(0), ["a", "b", "c"], hashes).first()[0] == 0


def test_unique_rows_are_not_keyed_by_their_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    alone, _ = RP.split_repeats(df, ["a", "b", "c"])
    plan = alone._jdf.queryExecution().executedPlan().toString()
    keyed = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert keyed and all("hashpartitioning(__h1" in line for line in keyed)
