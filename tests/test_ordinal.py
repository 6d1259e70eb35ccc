"""Bucketed running sums and exact quantiles against brute force."""

import numpy as np
from pyspark.sql import functions as F

from churnkit.operators import evaluate as EV
from churnkit.operators import ordinal


def test_running_count_matches_global_order(spark):
    rng = np.random.default_rng(1)
    flags = rng.integers(0, 2, 500).tolist()
    df = spark.createDataFrame([(i * 3, f) for i, f in enumerate(flags)], "row_no long, blank long")
    out = ordinal.running_sum(df, F.col("blank"), [F.col("row_no")],
                              ordinal.range_bucket(F.col("row_no"), 64), "cum")
    got = {r.row_no: r.cum for r in out.collect()}
    assert [got[i * 3] for i in range(500)] == np.cumsum(flags).tolist()


def test_row_number_partitioned(spark):
    rows = [(i % 3, (i * 7919) % 1000) for i in range(300)]
    df = spark.createDataFrame(rows, "g int, v long")
    out = ordinal.row_number(df, [F.col("v")], F.floor(F.col("v") / 100), "rn", ["g"]).collect()
    for g in range(3):
        vals = sorted(r.v for r in out if r.g == g)
        assert sorted((r.v, r.rn) for r in out if r.g == g) == [(v, i + 1) for i, v in enumerate(vals)]


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    vals = np.round(rng.gamma(2.0, 30.0, 777), 2)
    vals[:200] = 42.0                                   # a heavy tie
    df = spark.createDataFrame([(float(v), int(i % 2)) for i, v in enumerate(vals)], "x double, g int")
    q = ordinal.exact_quantiles(df, "x", [0.1, 0.25, 0.5, 0.75, 0.99]).first()
    expect = np.percentile(vals, [10, 25, 50, 75, 99])
    assert np.allclose([q.q0, q.q1, q.q2, q.q3, q.q4], expect, rtol=0, atol=1e-9)
    qg = {r.g: r for r in ordinal.exact_quantiles(df, "x", [0.5], ["g"]).collect()}
    for g in (0, 1):
        assert abs(qg[g].q0 - np.median(vals[np.arange(777) % 2 == g])) < 1e-9


def test_quantiles_and_sums_over_many_ranges(spark):
    rng = np.random.default_rng(9)
    vals = np.round(rng.gamma(2.0, 30.0, 900), 2)
    vals[:300] = 42.0                                   # one value holds a third of the rows
    groups = np.where(np.arange(900) % 10 < 7, "big", np.array([f"g{i}" for i in np.arange(900) % 5]))
    df = spark.createDataFrame([(float(v), str(g)) for v, g in zip(vals, groups)], "x double, g string")
    q = ordinal.exact_quantiles(df, "x", [0.1, 0.5, 0.99], per_bucket=40).first()
    assert np.allclose([q.q0, q.q1, q.q2], np.percentile(vals, [10, 50, 99]), rtol=0, atol=1e-9)
    for r in ordinal.exact_quantiles(df, "x", [0.25, 0.5], ["g"], per_bucket=40).collect():
        assert np.allclose([r.q0, r.q1], np.percentile(vals[groups == r.g], [25, 50]), rtol=0, atol=1e-9)
    counts = df.groupBy("x").agg(F.count("*").alias("n"))
    for down in (False, True):
        got = ordinal.running_sums(counts, "x", {"n": ("run", "all")}, descending=down, per_bucket=25).collect()
        assert {r["all"] for r in got} == {900}
        for r in got:
            assert r.run == ((vals >= r.x) if down else (vals <= r.x)).sum()


def test_a_row_meets_no_list_of_bounds(spark):
    """With ten thousand buckets the plan is the same as with two: one range exchange."""
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    plans = [ordinal.range_parts(df, [F.asc("x")], n, "b")._jdf.queryExecution().executedPlan().toString() for n in (2, 10_000)]
    assert "rangepartitioning" in plans[1] and ", 10000)" in plans[1]
    assert plans[1].count("Exchange") == 1 and "filter(" not in plans[1].lower().replace("filtered", "")
    assert abs(len(plans[0]) - len(plans[1])) < 40
    ranges = ordinal.range_parts(df, [F.desc("x")], 50, "b").groupBy("b").agg(F.min("x"), F.max("x")).orderBy("b").collect()
    assert all(a[1] > b[2] for a, b in zip(ranges, ranges[1:]))


def test_auc_matches_pairwise_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.5 + y * 0.2, 2)      # ties on purpose
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    got = EV.roc_auc(df).first().roc_auc
    pos, neg = s[y == 1], s[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got - brute) < 1e-6
    roc = EV.roc_curve(df).where("threshold is not null").orderBy(F.desc("threshold")).collect()
    last = roc[-1]
    assert last.fpr == 1.0 and last.tpr == 1.0 and len(roc) == len(set(s.tolist()))


def test_stratified_split_sizes(spark):
    rows = [(f"c{i}", i, int(i % 4 == 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "customerID string, row_no long, ChurnValue int")
    sp = EV.stratified_split(df)
    counts = {(r.split, r.ChurnValue): r.rows for r in EV.split_sizes(sp).collect()}
    assert counts[("test", 1)] == 50 and counts[("test", 0)] == 150
    assert counts[("train", 1)] == 200 and counts[("train", 0)] == 600


def test_split_borders_do_not_depend_on_how_they_are_found(spark):
    import hashlib
    rows = [(f"c{i % 7}", None if i == 50 else i, (i % 3 if i % 11 else None)) for i in range(600)]
    df = spark.createDataFrame(rows, "customerID string, row_no long, y int")
    expected = {}
    for y in range(3):
        own = sorted((hashlib.md5("|".join([c, *([str(n)] if n is not None else []), "42"]).encode()).hexdigest(), n is not None, n or 0)
                     for c, n, label in rows if label == y)
        expected[y] = sorted(((y, n if known else None) for _, known, n in own[:int(0.3 * len(own) + 0.5)]), key=str)
    for how in ({}, {"hex_digits": 1, "border_rows": 3}, {"hex_digits": 2, "border_rows": 0}):
        got = EV.stratified_split(df, "y", test_fraction=0.3, **how).where("split = 'test'").select("y", "row_no").collect()
        for y in range(3):
            assert sorted((tuple(r) for r in got if r.y == y), key=str) == expected[y]
    assert EV.stratified_split(df.limit(0), "y").count() == 0
    assert EV.stratified_split(df, "y", test_fraction=0.0).where("split = 'test'").count() == 0
