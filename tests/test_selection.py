"""Density curve, ANOVA selection, scaling and out-of-fold scoring against direct computation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.operators import features as FT
from churnkit.operators import profile as PR
from churnkit.operators import selection as SEL
from churnkit.plans import catalog


@pytest.fixture(scope="module")
def frame(spark, sf_dir):
    return FT.add_features(catalog.cleaned(spark, sf_dir)).where("ChurnValue is not null").checkpoint()


def test_density_is_the_direct_sum(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([np.full(200, 42.0), np.round(rng.normal(70, 20, 400), 2)])      # one value holds a third of the rows
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "v double")
    for cut in (0.0, 2.0):
        got = PR.density_curve(df, "v", points=50, cut=cut).orderBy("point").collect()
        h = v.std(ddof=1) * len(v) ** -0.2
        x = np.linspace(v.min() - cut * h, v.max() + cut * h, 50)
        direct = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert np.allclose([r.x for r in got], x) and np.allclose([r.density for r in got], direct, atol=1e-7)
    assert abs(PR.curve_mass(PR.density_curve(df, "v", cut=8.0)).first().mass - 1) < 1e-6


@pytest.mark.parametrize("rows", [[], [(5.0,)], [(5.0,), (5.0,), (None,)]])
def test_no_curve_without_spread(spark, rows):
    assert PR.density_curve(spark.createDataFrame(rows, "v double"), "v").collect() == []


def test_f_values_and_choice_are_the_selector_s(frame):
    from pyspark.ml.feature import UnivariateFeatureSelector, VectorAssembler
    got = {r.feature: r for r in SEL.f_values(frame, 8).collect()}
    data = VectorAssembler(inputCols=list(K.FEATURE_COLUMNS), outputCol="features").transform(
        frame.withColumn("label", F.col("ChurnValue").cast("double")))
    table = frame.select("ChurnValue", *[F.col(f"`{f}`").cast("double") for f in K.FEATURE_COLUMNS]).toPandas()
    for f in K.FEATURE_COLUMNS:
        parts = [own.to_numpy() for _, own in table.groupby("ChurnValue")[f]]
        x, n, k = table[f].to_numpy(), len(table), len(parts)
        between = sum(len(p) * (p.mean() - x.mean()) ** 2 for p in parts) / (k - 1)
        assert got[f].f_value == pytest.approx(between / (sum(((p - p.mean()) ** 2).sum() for p in parts) / (n - k)), abs=1e-3)
    selector = (UnivariateFeatureSelector(featuresCol="features", labelCol="label", selectionMode="numTopFeatures")
                .setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(8))
    theirs = {K.FEATURE_COLUMNS[i] for i in selector.fit(data).selectedFeatures}
    assert {f for f, r in got.items() if r.chosen} == theirs == set(SEL.chosen_features(frame, 8))


def test_constant_and_separating_features(spark):
    rows = [(i % 2, 3.0, float(i % 2), float(i)) for i in range(20)] + [(None, 9.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "ChurnValue int, same double, split double, x double")
    got = {r.feature: (r.f_value, r.place, r.chosen) for r in SEL.f_values(df, 3, ["same", "split", "x"]).collect()}
    assert got["same"] == (None, 3, False) and got["split"] == (float("inf"), 1, True)
    scaled = SEL.standardised(df.where("ChurnValue is not null"), df.where("ChurnValue is not null"), ["same", "x"], keep=()).collect()
    assert {r.same for r in scaled} == {0.0}
    assert np.mean([r.x for r in scaled]) == pytest.approx(0) and np.std([r.x for r in scaled], ddof=1) == pytest.approx(1)


def test_every_row_is_scored_by_a_model_that_has_not_seen_it(frame, monkeypatch):
    seen = []
    fit = SEL.models.fit

    def watched(train, name, label="ChurnValue", **kw):
        seen.append({r.row_no for r in train.select("row_no").collect()})
        return fit(train, name, label, **kw)
    monkeypatch.setattr(SEL.models, "fit", watched)
    rows = SEL.out_of_fold(frame.drop("churn_probability"), "decision_tree", 3, max_depth=3).select(
        "row_no", "fold", "trained_on", "churn_probability").collect()
    assert sorted(r.row_no for r in rows) == sorted(r.row_no for r in frame.select("row_no").collect())
    for fold, trained in enumerate(seen):
        own = {r.row_no for r in rows if r.fold == fold}
        assert own and not own & trained and {r.trained_on for r in rows if r.fold == fold} == {len(trained)}
    assert all(0 <= r.churn_probability <= 1 for r in rows)
    assert SEL.out_of_fold(frame.limit(0), "decision_tree").count() == 0
