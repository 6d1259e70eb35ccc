"""Spark ML families, persistence, tuning and the scaled/selected pipeline."""

import os
import tempfile

from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.operators import evaluate as EV
from churnkit.operators import models as MD
from churnkit.plans import catalog as CAT


def test_fit_save_load_and_feature_order(spark, sf_dir):
    train, test = CAT._train_test(spark, sf_dir)
    model = MD.fit(train, "logistic_regression", n_train=train.count())
    path = os.path.join(tempfile.mkdtemp(prefix="churnkit-model-"), "lr")
    MD.save_model(model, path)
    again = MD.load_model(path, force_reload=True)
    assert again is not None and MD.load_model(path) is again
    assert again.stages[0].getInputCols() == K.FEATURE_COLUMNS          # A13
    a = MD.predict(model, test).select("row_no", "churn_probability").collect()
    b = MD.predict(again, test).select("row_no", "churn_probability").collect()
    assert a == b
    assert MD.load_model(os.path.join(path, "missing")) is None


def test_scorecard_label_is_learnable(spark, sf_dir):
    # planted signal: the scorecard's own decision is the label
    s = CAT.scored(spark, sf_dir).withColumn("ChurnValue", (F.col("churn_probability") >= 0.5).cast("int"))
    train, test = EV.stratified_split(s).where("split = 'train'"), EV.stratified_split(s).where("split = 'test'")
    model = MD.fit(train, "logistic_regression", n_train=train.count())
    scored = MD.predict(model, test).select(F.col("ChurnValue").alias("label"), F.col("churn_probability").alias("score"))
    assert EV.roc_auc(scored).first().roc_auc > 0.75     # well above chance (0.5)


def test_tuning_and_selection(spark, sf_dir):
    train, _ = CAT._train_test(spark, sf_dir)
    cvm = MD.tuned(train, "logistic_regression", folds=2)
    assert len(cvm.avgMetrics) == 3
    pipe = MD.scaled_selected_pipeline("logistic_regression", k=10)
    m = pipe.fit(train.withColumn("label", F.col("ChurnValue").cast("double")))
    assert len(m.stages[2].selectedFeatures) == 10


def test_best_model_is_saved_in_one_step(spark, sf_dir):
    """The saved model is the comparison's choice, also where an older model stood at the path."""
    train, test = CAT._train_test(spark, sf_dir)
    models = {"logistic_regression": MD.fit(train, "logistic_regression", n_train=train.count()),
              "decision_tree": MD.fit(train, "decision_tree", max_depth=3)}
    table = {r["Model"]: r for r in MD.compare(models, test).collect()}
    want = min(table.values(), key=lambda r: (-r["f1"], -r["accuracy"], r["Model"]))["Model"]
    assert [m for m, r in table.items() if r["best"]] == [want]
    path = os.path.join(tempfile.mkdtemp(prefix="churnkit-model-"), "best")
    other = next(n for n in models if MD.DISPLAY_NAMES[n] != want)
    MD.save_model(models[other], path)
    assert MD.load_model(path) is not None                # now cached
    best = MD.save_best(models, test, path)
    assert MD.DISPLAY_NAMES[best] == want
    again = MD.load_model(path)
    assert type(again.stages[-1]) is type(models[best].stages[-1])
    a, b = (MD.predict(m, test).select("row_no", "churn_probability").collect() for m in (again, models[best]))
    assert sorted(a) == sorted(b)


def test_saved_best_scores_each_model_once(spark, sf_dir, monkeypatch):
    """Comparison, totals and the saved best read one table of scores; the reloaded model alone is scored again."""
    train, _ = CAT._train_test(spark, sf_dir)
    models = {n: MD.fit(train, "decision_tree", max_depth=d) for n, d in zip(MD.MODEL_NAMES, (1, 2, 3, 4), strict=True)}
    scored = []
    plain = MD.predict
    monkeypatch.setattr(CAT, "fitted", lambda spark, sf_dir, name: models[name])
    monkeypatch.setattr(CAT, "staged", lambda spark, name, sf_dir, build, real=CAT.staged: real(spark, f"{name}-once" if name == "model_scores" else name, sf_dir, build))
    monkeypatch.setattr(MD, "predict", lambda model, df, *a: scored.append(model) or plain(model, df, *a))
    CAT.q_i16(spark, sf_dir).collect()
    CAT.q_i16_totals(spark, sf_dir).collect()
    out = CAT.q_i17(spark, sf_dir).collect()
    assert len(scored) == len(models) + 1
    assert all(r["differing"] == 0 and r["is_best"] for r in out) and sum(r["rows"] for r in out) > 0
