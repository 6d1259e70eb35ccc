"""Model training, selection and persistence with Spark ML.

The four model families of the original map to Spark ML estimators over the
fixed 30-feature vector. Training is distributed by Spark ML itself
(tree-aggregate of gradients / histograms per partition); nothing is
collected except the fitted model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnkit import constants as K
from churnkit.operators.evaluate import binary_metrics, binary_metrics_by
from churnkit.sources.files import path_exists


# Tree training: let each pass over the data split more nodes at once (fewer
# passes); deep forests also cache node ids between iterations (checkpointed
# into the shared checkpoint folder every 10 iterations, so lineage stays
# short). Boosting's shallow trees gain nothing from the node-id cache.
TREE_PERF = dict(maxMemoryInMB=1024, cacheNodeIds=True)


def estimator(name: str, n_train: int | None = None, seed: int = 42, num_trees: int = 200,
              max_depth: int = 10, rounds: int = 100):
    """One of the four families (plus the README's decision tree); the defaults
    are the original's sizes (tree depth 10 instead of unlimited)."""
    if name == "logistic_regression":
        # sklearn's C=1 penalises 0.5*||w||^2 against the summed loss; Spark
        # scales the loss by 1/n, so regParam = 1/n approximates it.
        reg = 1.0 / n_train if n_train else 0.0
        return LogisticRegression(maxIter=5000, regParam=reg, elasticNetParam=0.0, standardization=False)
    if name == "random_forest":
        return RandomForestClassifier(numTrees=num_trees, featureSubsetStrategy="sqrt", seed=seed,
                                      maxDepth=max_depth, **TREE_PERF)
    if name == "gradient_boosting":        # stands in for XGBoost
        return GBTClassifier(maxIter=rounds, maxDepth=6, stepSize=0.3, seed=seed, maxMemoryInMB=1024)
    if name == "gradient_boosting_fast":   # stands in for LightGBM: more, shallower trees
        return GBTClassifier(maxIter=rounds, maxDepth=3, stepSize=0.2, seed=seed, subsamplingRate=0.8,
                             maxMemoryInMB=1024)
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=max_depth, seed=seed, **TREE_PERF)
    raise ValueError(f"unknown model {name}")


MODEL_NAMES = ["logistic_regression", "random_forest", "gradient_boosting", "gradient_boosting_fast"]
DISPLAY_NAMES = {"logistic_regression": "Logistic Regression", "random_forest": "Random Forest",
                 "gradient_boosting": "XGBoost (GBT)", "gradient_boosting_fast": "LightGBM (GBT)",
                 "decision_tree": "Decision Tree"}


def pipeline(name: str, **kw) -> Pipeline:
    """VectorAssembler over the fixed feature list + estimator (A13: the
    feature order is persisted inside the pipeline)."""
    va = VectorAssembler(inputCols=list(K.FEATURE_COLUMNS), outputCol="features", handleInvalid="keep")
    return Pipeline(stages=[va, estimator(name, **kw)])


def fit(train: DataFrame, name: str, label: str = "ChurnValue", **kw) -> PipelineModel:
    data = train.withColumn("label", F.col(label).cast("double"))
    return pipeline(name, **kw).fit(data)


def together(jobs: dict[str, Callable[[], PipelineModel]]) -> dict[str, PipelineModel]:
    """The results of ``jobs``, run at the same time: boosting's many short
    passes leave cores idle that another family's training can use."""
    with ThreadPoolExecutor(max(1, len(jobs))) as pool:
        in_session = inheritable_thread_target(SparkSession.active())
        found = {name: pool.submit(in_session(job)) for name, job in jobs.items()}
        return {name: f.result() for name, f in found.items()}


def predict(model: PipelineModel, df: DataFrame, threshold: float = K.CHURN_CUTOFF) -> DataFrame:
    """Class-1 probability and class at ``threshold``."""
    out = model.transform(df.drop("features", "label", "churn_probability", "predicted"))
    p = vector_to_array(F.col("probability"))[1]
    out = out.withColumn("churn_probability", F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))
    out = out.drop("features", "rawPrediction", "prediction", "probability")
    return out.withColumn("predicted", (F.col("churn_probability") >= threshold).cast("int"))


def evaluate_model(model: PipelineModel, test: DataFrame, label: str = "ChurnValue") -> DataFrame:
    scored = predict(model, test)
    return binary_metrics(scored, label=label, pred="predicted")


def choose_best(comparison: DataFrame) -> DataFrame:
    """Best by F1, then accuracy, then name (a top-1 over <= 5 rows)."""
    return comparison.orderBy(F.desc("f1"), F.desc("accuracy"), F.asc("Model")).limit(1)


def predictions(models: dict[str, PipelineModel], test: DataFrame, label: str = "ChurnValue", keep: Sequence[str] = ()) -> DataFrame:
    """(Model, label, prediction) of every row of ``test`` by every model, and the columns ``keep`` of the scored row."""
    out = None
    for name, model in models.items():
        one = predict(model, test).select(F.lit(DISPLAY_NAMES[name]).alias("Model"), F.col(label).alias("label"),
                                          F.col("predicted").alias("prediction"), *keep)
        out = one if out is None else out.unionByName(one)
    return out


def compare(models: dict[str, PipelineModel], test: DataFrame, label: str = "ChurnValue", scored: DataFrame | None = None) -> DataFrame:
    """I16: metrics of every model on ``test``, each scored once; ``best`` marks
    the choice of ``choose_best``. ``scored``: what ``predictions`` gave for them, where it is already written."""
    table = binary_metrics_by(predictions(models, test, label) if scored is None else scored, "Model")
    place = F.row_number().over(Window.orderBy(F.desc("f1"), F.desc("accuracy"), F.asc("Model")))   # one row per model
    return table.withColumn("best", place == 1)


def save_best(models: dict[str, PipelineModel], test: DataFrame, path: str, label: str = "ChurnValue",
              scored: DataFrame | None = None) -> str:
    """I16 + I17 in one step: compare on ``test``, save the best model at
    ``path`` (overwriting) and return its name. A model cached from ``path`` is forgotten."""
    shown = compare(models, test, label, scored).where("best").first()["Model"]
    best = next(name for name in models if DISPLAY_NAMES[name] == shown)
    save_model(models[best], path)
    _CACHE.pop(path, None)
    return best


def save_model(model: PipelineModel, path: str) -> str:
    """Spark ML persistence (overwrite)."""
    model.write().overwrite().save(path)
    return path


_CACHE: dict[str, PipelineModel] = {}


def load_model(path: str, force_reload: bool = False) -> PipelineModel | None:
    """Cached per process; None when missing, an error when unreadable."""
    if not force_reload and path in _CACHE:
        return _CACHE[path]
    if not is_model_available(path):
        return None
    _CACHE[path] = PipelineModel.load(path)
    return _CACHE[path]


def is_model_available(path: str) -> bool:
    """Whether a saved model stands at ``path`` (any store Spark reads)."""
    return path_exists(SparkSession.active(), f"{path.rstrip('/')}/metadata")


def feature_importances(model: PipelineModel) -> list[tuple[str, float]]:
    """Impurity importances of a tree model, by feature name."""
    est = model.stages[-1]
    imp = getattr(est, "featureImportances", None)
    if imp is None:
        return []
    return list(zip(K.FEATURE_COLUMNS, imp.toArray().tolist()))


# --- README claims without code in the original: tuning, scaling, selection -------

def tuned(train: DataFrame, name: str = "logistic_regression", label: str = "ChurnValue",
          folds: int = 3, seed: int = 42, parallelism: int = 4):
    """Cross-validated grid search (AUC) over a small grid of the family's
    main knobs; returns the CrossValidatorModel (``bestModel``, ``avgMetrics``)."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    pipe = pipeline(name)
    est = pipe.getStages()[-1]
    grid = ParamGridBuilder()
    if name == "logistic_regression":
        grid = grid.addGrid(est.regParam, [0.0, 0.01, 0.1])
    elif name in ("random_forest", "decision_tree"):
        grid = grid.addGrid(est.maxDepth, [5, 10])
    else:
        grid = grid.addGrid(est.maxDepth, [3, 5])
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=grid.build(), numFolds=folds, seed=seed,
                        parallelism=parallelism,
                        evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"))
    return cv.fit(train.withColumn("label", F.col(label).cast("double")))


def scaled_selected_pipeline(name: str = "logistic_regression", k: int = 15, **kw) -> Pipeline:
    """Feature scaling and selection: standardise the 30 features, keep the
    ``k`` best by an F-test against the label, then the estimator."""
    from pyspark.ml.feature import StandardScaler, UnivariateFeatureSelector
    va = VectorAssembler(inputCols=list(K.FEATURE_COLUMNS), outputCol="raw_features", handleInvalid="keep")
    sc = StandardScaler(inputCol="raw_features", outputCol="scaled", withMean=True, withStd=True)
    sel = (UnivariateFeatureSelector(featuresCol="scaled", outputCol="features", labelCol="label",
                                     selectionMode="numTopFeatures")
           .setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k))
    return Pipeline(stages=[va, sc, sel, estimator(name, **kw)])
