"""Classifiers: registry, search, cross-validation, storage."""

from __future__ import annotations

import random
from collections.abc import Callable
from itertools import product

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.operators.evaluate import metrics
from tracewarden.session import bounded_rows

DEEPEST = 30  # deepest tree Spark grows; stands for "no limit"


def _svm(p: dict) -> Estimator:
    """Linear SVM whose margin is calibrated to a probability. ``C`` weighs the loss of all rows against the norm."""
    reg = 1.0 / (float(p.get("C", 1.0)) * max(int(p.get("n_rows", 1)), 1))
    svm = LinearSVC(regParam=reg, maxIter=int(p.get("max_iter", 100)), predictionCol="svm_prediction")
    margin = VectorSlicer(inputCol="rawPrediction", outputCol="margin", indices=[1])
    platt = LogisticRegression(featuresCol="margin", rawPredictionCol="platt_raw", probabilityCol="probability", predictionCol="prediction", maxIter=50, tol=1e-4)
    return Pipeline(stages=[svm, margin, platt])


def _forest(p: dict) -> Estimator:
    return RandomForestClassifier(
        numTrees=int(p.get("n_estimators", 100)), maxDepth=min(int(p.get("max_depth") or DEEPEST), DEEPEST),
        seed=int(p.get("random_state", 42)),
    )


def _tree(p: dict) -> Estimator:
    return DecisionTreeClassifier(
        maxDepth=min(int(p.get("max_depth") or DEEPEST), DEEPEST), impurity=p.get("criterion", "gini"),
        minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=int(p.get("random_state", 42)),
    )


def _bayes(p: dict) -> Estimator:
    return NaiveBayes(modelType="multinomial", smoothing=float(p.get("alpha", 1.0)))


def _mlp(p: dict) -> Estimator:
    layers = [int(p["n_features"]), *[int(n) for n in p.get("hidden_layer_sizes", (64,))], 2]
    return MultilayerPerceptronClassifier(layers=layers, maxIter=int(p.get("max_iter", 200)), seed=int(p.get("random_state", 42)))


MODELS: dict[str, Callable[[dict], Estimator]] = {
    "svm": _svm, "random_forest": _forest, "decision_tree": _tree, "naive_bayes": _bayes, "mlp": _mlp,
}

# Search grids.
GRIDS: dict[str, dict[str, list]] = {
    "svm": {"C": [0.1, 1, 10, 100]},
    "random_forest": {"n_estimators": [50, 100, 200], "max_depth": [None, 10, 20]},
    "decision_tree": {"max_depth": [None, 5, 10, 15], "min_samples_leaf": [1, 2, 4], "criterion": ["gini", "entropy"]},
    "naive_bayes": {"alpha": [0.01, 0.1, 0.5, 1.0, 5.0, 10.0]},
    "mlp": {"hidden_layer_sizes": [(32,), (64,), (32, 32), (64, 32)], "max_iter": [100, 200, 300]},
}


def register_model(kind: str, factory: Callable[[dict], Estimator]) -> None:
    """Add a user's own estimator to the registry."""
    MODELS[kind] = factory


def get_model(kind: str, params: dict | None = None) -> Estimator:
    if kind.lower() not in MODELS:
        raise ValueError(f"unknown model type: {kind}; known: {sorted(MODELS)}")
    return MODELS[kind.lower()](params or {})


def combinations(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def f1_evaluator() -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0, beta=1.0)


def _search(train: DataFrame, kind: str, candidates: list[dict], fixed: dict, fold_col: str, parallelism: int) -> tuple[dict, CrossValidatorModel]:
    """Cross-validate whole estimators: the pipeline's stages are the parameter that varies."""
    n_folds = train.agg(F.max(fold_col)).first()[0] + 1
    holder = Pipeline(stages=[])
    maps = [{holder.stages: [get_model(kind, {**fixed, **c})]} for c in candidates]
    search = CrossValidator(
        estimator=holder, estimatorParamMaps=maps, evaluator=f1_evaluator(), numFolds=n_folds, foldCol=fold_col, parallelism=parallelism
    ).fit(train)
    best = max(range(len(candidates)), key=lambda i: (search.avgMetrics[i], -i))
    return candidates[best], search


def tune_grid(train: DataFrame, kind: str, grid: dict[str, list] | None = None, fixed: dict | None = None, fold_col: str = "fold", parallelism: int = 4):
    """All combinations; returns the best one by mean F1 and the fitted search."""
    return _search(train, kind, combinations(grid or GRIDS[kind]), fixed or {}, fold_col, parallelism)


def tune_random(train: DataFrame, kind: str, n_iter: int, grid: dict[str, list] | None = None, fixed: dict | None = None, seed: int = 42, fold_col: str = "fold", parallelism: int = 4):
    """A seeded sample of the combinations."""
    every = combinations(grid or GRIDS[kind])
    return _search(train, kind, random.Random(seed).sample(every, min(n_iter, len(every))), fixed or {}, fold_col, parallelism)


def search_table(spark: SparkSession, candidates: list[dict], scores: list[float]) -> DataFrame:
    return spark.createDataFrame([(str(c), float(s)) for c, s in zip(candidates, scores)], "params string, f1 double")


def best_params(results: DataFrame, params: str = "params", score: str = "f1") -> DataFrame:
    """Parameters with the best mean score; ties go to the smaller text."""
    means = results.groupBy(params).agg(F.avg(score).alias("mean_score"))
    return means.orderBy(F.desc("mean_score"), params).limit(1)


def cross_validate(df: DataFrame, kind: str, params: dict | None = None, fold_col: str = "fold") -> tuple[DataFrame, DataFrame, object]:
    """Metrics per fold, their means, and the model refitted on all rows."""
    folds = [r[0] for r in bounded_rows(df.select(fold_col).distinct(), 100, "folds")]
    scored = None
    for fold in sorted(folds):
        model = get_model(kind, params).fit(df.filter(F.col(fold_col) != fold))
        part = model.transform(df.filter(F.col(fold_col) == fold)).select(fold_col, "label", "prediction")
        scored = part if scored is None else scored.unionByName(part)
    per_fold = metrics(scored, [fold_col])
    means = per_fold.agg(*[F.avg(m).alias(m) for m in ("accuracy", "precision", "recall", "f1")])
    return per_fold, means, get_model(kind, params).fit(df)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """Load a stored pipeline; a missing path is an error that names it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"no model at {path}")
    return PipelineModel.load(path)
