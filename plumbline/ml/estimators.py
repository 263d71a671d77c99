"""The model families, each as a function from a prepared frame to a fitted pipeline.

A prepared frame has `features` and `label` (and `row_key` for neighbours).  Every fitted
model adds `prediction`, and for classification `probability`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.ml.boosted_trees import boosted_trees
from plumbline.ml.boosting import boosted_stumps
from plumbline.ml.forests import grown
from plumbline.ml.kernels import RandomFourierFeatures
from plumbline.operators.neighbors import knn_classify, knn_regress

SEED = 42


@dataclass(frozen=True)
class Shape:
    """What an estimator may need to know about its training frame."""

    rows: int
    width: int
    classes: int  # 0 for regression
    label_std: float = 1.0  # population deviation of a regression label


CALIBRATION_STEPS = 25


def _calibration(raw: str, shape: Shape) -> LogisticRegression:
    """Probabilities for a margin model: a lightly penalised logistic fit on its raw scores."""
    return LogisticRegression(featuresCol=raw, labelCol="label", maxIter=CALIBRATION_STEPS, regParam=1.0 / max(shape.rows, 1))


def logistic_regression(df: DataFrame, shape: Shape, C: float = 1.0, max_iter: int = 1000) -> PipelineModel:
    est = LogisticRegression(regParam=1.0 / (C * max(shape.rows, 1)), elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    return Pipeline(stages=[est]).fit(df)


def _svc(features: str, shape: Shape, C: float, max_iter: int):
    svc = LinearSVC(featuresCol=features, regParam=1.0 / (C * max(shape.rows, 1)), maxIter=max_iter, tol=1e-4, standardization=False)
    if shape.classes > 2:
        return OneVsRest(classifier=svc, featuresCol=features, predictionCol="margin_prediction", rawPredictionCol="margin")
    return svc.setPredictionCol("margin_prediction").setRawPredictionCol("margin")


def linear_svm(df: DataFrame, shape: Shape, C: float = 1.0, max_iter: int = 50) -> PipelineModel:
    return Pipeline(stages=[_svc("features", shape, C, max_iter), _calibration("margin", shape)]).fit(df)


def rbf_svm(df: DataFrame, shape: Shape, C: float = 1.0, gamma: float | None = None, size: int = 128, max_iter: int = 50) -> PipelineModel:
    """Approximate kernel machine: random Fourier features, then a linear margin."""
    kernel = RandomFourierFeatures(
        inputCol="features", outputCol="kernel_features", size=size, gamma=float(gamma or 1.0 / max(shape.width, 1)), width=shape.width, seed=SEED
    )
    margin = _svc("kernel_features", shape, C, max_iter)
    # the projection runs once, not once per optimizer step
    projected = kernel.transform(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = Pipeline(stages=[margin, _calibration("margin", shape)]).fit(projected)
    finally:
        projected.unpersist()
    return PipelineModel([kernel, *fitted.stages])


def decision_tree(df: DataFrame, shape: Shape, max_depth: int = 10, min_leaf: int = 1) -> PipelineModel:
    """A tree on histograms of profiles; see `ml.forests`."""
    return grown(df, shape.width, shape.classes, 1, max_depth, min_leaf)


def random_forest(df: DataFrame, shape: Shape, n_estimators: int = 100, max_depth: int = 10, min_leaf: int = 1) -> PipelineModel:
    """Trees on histograms of profiles for classes; numbers are left to Spark's, as profiles do not tell the sum of drawn rows."""
    if shape.classes:
        return grown(df, shape.width, shape.classes, n_estimators, max_depth, min_leaf, bootstrap=True, seed=SEED)
    return Pipeline(stages=[RandomForestRegressor(numTrees=n_estimators, maxDepth=max_depth, minInstancesPerNode=min_leaf, seed=SEED)]).fit(df)


def gradient_boosting(
    df: DataFrame, shape: Shape, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3, subsample: float = 1.0
) -> PipelineModel:
    """Trees on histograms for two classes or numbers; rows drawn anew for each tree, and more classes, are left to Spark's."""
    if subsample == 1.0 and shape.classes in (0, 2):
        return boosted_trees(df, shape.width, shape.classes, n_estimators, learning_rate, max_depth)
    options = dict(maxIter=n_estimators, stepSize=learning_rate, maxDepth=max_depth, subsamplingRate=subsample, seed=SEED)
    if not shape.classes:
        return Pipeline(stages=[GBTRegressor(**options)]).fit(df)
    if shape.classes == 2:
        return Pipeline(stages=[GBTClassifier(**options)]).fit(df)
    each = OneVsRest(classifier=GBTClassifier(**options), predictionCol="margin_prediction", rawPredictionCol="margin")
    return Pipeline(stages=[each, _calibration("margin", shape)]).fit(df)


def mlp(df: DataFrame, shape: Shape, hidden: tuple[int, ...] = (64, 32), max_iter: int = 320) -> PipelineModel:
    layers = [shape.width, *hidden, shape.classes]
    return Pipeline(stages=[MultilayerPerceptronClassifier(layers=layers, maxIter=max_iter, seed=SEED)]).fit(df)


def deep_mlp(df: DataFrame, shape: Shape, max_iter: int = 420) -> PipelineModel:
    return mlp(df, shape, (256, 128, 64), max_iter)


def ridge(df: DataFrame, shape: Shape, alpha: float = 1.0) -> PipelineModel:
    """Ridge with penalty `alpha`; Spark scales its penalty by rows and by the label's deviation."""
    reg = alpha / max(shape.rows, 1) * shape.label_std
    return Pipeline(stages=[LinearRegression(regParam=reg, elasticNetParam=0.0, standardization=False)]).fit(df)


def adaboost(df: DataFrame, shape: Shape, n_estimators: int = 160, learning_rate: float = 1.0, checkpoint_every: int = 20) -> PipelineModel:
    """Boosted stumps; see `ml.boosting`."""
    return boosted_stumps(df, shape.width, shape.classes, n_estimators, learning_rate, checkpoint_every)


class NeighborModel(Model):
    """k nearest neighbours of the training rows; needs a unique `row_key` on both sides."""

    def __init__(self, train: DataFrame, classes: int, k: int):
        super().__init__()
        self.classes, self.k = classes, k
        self.base = train.select(F.col("row_key").alias("id"), vector_to_array("features").alias("v"), "label")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        asked = dataset.select(F.col("row_key").alias("id"), vector_to_array("features").alias("v"))
        predict = knn_classify if self.classes else knn_regress
        found = predict(asked, self.base, "label", self.k).withColumnRenamed("query_id", "row_key")
        return dataset.join(found.select("row_key", F.col("prediction").cast("double").alias("prediction")), "row_key", "left")


def knn(df: DataFrame, shape: Shape, n_neighbors: int = 7) -> NeighborModel:
    return NeighborModel(df, shape.classes, n_neighbors)


Fitter = Callable[..., Model]

# Model names by task.
CLASSIFIERS: dict[str, Fitter] = {
    "Logistic Regression": logistic_regression,
    "Linear SVM": linear_svm,
    "RBF SVM": rbf_svm,
    "KNN": knn,
    "Decision Tree": decision_tree,
    "Random Forest": random_forest,
    "AdaBoost": adaboost,
    "Gradient Boosting": gradient_boosting,
    "MLP Neural Net": mlp,
    "Deep MLP Neural Net": deep_mlp,
}
REGRESSORS: dict[str, Fitter] = {
    "Linear Regression": ridge,
    "KNN": knn,
    "Decision Tree": decision_tree,
    "Random Forest": random_forest,
    "Gradient Boosting": gradient_boosting,
}


def fitters(task: str) -> dict[str, Fitter]:
    return CLASSIFIERS if task == "classification" else REGRESSORS


def shape_of(prepared: DataFrame, width: int, classes: int) -> Shape:
    row = prepared.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
    return Shape(row["n"], width, classes, row["s"] or 1.0)
