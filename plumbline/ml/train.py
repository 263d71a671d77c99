"""Training many models on one prepared table, with cross-validation, tuning and evaluation."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark import StorageLevel
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import quoted
from plumbline.functions.typing import columns_of, detect_task, normalised, numeric_columns
from plumbline.ml.estimators import Fitter, Shape, fitters, shape_of
from plumbline.ml.importance import feature_importance
from plumbline.ml.prepare import Preparation, encode_label, fit_preparation, label_levels
from plumbline.operators import evaluate as V
from plumbline.operators.split import assign_folds, train_test_split
from plumbline.session import PARALLEL, concurrently, stage

# Limits of a run, and the search ranges per model family.
TRIALS = 12
SEARCH = {
    "Random Forest": {"n_estimators": (80, 300), "max_depth": (3, 18), "min_leaf": (1, 8)},
    "Gradient Boosting": {"n_estimators": (60, 240), "learning_rate": (0.01, 0.3, "log"), "max_depth": (2, 8), "subsample": (0.6, 1.0, "linear")},
    "Logistic Regression": {"C": (1e-3, 20.0, "log")},
    "Linear Regression": {"alpha": (1e-3, 20.0, "log")},
}


@dataclass
class Trained:
    """One fitted model with everything measured about it; `error` and `problem` are set when any part of that failed."""

    name: str
    task: str
    seconds: float = 0.0
    model: PipelineModel | Model | None = None
    params: dict = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)
    fold_scores: list = field(default_factory=list)
    importance: dict = field(default_factory=dict)
    evaluation: dict = field(default_factory=dict)
    error: str | None = None
    problem: Exception | None = field(default=None, repr=False)

    def failed(self, problem: Exception) -> None:
        """Record the first failure."""
        if self.error is None:
            self.error, self.problem = _short(problem), problem


@dataclass
class TrainingRun:
    task: str
    target: str
    labels: list[str] | None
    preparation: Preparation
    prepare: PipelineModel
    models: list[Trained]
    test: DataFrame

    def best(self) -> Trained | None:
        key = "accuracy" if self.task == "classification" else "r2_score"
        done = [m for m in self.models if m.error is None]
        return max(done, key=lambda m: m.metrics.get(key) if m.metrics.get(key) is not None else -1e9, default=None)

    def whole(self) -> TrainingRun:
        """The run, if every model was fitted and measured on all folds; raises the first failure otherwise.

        For those who read results off the run: a model that failed has none, or only some.
        """
        for m in self.models:
            if m.error is not None:
                raise RuntimeError(f"{m.name}: {m.error}") from m.problem
        return self


def _ready(df: DataFrame, key: str, target: str, labels) -> DataFrame:
    return encode_label(df, target, labels).withColumn("row_key", quoted(key))


def _apply(prep: PipelineModel, df: DataFrame) -> DataFrame:
    return prep.transform(df).select("row_key", "features", "label")


ROWS_PER_TASK = 20_000
KEPT_FOLD_ROWS = 2_000_000


def _held(df: DataFrame) -> DataFrame:
    """Keep a prepared frame for the optimizer's many passes.

    Small frames are packed into few partitions, since every step of a fit is a job.
    """
    rows = df.count()
    return df.coalesce(max(1, rows // ROWS_PER_TASK)).persist(StorageLevel.MEMORY_AND_DISK)


def score_frame(model: Model, prepared: DataFrame, task: str) -> DataFrame:
    """`(row_key, y_true, y_pred[, scores])` with class positions as text."""
    out = model.transform(prepared)
    if task == "regression":
        return out.select("row_key", F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
    cast = lambda c: F.col(c).cast("int").cast("string")
    columns = ["row_key", cast("label").alias("y_true"), cast("prediction").alias("y_pred")]
    if "probability" in out.columns:
        columns.append(vector_to_array("probability").alias("scores"))
    return out.select(*columns)


def evaluate_model(scored: DataFrame, task: str, classes: int) -> dict:
    """Headline metrics of a scored frame as numbers (the tables are in `operators.evaluate`)."""
    if task == "regression":
        return V.regression_metrics(scored).first().asDict()
    metrics = V.classification_metrics(scored).first().asDict()
    metrics["roc_auc"] = None
    if "scores" in scored.columns:
        if classes == 2:
            one = scored.withColumn("score", F.col("scores")[1])
            metrics["roc_auc"] = V.roc_auc(one, "1").first()[0]
        else:
            metrics["roc_auc"] = V.roc_auc_multiclass(scored, [str(i) for i in range(classes)]).first()[0]
    return metrics


#: Classes up to which the whole confusion grid is kept with a model, the error of its stored ROC curve, and rows of its
#: residual sample.
GRID_CLASSES, ROC_ERROR, RESIDUAL_ROWS = 200, 1e-3, 2000


def evaluation_tables(scored: DataFrame, task: str, classes: int) -> dict:
    """What is kept of a model's test besides numbers, all of bounded size.

    Classification: the confusion grid by class position, the class report, and for two classes the thinned ROC curve of
    the second.  Regression: a sample of residuals by the hash of the row key.
    """
    if task == "regression":
        rows = V.residual_sample(scored, ["row_key"], RESIDUAL_ROWS).collect()
        return {"residual_sample": [tuple(float(x) for x in r) for r in rows]}
    out: dict = {}
    if classes <= GRID_CLASSES:
        cells = {(r["y_true"], r["y_pred"]): r["n"] for r in V.confusion_cells(scored).collect()}
        out["confusion_matrix"] = [[cells.get((str(i), str(j)), 0) for j in range(classes)] for i in range(classes)]
        names = ("label", "precision", "recall", "f1", "support")
        report = V.class_report(scored).select(*names).orderBy("label").collect()
        out["class_report"] = [(r["label"], *(float(r[c]) for c in names[1:4]), int(r["support"])) for r in report]
    if classes == 2 and "scores" in scored.columns:
        one = scored.withColumn("score", F.col("scores")[1])
        points = V.roc_points(one, "1", ROC_ERROR).orderBy(F.col("threshold").desc_nulls_first()).collect()
        out["roc"] = ([r["fpr"] for r in points], [r["tpr"] for r in points], [r["threshold"] for r in points])
    return out


@dataclass
class Folds:
    """Fold parts with their fitted preparation, shared by all models.

    Each fold's preparation is learned on its own training rows.  Prepared frames of small
    inputs stay in memory for the whole run; a large fold is held once, while all models or trials
    are fitted on it, so at most one is kept at a time.
    """

    parts: list[tuple[DataFrame, DataFrame, Shape, bool]]

    @classmethod
    def build(cls, df: DataFrame, key: str, target: str, task: str, labels, folds: int, features) -> Folds:
        placed = assign_folds(df, key, folds, target if task == "classification" else None)

        def part(f: int) -> tuple[DataFrame, DataFrame, Shape, bool]:
            train, test = placed.filter(F.col("fold") != f), placed.filter(F.col("fold") == f)
            prep = fit_preparation(train.drop("fold", "row_key", "label"), target, features)
            model = prep.model(train)
            ready, held_out = _apply(model, train), _apply(model, test)
            shape = shape_of(ready, len(prep.slots()), len(labels) if labels else 0)
            keep = shape.rows <= KEPT_FOLD_ROWS
            if keep:
                ready, held_out = _held(ready), _held(held_out)
            return ready, held_out, shape, keep

        return cls(concurrently(df.sparkSession, [partial(part, f) for f in range(folds)]))

    def score(self, f: int, fit: Fitter, task: str, params: dict) -> float | None:
        """Fit on the rows outside fold `f`, and measure on the fold."""
        train, test, shape, _ = self.parts[f]
        scored = score_frame(fit(train, shape, **params), test, task).withColumn("fold", F.lit(f))
        row = V.fold_scores(scored, task).first()
        return row["score"] if row else None

    def scores(self, work: Sequence[tuple[Fitter, dict]], task: str, parallel: int, also: Sequence = ()) -> tuple[list[list[tuple]], list[tuple]]:
        """(score, error) on each fold, a list for each (fit, params), and the results of the tasks of `also`, which run beside the small folds.

        A large fold is held once for all fits.
        """
        spark = self.parts[0][0].sparkSession
        out: list[list[tuple]] = [[(None, None)] * len(self.parts) for _ in work]
        large = [f for f, part in enumerate(self.parts) if not part[3]]
        others: list[tuple] = []
        for batch in [[f for f in range(len(self.parts)) if f not in large], *[[f] for f in large]]:
            held = [frame for f in batch if f in large for frame in self.parts[f][:2]]
            for frame in held:
                frame.persist(StorageLevel.MEMORY_AND_DISK)
            try:
                spots = [(i, f) for i in range(len(work)) for f in batch]
                done = concurrently(spark, [*also, *[partial(_outcome, partial(self.score, f, work[i][0], task, work[i][1])) for i, f in spots]], parallel)
            finally:
                for frame in held:
                    frame.unpersist()
            others, also = others + done[: len(also)], ()
            for (i, f), outcome in zip(spots, done[len(done) - len(spots) :]):
                out[i][f] = outcome
        return out, others

    def release(self) -> None:
        for train, test, _, kept in self.parts:
            if kept:
                train.unpersist()
                test.unpersist()


def draw(space: dict, rng: np.random.Generator) -> dict:
    """One random point of a search space."""
    out = {}
    for name, span in space.items():
        low, high, *kind = span
        if not kind:
            out[name] = int(rng.integers(low, high + 1))
        elif kind[0] == "log":
            out[name] = float(np.exp(rng.uniform(np.log(low), np.log(high))))
        else:
            out[name] = float(rng.uniform(low, high))
    return out


def search(folds: Folds, fit: Fitter, task: str, space: dict, trials: int = TRIALS, budget: float | None = None, seed: int = 42, parallel: int = PARALLEL) -> dict:
    """Seeded random search; each trial is one cross-validation.

    With a `budget` in seconds the clock is read between trials, and `n_trials` tells how many there were; without one
    the same seed gives the same search on any machine.
    """
    rng, begun = np.random.default_rng(seed), time.monotonic()
    history = []
    drawn = [draw(space, rng) for _ in range(trials)]
    together = 1 if budget is not None else trials  # the clock is read between trials
    for start in range(0, trials, together):
        block = drawn[start : start + together]
        done, _ = folds.scores([(fit, params) for params in block], task, parallel)
        for params, outcomes in zip(block, done):
            scores = [s for s in _all_or_raise(outcomes) if s is not None]
            history.append((float(np.mean(scores)) if scores else -1e9, params))
        if budget is not None and time.monotonic() - begun >= budget:
            break
    value, params = max(history, key=lambda h: h[0])
    return {"best_value": value, "best_params": params, "n_trials": len(history)}


def _outcome(task: Callable[[], object]) -> tuple[object, Exception | None]:
    """(result, error): for what is recorded by model, so that whoever reads the result has to look at the error."""
    try:
        return task(), None
    except Exception as problem:
        return None, problem


def _all_or_raise(done: list[tuple]) -> list:
    for _, problem in done:
        if problem is not None:
            raise problem
    return [value for value, _ in done]


def _short(problem: Exception) -> str:
    return str(problem).split("\n")[0][:500]


def train_models(
    df: DataFrame,
    target: str,
    key: str,
    task: str | None = None,
    models: Sequence[str] | None = None,
    features: Sequence[str] | None = None,
    test_size: float = 0.2,
    folds: int = 5,
    params: dict[str, dict] | None = None,
    tune: bool = False,
    trials: int = TRIALS,
    budget: float | None = None,
    parallel: int = PARALLEL,
) -> TrainingRun:
    """Split, prepare, then fit and measure each model; a failing model is recorded and the run goes on (`whole()` raises it).

    `key` is a unique row key, not a feature.  Cross-validation covers all rows, with the
    preparation refitted on each training part; `folds=0` skips it.  Up to `parallel` fits, folds or trials run at the
    same time, with the results that they have one after the other.
    """
    if target not in df.columns:
        raise ValueError(f"target column '{target}' is missing")
    df = normalised(df).filter(quoted(target).isNotNull())
    # the task is read off the raw target, before any encoding
    task = task if task in ("classification", "regression") else detect_task(df, target, "training").first()["task_type"]
    catalog = fitters(task)
    names = list(models) if models else ["Logistic Regression" if task == "classification" else "Linear Regression", "Random Forest"]
    unknown = [m for m in names if m not in catalog]
    if unknown:
        raise ValueError(f"models not available for {task}: {', '.join(unknown)}")
    labels = label_levels(df, target) if task == "classification" else None
    usable = features or [c for c in [*numeric_columns(df), *columns_of(df, "categorical", "boolean")] if c not in (target, key)]
    # dozens of passes follow: they read a kept copy, not the query behind `df`
    base = stage(_ready(df.select(*map(quoted, dict.fromkeys([key, *usable, target]))), key, target, labels), "training")
    stratum = target if labels and len(labels) < 20 else None
    parts = train_test_split(base, key, stratum, test_size)
    train, test = parts.filter(~F.col("is_test")), parts.filter(F.col("is_test"))
    prep = fit_preparation(train.drop("is_test", "row_key", "label"), target, usable)
    prepare = prep.model(train)
    fitted, held = _held(_apply(prepare, train)), _held(_apply(prepare, test))
    shape = shape_of(fitted, len(prep.slots()), len(labels) if labels else 0)
    splits = Folds.build(base, key, target, task, labels, folds, usable) if folds else None
    def fitted_model(result: Trained) -> None:
        started = time.monotonic()
        result.model = catalog[result.name](fitted, shape, **result.params)
        result.seconds = time.monotonic() - started
        scored = score_frame(result.model, held, task).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            result.metrics = evaluate_model(scored, task, shape.classes)
            result.evaluation = evaluation_tables(scored, task, shape.classes)
        finally:
            scored.unpersist()
        result.importance = feature_importance(result.model, prep.slots())

    done = [Trained(name, task, params=dict((params or {}).get(name, {}))) for name in names]
    ready: list[Trained] = []
    for result in done:
        try:
            if tune and result.name in SEARCH and splits:
                found = search(splits, catalog[result.name], task, SEARCH[result.name], trials, budget, parallel=parallel)
                result.params = {**result.params, **found["best_params"]}
        except Exception as problem:
            result.failed(problem)
            continue
        ready.append(result)
    fitting = [partial(_outcome, partial(fitted_model, result)) for result in ready]
    if splits:
        crossed, fits = splits.scores([(catalog[result.name], result.params) for result in ready], task, parallel, fitting)
    else:
        crossed, fits = [[] for _ in ready], concurrently(base.sparkSession, fitting, parallel)
    for result, fit, outcomes in zip(ready, fits, crossed):
        for work, (value, problem) in enumerate([fit, *outcomes]):
            if problem is not None:  # one model must not end the run
                result.failed(problem)
            elif work:
                result.fold_scores.append(value)
    if splits:
        splits.release()
    base.unpersist()
    fitted.unpersist()
    return TrainingRun(task, target, labels, prep, prepare, done, held)


def as_models_table(run: TrainingRun, df: DataFrame, job_id: str) -> DataFrame:
    """The run's successful models as catalog rows."""
    rows = []
    for i, m in enumerate(run.models):
        if m.error is not None:
            continue
        clean = {k: float(v) for k, v in m.metrics.items() if v is not None}
        flat = {k: clean.get(k) for k in ("accuracy", "f1_score", "roc_auc", "rmse", "mae", "r2_score")}
        rows.append((i, job_id, m.name, run.task, m.seconds, False, *flat.values(), clean, [s for s in m.fold_scores if s is not None], m.importance))
    schema = (
        "model_id long, job_id string, model_name string, task_type string, training_time double, is_deployed boolean, accuracy double, f1_score double, "
        "roc_auc double, rmse double, mae double, r2_score double, metrics map<string,double>, cv_scores array<double>, feature_importance map<string,double>"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def evaluations_table(run: TrainingRun, df: DataFrame, job_id: str) -> DataFrame:
    """What was kept of each successful model's test, numbered like `as_models_table`; the charts of `leaderboard` read it."""
    rows = []
    for i, m in enumerate(run.models):
        if m.error is None:
            e = m.evaluation
            rows.append((i, job_id, m.name, run.labels, e.get("confusion_matrix"), e.get("class_report"), e.get("roc"), e.get("residual_sample")))
    schema = (
        "model_id long, job_id string, model_name string, labels array<string>, confusion_matrix array<array<bigint>>, "
        "class_report array<struct<label:string,precision:double,recall:double,f1:double,support:bigint>>, "
        "roc struct<fpr:array<double>,tpr:array<double>,thresholds:array<double>>, residual_sample array<struct<actual:double,predicted:double,residual:double>>"
    )
    return df.sparkSession.createDataFrame(rows, schema)
