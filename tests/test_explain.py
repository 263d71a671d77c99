import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.ml import explain as X
from plumbline.ml.train import train_models
from plumbline.sources.bundles import ModelBundle
from plumbline.sources.synthetic import classification_frame


@pytest.fixture(scope="module")
def classes(spark):
    return classification_frame(spark, 120).cache()


@pytest.fixture(scope="module")
def bundle(classes):
    run = train_models(classes, "target", "row_id", models=("Random Forest",), folds=0, params={"Random Forest": {"n_estimators": 5}})
    return ModelBundle.of(run, run.models[0], classes)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shapley_sorts_no_walks(classes, bundle):
    """Walks are summed in the task that made them; no window orders their rows."""
    got = X.sampled_shapley(classes, classes, bundle, "row_id", "row_id", permutations=3)
    assert "Window [lag" not in plan(got) and "SortMergeJoin" not in plan(got)
    assert got.columns == ["row_id", "feature", "contribution", "base_value"]
    assert got.count() == 120 * len(bundle.features)


def test_shapley_of_one_walk_is_its_steps(classes, bundle):
    got = X.sampled_shapley(classes, classes, bundle, "row_id", "row_id", permutations=1, seed=3)
    order = np.random.default_rng(3).permutation(len(bundle.features))
    names = [n for n, _ in bundle.features]
    ground = X.sample_rows(classes, "row_id", 1).first()
    for row in classes.filter("row_id < 4").collect():
        have = {r["feature"]: r["contribution"] for r in got.filter(F.col("row_id") == row["row_id"]).collect()}
        steps = [[row[n] if order[i] < k else ground[n] for i, n in enumerate(names)] for k in range(len(names) + 1)]
        schema = ", ".join(f"{n} {t}" for n, t in bundle.features)
        frame = classes.sparkSession.createDataFrame([tuple(s) for s in steps], schema).coalesce(1)
        scored = bundle.pipeline.transform(frame)
        out = [r[0] for r in scored.select(X.model_output(scored, bundle)).collect()]
        want = {n: out[order[i] + 1] - out[order[i]] for i, n in enumerate(names)}
        assert have == pytest.approx(want, abs=1e-12)


def test_surrogate_shuffles_no_drawn_rows(spark, classes, bundle):
    """Levels travel to the draws; the optimizer's own threshold does not decide it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = X.local_surrogate(classes, classes, bundle, "row_id", samples=20)
        assert "SortMergeJoin" not in plan(got)
        assert got.select("row_id").distinct().count() == 120
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
