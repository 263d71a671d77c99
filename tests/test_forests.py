import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from plumbline.ml import forests, votes
from plumbline.ml.estimators import Shape, decision_tree, random_forest
from plumbline.ml.forests import TreeVotes, grown
from plumbline.session import scratch_path


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 9, 3000), rng.integers(0, 4, 3000), rng.integers(0, 2, 3000)]).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] == 2)) * 1.0 + ((x[:, 2] == 1) & (rng.random(3000) < 0.4))
    rows = [(i, [float(v) for v in a], float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_key long, f array<double>, label double")
    return df.select("row_key", array_to_vector("f").alias("features"), "label").cache()


def predicted(model, df):
    return [r["prediction"] for r in model.transform(df).orderBy("row_key").collect()]


@pytest.mark.parametrize("classes,kind", [(3, DecisionTreeClassifier), (0, DecisionTreeRegressor)])
def test_tree_is_sparks_tree(frame, classes, kind):
    ours, theirs = decision_tree(frame, Shape(3000, 3, classes), 5), kind(maxDepth=5, seed=42).fit(frame)
    assert predicted(ours, frame) == pytest.approx(predicted(theirs, frame))
    share = ours.slot_weights / ours.slot_weights.sum()
    assert share == pytest.approx(theirs.featureImportances.toArray(), abs=1e-6)


def test_forest_of_copies_looks_at_no_more_profiles(spark, frame, monkeypatch):
    """Work follows the profiles, not the rows: ten copies of each row are the same blocks with larger counts."""
    seen = []
    packed = forests.packed
    monkeypatch.setattr(forests, "packed", lambda table, rows: (seen.append(table.count()), packed(table, rows))[1])
    copies = frame.crossJoin(spark.range(10)).drop("id")
    for df in (frame, copies):
        random_forest(df, Shape(df.count(), 3, 3), 5, 4)
    assert seen[0] == seen[1] <= 9 * 4 * 2 * 3


def test_forest_depends_on_no_partitioning(frame):
    one, other = (grown(df, 3, 3, 12, 6, bootstrap=True) for df in (frame, frame.repartition(7, "row_key")))
    for name in ("features", "thresholds", "lefts", "values", "sizes"):
        assert one.stages[0].getOrDefault(name) == other.stages[0].getOrDefault(name)
    right = one.transform(frame).filter(F.col("prediction") == F.col("label")).count()
    assert right > 0.78 * 3000  # noise leaves the best rule 0.8


def test_scores_are_the_same_with_and_without_a_grid(spark, frame, monkeypatch):
    model = grown(frame, 3, 3, 8, 6, bootstrap=True)
    path = scratch_path(spark, "votes")
    model.stages[0].write().save(path)
    model.stages[0] = TreeVotes.load(path)
    out = lambda: [(r["prediction"], *r["probability"].toArray()) for r in model.transform(frame).orderBy("row_key").collect()]
    grid = out()
    monkeypatch.setattr(votes, "GRID_CELLS", 0)
    assert out() == grid
    assert all(abs(sum(r[1:]) - 1) < 1e-9 for r in grid)


def test_draws_are_poisson():
    n = np.repeat([1, 7, 400, 600], 3000)
    key = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, len(n))
    _, _, counts = forests.drawn(20, 42, (None, None, n, key))
    for size in (1, 7, 400, 600):
        got = counts[:, n == size]
        assert got.mean() == pytest.approx(size, rel=0.02)
        assert got.var() == pytest.approx(size, rel=0.05)
    assert abs(np.corrcoef(counts[:, n == 400])[0, 1:]).max() < 0.08
