from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from plumbline.ml import explain as X
from plumbline.ml import prepare as P
from plumbline.ml import score as SC
from plumbline.ml import train as T
from plumbline.ml.estimators import Shape, adaboost, fitters, ridge, shape_of
from plumbline.ml.train import as_models_table, draw, train_models
from plumbline.operators import neighbors as N
from plumbline.operators.neighbors import knn_approximate, knn_join
from plumbline.plans.report import analytics_report, exploration_report
from plumbline.queries import modelling as Q
from plumbline.session import concurrently, scratch_path
from plumbline.sources.bundles import ModelBundle
from plumbline.sources.synthetic import classification_frame, passengers, regression_frame
from plumbline.streaming.serving import score_stream, watch_drift


@pytest.fixture(scope="module")
def classes(spark):
    return classification_frame(spark, 240).cache()


@pytest.fixture(scope="module")
def run(classes):
    return train_models(classes, "target", "row_id", models=("Logistic Regression", "Decision Tree"), folds=2)


@pytest.fixture(scope="module")
def bundle(run, classes):
    return ModelBundle.of(run, run.models[0], classes)


@pytest.mark.parametrize("block_rows", [40, 4096])
def test_neighbors_match_brute_force(spark, block_rows):
    rng = np.random.default_rng(0)
    # most points in one tight cluster, some copies
    v = np.concatenate([rng.normal(0, 0.01, (150, 4)), rng.normal(5, 2, (60, 4)), np.tile(rng.normal(0, 1, (1, 4)), (12, 1))])
    df = spark.createDataFrame([(int(i), [float(a) for a in x]) for i, x in enumerate(v)], "id long, v array<double>")
    got = knn_join(df, df, 5, exclude_self=True, block_rows=block_rows).toPandas()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert len(got) == len(v) * 5
    for i, part in got.groupby("query_id"):
        order = np.lexsort((np.arange(len(v)), d[i]))[:5]
        assert part.sort_values("rank").neighbor_id.tolist() == order.tolist()


@pytest.mark.parametrize("numbers", [200, 8_000_000])
def test_small_blocks_send_no_more_rows(spark, numbers, monkeypatch):
    """Rows travel once to a strip, not to a block; a strip that would be too large becomes several, with the same result."""
    monkeypatch.setattr(N, "STRIP_NUMBERS", numbers)
    v = np.random.default_rng(3).normal(0, 1, (400, 4)).round(1)  # with ties
    df = spark.createDataFrame([(int(i), [float(a) for a in x]) for i, x in enumerate(v)], "id long, v array<double>")
    cells = N._assign(df, v[:3])
    strips = sum(r["parts"] for r in N._strips(cells, v[:3], 5).collect())
    assert strips <= 2 * N.STRIPS if numbers > 200 else strips >= 400 * 4 // 200
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for join in (lambda: knn_join(df, df, 5, exclude_self=True, block_rows=5), lambda: knn_approximate(df, df, 5, exclude_self=True, pivots=3, probes=3, block_rows=5)):
        got = {(r["query_id"], r["rank"]): r["neighbor_id"] for r in join().collect()}
        assert got == {(i, j + 1): int(b) for i in range(400) for j, b in enumerate(np.lexsort((np.arange(400), d[i]))[:5])}


@pytest.mark.parametrize("block_rows", [4096, 40])
def test_approximate_neighbours_of_clustered_vectors(spark, block_rows):
    rng = np.random.default_rng(8)
    v = rng.normal(0, 10, (20, 6))[rng.integers(0, 20, 600)] + rng.normal(0, 1, (600, 6))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")
    exact = {(r["query_id"], r["neighbor_id"]): r["distance"] for r in knn_join(df, df, 5, exclude_self=True).collect()}
    few = knn_approximate(df, df, 5, exclude_self=True, pivots=20, probes=3, block_rows=block_rows).collect()
    met = [(r["query_id"], r["neighbor_id"]) for r in few]
    assert len(set(met) & set(exact)) >= 0.95 * len(exact) and len(set(met)) == len(met) == 3000
    assert all(abs(r["distance"] - exact[k]) < 1e-9 for r, k in zip(few, met) if k in exact)
    every = knn_approximate(df, df, 5, exclude_self=True, pivots=20, probes=20, block_rows=block_rows).collect()
    assert {(r["query_id"], r["neighbor_id"]) for r in every} == set(exact)
    assert knn_approximate(df, df.limit(0)).count() == 0


def _strip(v, seed=0):
    """A strip of vectors around three of them, in no order, with ids that are not in their order either."""
    pivots, ids = v[:3].astype(float), np.random.default_rng(seed).permutation(len(v))
    reach = np.sqrt(((v[:, None].astype(float) - pivots) ** 2).sum(axis=2))
    return pivots, pd.DataFrame({"id": ids, "v": list(v), "cell": reach.argmin(axis=1).astype("int32"), "reach": reach.min(axis=1), "theta": 1e300})


def test_a_loose_bound_measures_few_pairs(monkeypatch):
    """A bound that all rows meet had every pair of the first blocks measured and sorted."""
    pivots, strip = _strip(np.random.default_rng(1).normal(size=(3000, 16)))
    sorted_rows, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sorted_rows.append(len(keys[0])) or lexsort(keys))
    assert len(N._strip_best(8, pivots, 4096)(strip.assign(theta=100.0), strip)) == 8 * 3000
    assert sum(sorted_rows) < 3000 * 3000 / 20


@pytest.mark.parametrize("kind", ["even", "far off", "close together", "ties", "large", "small", "one outlier", "one row", "a line", "single"])
def test_strips_match_brute_force(kind):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(900, 8))
    v = {
        "far off": v + 1e6, "close together": 1 + 1e-6 * v, "ties": v.round(0), "large": v * 1e20, "small": v * 1e-15,
        "one outlier": np.concatenate([v, np.full((1, 8), 1e9)]), "one row": v[:1], "a line": v[:, :1], "single": v.astype("f4"),
    }.get(kind, v)
    pivots, strip = _strip(np.resize(v, (3, v.shape[1])) if kind == "one row" else v)
    strip = strip.iloc[: len(v)]
    x, ids = np.array(strip["v"].tolist(), dtype=float), strip["id"].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    want = {(ids[i], ids[j]): d[i, j] for i in range(len(x)) for j in np.lexsort((ids, d[i]))[:6]}
    for block_rows in (4096, 50):
        got = N._strip_best(6, pivots, block_rows)(strip, strip)
        assert {(q, n): x for q, n, x in got.itertuples(index=False)} == want


def test_a_product_serves_both_rows(monkeypatch):
    """Rows that look for each other were multiplied once for either."""
    v = np.random.default_rng(4).normal(size=(2000, 16))
    pivots, strip = _strip(v)
    products, matmul = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, **out: products.append(len(a) * b.shape[1]) or matmul(a, b, **out))
    half = strip["id"].to_numpy() % 2
    own = N._own_best(8, pivots, 64)
    met = [own(strip[half == i].assign(own=i, low=i, high=i, task=0)) for i in (0, 1)]
    pairs = N._mutual_best(8, pivots, 64)(pd.concat([m.assign(other=1 - i) for i, m in enumerate(met)]))
    assert sum(products) < 2000 * 2000 * 0.7
    found = {i: list(zip(d, ids)) for m in met for i, ids, d in zip(m["id"], m["met_id"], m["met_distance"])}
    for q, n, d in pairs.itertuples(index=False):
        found[q].append((d, n))
    x = v[np.argsort(strip["id"].to_numpy())]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert all([n for _, n in sorted(found[i])[:8]] == np.lexsort((np.arange(2000), d[i]))[:8].tolist() for i in range(2000))


@pytest.mark.parametrize("numbers", [300, 8_000_000])
def test_a_join_with_itself_equals_that_of_two_tables(spark, numbers, monkeypatch):
    """Few probes, several strips, cells of several strips; queries with fewer neighbours than asked for."""
    monkeypatch.setattr(N, "STRIP_NUMBERS", numbers)
    v = np.concatenate([np.random.default_rng(6).normal(0, 1, (300, 3)).round(1), np.full((4, 3), 50.0)])
    df = spark.createDataFrame([(f"k{i}", [float(a) for a in x]) for i, x in enumerate(v)], "id string, v array<float>")
    copy = df.select("*")
    for join in (knn_join, partial(knn_approximate, pivots=9, probes=2)):
        one, two = (sorted(join(df, base, 6, exclude_self=True, block_rows=40).collect()) for base in (df, copy))
        assert one == two and len(one) >= 300 * 6


def test_preparation_matches_numpy(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, None, 4.0, 10.0], "c": ["a", "b", None, "b", "a"], "y": [1.0, 2, 3, 4, 5]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "x double, c string, y double")
    prep = P.fit_preparation(df, "y")
    filled = pdf.x.fillna(pdf.x.median())
    got = [r[0] for r in prep.filled_and_scaled(df).select("x_scaled").collect()]
    np.testing.assert_allclose(got, (filled - filled.mean()) / filled.std(ddof=0))
    # ties in the mode go to the lowest text; an unseen level encodes as zeros
    assert prep.texts["c"] == ("a", ["a", "b"])
    new = spark.createDataFrame([(None, "zzz", 1.0), (2.0, "b", 1.0)], "x double, c string, y double")
    vectors = [r["features"].toArray().tolist() for r in prep.model(df).transform(new).collect()]
    assert vectors[0][1:] == [0.0, 0.0] and vectors[1][1:] == [0.0, 1.0]


def test_crowded_texts_are_dropped(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("name"), (F.col("id") % 5).cast("string").alias("five"), (F.col("id") % 51).cast("string").alias("many"))
    assert P.low_cardinality(df, ("name", "five", "many")) == ["five"]


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 80)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    ready = P.encode_label(P.fit_preparation(df, "y").model(df).transform(df), "y", None)
    model = ridge(ready, shape_of(ready, 3, 0), alpha=5.0).stages[-1]
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 5 * np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose(model.coefficients.toArray(), want, rtol=1e-4)


def test_training_run(run, spark, classes):
    assert [m.error for m in run.models] == [None, None] and run.task == "classification" and run.labels == ["no", "yes"]
    lr = run.models[0]
    assert lr.metrics["accuracy"] > 0.9 and lr.metrics["roc_auc"] > 0.95 and len(lr.fold_scores) == 2
    assert sum(lr.importance.values()) == pytest.approx(1.0) and set(lr.importance) == {"x1", "x2", "cat"}
    assert run.best() is lr
    table = as_models_table(run, classes, "job").collect()
    assert [r["model_name"] for r in table] == ["Logistic Regression", "Decision Tree"]


def test_a_failing_model_does_not_end_the_run(classes):
    got = train_models(classes, "target", "row_id", models=("Decision Tree", "Random Forest"), folds=0, params={"Random Forest": {"max_depth": -3}})
    assert got.models[0].error is None and got.models[1].error


@pytest.mark.parametrize("failing", ["the first fit", "a fold's fit"])
def test_a_failed_forest_is_no_importance(spark, failing, monkeypatch):
    """feature_importance had no rows, or those of a forest whose cross-validation had failed."""
    calls = []

    def forest(train, shape, **params):
        calls.append(1)
        if (len(calls) == 1) == (failing == "the first fit"):
            raise MemoryError("no room")
        tree = fitters("classification")["Decision Tree"]
        return tree(train, shape)

    monkeypatch.setattr(T, "fitters", lambda task: {"Random Forest": forest})
    monkeypatch.setattr(Q, "train_models", partial(train_models, folds=2, parallel=1))
    with pytest.raises(RuntimeError, match="Random Forest: no room") as raised:
        Q.feature_importance(spark, "/root/testdata/sf0.001").collect()
    assert isinstance(raised.value.__cause__, MemoryError)


@pytest.mark.parametrize("parallel", [1, 2])
def test_a_failure_of_tasks_together_is_raised(spark, parallel):
    begun = []

    def task(i):
        begun.append(i)
        if i == 1:
            raise ValueError("second")
        return spark.range(i).count()

    assert concurrently(spark, [partial(task, i) for i in (0, 2, 3)], parallel) == [0, 2, 3]
    with pytest.raises(ValueError, match="second"):
        concurrently(spark, [partial(task, i) for i in range(3)], parallel)


def test_bad_requests(classes):
    with pytest.raises(ValueError, match="missing"):
        train_models(classes, "absent", "row_id")
    with pytest.raises(ValueError, match="not available"):
        train_models(classes, "target", "row_id", models=("Linear Regression",))


def test_regression_run(spark):
    got = train_models(regression_frame(spark, 260), "target", "row_id", models=("Linear Regression",), folds=0, tune=False)
    assert got.task == "regression" and got.models[0].metrics["r2_score"] > 0.9


def test_boosting_beats_a_stump(spark, classes):
    labels = P.label_levels(classes, "target")
    df = P.encode_label(classes, "target", labels)
    ready = P.fit_preparation(classes.drop("row_id"), "target").model(classes).transform(df).select("features", "label").cache()
    hits = lambda k: adaboost(ready, Shape(240, 4, 2), n_estimators=k, checkpoint_every=3).transform(ready).filter("prediction = label").count()
    assert hits(8) > hits(1)


def test_boosting_equals_boosting_on_rows(spark):
    """Histogram rounds against the same rounds on all rows in NumPy; the model survives saving."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 12, 300), rng.integers(0, 2, 300), rng.integers(0, 5, 300)]).astype(float)
    y = (x[:, 0] > 5).astype(int) + ((x[:, 2] > 2) & (rng.random(300) < 0.8))
    df = spark.createDataFrame([(Vectors.dense(r), float(c)) for r, c in zip(x, y)], ["features", "label"])
    model = adaboost(df, Shape(300, 3, 3), n_estimators=12, checkpoint_every=5)

    w, votes, chosen = np.ones(300), np.zeros((300, 3)), np.zeros(3)
    for _ in range(12):
        best = None
        for f in range(3):
            for t in sorted(set(x[:, f]))[:-1]:
                sides = [np.bincount(y[m], w[m], minlength=3) for m in (x[:, f] <= t, x[:, f] > t)]
                purity = round(sum((s**2).sum() / s.sum() for s in sides) / w.sum(), 12)
                if best is None or purity > best[0]:
                    best = (purity, f, t, sides)
        _, f, t, sides = best
        said = np.where(x[:, f] <= t, sides[0].argmax(), sides[1].argmax())
        error = w[said != y].sum() / w.sum()
        if error >= 2 / 3:
            break
        alpha = np.log((1 - error) / error) + np.log(2)
        votes[np.arange(300), said] += alpha
        chosen[f] += 1
        w = w * np.where(said != y, np.exp(alpha), 1.0)
        w *= 300 / w.sum()
    assert model.slot_weights.tolist() == chosen.tolist()
    path = scratch_path(spark, "stumps")
    model.save(path)
    for m in (model, PipelineModel.load(path)):
        rows = m.transform(df).select("prediction", "probability").collect()
        assert np.allclose([r["probability"].toArray() for r in rows], votes / votes.sum(axis=1, keepdims=True))
        assert [r["prediction"] for r in rows] == votes.argmax(axis=1).tolist()


def test_fits_at_the_same_time_equal_those_in_sequence(classes):
    runs = [train_models(classes, "target", "row_id", models=("Logistic Regression", "AdaBoost"), folds=3, params={"AdaBoost": {"n_estimators": 6}}, parallel=p) for p in (1, 4)]
    one, four = [[(m.name, m.error, m.metrics, m.fold_scores, m.importance) for m in run.models] for run in runs]
    assert one == four and all(len(m[3]) == 3 for m in one)


def test_search_at_the_same_time_equals_the_sequence(classes):
    runs = [train_models(classes, "target", "row_id", models=("Logistic Regression",), folds=2, tune=True, trials=3, parallel=p) for p in (1, 4)]
    assert runs[0].models[0].params == runs[1].models[0].params and runs[0].models[0].fold_scores == runs[1].models[0].fold_scores


def test_large_folds_are_held_once(spark, monkeypatch):
    """All models and trials are fitted on a large fold while it is held, with the results of small folds."""
    frame = regression_frame(spark, 200).cache()
    names = dict(zip(("key", "target"), (frame.columns[0], "target")))
    runs, held = [], []
    for most in (T.KEPT_FOLD_ROWS, 0):
        monkeypatch.setattr(T, "KEPT_FOLD_ROWS", most)
        kept = type(frame).persist
        with monkeypatch.context() as m:
            m.setattr(type(frame), "persist", lambda self, *a: held.append((most, self.columns)) or kept(self, *a))
            run = train_models(frame, names["target"], names["key"], "regression", ("Linear Regression",), folds=2, tune=True, trials=6)
        runs.append([(r.name, r.error, r.params, r.fold_scores) for r in run.models])
    assert [r[:3] for r in runs[0]] == [r[:3] for r in runs[1]] and [r[3] for r in runs[0]] == [pytest.approx(r[3]) for r in runs[1]]
    prepared = [c for most, c in held if most == 0 and c == ["row_key", "features", "label"]]
    assert len(prepared) <= 2 + 2 * 2 * 2  # the run's own parts, then both parts of each fold for the six trials and for the model


def test_search_draws_are_seeded():
    space = {"a": (1, 9), "b": (0.01, 1.0, "log"), "c": (0.5, 1.0, "linear")}
    one, two = draw(space, np.random.default_rng(3)), draw(space, np.random.default_rng(3))
    assert one == two and 1 <= one["a"] <= 9 and 0.01 <= one["b"] <= 1.0


def test_bundle_round_trip_and_missing_features(spark, classes, bundle):
    path = scratch_path(spark, "bundle")
    bundle.save(spark, path)
    loaded = ModelBundle.load(spark, path)
    a = SC.score(classes, bundle, ["row_id"]).orderBy("row_id").toPandas()
    b = SC.score(classes, loaded, ["row_id"]).orderBy("row_id").toPandas()
    assert (a.prediction == b.prediction).all()
    sparse = SC.score(classes.select("row_id", "x1", F.lit("unseen").alias("cat")), loaded, ["row_id"]).first()
    assert sparse["prediction"] in ("yes", "no") and sum(sparse["probability"].values()) == pytest.approx(1.0)
    with pytest.raises(ValueError):
        SC.truth_and_prediction(classes.drop("target"), bundle, "row_id")
    assert SC.truth_and_prediction(classes, bundle, "row_id").filter("y_true = y_pred").count() > 200


def test_shapley_adds_up(classes, bundle):
    got = X.sampled_shapley(classes, classes, bundle, "row_id", "row_id", permutations=4, max_instances=5)
    out = SC.score(classes, bundle, ["row_id"]).select("row_id", F.col("probability")["yes"].alias("p"))
    sums = got.groupBy("row_id").agg(F.sum("contribution").alias("s"), F.first("base_value").alias("b")).join(out, "row_id").collect()
    assert len(sums) == 5
    for r in sums:
        assert r["s"] + r["b"] == pytest.approx(r["p"], abs=1e-9)


def test_surrogate_finds_the_direction(classes, bundle):
    got = X.local_surrogate(classes, classes, bundle, "row_id", samples=150, max_instances=4, override={"x1": 0.0, "x2": 0.0})
    weights = {(r["row_id"], r["feature"]): r["weight"] for r in got.collect()}
    assert len(weights) == 12 and all(w > 0 for (_, f), w in weights.items() if f in ("x1", "x2"))


def test_linear_contributions_sum_to_the_difference(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 6.0)], "k int, a double, b double")
    got = {(r["k"], r["feature"]): r["contribution"] for r in X.linear_contributions(df, "k", {"a": 2.0, "b": -1.0}).collect()}
    assert got == {(1, "a"): -2.0, (1, "b"): 2.0, (2, "a"): 2.0, (2, "b"): -2.0}


def test_template(classes):
    got = {r["feature"]: r for r in SC.inference_template(classes, ["x1", "cat", "none"]).collect()}
    assert got["x1"]["input_kind"] == "number" and set(got["cat"]["options"]) == {"A", "B"} and got["none"]["default_value"] == ""


def test_passengers_have_their_gaps(spark):
    df = passengers(spark)
    row = df.agg(F.count("*"), F.count_if(F.col("age").isNull()), F.count_if(F.col("embarked").isNull()), F.avg("survived")).first()
    assert row[:3] == (891, 177, 2) and 0.1 < row[3] < 0.5


def test_reports_hold_their_tables(spark, classes):
    scored = classes.select("row_id", F.col("target").alias("y_true"), F.col("target").alias("y_pred"))
    got = analytics_report(classes, "target", ["row_id"], scored=scored).select("chart_id", "section").distinct().collect()
    names = {r["chart_id"] for r in got}
    assert len(names) >= 10 and {"confusion_matrix", "class_report", "class_distribution", "feature_ranking"} <= names
    numbers = regression_frame(spark, 260)
    with_eval = numbers.select("row_id", F.col("target").alias("y_true"), (F.col("target") + 0.25).alias("y_pred"))
    names = {r["chart_id"] for r in analytics_report(numbers, "target", ["row_id"], scored=with_eval).select("chart_id").distinct().collect()}
    assert {"residual_histogram", "residuals_vs_predicted", "actual_vs_predicted", "mean_target"} <= names and len(names) >= 14
    sections = {r["chart_id"] for r in exploration_report(classes.drop("row_id"), "target").select("chart_id").distinct().collect()}
    # this frame has no related pairs and no leaking feature, so those two tables are empty
    assert sections == {"overview", "numeric_summary", "histograms", "top_values", "semantic_types", "drift_baseline_numeric", "drift_baseline_categorical"}


def test_streams(spark, classes, bundle, tmp_path):
    classes.drop("target").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(classes.drop("target").schema).parquet(str(tmp_path / "in"))
    q = score_stream(stream, bundle, ["row_id"]).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("scored").count() == 240
    seen = []
    watch_drift(stream, classes, lambda t, n: seen.append({r["feature"] for r in t.collect()}), str(tmp_path / "chk"), target="target").awaitTermination(120)
    assert seen and seen[0] == {"row_id", "x1", "x2"}


def test_training_queries_run_the_defaults(spark, monkeypatch):
    from plumbline.queries import modelling as Q

    given = []
    monkeypatch.setattr(Q, "train_models", lambda *a, **settings: given.append((len(a), settings)))
    monkeypatch.setattr(Q, "_board", lambda *a: None)
    monkeypatch.setattr(Q, "training_documents", lambda *a: None)
    monkeypatch.setattr(Q, "pricing", lambda *a: None)
    for query in (Q.train_classifiers, Q.train_margin_and_boosted_classifiers, Q.train_multiclass, Q.train_regressors):
        query(spark, "")
    assert given == [(5, {})] * 4


def test_a_round_of_boosting_is_one_job(spark):
    """Twelve more rounds are twelve more jobs, besides the two that keep the weights."""
    df = spark.createDataFrame([(Vectors.dense([float(i % 7), float(i % 5)]), float((i % 7 > 3) != (i % 35 == 0))) for i in range(300)], ["features", "label"]).cache()
    track, jobs = spark.sparkContext.statusTracker(), []
    for k in (4, 16):
        spark.sparkContext.setJobGroup(f"rounds-{k}", "")
        adaboost(df, Shape(300, 2, 2), n_estimators=k, checkpoint_every=8)
        jobs.append(len(track.getJobIdsForGroup(f"rounds-{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] - jobs[0] <= 12 + 2


@pytest.mark.parametrize("many", [1, 12])
def test_cells_are_scored_once(spark, many):
    """Scores by cells equal scores by rows, NaN and too many cells to number included."""
    from plumbline.ml.votes import cell_scores

    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (400, 2)).astype(float)
    x[:9, 1] = np.nan
    cuts = {1: [1.0, 3.0], 0: [0.5 + i / 1e9 for i in range(many * 4)]}
    if many > 1:
        cuts |= {f: [0.0] * 63 for f in range(2, 14)}
        x = np.column_stack([x, np.ones((400, 12))])
    df = spark.createDataFrame([(i, Vectors.dense(r)) for i, r in enumerate(x)], ["i", "features"]).repartition(3)
    rows = df.select("i", cell_scores("features", cuts, lambda cells: cells[:, :2] * 1.0).alias("s")).collect()
    want = [[float((~(x[r["i"], f] <= np.array(cuts[f]))).sum()) for f in (1, 0)] for r in rows]
    assert [r["s"] for r in rows] == want


@pytest.mark.parametrize("classes_", [2, 0])
def test_boosted_trees_equal_those_of_rows(spark, classes_):
    """Histogram trees against Spark's on rows, where both have the same cuts, in three jobs a tree; the model survives saving."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    from plumbline.ml.estimators import gradient_boosting

    rng = np.random.default_rng(2)
    x = np.column_stack([rng.integers(0, 9, 400), rng.integers(0, 2, 400), rng.integers(0, 5, 400)]).astype(float)
    y = x[:, 0] * 2 - x[:, 2] ** 2 + 3 * x[:, 1] + rng.normal(size=400)
    y = (y > 4).astype(float) if classes_ else y
    df = spark.createDataFrame([(i, Vectors.dense(r), float(c)) for i, (r, c) in enumerate(zip(x, y))], ["i", "features", "label"]).cache()
    spark.sparkContext.setJobGroup(f"trees-{classes_}", "")
    model = gradient_boosting(df, Shape(400, 3, classes_), n_estimators=12, learning_rate=0.1, max_depth=3)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trees-{classes_}")) <= 12 * 3 + 12
    kind = GBTClassifier if classes_ else GBTRegressor
    spark_model = kind(maxIter=12, stepSize=0.1, maxDepth=3, seed=42).fit(df)
    out = "probability" if classes_ else "prediction"
    numbers = lambda m: [np.atleast_1d(r[0].toArray() if classes_ else r[0]) for r in m.transform(df).orderBy("i").select(out).collect()]
    path = scratch_path(spark, "trees")
    model.save(path)
    for m in (model, PipelineModel.load(path)):
        assert np.allclose(numbers(m), numbers(spark_model))
    assert np.allclose(model.slot_weights / model.slot_weights.sum(), spark_model.featureImportances.toArray(), atol=1e-6)
