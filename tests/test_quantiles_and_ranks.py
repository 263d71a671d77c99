import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.operators import quantiles as Q
from plumbline.operators.quantiles import column_quantiles, group_quantiles, quantiles_by_selection, select_ranks
from plumbline.operators.ranks import row_at, running_totals, top_per_group
from plumbline.operators.split import assign_folds, sample_rows, train_test_split

PROBS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def _draws():
    rng = np.random.default_rng(5)
    return {
        "uniform": rng.uniform(-3, 3, 3000),
        "heavy": np.exp(rng.normal(0, 6, 3000)),
        "hot": np.where(rng.random(3000) < 0.4, 7.0, rng.normal(7, 1e-9, 3000)),
        "two_hot": np.repeat([1.0, 2.0], 1500),
        "few": rng.integers(0, 4, 3000).astype(float),
        "wide": np.concatenate([rng.uniform(-1, 1, 2990) * 1.7e308, np.full(10, 1e-320)]),
        "constant": np.full(3000, 3.25),
    }


@pytest.fixture(scope="module")
def cells(spark):
    data = pd.concat([pd.DataFrame({"grp": g, "value": v}) for g, v in _draws().items()])
    return spark.createDataFrame(data).repartition(6).cache()


@pytest.mark.parametrize("finish_rows,width", [(20, 8), (500, 64), (10**6, 16)])
def test_selection_equals_sorting(cells, finish_rows, width):
    draws = _draws()
    ranks = {g: [0, 1, 700, 1499, 1500, 2998, 2999] for g in draws}
    got = select_ranks(cells, ranks, finish_rows=finish_rows, width=width)
    for g, v in draws.items():
        ordered = np.sort(v)
        for r in ranks[g]:
            assert got[(g, r)] == ordered[r], (g, r)


def test_selection_quantiles_match_numpy(cells):
    got = quantiles_by_selection(cells.filter("grp <> 'wide'"), PROBS, finish_rows=50, width=16)
    for g, v in _draws().items():
        if g != "wide":
            np.testing.assert_allclose(got[g], np.quantile(v, PROBS), rtol=1e-12)


def test_infinite_values_keep_their_ranks(spark):
    v = [float("-inf")] * 2 + [1.0, 2.0, 3.0] + [float("inf")]
    df = spark.createDataFrame([("g", x) for x in v], "grp string, value double")
    got = select_ranks(df, {"g": range(6)}, finish_rows=1, width=2)
    assert [got[("g", r)] for r in range(6)] == v


def test_both_quantile_forms_agree(spark, cells):
    df = spark.createDataFrame(pd.DataFrame({k: v for k, v in _draws().items() if k != "wide"}))
    small = column_quantiles(df, df.columns, PROBS, small=True)
    large = column_quantiles(df, df.columns, PROBS, small=False)
    for c in df.columns:
        np.testing.assert_allclose(small[c], large[c], rtol=1e-12)
    one = group_quantiles(df.withColumn("k", F.lit("a")), "k", "heavy", (0.5,), small=False).first()
    assert one["q"][0] == pytest.approx(np.median(_draws()["heavy"]))


@pytest.fixture(scope="module")
def far(spark):
    """Log-normal values with a few huge ones, hot values, infinities, nulls, and a column of one value."""
    rng = np.random.default_rng(9)
    v = np.exp(rng.normal(0, 3, 20000))
    v[:5] = 1e15
    edges = np.where(rng.random(20000) < 0.3, 5.0, rng.normal(0, 1, 20000))
    edges[:40], edges[40:100] = -np.inf, np.inf
    data = pd.DataFrame({"skewed": v, "edges": edges, "one": 2.5})
    return data, spark.createDataFrame(data).repartition(5).cache()


def test_two_scans_whatever_the_distribution(far, monkeypatch):
    data, df = far
    calls = []
    plain = Q.select_ranks

    def watched(*args, **named):
        calls.append(named.get("weight"))
        return plain(*args, **named)

    monkeypatch.setattr(Q, "select_ranks", watched)
    stats, got, extra = Q.quantiles_in_two_scans(df, list(data), PROBS, [F.count("*").alias("rows")])
    assert calls == ["n"]  # ranks were read off the bracket table, never searched for in the input again
    assert extra == {"rows": 20000} and stats["edges"][3:] == (40, 60) and stats["skewed"][:1] == (20000,)
    for c in data:
        ordered = np.sort(data[c])
        for p, q in zip(PROBS, got[c]):
            low, w = divmod((len(ordered) - 1) * p, 1)
            a, b = ordered[int(low)], ordered[min(int(low) + 1, len(ordered) - 1)]
            assert q == a if w == 0 or a == b else q == pytest.approx(a * (1 - w) + b * w, rel=1e-12), (c, p)


def test_ranks_that_brackets_miss_are_still_exact(far):
    data, df = far
    # a tiny sketch with narrow brackets misses often
    _, got, _ = Q.quantiles_in_two_scans(df, ["skewed"], PROBS, sketch=8, reach=1e-9)
    np.testing.assert_allclose(got["skewed"], np.quantile(data["skewed"], PROBS), rtol=1e-12)


@pytest.mark.parametrize("buckets", [1, 6])
def test_quartiles_of_many_groups(spark, buckets):
    rng = np.random.default_rng(4)
    data = pd.DataFrame({"k": np.where(rng.random(3000) < 0.34, 7, rng.integers(100, 900, 3000)), "v": rng.integers(0, 50, 3000).astype(float)})
    data.loc[data["k"] == 101, "v"] = [np.inf] * int((data["k"] == 101).sum())
    df = spark.createDataFrame(data).unionByName(spark.createDataFrame([(None, 1.0), (5, None)], "k long, v double"))
    got = {r["grp"]: r["q"] for r in group_quantiles(df, "k", "v", (0.25, 0.5, 0.9), small=False, buckets=buckets).collect()}
    assert set(got) == {str(k) for k in data["k"].unique()}
    for k, part in data.groupby("k"):
        if k == 101:
            assert got["101"] == [np.inf] * 3
        else:
            np.testing.assert_allclose(got[str(k)], np.quantile(part["v"], (0.25, 0.5, 0.9)), rtol=1e-12)


def test_all_null_column_has_no_quantiles(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert column_quantiles(df, ["x"], (0.5,), small=True) == {"x": None}
    assert column_quantiles(df, ["x"], (0.5,), small=False) == {"x": None}


@pytest.mark.parametrize("buckets", [1, 7])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, buckets, descending):
    rng = np.random.default_rng(1)
    # a third of the rows in one group
    pdf = pd.DataFrame({"o": rng.permutation(900) * 0.5, "g": np.where(rng.random(900) < 0.4, "hot", rng.choice(list("abc"), 900)), "n": rng.integers(1, 9, 900)})
    got = running_totals(spark.createDataFrame(pdf), "o", ["n"], ["g"], descending, buckets).toPandas()
    ordered = pdf.sort_values("o", ascending=not descending)
    want = ordered.assign(n_before=ordered.groupby("g").n.cumsum() - ordered.n)
    merged = got.merge(want, on=["o", "g", "n"])
    assert len(merged) == 900 and (merged.n_before_x == merged.n_before_y).all()


@pytest.fixture(scope="module")
def keyed(spark):
    return spark.range(1000).select("id", F.when(F.col("id") < 400, "hot").when(F.col("id") < 997, "cold").otherwise("rare").alias("y")).cache()


@pytest.mark.parametrize("digits", [1, 3])
def test_split_and_folds_follow_the_hash(keyed, digits):
    import hashlib

    pdf = keyed.toPandas()
    pdf["h"] = [hashlib.md5(str(i).encode()).hexdigest() for i in pdf.id]
    position = pdf.sort_values("h").groupby("y").cumcount().sort_index()
    size = pdf.groupby("y").id.transform("size")
    want_test = dict(zip(pdf.id, (position + 1) <= np.ceil(size * 0.2)))
    got = train_test_split(keyed, "id", "y", 0.2, digits).toPandas()
    assert dict(zip(got.id, got.is_test)) == want_test
    folds = assign_folds(keyed, "id", 5, "y", digits).toPandas()
    assert len(folds) == 1000 and set(folds.fold) == {0, 1, 2, 3, 4}
    counts = folds.groupby(["y", "fold"]).size().unstack(fill_value=0)
    assert (counts.max(axis=1) - counts.min(axis=1) <= 1).all()


def test_folds_do_not_depend_on_partitions(keyed):
    a = assign_folds(keyed.repartition(1), "id", 3, "y").toPandas().set_index("id").fold
    b = assign_folds(keyed.repartition(9), "id", 3, "y").toPandas().set_index("id").fold
    assert (a.sort_index() == b.sort_index()).all()


def test_bad_split_arguments(keyed):
    with pytest.raises(ValueError):
        assign_folds(keyed, "id", 1)
    with pytest.raises(ValueError):
        train_test_split(keyed, "id", test_size=1.0)


def test_sample_is_repeatable(keyed):
    a = {r.id for r in sample_rows(keyed.repartition(3), "id", 50).collect()}
    assert len(a) == 50 and a == {r.id for r in sample_rows(keyed, "id", 50).collect()}


@pytest.mark.parametrize("heap", [10_000, 1])
def test_row_at(keyed, heap):
    assert row_at(keyed, "id", 37, heap).first()["id"] == 37
    with pytest.raises(IndexError):
        row_at(keyed, "id", 1000, heap)
    with pytest.raises(IndexError):
        row_at(keyed, "id", -1, heap)


def test_top_per_group_limits_before_the_shuffle(keyed):
    top = top_per_group(keyed, ["y"], [F.col("id").desc()], 2)
    assert top.count() == 6
    assert "WindowGroupLimit" in top._jdf.queryExecution().optimizedPlan().toString()


def test_row_at_deals_few_ranges(keyed, monkeypatch):
    """However small the heap, a round deals a bounded number of ranges; a key that never splits ends the search."""
    asked = []
    dealt = type(keyed).repartitionByRange
    monkeypatch.setattr(type(keyed), "repartitionByRange", lambda self, n, *c: asked.append(n) or dealt(self, n, *c))
    assert row_at(keyed, "id", 137, 1).first()["id"] == 137
    assert 1 < len(asked) <= 4 and max(asked) <= 64
    same = keyed.selectExpr("CASE WHEN id < 5 THEN NULL WHEN id < 90 THEN 7 ELSE id END AS key")
    assert row_at(same.distinct(), "key", 1, 1).first()["key"] == 7
    assert {r["key"] for r in row_at(same, "key", 50, 1).collect()} == {7} and {r["key"] for r in row_at(same, "key", 3, 1).collect()} == {None}
