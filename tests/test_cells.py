"""What is read off counted cells equals what the operators compute from the table itself."""

import decimal
import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import drift, leakage, profile, quality, relations, stats
from plumbline.operators.cells import TableCells

SCHEMA = "a double, big long, price decimal(9,2), word string, day date, flag boolean, y double, label string"


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for i in range(400):
        rows.append((
            None if i % 11 == 0 else float("nan") if i % 13 == 0 else float("inf") if i == 5 else -float("inf") if i == 7 else math.sin(i) * (1e15 if i == 9 else 10),
            2**53 + i % 3,
            decimal.Decimal(i % 50) / 4 if i % 9 else None,
            None if i % 7 == 0 else "hot" if i % 3 == 0 else f"w{i % 29}",
            None,
            None if i % 5 == 0 else i % 2 == 0,
            float(i % 37) if i % 17 else None,
            None if i % 19 == 0 else "abc"[i % 3],
        ))
    df = spark.createDataFrame(rows + rows[:25], SCHEMA)
    return df.withColumn("day", F.when(F.col("big") % 2 == 0, F.lit("2020-02-29").cast("date")))


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    clean = lambda x: f"{x:.9g}" if isinstance(x, float) else x
    read = lambda t: sorted((tuple(clean(r[c]) for c in names) for r in t.collect()), key=repr)
    assert read(got) == read(want)


def test_tables_without_classes(table):
    cells = TableCells(table, "y")
    numeric = ["a", "big", "price", "y"]
    assert cells.numeric == numeric and cells.rows == 425
    quartiles = cells.quantiles(numeric, stats.QUARTILES)
    same(cells.summary(numeric, quartiles, ("q1", "median", "q3")), stats.numeric_summary(table))
    same(cells.missing_counts(), stats.missing_counts(table))
    same(cells.distinct_counts(), stats.distinct_counts(table))
    same(cells.histogram(numeric), stats.histogram_table(table, numeric))
    same(cells.histogram(["y"], rows_per_bin=50, bounds=(8, 25)), profile.target_histogram(table, "y"))
    same(cells.top_values(["word", "day", "flag", "label"]), profile.top_values(table))
    same(cells.semantic_types(), profile.semantic_types(table))
    same(cells.duplicate_rows(), stats.duplicate_rows(table))
    assert cells.duplicate_rows().first()["duplicates"] == 25
    same(cells.numeric_baseline(cells.quantiles(numeric, drift.BASELINE_QUANTILES)), drift.numeric_baseline(table, "y"))
    same(cells.categorical_baseline(), drift.categorical_baseline(table, "y"))
    same(cells.moment_profile(numeric[1:]), stats.moment_profile(table, numeric[1:]))
    same(cells.outlier_counts(numeric, cells.quantiles(numeric, (0.25, 0.75))), quality.outlier_counts(table, numeric))
    same(cells.mean_target("word"), relations.mean_target_by_category(table, "y", "word"))
    same(cells.mutual_information(), relations.mutual_information(table, "y", "regression"))
    same(cells.leakage_ranking(cells.correlations()), leakage.leakage_ranking(table, "y"))


@pytest.mark.parametrize("target, feature", [("label", "word"), ("flag", "label")])
def test_tables_with_classes(table, target, feature):
    cells = TableCells(table, target, classes=True)
    same(cells.class_distribution(), profile.class_distribution(table, target))
    same(cells.unique_density(), profile.unique_density(table, target))
    same(cells.categorical_concentration(), profile.categorical_concentration(table, target))
    same(cells.quartiles_by_class("price"), relations.quartiles_by_class(table, target, "price"))
    same(cells.class_rates(feature), relations.class_rates_by_category(table, target, feature))
    same(cells.mutual_information(), relations.mutual_information(table, target, "classification"))


def test_no_rows_and_no_copies(spark, table):
    none = TableCells(table.limit(0), "label", classes=True)
    assert none.duplicate_rows().first()[:] == (0, 0) and none.semantic_types().count() == 8
    assert none.quantiles(none.numeric, (0.5,)) == {} and none.histogram(none.numeric).count() == 0
    assert none.mutual_information().count() == 0 and none.class_distribution().count() == 0
    alone = TableCells(spark.range(50).toDF("n"))
    assert alone.duplicate_rows().first()[:] == (50, 0) and alone.quantiles(["n"], (0.5,)) == {"n": [24.5]}


def test_a_report_reads_the_table_four_times(spark, table, tmp_path, monkeypatch):
    """Facts, cells, correlations, and copies of rows: counted as plans that reach the files."""
    from plumbline.operators import cells as C
    from plumbline.plans.report import exploration_report

    table.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(C, "stage", lambda df, name: staged(df, tmp_path / name))

    def staged(df, path):
        df.write.parquet(str(path))
        return spark.read.parquet(str(path))

    report = exploration_report(stored, "label")
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    # what is left to run after the facts, the cells and the correlations are there: copies only
    source = [c.name for c in stored.schema.fields]
    relations_left = [line for line in plan.splitlines() if "Relation [" in line and line.split("Relation [")[1].startswith(source[0] + "#")]
    assert len(relations_left) == 1


def test_dates_are_parsed_once_a_value(spark):
    """The scan for facts parses no text; shares are read off the counted values."""
    days = ["2020-02-29", "x", None, "2021-01-05"]
    df = spark.createDataFrame([(i, days[i % 4], "a") for i in range(200)], "k long, day string, code string")
    cells = TableCells(df)
    assert not [name for name in cells.facts if name.startswith("date")]
    assert cells.date_shares() == {"day": pytest.approx(2 / 3), "code": 0.0}
    got = {r["column"]: r["date_share"] for r in cells.semantic_types().collect()}
    assert got == {"k": 0.0, "day": 0.6667, "code": 0.0}
