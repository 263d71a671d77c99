"""Headline timings: prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from plumbline.ml.train import train_models  # noqa: E402
from plumbline.operators import drift, evaluate, leakage, profile, quality, relations, split, stats  # noqa: E402
from plumbline.operators.neighbors import knn_join  # noqa: E402
from plumbline.queries.base import LINE_KEY, gappy_lines, leaky_lines, read  # noqa: E402
from plumbline.queries.evaluation import multi_scores, regression_scores  # noqa: E402
from plumbline.queries.modelling import pricing  # noqa: E402
from plumbline.queries.neighbors import vectors  # noqa: E402
from plumbline.queries.quality import shipped_halves  # noqa: E402
from plumbline.session import local_session  # noqa: E402


def drain(df: DataFrame) -> None:
    """Run the whole plan without moving rows to the driver."""
    df.write.format("noop").mode("overwrite").save()


def forest(spark, folder: str) -> None:
    run = train_models(
        pricing(spark, folder), "o_totalprice", "o_orderkey", "regression", ("Random Forest",), folds=0, params={"Random Forest": {"n_estimators": 20, "max_depth": 6}}
    )
    if run.models[0].error:
        raise RuntimeError(run.models[0].error)


def evaluation(spark, folder: str) -> None:
    drain(evaluate.confusion_matrix(multi_scores(spark, folder)))
    drain(evaluate.class_report(multi_scores(spark, folder)))
    drain(evaluate.roc_auc_multiclass(multi_scores(spark, folder), ("A", "N", "R")))
    drain(evaluate.regression_metrics(regression_scores(spark, folder)))


QUERIES = {
    "numeric_summary": lambda s, d: drain(stats.numeric_summary(read(s, d, "lineitem"))),
    "column_profile": lambda s, d: drain(profile.column_profile(read(s, d, "lineitem"), LINE_KEY)),
    "histograms": lambda s, d: drain(stats.histogram_table(read(s, d, "lineitem"), ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))),
    "duplicate_rows": lambda s, d: drain(stats.duplicate_rows(read(s, d, "lineitem"))),
    "correlations": lambda s, d: drain(stats.correlation_pairs(read(s, d, "lineitem"))),
    "quality_score": lambda s, d: drain(quality.quality_score(read(s, d, "lineitem"))),
    "clean_table": lambda s, d: drain(quality.clean_table(gappy_lines(s, d))),
    "leakage_ranking": lambda s, d: drain(leakage.leakage_ranking(leaky_lines(s, d), "l_extendedprice")),
    "mean_shift": lambda s, d: drain(drift.mean_shift(*shipped_halves(s, d))),
    "mutual_information": lambda s, d: drain(
        relations.mutual_information(read(s, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice"), "l_extendedprice", "regression")
    ),
    "train_test_split": lambda s, d: drain(split.train_test_split(read(s, d, "lineitem"), LINE_KEY, "l_returnflag")),
    "evaluation": evaluation,
    "nearest_neighbors": lambda s, d: drain(knn_join(vectors(s, d), vectors(s, d), 7, exclude_self=True)),
    "forest_fit_and_score": forest,
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "plumbline-bench")
    drain(read(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count("*")))
    times = {}
    for name, run in QUERIES.items():
        begun = time.monotonic()
        run(spark, folder)
        times[name] = round(time.monotonic() - begun, 3)
        spark.catalog.clearCache()
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
