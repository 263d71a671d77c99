"""Model evaluation from scored tables `(y_true, y_pred[, score])`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expr import quoted
from plumbline.functions.typing import normalised
from plumbline.operators.quantiles import column_quantiles
from plumbline.operators.ranks import running_totals
from plumbline.operators.split import sample_rows
from plumbline.operators.stats import histogram_table, unfold


def align(truth: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Join truth and predictions on a stable row key (never by position); null truth is dropped."""
    return truth.filter(F.col("y_true").isNotNull()).join(predictions, key)


def confusion_cells(scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """`(y_true, y_pred, n)` of the pairs that occur; labels as text."""
    return scored.groupBy(quoted(y_true).cast("string").alias("y_true"), quoted(y_pred).cast("string").alias("y_pred")).agg(
        F.count("*").alias("n")
    )


def label_union(cells: DataFrame) -> DataFrame:
    """Distinct labels that occur as truth or prediction."""
    return cells.select(F.col("y_true").alias("label")).union(cells.select("y_pred")).distinct()


def confusion_matrix(scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """`(y_true, y_pred, n, rate)` over the union of labels, zero-filled; `rate` is row-normalised.

    The grid is the result itself: labels squared, however many rows were scored.
    """
    cells = confusion_cells(scored, y_true, y_pred)
    labels = label_union(cells).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    grid = labels.select(F.explode("labels").alias("y_true"), "labels").select("y_true", F.explode("labels").alias("y_pred"))
    full = grid.join(cells, ["y_true", "y_pred"], "left").select("y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(W.partitionBy("y_true"))
    return full.select(
        "y_true", "y_pred", "n", F.round(F.coalesce(F.try_divide(F.col("n"), total), F.lit(0.0)), 6).alias("rate")
    )


def confusion_rates(scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """`(y_true, y_pred, n, support, predicted, of_true, of_pred)` of the pairs that occur, for any number of labels.

    `support` and `predicted` are the totals of the truth and of the prediction; the rates are shares of them.  The size
    is that of the occurring pairs; `confusion_matrix` gives the grid.  A null label is a label.
    """
    cells = confusion_cells(scored, y_true, y_pred)
    rows = cells.groupBy(F.col("y_true").alias("t")).agg(F.sum("n").alias("support"))
    columns = cells.groupBy(F.col("y_pred").alias("p")).agg(F.sum("n").alias("predicted"))
    both = cells.join(rows, F.col("y_true").eqNullSafe(F.col("t"))).join(columns, F.col("y_pred").eqNullSafe(F.col("p")))
    return both.select("y_true", "y_pred", "n", "support", "predicted", (F.col("n") / F.col("support")).alias("of_true"), (F.col("n") / F.col("predicted")).alias("of_pred"))


def _class_counts(cells: DataFrame) -> DataFrame:
    """`(label, support, predicted, hits)` from the confusion cells in one grouping."""
    entry = lambda label, s, p, h: F.struct(label.alias("label"), s.alias("support"), p.alias("predicted"), h.alias("hits"))
    zero = F.lit(0).cast("long")
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(zero)
    sides = F.array(entry(F.col("y_true"), F.col("n"), zero, hit), entry(F.col("y_pred"), zero, F.col("n"), zero))
    return cells.select(F.inline(sides)).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])


def _per_class(cells: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    rated = _class_counts(cells).select("*", ratio("hits", "predicted").alias("precision"), ratio("hits", "support").alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def class_report(scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """`(label, precision, recall, f1, support)` per class, plus `macro avg` and `weighted avg` rows."""
    per = _per_class(confusion_cells(scored, y_true, y_pred))
    metrics = ("precision", "recall", "f1")
    weighted = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    averages = per.agg(
        *[F.avg(c).alias(f"m_{c}") for c in metrics], *[weighted(c).alias(f"w_{c}") for c in metrics], F.sum("support").alias("support")
    )
    rows = unfold(
        averages,
        [
            (F.lit(f"{name} avg").alias("label"), *[F.col(f"{tag}_{c}").alias(c) for c in metrics], F.col("support").alias("support"))
            for name, tag in (("macro", "m"), ("weighted", "w"))
        ],
    )
    return per.select("label", *metrics, "support").unionByName(rows)


def classification_metrics(scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """One row: accuracy, weighted precision, recall and F1, balanced accuracy (0/0 counts as 0)."""
    per = _per_class(confusion_cells(scored, y_true, y_pred))
    share = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    return per.agg(
        F.coalesce(F.try_divide(F.sum("hits"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
        share("precision").alias("precision"),
        share("recall").alias("recall"),
        share("f1").alias("f1_score"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
    )


def score_counts(scored: DataFrame, positive: str, y_true: str = "y_true", score: str = "score") -> DataFrame:
    """`(score, pos, neg)` per distinct score, the only thing ROC and AUC need."""
    hit = (quoted(y_true).cast("string") == F.lit(positive)).cast("long")
    rows = scored.filter(quoted(score).isNotNull() & ~F.isnan(quoted(score).cast("double")) & quoted(y_true).isNotNull())
    return rows.groupBy((quoted(score).cast("double") + F.lit(0.0)).alias("score")).agg(
        F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg")
    )


def roc_curve(scored: DataFrame, positive: str, y_true: str = "y_true", score: str = "score", buckets: int | None = None) -> DataFrame:
    """`(threshold, fpr, tpr)` per distinct score, highest first, with running totals taken bucket by bucket."""
    counts = score_counts(scored, positive, y_true, score)
    ahead = running_totals(counts, "score", ["pos", "neg"], descending=True, buckets=buckets)
    totals = F.broadcast(counts.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg")).withColumn("one", F.lit(1)))
    joined = ahead.withColumn("one", F.lit(1)).join(totals, "one")
    return joined.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_before") + F.col("neg"), F.col("all_neg")).alias("fpr"),
        F.try_divide(F.col("pos_before") + F.col("pos"), F.col("all_pos")).alias("tpr"),
    )


def roc_points(scored: DataFrame, positive: str, error: float = 1e-3, y_true: str = "y_true", score: str = "score", buckets: int | None = None) -> DataFrame:
    """`(threshold, fpr, tpr)`: the curve with its start (0, 0), thinned for storage.

    The unit square is cut into cells of side `error`; of the points in one cell the first and the last stay.  A rising
    curve crosses at most 2 / error + 1 cells, and in each the line between them is off by half a cell's area at most: there
    are at most 4 / error + 3 points, and their area differs from the whole curve's by error + error ^ 2 / 2 at most.  The start
    has no threshold; without positives or negatives there are no points.
    """
    whole = roc_curve(scored, positive, y_true, score, buckets).filter(F.col("fpr").isNotNull() & F.col("tpr").isNotNull())
    cell = lambda c: F.floor(F.col(c) / error)
    point = F.struct("threshold", "fpr", "tpr")
    ends = whole.groupBy(cell("fpr").alias("x"), cell("tpr").alias("y")).agg(F.max(point).alias("first"), F.min(point).alias("last"))
    kept = ends.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("p")).select("p.*")
    start = kept.limit(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(kept)


def roc_auc(scored: DataFrame, positive: str, y_true: str = "y_true", score: str = "score", buckets: int | None = None) -> DataFrame:
    """One row `(roc_auc)`: chance that a positive outranks a negative, ties counting half; null with one class."""
    counts = score_counts(scored, positive, y_true, score)
    below = running_totals(counts, "score", ["neg"], buckets=buckets)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return below.agg(F.try_divide(wins, pairs).alias("roc_auc"))


def roc_auc_multiclass(
    scored: DataFrame, classes: Sequence[str], y_true: str = "y_true", scores: str = "scores", buckets: int | None = None
) -> DataFrame:
    """One row `(roc_auc)`: one-vs-rest AUC per class, weighted by support; null when a class is absent.

    `scores` is an array in the order of `classes`.
    """
    entry = [
        F.struct(
            F.lit(c).alias("label"),
            (quoted(scores)[i].cast("double") + F.lit(0.0)).alias("score"),
            (quoted(y_true).cast("string") == F.lit(c)).cast("long").alias("hit"),
        )
        for i, c in enumerate(classes)
    ]
    long = scored.select(F.inline(F.array(*entry))).filter(F.col("score").isNotNull() & ~F.isnan("score"))
    counts = long.groupBy("label", "score").agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    below = running_totals(counts, "score", ["neg"], group=["label"], buckets=buckets)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    per = below.groupBy("label").agg(
        F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"), F.sum("pos").alias("support")
    )
    failed = F.count_if(F.col("auc").isNull()) > 0
    return per.agg(
        F.when(~failed, F.try_divide(F.sum(F.col("auc") * F.col("support")), F.sum("support"))).alias("roc_auc")
    )


def _residual() -> Column:
    return F.col("y_true").cast("double") - F.col("y_pred").cast("double")


def complete_pairs(scored: DataFrame) -> DataFrame:
    """Rows with a true and a predicted number; NaN is missing, as everywhere."""
    rows = normalised(scored)
    return rows.filter(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())


def regression_metrics(scored: DataFrame, exact: bool = True) -> DataFrame:
    """One row: RMSE, MSE, MAE, R2, explained variance, median absolute error, MAPE."""
    rows = complete_pairs(scored).select(F.col("y_true").cast("double").alias("y"), _residual().alias("e"), F.abs(_residual()).alias("a"))
    median = column_quantiles(rows, ["a"], (0.5,), exact)["a"]
    y, e = F.col("y"), F.col("e")
    mse = F.avg(e * e)
    return rows.agg(
        F.sqrt(mse).alias("rmse"),
        mse.alias("mse"),
        F.avg("a").alias("mae"),
        (1 - F.try_divide(mse, F.var_pop(y))).alias("r2_score"),
        (1 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"),
        F.lit(median[0] if median else None).cast("double").alias("median_ae"),
        F.avg(F.col("a") / F.greatest(F.abs(y), F.lit(1e-8))).alias("mape"),
    )


def residual_summary(scored: DataFrame, exact: bool = True) -> DataFrame:
    """One row: mean residual, 95th percentile of its size, rows at or above it."""
    rows = complete_pairs(scored).select(_residual().alias("e"), F.abs(_residual()).alias("a"))
    p95 = column_quantiles(rows, ["a"], (0.95,), exact)["a"]
    limit = F.lit(p95[0] if p95 else 0.0)
    return rows.agg(
        F.avg("e").alias("mean_residual_bias"), limit.alias("large_residual_limit"), F.count_if(F.col("a") >= limit).alias("large_residual_count")
    )


def residual_histogram(scored: DataFrame) -> DataFrame:
    """Bins follow the row count: one per 50 rows, from 10 to 25."""
    return histogram_table(scored.select(_residual().alias("residual")), ["residual"], rows_per_bin=50, bounds=(10, 25))


def residual_sample(scored: DataFrame, key: Sequence[str], n: int = 2000) -> DataFrame:
    """n rows sampled by their key's hash: actual, predicted, residual."""
    head = sample_rows(scored, key, n)
    return head.select(F.col("y_true").alias("actual"), F.col("y_pred").alias("predicted"), _residual().alias("residual"))


def fold_scores(scored: DataFrame, task: str, fold: str = "fold") -> DataFrame:
    """`(fold, score)`: accuracy or R2 of each fold."""
    if task == "classification":
        score = F.avg((F.col("y_true").cast("string") == F.col("y_pred").cast("string")).cast("double"))
    else:
        e = _residual()
        score = 1 - F.try_divide(F.avg(e * e), F.var_pop(F.col("y_true").cast("double")))
    return scored.groupBy(quoted(fold).alias("fold")).agg(score.alias("score"))


def fold_summary(folds: DataFrame) -> DataFrame:
    """One row: folds, mean and population deviation of the scores."""
    return folds.agg(F.count("*").alias("folds"), F.avg("score").alias("cv_mean"), F.stddev_pop("score").alias("cv_std"))


def prediction_shares(df: DataFrame, group: str, label: str) -> DataFrame:
    """`(group, label, n, share)`: share of each label inside its group, from grouped counts."""
    counts = df.groupBy(quoted(group).alias("group"), quoted(label).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("group")))
