"""Batch scoring, scoring templates and truth-prediction tables."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import integer_like, quoted
from plumbline.functions.typing import normalised, type_groups
from plumbline.ml.prepare import decode_label
from plumbline.operators.registry import align_features
from plumbline.operators.stats import ranked_values, unfold, value_frequencies
from plumbline.sources.bundles import ModelBundle

MAX_OPTIONS = 20


def score(df: DataFrame, bundle: ModelBundle, keep: list[str] | None = None) -> DataFrame:
    """Adds `prediction` to the `keep` columns, and for classes `probability` (class -> p) and `confidence`.

    Missing feature columns are imputed and extra ones ignored.  A projection per row, so
    the same call scores a batch or a stream.
    """
    keep = list(df.columns) if keep is None else list(keep)
    carried = [quoted(c).alias(f"__keep_{i}") for i, c in enumerate(keep)]
    features = align_features(df, bundle.features).columns
    have = dict(bundle.features)
    aligned = [(quoted(c) if c in df.columns else F.lit(None)).cast(have[c]).alias(c) for c in features]
    out = bundle.pipeline.transform(df.select(*carried, *aligned))
    back = [F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)]
    if bundle.task == "regression":
        return out.select(*back, F.col("prediction"))
    columns = [*back, decode_label("prediction", bundle.labels).alias("prediction")]
    if "probability" in out.columns:
        p = vector_to_array("probability")
        names = F.array(*[F.lit(x) for x in bundle.labels])
        columns += [F.map_from_arrays(names, p).alias("probability"), F.array_max(p).alias("confidence")]
    return out.select(*columns)


def truth_and_prediction(df: DataFrame, bundle: ModelBundle, key: str) -> DataFrame:
    """`(key, y_true, y_pred[, confidence])`: rows with a target, scored in place; classes are decoded first."""
    if bundle.target not in df.columns:
        raise ValueError(f"target column '{bundle.target}' is missing")
    rows = normalised(df).filter(quoted(bundle.target).isNotNull())
    scored = score(rows, bundle, keep=[key, bundle.target])
    kind = "string" if bundle.task == "classification" else "double"
    return scored.select(quoted(key), quoted(bundle.target).cast(kind).alias("y_true"), F.col("prediction").alias("y_pred"))


def inference_template(df: DataFrame, features: list[str], seed: int | None = None) -> DataFrame:
    """`(feature, input_kind, min, max, mean, std, integer_like, options, default_value)` per feature.

    Default: the mean (rounded when all values are whole), or a seeded draw from the range.
    Text: the most frequent value, or a seeded pick among the 20 options.  A feature the
    table lacks is free text.
    """
    df = normalised(df)
    known = [f for f in features if f in df.columns]
    groups = type_groups(df.select(*map(quoted, known)))
    numbers = [f for f in known if groups[f] == "numeric"]
    texts = [f for f in known if groups[f] != "numeric"]
    schema = "feature string, input_kind string, min double, max double, mean double, std double, integer_like boolean, options array<string>, default_value string"
    order = {f: i for i, f in enumerate(features)}
    parts = [df.sparkSession.createDataFrame([(f, "text", None, None, None, None, None, None, "") for f in features if f not in known], schema)]
    draw = lambda f: F.lit(0.5) if seed is None else F.rand(seed + order[f])
    if numbers:
        exprs = []
        for i, f in enumerate(numbers):
            x = quoted(f).cast("double")
            exprs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"a{i}"), F.max(x).alias(f"b{i}"), F.avg(x).alias(f"m{i}")]
            exprs += [F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"s{i}"), F.every(integer_like(x)).alias(f"i{i}")]
        def default(i, f):
            if seed is None:
                return F.when(F.col(f"i{i}"), F.round(F.col(f"m{i}")).cast("long").cast("string")).otherwise(F.round(F.col(f"m{i}"), 6).cast("string"))
            u, low, high = draw(f), F.col(f"a{i}"), F.col(f"b{i}")
            whole = F.floor(low + u * (high - low + 1)).cast("long").cast("string")
            return F.when(F.col(f"i{i}"), whole).otherwise(F.round(low + u * (high - low), 6).cast("string"))

        cells = [
            (
                F.lit(f).alias("feature"),
                F.when(F.col(f"n{i}") > 0, "number").otherwise("text").alias("input_kind"),
                F.col(f"a{i}").alias("min"),
                F.col(f"b{i}").alias("max"),
                F.col(f"m{i}").alias("mean"),
                F.col(f"s{i}").alias("std"),
                F.col(f"i{i}").alias("integer_like"),
                F.lit(None).cast("array<string>").alias("options"),
                F.coalesce(default(i, f), F.lit("")).alias("default_value"),
            )
            for i, f in enumerate(numbers)
        ]
        parts.append(unfold(df.agg(*exprs), cells))
    if texts:
        freq = value_frequencies(df, texts).filter(F.col("value").isNotNull())
        top = ranked_values(freq, MAX_OPTIONS)
        listed = top.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("o"))
        options = F.transform("o", lambda s: s["value"])
        pick = F.lit(0) if seed is None else F.floor(F.rand(seed) * F.size("o")).cast("int")
        names = df.sparkSession.createDataFrame([(t,) for t in texts], "column string")
        empty = F.lit(None).cast("double")
        parts.append(
            names.join(F.broadcast(listed), "column", "left").select(
                F.col("column").alias("feature"),
                F.when(F.col("o").isNotNull(), "select").otherwise("text").alias("input_kind"),
                empty.alias("min"),
                empty.alias("max"),
                empty.alias("mean"),
                empty.alias("std"),
                F.lit(None).cast("boolean").alias("integer_like"),
                options.alias("options"),
                F.coalesce(F.get(options, pick), F.lit("")).alias("default_value"),
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
