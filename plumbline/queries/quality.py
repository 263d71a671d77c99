"""Quality, cleaning, leakage and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import drift as D
from plumbline.operators import leakage as L
from plumbline.operators import quality as Q
from plumbline.operators.relations import complete_pairs
from plumbline.queries.base import (
    GAPPY_SQL,
    LABELLED_SQL,
    LEAKY_SQL,
    LINE_NUMERIC,
    gappy_lines,
    labelled_documents,
    leaky_lines,
    per_column,
    query,
    read,
    rounds,
)


def fences_cte(columns, source):
    return ", ".join(
        f"f_{c} AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, q3 - q1 AS iqr FROM "
        f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source}))"
        for c in columns
    )


EVENT_OUTLIERS = (
    f"WITH {fences_cte(('event_id', 'user_id', 'value'), 'events')} "
    + per_column(
        ("event_id", "user_id", "value"),
        "SELECT '{c}' AS feature, coalesce(sum((iqr <> 0 AND ({c} < lo OR {c} > hi))::INT), 0)::BIGINT AS outliers FROM events, f_{c}",
    )
)


@query("outliers", EVENT_OUTLIERS)
def outliers(spark, folder):
    return Q.outlier_counts(read(spark, folder, "events"))


@query("outliers_found", f"SELECT * FROM ({EVENT_OUTLIERS}) WHERE outliers > 0")
def outliers_found(spark, folder):
    return Q.outlier_counts(read(spark, folder, "events"), keep_zero=False)


QUALITY_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")


@query(
    "quality_score",
    f"WITH {GAPPY_SQL}, t AS (SELECT {', '.join(QUALITY_COLUMNS)} FROM gappy), {fences_cte(QUALITY_COLUMNS[:3], 't')}, "
    "s AS (SELECT count(*) AS rows, sum((l_discount IS NULL)::INT + (l_returnflag IS NULL)::INT)::BIGINT AS missing_cells, "
    "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows, ("
    + " + ".join(f"(SELECT coalesce(sum((iqr <> 0 AND ({c} < lo OR {c} > hi))::INT), 0) FROM t, f_{c})" for c in QUALITY_COLUMNS[:3])
    + ")::BIGINT AS outlier_cells FROM t) "
    "SELECT rows, 5::INTEGER AS columns, missing_cells, duplicate_rows, outlier_cells, round(greatest(0, 100 - least(25, missing_cells / (rows * 5) * 100) "
    "- least(20, duplicate_rows / rows * 100) - least(20, outlier_cells / rows * 100)), 2) AS quality_score, "
    "concat_ws(',', CASE WHEN missing_cells > 0 THEN 'impute_missing' END, CASE WHEN duplicate_rows > 0 THEN 'drop_duplicates' END, "
    "CASE WHEN outlier_cells > 0 THEN 'cap_outliers' END) AS advice FROM s",
)
def quality_score(spark, folder):
    out = Q.quality_score(gappy_lines(spark, folder).select(*QUALITY_COLUMNS))
    return out.withColumn("advice", F.array_join("advice", ","))


@query(
    "quality_score_events",
    f"WITH {fences_cte(('event_id', 'user_id', 'value'), 'events')}, s AS (SELECT count(*) AS rows, 0::BIGINT AS missing_cells, "
    "count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)) AS duplicate_rows, ("
    + " + ".join(f"(SELECT coalesce(sum((iqr <> 0 AND ({c} < lo OR {c} > hi))::INT), 0) FROM events, f_{c})" for c in ("event_id", "user_id", "value"))
    + ")::BIGINT AS outlier_cells FROM events) SELECT rows, 6::INTEGER AS columns, missing_cells, duplicate_rows, outlier_cells, "
    "round(greatest(0, 100 - least(20, duplicate_rows / rows * 100) - least(20, outlier_cells / rows * 100)), 2) AS quality_score, "
    "concat_ws(',', CASE WHEN duplicate_rows > 0 THEN 'drop_duplicates' END, CASE WHEN outlier_cells > 0 THEN 'cap_outliers' END) AS advice FROM s",
)
def quality_score_events(spark, folder):
    return Q.quality_score(read(spark, folder, "events")).withColumn("advice", F.array_join("advice", ","))


# Cleaning: quantity, discount (gaps) and flag (gaps) of lineitem, with very many copies.
_DEDUP = f"{GAPPY_SQL}, u AS (SELECT DISTINCT l_quantity, l_discount, l_returnflag FROM gappy)"
_FILLED = (
    f"{_DEDUP}, m AS (SELECT quantile_cont(l_discount, 0.5) AS med FROM u), "
    "o AS (SELECT l_returnflag AS mode FROM u WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), "
    "filled AS (SELECT l_quantity, coalesce(l_discount, med) AS l_discount, coalesce(l_returnflag, mode) AS l_returnflag FROM u, m, o)"
)


def cleaning_input(spark, folder):
    return gappy_lines(spark, folder).select("l_quantity", "l_discount", "l_returnflag")


@query("drop_duplicates", f"WITH {_DEDUP} SELECT * FROM u")
def drop_duplicates(spark, folder):
    return Q.drop_duplicates(cleaning_input(spark, folder))


@query("fill_missing", f"WITH {_FILLED} SELECT l_quantity, round(l_discount, 6) + 0.0 AS l_discount, l_returnflag FROM filled")
def fill_missing(spark, folder):
    distinct = Q.drop_duplicates(cleaning_input(spark, folder))
    return rounds(Q.fit_cleaning(distinct).filled(distinct))


_EV = "SELECT event_type, nullif(user_id, 0) AS user_id, value FROM events"
_EV_CLEAN = (
    f"u AS (SELECT DISTINCT * FROM ({_EV})), m AS (SELECT quantile_cont(user_id, 0.5) AS med FROM u), "
    "filled AS (SELECT event_type, coalesce(user_id, med)::DOUBLE AS user_id, value FROM u, m), "
    + fences_cte(("user_id", "value"), "filled")
)


def gappy_events(spark, folder):
    ev = read(spark, folder, "events")
    return ev.select("event_type", F.nullif("user_id", F.lit(0)).alias("user_id"), "value")


_EV_TABLE = (
    f"WITH {_EV_CLEAN} SELECT event_type, round(greatest(a.lo, least(a.hi, user_id)), 6) + 0.0 AS user_id, "
    "round(greatest(b.lo, least(b.hi, value)), 6) + 0.0 AS value FROM filled, f_user_id a, f_value b"
)


@query("clean_table", _EV_TABLE)
def clean_table(spark, folder):
    return rounds(Q.clean_table(gappy_events(spark, folder)))


@query(
    "cleaning_log",
    f"WITH {_EV_CLEAN}, l AS (SELECT 'drop_duplicates' AS step, '' AS \"column\", (SELECT count(*) FROM events) - (SELECT count(*) FROM u) AS n "
    "UNION ALL SELECT 'fill_median', 'user_id', count(*) FILTER (user_id IS NULL) FROM u "
    "UNION ALL SELECT 'clip', 'user_id', count(*) FILTER (user_id < lo OR user_id > hi) FROM filled, f_user_id "
    "UNION ALL SELECT 'clip', 'value', count(*) FILTER (value < lo OR value > hi) FROM filled, f_value) SELECT * FROM l WHERE n > 0",
)
def cleaning_log(spark, folder):
    return Q.cleaning_log(gappy_events(spark, folder))


@query(
    "clean_preview",
    f"WITH t AS ({_EV_TABLE}) SELECT event_type, user_id, value, (SELECT count(*) FROM t) AS rows_after_cleaning FROM t "
    "ORDER BY event_type, user_id, value LIMIT 10",
)
def clean_preview(spark, folder):
    out = Q.clean_preview(gappy_events(spark, folder), ("event_type", "user_id", "value"))
    return rounds(out.withColumn("user_id", F.col("user_id").cast("double")).withColumn("value", F.col("value").cast("double")))


@query(
    "clean_and_describe",
    f"WITH t AS ({_EV_TABLE}) "
    + per_column(
        ("user_id", "value"),
        "SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) + 0.0 AS mean, round(stddev_samp({c}), 4) + 0.0 AS std, round(min({c}), 4) + 0.0 AS min, "
        "round(quantile_cont({c}, 0.25), 4) + 0.0 AS q1, round(quantile_cont({c}, 0.5), 4) + 0.0 AS median, round(quantile_cont({c}, 0.75), 4) + 0.0 AS q3, "
        "round(max({c}), 4) + 0.0 AS max FROM t",
    ),
)
def clean_and_describe(spark, folder):
    """Clean, write, read back, describe again."""
    from plumbline.plans.curation import clean_and_save
    from plumbline.session import scratch_path

    described, _ = clean_and_save(gappy_events(spark, folder), scratch_path(spark, "cleaned"))
    return rounds(described, 4)


_NAMES = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linestatus", "l_shipdate", "price_copy", "returnflag_copy")


@query(
    "match_rates",
    f"WITH {LEAKY_SQL} "
    + per_column(
        [c for c in _NAMES if c != "l_shipdate"],
        "SELECT '{c}' AS feature, count(*) FILTER ({c} IS NOT NULL AND l_returnflag IS NOT NULL) AS pairs, "
        "round(avg(({c}::VARCHAR = l_returnflag)::INT), 6) + 0.0 AS match_rate FROM leaky",
    ),
)
def match_rates(spark, folder):
    return rounds(L.match_rates(leaky_lines(spark, folder).drop("l_shipdate"), "l_returnflag"))


def _corr(c, y, source):
    a, b = f"{c}::DOUBLE", f"{y}::DOUBLE"
    both = f"{c} IS NOT NULL AND {y} IS NOT NULL"
    return f"coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) FILTER ({both}) * stddev_pop({b}) FILTER ({both}), 0), 0)"


@query(
    "target_correlations",
    f"WITH {LEAKY_SQL} "
    + per_column(
        [c for c in (*LINE_NUMERIC, "price_copy") if c != "l_extendedprice"],
        "SELECT '{c}' AS feature, round(" + _corr("{c}", "l_extendedprice", "leaky") + ", 6) + 0.0 AS correlation FROM leaky",
    ),
)
def target_correlations(spark, folder):
    return rounds(L.target_correlations(leaky_lines(spark, folder), "l_extendedprice"))


def _leak_sql(target, columns, numeric):
    tokens = [t for t in target.lower().replace("_", " ").split() if len(t) >= 3]
    rows = []
    for c in columns:
        overlap = any(t in c.lower() for t in tokens)
        strong = f"abs({_corr(c, target, 'leaky')}) >= 0.98" if c in numeric and target in numeric else "false"
        match = f"coalesce(avg(({c}::VARCHAR = {target}::VARCHAR)::INT) >= 0.98, false)"
        rows.append(f"SELECT '{c}' AS feature, {str(overlap).lower()} AS o, {match} AS m, {strong} AS s FROM leaky")
    return (
        f"WITH {LEAKY_SQL}, x AS (" + " UNION ALL ".join(rows) + "), y AS (SELECT feature, round(least(1.0, o::INT * 0.2 + m::INT * 0.9 + s::INT * 0.8)::DOUBLE, 4) AS risk_score, "
        "concat_ws(',', CASE WHEN o THEN 'name_overlap' END, CASE WHEN m THEN 'equals_target' END, CASE WHEN s THEN 'correlates_with_target' END) AS reasons FROM x) "
        "SELECT * FROM y WHERE risk_score > 0 ORDER BY risk_score DESC, feature LIMIT 20"
    )


@query("leakage_text_target", _leak_sql("l_returnflag", [c for c in (*_NAMES,) if c != "l_shipdate"], ()))
def leakage_text_target(spark, folder):
    out = L.leakage_ranking(leaky_lines(spark, folder), "l_returnflag")
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "leakage_numeric_target",
    _leak_sql("l_extendedprice", [c for c in (*_NAMES, "l_returnflag") if c not in ("l_shipdate", "l_extendedprice")], (*LINE_NUMERIC, "price_copy")),
)
def leakage_numeric_target(spark, folder):
    out = L.leakage_ranking(leaky_lines(spark, folder), "l_extendedprice")
    return out.withColumn("reasons", F.array_join("reasons", ","))


@query(
    "drift_baseline_numeric",
    f"WITH {GAPPY_SQL} "
    + per_column(
        [c for c in LINE_NUMERIC if c != "l_tax"],
        "SELECT '{c}' AS feature, round(avg({c}), 4) + 0.0 AS mean, round(stddev_samp({c}), 4) + 0.0 AS std, round(quantile_cont({c}::DOUBLE, 0.05), 4) + 0.0 AS q05, "
        "round(quantile_cont({c}::DOUBLE, 0.5), 4) + 0.0 AS q50, round(quantile_cont({c}::DOUBLE, 0.95), 4) + 0.0 AS q95, "
        "round((count(*) - count({c})) / count(*), 4) + 0.0 AS missing_rate FROM gappy",
    ),
)
def drift_baseline_numeric(spark, folder):
    return rounds(D.numeric_baseline(gappy_lines(spark, folder), "l_tax"), 4)


@query(
    "drift_baseline_categorical",
    f"WITH {GAPPY_SQL}, c AS ("
    + per_column(
        ("l_returnflag", "l_linestatus"),
        "SELECT '{c}' AS feature, coalesce({c}, '<missing>') AS value, count(*) AS n, (SELECT round(avg(({c} IS NULL)::INT), 6) FROM gappy) AS missing_rate "
        "FROM gappy GROUP BY 2",
    )
    + "), k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY n DESC, value)::INTEGER AS rank, sum(n) OVER (PARTITION BY feature) AS total FROM c) "
    "SELECT feature, rank, value, round(n / total, 6) + 0.0 AS rate, missing_rate + 0.0 AS missing_rate FROM k WHERE rank <= 10",
)
def drift_baseline_categorical(spark, folder):
    return rounds(D.categorical_baseline(gappy_lines(spark, folder).drop("l_shipdate"), "l_tax"))


_SHIFT = per_column(
    LINE_NUMERIC,
    "SELECT '{c}' AS feature, avg({c}) FILTER (l_shipdate < TIMESTAMP '1998-06-01') AS train_mean, avg({c}) FILTER (l_shipdate >= TIMESTAMP '1998-06-01') AS current_mean, "
    "round(abs(avg({c}) FILTER (l_shipdate >= TIMESTAMP '1998-06-01') - avg({c}) FILTER (l_shipdate < TIMESTAMP '1998-06-01')) / "
    "CASE WHEN stddev_samp({c}) FILTER (l_shipdate < TIMESTAMP '1998-06-01') > 1e-9 THEN stddev_samp({c}) FILTER (l_shipdate < TIMESTAMP '1998-06-01') ELSE 1 END, 4) + 0.0 AS z_drift "
    "FROM lineitem",
)


def shipped_halves(spark, folder):
    li = read(spark, folder, "lineitem")
    cut = F.lit("1998-06-01").cast("timestamp")
    return li.filter(F.col("l_shipdate") < cut), li.filter(F.col("l_shipdate") >= cut)


@query("mean_shift", f"SELECT feature, round(train_mean, 4) + 0.0 AS train_mean, round(current_mean, 4) + 0.0 AS current_mean, z_drift FROM ({_SHIFT})")
def mean_shift(spark, folder):
    return rounds(D.mean_shift(*shipped_halves(spark, folder)), 4)


@query(
    "drift_summary",
    f"SELECT count(*) AS features_compared, round(avg(z_drift), 4) + 0.0 AS avg_z_drift, "
    f"CASE WHEN avg(z_drift) < 0.5 THEN 'low' WHEN avg(z_drift) < 1 THEN 'medium' ELSE 'high' END AS drift_level FROM ({_SHIFT})",
)
def drift_summary(spark, folder):
    return D.drift_summary(D.mean_shift(*shipped_halves(spark, folder)))


@query("top_drift", f"SELECT feature, z_drift FROM ({_SHIFT}) ORDER BY z_drift DESC, feature LIMIT 3")
def top_drift(spark, folder):
    return D.top_drift(D.mean_shift(*shipped_halves(spark, folder)), 3).select("feature", "z_drift")


@query("complete_pairs", f"WITH {LABELLED_SQL} SELECT n_chars, quality FROM labelled WHERE quality IS NOT NULL AND n_chars IS NOT NULL")
def complete_pairs_query(spark, folder):
    return complete_pairs(labelled_documents(spark, folder), "n_chars", "quality")


@query("drop_missing_target", f"WITH {LABELLED_SQL} SELECT doc_id, lang, quality FROM labelled WHERE quality IS NOT NULL")
def drop_missing_target(spark, folder):
    return labelled_documents(spark, folder).na.drop(subset=["quality"]).select("doc_id", "lang", "quality")
