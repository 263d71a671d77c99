"""Profiles of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import profile as P
from plumbline.operators import stats as S
from plumbline.queries.base import (
    GAPPY_SQL,
    LINE_KEY,
    LINE_NUMERIC,
    LINEITEM,
    gappy_lines,
    labelled_documents,
    per_column,
    query,
    r,
    read,
    rounds,
)

TEXTS = ("l_returnflag", "l_linestatus")
SUMMARY = ("mean", "std", "min", "q1", "median", "q3", "max")


def _summary_sql(columns, source):
    return per_column(
        columns,
        "SELECT '{c}' AS \"column\", count({c}) AS count, "
        + ", ".join(
            f"{r(e, 4)} AS {n}"
            for e, n in (
                ("avg({c})", "mean"), ("stddev_samp({c})", "std"), ("min({c})::DOUBLE", "min"),
                ("quantile_cont({c}::DOUBLE, 0.25)", "q1"), ("quantile_cont({c}::DOUBLE, 0.5)", "median"),
                ("quantile_cont({c}::DOUBLE, 0.75)", "q3"), ("max({c})::DOUBLE", "max"),
            )
        )
        + f" FROM {source}",
    )


@query("numeric_summary", _summary_sql(LINE_NUMERIC, "lineitem"))
def numeric_summary(spark, folder):
    return rounds(S.numeric_summary(read(spark, folder, "lineitem")), 4)


@query("numeric_summary_with_gaps", f"WITH {GAPPY_SQL} " + _summary_sql(LINE_NUMERIC, "gappy"))
def numeric_summary_with_gaps(spark, folder):
    return rounds(S.numeric_summary(gappy_lines(spark, folder)), 4)


@query("table_shape", "SELECT count(*) AS rows, 11::INTEGER AS columns FROM lineitem")
def table_shape(spark, folder):
    return P.table_shape(read(spark, folder, "lineitem"))


_MISSING = per_column(
    LINEITEM,
    "SELECT '{c}' AS \"column\", {i}::INTEGER AS position, count(*) - count({c}) AS missing, count(*) AS rows, "
    "round((count(*) - count({c})) / greatest(count(*), 1), 6) + 0.0 AS missing_rate FROM gappy",
)


@query("missing_rates", f"WITH {GAPPY_SQL} {_MISSING}")
def missing_rates(spark, folder):
    return rounds(P.missing_rates(gappy_lines(spark, folder)))


@query(
    "missing_cells",
    f"WITH {GAPPY_SQL}, m AS ({_MISSING}) SELECT sum(missing)::BIGINT AS missing_cells, "
    "round(sum(missing) / (max(rows) * 11), 8) AS missing_rate FROM m",
)
def missing_cells(spark, folder):
    return P.missing_overview(gappy_lines(spark, folder))


@query(
    "missing_only_columns",
    f"WITH {GAPPY_SQL}, m AS ({_MISSING}) SELECT \"column\", missing FROM m WHERE missing > 0",
)
def missing_only_columns(spark, folder):
    return S.missing_counts(gappy_lines(spark, folder)).filter("missing > 0").select("column", "missing")


@query(
    "missing_ranking",
    f"WITH {GAPPY_SQL}, m AS ({_MISSING}) SELECT \"column\", missing FROM m ORDER BY missing DESC, \"column\" LIMIT 20",
)
def missing_ranking(spark, folder):
    return P.missing_ranking(gappy_lines(spark, folder), 20)


@query(
    "duplicate_rows",
    "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem)) "
    "AS duplicates FROM lineitem",
)
def duplicate_rows(spark, folder):
    return S.duplicate_rows(read(spark, folder, "lineitem"), ("l_returnflag", "l_linestatus", "l_quantity"))


@query(
    "duplicate_documents",
    "SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicates FROM documents",
)
def duplicate_documents(spark, folder):
    return S.duplicate_rows(read(spark, folder, "documents"), ("text", "lang"))


@query(
    "unique_rates",
    f"WITH {GAPPY_SQL} "
    + per_column(
        LINEITEM,
        "SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS \"distinct\", "
        "round(count(DISTINCT {c}) / greatest(count(*), 1), 6) + 0.0 AS unique_rate FROM gappy",
    ),
)
def unique_rates(spark, folder):
    return rounds(P.unique_rates(gappy_lines(spark, folder)))


_SAMPLES = (
    "(SELECT string_agg(v, ',' ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber) FROM (SELECT {c}::VARCHAR AS v, "
    "l_orderkey, l_partkey, l_suppkey, l_linenumber FROM gappy WHERE {c} IS NOT NULL "
    "ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 5))"
)


@query(
    "column_catalog",
    f"WITH {GAPPY_SQL} "
    + per_column(
        LINEITEM,
        "SELECT '{c}' AS \"column\", {i}::INTEGER AS position, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", "
        + _SAMPLES
        + " AS samples, {{STATS_{c}}} FROM gappy",
    ),
)
def column_catalog(spark, folder):
    out = P.column_catalog(gappy_lines(spark, folder), LINE_KEY).drop("dtype")
    return rounds(out.withColumn("samples", F.array_join("samples", ",")), 4)


def _stats_sql(c):
    pairs = (("min", f"min({c})::DOUBLE"), ("max", f"max({c})::DOUBLE"), ("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("median", f"quantile_cont({c}::DOUBLE, 0.5)"))
    if c in LINE_NUMERIC:
        return ", ".join(f"{r(e, 4)} AS {n}" for n, e in pairs)
    return ", ".join(f"NULL::DOUBLE AS {n}" for n, _ in pairs)


def _fill_stats(name):
    from plumbline.queries.base import ORACLES

    sql = ORACLES[name]
    for c in LINEITEM:
        sql = sql.replace("{STATS_%s}" % c, _stats_sql(c))
    ORACLES[name] = sql


_fill_stats("column_catalog")

_HIST = """
  SELECT '{c}' AS "column", g.bin::INTEGER AS bin, lo + (hi - lo) / k * g.bin AS low,
    CASE WHEN g.bin = k - 1 THEN hi ELSE lo + (hi - lo) / k * (g.bin + 1) END AS high, coalesce(h.n, 0)::BIGINT AS n
  FROM (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, {k} AS k FROM {source}) f, LATERAL (SELECT unnest(range(k)) AS bin) g
  LEFT JOIN (SELECT least(floor(({c} - lo) / (hi - lo) * k), k - 1) AS bin, count(*) AS n
    FROM {source}, (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi, {k} AS k FROM {source}) WHERE {c} IS NOT NULL GROUP BY 1) h
  ON h.bin = g.bin"""


def short(e, digits=4):
    return f"regexp_replace(printf('%.{digits}f', round({e}, {digits}) + 0.0), '0{{1,{digits - 1}}}$', '')"


def hist_sql(columns, k, source, ctes=""):
    parts = "\nUNION ALL\n".join(_HIST.format(c=c, k=k, source=source) for c in columns)
    head = f"WITH {ctes + ', ' if ctes else ''}h AS ({parts}) "
    return head + f'SELECT "column", bin, {r("low")} AS low, {r("high")} AS high, n, {short("low")} || \' to \' || {short("high")} AS label FROM h'


HIST_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount")


@query("histogram", hist_sql(HIST_COLUMNS, 20, "gappy", GAPPY_SQL))
def histogram(spark, folder):
    return rounds(S.histogram_table(gappy_lines(spark, folder), HIST_COLUMNS))


@query("feature_histograms", hist_sql(("l_linenumber", "l_quantity", "l_extendedprice", "l_discount"), 15, "lineitem"))
def feature_histograms(spark, folder):
    li = read(spark, folder, "lineitem").drop("l_orderkey", "l_partkey", "l_suppkey")
    return rounds(P.feature_histograms(li, "l_tax"))


@query(
    "target_histogram",
    hist_sql(("o_totalprice",), "(SELECT least(greatest(count(o_totalprice) // 50, 8), 25) FROM orders)", "orders"),
)
def target_histogram(spark, folder):
    return rounds(P.target_histogram(read(spark, folder, "orders"), "o_totalprice"))


def top_sql(columns, source, k, ctes="", extra="", cast="{c}"):
    counts = per_column(columns, f"SELECT '{{c}}' AS \"column\", coalesce(({cast})::VARCHAR, '<missing>') AS value, count(*) AS n FROM {source} GROUP BY ALL")
    return (
        f"WITH {ctes + ', ' if ctes else ''}c AS ({counts}), k AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value)::INTEGER AS rank, "
        f"sum(n) OVER (PARTITION BY \"column\") AS total FROM c) SELECT \"column\", rank, value{extra or ', n'} FROM k WHERE rank <= {k}"
    )


@query("top_values", top_sql(TEXTS, "gappy", 20, GAPPY_SQL))
def top_values(spark, folder):
    return P.top_values(gappy_lines(spark, folder), TEXTS)


@query("top_values_customers", top_sql(("c_name", "c_mktsegment"), "customer", 20))
def top_values_customers(spark, folder):
    return P.top_values(read(spark, folder, "customer"))


@query("top_value_rates", top_sql(TEXTS, "gappy", 10, GAPPY_SQL, ", round(n / total, 6) + 0.0 AS rate"))
def top_value_rates(spark, folder):
    return rounds(P.top_value_rates(gappy_lines(spark, folder), TEXTS))


@query(
    "class_distribution",
    "SELECT coalesce(quality::VARCHAR, '<missing>') AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, label)::INTEGER AS rank "
    "FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
)
def class_distribution(spark, folder):
    return P.class_distribution(labelled_documents(spark, folder), "quality")


@query(
    "target_distribution_numeric",
    hist_sql(("l_quantity",), 20, "lineitem").replace('SELECT "column", bin, ', "SELECT 'numeric' AS kind, bin AS position, label, n FROM (SELECT bin, ")
    + ")",
)
def target_distribution_numeric(spark, folder):
    return P.target_distribution(read(spark, folder, "lineitem"), "l_quantity")


@query(
    "target_distribution_text",
    "SELECT 'categorical' AS kind, (row_number() OVER (ORDER BY count(*) DESC, o_orderpriority) - 1)::INTEGER AS position, "
    "o_orderpriority AS label, count(*) AS n FROM orders GROUP BY o_orderpriority",
)
def target_distribution_text(spark, folder):
    return P.target_distribution(read(spark, folder, "orders"), "o_orderpriority")


DATED_SQL = """dated AS (SELECT event_id, event_type, value, strftime(ts, '%Y-%m-%d') AS day_text, value > 50 AS big, ts, props FROM events)"""


def dated_events(spark, folder):
    ev = read(spark, folder, "events")
    return ev.select(
        "event_id", "event_type", "value", F.date_format("ts", "yyyy-MM-dd").alias("day_text"), (F.col("value") > 50).alias("big"), "ts", "props"
    )


DATED = {"event_id": "numeric", "event_type": "categorical", "value": "numeric", "day_text": "categorical", "big": "boolean", "ts": "datetime", "props": "categorical"}


def _semantic_sql():
    rows = []
    for i, (c, g) in enumerate(DATED.items()):
        share = {"datetime": "1.0::DOUBLE", "categorical": f"coalesce(avg((try_cast({c} AS TIMESTAMP) IS NOT NULL)::INT) FILTER ({c} IS NOT NULL), 0)"}.get(g, "0.0::DOUBLE")
        rows.append(
            f"SELECT '{c}' AS \"column\", {i}::INTEGER AS position, '{g}' AS dtype_group, count(DISTINCT {c}) AS \"distinct\", "
            f"count(DISTINCT {c}) / greatest(count(*), 1) AS unique_rate, round({share}, 4) AS date_share FROM dated"
        )
    return (
        f"WITH {DATED_SQL}, s AS (" + " UNION ALL ".join(rows) + ") SELECT \"column\", position, dtype_group, \"distinct\", round(unique_rate, 6) + 0.0 AS unique_rate, "
        "date_share + 0.0 AS date_share, CASE WHEN dtype_group = 'numeric' THEN CASE WHEN unique_rate > 0.1 THEN 'continuous' ELSE 'ordinal_numeric' END "
        "WHEN dtype_group IN ('datetime', 'boolean') THEN dtype_group WHEN date_share >= 0.8 THEN 'datetime_like' "
        "WHEN \"distinct\" <= 20 THEN 'ordinal_or_nominal_low_cardinality' ELSE 'nominal' END AS semantic_type FROM s"
    )


@query("semantic_types", _semantic_sql())
def semantic_types(spark, folder):
    return rounds(P.semantic_types(dated_events(spark, folder)))


@query(
    "date_share",
    f"WITH {DATED_SQL} "
    + per_column(
        ("event_type", "day_text", "props"),
        "SELECT '{c}' AS \"column\", round(avg((try_cast({c} AS TIMESTAMP) IS NOT NULL)::INT), 6) AS date_share FROM dated",
    ),
)
def date_share(spark, folder):
    return rounds(P.date_shares(dated_events(spark, folder)))


@query(
    "typing_tally",
    f"WITH sem AS ({_semantic_sql()}) SELECT sum((dtype_group = 'numeric')::INT)::BIGINT AS numeric, sum((dtype_group = 'categorical')::INT)::BIGINT AS categorical, "
    "sum((dtype_group = 'datetime' OR semantic_type = 'datetime_like')::INT)::BIGINT AS datetime, sum((dtype_group = 'boolean')::INT)::BIGINT AS boolean, "
    "coalesce(string_agg(\"column\", ',' ORDER BY position) FILTER (dtype_group = 'categorical' AND unique_rate > 0.3), '') AS high_cardinality FROM sem",
)
def typing_tally(spark, folder):
    return P.typing_tally(dated_events(spark, folder)).withColumn("high_cardinality", F.array_join("high_cardinality", ","))


_PROFILE = per_column(
    LINEITEM,
    "SELECT '{c}' AS \"column\", {i}::INTEGER AS position, '{{GROUP_{c}}}' AS dtype_group, count(*) - count({c}) AS missing, "
    "round((count(*) - count({c})) / count(*), 6) + 0.0 AS missing_rate, count(DISTINCT {c}) AS \"distinct\", "
    "round(count(DISTINCT {c}) / count(*), 6) + 0.0 AS unique_rate, {{SHARE_{c}}} AS date_share, " + _SAMPLES + " AS samples, {{FULL_{c}}} FROM gappy",
)


def _profile_sql():
    sql = _PROFILE
    for c in LINEITEM:
        group = "numeric" if c in LINE_NUMERIC else "datetime" if c == "l_shipdate" else "categorical"
        exprs = (("mean", f"avg({c})"), ("std", f"stddev_samp({c})"), ("min", f"min({c})::DOUBLE"), ("q1", f"quantile_cont({c}::DOUBLE, 0.25)"),
                 ("median", f"quantile_cont({c}::DOUBLE, 0.5)"), ("q3", f"quantile_cont({c}::DOUBLE, 0.75)"), ("max", f"max({c})::DOUBLE"))
        full = ", ".join(f"{r(e, 4)} AS {n}" if c in LINE_NUMERIC else f"NULL::DOUBLE AS {n}" for n, e in exprs)
        sql = sql.replace("{GROUP_%s}" % c, group).replace("{SHARE_%s}" % c, "1.0::DOUBLE" if group == "datetime" else "0.0::DOUBLE").replace("{FULL_%s}" % c, full)
    return (
        f"WITH {GAPPY_SQL}, p AS ({sql}) SELECT *, CASE WHEN dtype_group = 'numeric' THEN CASE WHEN unique_rate > 0.1 THEN 'continuous' ELSE 'ordinal_numeric' END "
        "WHEN dtype_group = 'datetime' THEN 'datetime' WHEN \"distinct\" <= 20 THEN 'ordinal_or_nominal_low_cardinality' ELSE 'nominal' END AS semantic_type FROM p"
    )


@query("column_profile", _profile_sql())
def column_profile(spark, folder):
    out = P.column_profile(gappy_lines(spark, folder), LINE_KEY).drop("dtype")
    return rounds(out.withColumn("samples", F.array_join("samples", ",")), 4, *SUMMARY).transform(rounds, 6, "missing_rate", "unique_rate")


@query(
    "table_bytes",
    "SELECT (count(*) * 68 + sum(strlen(l_returnflag)) + sum(strlen(l_linestatus)))::BIGINT AS bytes FROM lineitem",
)
def table_bytes(spark, folder):
    return P.table_bytes(read(spark, folder, "lineitem"))


@query(
    "summary_cards",
    f"WITH {GAPPY_SQL}, c AS (SELECT l_quantity, l_discount, l_returnflag, l_linestatus FROM gappy), "
    "s AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT DISTINCT * FROM c)) AS d, "
    "sum((l_discount IS NULL)::INT + (l_returnflag IS NULL)::INT) AS m, sum(16 + coalesce(strlen(l_returnflag), 0) + strlen(l_linestatus)) AS b FROM c) "
    "SELECT 'rows' AS label, n::DOUBLE AS value FROM s UNION ALL SELECT 'columns', 4.0 FROM s UNION ALL SELECT 'missing_cells', m FROM s "
    "UNION ALL SELECT 'missing_rate_percent', round(m / (n * 4) * 100, 2) FROM s UNION ALL SELECT 'duplicate_rows', n - d FROM s "
    "UNION ALL SELECT 'size_mb', round(b / 1048576, 2) FROM s",
)
def summary_cards(spark, folder):
    return P.summary_cards(gappy_lines(spark, folder).select("l_quantity", "l_discount", "l_returnflag", "l_linestatus"))


@query(
    "unique_density",
    per_column(
        [c for c in LINEITEM if c != "l_quantity"],
        "SELECT '{c}' AS feature, count(DISTINCT {c}) AS unique_values, round(count(DISTINCT {c}) / count(*), 6) + 0.0 AS unique_ratio FROM lineitem",
    ),
)
def unique_density(spark, folder):
    return P.unique_density(read(spark, folder, "lineitem"), "l_quantity")


@query(
    "numeric_skewness",
    per_column(LINE_NUMERIC, "SELECT '{c}' AS feature, round(coalesce(skewness({c}), 0), 4) + 0.0 AS skewness FROM gappy").join([f"WITH {GAPPY_SQL} ", ""]),
)
def numeric_skewness(spark, folder):
    out = S.moment_profile(gappy_lines(spark, folder)).filter(F.col("skewness").isNotNull())
    return rounds(out.select(F.col("column").alias("feature"), "skewness"), 4)


@query(
    "numeric_variance",
    per_column(LINE_NUMERIC, "SELECT '{c}' AS feature, round(var_pop({c}), 2) + 0.0 AS variance FROM lineitem"),
)
def numeric_variance(spark, folder):
    out = S.moment_profile(read(spark, folder, "lineitem")).filter(F.col("variance").isNotNull())
    return rounds(out.select(F.col("column").alias("feature"), "variance"), 2)


@query(
    "categorical_concentration",
    f"WITH {GAPPY_SQL} "
    + per_column(
        ("l_returnflag", "l_linestatus", "l_shipdate"),
        "SELECT '{c}' AS feature, round(max(n) / sum(n), 6) + 0.0 AS top_category_share, count(*) AS distinct_categories, sum(n)::BIGINT AS non_null_rows "
        "FROM (SELECT {c}, count(*) AS n FROM gappy WHERE {c} IS NOT NULL GROUP BY 1)",
    ),
)
def categorical_concentration(spark, folder):
    return P.categorical_concentration(gappy_lines(spark, folder), "l_tax")


@query(
    "preview",
    f"WITH {GAPPY_SQL} SELECT coalesce(l_orderkey::VARCHAR, '') AS l_orderkey, coalesce(l_quantity::VARCHAR, '') AS l_quantity, "
    "coalesce(l_discount::VARCHAR, '') AS l_discount, coalesce(l_returnflag, '') AS l_returnflag FROM gappy ORDER BY gappy.l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 10",
)
def preview(spark, folder):
    return P.preview(gappy_lines(spark, folder), LINE_KEY).select("l_orderkey", "l_quantity", "l_discount", "l_returnflag")
