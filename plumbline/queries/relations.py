"""Feature-to-target relations and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import expr as X
from plumbline.functions import typing as T
from plumbline.operators import relations as R
from plumbline.operators import stats as S
from plumbline.operators.quantiles import group_quantiles, quantiles_in_two_scans
from plumbline.queries.base import GAPPY_SQL, LABELLED_SQL, LINE_KEY, LINE_NUMERIC, gappy_lines, labelled_documents, per_column, query, read, rounds
from plumbline.queries.quality import _corr

PAIR_COLUMNS = ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "price_copy")
_PAIRS_SQL = f"WITH {GAPPY_SQL}, t AS (SELECT *, l_extendedprice * 2 AS price_copy FROM gappy), c AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round({_corr(a, b, 't')}, 6) + 0.0 AS correlation FROM t"
    for i, a in enumerate(PAIR_COLUMNS)
    for b in PAIR_COLUMNS[i + 1 :]
) + ")"


def pair_input(spark, folder):
    return gappy_lines(spark, folder).withColumn("price_copy", F.col("l_extendedprice") * 2).select(*PAIR_COLUMNS)


@query("correlations", f"{_PAIRS_SQL} SELECT * FROM c")
def correlations(spark, folder):
    return rounds(S.correlation_pairs(pair_input(spark, folder)))


@query(
    "correlation_matrix",
    f"{_PAIRS_SQL} SELECT * FROM c UNION ALL SELECT feature_b, feature_a, correlation FROM c UNION ALL "
    + " UNION ALL ".join(f"SELECT '{c}', '{c}', 1.0" for c in PAIR_COLUMNS),
)
def correlation_matrix(spark, folder):
    return rounds(S.correlation_matrix(pair_input(spark, folder)))


@query("correlations_wide_table", f"{_PAIRS_SQL} SELECT * FROM c")
def correlations_wide_table(spark, folder):
    """The matrix-product form that wide tables use, forced."""
    df = T.normalised(pair_input(spark, folder))
    pairs = [(a, b) for i, a in enumerate(PAIR_COLUMNS) for b in PAIR_COLUMNS[i + 1 :]]
    return rounds(S._pair_matrix(df, list(PAIR_COLUMNS), pairs))


@query("high_correlations", f"{_PAIRS_SQL} SELECT * FROM c WHERE abs(correlation) >= 0.75 ORDER BY abs(correlation) DESC, feature_a, feature_b LIMIT 30")
def high_correlations(spark, folder):
    return rounds(S.high_correlations(pair_input(spark, folder)))


@query(
    "quartiles_by_class",
    "SELECT l_returnflag AS class, quantile_cont(l_extendedprice, 0.25) + 0.0 AS q1, quantile_cont(l_extendedprice, 0.5) + 0.0 AS median, "
    "quantile_cont(l_extendedprice, 0.75) + 0.0 AS q3 FROM lineitem GROUP BY 1",
)
def quartiles_by_class(spark, folder):
    return R.quartiles_by_class(read(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice")


@query(
    "quartiles_by_class_selected",
    "SELECT l_returnflag AS class, round(quantile_cont(l_extendedprice, 0.25), 6) + 0.0 AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) + 0.0 AS median, "
    "round(quantile_cont(l_extendedprice, 0.75), 6) + 0.0 AS q3 FROM lineitem GROUP BY 1",
)
def quartiles_by_class_selected(spark, folder):
    """The rank-selection form that large tables use, forced."""
    from plumbline.operators.quantiles import quantiles_by_selection

    cells = read(spark, folder, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("value"))
    got = quantiles_by_selection(cells, (0.25, 0.5, 0.75), finish_rows=500, width=32)
    return rounds(spark.createDataFrame([(g, *q) for g, q in got.items()], "class string, q1 double, median double, q3 double"))


@query(
    "quartiles_of_many_groups",
    "SELECT o_custkey::VARCHAR AS grp, round(quantile_cont(o_totalprice, 0.25), 6) + 0.0 AS q1, round(quantile_cont(o_totalprice, 0.5), 6) + 0.0 AS median, "
    "round(quantile_cont(o_totalprice, 0.75), 6) + 0.0 AS q3 FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL GROUP BY 1",
)
def quartiles_of_many_groups(spark, folder):
    """One group a customer, by running totals on the executors."""
    got = group_quantiles(read(spark, folder, "orders"), "o_custkey", "o_totalprice", S.QUARTILES, small=False, buckets=4)
    return rounds(got.select("grp", *[F.col("q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))]))


@query(
    "quantiles_in_two_scans",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(quantile_cont({c}::DOUBLE, 0.05), 6) + 0.0 AS low, round(quantile_cont({c}::DOUBLE, 0.5), 6) + 0.0 AS median, "
        f"round(quantile_cont({c}::DOUBLE, 0.95), 6) + 0.0 AS high FROM lineitem"
        for c in LINE_NUMERIC
    ),
)
def quantiles_of_brackets(spark, folder):
    """The sketch-and-bracket form that large tables use, forced."""
    _, got, _ = quantiles_in_two_scans(T.normalised(read(spark, folder, "lineitem")), LINE_NUMERIC, (0.05, 0.5, 0.95))
    return rounds(spark.createDataFrame([(c, *q) for c, q in got.items()], "column string, low double, median double, high double"))


@query("top_category_rows", "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 8)")
def top_category_rows(spark, folder):
    return R.keep_top_categories(read(spark, folder, "documents"), "source", 8).select("doc_id", "source")


_RATES = (
    f"WITH {LABELLED_SQL}, p AS (SELECT source AS category, quality::VARCHAR AS class FROM labelled WHERE source IS NOT NULL AND quality IS NOT NULL), "
    "t AS (SELECT category, count(*) AS total FROM p GROUP BY 1 ORDER BY total DESC, category LIMIT 8)"
)


@query("class_rates", f"{_RATES} SELECT category, class, total, round(count(*) / total, 6) + 0.0 AS rate FROM p JOIN t USING (category) GROUP BY category, class, total")
def class_rates(spark, folder):
    return rounds(R.class_rates_by_category(labelled_documents(spark, folder), "quality", "source"))


@query(
    "class_rates_wide",
    f"{_RATES} SELECT category, total, round(nullif(count(*) FILTER (class = '0'), 0) / total, 6) AS rate_0, "
    "round(nullif(count(*) FILTER (class = '1'), 0) / total, 6) AS rate_1 FROM p JOIN t USING (category) GROUP BY category, total",
)
def class_rates_wide(spark, folder):
    return rounds(R.class_rates_wide(labelled_documents(spark, folder), "quality", ("0", "1"), "source"))


@query("mean_target_by_category", "SELECT o_orderpriority AS category, round(avg(o_totalprice), 4) AS target_mean FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 12")
def mean_target_by_category(spark, folder):
    return rounds(R.mean_target_by_category(read(spark, folder, "orders"), "o_totalprice", "o_orderpriority"), 4)


@query(
    "pair_sample",
    f"WITH {GAPPY_SQL} SELECT l_quantity AS x, l_discount AS y, l_returnflag AS \"group\" FROM gappy WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL "
    f"AND l_returnflag IS NOT NULL ORDER BY md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)) LIMIT 800",
)
def pair_sample(spark, folder):
    return R.pair_sample(gappy_lines(spark, folder), "l_returnflag", LINE_KEY, ("l_quantity", "l_discount"))


@query(
    "target_sample",
    f"WITH {GAPPY_SQL} SELECT l_discount AS x, l_extendedprice AS y FROM gappy WHERE l_discount IS NOT NULL ORDER BY md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber)) LIMIT 1200",
)
def target_sample(spark, folder):
    return R.target_sample(gappy_lines(spark, folder), "l_extendedprice", LINE_KEY, "l_discount")


def _decile(c, source, where="true"):
    cuts = ", ".join(f"{i / 10}" for i in range(1, 10))
    return f"(SELECT list_distinct(quantile_cont({c}::DOUBLE, [{cuts}])) FROM {source} WHERE {where})"


def _mi_sql(source_cte, table, numeric, texts, y, where):
    """Joint counts per feature and bin, then the information sum; text levels become indicators."""
    rows = f"base AS (SELECT * FROM {table} WHERE {where})"
    cells = [
        f"SELECT '{c}' AS feature, len(list_filter({_decile(c, 'base')}, lambda q: q < b.{c}))::VARCHAR AS x, {y} AS y FROM base b" for c in numeric
    ]
    for c in texts:
        levels = f"(SELECT DISTINCT {c} AS lv FROM {table} WHERE {c} IS NOT NULL ORDER BY 1 OFFSET 1)"
        cells.append(f"SELECT '{c}_' || lv AS feature, (coalesce(b.{c}, '') = lv)::VARCHAR AS x, {y} AS y FROM base b, {levels}")
    return (
        f"WITH {source_cte}, {rows}, cells AS ({' UNION ALL '.join(cells)}), j AS (SELECT feature, x, y, count(*) AS nxy FROM cells GROUP BY ALL), "
        "s AS (SELECT *, sum(nxy) OVER (PARTITION BY feature) AS n, sum(nxy) OVER (PARTITION BY feature, x) AS nx, sum(nxy) OVER (PARTITION BY feature, y) AS ny FROM j), "
        "m AS (SELECT feature, greatest(sum(nxy / n * ln(nxy * n / (nx::DOUBLE * ny))), 0) AS score FROM s GROUP BY 1) "
        "SELECT feature, round(score, 6) + 0.0 AS score FROM m ORDER BY round(score, 9) DESC, feature LIMIT 15"
    )


@query(
    "mutual_information_classes",
    _mi_sql(GAPPY_SQL, "gappy", ("l_linenumber", "l_quantity", "l_extendedprice", "l_discount"), ("l_returnflag",), "l_linestatus", "l_discount IS NOT NULL"),
)
def mutual_information_classes(spark, folder):
    df = gappy_lines(spark, folder).select("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    return rounds(R.mutual_information(df, "l_linestatus", "classification"))


@query(
    "mutual_information_regression",
    _mi_sql(
        "li AS (SELECT l_linenumber, l_quantity, l_tax + 0 AS l_tax, l_returnflag, l_linestatus, l_extendedprice FROM lineitem)",
        "li",
        ("l_linenumber", "l_quantity", "l_tax"),
        ("l_returnflag", "l_linestatus"),
        f"len(list_filter({_decile('l_extendedprice', 'li')}, lambda q: q < b.l_extendedprice))::VARCHAR",
        "true",
    ),
)
def mutual_information_regression(spark, folder):
    df = read(spark, folder, "lineitem").select("l_linenumber", "l_quantity", "l_tax", "l_returnflag", "l_linestatus", "l_extendedprice")
    return rounds(R.mutual_information(df, "l_extendedprice", "regression"))


# ---- scalar rules over whole tables -------------------------------------------------


@query(
    "text_functions",
    "SELECT p_partkey, lower(p_brand) AS low, array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda t: length(t) >= 3), '|') AS tokens, "
    "contains(lower(p_name), 'ring') AS has_ring, replace(p_brand, '#', '_') AS brand, printf('%.2f', p_retailprice) AS price_text FROM part",
)
def text_functions(spark, folder):
    return read(spark, folder, "part").select(
        "p_partkey",
        F.lower("p_brand").alias("low"),
        F.array_join(X.name_tokens("p_name", 3), "|").alias("tokens"),
        F.contains(F.lower("p_name"), F.lit("ring")).alias("has_ring"),
        F.replace("p_brand", F.lit("#"), F.lit("_")).alias("brand"),
        F.format_string("%.2f", "p_retailprice").alias("price_text"),
    )


@query(
    "number_functions",
    "SELECT o_orderkey, abs(o_totalprice - 200000) AS gap, floor(o_totalprice / 1000)::BIGINT AS low, ceil(o_totalprice / 1000)::BIGINT AS high, "
    "round(sqrt(o_totalprice), 6) AS root, round(log2(o_totalprice), 6) AS bits, greatest(50000, least(400000, o_totalprice)) AS clamped, "
    "abs(o_totalprice - round(o_totalprice)) <= 1e-9 AS whole, round(o_totalprice / nullif(o_orderkey, 0), 6) AS ratio, round((o_orderkey % 8) / 8.0::DOUBLE * 100, 1) AS pct FROM orders",
)
def number_functions(spark, folder):
    p = F.col("o_totalprice")
    return read(spark, folder, "orders").select(
        "o_orderkey",
        F.abs(p - 200000).alias("gap"),
        F.floor(p / 1000).alias("low"),
        F.ceil(p / 1000).alias("high"),
        F.round(F.sqrt(p), 6).alias("root"),
        F.round(F.log2(p), 6).alias("bits"),
        X.clamp(p, 50000.0, 400000.0).alias("clamped"),
        X.integer_like(p).alias("whole"),
        F.round(X.safe_divide(p, "o_orderkey"), 6).alias("ratio"),
        X.percent((F.col("o_orderkey") % 8) / F.lit(8.0)).alias("pct"),
    )


@query(
    "casts",
    "SELECT event_id, value::VARCHAR AS value_text, try_cast(json_extract_string(props, '$.k') AS DOUBLE) AS k, try_cast(event_type AS DOUBLE) AS not_a_number FROM events",
)
def casts(spark, folder):
    return read(spark, folder, "events").select(
        "event_id",
        F.col("value").cast("string").alias("value_text"),
        X.to_number(F.from_json("props", "k string")["k"]).alias("k"),
        X.to_number("event_type").alias("not_a_number"),
    )


@query(
    "json_round_trip",
    "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_object('event_type', event_type, 'k', json_extract_string(props, '$.k')::BIGINT)::VARCHAR AS document FROM events",
)
def json_round_trip(spark, folder):
    k = F.from_json("props", "k bigint")["k"]
    return read(spark, folder, "events").select("event_id", k.alias("k"), F.to_json(F.struct("event_type", k.alias("k"))).alias("document"))


@query(
    "non_finite_to_null",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_discount = 0 OR l_tax = 0 THEN NULL ELSE round(l_tax / l_discount, 6) + 0.0 END AS ratio FROM lineitem",
)
def non_finite_to_null(spark, folder):
    li = read(spark, folder, "lineitem")
    # 0/0 would be NaN and x/0 infinite: both, and log(0), must come out as null
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(
        F.try_divide(F.col("l_tax"), F.col("l_discount"))
    )
    nested = li.select(*LINE_KEY, F.struct(F.array(ratio).alias("values")).alias("nested"))
    return rounds(X.finite_frame(nested).select(*LINE_KEY, F.col("nested.values")[0].alias("ratio")))


@query("finite_rows", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0")
def finite_rows(spark, folder):
    li = read(spark, folder, "lineitem")
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return li.filter(X.is_finite(ratio)).select(*LINE_KEY)


@query("row_fingerprints", "SELECT c_custkey, substring(sha1(concat_ws('|', c_custkey::VARCHAR, c_name, c_mktsegment)), 1, 16) AS fingerprint FROM customer")
def row_fingerprints(spark, folder):
    return read(spark, folder, "customer").select("c_custkey", X.fingerprint(("c_custkey", "c_name", "c_mktsegment")).alias("fingerprint"))


@query(
    "map_functions",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(coalesce(l_discount, 0.5), 6) + 0.0 AS discount, l_quantity AS quantity, "
    "'base,discount,quantity' AS keys FROM gappy".join([f"WITH {GAPPY_SQL} ", ""]),
)
def map_functions(spark, folder):
    base = F.create_map(F.lit("discount"), F.lit(0.5), F.lit("base"), F.lit(1.0))
    over = F.create_map(F.lit("discount"), F.col("l_discount"), F.lit("quantity"), F.col("l_quantity"))
    merged = X.merge_maps(base, over)
    keys = F.array_join(F.transform(X.sorted_entries(merged), lambda e: e["key"]), ",")
    return rounds(gappy_lines(spark, folder).select(*LINE_KEY, merged["discount"].alias("discount"), merged["quantity"].alias("quantity"), keys.alias("keys")))


def _task_sql(table, column, rule, group):
    rows = f"count({column})" if rule == "report" else "count(*)"
    few = f"count(DISTINCT {column}) / greatest({rows}, 1) " + ("<= 0.2" if rule == "report" else "< 0.05")
    test = "true" if group != "numeric" else f"count(DISTINCT {column}) <= 20 AND {few}"
    return f"SELECT '{column}' AS target, count(DISTINCT {column}) AS \"distinct\", {rows} AS rows, CASE WHEN {test} THEN 'classification' ELSE 'regression' END AS task_type FROM {table}"


_TARGETS = (("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"), ("l_discount", "numeric"), ("l_returnflag", "text"))


def _task_types(spark, folder, rule):
    df = gappy_lines(spark, folder)
    out = None
    for c, _ in _TARGETS:
        part = T.detect_task(df, c, rule)
        out = part if out is None else out.unionByName(part)
    return out


@query("task_type_report_rule", f"WITH {GAPPY_SQL} " + " UNION ALL ".join(_task_sql("gappy", c, "report", g) for c, g in _TARGETS))
def task_type_report_rule(spark, folder):
    return _task_types(spark, folder, "report")


@query("task_type_training_rule", f"WITH {GAPPY_SQL} " + " UNION ALL ".join(_task_sql("gappy", c, "training", g) for c, g in _TARGETS))
def task_type_training_rule(spark, folder):
    return _task_types(spark, folder, "training")


@query("columns_by_type", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount + 0 AS l_discount, l_tax + 0 AS l_tax FROM lineitem")
def columns_by_type(spark, folder):
    df = T.normalised(read(spark, folder, "lineitem"))
    return df.select(*T.numeric_columns(df))


@query(
    "order_by_absolute",
    f"WITH c AS ({per_column(LINE_NUMERIC, 'SELECT {q} AS feature, round(coalesce(skewness({c}), 0), 4) + 0.0 AS skewness FROM lineitem'.replace('{q}', chr(39) + '{c}' + chr(39)))}) "
    "SELECT * FROM c ORDER BY abs(skewness) DESC, feature LIMIT 5",
)
def order_by_absolute(spark, folder):
    out = rounds(S.moment_profile(read(spark, folder, "lineitem")).select(F.col("column").alias("feature"), "skewness"), 4)
    return out.orderBy(F.abs("skewness").desc(), "feature").limit(5)
