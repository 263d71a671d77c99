"""Registry of named queries and their SQL twins, plus the derived inputs both sides share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with the SQL that must give the same rows."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


LINEITEM = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)
LINE_KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
LINE_NUMERIC = LINEITEM[:8]
ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


def gappy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """lineitem with gaps: discount 0 and return flag R become null."""
    li = read(spark, folder, "lineitem")
    return li.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0))).withColumn(
        "l_returnflag", F.nullif("l_returnflag", F.lit("R"))
    )


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their labels; most have none."""
    return read(spark, folder, "documents").join(read(spark, folder, "labels"), "doc_id", "left")


def leaky_lines(spark: SparkSession, folder: str) -> DataFrame:
    li = read(spark, folder, "lineitem")
    return li.withColumn("price_copy", F.col("l_extendedprice") * 2).withColumn("returnflag_copy", F.col("l_returnflag"))


# The same inputs as common table expressions; negative zero becomes zero on both sides.
GAPPY_SQL = """gappy AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
    nullif(l_discount, 0) AS l_discount, l_tax + 0 AS l_tax, nullif(l_returnflag, 'R') AS l_returnflag,
    l_linestatus, l_shipdate FROM lineitem)"""
LABELLED_SQL = "labelled AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
LEAKY_SQL = """leaky AS (SELECT *, l_extendedprice * 2 AS price_copy, l_returnflag AS returnflag_copy FROM lineitem)"""


def per_column(columns: Sequence[str], template: str, glue: str = "\nUNION ALL\n") -> str:
    """One SELECT per column from a template with {c} and {i}."""
    return glue.join(template.format(c=c, i=i) for i, c in enumerate(columns))


def r(expr: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0"


def rounds(df: DataFrame, digits: int = 6, *columns: str, **special: int) -> DataFrame:
    """Round double columns of a result (all of them by default), zero kept unsigned."""
    kinds = dict(df.dtypes)
    chosen = columns or [c for c, k in kinds.items() if k == "double"]
    for c in chosen:
        df = df.withColumn(c, F.round(c, special.get(c, digits)) + F.lit(0.0))
    return df
