"""Small helpers that the training-text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import scratch_path

#: ASCII white space, as a regular expression class: space and code points 9 to 13.
WHITE = r"[\x20\x09-\x0D]"
#: Digits and the bits that md5_fraction() takes from a hash.
HASH_DIGITS, HASH_BITS = 13, 52
#: Rows that a task writes of a staged table of narrow rows, and tasks that write it at least.
TASK_ROWS, LEAST_TASKS = 20_000, 8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` computed once a row although `use` may name it often, also inside lambdas.

    A plain `withColumn` gives no such promise: the optimizer may merge projections and put the expression
    in every place that names it.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def only_columns(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, under exactly these names, whatever else `df` holds."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


def plus(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with these columns at its end; columns of `df` that have one of these names give way."""
    taken = {c.lower() for c in columns}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; no other letter changes."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_number(*parts: Column | str) -> Column:
    """52 bits of the md5 of the parts, joined by '|' (a null part is '~'), as a long."""
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("~")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, HASH_DIGITS), 16, 10).cast("long")


def hash_number_sql(*parts: str) -> str:
    """hash_number() in DuckDB's SQL; parts are SQL expressions."""
    texts = ", ".join(f"coalesce(({p})::VARCHAR, '~')" for p in parts)
    return f"('0x' || substr(md5(concat_ws('|', {texts})), 1, {HASH_DIGITS}))::BIGINT"


def utf8_bytes(name: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(name)), F.lit(0)).cast("long")


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """`df` written to the shared checkpoint folder and read again: it cuts the lineage and outlives executors.

    With `rows`, about how many narrow ones there are at most, no more tasks write than they need: each task's file has
    a commit of its own, and on local folders a process that the executor starts to set its mode.
    """
    path = scratch_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(LEAST_TASKS, ceil(rows / TASK_ROWS)))
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.staged_at = path
    return kept


def forget(*frames: DataFrame) -> None:
    """Delete the files of staged frames that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame.staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def portions(batches: Iterable, rows: int):
    """The batches in slices of so many rows at most, so that few whole texts are Python objects at a time.

    What a worker's Arrow pool holds back goes to the system at the end, as workers live on for later tasks.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def text_rows(batches: Iterable, *columns: str):
    """Python lists of the columns of each Arrow batch."""
    for batch in batches:
        if batch.num_rows:
            yield [batch.column(c).to_pylist() for c in columns]
