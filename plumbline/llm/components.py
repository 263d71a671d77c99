"""Connected components of a link table by alternating stars.

Each round sends every node's larger neighbours, then its smaller ones, to the smallest node that it sees.  The number
of rounds grows with the logarithm of the longest chain.  Links are staged in the shared checkpoint folder after each
round, so neither the lineage nor the driver grows with them; only one number a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import forget, staged


def _smallest(links: DataFrame, both: bool, rows: int) -> tuple[DataFrame, DataFrame]:
    """Each node a with its neighbours b, and m, the smallest of them all; then the staged table of m.

    `both`: links count in both directions.  The table is staged so that the join shuffles both sides by the node
    alone; the runtime can then split a node that has very many links.
    """
    if both:
        links = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = staged(links.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.col("a")).alias("m")), "least", rows)
    return links.join(least, F.col("a") == F.col("u")).select("a", "b", "m"), least


def _round(links: DataFrame, rows: int) -> DataFrame:
    """One large star and one small star of so many links, which point from the larger node a to the smaller b."""
    seen, least = _smallest(links, True, 2 * rows)
    large = staged(seen.where("b > a AND m <> b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large", rows)
    down, lower = _smallest(large, False, rows)
    moved = down.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = staged(moved.unionAll(down.select("a", F.col("m").alias("b"))).distinct(), "links", 2 * rows)
    forget(least, large, lower)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); the root is the component's smallest node.

    Links may be repeated, turned round or from a node to itself; null ends are left out.
    """
    turned = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b AND a IS NOT NULL AND b IS NOT NULL")
    now, facts = staged(turned.distinct(), "links"), None
    while (seen := now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()) != facts and seen[0]:
        following, facts = _round(now, seen[0]), seen
        forget(now)
        now = following
    members = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.unionAll(members.select(F.col("root").alias("node"), "root").distinct())


def first_of_each(docs: DataFrame, found: DataFrame, printed: Callable[[str | None], int], key: str = "doc_id") -> DataFrame:
    """The rows of `docs`, of each root only those of one text: the smallest (key, print).

    `found` has (key, print, root) for each row; `printed` gives the print of a text.  Rows of one key and print are one
    document, of which the one with the smallest text stays.  Rows with a null key always stay.  Only keys that repeat
    need the print of each row; all other rows stay or go by their key alone.
    """
    texts = staged(found.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), "print").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("n")), "texts")
    rows = texts.count()
    first = texts.groupBy("root").agg(F.min(F.struct("_key", "print")).alias("first"))
    judged = staged(texts.join(first, "root").select("_key", "print", "n", (F.struct("_key", "print") == F.col("first")).alias("stays")), "judged", rows)
    keys = staged(judged.groupBy("_key").agg((F.sum("n") > 1).alias("again"), F.max("stays").alias("stays")), "keys", rows)
    on_key = F.col(f"`{key}`") == F.col("_key")
    kept = docs.join(keys.where("again OR NOT stays").select("_key"), on_key, "left_anti")
    forget(texts)
    again = keys.where("again AND stays").select("_key")
    if not again.limit(1).count():
        return kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array(map(printed, batch.column("text").to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, prints], [*batch.schema.names, "_print"])

    rows = docs.join(again, on_key, "left_semi")
    rows = rows.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("_print", T.LongType())]))
    rows = rows.join(judged.where("stays").select("_key", "print"), on_key & (F.col("_print") == F.col("print")), "left_semi")
    one = rows.groupBy(key, "_print").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.coalesce("text", F.lit(""))).alias("_row"))
    return kept.unionAll(one.select("_row.*"))
