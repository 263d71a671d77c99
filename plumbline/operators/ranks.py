"""Ranks, running totals and hash-ordered thresholds that never put one group in one task."""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.expr import key_hash, quoted
from plumbline.session import bounded_broadcast, estimated_bytes, stage

#: Buckets of an input whose size is unknown, and the most that the sketch tells apart.
UNSIZED_BUCKETS, MOST_BUCKETS = 1024, 16_384
LITERAL_STRATA = 64
#: Ordered ranges that keys are dealt into at a time.
MOST_RANGES = 64
#: A size estimate beyond this is the optimizer's way of saying that it does not know.
UNLIKELY_BYTES = 1 << 60


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group, with their rank.

    Spark keeps only k rows per group and task before the shuffle (window group limit),
    so a hot group costs k rows per task.
    """
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_rows(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """First n rows in a stated order: a bounded heap per task, no global sort."""
    return df.orderBy(*order).limit(n)


def row_at(df: DataFrame, key: str, index: int, heap_rows: int = 10_000) -> DataFrame:
    """Row number `index` (from 0) in the order of a unique key of any type, nulls first; out of range raises.

    Near the start a bounded heap finds it.  Further in, the keys are dealt into at most MOST_RANGES ordered ranges and
    written; the counts of the ranges say which one holds the row, and that one is dealt again until it has no more than
    `heap_rows` keys or a single one, or a round parts nothing.  So each round sends a bounded sample of keys and a count a range to the driver.
    """
    if index < 0:
        raise IndexError("row index must not be negative")
    if index < heap_rows:
        row = df.orderBy(quoted(key)).offset(index).limit(1)
        if row.isEmpty():
            raise IndexError(f"row index {index} is out of range")
        return row
    keys = df.select(quoted(key).alias("key"))
    n = keys.count()
    if index >= n:
        raise IndexError(f"row index {index} is out of range (rows: {n})")
    at = index
    while n > heap_rows:
        dealt = keys.repartitionByRange(min(MOST_RANGES, -(-n // heap_rows)), F.col("key").asc_nulls_first())
        kept = stage(dealt.select("key", F.spark_partition_id().alias("part")), "ranges", small=False)
        held = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"), F.count("key").alias("known")).collect()
        before = n
        for part, n, low, high, known in sorted(held, key=lambda r: r["part"]):
            if at < n:
                break
            at -= n
        keys = kept.filter(F.col("part") == part).select("key")
        if n == before or (low == high and known in (0, n)):  # a key that repeats, or nulls alone
            break
    value = keys.orderBy("key").offset(at).limit(1)
    return df.join(F.broadcast(value.select(F.col("key").alias("__at"))), quoted(key).eqNullSafe(F.col("__at"))).drop("__at")


def bucket_count(df: DataFrame, target_bytes: int = 64 * 1024 * 1024) -> int:
    """How many ordered buckets a running total needs to keep each one near `target_bytes`."""
    size = estimated_bytes(df)
    if size > UNLIKELY_BYTES:
        return UNSIZED_BUCKETS
    return int(max(1, min(MOST_BUCKETS, -(-size // target_bytes))))


def running_totals(
    df: DataFrame,
    order: str,
    sums: Sequence[str],
    group: Sequence[str] = (),
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Adds `<c>_before` for each column of `sums`: its total over the rows strictly ahead.

    `order` is numeric and unique inside each group (pre-aggregate first).  The order is cut
    into buckets by a quantile sketch; bucket totals give each bucket its offset and only a
    bucket, never a whole group, is sorted in one task.
    """
    buckets = bucket_count(df) if buckets is None else buckets
    direction = quoted(order).desc() if descending else quoted(order).asc()
    group = list(group)
    if buckets <= 1:
        ahead = W.partitionBy(*group).orderBy(direction).rowsBetween(W.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in sums])
    grid = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(quoted(order).cast("double"), grid, max(10_000, 4 * buckets))).first()[0] or []
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="__order", outputCol="__bucket")
    placed = cut.transform(df.withColumn("__order", quoted(order).cast("double")))
    keys = [*group, "__bucket"]
    totals = placed.groupBy(*keys).agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    side = F.col("__bucket").desc() if descending else F.col("__bucket").asc()
    earlier = W.partitionBy(*group).orderBy(side).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"__{c}").over(earlier), F.lit(0)).alias(f"__o_{c}") for c in sums])
    within = W.partitionBy(*keys).orderBy(direction).rowsBetween(W.unboundedPreceding, -1)
    local = placed.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"__l_{c}") for c in sums])
    joined = local.join(offsets, keys)
    return joined.select(
        *[quoted(c) for c in df.columns],
        *[(F.col(f"__o_{c}") + F.col(f"__l_{c}")).alias(f"{c}_before") for c in sums],
    )


def _prefix_digits(df: DataFrame, per_bucket: int = 16 * 1024 * 1024) -> int:
    size = estimated_bytes(df)
    if size > UNLIKELY_BYTES:
        return 5
    return int(min(12, max(1, round(log(max(size / per_bucket, 16), 16)))))


def hash_thresholds(
    df: DataFrame,
    key: str | Sequence[str],
    strata: str | None,
    ranks_of,
    digits: int | None = None,
) -> DataFrame:
    """Key hashes at chosen ranks of each stratum: rows `(stratum, cut_no, threshold)`.

    `ranks_of(n: Column) -> list[Column]` gives the 1-based ranks wanted from a stratum of
    n rows (0 = none).  Hash prefixes split a stratum into buckets that follow the hash order;
    counts per (stratum, prefix) locate the bucket of each rank, and only the rows of those
    buckets are sorted.  A caller then assigns rows by comparing hashes - no row moves.
    """
    digits = _prefix_digits(df) if digits is None else digits
    stratum = F.lit("") if strata is None else F.coalesce(quoted(strata).cast("string"), F.lit(""))
    hashed = df.select(stratum.alias("stratum"), key_hash(key).alias("h")).withColumn("prefix", F.substring("h", 1, digits))
    counts = hashed.groupBy("stratum", "prefix").agg(F.count("*").alias("n"))
    before = W.partitionBy("stratum").orderBy("prefix").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("stratum")
    located = counts.select(
        "stratum",
        "prefix",
        "n",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"),
        F.sum("n").over(whole).alias("total"),
    )
    wanted = F.posexplode(F.array(*[r.cast("long") for r in ranks_of(F.col("total"))])).alias("cut_no", "rank")
    spots = (
        located.select("stratum", "prefix", "n", "ahead", wanted)
        .filter((F.col("rank") > F.col("ahead")) & (F.col("rank") <= F.col("ahead") + F.col("n")))
        .select("stratum", "prefix", "cut_no", (F.col("rank") - F.col("ahead")).alias("local"))
    )
    # one row per cut and stratum, checked before it is broadcast
    spots = bounded_broadcast(spots)
    near = hashed.join(spots, ["stratum", "prefix"], "left_semi")
    ordered = near.withColumn("pos", F.row_number().over(W.partitionBy("stratum", "prefix").orderBy("h")))
    hits = ordered.join(spots, ["stratum", "prefix"]).filter(F.col("pos") == F.col("local"))
    return hits.select("stratum", "cut_no", F.col("h").alias("threshold"))


def attach_thresholds(df: DataFrame, key: str | Sequence[str], strata: str | None, cuts: DataFrame, out: str) -> DataFrame:
    """Adds `out`: how many of the stratum's thresholds lie strictly before the row's hash."""
    per = cuts.groupBy("stratum").agg(F.array_sort(F.collect_list("threshold")).alias("cuts"))
    stratum = F.lit("") if strata is None else F.coalesce(quoted(strata).cast("string"), F.lit(""))
    found = per.limit(LITERAL_STRATA + 1).collect()
    position = lambda cuts: F.coalesce(F.size(F.filter(cuts, lambda c: c < key_hash(key))), F.lit(0))
    if len(found) <= LITERAL_STRATA:
        # a handful of hashes per class: literals in a projection, no join at all
        at = F.lit(0)
        for r in found:
            at = F.when(stratum == r["stratum"], position(F.array(*[F.lit(c) for c in r["cuts"]]))).otherwise(at)
        return df.withColumn(out, at)
    joined = df.withColumn("__stratum", stratum).join(bounded_broadcast(per.withColumnRenamed("stratum", "__stratum")), "__stratum", "left")
    return joined.withColumn(out, position(F.col("cuts"))).drop("__stratum", "cuts")
