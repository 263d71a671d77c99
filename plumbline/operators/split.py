"""Train/test split, folds and samples that follow a hash of the row key.

They depend on the key alone - not on partitions, file order or engine - and rows never
move: a few hash thresholds per class are found first, then each row compares its hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.expr import key_hash
from plumbline.operators.ranks import attach_thresholds, hash_thresholds


def train_test_split(
    df: DataFrame, key: str | Sequence[str], target: str | None = None, test_size: float = 0.2, digits: int | None = None
) -> DataFrame:
    """Adds `is_test`: true for the first ceil(test_size * n) hashes of each class (`target`), or of all rows."""
    if not 0 < test_size < 1:
        raise ValueError("test_size must lie between 0 and 1")
    ranks = lambda n: [F.ceil(n * F.lit(test_size))]
    cuts = hash_thresholds(df, key, target, ranks, digits)
    return attach_thresholds(df, key, target, cuts, "__after").withColumn("is_test", F.col("__after") == 0).drop("__after")


def assign_folds(
    df: DataFrame, key: str | Sequence[str], folds: int = 5, target: str | None = None, digits: int | None = None
) -> DataFrame:
    """Adds `fold` (0 .. folds-1): equal runs of the hash order inside each class, larger runs first."""
    if folds < 2:
        raise ValueError("there must be two folds or more")

    def ranks(n):
        base, extra = F.floor(n / folds), n % folds
        # a class with fewer rows than folds leaves the last folds empty (rank clamped to n)
        return [base * (i + 1) + F.least(extra, F.lit(i + 1)) for i in range(folds - 1)]

    cuts = hash_thresholds(df, key, target, ranks, digits)
    return attach_thresholds(df, key, target, cuts, "fold")


def sample_rows(df: DataFrame, key: str | Sequence[str], n: int) -> DataFrame:
    """At most n rows, the lowest key hashes: a seeded sample that every engine repeats (bounded heap)."""
    return df.orderBy(key_hash(key)).limit(n)


def union_rows(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
