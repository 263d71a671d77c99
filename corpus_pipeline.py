"""The corpus pipeline: five stages from raw documents to sharded training text.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet in the shared checkpoint
folder and read again as the next one's documents.  All but the last return the columns of the documents they got.

Nulls, ties and the like: documents with a null text, or none with a letter, leave in the first stage; documents with a
null id pass all others (they can't be named as a copy, and draw a shard like any text); a null language or source is a
child of its own in the mix; empty tables pass as empty tables; other columns stay, and the last stage's own columns
replace any with their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, language, mixing, near_copies, sharding
from plumbline.llm.common import forget, staged
from plumbline.llm.queries import MIX, MIX_SEED, domain_of_source, table

SHARDS = 8
#: The part of the tokens that the mix takes, each document at most once.
MIX_SHARE = 0.9


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay."""
    return language.readable(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays."""
    return near_copies.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out; documents that are mostly such passages go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Domains, languages and sources are brought to their target weights."""
    return mixing.mixed_documents(docs, MIX, MIX_SHARE, seed=MIX_SEED, domain=domain_of_source())


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a shard, with its region and rack."""
    return sharding.place(docs, sharding.shard_tree(SHARDS))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("source_mix", source_mix), ("sharding", shards)]

#: A learned language classifier and XXH64 fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return docs
