"""Mixing sources to target weights by hierarchical budgets.

The leaves of a domain-language-source tree supply tokens; every node has a weight among its siblings.  The budget goes
down the tree: a node's budget is shared among its children by weight, no child getting more than its capacity (supply
times the allowed epochs).  What a child can't supply goes to its siblings by their weights, and only what a whole
family can't supply has gone to the parent's siblings before, as the family's capacity bounds its budget.  With
children sorted by capacity over weight, the common level of those not exhausted is the largest of the levels that
each child would give, so one window a level of the tree does it, over a table with one row for each leaf.

A leaf then takes whole epochs of its documents, and of the next epoch a prefix: documents in the order of a hash of
seed, epoch and key, as long as the running number of tokens stays within the budget.  The prefix ends at a cut that is
found by sums over CELLS hash cells of each leaf and by a window over the one cell in which the budget ends; rows then
compare their own hash with their leaf's cut.  No leaf is sorted as a whole, and texts are never shuffled.

Nulls, ties and the like: a null domain, language or source is a child of its own ('~'); a null text has no tokens;
rows with the same key are taken together or not at all, and their tokens count together; a weight of zero or less
gives nothing; a budget beyond all capacity takes everything; an empty table gives an empty result; columns of the
result that the table has already give way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import HASH_BITS, hash_number, hash_number_sql, staged, text_or_empty

CELLS = 4096
CELL_SHIFT = HASH_BITS - (CELLS.bit_length() - 1)
LEVELS = ("domain", "lang", "source")
#: Words are the tokens that are counted.
TOKEN = r"[^\x20\x09-\x0D]+"


def token_count() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(TOKEN)).cast("long")


def _weight(levels: Sequence[str], weights: Mapping[tuple[str, ...], float]) -> Column:
    """The weight of the node at the last level; 1 where none is given."""
    given = [(k, v) for k, v in weights.items() if len(k) == len(levels)]
    path = F.array(*[F.col(c) for c in levels])
    case = None
    for k, v in given:
        same = path == F.array(*[F.lit(x) for x in k])
        case = F.when(same, F.lit(float(v))) if case is None else case.when(same, F.lit(float(v)))
    return F.lit(1.0) if case is None else case.otherwise(F.lit(1.0))


def budgets(supply: DataFrame, weights: Mapping[tuple[str, ...], float], tokens: int, max_epochs: int, levels: Sequence[str] = LEVELS) -> DataFrame:
    """The leaf table (levels, supply) with each leaf's `budget` in whole tokens."""
    leaves = supply
    for depth in range(1, len(levels) + 1):
        leaves = leaves.withColumn(f"_w{depth}", _weight(levels[:depth], weights))
    wanted = F.least(*[F.col(f"_w{d}") for d in range(1, len(levels) + 1)], F.lit(1.0)) > 0
    leaves = leaves.withColumn("_cap", F.when(wanted, F.col("supply") * max_epochs).otherwise(0).cast("double"))
    given = None
    for depth in range(1, len(levels) + 1):
        path, parent = list(levels[:depth]), list(levels[: depth - 1])
        nodes = leaves.groupBy(*path).agg(F.sum("_cap").alias("cap"), F.greatest(F.max(f"_w{depth}"), F.lit(0.0)).alias("w"))
        nodes = nodes.withColumn("b", F.lit(float(tokens))) if given is None else nodes.join(given.withColumnRenamed("got", "b"), parent)
        family = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
        turn = family.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(-1.0)), path[-1])
        spent = F.coalesce(F.sum("cap").over(turn.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        left = F.sum("w").over(turn.rowsBetween(W.currentRow, W.unboundedFollowing))
        nodes = nodes.withColumn("level", F.when(left > 0, (F.col("b") - spent) / left).otherwise(F.lit(0.0)))
        given = nodes.select(*path, F.least("cap", F.col("w") * F.max("level").over(family)).alias("got"))
    return leaves.join(given, list(levels)).select(*levels, "supply", F.floor("got").cast("long").alias("budget"))


def cuts(rows: DataFrame, leaves: DataFrame, seed: str, key: str = "doc_id", levels: Sequence[str] = LEVELS) -> DataFrame:
    """One row for each leaf: whole epochs `full`, and where the prefix of the next one ends.

    `rows` holds the key, the levels and n_tokens.
    """
    full = F.when(F.col("supply") > 0, F.floor(F.col("budget") / F.col("supply"))).otherwise(F.lit(0)).cast("long")
    plan = staged(leaves.withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("supply")), "leaf_plan")
    ordered = rows.join(plan.select(*levels, "full", "rest"), list(levels)).withColumn("h", hash_number(F.lit(seed), F.col("full"), F.col(key)))
    ordered = ordered.withColumn("cell", F.shiftright("h", CELL_SHIFT))
    sums = ordered.groupBy(*levels, "cell").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    upto = sums.withColumn("upto", F.sum("n").over(W.partitionBy(*levels).orderBy("cell")))
    ends = staged(upto.where("upto > rest").groupBy(*levels).agg(F.min_by(F.struct("cell", (F.col("upto") - F.col("n")).alias("before")), "cell").alias("end")).select(*levels, "end.*"), "cut_cells")
    inside = ordered.join(ends, [*levels, "cell"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(W.partitionBy(*levels, "cell").orderBy("h", key)))
    last = inside.where("upto <= rest").groupBy(*levels).agg(F.max(F.struct("h", F.col(key).alias("k"))).alias("last"))
    out = plan.join(ends.select(*levels, "cell"), list(levels), "left").join(last, list(levels), "left")
    return staged(out.select(*levels, "budget", "supply", "full", F.col("cell").alias("cut_cell"), F.col("last.h").alias("cut_h"), F.col("last.k").alias("cut_key")), "cuts")


def copies(rows: DataFrame, cut: DataFrame, seed: str, key: str = "doc_id", levels: Sequence[str] = LEVELS) -> DataFrame:
    """`rows` with `copies`: how many epochs take the row.  A join with the leaf table and a comparison; no row is sorted."""
    joined = rows.join(cut, list(levels))
    h = hash_number(F.lit(seed), F.col("full"), F.col(key))
    cell = F.shiftright(h, CELL_SHIFT)
    within = (cell == F.col("cut_cell")) & F.col("cut_h").isNotNull() & ((h < F.col("cut_h")) | ((h == F.col("cut_h")) & F.col(key).eqNullSafe(F.col("cut_key"))) | ((h == F.col("cut_h")) & (F.col(key) < F.col("cut_key"))))
    taken = F.col("cut_cell").isNull() | (cell < F.col("cut_cell")) | within
    return joined.withColumn("copies", F.when(F.col("budget") > 0, F.col("full") + F.when(taken & (F.col("budget") > F.col("full") * F.col("supply")), 1).otherwise(0)).otherwise(0).cast("long")).drop("cut_cell", "cut_h", "cut_key", "full")


def mixed(
    docs: DataFrame,
    weights: Mapping[tuple[str, ...], float],
    share: float,
    max_epochs: int = 1,
    seed: str = "mix",
    key: str = "doc_id",
    domain: Column | None = None,
    levels: Sequence[str] = LEVELS,
) -> tuple[DataFrame, DataFrame]:
    """(rows, cuts): a narrow row for each document (key, levels, n_tokens), staged, and the leaves' cuts.

    The budget is `share` of all tokens.  `domain` derives the first level where the table has no such column.
    """
    rows = staged(docs.select(F.col(f"`{key}`").alias(key), *leaf_columns(domain, levels), token_count().alias("n_tokens")), "tokens")
    supply = rows.groupBy(*levels).agg(F.sum("n_tokens").alias("supply"))
    total = rows.agg(F.sum("n_tokens")).first()[0] or 0
    return rows, cuts(rows, budgets(supply, weights, int(total * share), max_epochs, levels), seed, key, levels)


def leaf_columns(domain: Column | None, levels: Sequence[str] = LEVELS) -> list[Column]:
    exprs = [domain if domain is not None and i == 0 else F.col(f"`{c}`") for i, c in enumerate(levels)]
    return [F.coalesce(e.cast("string"), F.lit("~")).alias(c) for e, c in zip(exprs, levels)]


def mixed_documents(
    docs: DataFrame,
    weights: Mapping[tuple[str, ...], float],
    share: float,
    max_epochs: int = 1,
    seed: str = "mix",
    key: str = "doc_id",
    domain: Column | None = None,
    levels: Sequence[str] = LEVELS,
) -> DataFrame:
    """The rows of `docs`, with their own columns, each as often as the mix takes it."""
    _, cut = mixed(docs, weights, share, max_epochs, seed, key, domain, levels)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{key}`").alias(key), *leaf_columns(domain, levels))
    found = copies(own, cut, seed, key, levels).where("copies > 0")
    again = found if max_epochs == 1 else found.withColumn("_epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select("_row.*")


def mix_sql(rows: str, weights: Mapping[tuple[str, ...], float], share: float, max_epochs: int, seed: str, key: str = "doc_id", levels: Sequence[str] = LEVELS) -> str:
    """copies() of mixed() in DuckDB's SQL, as the tables `leaves` and `mixed` from a table `rows` (key, levels, n_tokens)."""

    def weight(depth: int) -> str:
        cases = " ".join("WHEN " + " AND ".join(f"{c} = '{x}'" for c, x in zip(levels, k)) + f" THEN {float(v)}" for k, v in weights.items() if len(k) == depth)
        return f"CASE {cases} ELSE 1.0 END::DOUBLE" if cases else "1.0::DOUBLE"

    out = [f"supply AS MATERIALIZED (SELECT {', '.join(levels)}, sum(n_tokens)::BIGINT AS supply, sum(n_tokens)::DOUBLE * {max_epochs} AS cap0 FROM {rows} GROUP BY ALL)"]
    for depth in range(1, len(levels) + 1):
        path, parent = ", ".join(levels[:depth]), ", ".join(levels[: depth - 1])
        budget = f"floor((SELECT sum(n_tokens) FROM {rows}) * {share})::DOUBLE AS b" if depth == 1 else "got AS b"
        source = f"(SELECT {path}, sum(cap0) AS cap, {weight(depth)} AS w FROM supply GROUP BY ALL)" + (f" JOIN b{depth - 1} USING ({parent})" if parent else "")
        by = f"PARTITION BY {parent} " if parent else ""
        turn = f"{by}ORDER BY cap / w, {levels[depth - 1]}"
        out += [
            f"n{depth} AS (SELECT {path}, cap, w, {budget} FROM {source})",
            f"l{depth} AS (SELECT *, (b - coalesce(sum(cap) OVER ({turn} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({turn} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM n{depth})",
            f"b{depth} AS MATERIALIZED (SELECT {path}, least(cap, w * max(lev) OVER ({by})) AS got FROM l{depth})",
        ]
    last = len(levels)
    out += [
        f"leaves AS MATERIALIZED (SELECT {', '.join(levels)}, supply, floor(got)::BIGINT AS budget, CASE WHEN supply > 0 THEN floor(got)::BIGINT // supply ELSE 0 END AS whole FROM supply JOIN b{last} USING ({', '.join(levels)}))",
        f"ordered AS (SELECT *, {hash_number_sql(repr(seed), 'whole', key)} AS h FROM {rows} JOIN leaves USING ({', '.join(levels)}))",
        f"mixed AS (SELECT *, whole + CASE WHEN budget > whole * supply AND sum(n_tokens) OVER (PARTITION BY {', '.join(levels)} ORDER BY h, {key}) <= budget - whole * supply THEN 1 ELSE 0 END AS copies FROM ordered)",
    ]
    return ",\n".join(out)
