"""Placing rows in shards by a hierarchical weighted hash tree.

The tree has regions, racks in regions and shards in racks.  A row descends it: at each level every child draws an
exponential waiting time from a hash of the row's key and the child's path, divided by the child's weight, and the
shortest wait wins.  A child so wins in proportion to its weight, and its waits depend on nothing but the key and
itself: when a weight changes, rows move only into or out of the subtree with that weight.  Rows of all other
subtrees stay in their shards.  Everything is a projection of the key; no row is shuffled to be placed.

Nulls, ties and the like: a null key draws as the text '~'; rows with the same key share a shard; a subtree of
weight zero takes no row; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import HASH_BITS, hash_number, hash_number_sql, let, plus, staged, utf8_bytes

#: Cells that slot numbering cuts each shard into, so that no task sorts a whole shard.
CELLS = 4096


@dataclass(frozen=True)
class Node:
    """A region, rack or shard.  Inner nodes weigh what their children weigh unless a weight is given."""

    name: str
    children: tuple[Node, ...] = ()
    own_weight: float | None = None
    shard: int | None = None

    @property
    def weight(self) -> float:
        if self.own_weight is not None:
            return self.own_weight
        return sum(c.weight for c in self.children) if self.children else 1.0

    def shards(self) -> list[int]:
        return [self.shard] if self.shard is not None else [s for c in self.children for s in c.shards()]


def shard_tree(shards: int, racks_in_region: int = 2, shards_in_rack: int = 2, grown_from: int | None = None) -> Node:
    """A tree of `shards` equal shards.

    Up to `grown_from` shards fill racks and regions in turn.  Every later shard opens a region of its own, so that it
    takes its share from all others and no other pair of shards exchanges a row.
    """
    base = shards if grown_from is None else min(shards, grown_from)
    leaves = [Node(f"s{i}", shard=i) for i in range(base)]
    racks = [Node(f"k{i // shards_in_rack}", tuple(leaves[i : i + shards_in_rack])) for i in range(0, base, shards_in_rack)]
    regions = [Node(f"r{i // racks_in_region}", tuple(racks[i : i + racks_in_region])) for i in range(0, len(racks), racks_in_region)]
    late = [Node(f"r+{i}", (Node(f"k+{i}", (Node(f"s{i}", shard=i),)),)) for i in range(base, shards)]
    return Node("tree", (*regions, *late))


def reweighted(tree: Node, shard: int, weight: float) -> Node:
    """The tree with another weight for one shard; inner nodes without a weight of their own follow."""
    if tree.shard is not None:
        return replace(tree, own_weight=weight) if tree.shard == shard else tree
    return replace(tree, children=tuple(reweighted(c, shard, weight) for c in tree.children))


def _wait(key: Column, path: str, weight: float) -> Column:
    return -F.log((hash_number(path, key) + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))) / F.lit(float(weight))


def _descend(node: Node, path: str, key: Column) -> Column:
    """The names of region, rack and shard of a key below `node`, then the shard's number, as an array of texts."""
    here = [c for c in node.children if c.weight > 0]
    if not here:
        raise ValueError(f"no shard with a weight below {path}")
    outs = []
    for c in here:
        name = F.array(F.lit(c.name))
        outs.append(F.array(F.lit(c.name), F.lit(str(c.shard))) if c.shard is not None else F.concat(name, _descend(c, f"{path}/{c.name}", key)))
    if len(here) == 1:
        return outs[0]
    waits = F.array(*[F.struct(_wait(key, f"{path}/{c.name}", c.weight).alias("wait"), F.lit(i).alias("child")) for i, c in enumerate(here)])
    return let(F.array_min(waits)["child"], lambda winner: _branch(winner, outs))


def _branch(winner: Column, outs: list[Column]) -> Column:
    case = F.when(winner == 0, outs[0])
    for i, out in enumerate(outs[1:-1], 1):
        case = case.when(winner == i, out)
    return case.otherwise(outs[-1])


def place(docs: DataFrame, tree: Node, key: str = "doc_id", name: str = "shard") -> DataFrame:
    """`docs` with the columns `shard` (int), `region` and `rack`; a column of such a name gives way.

    A projection: no shuffle, no state, so it may run anywhere in a plan.
    """
    out = plus(docs, _placed=_descend(tree, tree.name, F.col(f"`{key}`")))
    found = {name: F.col("_placed")[3].cast("int"), "region": F.col("_placed")[0], "rack": F.col("_placed")[1]}
    return plus(out, **found).drop("_placed")


def numbered(rows: DataFrame, by: str, order: tuple[str, ...], name: str = "slot") -> DataFrame:
    """`rows` with a gapless number from 0 within each value of `by`, in a fixed pseudo-random order.

    The order is a hash of the `order` columns, ties by these columns.  Hash order cuts each value of `by` into cells
    of about equal size; a window numbers the rows of a cell, and the sums of the earlier cells' counts are added.  The
    largest sort is a cell's; the table of counts has at most CELLS rows for each value of `by`.  `rows` is staged,
    since it is read twice, and should be narrow.
    """
    h = hash_number("slot", *[F.col(c) for c in order])
    kept = staged(plus(rows, _h=h).withColumn("_cell", F.shiftright("_h", HASH_BITS - (CELLS.bit_length() - 1))), "slots")
    counts = kept.groupBy(by, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)))
    inside = F.row_number().over(W.partitionBy(by, "_cell").orderBy("_h", *order)).cast("long")
    within = kept.withColumn("_in", inside)
    joined = within.join(before.select(F.col(by).alias("_by"), F.col("_cell").alias("_at"), "_before"), (F.col(by) == F.col("_by")) & (F.col("_cell") == F.col("_at")))
    return joined.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_in") - 1).drop("_h", "_cell", "_in", "_by", "_at", "_before")


def shard_table(docs: DataFrame, shards: int = 8, key: str = "doc_id") -> DataFrame:
    """One narrow row for each document: its size, checksum, shard, slot, and its shard in a tree grown by one."""
    facts = docs.select(
        F.col(f"`{key}`").alias(key),
        (utf8_bytes() + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    here = place(facts, shard_tree(shards), key)
    grown = place(here.drop("region", "rack"), shard_tree(shards + 1, grown_from=shards), key, "grown_shard").drop("region", "rack")
    return numbered(grown, "shard", (key, "size", "text_crc32"))


def tree_sql(tree: Node, key: str, source: str, out: str, name: str) -> str:
    """place() in DuckDB's SQL: a table `out` of `source` with the column `name`."""

    def descend(node: Node, path: str) -> str:
        if node.shard is not None:
            return str(node.shard)
        here = [c for c in node.children if c.weight > 0]
        below = [descend(c, f"{path}/{c.name}") for c in here]
        if len(here) == 1:
            return below[0]
        waits = [f"-ln(({hash_number_sql(repr(f'{path}/{c.name}'), key)} + 0.5) / {float(1 << HASH_BITS)}) / {float(c.weight)}" for c in here]
        winner = f"list_position([{', '.join(waits)}], list_min([{', '.join(waits)}]))"
        return f"CASE {winner} " + " ".join(f"WHEN {i} THEN {b}" for i, b in enumerate(below, 1)) + " END"

    return f"{out} AS (SELECT *, ({descend(tree, tree.name)})::INT AS {name} FROM {source})"


def slot_sql(*order: str) -> str:
    """The hash that numbered() orders by."""
    return hash_number_sql("'slot'", *order)
