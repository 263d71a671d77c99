"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Words are those of `simhash`; fewer words than a shingle has make one shingle.  Rows of equal sets are copies.  Distinct
sets are sketched by TABLES x ROWS least values of hashes, and each run of ROWS values is a cell of one of TABLES tables:
two sets of similarity s share a cell with a chance of 1 - (1 - s ^ 5) ^ 32, which is 0.999997 at 0.8 and more above.  All
pairs that share a cell are candidates; they are verified by the exact similarity of their complete sets.

A cell may hold any number of sets, and its pairs would grow with its square.  So all members are verified against the
smallest of the cell first, and after that only pairs whose ends no link has brought into one component yet: no link that
could join two components is left out.  A round chooses up to LEADERS members of each such cell, which are verified
against all members of other components, and components are found anew; most groups of near copies are one component then.
Pairs of unlike components that are left then (in cells of strangers that share a passage) are searched by an exact prefix
filter over the sets of those cells: with shingles in order of their rarity, two sets of similarity 0.8 share one of the
first fifth.  Of what it lets through, parity bits of both sets give a least number of shingles that only one of them has,
and pairs with too many are left out.  Components of links are groups.

SimHash fingerprints of the sets and their multi-index search (`simhash`) give candidates too, which are verified with the
smallest members' ones.  They alone would not do: at 0.8 some 10 of 64 bits differ, with a spread of 3.

Nulls, ties and the like: null texts and texts without words are copies of each other; rows with a null id always stay
and link nothing; of a group the rows of the smallest (id, set) stay, and rows that share both are one document; an id that
repeats with unlike texts stays with each of them; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import forget, only_columns, portions, staged
from plumbline.llm.components import components, first_of_each
from plumbline.llm.simhash import SEED, bit_counts, close_links, shingle_hashes

WORDS = 5
#: Tables of the index, and hash functions of one table's cells.
TABLES, ROWS = 32, 5
#: Members of a cell that are compared with all of it in a round, and rounds before the prefix filter.
LEADERS, ROUNDS = 2, 1
#: Parity bits of a set, in columns of 64.
PARITY = 256
PARITIES = [f"p{i}" for i in range(PARITY // 64)]
#: Shingles that are hashed at a time, texts that are taken at a time.
BATCH = 256
CHUNK = 1 << 10


def _odd(name: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"{name}{i}", SEED) | 1 for i in range(n)], np.uint64)


FACTORS, SHIFTS, MIX, STARTS = _odd("factor", TABLES * ROWS), _odd("shift", TABLES * ROWS), _odd("mix", ROWS), _odd("table", TABLES)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order."""
    return np.unique(shingle_hashes(text, words))


def set_print(hashes: np.ndarray) -> int:
    """A signed 64-bit number for the set."""
    return int(np.array([xxhash.xxh64_intdigest(hashes.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def set_fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of the set as a signed 64-bit number."""
    return int(np.packbits(2 * bit_counts(hashes) > len(hashes), bitorder="little").view(np.int64)[0])


def parities(hashes: np.ndarray) -> np.ndarray:
    """PARITY bits: whether an odd number of the set's shingles falls on each.

    A shingle that only one of two sets has turns one bit, so as many bits differ as there are such shingles, at most.
    """
    odd = np.bincount((hashes % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def cells(hashes: np.ndarray) -> np.ndarray:
    """The set's cell in each table; the number names the table too."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(TABLES * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[None, i : i + CHUNK] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1), out=least)
    least = (least ^ (least >> np.uint64(29))).reshape(TABLES, ROWS)
    return ((least * MIX).sum(axis=1, dtype=np.uint64) + STARTS).view(np.int64)


def sketches(docs: DataFrame, words: int = WORDS, key: str = "doc_id") -> DataFrame:
    """(key, fp, n, cells, sim) of the rows with an id: set, its size, its cells, and its SimHash."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, BATCH):
            prints, sizes, found, sims = [], [], [], []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), words)
                prints.append(set_print(hashes))
                sizes.append(len(hashes))
                found.append(cells(hashes))
                sims.append(set_fingerprint(hashes))
            arrays = [pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(sims, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(key), *arrays], [key, "fp", "n", "cells", "sim"])

    named = only_columns(docs, key, "text").where(F.col(key).isNotNull())
    return named.mapInArrow(run, f"`{key}` {kind}, fp long, n int, cells array<long>, sim long")


def _shingles(texts: DataFrame, words: int) -> DataFrame:
    """(fp, hashes, p0 ..) of rows (text, fp), without the rows whose text has another set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, BATCH):
            sets = [shingle_set(t, words) for t in part.column("text").to_pylist()]
            same = [(f, s) for f, s in zip(part.column("fp").to_pylist(), sets) if set_print(s) == f]
            odd = np.array([parities(s) for _, s in same], np.int64).reshape(-1, len(PARITIES))
            arrays = [pa.array([f for f, _ in same], pa.int64()), pa.array([s.view(np.int64) for _, s in same], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(o, pa.int64()) for o in odd.T]], ["fp", "hashes", *PARITIES])

    return texts.mapInArrow(run, f"fp long, hashes array<long>, {', '.join(f'{p} long' for p in PARITIES)}")


def by_fingerprints(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets (fp, sim): each with the smallest of its fingerprint, and the smallest ones of close fingerprints."""
    prints = staged(sets.groupBy("sim").agg(F.min("fp").alias("least")), "fingerprints")
    same = sets.join(prints, "sim").where("fp <> least").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    one, two = (prints.select(F.col("sim").alias(end), F.col("least").alias(f"{end}_least")) for end in "ab")
    close = close_links(prints.select(F.col("sim").alias("fp"))).join(one, "a").join(two, "b")
    return same.unionAll(close.select(F.least("a_least", "b_least").alias("a"), F.greatest("a_least", "b_least").alias("b")))


def _like_sizes(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can have a similarity of 0.8."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b) with a similarity of 0.8 or more."""
    one = shingles.select(F.col("fp").alias("a"), F.col("hashes").alias("x"))
    two = shingles.select(F.col("fp").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.distinct().join(one, "a").join(two, "b").where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def _rooted(members: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """(cell, fp, n, led, root) of the members of cells with several roots, staged; roots are those of all links so far.

    There are so many `rows` of members at most.
    """
    roots = staged(components(links), "star_roots", rows)
    now = staged(members.join(roots, F.col("fp") == F.col("node"), "left").select("cell", "fp", "n", "led", F.coalesce("root", "fp").alias("root")), "rooted", rows)
    mixed = now.groupBy(F.col("cell").alias("c")).agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("c")
    out = staged(now.join(mixed, F.col("cell") == F.col("c"), "left_semi"), "mixed", rows)
    forget(roots, now)
    return out


def _leaders(now: DataFrame) -> DataFrame:
    """(cell, a, m, r): the next members to be compared with a whole cell, with their size and root.

    They are of any root but the one with the most members that have not led yet: once only that root has such members,
    each pair of unlike roots has been compared.
    """
    sizes = now.where("NOT led").groupBy("cell", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy(F.col("cell").alias("c")).agg(F.max(F.struct("size", "root")).alias("main"))
    others = now.where("NOT led").join(main, F.col("cell") == F.col("c")).where(F.col("root") != F.col("main.root"))
    turn = F.row_number().over(W.partitionBy("cell").orderBy(F.xxhash64("fp"), "fp"))
    return others.withColumn("turn", turn).where(F.col("turn") <= LEADERS).select("cell", F.col("fp").alias("a"), F.col("n").alias("m"), F.col("root").alias("r"))


def _by_rare_shingles(now: DataFrame, shingles: DataFrame) -> DataFrame:
    """Pairs (a, b) of unlike roots among the sets of `now` that can have a similarity of 0.8.

    With all sets' shingles in one order, the rarest first, two such sets share one of their first n - ceil(0.8 n) + 1.
    The first that they share has enough shingles behind it in both; passages that many sets hold fall away by that.
    """
    left = staged(now.select("fp", "n", "root").distinct().join(shingles.select("fp", *PARITIES), "fp"), "left_sets")
    words = staged(shingles.join(left.select("fp"), "fp").select("fp", F.explode("hashes").alias("h")), "left_shingles")
    often = words.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    own = W.partitionBy("fp")
    # the n - known shingles that no other set has come first, and are in no pair
    shared = words.join(often, "h").select("fp", "h", (F.row_number().over(own.orderBy("f", "h")) - F.count(F.lit(1)).over(own)).alias("behind"))
    placed = shared.join(left, "fp").select("h", "fp", "n", "root", *PARITIES, (F.col("n") + F.col("behind")).alias("at"))
    first = staged(placed.where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * 4 / F.lit(5)) + 1), "rare")
    x, y = (first.select("h", *[F.col(c).alias(c + side) for c in ("fp", "n", "root", "at", *PARITIES)]) for side in ("_x", "_y"))
    enough = 9 * (1 + F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))) >= 4 * (F.col("n_x") + F.col("n_y"))
    # at 0.8 no more than a ninth of all shingles are in one set alone
    apart = sum((F.bit_count(F.col(f"{p}_x").bitwiseXOR(F.col(f"{p}_y"))) for p in PARITIES), F.lit(0))
    close = 9 * apart <= F.col("n_x") + F.col("n_y")
    both = x.join(y, "h").where((F.col("fp_x") < F.col("fp_y")) & (F.col("root_x") != F.col("root_y")) & enough & close)
    return both.select(F.col("fp_x").alias("a"), F.col("fp_y").alias("b"))


def links(docs: DataFrame, sets: DataFrame, words: int = WORDS, key: str = "doc_id", rounds: int | None = None, first: DataFrame | None = None) -> DataFrame:
    """(a, b): links between distinct sets (key, fp, n, cells), whose components are those of all candidates' links.

    `first` are candidates (a, b) besides those that share a cell.
    """
    members = sets.select("fp", "n", F.explode("cells").alias("cell"))
    least = members.groupBy("cell").agg(F.min(F.struct("fp", "n")).alias("least"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = staged(members.join(least, "cell").select("cell", "fp", "n", "least"), "shared")
    rows = shared.count()
    ends = shared.select("fp")
    if first is not None:
        ends = ends.unionAll(first.select("a")).unionAll(first.select("b"))
    wanted = sets.join(ends.distinct(), "fp").select(F.col(key).alias("_id"), "fp")
    texts = only_columns(docs, key, "text").join(wanted, F.col(key) == F.col("_id")).select("text", "fp")
    shingles = staged(_shingles(texts, words).dropDuplicates(["fp"]), "shingles")
    stars = shared.where((F.col("fp") != F.col("least.fp")) & _like_sizes(F.col("n"), F.col("least.n"))).select(F.col("least.fp").alias("a"), F.col("fp").alias("b"))
    found = staged(verified(stars if first is None else stars.unionAll(first), shingles), "stars")
    now = _rooted(shared.select("cell", "fp", "n", (F.col("fp") == F.col("least.fp")).alias("led")), found, rows)
    forget(shared)
    for _ in range(ROUNDS if rounds is None else rounds):
        leaders = staged(_leaders(now), "leaders", rows)
        if not leaders.limit(1).count():
            forget(leaders)
            break
        pairs = now.join(leaders, "cell").where((F.col("root") != F.col("r")) & _like_sizes(F.col("n"), F.col("m"))).select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
        more = staged(found.unionAll(verified(pairs, shingles)), "stars")
        led = now.join(leaders.select(F.col("cell").alias("c"), "a"), (F.col("cell") == F.col("c")) & (F.col("fp") == F.col("a")), "left")
        following = _rooted(led.select("cell", "fp", "n", (F.col("led") | F.col("a").isNotNull()).alias("led")), more, rows)
        forget(found, now, leaders)
        found, now = more, following
    else:
        if _leaders(now).limit(1).count():
            found = found.unionAll(staged(verified(_by_rare_shingles(now, shingles), shingles), "rest"))
    forget(shingles, now)
    return found


def near_groups(docs: DataFrame, words: int = WORDS, key: str = "doc_id") -> DataFrame:
    """(key, print, root): one row for each row of `docs` with an id; rows of one root are near copies."""
    rows = staged(sketches(docs, words, key), "sketches")
    n = rows.count()
    sets = staged(rows.groupBy("fp").agg(F.min(F.struct(key, "n", "cells", "sim")).alias("s")).select("fp", "s.*"), "sets", n)
    first = staged(by_fingerprints(sets.select("fp", "sim")), "close_prints")
    roots = staged(components(links(docs, sets, words, key, first=first)), "roots", n)
    forget(sets, first)
    return rows.join(roots, F.col("fp") == F.col("node"), "left").select(key, F.col("fp").alias("print"), F.coalesce("root", "fp").alias("root"))


def deduplicated(docs: DataFrame, words: int = WORDS, key: str = "doc_id") -> DataFrame:
    """The rows of `docs`, of each group of near copies only the document with the smallest id."""
    return first_of_each(docs, near_groups(docs, words, key), lambda text: set_print(shingle_set(text, words)), key)
