"""Near-duplicate documents by SimHash fingerprints and multi-index hashing.

A document's words, with A-Z in lower case, give word shingles (repeats count); each shingle's XXH64 votes on 64 bits,
and a bit is set if it is set in over half of the hashes.  Documents link if their fingerprints differ in at most two
bits; components of links are groups.

The search works on distinct fingerprints, so copies cost nothing.  Each fingerprint has two segments of 32 bits, and
each segment a table from its value to fingerprints.  Two fingerprints within two bits are within one bit in the first
segment or equal in the second: so 33 probes of the first table and one of the second find every partner, and the
complete distance is verified.  A table cell can hold any number of fingerprints (near copies that share half of their
bits); pairs within a cell would grow with its square.  Cells beyond CELL_LIMIT are therefore left out of the tables
and their fingerprints, all of them, emit the ball of radius one round themselves: two fingerprints are within two
bits if and only if their balls meet, a meeting point has at most 65 of them, and linking those to their smallest keeps
every component.  A pair is missed by the tables only if both ends lie in full cells, so the two ways cover all pairs.

Nulls, ties and the like: a null text, or one without words, has fingerprint zero and links like any other; fewer words
than a shingle has make one shingle; rows with a null id keep their fingerprint and take the component of their
fingerprint's smallest id; rows that share an id count as one document in the ids; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import forget, only_columns, staged, text_rows
from plumbline.llm.components import components, first_of_each

BITS = 64
SEED = 42
#: The largest distance of a link.  Two segments of 32 bits are made for it.
RADIUS = 2
SEGMENT = 32
#: Fingerprints in one table cell beyond which the cell is searched by balls instead.
CELL_LIMIT = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many of the 64-bit hashes each bit is set, lowest bit first."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:  # sums of 255 bits fit in a byte
            total += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return total


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The hashes of the text's shingles; repeats count."""
    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        spans = [(0, len(joined))]
    else:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.cumsum(sizes + 1) - 1
        spans = zip((ends - sizes)[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str | None, words: int) -> int:
    """The SimHash of one text as a signed 64-bit number."""
    hashes = shingle_hashes(text, words)
    set_bits = 2 * bit_counts(hashes) > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) of every row: a narrow projection, with texts handled one at a time in Arrow batches."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t, words) for [texts] in text_rows([batch], "text") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(prints, pa.int64())], [key, "fingerprint"])

    return only_columns(docs, key, "text").mapInArrow(run, f"`{key}` {kind}, fingerprint long")


def _segments(fp: Column) -> list[Column]:
    return [F.shiftrightunsigned(fp, SEGMENT), fp.bitwiseAND(F.lit((1 << SEGMENT) - 1))]


def _ball(value: Column, bits: int) -> Column:
    """The values within one bit of `value`, itself included."""
    masks = [0, *[(1 << i) - (1 << 64 if i == 63 else 0) for i in range(bits)]]
    return F.array(*[value.bitwiseXOR(F.lit(m).cast("long")) for m in masks])


def close_links(prints: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` whose components are those of all pairs within two bits."""
    first, second = _segments(F.col("fp"))
    table = prints.select("fp", F.posexplode(F.array(first, second)).alias("seg", "cell"))
    counts = table.groupBy(F.col("seg").alias("s"), F.col("cell").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    full = staged(counts.where(F.col("n") > CELL_LIMIT).select("s", "c"), "full_cells")
    on_cell = (F.col("seg") == F.col("s")) & (F.col("cell") == F.col("c"))
    open_cells = table.join(full, on_cell, "left_anti").select(F.col("fp").alias("b"), "seg", "cell")
    probes = prints.select(F.col("fp").alias("a"), F.explode(_ball(first, SEGMENT)).alias("p")).select("a", F.lit(0).alias("s"), "p").unionAll(
        prints.select(F.col("fp").alias("a"), F.lit(1).alias("s"), second.alias("p"))
    )
    hits = probes.join(open_cells, (F.col("s") == F.col("seg")) & (F.col("p") == F.col("cell")))
    verified = hits.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    crowded = table.join(full, on_cell, "left_semi").select("fp").distinct()
    balls = crowded.select("fp", F.explode(_ball(F.col("fp"), BITS)).alias("point"))
    met = balls.groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("near")).where(F.size("near") > 1)
    stars = met.select(F.col("near")[0].alias("a"), F.explode(F.slice("near", 2, BITS + 1)).alias("b"))
    return verified.unionAll(stars)


def _grouped(docs: DataFrame, words: int, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, fingerprint) of every row, and (fp, root, component_id) of every fingerprint, both staged."""
    rows = staged(fingerprints(docs, words, key), "fingerprints")
    prints = staged(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min(key).alias("least")), "prints")
    roots = staged(components(close_links(prints.select("fp"))), "roots")
    grouped = prints.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(grouped.join(least, "root").select("fp", "root", "component_id"), "named")
    forget(prints, roots)
    return rows, named


def near_duplicates(docs: DataFrame, words: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id): one row for each row of `docs`.

    component_id is the smallest key that links reach, the row's own included.  Fingerprints are staged; links,
    components and joins move only numbers.
    """
    rows, named = _grouped(docs, words, key)
    return rows.join(named, F.col("fingerprint") == F.col("fp"), "left").select(key, "fingerprint", "component_id")


def deduplicated(docs: DataFrame, words: int = 3, key: str = "doc_id") -> DataFrame:
    """The rows of `docs`, of each component only those of its smallest (key, fingerprint), as one document.

    Rows with a null key always stay; a key that repeats with unlike texts stays with each of them.
    """
    rows, named = _grouped(docs, words, key)
    found = rows.join(named, F.col("fingerprint") == F.col("fp")).select(key, F.col("fp").alias("print"), "root")
    return first_of_each(docs, found, lambda text: fingerprint(text, words), key)
