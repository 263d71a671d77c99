"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are normalised to words: A-Z in lower case, then runs of ASCII letters and digits or characters
beyond ASCII.  One automaton holds every run of words of every item, with its items.  Documents are streamed through it
word by word; its state gives the length of the longest run that ends here and occurs in an item, so one pass finds
all matches of `min_words` words or more, and all items shorter than that as a whole.  Words of matches are hits.

Each task builds the automaton from the items' words once.  Its size is bounded: items are dealt into packs of at most
`pack_words` words, and the documents are scanned pack by pack; a document's hits are then united.  A benchmark that
fits one pack, the usual case, needs one scan and no shuffle at all.  What is cut or dropped is the same for any packs.

Nulls, ties and the like: a null or empty text has no words and no hits; items without words match nothing; repeated
items count once by their id; items with a null id mark hits but are not listed; an item longer than a pack is a pack
by itself; an empty benchmark leaves all documents clean; other columns of the tables are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import forget, lower_ascii, only_columns, portions, staged, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of words to themselves, A-Z to a-z, all others to a space.  Bytes from 128 on belong to characters beyond ASCII.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Words of a match, unless the item has fewer.
MIN_WORDS = 10
#: Texts that are taken at a time.
BATCH = 256
#: Words of the items of one automaton.
PACK_WORDS = 200_000


class Automaton:
    """A suffix automaton of word sequences, with the items in which each long enough run occurs."""

    def __init__(self, items: list[tuple[object, list[bytes]]], min_words: int):
        self.min_words = min_words
        self.ids: dict[bytes, int] = {}
        self.go: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: dict[int, set[int]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        self.names = [name for name, _ in items]
        for number, (_, words) in enumerate(items):
            last = 0
            for word in words:
                last = self._add(last, self.ids.setdefault(word, len(self.ids)))
                ends.setdefault(last, set()).add(number)
        self._finish(items, ends, whole)

    def _add(self, last: int, word: int) -> int:
        """The state of the current item's run, made longer by one word."""
        go, link, size = self.go, self.link, self.len
        there = go[last].get(word)
        if there is not None:
            return there if size[there] == size[last] + 1 else self._split(last, word, there)
        new = self._state({}, 0, size[last] + 1)
        p = last
        while p >= 0 and word not in go[p]:
            go[p][word] = new
            p = link[p]
        if p >= 0:
            q = go[p][word]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: int, q: int) -> int:
        """A state of its own for the shorter runs of q."""
        copy = self._state(dict(self.go[q]), self.link[q], self.len[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.go[p].get(word) == q:
            self.go[p][word] = copy
            p = self.link[p]
        return copy

    def _state(self, go: dict[int, int], link: int, size: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.len.append(size)
        return len(self.len) - 1

    def _finish(self, items: list, ends: dict[int, set[int]], whole: dict[int, list[tuple[int, int]]]) -> None:
        """items_of: for states whose runs include one of min_words words, the items in which that run occurs.
        short: for each state the short items, with their length, that a run ending there can end with."""
        link, size = self.link, self.len
        by_length = sorted(range(1, len(size)), key=size.__getitem__, reverse=True)
        self.items_of: dict[int, frozenset[int]] = {}
        for v in by_length:
            here = ends.get(v, ())
            if size[v] >= self.min_words > size[link[v]]:
                self.items_of[v] = frozenset(here)
            elif size[v] >= self.min_words:
                ends.setdefault(link[v], set()).update(here)
        for number, (_, words) in enumerate(items):
            if 0 < len(words) < self.min_words:
                v = 0
                for word in words:
                    v = self.go[v][self.ids[word]]
                whole.setdefault(v, []).append((len(words), number))
        self.short: dict[int, list[tuple[int, int]]] = {}
        for v in reversed(by_length) if whole else ():
            found = whole.get(v, []) + self.short.get(link[v], [])
            if found:
                self.short[v] = found
        lengths = [len(words) for _, words in items if words]
        self.shortest = min([*lengths, self.min_words]) if lengths else 0

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """The word spans (start, end) that matches cover, the items met, and the longest match."""
        spans: list[list[int]] = []
        met: set[int] = set()
        longest = 0
        if not self.shortest:
            return [], met, 0
        least = self.min_words
        known = np.array([self.ids.get(w, -1) for w in words], np.int64)
        go, link, size, short, items_of = self.go, self.link, self.len, self.short, self.items_of
        for a, b in _runs(known >= 0, self.shortest):  # outside of these the automaton is at its start
            state = length = 0
            for i, word in enumerate(known[a:b].tolist(), a):
                while state and word not in go[state]:
                    state = link[state]
                    length = size[state]
                following = go[state].get(word)
                if following is None:
                    length = 0
                    continue
                state, length = following, length + 1
                if length > longest:
                    longest = length
                covers = 0
                if length >= least:
                    covers, at = length, state
                    while size[link[at]] >= least:
                        at = link[at]
                    met |= items_of[at]
                if short and state in short:
                    for n, number in short[state]:
                        if n <= length:
                            covers = max(covers, n)
                            met.add(number)
                if covers:
                    start = i + 1 - covers
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append([start, i + 1])
        return [(a, b) for a, b in spans], met, longest


def _runs(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of true values with at least `least` of them."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= least
    return list(zip(starts[long].tolist(), ends[long].tolist()))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(PLAIN).split()


def word_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in code points."""
    raw = text.encode()
    inside = np.frombuffer(raw.translate(PLAIN), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    points = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return points[edges[::2]], points[edges[1::2]]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the word spans; a line break stands for each, or nothing at either end."""
    starts, ends = word_places(text)
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at : starts[a]].rstrip())
        at = int(ends[b - 1])
    parts.append(text[at:].lstrip() if spans else text)
    return "\n".join(p for p in parts if p)


def packs(items: DataFrame, pack_words: int = PACK_WORDS, key: str = "item_id") -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with their words, in packs of at most `pack_words` words.

    Words are counted on the executors first; a benchmark beyond one pack is fetched in parts of about half a pack.
    """
    counted = F.regexp_count(lower_ascii(text_or_empty()), F.lit(WORD)).alias("n")
    rows = only_columns(items, key, "text").select(key, "text", counted).where("n > 0").distinct()
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = 1 if total <= pack_words else -(-2 * total // pack_words)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(key, "text"), F.lit(parts)))
    for i in range(parts):
        here: list[tuple[object, list[bytes]]] = []
        size = 0
        for row in sorted(dealt.where(F.col("part") == i).collect(), key=repr):
            if here and size + row["n"] > pack_words:
                yield here
                here, size = [], 0
            here.append((row[key], words_of(row["text"])))
            size += row["n"]
        if here:
            yield here


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
SPAN_TYPE = "array<struct<start:int,end:int>>"


def matches(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, pack_words: int = PACK_WORDS, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(key, n_words, n_hit, longest, spans, items) for each row of `docs`.

    spans are runs of hit words (start, end), counted in words from 0, end exclusive; items the sorted ids of the items
    with a match; longest the longest match in words.
    """
    id_type = items.schema[item_key].dataType
    id_arrow = pa.list_(to_arrow_type(id_type))
    rows = only_columns(docs, key, "text").select(
        key, "text", F.lit(0).cast("long").alias("n_words"), F.lit(0).alias("longest"), F.array().cast(SPAN_TYPE).alias("spans"), F.array().cast(f"array<{id_type.simpleString()}>").alias("items")
    )

    def scanner(pack: list[tuple[object, list[bytes]]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(pack, min_words)
            for batch in portions(batches, BATCH):
                counts, longest, spans, met = [], [], [], []
                for text, far, old, names in zip(*(batch.column(c).to_pylist() for c in ("text", "longest", "spans", "items"))):
                    words = words_of(text)
                    found, numbers, most = automaton.scan(words)
                    counts.append(len(words))
                    longest.append(max(far, most if found else 0))
                    spans.append([{"start": a, "end": b} for a, b in (_united([*found, *((s["start"], s["end"]) for s in old)]) if old else found)])
                    met.append(sorted({*names, *(automaton.names[n] for n in numbers if automaton.names[n] is not None)}))
                arrays = [batch.column(key), batch.column("text"), pa.array(counts, pa.int64()), pa.array(longest, pa.int32()), pa.array(spans, SPANS), pa.array(met, id_arrow)]
                yield pa.RecordBatch.from_arrays(arrays, [key, "text", "n_words", "longest", "spans", "items"])

        return run

    dealt, shape = packs(items, pack_words, item_key), rows.schema
    rows = rows.mapInArrow(scanner(next(dealt, [])), shape)
    for pack in dealt:  # one pack at a time is on the driver
        rows = staged(rows, "hits").mapInArrow(scanner(pack), shape)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(key, "n_words", hit.alias("n_hit"), "longest", "spans", "items")


def decontaminated(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, max_share: float = 0.5, pack_words: int = PACK_WORDS, item_key: str = "item_id") -> DataFrame:
    """`docs` with all matches cut out of their texts, and without the rows of which more than `max_share` is hit.

    A match is a run of `min_words` words or more that an item holds (the length limit), or a whole shorter item (the
    coverage limit).  What is left is scanned again until no match remains, as words on both sides of a cut can form a
    new one.  A column n_chars follows the text where it changes; all other columns stay.
    """
    columns, schema = docs.columns, docs.schema
    counted = "n_chars" in columns and schema["n_chars"].dataType.simpleString() in ("bigint", "int")

    def cutter(pack: list[tuple[object, list[bytes]]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(pack, min_words)
            for batch in portions(batches, BATCH):
                texts, sizes, cuts, keep = [], [], [], []
                for text in batch.column("text").to_pylist():
                    words = words_of(text)
                    spans = automaton.scan(words)[0]
                    keep.append(sum(b - a for a, b in spans) <= max_share * len(words))
                    cuts.append(bool(spans))
                    while spans:
                        text = without(text, spans)
                        spans = automaton.scan(words_of(text))[0]
                    texts.append(text)
                    sizes.append(len(text or ""))
                new = {"text": pa.array(texts, pa.string())}
                if counted:
                    old = batch.column("n_chars")
                    new["n_chars"] = pc.if_else(pa.array(cuts, pa.bool_()), pa.array(sizes, old.type), old)
                arrays = [new[c] if c in new else batch.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, columns).filter(pa.array(keep, pa.bool_()))

        return run

    dealt = packs(items, pack_words, item_key)
    first = next(dealt, None)
    if first is None:
        return docs
    second = next(dealt, None)
    if second is None:
        return docs.mapInArrow(cutter(first), schema)
    return _in_packs(docs, chain([first, second], dealt), lambda: packs(items, pack_words, item_key), min_words, max_share, counted)


def _in_packs(docs: DataFrame, dealt: Iterator[list], anew: Callable[[], Iterator[list]], min_words: int, max_share: float, counted: bool) -> DataFrame:
    """decontaminated() for items of many packs, which `dealt` and for each further round `anew` fetch one at a time.

    Each round unites the spans of all packs on one text and then cuts them at once; the first, on the original texts,
    decides which rows go.  So the rows are those that one pack would give.  Only texts cut last are scanned again.
    """
    columns, schema = docs.columns, docs.schema
    wide = T.StructType([*schema.fields, T.StructField("_open", T.BooleanType()), T.StructField("_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])

    def scanner(pack: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(pack, min_words)
            for batch in portions(batches, BATCH):
                spans = []
                for text, again, old in zip(*(batch.column(c).to_pylist() for c in ("text", "_open", "_spans"))):
                    found = automaton.scan(words_of(text))[0] if again else []
                    spans.append([{"start": a, "end": b} for a, b in _united([*found, *((s["start"], s["end"]) for s in old)])])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, SPANS)], batch.schema.names)

        return run

    def cutter(judge: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in portions(batches, BATCH):
                texts, sizes, cuts, keep = [], [], [], []
                for text, found in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist()):
                    spans = [(s["start"], s["end"]) for s in found]
                    keep.append(not judge or sum(b - a for a, b in spans) <= max_share * len(words_of(text)))
                    cuts.append(bool(spans))
                    texts.append(without(text, spans) if spans else text)
                    sizes.append(len(texts[-1] or ""))
                cut = pa.array(cuts, pa.bool_())
                new = {"text": pa.array(texts, pa.string()), "_open": cut, "_spans": pa.array([[]] * len(texts), SPANS)}
                if counted:
                    old = batch.column("n_chars")
                    new["n_chars"] = pc.if_else(cut, pa.array(sizes, old.type), old)
                arrays = [new[c] if c in new else batch.column(c) for c in wide.names]
                yield pa.RecordBatch.from_arrays(arrays, wide.names).filter(pa.array(keep, pa.bool_()))

        return run

    rows, before, judge = docs.select("*", F.lit(True).alias("_open"), F.array().cast(SPAN_TYPE).alias("_spans")), None, True
    while True:
        for pack in dealt:
            rows = staged(rows.mapInArrow(scanner(pack), wide), "hits")
            if before is not None:
                forget(before)
            before = rows
        if not rows.where(F.size("_spans") > 0).limit(1).count():
            return rows.select(*columns)
        rows, dealt, judge = rows.mapInArrow(cutter(judge), wide), anew(), False
