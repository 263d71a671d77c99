"""Spelling variants: words one edit apart, found by composing finite-state machines.

Words are runs of letters of a text, with A-Z in lower case, that occur often enough in all texts.  Two words are near if
one inserted, deleted or replaced code point makes one of the other.  With A the minimised acceptor of the vocabulary
and T the transducer of one edit, the near pairs are what A o T o A accepts.  Both tapes copy the same letters until
the edit, so the composition is on its diagonal (q, q) up to the edit and in a state (s, t) after it, where both
sides read the same letters to their ends.  The edit is taken where the two words first differ, so each pair has one path.

The pairs are enumerated by initial state.  A state reached by few letters has a large right language, too large
for one task; so a prefix whose words have over `limit` letters is composed by a shuffle: every word leaves it by the edit arc
(the word without the letter after the prefix, next to that letter) or as it is, and two words that agree in what is left
are near.  Such a group has at most one word for each letter and one more.  Prefixes below the limit are tasks of their own: a
task builds the minimised acceptor of its words, walks the composition once for each of its states, however many
prefixes lead there, and numbers words by their rank in the acceptor.  The prefixes that branch are taken level by level;
common beginnings are jumped over.

Neither way writes pairs: each word gets the number of its near words and the most frequent one.  A word's form is that one
if it occurs at least `ratio` times as often, and its root is found by doubling along forms (a chain is as long as its
logarithm).  Words are counted in each task with a memory of bounded size before they are shuffled.

Nulls, ties and the like: a null text has no words, a null id counts as an empty one; repeated rows count as often as
they occur; equal counts go to the word that comes first in code points; a word of any length is compared whole; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import forget, only_columns, staged

LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One occurrence in so many, by a hash of document and word, loses a letter.
SLIP = 31
#: Letters of the words of one task.
LIMIT = 1 << 18
#: Words that a task counts before it passes them on, texts that it takes at a time.
REMEMBERED, BATCH = 200_000, 256
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
LETTERS = "a-zÀ-ÿ"


def slipped(doc_id: object, word: str) -> str:
    """The word, without one of its letters if its hash in this document says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % SLIP:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def words_of(text: str | None, least: int = LEAST_LENGTH) -> list[str]:
    """The lower-cased runs of letters with `least` letters or more."""
    return re.findall(f"[{LETTERS}]{{{least},}}", (text or "").encode().translate(LOWER).decode())


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, key: str = "doc_id") -> DataFrame:
    """(word, n): the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                for doc_id, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist()):
                    for word, n in Counter(words_of(text, least_length)).items():
                        if len(word := slipped(doc_id, word)) >= least_length:
                            found[word] += n
                    if len(found) >= REMEMBERED:
                        yield rows()
        yield rows()

    counted = only_columns(docs, key, "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Acceptor:
    """The minimal acceptor of sorted distinct words.  States are numbered so that arcs lead to lower numbers."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        #: By state: letter to (next state, words of this state that come before those of the arc).
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.count: list[int] = []
        #: By state: bit l is set if a word with l more letters, modulo 64, is accepted.
        self.lengths: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list, bool]] = [([], False)]
        last = ""

        def close(depth: int) -> int:
            while True:
                arcs, final = path.pop()
                state = known.setdefault((final, *arcs), len(self.final))
                if state == len(self.final):
                    self._add(arcs, final)
                if len(path) == depth:
                    return state
                path[-1][0].append((last[len(path) - 1], state))

        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            if len(path) > same + 1:
                state = close(same + 1)
                path[same][0].append((last[same], state))
            path += [([], False) for _ in word[same:]]
            path[-1] = (path[-1][0], True)
            last = word
        self.start = close(0)

    def _add(self, arcs: list[tuple[str, int]], final: bool) -> None:
        at, lengths, numbered = int(final), int(final), {}
        for letter, state in arcs:
            numbered[letter] = (state, at)
            at += self.count[state]
            lengths |= (self.lengths[state] << 1 | self.lengths[state] >> 63) & (1 << 64) - 1
        self.final.append(final)
        self.arcs.append(numbered)
        self.count.append(at)
        self.lengths.append(lengths)

    def common(self, s: int, t: int, i: int, j: int, skip: str, out: list[tuple[int, int, int]]) -> None:
        """Adds (i + rank in s, j + rank in t, run) for the words of both s and t, runs of consecutive ranks at once.

        Words that begin with `skip` are left out.
        """
        todo = [(s, t, i, j, skip)]
        while todo:
            s, t, i, j, skip = todo.pop()
            if not self.lengths[s] & self.lengths[t]:
                continue
            if s == t and not skip:
                out.append((i, j, self.count[s]))
                continue
            if self.final[s] and self.final[t]:
                out.append((i, j, 1))
            one, two = self.arcs[s], self.arcs[t]
            for letter in one if len(one) <= len(two) else two:
                if letter in one and letter in two and letter != skip:
                    (u, m), (v, n) = one[letter], two[letter]
                    todo.append((u, v, i + m, j + n, ""))

    def edits(self, q: int) -> list[tuple[int, int, int]]:
        """Runs of ranks (in q, in q, length) of the near pairs whose words first differ in state q."""
        out: list[tuple[int, int, int]] = []
        arcs = list(self.arcs[q].items())
        for at, (letter, (s, i)) in enumerate(arcs):
            for _, (t, j) in arcs[at + 1 :]:
                self.common(s, t, i, j, "", out)
            self.common(s, q, i, 0, letter, out)
        return out

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ranks of all near pairs, a block for each state in which words first differ."""
        bases: list[list[int]] = [[] for _ in self.final]
        bases[self.start].append(0)
        for q in range(len(self.final) - 1, -1, -1):
            here, bases[q] = np.array(bases[q], np.int64), []
            for s, at in self.arcs[q].values():
                bases[s].extend((here + at).tolist())
            if found := self.edits(q):
                i, j, run = np.array(found, np.int64).T
                step = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
                i, j = np.repeat(i, run) + step, np.repeat(j, run) + step
                yield (here[:, None] + i).ravel(), (here[:, None] + j).ravel()


def nearest_words(words: list[str], counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many of the sorted words are near each word, and the number of the most frequent of them (or -1)."""
    order = np.lexsort((np.arange(len(words)), -np.array(counts, np.int64)))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    for i, j in Acceptor(words).pairs():
        for a, b in ((i, j), (j, i)):
            np.add.at(near, a, 1)
            np.minimum.at(best, a, place[b])
    return near, np.append(order, -1)[best]


def _within(words: DataFrame) -> DataFrame:
    """Near words of (word, n, prefix) among the words of one prefix, a task each.

    `best` tells a near word as its count, negative, and itself, so that the smallest is the one wanted.
    """

    def run(group: pa.Table) -> pa.Table:
        counted = dict(zip(group.column("word").to_pylist(), group.column("n").to_pylist()))
        names = sorted(counted)  # by code points
        near, best = nearest_words(names, [counted[w] for w in names])
        met = np.flatnonzero(near).tolist()
        others = [names[best[i]] for i in met]
        arrays = [pa.array([names[i] for i in met], pa.string()), pa.array(near[met]), pa.array([-counted[o] for o in others], pa.int64()), pa.array(others, pa.string())]
        return pa.table(arrays, ["word", "n_near", "m", "w"])

    found = words.groupBy("prefix").applyInArrow(run, "word string, n_near long, m long, w string")
    return found.select("word", "n_near", F.struct(F.col("m").alias("m"), F.col("w").alias("word")).alias("best"))


def _across(words: DataFrame) -> DataFrame:
    """Near words of (word, n, k) that first differ after k letters, the prefix being the same: by the rest of the word."""
    edited = words.where(F.length("word") > F.col("k")).select(
        "k", F.concat(F.expr("substring(word, 1, k)"), F.expr("substring(word, k + 2)")).alias("rest"), F.struct(F.expr("substring(word, k + 1, 1)").alias("letter"), "word", "n").alias("m")
    )
    plain = words.select("k", F.col("word").alias("rest"), F.struct(F.lit(None).cast("string").alias("letter"), "word", "n").alias("m"))
    groups = edited.unionAll(plain).groupBy("k", "rest").agg(F.collect_list("m").alias("members")).where(F.size("members") > 1)  # a letter each and one more
    follows = F.expr("substring(rest, k + 1, 1)")

    def near(m, o):
        inserted = m["letter"].isNull() | o["letter"].isNull()
        return (o["word"] != m["word"]) & ~(inserted & (F.coalesce(m["letter"], o["letter"]) == F.col("follows")))

    one = groups.withColumn("follows", follows).select("follows", "members", F.explode("members").alias("m"))
    found = one.select(F.col("m.word").alias("word"), F.filter("members", lambda o: near(F.col("m"), o)).alias("near")).where(F.size("near") > 0)
    return found.select("word", F.size("near").cast("long").alias("n_near"), F.array_min(F.transform("near", lambda o: F.struct((-o["n"]).alias("m"), o["word"].alias("word")))).alias("best"))


def near_words(vocabulary: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(word, n_near, best) for the words of (word, n) that have near ones; a word may have several rows."""
    now = vocabulary.select("word", "n", F.lit("").alias("prefix"))
    found, frames = None, []
    while True:
        groups = now.groupBy("prefix").agg(F.sum(F.length("word")).alias("letters"), F.count(F.lit(1)).alias("words"), F.min("word").alias("low"), F.max("word").alias("high"))
        shared = F.size(F.filter(F.sequence(F.lit(1), F.length("low")), lambda i: F.substring("low", F.lit(1), i) == F.substring("high", F.lit(1), i)))
        groups = staged(groups.where("words > 1").select("prefix", (F.col("letters") > limit).alias("large"), F.when(F.col("letters") > limit, shared).alias("k")), "prefixes")
        dealt = staged(now.join(groups, "prefix"), "dealt")
        frames += [groups, dealt]
        part = _within(dealt.where("NOT large").select("word", "n", "prefix"))
        found = part if found is None else found.unionAll(part)
        if not groups.where("large").limit(1).count():
            return staged_and_forgotten(found, frames)
        large = dealt.where("large").select("word", "n", "k")
        found = found.unionAll(_across(large))
        now = large.select("word", "n", F.expr("substring(word, 1, k + 1)").alias("prefix"))


def staged_and_forgotten(found: DataFrame, frames: list[DataFrame]) -> DataFrame:
    out = staged(found, "near_words")
    forget(*frames)
    return out


def _with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), by doubling."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = staged(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(now)
        now = following
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, limit: int = LIMIT, key: str = "doc_id") -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of the vocabulary."""
    vocabulary = staged(word_counts(docs, least_length, least_count, key), "vocabulary")
    met = near_words(vocabulary, limit)
    none = vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<m:long,word:string>").alias("best"))
    every = none.unionAll(met.select("word", F.lit(None).cast("long").alias("n"), "n_near", "best"))
    summed = every.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    often = -F.col("best.m") >= ratio * F.col("n")
    words = staged(summed.select("word", "n", "n_near", F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.m")).alias("form_n")), "words")
    roots = _with_roots(words.where("form IS NOT NULL"))
    forget(vocabulary, met)
    return words.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants_sql(source: str, crc: str, tables: str) -> str:
    """variants() in DuckDB's SQL.  `crc` gives the checksum of `s`, for which `tables` are common tables."""
    return f"""WITH RECURSIVE {tables},
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[{LETTERS}]+')) AS w FROM {source}) GROUP BY doc_id, w),
hashed AS (SELECT w, n, {crc} AS h FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || w AS s FROM runs WHERE length(w) >= {LEAST_LENGTH}), crc_table),
said AS (SELECT CASE WHEN h % {SLIP} = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, n FROM hashed),
vocabulary AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM said WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocabulary b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocabulary b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= {RATIO} * n THEN other END AS form, CASE WHEN m >= {RATIO} * n THEN m END AS form_n FROM vocabulary LEFT JOIN best USING (word)),
chain AS (SELECT word, coalesce(form, word) AS root FROM formed UNION SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, n, n_near, form, form_n, root FROM formed JOIN roots USING (word)"""
