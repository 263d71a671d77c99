"""A quality classifier trained by two views that teach each other.

One view reads a text's content: hashed words that occur in it and a few shares (capitals, punctuation, repetition).
The other reads what is known about the page without its text: source, language and length.  Both start from the
labelled rows.  In each round each view ranks unlabelled rows by its calibrated probability and hands the first of each
kind, good and bad in the proportion of the labels, to the other view's training set.  A handed label weighs as much as
the probability exceeds the kind's share among the labels (0 at the share, 1 at certainty), so a view that knows little
says little; below `floor` nothing is handed, and the rounds end when neither view hands anything.  Each view's log odds are
calibrated on labelled rows that no round saw, a logistic combination of the two is fitted on the same rows, and the
round whose combination has the least log loss there (ties: the earlier) gives the model that scores every document.
`Model.rounds` tells what was handed and that loss, round by round.

The fit's bounds are parameters: at most `max_labelled` labelled and `max_pool` unlabelled rows, the first by a hash of
their key.  Their features are made on the executors and trained on in one task of that bounded size.  Scoring is one
pass over all rows without a shuffle; the model, two weight vectors of fixed length, goes to every task.

A row is good if its quality label is 1 and no label calls it toxic; a label without a quality is ignored; several
labels of a row are joined to the worst.  Nulls, ties and the like: a null text is an empty one, null or missing page
columns count as such; rows with a null key are scored but not learned from; without labels of both kinds every score
is the share of good labels, or one half; ties in sureness go to the smaller key; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import HASH_BITS, hash_number, only_columns, staged
from plumbline.llm.decontaminate import PLAIN

WORDS, SHARES = 1 << 15, 8
#: Each share falls in one of this many steps, one feature each.
STEPS = 8
TEXT_SIZE = WORDS + SHARES * STEPS
PAGE_SIZE = 1 << 11
PAGE_COLUMNS = ("lang", "source", "n_chars")
#: Byte classes: 0 other, 1 capital, 2 small letter, 3 digit, 4 white space, 5 ASCII punctuation.
CLASS = np.array([5 if 33 <= b <= 126 else 4 if b in (9, 10, 11, 12, 13, 32) else 0 for b in range(256)], np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[48:58] = 1, 2, 3
#: Words whose buckets a task remembers; the memory is emptied when it is full.
REMEMBERED = 500_000


@dataclass
class Buckets:
    """Word to bucket, with a bounded memory."""

    known: dict[bytes, int] = field(default_factory=dict)

    def of(self, word: bytes) -> int:
        at = self.known.get(word)
        if at is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            at = self.known[word] = xxhash.xxh64_intdigest(word) % WORDS
        return at


def text_features(text: str | None, buckets: Buckets) -> np.ndarray:
    """The numbers of the features that a text has."""
    raw = (text or "").encode()
    words = raw.translate(PLAIN).split()
    distinct = set(words)
    kinds = np.bincount(CLASS[np.frombuffer(raw, np.uint8)], minlength=6)
    n, letters, solid = max(1, len(words)), max(1, int(kinds[1] + kinds[2])), max(1, len(raw) - int(kinds[4]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spread = 1.0 - len(distinct) / n
    shares = (
        kinds[1] / letters,
        3.0 * kinds[5] / solid,
        kinds[3] / solid,
        spread if n < 200 else spread / 2.0,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1.0 - len(set(lines)) / max(1, len(lines)),
        min(1.0, raw.count(b"!") / n),
        min(1.0, len(words) / 50.0),
    )
    steps = [WORDS + i * STEPS + min(STEPS - 1, int(min(1.0, s) * STEPS)) for i, s in enumerate(shares)]
    return np.array([*sorted({buckets.of(w) for w in distinct}), *steps], np.int32)


def page_features(values: tuple, names: tuple[str, ...]) -> np.ndarray:
    found = []
    for name, value in zip(names, values):
        if name == "n_chars" and value is not None:
            value = int(math.log2(value + 1)) if value >= 0 else -1
        found.append(xxhash.xxh64_intdigest(f"{name}={value!r}") % PAGE_SIZE)
    return np.array(sorted(set(found)) or [0], np.int32)


class Rows:
    """Binary features of rows, flat."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.at = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1])) if rows else np.zeros(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(w[self.at], self.starts) if len(self.sizes) else np.zeros(0)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.at, np.repeat(g, self.sizes), minlength=size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0)))


def telling(data: Rows, y: np.ndarray, trust: np.ndarray, size: int, least: int = 5, deviation: float = 3.0) -> np.ndarray:
    """The features of `least` rows or more whose frequency differs between good and bad rows by `deviation` standard errors.

    A row counts by its trust.
    """
    high, low = max(1.0, trust[y > 0].sum()), max(1.0, trust[y <= 0].sum())
    of_good, of_all = data.back(np.where(y > 0, trust, 0.0), size), data.back(trust, size)
    p = of_all / (high + low)
    error = np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1.0 / high + 1.0 / low))
    return (of_all >= least) & (np.abs(of_good / high - (of_all - of_good) / low) >= deviation * error)


def logistic_fit(rows: list[np.ndarray], y: np.ndarray, trust: np.ndarray, size: int, decay: float, steps: int = 150, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Logistic regression over the telling ones of binary features by full-batch Adam; both kinds of rows weigh alike."""
    data = Rows(rows)
    mask = telling(data, y, trust, size)
    weight = trust * np.where(y > 0, 0.5 / max(1.0, trust[y > 0].sum()), 0.5 / max(1.0, trust[y <= 0].sum()))
    w, b = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, steps + 1):
        g = (_sigmoid(data.dot(w) + b) - y) * weight
        gw, gb = np.where(mask, data.back(g, size) + decay * w, 0.0), float(g.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= rate * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return w, b


def combined_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (one for each column of x, then the offset) of P(y = 1); column weights are never negative."""
    z = np.column_stack([x, np.ones(len(y))])
    goal = np.where(y > 0, ((y > 0).sum() + 1.0) / ((y > 0).sum() + 2.0), 1.0 / ((y <= 0).sum() + 2.0))
    active = np.ones(z.shape[1], bool)
    for _ in range(z.shape[1]):
        w = np.zeros(z.shape[1])
        for _ in range(60):
            p = _sigmoid(z @ w)
            grad = z.T @ (p - goal) + 1e-3 * w
            curve = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + 1e-3 * np.eye(z.shape[1])
            w[active] -= np.linalg.solve(curve[np.ix_(active, active)], grad[active])
        below = (w < 0) & active
        below[-1] = False
        if not below.any():
            return w
        active &= ~below
    return w


@dataclass
class Model:
    """Two views and their combination.  Without a fit, `share` is every score."""

    share: float
    text: np.ndarray | None = None
    text_bias: float = 0.0
    page: np.ndarray | None = None
    page_bias: float = 0.0
    #: Calibration of each view (slope, offset), then the combination (text, page, offset).
    curves: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    #: One entry a round: (good, bad) labels that the text view and the page view handed over before it, the log loss of
    #: the combination on the held-back labels, and whether this round's fit is the model.
    rounds: list[dict] = field(default_factory=list)

    def scores(self, texts: list[np.ndarray], pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) by the text view, by the page view, and by both."""
        if self.curves is None:
            flat = np.full(len(texts), self.share)
            return flat, flat, flat
        a = Rows(texts).dot(self.text) + self.text_bias
        b = Rows(pages).dot(self.page) + self.page_bias
        ca, cb, both = self.curves
        a, b = ca[0] * a + ca[1], cb[0] * b + cb[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(both[0] * a + both[1] * b + both[2])


def _excess(p: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """How far P(good) is above the share of good labels, and P(bad) above that of bad ones, as parts of the way to certainty."""
    return (p - share) / (1.0 - share), (share - p) / share


def cotrained(texts: list[np.ndarray], pages: list[np.ndarray], labels: list[int | None], rounds: int, handed: int, floor: float) -> Model:
    """Fit both views.  Rows come in key order; labels are 1, 0 or None."""
    known = [i for i, x in enumerate(labels) if x is not None]
    y_all = np.array([labels[i] for i in known], float)
    share = float((y_all.sum() + 1.0) / (len(y_all) + 2.0)) if known else 0.5
    check = [i for j, i in enumerate(known) if j % 4 == 0]
    first = [i for j, i in enumerate(known) if j % 4]
    if any(len({labels[i] for i in part}) < 2 for part in (check, first)):
        return Model(share)
    pool = [i for i, x in enumerate(labels) if x is None]
    sets = [{i: (float(labels[i]), 1.0) for i in first} for _ in range(2)]
    views, sizes, decay = (texts, pages), (TEXT_SIZE, PAGE_SIZE), 1e-4
    goal = np.array([labels[i] for i in check], float)

    def train(v: int) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
        rows = sorted(sets[v])
        y, trust = np.array([sets[v][i] for i in rows]).T
        w, b = logistic_fit([views[v][i] for i in rows], y, trust, sizes[v], decay)
        margin = Rows([views[v][i] for i in check]).dot(w) + b
        curve = combined_curve(margin[:, None], goal)
        return w, b, curve, curve[0] * margin + curve[1]

    def hand_over(v: int, w: np.ndarray, b: float, curve: np.ndarray) -> tuple[int, int]:
        fresh = [i for i in pool if i not in sets[1 - v]]
        if not fresh:
            return 0, 0
        p = _sigmoid(curve[0] * (Rows([views[v][i] for i in fresh]).dot(w) + b) + curve[1])
        given = []
        for value, excess, most in zip((1.0, 0.0), _excess(p, share), (round(handed * share), round(handed * (1.0 - share)))):
            best = [j for j in np.argsort(-excess, kind="stable")[:most] if excess[j] >= floor]
            sets[1 - v].update({fresh[j]: (value, float(excess[j])) for j in best})
            given.append(len(best))
        return given[0], given[1]

    model, least, told, given = Model(share), math.inf, [], ((0, 0), (0, 0))
    for t in range(rounds + 1):
        (wa, ba, ca, ma), (wb, bb, cb, mb) = fits = train(0), train(1)
        x = np.column_stack([ma, mb])
        both = combined_curve(x, goal)
        p = np.clip(_sigmoid(x @ both[:-1] + both[-1]), 1e-12, 1.0 - 1e-12)
        loss = float(-np.mean(np.where(goal > 0, np.log(p), np.log(1.0 - p))))
        told.append({"by_text": given[0], "by_page": given[1], "loss": loss, "chosen": False})
        if loss < least:
            least, best = loss, t
            model = Model(share, wa, ba, wb, bb, (ca, cb, both))
        if t == rounds:
            break
        given = tuple(hand_over(v, *fits[v][:3]) for v in (0, 1))
        if not any(map(any, given)):
            break
    told[best]["chosen"] = True
    model.rounds = told
    return model


def _page_names(docs: DataFrame, names: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(n for n in names if n in docs.columns)


def _first_by_hash(rows: DataFrame, salt: str, most: int, key: str) -> DataFrame:
    """The `most` rows with the smallest hashes of their key.

    Only about twice as many pass a threshold on the hash, so tasks send few rows to be ordered, however many tasks.
    """
    h, n = hash_number(salt, F.col(key)), rows.count()
    likely = rows if n <= 2 * most else rows.where(h < float(1 << HASH_BITS) * 2.0 * most / n)
    return likely.orderBy(h, key).limit(most)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 6000, max_pool: int = 4000, rounds: int = 4, handed: int = 400, floor: float = 0.05, page_columns: tuple[str, ...] = PAGE_COLUMNS, key: str = "doc_id") -> Model:
    """Learn from the labelled rows of `docs` and a pool without labels; see the module's text for the bounds."""
    spark = docs.sparkSession
    good = ((F.min("quality") == 1) & (F.coalesce(F.max("toxic"), F.lit(0)) != 1)).cast("int")
    judged = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key).agg(good.alias("label"))
    marked = {r[0]: r[1] for r in _first_by_hash(judged, "labelled", max_labelled, key).collect()}
    named = docs.select(F.col(f"`{key}`").alias(key)).where(F.col(key).isNotNull())
    ids = {r[0] for r in _first_by_hash(named, "pool", max_pool, key).collect()}
    kind = docs.schema[key].dataType
    pool = spark.createDataFrame([(i,) for i in sorted(ids)], T.StructType([T.StructField(key, kind)]))
    ids -= {r[0] for r in labels.select(key).join(F.broadcast(pool), key, "left_semi").distinct().collect()}
    picks = [(i, x) for i, x in sorted(marked.items())] + [(i, None) for i in sorted(ids - set(marked))]
    chosen = spark.createDataFrame(picks, T.StructType([T.StructField(key, kind), T.StructField("label", T.IntegerType())]))
    names = _page_names(docs, page_columns)
    rows = only_columns(docs, key, "text", *names).join(F.broadcast(chosen), key).dropDuplicates([key])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            texts = [text_features(t, buckets).tobytes() for t in batch.column("text").to_pylist()]
            columns = [batch.column(n).to_pylist() for n in names]
            pages = [page_features(tuple(c[i] for c in columns), names).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("label"), pa.array(texts, pa.binary()), pa.array(pages, pa.binary())], [key, "label", "t", "p"])

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, kind="stable")
        texts, pages = ([np.frombuffer(x, np.int32) for x in group[c]] for c in ("t", "p"))
        m = cotrained(texts, pages, [None if pd.isna(x) else int(x) for x in group["label"]], rounds, handed, floor)
        blank = m.curves is None
        curves = b"" if blank else np.concatenate(m.curves).tobytes()
        return pd.DataFrame({"share": [m.share], "t": [b"" if blank else m.text.tobytes()], "tb": [m.text_bias], "p": [b"" if blank else m.page.tobytes()], "pb": [m.page_bias], "curves": [curves], "rounds": [json.dumps(m.rounds)]})

    vectored = staged(rows.mapInArrow(vectors, f"`{key}` {kind.simpleString()}, label int, t binary, p binary"), "quality_sample")
    found = vectored.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(train, "share double, t binary, tb double, p binary, pb double, curves binary, rounds string").collect()
    if not found or not found[0]["curves"]:
        return Model(found[0]["share"] if found else 0.5)
    r = found[0]
    c = np.frombuffer(r["curves"])
    return Model(r["share"], np.frombuffer(r["t"]), r["tb"], np.frombuffer(r["p"]), r["pb"], (c[:2], c[2:4], c[4:]), json.loads(r["rounds"]))


def scored(docs: DataFrame, model: Model, threshold: float = 0.5, page_columns: tuple[str, ...] = PAGE_COLUMNS, key: str = "doc_id") -> DataFrame:
    """(key, text_score, page_score, score, kept) for each row."""
    names = _page_names(docs, page_columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n).to_pylist() for n in names]
            pages = [page_features(tuple(c[i] for c in columns), names) for i in range(batch.num_rows)]
            a, b, both = model.scores([text_features(t, buckets) for t in batch.column("text").to_pylist()], pages)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= threshold)], [key, "text_score", "page_score", "score", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return only_columns(docs, *dict.fromkeys([key, "text", *names])).mapInArrow(run, f"`{key}` {kind}, text_score double, page_score double, score double, kept boolean")
