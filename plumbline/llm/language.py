"""Language identification in two steps: the family first, then one-versus-one linear support vector machines in it.

A text's features are counts of its letters' byte n-grams (non-letters are word breaks), hashed into a fixed number of
buckets, square-rooted and scaled to length one, over the whole text.  A pair classifier is a linear support vector
machine with a logistic curve on its margin, fitted on rows that its weights did not see.  Pairs of families decide the
family, pairs of its languages the language; the side with the largest mean probability against the others wins, and
the score is the product of both steps' means.

Learning: at most `per_language` labelled rows of each language, the first by a hash of their key, are the sample (the
documented bound of the fit); features are made on the executors, each pair is trained as one group of at most
2 * `per_class` rows, and the driver gets one weight vector for each pair.  Prediction is a narrow pass without a
shuffle and sees the text only.

Nulls, ties and the like: rows with a null key, language or text, or without a letter, are not learned from; a null
text or one without a letter is `und` with score 0, and so is every text if nothing could be learned; ties go to the
name that sorts first; a single language or family wins with 1; languages without a known family form families of
their own; repeated rows count as often as they occur, within the bound.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import HASH_BITS, hash_number, only_columns, portions, staged

UNKNOWN = "und"
#: Families by ISO 639-1 code.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "is", "nl", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "baltic": ("lt", "lv"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
    "iranian": ("fa", "ku", "ps"),
    "semitic": ("am", "ar", "he", "mt"),
    "dravidian": ("kn", "ml", "ta", "te"),
    "austronesian": ("id", "jv", "ms", "tl"),
    "sinitic": ("zh",),
    "celtic": ("br", "cy", "ga", "gd"),
}
GRAMS = (2, 3, 4)
BUCKETS = 4096
SIZE = BUCKETS * len(GRAMS)
#: Bytes of a text that are counted at a time.
CHUNK = 1 << 20
#: ASCII letters to themselves, other ASCII to a space; bytes beyond ASCII stay.
LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BATCH = 256


def family_of(lang: str, families: Mapping[str, tuple[str, ...]] = FAMILIES) -> str:
    return next((f for f, members in families.items() if lang in members), f"family of {lang}")


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: str) -> np.ndarray:
    """The unit vector of a text's n-gram counts."""
    raw = b" " + b" ".join(text.lower().encode().translate(LETTERS).split()) + b" "
    counts = np.zeros(SIZE)
    longest = max(GRAMS)
    for start in range(0, max(1, len(raw) - 1), CHUNK):
        part = np.frombuffer(raw[start : start + CHUNK + longest - 1], np.uint8).astype(np.uint32)
        room = min(CHUNK, len(raw) - start)
        gram = part
        for n in range(2, longest + 1):
            if len(part) < n:
                break
            gram = gram[: len(part) - n + 1] * np.uint32(0x9E3779B1) + part[n - 1 :]
            if n in GRAMS:
                at = GRAMS.index(n) * BUCKETS
                mixed = (gram[:room] * np.uint32(0x85EBCA6B)) >> np.uint32(20)
                counts[at : at + BUCKETS] += np.bincount(mixed, minlength=BUCKETS)
    counts = np.sqrt(counts)
    norm = math.sqrt(float(counts @ counts))
    return (counts / norm if norm else counts).astype(np.float32)


def support_vector_machine(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with hinge loss, by dual coordinate descent over the Gram matrix; y is -1 or 1.

    The rarer side's rows weigh more, so that both sides count alike.
    """
    sides = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    most = c * len(y) / (2.0 * sides)
    gram = (x @ x.T + 1.0) * np.outer(y, y)
    alpha, margin, diagonal = np.zeros(len(y)), np.zeros(len(y)), np.diag(gram).copy()
    order = np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            new = min(max(alpha[i] + (1.0 - margin[i]) / diagonal[i], 0.0), most[i])
            step = new - alpha[i]
            if step:
                margin += step * gram[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return ((alpha * y) @ x).astype(np.float32), float((alpha * y).sum())


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y = 1) over the margin, with smoothed targets; the slope is never negative."""
    high, low = (y > 0).sum(), (y < 0).sum()
    goal = np.where(y > 0, (high + 1.0) / (high + 2.0), 1.0 / (low + 2.0))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        g, w = p - goal, np.maximum(p * (1 - p), 1e-9)
        h11, h12, h22 = (w * margin * margin).sum() + 1e-6, (w * margin).sum(), w.sum() + 1e-6
        g1, g2 = (g * margin).sum(), g.sum()
        det = h11 * h22 - h12 * h12
        slope, offset = slope - (h22 * g1 - h12 * g2) / det, offset - (h11 * g2 - h12 * g1) / det
    return (slope, offset) if slope > 0 and math.isfinite(slope + offset) else (1.0, 0.0)


class Model:
    """Pair classifiers of families and of the languages of each family."""

    def __init__(self, languages: list[str], pairs: dict[tuple[str, str, str], tuple[np.ndarray, float, float, float]], families: Mapping[str, tuple[str, ...]]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(languages):
            self.families.setdefault(family_of(lang, families), []).append(lang)
        self.keys = sorted(pairs)
        self.weights = np.array([pairs[k][0] for k in self.keys], np.float32).reshape(-1, SIZE)
        self.rest = np.array([pairs[k][1:] for k in self.keys]).reshape(-1, 3)
        self.place = {k: i for i, k in enumerate(self.keys)}

    def _best(self, step: str, names: list[str], p: np.ndarray) -> tuple[str, float]:
        best, most = names[0], -1.0
        for name in names:
            wins = [p[self.place[step, name, o]] if name < o else 1.0 - p[self.place[step, o, name]] for o in names if o != name]
            mean = sum(wins) / len(wins) if wins else 1.0
            if mean > most:
                best, most = name, float(mean)
        return best, most

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if self.families and has_letter(t)]
        for start in range(0, len(known), BATCH):
            part = known[start : start + BATCH]
            margins = np.array([features(texts[i]) for i in part]) @ self.weights.T + self.rest[:, 0]
            chance = 1.0 / (1.0 + np.exp(-np.clip(self.rest[:, 1] * margins + self.rest[:, 2], -30, 30)))
            for i, p in zip(part, chance):
                family, sure = self._best("family", sorted(self.families), p)
                langs[i], within = self._best("language", self.families[family], p)
                scores[i] = min(1.0, max(0.0, sure * within))
        return langs, scores


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = 500, per_class: int = 600, families: Mapping[str, tuple[str, ...]] = FAMILIES, key: str = "doc_id") -> Model:
    """Learn from the rows of `docs` with a language; see the module's text for the bounds."""
    rows = only_columns(docs, key, "text", "lang").where(F.col(key).isNotNull() & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    sizes = {r["lang"]: r["count"] for r in docs.where(F.col(key).isNotNull() & F.col("lang").isNotNull()).groupBy("lang").count().collect()}
    # about twice the rows wanted pass by their hash, so that few texts are shuffled to be ranked
    passing = [F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * per_language / n))) for lang, n in sorted(sizes.items()) if n > 2 * per_language]
    h = hash_number("lang", F.col(key))
    likely = rows.where(h < F.coalesce(*passing, F.lit(1.0)) * float(1 << HASH_BITS))
    turn = F.row_number().over(W.partitionBy("lang").orderBy(h, key, "text"))
    sample = likely.withColumn("turn", turn).where(F.col("turn") <= per_language)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, BATCH):
            xs = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("turn"), pa.array(xs, pa.binary())], ["lang", "turn", "x"])

    vectored = staged(sample.mapInArrow(vectors, "lang string, turn int, x binary"), "language_sample")
    languages = sorted(r[0] for r in vectored.select("lang").distinct().collect())
    homes = {lang: family_of(lang, families) for lang in languages}
    everyone = sorted(set(homes.values()))
    members = {f: sum(h == f for h in homes.values()) for f in everyone}
    roles = []
    for lang in languages:
        home = homes[lang]
        share = max(1, per_class // members[home])
        for a, b in itertools.combinations(everyone, 2):
            if home in (a, b):
                roles.append((lang, "family", a, b, 1 if home == a else -1, share))
        for a, b in itertools.combinations([x for x in languages if homes[x] == home], 2):
            if lang in (a, b):
                roles.append((lang, "language", a, b, 1 if lang == a else -1, per_class))
    pairs: dict[tuple[str, str, str], tuple[np.ndarray, float, float, float]] = {}
    if roles:
        table = docs.sparkSession.createDataFrame(roles, "lang string, step string, a string, b string, y int, most int")

        def train(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["turn", "lang"], kind="stable")
            x = np.frombuffer(b"".join(group["x"]), np.float32).reshape(len(group), SIZE)
            y, seen = group["y"].to_numpy(float), group["turn"].to_numpy() % 5 != 0
            if len(set(y[seen])) < 2 or len(set(y[~seen])) < 2:
                seen = np.ones(len(y), bool)
            w, bias = support_vector_machine(x[seen], y[seen])
            check = ~seen if not seen.all() else seen
            slope, offset = logistic_curve(x[check] @ w + bias, y[check])
            first = group.iloc[0]
            return pd.DataFrame({"step": [first["step"]], "a": [first["a"]], "b": [first["b"]], "w": [w.tobytes()], "bias": [bias], "slope": [slope], "offset": [offset]})

        dealt = vectored.join(F.broadcast(table), "lang").where(F.col("turn") <= F.col("most"))
        found = dealt.groupBy("step", "a", "b").applyInPandas(train, "step string, a string, b string, w binary, bias double, slope double, offset double")
        pairs = {(r["step"], r["a"], r["b"]): (np.frombuffer(r["w"], np.float32), r["bias"], r["slope"], r["offset"]) for r in found.collect()}
    return Model(languages, pairs, families)


def predicted(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns `keep` of `docs`, or all of them, with lang_pred and score at the end; such columns give way."""
    names = [c for c in (keep or docs.columns) if c.lower() not in ("lang_pred", "score")]
    fields = [docs.schema[c] for c in names]
    rows = only_columns(docs, *dict.fromkeys([*names, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, BATCH):
            langs, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    out = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, out)


def identified(docs: DataFrame, per_language: int = 500, key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score): a model of the rows that are not held out, applied to all rows."""
    model = fit(docs.where(~held_out(key)), per_language, key=key)
    return predicted(docs, model, key).select(key, held_out(key).alias("held_out"), "lang_pred", "score")


def readable(docs: DataFrame, min_score: float = 0.35, per_language: int = 500, key: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose language is recognised with at least `min_score`, with their own columns."""
    model = fit(docs.where(~held_out(key)), per_language, key=key)
    marked = predicted(docs, model)
    return marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
