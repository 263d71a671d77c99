"""Quality rules combined by weak supervision.

Each rule reads a text's counts and votes good (1), bad (-1) or abstains (0).  The rules' accuracies are unknown, on
good texts as well as on bad ones, and so is the share of good texts; expectation-maximisation estimates them from the
votes alone: given accuracies, every pattern of votes has a posterior probability of being good; given posteriors, a
rule's two accuracies are how often it votes good on good texts and bad on bad ones.  A rule that calls nearly
everything good thus says little by a good vote and much by a bad one.  A text is kept if its posterior reaches a
threshold, so one doubtful rule no longer decides alone.

The counts are one projection with built-in functions.  The fit runs over the table of vote patterns, which covers all
rows and has at most 3 ** rules of them whatever the input; each round is one small aggregate over it, and one row of
sums comes back.  The rest is a projection again.

Nulls, ties and the like: a null text has no words, fails the base rule and is not kept; a rule that never votes keeps
its first accuracies; accuracies stay within bounds so that no rule is trusted blindly or turned round; repeated rows
count as often as they occur; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WHITE, let, staged, text_or_empty

WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Conditions over the counts, in SQL; bad wins if both hold."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 10", "n_words >= 40"),
    Rule("word_length", "word_chars > 15 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines AND n_lines > 0"),
    Rule("repetition", "100 * n_repeat_words > 20 * n_words", "100 * n_repeat_words <= 5 * n_words"),
    Rule("capitals", "10 * n_upper > 3 * word_chars", "10 * n_upper <= word_chars"),
    Rule("shouting", "5 * n_exclaim > n_words", "50 * n_exclaim <= n_words"),
    Rule("digits", "10 * n_digits > 3 * word_chars", "10 * n_digits <= word_chars"),
    Rule("punctuation", "100 * n_punctuation > 12 * word_chars", "100 * n_punctuation <= 7 * word_chars"),
    Rule("letters", "100 * (n_punctuation + n_digits) > 18 * word_chars", "100 * (n_punctuation + n_digits) <= 10 * word_chars"),
)
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
ROUNDS = 25
#: Where the fit begins: the share of good texts, a rule's accuracy on good texts and on bad ones.
FIRST = {"share": 0.85, "good": 0.95, "bad": 0.3}
BOUNDS = {"share": (0.05, 0.99), "good": (0.5, 0.999), "bad": (0.02, 0.98)}
#: ASCII characters that are neither letters, digits, white space nor control characters.
PUNCTUATION = r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E"


def _left(text: Column, other: str) -> Column:
    """How many characters are left when those of the class `other` go."""
    return F.length(F.regexp_replace(text, other, "")).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside windows of five words that the text has twice or more, all of a window's occurrences included.

    Windows are compared by a 64-bit hash.  Texts without an equal pair, most of them, stop after a hash set; the rest
    sort (hash, place), mark equal neighbours, and add up the marked places' windows without overlap.
    """
    places = F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i, F.lit(WINDOW))))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(p: Column) -> Column:
            twins = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda k: (F.get(p, k)["h"].eqNullSafe(F.get(p, k - 1)["h"])) | (F.get(p, k)["h"].eqNullSafe(F.get(p, k + 1)["h"])))
            return F.sort_array(F.transform(twins, lambda k: F.get(p, k)["i"]))

        def total(q: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0), F.size(q) - 1), F.lit(0).cast("long"), lambda n, k: n + F.coalesce(F.least(F.lit(WINDOW), F.get(q, k + 1) - F.get(q, k)), F.lit(WINDOW)))

        return let(let(pairs, marked), total)

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0).cast("long")).otherwise(some)


def counted(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, counts) for each row, over its whole text."""
    text = text_or_empty()
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, WHITE + "+", -1))
    lines = F.filter(F.split(text, "\n", -1), lambda line: F.btrim(line, F.lit(" \t\n\x0b\x0c\r")) != "")
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    narrow = docs.select(
        F.col(f"`{key}`").alias(key),
        by_words.alias("_w"),
        by_lines.alias("_l"),
        _left(text, f"[^{SYMBOLS}]+").alias("n_symbols"),
        _left(text, "[^A-Z]+").alias("n_upper"),
        _left(text, "[^!]+").alias("n_exclaim"),
        _left(text, "[^0-9]+").alias("n_digits"),
        _left(text, f"[^{PUNCTUATION}]+").alias("n_punctuation"),
    )
    return narrow.select(key, "_w.*", "_l.*", "n_symbols", "n_upper", "n_exclaim", "n_digits", "n_punctuation")


def votes(counts: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`counts` with a column v_<rule> for each rule."""
    return counts.select("*", *[F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).alias(f"v_{r.name}") for r in rules])


@dataclass
class Fit:
    """The share of good texts, and each rule's accuracy on good and on bad ones."""

    share: float
    good: list[float]
    bad: list[float]

    def log_odds(self, rules: Sequence[Rule] = RULES) -> Column:
        """The log odds that a row with these votes is good."""
        total = F.log(F.lit(self.share) / F.lit(1.0 - self.share))
        for rule, g, b in zip(rules, self.good, self.bad):
            vote = F.col(f"v_{rule.name}")
            total = total + F.when(vote == 1, F.log(F.lit(g) / F.lit(1.0 - b))).when(vote == -1, F.log(F.lit(1.0 - g) / F.lit(b))).otherwise(F.lit(0.0))
        return total


def _held(value: float | None, kind: str, otherwise: float) -> float:
    return otherwise if value is None else min(max(value, BOUNDS[kind][0]), BOUNDS[kind][1])


def estimated(voted: DataFrame, rounds: int = ROUNDS, rules: Sequence[Rule] = RULES) -> Fit:
    """The fit after `rounds` of expectation-maximisation."""
    names = [f"v_{r.name}" for r in rules]
    patterns = staged(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "vote_patterns")
    fit = Fit(FIRST["share"], [FIRST["good"]] * len(rules), [FIRST["bad"]] * len(rules))
    for _ in range(rounds):
        p = 1.0 / (1.0 + F.exp(-fit.log_odds(rules)))
        weighed = patterns.select("*", (F.col("n") * p).alias("g"), (F.col("n") * (1.0 - p)).alias("b"))
        sums = [(F.sum(F.when(F.col(v) == vote, F.col(w))) / F.sum(F.when(F.col(v) != 0, F.col(w)))).alias(f"{w}_{v}") for v in names for w, vote in (("g", 1), ("b", -1))]
        got = weighed.agg((F.sum("g") / F.sum("n")).alias("share"), *sums).first()
        fit = Fit(
            _held(got["share"], "share", fit.share),
            [_held(got[f"g_{v}"], "good", old) for v, old in zip(names, fit.good)],
            [_held(got[f"b_{v}"], "bad", old) for v, old in zip(names, fit.bad)],
        )
    return fit


def rated(docs: DataFrame, threshold: float = 0.5, key: str = "doc_id", rules: Sequence[Rule] = RULES) -> DataFrame:
    """(key, counts, votes, base_failed, posterior, kept) for each row.  The counts are staged, being read twice."""
    voted = staged(votes(counted(docs, key), rules), "votes")
    fit = estimated(voted, rules=rules)
    marked = voted.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("posterior", 1.0 / (1.0 + F.exp(-fit.log_odds(rules))))
    return marked.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def rules_sql(source: str, threshold: float = 0.5, rounds: int = ROUNDS, rules: Sequence[Rule] = RULES) -> str:
    """rated() in DuckDB's SQL, with the rounds of the fit written out."""
    names = [f"v_{r.name}" for r in rules]
    cases = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v_{r.name}" for r in rules)
    odds = "ln(share / (1 - share))" + "".join(f" + CASE {v} WHEN 1 THEN ln(g_{v} / (1 - b_{v})) WHEN -1 THEN ln((1 - g_{v}) / b_{v}) ELSE 0 END" for v in names)
    hold = lambda value, kind, old: f"coalesce(least(greatest({value}, {BOUNDS[kind][0]}), {BOUNDS[kind][1]}), any_value({old}))"
    # a ratio without any vote is null, and least() and greatest() would drop the null
    ratio = lambda v, vote, w: f"(sum(CASE WHEN {v} = {vote} THEN {w} END) / sum({w}) FILTER ({v} <> 0))"
    guarded = lambda v, vote, w, kind: f"CASE WHEN {ratio(v, vote, w)} IS NULL THEN any_value({w}_{v}) ELSE {hold(ratio(v, vote, w), kind, f'{w}_{v}')} END AS {w}_{v}"
    right = ", ".join(guarded(v, vote, w, kind) for v in names for w, vote, kind in (("g", 1, "good"), ("b", -1, "bad")))
    fits = [f"fit0 AS (SELECT {FIRST['share']}::DOUBLE AS share, " + ", ".join(f"{FIRST['good']}::DOUBLE AS g_{v}, {FIRST['bad']}::DOUBLE AS b_{v}" for v in names) + ")"]
    for i in range(rounds):
        fits.append(f"fit{i + 1} AS MATERIALIZED (SELECT {hold('sum(g) / sum(n)', 'share', 'share')} AS share, {right} FROM (SELECT *, n / (1 + exp(-({odds}))) AS g, n - g AS b FROM patterns, fit{i}))")
    white = r"[\x20\x09-\x0D]"
    word = r"[^\x20\x09-\x0D]+"
    left = lambda other: f"length(regexp_replace(x, '{other}', '', 'g'))"
    return f"""WITH texts AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(x, '{word}') AS w, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '{word}')) AS ls FROM {source}),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM texts)),
repeats AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1) GROUP BY doc_id),
counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(x, '{white}', '', 'g')) AS word_chars, {left(f'[^{SYMBOLS}]+')} AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, {left('[^A-Z]+')} AS n_upper, {left('[^!]+')} AS n_exclaim, {left('[^0-9]+')} AS n_digits, {left(f'[^{PUNCTUATION}]+')} AS n_punctuation
    FROM texts LEFT JOIN repeats USING (doc_id)),
voted AS MATERIALIZED (SELECT *, {cases} FROM counts),
patterns AS MATERIALIZED (SELECT {', '.join(names)}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL),
{", ".join(fits)},
rated AS (SELECT *, {BASE_FAILED} AS base_failed, 1 / (1 + exp(-({odds}))) AS posterior FROM voted, fit{rounds})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= {threshold} AS kept, round(posterior, 4) + 0.0 AS posterior FROM rated"""
