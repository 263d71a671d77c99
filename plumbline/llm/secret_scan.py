"""Secrets in texts: patterns, and sliding-window entropy over candidate strings.

Patterns find assignments to secret-like names, access keys and long hexadecimal runs.  The entropy scan takes every
run of token characters, sorts it into a character class by the characters that it has, and slides a window of the
class's width along it.  The window's counts are kept by adding the character that enters and taking off the one that
leaves; with f(c) = c log2(c), the entropy is log2(width) minus the sum of f(counts) over the width, so a step
changes two terms.  A candidate is a secret if some window's entropy reaches the class's limit and no allow-list rule
names it; it is reported as a whole.

Everything is a projection with built-in functions: no shuffle, no Python.  Positions are code points, end exclusive.
They come from the lengths of the pieces between matches; running sums are cut into blocks, so that a text with very
many matches is not quadratic.

Nulls, ties and the like: a null text is empty and has no spans; spans of one kind never overlap; entropy spans that
overlap a pattern's span are left out, as that secret is known; at one start the kinds go in the listed order; repeated
rows repeat their results; an empty table gives an empty result; columns with the results' names give way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, plus, text_or_empty


@dataclass(frozen=True)
class Pattern:
    """A kind of secret; a match counts if its `group` has `least` characters or more."""

    kind: str
    regex: str
    group: int
    least: int


@dataclass(frozen=True)
class CharacterClass:
    """Candidates whose characters are all in `members`, and the window in which their entropy must reach `limit` bits."""

    name: str
    members: str
    width: int
    limit: float


#: A limit that no window reaches.
NEVER = 9.0
#: Letters of the names are written in both cases, so that all engines agree on what "either case" is.
NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api")) + "_?[Kk][Ee][Yy]"
PATTERNS = (
    Pattern("assign", rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Pattern("access", "AKIA[A-Z0-9]+", 0, 20),
    Pattern("hex", "[0-9a-f]+", 0, 24),
)
#: Runs shorter than a kind's least never count: asking for that length in the expression gives the same matches.
SHORTCUTS = {"access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
ENTROPY_KIND = "entropy"
CANDIDATE = "[A-Za-z0-9+/=_-]{24,}"
#: The first class that holds all characters of a candidate decides.
CLASSES = (
    CharacterClass("digits", "0123456789", 24, NEVER),
    CharacterClass("hex", "0123456789abcdef", 24, 3.05),
    CharacterClass("upper hex", "0123456789ABCDEF", 24, 3.05),
    CharacterClass("lower", "abcdefghijklmnopqrstuvwxyz_-", 24, 4.31),
    CharacterClass("token", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-", 24, 3.95),
)
#: Candidates that a rule matches anywhere are no secrets: placeholders, long runs of one character, the alphabet and
#: digits in order, paths of plain words, public key and hash prefixes, words without any digit.
ALLOWED = (
    "(?:EXAMPLE|example|SAMPLE|sample|PLACEHOLDER|placeholder|dummy|DUMMY|xxxx|XXXX)",
    "(?:abcdefgh|ABCDEFGH|01234567|12345678)",
    "^[a-z]+(?:[-_/][a-z]+)*$",
    "^[A-Z]+(?:[-_/][A-Z]+)*$",
    "^[A-Za-z]+$",
    "^(?:sha256|sha512|sha1|md5)[-=_]",
    "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
)
#: Matches whose starts are summed at a time.
BLOCK = 256


def running_starts(gaps: Column, sizes: Column) -> Column:
    """[(start, end)] from the lengths before each match and of each match, in order."""

    def block(i: Column) -> Column:
        return F.slice(F.arrays_zip(gaps.alias("g"), sizes.alias("s")), i * BLOCK + 1, F.lit(BLOCK))

    def advance(base: Column, pairs: Column) -> Column:
        empty = F.array().cast("array<struct<start:long,end:long>>")
        step = lambda acc, p: F.struct((acc["at"] + p["g"] + p["s"]).alias("at"), F.array_append(acc["out"], F.struct((acc["at"] + p["g"]).alias("start"), (acc["at"] + p["g"] + p["s"]).alias("end"))).alias("out"))
        return F.aggregate(pairs, F.struct(base.alias("at"), empty.alias("out")), step)["out"]

    numbers = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int"))
    totals = F.transform(numbers, lambda i: F.aggregate(block(i), F.lit(0).cast("long"), lambda n, p: n + p["g"] + p["s"]))
    bases = F.aggregate(totals, F.array(F.lit(0).cast("long")), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    one = advance(F.lit(0).cast("long"), F.arrays_zip(gaps.alias("g"), sizes.alias("s")))
    many = let(bases, lambda b: F.flatten(F.transform(numbers, lambda i: advance(F.get(b, i), block(i)))))
    return F.when(F.size(sizes) <= BLOCK, one).otherwise(many)


SPAN = "array<struct<start:long,end:long,kind:string,rank:int>>"


def _located(text: Column, regex: str, group: int, keep: Callable[[Column], Column], kind: str, rank: int) -> Column:
    """The spans of `regex` in `text` whose `group` passes `keep`."""
    nothing = F.array().cast(SPAN)
    whole = F.regexp_extract_all(text, F.lit(regex), 0)
    tested = whole if group == 0 else F.regexp_extract_all(text, F.lit(regex), group)
    gaps = F.transform(F.split(text, regex, -1), lambda p: F.length(p).cast("long"))

    def spans(matches: Column) -> Column:
        sizes = F.transform(matches, lambda m: F.length(m).cast("long"))
        places = let(sizes, lambda s: let(gaps, lambda g: running_starts(F.slice(g, F.lit(1), F.size(s)), s)))
        marked = F.zip_with(places, tested, lambda p, m: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), keep(m).alias("keep")))
        return F.transform(F.filter(marked, lambda m: m["keep"]), lambda m: F.struct(m["start"], m["end"], m["kind"], m["rank"])).cast(SPAN)

    return F.when(text.rlike(regex), let(whole, spans)).otherwise(nothing)


def _f(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))


def most_entropy(word: Column, members: str, width: int) -> Column:
    """The largest Shannon entropy, in bits a character, of any `width` characters in a row of `word`.

    `word` has at least `width` characters, all in `members`.  The state is the counts of the window by member and the
    sum of f over them.
    """
    place = lambda i: F.instr(F.lit(members), F.substring(word, i, F.lit(1)))
    bump = lambda counts, at, by: F.concat(F.slice(counts, F.lit(1), at - 1), F.array(F.get(counts, at - 1) + by), F.slice(counts, at + 1, F.lit(len(members))))

    def enter(state: Column, at: Column) -> Column:
        old = F.get(state["counts"], at - 1)
        return F.struct(bump(state["counts"], at, F.lit(1.0)).alias("counts"), (state["total"] + _f(old + 1) - _f(old)).alias("total"), state["least"].alias("least"))

    def leave(state: Column, at: Column) -> Column:
        old = F.get(state["counts"], at - 1)
        return F.struct(bump(state["counts"], at, F.lit(-1.0)).alias("counts"), (state["total"] + _f(old - 1) - _f(old)).alias("total"), state["least"].alias("least"))

    def step(state: Column, i: Column) -> Column:
        moved = let(F.when(i > width, leave(state, place(i - width))).otherwise(state), lambda s: enter(s, place(i)))
        return let(moved, lambda s: F.struct(s["counts"].alias("counts"), s["total"].alias("total"), F.when(i >= width, F.least(s["least"], s["total"])).otherwise(s["least"]).alias("least")))

    begin = F.struct(F.array_repeat(F.lit(0.0), len(members)).alias("counts"), F.lit(0.0).alias("total"), F.lit(float("inf")).alias("least"))
    least = F.aggregate(F.sequence(F.lit(1), F.length(word)), begin, step)["least"]
    return F.log2(F.lit(float(width))) - least / F.lit(float(width))


def high_entropy(word: Column) -> Column:
    """Whether a candidate's entropy reaches its class's limit, and no allow-list rule names it."""
    allowed = F.lit(False)
    for rule in ALLOWED:
        allowed = allowed | word.rlike(rule)
    case = None
    for c in CLASSES:
        inside = F.length(F.translate(word, c.members, "")) == 0
        enough = F.lit(False) if c.limit >= NEVER else most_entropy(word, c.members, c.width) >= F.lit(c.limit)
        case = F.when(inside, enough) if case is None else case.when(inside, enough)
    return ~allowed & case.otherwise(F.lit(False))


def found_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with `base` and `added`: arrays of (start, end, kind, rank), by start, then rank."""
    text = text_or_empty()
    parts = [_located(text, SHORTCUTS.get(p.kind, p.regex), p.group, lambda m, p=p: F.length(m) >= p.least, p.kind, i) for i, p in enumerate(PATTERNS)]
    order = lambda a, b: F.when(F.struct(a["start"], a["rank"]) < F.struct(b["start"], b["rank"]), -1).when(F.struct(a["start"], a["rank"]) > F.struct(b["start"], b["rank"]), 1).otherwise(0)
    base = F.array_sort(F.concat(*parts), order)
    candidates = _located(text, CANDIDATE, 0, high_entropy, ENTROPY_KIND, len(PATTERNS))
    out = plus(docs, base=base, _candidates=candidates)
    free = F.filter("_candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    return plus(out, added=free).drop("_candidates")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def secret_table(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) for each row."""
    found = found_secrets(docs.select(F.col(f"`{key}`").alias(key), "text"))
    counts = [_count(p.kind).alias(f"n_{p.kind}") for p in PATTERNS]
    everything = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return found.select(key, *counts, F.size("added").cast("long").alias("n_entropy"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(everything).alias("spans"))


def secrets_sql(source: str) -> str:
    """secret_table() in DuckDB's SQL."""
    quoted = lambda x: x.replace("'", "''")

    def matches(kind: str, rank: int, regex: str, group: int) -> str:
        r = quoted(regex)
        return f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(x, '{r}', 0) AS whole, regexp_extract_all(x, '{r}', {group}) AS tested, string_split_regex(x, '{r}') AS gaps FROM texts WHERE regexp_matches(x, '{r}')"

    kinds = [matches(p.kind, i, p.regex, p.group) for i, p in enumerate(PATTERNS)] + [matches(ENTROPY_KIND, len(PATTERNS), CANDIDATE, 0)]
    least = " OR ".join([f"(kind = '{p.kind}' AND length(tested) >= {p.least})" for p in PATTERNS])
    classes = " ".join(
        f"WHEN length(translate(tested, '{c.members}', '')) = 0 THEN " + ("false" if c.limit >= NEVER else f"list_max(list_transform(range(1, length(tested) - {c.width - 2}), lambda i: list_aggregate(string_split(substr(tested, i, {c.width}), ''), 'entropy'))) >= {c.limit}") for c in CLASSES
    )
    allowed = " OR ".join(f"regexp_matches(tested, '{quoted(a)}')" for a in ALLOWED)
    counts = ", ".join(f"count(*) FILTER (kind = '{p.kind}') AS n_{p.kind}" for p in PATTERNS)
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS x FROM {source}),
found AS (SELECT doc_id, kind, rank, unnest(whole) AS m, unnest(tested) AS tested, unnest(gaps[:len(whole)]) AS gap, unnest(range(len(whole))) AS i FROM ({" UNION ALL ".join(kinds)})),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop, stop - length(m) AS start FROM found),
base AS MATERIALIZED (SELECT doc_id, kind, rank, start, stop FROM placed WHERE {least}),
added AS (SELECT doc_id, kind, rank, start, stop FROM placed p WHERE kind = '{ENTROPY_KIND}' AND NOT ({allowed}) AND (CASE {classes} ELSE false END)
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = p.doc_id AND b.start < p.stop AND p.start < b.stop)),
bases AS (SELECT doc_id, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s FROM base GROUP BY doc_id),
alls AS (SELECT doc_id, count(*) FILTER (kind = '{ENTROPY_KIND}') AS n_added, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS s FROM (FROM base UNION ALL FROM added) GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{p.kind}, 0)::BIGINT AS n_{p.kind}" for p in PATTERNS)}, coalesce(n_added, 0)::BIGINT AS n_entropy, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans
FROM texts LEFT JOIN bases b USING (doc_id) LEFT JOIN alls a USING (doc_id)"""
