"""Personal data in texts: fixed patterns, and identifiers that their context gives away.

Fixed patterns find mail addresses, internet addresses, card and phone numbers.  Many identifiers escape them: a phone number
without its country code, a card number with a digit wrong.  They are looked for by bootstrapping.  The pattern finds
are seeds; the words round a find make lexical patterns ("call me at _", "_ ext"): the two words before it, and the word
before with the word after.  Candidates are number-like and handle-like strings that no find overlaps.

Patterns and values (finds or candidates) are the two sides of a graph, with an edge where a value occurs in a pattern.  A
round scores patterns, for each kind, by the scores of their values over the number of their values and one; patterns with
`support` known values and a score of `sure` or more are kept.  Values are then scored by all patterns kept (the chance
that not all of them are wrong), and candidates with `accept` or more, of a form that suits the kind, join the known values
with their score in the next round.  After the last round every place of such a candidate is reported.

Texts are read once, by a projection with built-in functions, into a narrow table of places and contexts.  All else are grouped
sums and joins over distinct (pattern, value) edges, of which those of rare patterns go first.  Scores are whole
millionths, so that sums don't depend on their order.  No Python runs on executors.

Positions are code points, end exclusive; added kinds are named `<kind>_context`.  Nulls, ties and the like: a null text is empty and has
no spans; rows are told apart by their place, so null and repeated ids keep their own results; a candidate that overlaps a find is none; a
value that suits several kinds takes the best score, then the kind listed first; contexts end at the match before or after and at
48 characters; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import forget, let, lower_ascii, staged, text_or_empty
from plumbline.llm.secret_scan import running_starts

KINDS = ("email", "ip", "card", "phone")
#: What each kind matches, as defined.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches, in time linear in the text and without recursion: a match starts where its run of characters starts
#: (or where the match before ended) and never gives characters back.  Card runs are matched only with 16 to 19 digits.
LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ADDRESS = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
CANDIDATE = r"[(]?[0-9][0-9().\x20/-]{5,30}[0-9]|[A-Za-z0-9._%+-]{0,64}@[A-Za-z0-9_-]{2,63}"
#: A candidate ends at both ends: it is no part of a longer run.
ALNUM = "[A-Za-z0-9]"
#: The number of a candidate's row, where finds have the number of their kind.
NONE = 9
#: Digits that a number-like candidate must have.
LEAST_DIGITS = 7
#: Digits of candidates that may be a card or phone number.
CARD_DIGITS, PHONE_DIGITS = (12, 19), (7, 15)
ADDED = tuple(f"{k}_context" for k in KINDS)
CONTEXT = 48
WORD = r"[^\x20\x09-\x0D]+"
ROUNDS, SUPPORT, SURE, ACCEPT = 3, 3, 0.5, 0.75
MILLION = 1_000_000
PLACE = "array<struct<rank:int,start:long,end:long,value:string,patterns:array<string>>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""

    def add(rest: Column):
        def step(total: Column, i: Column) -> Column:
            d = F.ascii(F.substring(rest, i, F.lit(1))) - 48
            return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

        return step

    return let(F.reverse(digits), lambda r: F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), add(r)) % 10 == 0)


def _counts(value: Column, kind: str | None) -> Column:
    """Whether a match of a kind, or of a candidate, passes the kind's test."""
    if kind is None:
        return value.contains("@") | (F.length(_digits(value)) >= LEAST_DIGITS)
    if kind == "ip":
        return value.rlike(ADDRESS)
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(16, 19) & luhn(d))
    return F.length(_digits(value)).between(8, 15) if kind == "phone" else F.lit(True)


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a place with these texts before and after it."""
    words = lambda t: F.regexp_extract_all(F.regexp_replace(lower_ascii(t), "[0-9]", "9"), F.lit(WORD), 0)

    def made(before: Column) -> Column:
        two = F.when(F.size(before) > 1, F.concat(F.lit("2|"), F.element_at(before, -2), F.lit(" "), F.element_at(before, -1)))
        after = let(words(right), lambda w: F.when((F.size(w) > 0) & (F.size(before) > 0), F.concat(F.lit("1|"), F.element_at(before, -1), F.lit(" _ "), F.get(w, F.lit(0)))))
        return F.array_compact(F.array(two, after))

    return let(words(left), made)


def _places(text: Column, regex: str, kind: str | None) -> Column:
    """The matches that count, with their patterns, in order."""

    def found(whole: Column) -> Column:
        gaps = F.split(text, regex, -1)
        lengths = lambda a: F.transform(a, lambda m: F.length(m).cast("long"))
        spots = lambda g: let(lengths(whole), lambda s: running_starts(F.slice(lengths(g), F.lit(1), F.size(s)), s))
        rows = let(gaps, lambda g: F.arrays_zip(spots(g).alias("at"), whole.alias("v"), F.slice(g, F.lit(1), F.size(whole)).alias("l"), F.slice(g, F.lit(2), F.size(whole)).alias("r")))
        return F.transform(
            F.filter(rows, lambda m: _counts(m["v"], kind) & (F.lit(True) if kind else ~F.right(m["l"], F.lit(1)).rlike(ALNUM) & ~F.left(m["r"], F.lit(1)).rlike(ALNUM))),
            lambda m: F.struct(F.lit(NONE if kind is None else KINDS.index(kind)).alias("rank"), m["at"]["start"].alias("start"), m["at"]["end"].alias("end"), lower_ascii(m["v"]).alias("value"), _patterns(F.right(m["l"], F.lit(CONTEXT)), F.left(m["r"], F.lit(CONTEXT))).alias("patterns")),
        ).cast(PLACE)

    whole = F.regexp_extract_all(text, F.lit(regex), 0)
    return F.when(text.rlike(regex), let(whole, found)).otherwise(F.array().cast(PLACE))


def scanned(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(row, key, base, places), staged: base spans as (rank, start, end); places of finds and candidates with patterns."""
    text = text_or_empty()
    finds = F.concat(*[_places(text, LINEAR[k], k) for k in KINDS])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias(key), finds.alias("finds"), _places(text, CANDIDATE, None).alias("others"))
    base = F.transform("finds", lambda p: F.struct(p["rank"], p["start"], p["end"]))
    return staged(rows.select("row", key, base.alias("base"), F.concat("finds", "others").alias("places")), "places")


def occurrences(places: DataFrame) -> DataFrame:
    """(row, rank, start, end, value, patterns) of the finds, and of the candidates that overlap none."""
    every = places.select("row", F.explode("places").alias("p")).select("row", "p.*")
    order = W.partitionBy("row").orderBy("start", "rank")
    find = F.col("rank") < NONE
    ended = F.max(F.when(find, F.col("end"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    following = F.min(F.when(find, F.col("start"))).over(W.partitionBy("row").orderBy(F.desc("start"), F.desc("rank")).rowsBetween(W.unboundedPreceding, 0))
    overlaps = (F.coalesce(ended, F.lit(-1)) > F.col("start")) | (F.coalesce(following, F.col("end")) < F.col("end"))
    return every.withColumn("over", overlaps).where(find | ~F.col("over")).drop("over")


def suits(value: Column, rank: Column) -> Column:
    """Whether a candidate may be of a kind."""
    n = F.length(_digits(value))
    return (
        F.when(rank == 0, value.contains("@"))
        .when(rank == 1, value.rlike(r"^[0-9]+\.[0-9]+\.[0-9.]+$"))
        .when(rank == 2, n.between(*CARD_DIGITS) & ~value.contains("@"))
        .otherwise(n.between(*PHONE_DIGITS) & ~value.contains("@"))
    )


def bootstrapped(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, sure: float = SURE, accept: float = ACCEPT) -> DataFrame:
    """(value, rank, score) of the candidates accepted among occurrences, scores in millionths."""
    seeds = staged(found.where(F.col("rank") < NONE).select("value", "rank", F.lit(MILLION).cast("long").alias("score")).distinct(), "seeds")
    pairs = staged(found.select("value", F.explode("patterns").alias("pattern")).distinct(), "pairs")
    often = pairs.groupBy("pattern").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") >= support)
    edges = staged(pairs.join(often, "pattern"), "edges")
    open_edges = staged(edges.join(seeds.select("value").distinct(), "value", "left_anti"), "open_edges")
    known, accepted = seeds, None
    for _ in range(rounds):
        told = edges.join(known, "value").groupBy("pattern", "total", "rank").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("mass"))
        chance = F.col("mass") / (float(MILLION) * (F.col("total") + 1))
        kept = told.where((F.col("n") >= support) & (chance >= sure)).select("pattern", "rank", F.round(-F.log(1.0 - chance) * MILLION).cast("long").alias("proof"))
        heard = open_edges.select("pattern", "value").join(kept, "pattern").where(suits(F.col("value"), F.col("rank"))).groupBy("value", "rank").agg(F.sum("proof").alias("proof"))
        best = heard.where(F.col("proof") >= round(-math.log(1.0 - accept) * MILLION)).groupBy("value").agg(F.max(F.struct("proof", -F.col("rank"))).alias("best"))
        score = F.round((1.0 - F.exp(-F.col("best.proof") / float(MILLION))) * MILLION).cast("long")
        following = staged(best.select("value", (-F.col("best.col2")).cast("int").alias("rank"), score.alias("score")), "accepted")
        if accepted is not None:
            forget(accepted)
        accepted = following
        known = seeds.unionAll(accepted)
    forget(pairs, edges, open_edges, seeds)
    return accepted


def found_personal_data(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(key, base, added) for each row: arrays of (rank, start, end); ranks of `added` go on after those of the kinds."""
    places = scanned(docs, key)
    found = staged(occurrences(places), "occurrences")
    accepted = bootstrapped(found, **options).select("value", (F.col("rank") + len(KINDS)).alias("rank"))
    new = found.where(F.col("rank") == NONE).select("row", "value", "start", "end").join(accepted, "value")
    new = new.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "end"))).alias("added"))
    out = places.select("row", key, "base").join(new, "row", "left")
    return out.select(key, "base", F.coalesce("added", F.array().cast("array<struct<rank:int,start:long,end:long>>")).alias("added"))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS + ADDED])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def personal_data_table(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) for each row."""
    found = found_personal_data(docs, key, **options)
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(key, *counts, F.size("added").cast("long").alias("n_added"), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"))


def personal_data_sql(source: str, rounds: int = ROUNDS, support: int = SUPPORT, sure: float = SURE, accept: float = ACCEPT) -> str:
    """personal_data_table() in DuckDB's SQL."""
    regexes = [*enumerate(PATTERNS.values()), (NONE, CANDIDATE)]
    matches = " UNION ALL ".join(f"SELECT rid, {r} AS rank, regexp_extract_all(x, '{e}', 0) AS whole, string_split_regex(x, '{e}') AS gaps FROM texts WHERE regexp_matches(x, '{e}')" for r, e in regexes)
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    luhn_sql = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse({digits})[i]::INT ELSE 2 * reverse({digits})[i]::INT - CASE WHEN reverse({digits})[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda x: f"regexp_extract_all(regexp_replace({lower(x)}, '[0-9]', '9', 'g'), '{WORD}')"
    steps, known = [], "seeds"
    for i in range(rounds):
        steps.append(f"""kept{i} AS (SELECT pattern, rank, round(-ln(1.0 - chance) * {MILLION})::BIGINT AS proof FROM
    (SELECT pattern, rank, count(*) AS n, sum(score) / ({MILLION}::DOUBLE * (total + 1)) AS chance FROM edges JOIN {known} USING (value) GROUP BY pattern, total, rank) WHERE n >= {support} AND chance >= {sure}),
heard{i} AS (SELECT value, rank, sum(proof) AS proof FROM edges JOIN kept{i} USING (pattern) WHERE value NOT IN (SELECT value FROM seeds) AND
    CASE rank WHEN 0 THEN contains(value, '@') WHEN 1 THEN regexp_matches(value, '^[0-9]+\\.[0-9]+\\.[0-9.]+$') WHEN 2 THEN length({digits}) BETWEEN {CARD_DIGITS[0]} AND {CARD_DIGITS[1]} AND NOT contains(value, '@')
    ELSE length({digits}) BETWEEN {PHONE_DIGITS[0]} AND {PHONE_DIGITS[1]} AND NOT contains(value, '@') END GROUP BY value, rank),
accepted{i} AS MATERIALIZED (SELECT value, arg_min(rank, (-proof, rank)) AS rank, round((1.0 - exp(-max(proof) / {MILLION}::DOUBLE)) * {MILLION})::BIGINT AS score FROM heard{i} WHERE proof >= {round(-math.log(1.0 - accept) * MILLION)} GROUP BY value),
known{i} AS (SELECT value, rank, score FROM seeds UNION ALL SELECT value, rank, score FROM accepted{i})""")
        known = f"known{i}"
    steps = ",\n".join(steps)
    names = "[" + ", ".join(f"'{k}'" for k in KINDS + ADDED) + "]"
    counts = ", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(KINDS))
    return f"""WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM {source}),
found AS (SELECT rid, rank, unnest(whole) AS m, unnest(gaps[:len(whole)]) AS gap, unnest(range(len(whole))) AS i FROM ({matches})),
placed AS (SELECT rid, rank, i, {lower("m")} AS value, (sum(length(gap) + length(m)) OVER (PARTITION BY rid, rank ORDER BY i))::BIGINT AS stop, stop - length(m) AS start FROM found),
told AS (SELECT rid, rank, value, start, stop, substr(x, last + 1, start - last) AS before, substr(x, stop + 1, following - stop) AS after FROM
    (SELECT *, coalesce(lag(stop) OVER o, 0) AS last, coalesce(lead(start) OVER o, stop + 48) AS following FROM placed WHERE rank <> 2 OR length({digits}) BETWEEN 16 AND 19 WINDOW o AS (PARTITION BY rid, rank ORDER BY i)) JOIN texts USING (rid)),
counted AS (SELECT *, {words("right(before, " + str(CONTEXT) + ")")} AS l, {words("left(after, " + str(CONTEXT) + ")")} AS r FROM told WHERE CASE rank WHEN 0 THEN true WHEN 1 THEN regexp_matches(value, '{ADDRESS}')
    WHEN 2 THEN length({digits}) BETWEEN 16 AND 19 AND {luhn_sql} WHEN 3 THEN length({digits}) BETWEEN 8 AND 15 ELSE (contains(value, '@') OR length({digits}) >= {LEAST_DIGITS}) AND NOT regexp_matches(right(before, 1), '{ALNUM}') AND NOT regexp_matches(left(after, 1), '{ALNUM}') END),
occurrences AS MATERIALIZED (SELECT * FROM counted c WHERE rank < {NONE} OR NOT EXISTS (SELECT 1 FROM counted b WHERE b.rank < {NONE} AND b.rid = c.rid AND b.start < c.stop AND c.start < b.stop)),
patterned AS (SELECT value, CASE WHEN len(l) > 1 THEN '2|' || l[-2] || ' ' || l[-1] END AS pattern FROM occurrences UNION SELECT value, CASE WHEN len(l) > 0 AND len(r) > 0 THEN '1|' || l[-1] || ' _ ' || r[1] END FROM occurrences),
pairs AS (SELECT DISTINCT value, pattern FROM patterned WHERE pattern IS NOT NULL),
edges AS MATERIALIZED (SELECT value, pattern, total FROM pairs JOIN (SELECT pattern, count(*) AS total FROM pairs GROUP BY pattern HAVING count(*) >= {support}) USING (pattern)),
seeds AS MATERIALIZED (SELECT DISTINCT value, rank, {MILLION}::BIGINT AS score FROM occurrences WHERE rank < {NONE}),
{steps},
spans AS (SELECT rid, rank, start, stop FROM occurrences WHERE rank < {NONE} UNION ALL SELECT rid, a.rank + {len(KINDS)}, start, stop FROM occurrences o JOIN accepted{rounds - 1} a USING (value) WHERE o.rank = {NONE}),
summed AS (SELECT rid, {counts}, count(*) FILTER (rank >= {len(KINDS)}) AS n_added, string_agg(({names})[rank + 1] || ':' || start || ':' || stop, ',' ORDER BY rank, start) FILTER (rank < {len(KINDS)}) AS base,
    string_agg(({names})[rank + 1] || ':' || start || ':' || stop, ',' ORDER BY rank, start) AS spans FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in KINDS)}, coalesce(n_added, 0)::BIGINT AS n_added, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN summed USING (rid)"""
