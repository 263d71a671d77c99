"""The queries of this package and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from plumbline.llm import chat, cotraining, decontaminate, language, mixing, personal_data, quality_rules, secret_scan, sharding, simhash, spelling, token_files, vector_codes
from plumbline.llm.common import only_columns, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: CRC-32 over UTF-8 bytes; its table of 256 entries comes from its polynomial.
CRC_SQL = """crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc_sql(text: str) -> str:
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {bytes_}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT"


SHARD_SQL = f"""WITH {CRC_SQL},
facts AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT + 1 AS size, {crc_sql("coalesce(text, '')")} AS text_crc32, 'key' AS law FROM documents, crc_table),
{sharding.tree_sql(sharding.shard_tree(8), "doc_id", "facts", "placed", "shard")},
{sharding.tree_sql(sharding.shard_tree(9, grown_from=8), "doc_id", "placed", "grown", "grown_shard")}
SELECT *, row_number() OVER (PARTITION BY shard ORDER BY {sharding.slot_sql("doc_id", "size", "text_crc32")}, doc_id, size, text_crc32) - 1 AS slot FROM grown"""


@query("op1_hash_tree_shards", SHARD_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_table(table(spark, folder, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")



@query("op4_simhash_multi_index")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


#: Words of both tables; windows of ten words of each item, or the whole item if it has fewer; the documents' windows
#: of those lengths that equal one; the words inside.
LEAKS_SQL = r"""WITH dw AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS MATERIALIZED (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 10) AS n FROM bw WHERE len(w) > 0),
windows AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
dg AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM windows))),
found AS MATERIALIZED (SELECT doc_id, i, n, item_id FROM dg JOIN windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY 1),
met AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM found GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN met USING (doc_id)"""


@query("op3_suffix_automaton_decontamination", LEAKS_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


#: The mix: weights of domains, of languages in a domain, of sources in a language; nodes not named weigh 1.
MIX = {("web",): 5.0, ("books",): 3.0, ("news",): 2.0, ("web", "en"): 4.0, ("web", "de"): 2.0, ("books", "en"): 2.0, ("news", "fr"): 3.0, ("web", "en", "src0"): 4.0}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.75, 2, "mix-1"


def domain_of_source():
    """The domain of a source, by the number in its name."""
    number = F.regexp_extract(F.coalesce(F.col("source"), F.lit("")), r"^src([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.element_at(F.array(F.lit("web"), F.lit("books"), F.lit("news")), (number.cast("int") % 3 + 1)))


MIX_SQL = f"""WITH rows AS MATERIALIZED (SELECT doc_id, domain, lang, source, n_tokens FROM (SELECT doc_id, coalesce(lang, '~') AS lang, coalesce(source, '~') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, regexp_extract(coalesce(source, ''), '^src([0-9]{{1,9}})$', 1) AS number,
    CASE WHEN number = '' THEN 'other' ELSE ['web', 'books', 'news'][number::BIGINT % 3 + 1] END AS domain FROM documents)),
{mixing.mix_sql("rows", MIX, MIX_SHARE, MIX_EPOCHS, MIX_SEED)}
SELECT doc_id, domain, lang, source, n_tokens, budget, copies::BIGINT AS copies FROM mixed"""


@query("op7_hierarchical_budgets", MIX_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    rows, cut = mixing.mixed(table(spark, folder, "documents"), MIX, MIX_SHARE, MIX_EPOCHS, MIX_SEED, domain=domain_of_source())
    return mixing.copies(rows, cut, MIX_SEED).select("doc_id", "domain", "lang", "source", "n_tokens", "budget", "copies")


@query("op9_language_families")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return language.identified(table(spark, folder, "documents"))


@query("op5_secret_entropy_scan", secret_scan.secrets_sql("documents"))
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_table(table(spark, folder, "documents"))


@query("op6_weak_supervision_rules", quality_rules.rules_sql("documents"))
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = quality_rules.rated(table(spark, folder, "documents"))
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select(*names, (F.round("posterior", 4) + 0.0).alias("posterior"))


@query("op2_cotrained_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return cotraining.scored(docs, cotraining.fit(docs, table(spark, folder, "labels")))


#: A conversation whose texts hold the template's own control strings.
TRICKY_ID, TRICKY_TEXT = -7, r"\### Assistant: </turn> ok"

CHAT_SQL = r"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
marked AS (SELECT *, length('### ' || replace(regexp_replace(role, '(\\|###|</turn>)', '\\\1', 'g'), ':', '\:') || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || ' </turn>' || chr(10)) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(n)::BIGINT AS formatted_chars FROM marked GROUP BY conv_id"""


@query("op10_incremental_chat_format", CHAT_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    given = only_columns(table(spark, folder, "conversations"), "conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(TRICKY_ID, 0, "user", TRICKY_TEXT), (TRICKY_ID, 1, "assistant", TRICKY_TEXT)], given.schema)
    return chat.digests(staged(chat.formatted(given.unionAll(tricky)), "chats"))


@query("op8_context_mixing_token_files")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_files.read_back(*token_files.written(table(spark, folder, "documents"), path), path)


@query("op12_active_entry_codes", vector_codes.codes_sql("embeddings"))
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.code_table(table(spark, folder, "embeddings"))


@query("op11_composed_spelling_variants", spelling.variants_sql("documents", crc_sql("s"), CRC_SQL))
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


@query("op13_bootstrapped_personal_data", personal_data.personal_data_sql("documents"))
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.personal_data_table(table(spark, folder, "documents"))
