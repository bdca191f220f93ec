"""The operators' queries over the tables of a folder, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, html_extract, jaccard_join, mixing, packing, quality_crf, quality_rules, sharding, token_counts
from .common import text_of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 by the external shuffle; law ``rows``."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    size = sharding.document_size(F.col("text"))
    out = sharding.shard_records(docs, shards=40, seed=17, size=size)
    return out.select(
        "doc_id",
        size.alias("size"),
        F.crc32(text_of()).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The conversation that the query adds to the table: control strings of a template as texts.
ADDED_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED_CONVERSATION, "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_conversations(rows.unionByName(added), public_tokenizers.path("byte_bpe_50k.json")))


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"), words=4, percent=85)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_left")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup_files(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), seed=5)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(_table(spark, sf_dir, "documents"), seed=29)
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_html_extract": op1_html_extract,
    "op2_sharding": op2_sharding,
    "op3_chat_format": op3_chat_format,
    "op4_quality_crf": op4_quality_crf,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
}

_WORD = r"[^\x20\x09-\x0D]+"

_OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, host, text, regexp_extract_all(text, '{_WORD}') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM d
), g AS (
  SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
), h AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM g
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r
), l AS (
  SELECT r, host, text, unnest(lines) AS line FROM w
), ln AS (
  SELECT r, host, text, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
         len(regexp_extract_all(line, '{_WORD}')) AS n FROM l
), lim AS (
  SELECT host, greatest({quality_rules.LINE_DOCUMENTS}::DOUBLE, count(DISTINCT text) * {quality_rules.LINE_SHARE}::DOUBLE) AS most FROM w GROUP BY host
), common AS (
  SELECT host, norm FROM ln JOIN lim USING (host) GROUP BY host, norm, most HAVING count(DISTINCT text) > most
), gone AS (
  SELECT r, sum(n) AS removed FROM ln JOIN common USING (host, norm) GROUP BY r
), c AS (
  SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(words) - coalesce(removed, 0) AS words_left
  FROM w LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
), b AS (
  SELECT *, n_words < {quality_rules.FEWEST_WORDS} OR 100 * n_repeat_words > {quality_rules.MOST_REPEATED} * n_words AS base_failed FROM c
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND words_left >= {quality_rules.LEAST_LEFT}::DOUBLE * n_words AS kept, words_left::BIGINT AS words_left
FROM b
"""

_OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

_OP10_SQL = rf"""
WITH r AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         ('0x' || substr(md5('29:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h,
         len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size
  FROM documents
), s AS (
  SELECT skey, sum(size)::BIGINT AS source_size FROM r GROUP BY skey
), k AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT] AS weight FROM s
), ratios AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS all_size, sum(weight) OVER () AS all_weight FROM k
), held AS (
  SELECT *, coalesce(sum(source_size * 3) OVER b, 0) AS held, coalesce(sum(weight) OVER b, 0) AS gone
  FROM ratios WINDOW b AS (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (all_size - held)::DOUBLE / (all_weight - gone)::DOUBLE AS own FROM held
), top AS (
  SELECT skey, source_size, weight, max(CASE WHEN own <= ratio THEN own END) OVER () AS level FROM levels
), t AS (
  SELECT skey, source_size, least(3.0::DOUBLE * source_size, level * weight) AS target FROM top
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 1 END AS whole FROM t
), c AS (
  SELECT r.*, source_size, target, whole, target - whole * source_size AS rest,
         sum(size) OVER (PARTITION BY skey ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total,
         sum(size) OVER (PARTITION BY skey, h) AS same, count(*) OVER (PARTITION BY skey, h) AS ties
  FROM r JOIN p USING (skey)
), e AS (
  SELECT *, min(CASE WHEN total > rest THEN h END) OVER (PARTITION BY skey) AS edge FROM c
)
SELECT doc_id, size, source_size, target, (whole * size + CASE
    WHEN rest <= 0 THEN 0
    WHEN edge IS NULL OR h < edge THEN size
    WHEN h > edge THEN 0
    WHEN ties = 1 THEN CASE WHEN (rest - (total - same)) * 2 >= same THEN size ELSE 0 END
    ELSE floor(size * (rest - (total - same)) / same) END)::BIGINT AS taken
FROM e
"""

ORACLE_SQL: dict[str, str] = {
    "op6_quality_rules": _OP6_SQL,
    "op7_exact_dedup": _OP7_SQL,
    "op10_mixing": _OP10_SQL,
}
