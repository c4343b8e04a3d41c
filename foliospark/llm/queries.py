"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from foliospark.llm import byte_bpe, license_scan, mixing, order_minhash, quality, quality_rules, sharding, substring_dedup, token_files, topk
from foliospark.llm.common import WORD_BREAK, table

MIX_SEED = 20


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.replicate(table(spark, sf_dir, "documents"), seed=MIX_SEED)
    return mixed.select("doc_id", "source", "copy", "n_copies", F.round("rate", 6).alias("rate"), "text", "shuffle_key")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return dealt.select("doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = quality.fit(docs, labels.filter(~held_out()))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), WORD_BREAK, " "))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids_le").alias("ids_crc32"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return made.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(quality_rules.rule_mask(quality_rules.POLICIES["base"]))) != 0).alias("base_failed"),
        "kept", "n_lines", "n_upper", "fail_bits",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the production policy costs, by source."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")), by=["source"])


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_order_minhash": op6_order_minhash,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_topk_search": op3_topk_search,
    "op8_source_mixing": op8_source_mixing,
    "op10_sharding": op10_sharding,
    "op4_token_files": op4_token_files,
    "op7_byte_bpe": op7_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "quality_ablations": quality_ablations,
}

_LEDGER_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base WHERE len(w) >= 3)
), twice AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS s(k) GROUP BY doc_id
), measured AS (
  SELECT b.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS BIGINT) AS n_upper
  FROM base b LEFT JOIN covered c ON c.doc_id = b.doc_id
), ledger AS (
  SELECT *, CAST(
      (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
    + (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END)
    + (CASE WHEN n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END) AS BIGINT) AS fail_bits
  FROM measured
)
"""
OP9_SQL = _LEDGER_SQL + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, n_lines, n_upper, fail_bits
FROM ledger
"""
ABLATIONS_SQL = _LEDGER_SQL + f"""
SELECT source, rule, CAST(count(*) FILTER (own <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (own <> 0 AND rest = 0) AS BIGINT) AS n_failed_alone,
       CAST(count(*) FILTER (rest = 0) AS BIGINT) AS n_kept_without, CAST(coalesce(bit_or(rest) FILTER (own <> 0), 0) AS BIGINT) AS together
FROM (SELECT source, rule, fail_bits & b AS own, fail_bits & (127 - b) AS rest
      FROM ledger JOIN (SELECT doc_id, source FROM documents) USING (doc_id),
           (VALUES {", ".join(f"('{name}', {1 << i})" for i, name in enumerate(quality_rules.RULES))}) AS r(rule, b))
GROUP BY source, rule
"""

OP8_SQL = f"""
WITH RECURSIVE sizes AS (
  SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source
), rated AS (
  SELECT source, w / sum(w) OVER () * CAST(sum(chars) OVER () AS BIGINT) / chars AS rate
  FROM (SELECT *, CASE WHEN chars > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM sizes) WHERE chars > 0
), stepped AS (
  SELECT *, greatest(1, CAST(ceil(rate / 32) AS INT)) AS steps FROM rated
), cdf AS (
  SELECT source, rate / steps AS mean, 0 AS k, exp(-(rate / steps)) AS p, exp(-(rate / steps)) AS c FROM stepped
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < {mixing.TERMS}
), curve AS (
  SELECT source, list(c) AS cs FROM cdf GROUP BY source
), drawn AS (
  SELECT d.doc_id, d.source, d.text, s.rate,
         CAST(list_sum(list_transform(range(1, s.steps + 1), lambda i: len(list_filter(cs, lambda c:
           c <= CAST(('0x' || substr(md5('{MIX_SEED}|' || d.doc_id || '|' || i), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)))) AS INT) AS n_copies
  FROM documents d JOIN stepped s ON d.source IS NOT DISTINCT FROM s.source JOIN curve v ON v.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, source, CAST(copy AS INT) AS copy, n_copies, round(rate, 6) AS rate, text,
       md5('{MIX_SEED}|' || doc_id || '|' || copy || '|order') AS shuffle_key
FROM (SELECT *, unnest(range(1, n_copies + 1)) AS copy FROM drawn)
"""

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""

ORACLE_SQL: dict[str, str] = {
    "op3_topk_search": OP3_SQL,
    "op8_source_mixing": OP8_SQL,
    "op9_quality_rules": OP9_SQL,
    "quality_ablations": ABLATIONS_SQL,
}
