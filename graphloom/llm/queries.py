"""The queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import documents


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.line_dedup import line_dedup

    return line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.language_id import held_out, language_id

    docs = documents(spark, sf_dir)
    found = language_id(docs.select("doc_id", "text", "lang"))
    return found.select("doc_id", held_out(found["doc_id"]).alias("held_out"), "lang_pred", "score", "n_spans")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.mixing import mix

    return mix(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality_rules import quality_rules

    return quality_rules(documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.substring_dedup import substring_dedup

    # Passages, as this query is asked for: short lines that recur (salutations, licences) are left to the default of 1.
    return substring_dedup(documents(spark, sf_dir), min_words=30)


def op7_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality_lm import quality_lm

    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0")
    return quality_lm(documents(spark, sf_dir), trusted)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from graphloom.llm.bpe import encode_decode

    return encode_decode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.chat import chat
    from graphloom.llm.common import settle

    settle(spark)
    return chat(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.simhash import simhash

    return simhash(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_mixing, op3_line_dedup, op4_quality_rules, op5_exact_dedup, op6_substring_dedup, op7_quality_lm, op8_bpe, op9_chat, op10_simhash)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE: dict[str, str] = {
    "op3_line_dedup": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
     l AS (SELECT doc_id, r, i, lines[i] AS line, translate(trim(lines[i], {BLANK}), '{UPPER}', '{LOWER}') AS key
           FROM (SELECT doc_id, r, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
     k AS (SELECT key, max(doc_id) AS stays FROM (SELECT DISTINCT key, doc_id, r FROM l WHERE length(key) >= 40) GROUP BY key HAVING count(*) >= 5)
SELECT doc_id, count(*) AS n_lines, count(stays) FILTER (doc_id <> stays) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (stays IS NULL OR doc_id = stays), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY doc_id, r""",
    "op9_chat": """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k, role, text FROM conversations),
     h AS (SELECT conv_id, k, string_agg(coalesce(role || '|', '-') || chr(0) || coalesce(text || '|', '-') || chr(1), '') OVER (PARTITION BY conv_id ORDER BY k) AS s FROM t),
     n AS (SELECT conv_id, max(k) AS n_turns, arg_max(s, k) AS s FROM h GROUP BY conv_id),
     inner_ AS (SELECT DISTINCT h.s FROM h JOIN n USING (conv_id) WHERE h.k < n.n_turns),
     keep AS (SELECT min(conv_id) AS conv_id FROM n WHERE s NOT IN (SELECT s FROM inner_) GROUP BY s)
SELECT conv_id, count(*) AS n_turns, string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY k) AS rendered
FROM t SEMI JOIN keep USING (conv_id) GROUP BY conv_id""",
    "op5_exact_dedup": f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
}
