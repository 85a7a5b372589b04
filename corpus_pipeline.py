"""A training-data pipeline over documents. Each stage works on all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.bpe import encode_decode
from graphloom.llm.common import discard, documents, scratch, settle
from graphloom.llm.exact_dedup import drop_copies
from graphloom.llm.language_id import drop_unknown
from graphloom.llm.mixing import mixed
from graphloom.llm.simhash import drop_near

#: The vocabulary that the last stage encodes with.
VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language, or none with half of their letters, go."""
    settle(spark)
    return drop_unknown(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest doc_id stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays."""
    return drop_near(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights: documents are left out, cut at a block's end, or repeated."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids, and the digest of the bytes they decode to."""
    settle(spark)
    return encode_decode(docs, VOCABULARY, PATTERN, with_ids=True)


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash", near), ("mixing", mix), ("bpe", encode)]

#: Learned languages and fingerprints can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written to the shared folder and read again; the last is returned as it is.

    A stage's table is deleted when the next one is written; that of the last stage but one stays, the result reads it.
    """
    docs, before = documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := scratch(spark, name))
            docs = spark.read.parquet(path)
            if before:
                discard(spark, before)
            before = path
    return docs
