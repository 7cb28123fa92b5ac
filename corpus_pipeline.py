"""From raw documents to token files: quality rules, near-dedup, decontamination, mixing, token output."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabmine.llm import decontaminate, mixing, quality_rules, simhash, token_store
from tabmine.llm.common import scratch, stored

#: Target weights of the mixing stage; names that aren't listed weigh 1.
WEIGHTS = {"lang": {"en": 6, "de": 2, "fr": 2, "es": 1}}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go; repeated rows stay or go together; a rate equal to its threshold is kept; very
    long texts are judged whole; an empty table stays empty; extra columns stay, helper-prefixed ones are an error.
    """
    return quality_rules.keep_good(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest doc_id.

    Texts without words are one group; rows without doc_id and rows that share the smallest one all stay;
    very long texts are read whole; an empty table stays empty; extra columns stay.
    """
    return simhash.keep_one(spark, docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item or passage of one.

    Null and empty texts and rows without doc_id stay; repeated rows stay or go together; very long texts
    are searched whole; an empty table stays empty, an empty benchmark drops nothing; extra columns stay.
    """
    return decontaminate.keep_clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the target weights, four fifths of all words, each at most once.

    Texts without words go; rows of one doc_id (or without any) are taken together; of equal order keys the
    smaller id comes first; very long texts are counted whole; an empty table stays empty; extra columns stay.
    """
    return mixing.apply_mix(spark, docs, WEIGHTS, share=0.8, epochs=1)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the documents, read back: doc_id, start, n_tokens and ids_crc32 of each.

    Null texts are empty documents (the end id alone); null ids come first; repeated rows are written
    repeatedly; very long texts are one frame; an empty table gives no rows; other columns are left out.
    """
    path = scratch(spark, "tokens")
    token_store.write(spark, docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.digest(spark, path)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", clean),
    ("mix_sources", mix),
    ("token_output", tokens),
]

#: SimHash groups, edit distances and token ids aren't SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(spark, stage(spark, docs, sf_dir), name)
    return docs
