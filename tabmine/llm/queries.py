"""The operators with production parameters over the whole tables, under the names of the contract.

Nulls, empty and long texts, ties, repeated rows, empty tables and other columns: see each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabmine.llm import (
    decontaminate,
    filter_audit,
    language_id,
    language_model,
    mixing,
    pii,
    quality_classifier,
    quality_rules,
    shingle_join,
    simhash,
    spelling,
    token_counts,
    token_store,
)
from tabmine.llm.common import scratch
from tabmine.llm.oracle import MIX_WEIGHTS, ORACLE_SQL  # noqa: F401  operators that SQL cannot express have no entry


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as token ids in a store, read back: doc_id, start, n_tokens, ids_crc32 (``token_store``)."""
    path = scratch(spark, "tokens")
    docs = _table(spark, sf_dir, "documents")
    token_store.write(spark, docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.digest(spark, path)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every text by learned thresholds (``quality_rules.quality``)."""
    return quality_rules.quality(spark, _table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token count of every text over the pieces of a public vocabulary (``token_counts.counts``)."""
    vocab = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts.counts(spark, _table(spark, sf_dir, "documents"), vocab)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document over all words and word pairs (``language_model.score``)."""
    return language_model.score(spark, _table(spark, sf_dir, "documents"))


def op4_lm_scoring_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same: scores over the counts of every word pair, those that occur once included."""
    return op4_lm_scoring(spark, sf_dir)


def op4_lm_scoring_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over the counts of all words, pairs and triples."""
    return language_model.score(spark, _table(spark, sf_dir, "documents"), order=3)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and added spans of personal data in every text (``pii.find``)."""
    return pii.find(spark, _table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken for half of all tokens at the target weights (``mixing.mix``)."""
    return mixing.mix(spark, _table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of benchmark items in every text (``decontaminate.contaminated``)."""
    return decontaminate.contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every text, learned from four fifths of the ids (``quality_classifier.classify``)."""
    return quality_classifier.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from three quarters of the ids (``language_id.identify``)."""
    return language_id.identify(spark, _table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document (``simhash.near_duplicates``)."""
    found = simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove at each step of all 120 orders, per source (``filter_audit.audit``)."""
    return filter_audit.audit(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and group of every document by Jaccard links of word shingles (``shingle_join.near_duplicates``)."""
    return shingle_join.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every frequent word of all texts (``spelling.variants``)."""
    return spelling.variants(spark, _table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_output,
        op2_quality_rules,
        op3_token_counts,
        op4_lm_scoring,
        op4_lm_scoring_all_pairs,
        op4_lm_scoring_trigrams,
        op5_pii,
        op6_mix_sources,
        op7_decontaminate,
        op8_quality_classifier,
        op9_language_id,
        op10_simhash,
        op11_filter_audit,
        op12_shingle_join,
        op13_spelling_variants,
    )
}
