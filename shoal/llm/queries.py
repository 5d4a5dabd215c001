"""Queries of the text operators, for ``__spark_entry__``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import counts, decontam, licenses, lm, media, mixing, neardup, quality, resample, search, spm, tokenbin, toxicity
from .text import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.posterior(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.stored(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op7_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lex = toxicity.learn(toxicity.training(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return toxicity.scored(docs, lex).select("doc_id", held.alias("held_out"), "score", "predicted")


def op9_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digests(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_quality_bayes, op2_maxent_scores, op3_order_minhash, op4_token_codes, op5_audio_features, op6_token_counts, op7_string_tiling, op8_toxicity_lexicon, op9_licence_rules, op10_sentencepiece, op11_importance_resampling, op12_source_mixing, op13_lexical_search)}
ORACLES = {"op9_licence_rules": licenses.scan_sql(), "op12_source_mixing": mixing.mixed_sql(), "op13_lexical_search": search.ranked_sql()}
