"""A training-corpus pipeline of five stages over the table ``documents``.

Toxic documents go, poor documents go, one document of each group of near duplicates stays,
documents with benchmark passages go, and the rest is encoded by SentencePiece and decoded again.
Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the next one's docs. Labels and the benchmark come from ``sf_dir``; classifiers learn from the labelled
rows among the stage's own documents. Stages see whole rows, so null texts, repeated rows and extra
columns pass on as each operator's module says; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shoal.llm import decontam, neardup, quality, spm, toxicity
from shoal.llm.queries import tokenizer
from shoal.llm.text import materialize, table

#: Some stage can't be expressed in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lexicon = toxicity.learn(toxicity.training(docs, table(spark, sf_dir, "labels")))
    return toxicity.drop_toxic(docs, lexicon)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_poor(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spm.digests(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
