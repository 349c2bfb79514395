"""The corpus pipeline: from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import language_id, line_dedup, mixing, ngram_join, sentencepiece_codec
from docquarry.llm.common import Scratch, clear, opened


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: those without letters, and noise."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.rewrite(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.rewrite(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(docs, sentencepiece_codec.load_model())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL expresses neither the parser, the bisection nor the codec.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables, before = Scratch(spark, "pipeline"), None
    for name, stage in STAGES[:-1]:
        others = opened()
        docs = tables.stored(stage(spark, docs, sf_dir), name)
        clear(keep=others)  # the stage's intermediate tables
        if before:
            tables.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
