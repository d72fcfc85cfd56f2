"""Corpus pipeline: language ID, exact dedup, n-gram Jaccard join, source mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's ``docs``. All but the last return the columns of
``documents``. Empty tables pass through every stage; nulls fare as the operators' docstrings state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.functions.scale import materialise
from tallyloom.llm import exact_dedup, language, mixing, ngram_join, packing


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents and keeps those with a recognised language."""
    return language.keep_known(docs, language.fit(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_exact(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of linked documents the one with the smallest doc_id stays."""
    return ngram_join.drop_near(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents until each source is near its target share."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.packed_documents(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("ngram_jaccard_join", near_duplicates),
          ("source_mix", source_mix), ("packing", pack)]

#: Naive Bayes and column generation have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
