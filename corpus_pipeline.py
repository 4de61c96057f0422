"""The corpus pipeline: toxicity, language, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import langid, packing, simhash, substring, toxicity
from graphloom.llm.common import committed, shrink_heaps
from graphloom.llm.queries import END_ID, WORD_BPE, tokenizer_path

#: No SQL expresses learned models; the tests hold the stages against plain versions.
ORACLE_SQL = None


#: Chunks that a packing worker remembers: fewer than alone, since the stages before leave their workers and heaps behind.
STAGE_MEMO = 120_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword model, learned from the labelled ones among them, scores under one half."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and resembles some language; rejected is what resembles none."""
    return langid.keep_identified(docs, langid.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies (shingles of five words, Jaccard similarity 0.8 or more) the document with the smallest id."""
    return simhash.keep_one(docs, shingle=simhash.COPY_SHINGLE, similarity=simhash.COPY_SIMILARITY)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 or more words that an earlier one has."""
    return substring.without_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path(WORD_BPE), END_ID, memo=STAGE_MEMO)


def _after_others(stage):
    """The stage, begun when executors have given back what the stages before left on their heaps."""

    @wraps(stage)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shrink_heaps(spark)
        return stage(spark, docs, sf_dir)

    return begun


STAGES = [(name, _after_others(stage)) for name, stage in [("toxicity", drop_toxic), ("language", keep_languages), ("simhash", drop_near_copies), ("substring", cut_repeats), ("packing", pack_sequences)]]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = committed(docs, f"stage-{name}")
    return docs
