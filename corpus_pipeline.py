"""From documents to packed training sequences.

Every stage works on all that the stage before it kept, is written as Parquet and
read again; all but the last return the columns of documents. What a stage wrote is
deleted when the next one is written; the last one is not written here, so what it
reads stays.

Defined cases, for every stage: a null text is an empty one and stays null; a null
doc_id is a document of its own and stays null; nulls in other columns, and further
columns of any name, are carried along. Empty texts stay in all stages (as the end
token alone in the last). Texts of any length are read whole. Repeated rows: equal
ones are near duplicates, of which one stays, but empty ones all stay; the other
stages treat each alike. Of equal documents the least doc_id stays. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import jaccard, packing, pii, substring, toxicity
from tracewell.llm.common import discard, materialise, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike (five words, 0.8 or more), the least doc_id stays."""
    return jaccard.keep_one(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows seen before are cut out."""
    return substring.remove_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind's name."""
    return pii.redacted(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [
    ("toxicity", toxicity_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("pii", personal_data),
    ("best_fit_packing", sequences),
]

#: Learned models and tokenizers can't be put into SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
