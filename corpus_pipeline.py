"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, written as
Parquet and read again. All but the last return the columns of documents.

Defined results: rows whose text is null, empty or without words are never toxic and never near copies;
equal texts, empty ones too, are exact copies, null ones aren't; rows of a null id pass the near-copy
stage; of rows that agree in id and text one stays; of near copies that of the least id; the sample decides between
what is left, a null source being one of its own; a null text that is sampled has null tokens; an empty
table gives an empty result; columns beyond those of documents go along to the last stage, whatever
their names, and play no part. The same input gives the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from teleskein.llm import _spark, bpe, exact_dedup, jaccard_join, mixing, toxicity


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of operator 1 doesn't reject; it is fitted on these documents' labels."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, _spark.read(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near copies connect."""
    return jaccard_join.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample in which every source has the same share of tokens."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, tokens, round_trip) of every document."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources to target weights", mixed),
    ("byte-level BPE encoding and decoding", encoded),
]

#: Training, connected components and sampling have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = _spark.read(spark, sf_dir, "documents")
    folder = f"{_spark.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
