"""A corpus pipeline of five operators: each stage works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Documents the classifier rejects go; one document of each near-duplicate class stays; secrets are
replaced by a mark; sources are mixed to target weights, which repeats documents and may cut one short for
each source; the texts are then encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, classifier, common, mixing, ngrams, secrets


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.good_documents(docs, common.table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngrams.one_per_class(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]
#: Models, similarity joins and merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = common.stored(docs, f"stage{number}")
    return docs
