"""A training corpus from raw documents: five stages, each over all rows that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's rows as Parquet to the shared checkpoint folder and reads them again.  All
stages but the last return the columns of documents, whatever further columns there are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from watchloom.llm import decontaminate, language, near_dedup, packing, pii
from watchloom.llm.queries import tokenizer_path
from watchloom.llm.textops import bounded_batches, documents, shared_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told from their text; a null or letterless text goes."""
    bounded_batches(spark)
    return language.known_language(docs, language.fit(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    bounded_batches(spark)
    return near_dedup.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item: 80 % of its five-word shingles."""
    bounded_batches(spark)
    return decontaminate.without_leaks(docs, documents(spark, sf_dir, "benchmark"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced in their texts."""
    return pii.pseudonymise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, as pieces with their ids, sequence and offset."""
    bounded_batches(spark)
    return packing.pack(docs, tokenizer_path(), size=2048, end=0, with_ids=True)


STAGES = [
    ("language", known_language),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", without_benchmark),
    ("pii", pseudonyms),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    base = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs


#: The fitted language model and the MinHash classes can't be said in SQL; tests hold them against brute force.
ORACLE_SQL = None
