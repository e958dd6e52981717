"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; its result is written as
Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import base, decontaminate, exact_dedup, language, near_dedup, packing


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go: they have no language."""
    return language.keep_known(docs)


def one_of_equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row of the largest doc_id stays; of repeated rows one. Null and empty texts are equal."""
    return exact_dedup.drop_copies(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the row of the smallest doc_id stays; texts without words are classes of their own, repeated rows one."""
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more stands in windows of the benchmark's items go; null texts stay."""
    return decontaminate.drop_contaminated(docs, base.table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, as op7_packing gives them; a null text is one piece of its end id."""
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("language", known_language),
    ("exact_dedup", one_of_equal_texts),
    ("near_dedup", one_of_near_copies),
    ("decontaminate", without_benchmark),
    ("pack", packed),
]

#: SQL can express neither the language model nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents. What the stages before have written goes as soon as the next one's result is stored."""
    docs = base.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = base.stash(stage(spark, docs, sf_dir))
        base.release(spark, keep=docs)
    return docs
