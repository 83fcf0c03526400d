"""A corpus pipeline of five operators; each stage reads the Parquet that the one before wrote.

In every stage: an empty table gives an empty result, other columns are kept whatever their names (the last stage returns
packed rows instead), texts are read whole, and rows are judged one by one, so a null or repeated doc_id never makes rows
share a fate that their texts don't. Each stage states what else is defined.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from axolin.llm import decontaminate, mixing, packing, quality, simhash
from axolin.llm.common import checkpoint_ready, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier accepts. A null text is an empty one; equal texts score alike; a score of the very
    threshold is accepted; without labels of both kinds all rows stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the smallest doc_id, rows without one last, any one of equals. Null and
    blank texts are one group."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no benchmark passage; null texts stay, and an empty benchmark drops nothing."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it, up to three times; texts without words are not taken. A null source is a
    source of its own; repeated rows are taken each by itself."""
    return mixing.take_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed rows of token ids; null texts are empty documents, and every row of docs is packed, repeats too."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", packed),
]

#: Training, hashing and packing have no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet below the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    checkpoint_ready(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
