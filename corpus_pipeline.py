"""From raw documents to packed token ids: five stages, each written and read by the next.

Each stage works on all that its predecessor kept. All but the last return the columns of
``documents``; the last writes the token blocks and returns what it reads back from them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flaskmill.llm import chosen_path, compression, decontaminate, mixing, tokens
from flaskmill.llm.queries import ship, table, tokenizer
from flaskmill.session import staging, staging_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good ones."""
    ship(spark)
    return compression.reject_bad(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies."""
    ship(spark)
    return chosen_path.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents as often, and as much of them, as the mix takes."""
    ship(spark)
    return mixing.mixed_documents(docs)


def token_blocks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, read back from the packed blocks."""
    ship(spark)
    path = f"{staging_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    tokens.write_blocks(docs, path, tokenizer())
    return tokens.document_digests(tokens.read_blocks(spark, path))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mixture),
    ("token blocks", token_blocks),
]

#: A trained classifier and a sampled join have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table.

    What a stage keeps for itself is deleted as soon as its rows are written.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{staging_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for at, (_, stage) in enumerate(STAGES[:-1]):
        with staging(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{at}")
        docs = spark.read.parquet(f"{folder}/{at}")
    return STAGES[-1][1](spark, docs, sf_dir)
