"""Pipeline over the table of documents: rules, copies, near copies, mix, tokens.

Each stage takes (spark, docs, folder of the tables) and returns documents, the last
one their tokens. Between stages the documents are written as Parquet below the shared
folder and read again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, jaccard, mixing, quality
from tidemark.session import shared_folder


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or lie far from their group go."""
    return quality.keep_good(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar texts the document of smallest id stays."""
    return jaccard.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: what each pass of the schedule over a source takes of a document.

    A document taken whole stays as it is; of one that a pass takes in part, the
    words taken stay; one taken by several passes comes as often.
    """
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document of the mix, encoded and decoded again."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode_decode(docs, ranks, public_tokenizers.PATTERN)
    return coded.select(F.col("id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("byte-level bpe", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written and read again."""
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{number}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The minimum-covariance-determinant verdicts and the token ids can't be said in SQL.
ORACLE_SQL = None
