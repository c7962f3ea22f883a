"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerotrace.llm.common import checkpoint_dir, key_of, load
from aerotrace.llm.exact_dedup import drop_copies
from aerotrace.llm.near_dedup import near_duplicates
from aerotrace.llm.packing import pack
from aerotrace.llm.quality_rules import keep_good
from aerotrace.llm.queries import vocab
from aerotrace.llm.secret_scan import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null text is rejected."""
    return keep_good(docs, load(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts: the one with the smallest id."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id.

    Rows are told apart by id and text; rows equal in both, of which the stage before leaves one, stay together.
    """
    kept = near_duplicates(docs, words=5, percent=80, with_hash=True).filter("kept").select(key_of("doc_id").alias("k"), F.col("text_hash").alias("f")).distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # whatever the columns are called
    named = docs.select(key_of("doc_id").alias("k"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("f"), row)
    return named.join(kept, ["k", "f"], "left_semi").select("row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts and n_chars counted anew where that changed one."""
    return redact(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 1024 tokens."""
    return pack(docs, vocab(), size=1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("secret_scan", secrets),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = load(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
