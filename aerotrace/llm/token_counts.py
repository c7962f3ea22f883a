"""Exact token counts from a length histogram.

Documents are encoded and counted per encoded length, so all later work is on
one row per distinct length.  Suffix sums over the lengths then answer, for a
context limit of any length L: how many documents are at least that long, all
tokens of these, the total when every document is cut at L, and where L stands
among the quantiles.  The sums are taken in two levels, over ranges of lengths
and inside each range, so no task sees all lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as tv
from .bpe import chunk_ids, vocabulary
from .common import saved

#: Lengths per range of the two-level sums.
RANGE = 1024


def _lengths(path: str):
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for c in tv.chunks(batch.column(0)):
                lengths, counts = np.unique(np.diff(chunk_ids(c, v, fast=True)[1]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array(counts)], names=["n_tokens", "n_docs"])

    return run


def length_histogram(docs: DataFrame, vocab: str, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: one row per encoded length; a null or empty text has length 0."""
    # kept: the sums look at the histogram more than once
    pairs = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_lengths(vocab), "n_tokens long, n_docs long")
    return saved(pairs.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")))


def limits_table(histogram: DataFrame) -> DataFrame:
    """What every context limit gives, one row per distinct length taken as the limit.

    n_tokens, n_docs; docs_at_least and tokens_at_least (documents of that
    length or more); docs_before (shorter ones); truncated_total (tokens that
    stay when all documents are cut at n_tokens); total_docs, total_tokens;
    quantile (share of documents of that length or less).  No rows in, no rows out.
    """
    h = histogram.withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "part": F.floor(F.col("n_tokens") / RANGE)})
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("part_docs"), F.sum("tokens").alias("part_tokens"))
    behind = W.partitionBy(F.lit(0)).orderBy(F.col("part").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(0))
    none = lambda c: F.coalesce(c, F.lit(0))
    parts = parts.select("part", none(F.sum("part_docs").over(behind)).alias("later_docs"), none(F.sum("part_tokens").over(behind)).alias("later_tokens"), F.sum("part_docs").over(whole).alias("total_docs"), F.sum("part_tokens").over(whole).alias("total_tokens"))
    inside = W.partitionBy("part").orderBy(F.col("n_tokens").desc())
    x = h.join(parts, "part").withColumns({"docs_at_least": F.col("later_docs") + F.sum("n_docs").over(inside), "tokens_at_least": F.col("later_tokens") + F.sum("tokens").over(inside)})
    n: Column = F.col("n_tokens")
    return x.select(
        "n_tokens", "n_docs", "docs_at_least", "tokens_at_least", (F.col("total_docs") - F.col("docs_at_least")).alias("docs_before"),
        (F.col("total_tokens") - F.col("tokens_at_least") + n * F.col("docs_at_least")).alias("truncated_total"), "total_docs", "total_tokens",
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
    )


def token_counts(docs: DataFrame, vocab: str, text_col: str = "text") -> DataFrame:
    """limits_table of the documents' encoded lengths; other columns are ignored."""
    return limits_table(length_histogram(docs, vocab, text_col))


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """What given context limits give, whether or not a document has that length.

    table: limits_table.  limit, docs_at_least, tokens_at_least, docs_before,
    truncated_total, total_docs, total_tokens: one row per distinct limit, from
    the sums of the next longer length.  No rows in, no rows out.
    """
    asked = table.sparkSession.createDataFrame([(int(x),) for x in sorted(set(limits))], "limit long")
    longer = F.when(F.col("n_tokens") >= F.col("limit"), F.struct("n_tokens", "docs_at_least", "tokens_at_least"))
    x = table.crossJoin(F.broadcast(asked)).groupBy("limit").agg(F.min(longer).alias("next"), F.first("total_docs").alias("total_docs"), F.first("total_tokens").alias("total_tokens"))
    x = x.withColumns({c: F.coalesce(F.col(f"next.{c}"), F.lit(0).cast("long")) for c in ("docs_at_least", "tokens_at_least")})
    return x.select(
        "limit", "docs_at_least", "tokens_at_least", (F.col("total_docs") - F.col("docs_at_least")).alias("docs_before"),
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("limit") * F.col("docs_at_least")).alias("truncated_total"), "total_docs", "total_tokens",
    )
