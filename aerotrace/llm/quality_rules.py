"""Quality rules: a hashed n-gram log-likelihood ratio beside simple counts.

Each document's overlapping byte 4-grams are hashed to buckets.  Two smoothed
multinomials over the buckets, one of trusted documents and one of the whole raw
corpus, give every bucket a log ratio; a document's score is the mean over its
n-grams, in nats, so length cancels out.  A document with a score below the
threshold is rejected, whatever else the corpus holds.

The counts cover all documents; only what goes to the driver is bounded: one
pair of numbers per bucket.  Trusted ids are a bounded sample of the labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import id_of, key_of

U = np.uint64
BUCKETS = 1 << 14
GRAM = 4
#: Mean log ratio per n-gram under which a document is unlike the trusted ones.
THRESHOLD = -0.3
#: Labelled ids that are used at most: those with the smallest hashes.
TRUSTED_IDS = 50_000

SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _grams(c: tv.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each n-gram."""
    n = len(c.buf) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = c.buf.astype(np.uint32)
    g = b[:n] | (b[1 : n + 1] << 8) | (b[2 : n + 2] << 16) | (b[3 : n + 3] << 24)
    inside = np.ones(n, bool)
    cuts = c.offs[1:-1]
    for back in range(1, GRAM):
        at = cuts - back
        inside[at[(at >= 0) & (at < n)]] = False
    doc = np.repeat(np.arange(c.n), np.diff(c.offs))[:n][inside]
    g = g[inside].astype(U) * U(0x9E3779B97F4A7C15)
    return doc, (g >> U(64 - 14)).astype(np.int64)


def _text_of(batch: pa.RecordBatch):
    return batch.column(batch.schema.get_field_index("text"))


def _counts(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        trusted = batch.column(batch.schema.get_field_index("trusted")).to_numpy(zero_copy_only=False)
        for c in tv.chunks(_text_of(batch)):
            doc, g = _grams(c)
            raw += np.bincount(g, minlength=BUCKETS)
            own = trusted[c.first : c.first + c.n]
            if own.any():
                target += np.bincount(g[own[doc]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def _base(c: tv.Chunk) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each document."""
    c.words()
    lead = (c.buf & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead & ~tv.SPACE[c.buf])))
    symbols = np.concatenate(([0], np.cumsum(SYMBOL[c.buf])))
    # 3-word windows found twice or more in their document, as exact numbers of words, pairs and triples
    n = len(c.w_start)
    word = tv.numbered(c.buf, c.w_start, c.w_end)[1]
    at = np.flatnonzero(c.w_doc[: max(n - 2, 0)] == c.w_doc[2:])
    pair = np.unique(word[at] * n + word[at + 1], return_inverse=True)[1]
    triple = np.unique(pair * n + word[at + 2], return_inverse=True)[1]
    key = triple * c.n + c.w_doc[at]
    order = np.argsort(key)
    start = tv.group_starts(key[order])
    size = np.diff(np.append(start, len(key)))
    twice = at[order[np.repeat(size > 1, size)]]
    step = np.zeros(n + 4, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + 3, -1)
    repeated = np.bincount(c.w_doc[np.cumsum(step)[:n] > 0], minlength=c.n)
    # lines with a word, equal to an earlier line of their document
    newline = np.flatnonzero(c.buf == 10)
    ends = np.union1d(newline, c.offs[1:])
    starts = np.union1d(newline + 1, c.offs[:-1])
    starts = starts[starts < len(c.buf)]
    starts = starts[c.buf[starts] != 10]
    ends = ends[np.searchsorted(ends, starts, "right")]
    has = np.searchsorted(c.w_start, starts) < np.searchsorted(c.w_start, ends)
    starts, ends = starts[has], ends[has]
    doc = np.searchsorted(c.offs, starts, "right") - 1
    _, first = np.unique(tv.numbered(c.buf, starts, ends)[1] * c.n + doc, return_index=True)
    dup = np.ones(len(doc), bool)
    dup[first] = False
    return [c.w_count, np.diff(chars[c.offs]), np.diff(symbols[c.offs]), np.bincount(doc[dup], minlength=c.n), repeated]


def _verdicts(weights, threshold: float):
    def run(batches):
        w = weights.value
        for batch in batches:
            ks = batch.column(batch.schema.get_field_index("k"))
            for c in tv.chunks(_text_of(batch)):
                doc, g = _grams(c)
                grams = np.bincount(doc, minlength=c.n)
                score = np.bincount(doc, w[g], c.n) / np.maximum(grams, 1)
                base = [x.astype(np.int64) for x in _base(c)]
                failed = (base[0] < 50) | (100 * base[4] > 50 * base[0])
                yield pa.RecordBatch.from_arrays([ks.slice(c.first, c.n), *map(pa.array, base), pa.array(failed), pa.array(~failed & (score >= threshold)), pa.array(score)], schema=pa.schema([(x, kind) for x, kind in zip(("k", *BASE, "base_failed", "kept", "score"), (*[pa.int64()] * 6, pa.bool_(), pa.bool_(), pa.float64()), strict=True)]))

    return run


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def trusted_ids(labels: DataFrame, limit: int = TRUSTED_IDS) -> DataFrame:
    """At most ``limit`` ids with quality 1 and without the toxic mark, by hash."""
    ids = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def llr_weights(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The log ratio of every bucket; all 0 if no document is trusted."""
    marked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(trusted.select("doc_id", F.lit(True).alias("mark"))), "doc_id", "left")
    got = marked.select("text", F.coalesce("mark", F.lit(False)).alias("trusted")).mapInArrow(_counts, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in got:
        raw[bucket], target[bucket] = r, t
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    A null text is empty and fails; rows are judged one by one, so repeated ids
    or texts have rows of their own; labels that name no document count for
    nothing, and without any trusted document all scores are 0, which passes.
    Other columns are ignored.
    """
    weights = docs.sparkSession.sparkContext.broadcast(llr_weights(docs, trusted_ids(labels), id_col, text_col))
    base = docs.select(key_of(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    out = base.mapInArrow(_verdicts(weights, threshold), "k long, " + ", ".join(f"{x} long" for x in BASE) + ", base_failed boolean, kept boolean, score double")
    return out.select(id_of("k").alias(id_col), *BASE, "base_failed", "kept", "score")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns."""
    weights = docs.sparkSession.sparkContext.broadcast(llr_weights(docs, trusted_ids(labels), id_col, text_col))

    def run(batches):
        for batch in batches:
            text = _text_of(batch) if text_col == "text" else batch.column(batch.schema.get_field_index(text_col))
            one = pa.RecordBatch.from_arrays([pa.array(np.zeros(batch.num_rows, np.int64)), text], names=["k", "text"])
            kept = [x.column(x.schema.get_field_index("kept")) for x in _verdicts(weights, threshold)([one])]
            if kept:
                yield batch.filter(pa.concat_arrays(kept))

    return docs.mapInArrow(run, docs.schema)
