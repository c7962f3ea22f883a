"""Exact deduplication by counting quotient filters with byte verification.

Every partition builds a counting quotient filter over the 64-bit fingerprints
of its documents: the quotient selects a run, runs keep sorted remainders of 48
bits with counts.  Filters are cut by quotient range, and the ranges of all
partitions merge losslessly, remainder by remainder, since runs are sorted.  A
fingerprint counted once belongs to a unique document, whose text stays where it
is; the others route their documents to a comparison of whole normalised texts.

Hot texts: a text that a third of all rows hold is one counter per partition in
the filters and one row per chunk in the comparison; only ids and digests travel
per document, in a join that adaptive execution can split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import keyfilter
from . import textvec as tv
from .common import id_of, key_of, saved, shuffle_partitions

U = np.uint64


class QuotientFilter:
    """Counts of 64-bit fingerprints between two quotients: run lengths, sorted remainders, counts."""

    QUOTIENT_BITS = 16
    REMAINDER_BYTES = 6

    def __init__(self, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray, first: int = 0):
        self.runs, self.remainders, self.counts, self.first = runs, remainders, counts, first

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, first: int = 0, quotients: int = 1 << 16) -> QuotientFilter:
        order = np.argsort(fingerprints, kind="stable")
        f = fingerprints[order]
        c = np.ones(len(f), np.int64) if counts is None else counts[order]
        at = tv.group_starts(f)
        f, c = f[at], np.add.reduceat(c, at) if len(at) else c
        shift = U(64 - cls.QUOTIENT_BITS)
        runs = np.bincount((f >> shift).astype(np.int64) - first, minlength=quotients)
        return cls(runs.astype(np.uint32), f & ((U(1) << shift) - U(1)), c, first)

    def fingerprints(self) -> np.ndarray:
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64) + U(self.first), self.runs)
        return (quotients << U(64 - self.QUOTIENT_BITS)) | self.remainders

    def ranges(self, parts: int):
        """This filter cut into ``parts`` ranges of quotients."""
        edges = np.linspace(0, len(self.runs), parts + 1).astype(np.int64)
        at = np.concatenate(([0], np.cumsum(self.runs, dtype=np.int64)))[edges]
        for i in range(parts):
            if at[i] < at[i + 1]:
                yield i, QuotientFilter(self.runs[edges[i] : edges[i + 1]], self.remainders[at[i] : at[i + 1]], self.counts[at[i] : at[i + 1]], int(edges[i]))

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """The filter of both inputs; no fingerprint or count is lost.  Sorted remainders are merged run by run, nothing is sorted again."""
        a, b = self.fingerprints(), other.fingerprints()
        at_a, at_b = np.arange(len(a)) + np.searchsorted(b, a, "left"), np.arange(len(b)) + np.searchsorted(a, b, "right")
        remainders, counts, both = np.empty(len(a) + len(b), U), np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), U)
        for at, x, fingerprints in ((at_a, self, a), (at_b, other, b)):
            remainders[at], counts[at], both[at] = x.remainders, x.counts, fingerprints
        new = tv.group_starts(both)
        doubled = np.searchsorted(a, b, "right") > np.searchsorted(a, b, "left")
        quotients = np.repeat(np.arange(len(self.runs)), other.runs)
        runs = self.runs + other.runs - np.bincount(quotients[doubled], minlength=len(self.runs)).astype(np.uint32)
        return QuotientFilter(runs, remainders[new], np.add.reduceat(counts, new) if len(new) else counts, self.first)

    def packed(self) -> tuple[int, bytes, bytes, bytes]:
        """First quotient, run lengths, remainders of 6 bytes each, counts."""
        return self.first, self.runs.tobytes(), self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : self.REMAINDER_BYTES].tobytes(), self.counts.tobytes()

    @classmethod
    def unpacked(cls, first: int, runs: bytes, remainders: bytes, counts: bytes) -> QuotientFilter:
        wide = np.zeros((len(remainders) // cls.REMAINDER_BYTES, 8), np.uint8)
        wide[:, : cls.REMAINDER_BYTES] = np.frombuffer(remainders, np.uint8).reshape(-1, cls.REMAINDER_BYTES)
        return cls(np.frombuffer(runs, np.uint32), wide.view("<u8").ravel(), np.frombuffer(counts, np.int64), first)


def normalised(c: tv.Chunk) -> list[bytes]:
    """Each text with every run of white space as one space."""
    space = tv.SPACE[c.buf]
    run_on = np.zeros(len(space), bool)
    run_on[1:] = space[1:] & space[:-1]
    starts = c.offs[:-1]
    run_on[starts[starts < len(space)]] = False
    buf = np.where(space, np.uint8(32), c.buf)[~run_on]
    at = np.concatenate(([0], np.cumsum(~run_on)))[c.offs]
    return [buf[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _digests(batches):
    for batch in batches:
        ks = _column(batch, "k")
        for c in tv.chunks(_column(batch, "text")):
            digests = [hashlib.sha256(t).digest() for t in normalised(c)]
            fp = np.frombuffer(b"".join(d[:8] for d in digests), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([ks.slice(c.first, c.n), pa.array(fp), pa.array([d.hex() for d in digests])], names=["k", "fp", "sha"])


def _filters(parts: int):
    """The filter of a partition, cut into ranges."""

    def run(batches):
        held = [(_column(batch, "fp").to_numpy().view(U), _column(batch, "n").to_numpy()) for batch in batches]
        if not held:
            return
        q = QuotientFilter.build(*(np.concatenate(x) for x in zip(*held, strict=True)))
        rows = [(i, *x.packed()) for i, x in q.ranges(parts)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["pid", "first", "runs", "remainders", "counts"])

    return run


def _merged(batches):
    """Merges the filters of one range pairwise, like equal powers of two; yields what is counted twice or more."""
    stack: list[tuple[int, QuotientFilter]] = []
    for batch in batches:
        for _, *packed in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            new = (1, QuotientFilter.unpacked(*packed))
            while stack and stack[-1][0] <= new[0]:
                n, q = stack.pop()
                new = (n + new[0], q.merge(new[1]))
            stack.append(new)
    if stack:
        _, q = stack.pop()
        for _, other in stack[::-1]:
            q = q.merge(other)
        yield pa.RecordBatch.from_arrays([pa.array(q.fingerprints()[q.counts > 1].view(np.int64))], names=["fp"])


def _texts(often):
    """Per chunk one row for each distinct normalised text that the filter of repeated fingerprints may hold, with its smallest id and count."""

    def run(batches):
        for batch in batches:
            ks = _column(batch, "k").to_numpy()
            for c in tv.chunks(_column(batch, "text")):
                held: dict[bytes, list[int]] = {}
                for i, t in enumerate(normalised(c)):
                    k = int(ks[c.first + i])
                    if t in held:
                        x = held[t]
                        x[0], x[1] = min(x[0], k), x[1] + 1
                    else:
                        held[t] = [k, 1]
                digests = [hashlib.sha256(t).digest() for t in held]
                fp = np.frombuffer(b"".join(d[:8] for d in digests), ">i8").astype(np.int64)
                use = keyfilter.passes(often.value, fp)
                of = lambda values, kind: pa.array([x for x, u in zip(values, use, strict=True) if u], kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp[use]), of([d.hex() for d in digests], pa.string()), of(held, pa.binary()), of([x[0] for x in held.values()], pa.int64()), of([x[1] for x in held.values()], pa.int64())],
                    names=["fp", "sha", "norm", "k", "n"],
                )

    return run


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one
    space; a null text is empty.  The row with the smallest id stays; a null id
    is larger than all others.  Of rows that repeat both id and text one counts
    as kept.  Other columns are ignored; no rows in, no rows out.
    """
    parts = min(shuffle_partitions(docs.sparkSession), 1 << 12)
    base = docs.select(key_of(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    rows = saved(base.mapInArrow(_digests, "k long, fp long, sha string").groupBy("k", "fp", "sha").agg(F.count("*").alias("n")))
    often = rows.select("fp", "n").mapInArrow(_filters(parts), "pid int, first int, runs binary, remainders binary, counts binary").repartitionById(parts, F.col("pid")).mapInArrow(_merged, "fp long")
    often = saved(often)
    groups = base.mapInArrow(_texts(keyfilter.build(often, often.count())), "fp long, sha string, norm binary, k long, n long").join(often, "fp", "left_semi").groupBy("fp", "norm").agg(F.first("sha").alias("sha"), F.min("k").alias("keep"), F.sum("n").alias("size")).select("sha", "keep", "size")
    told = rows.join(groups, "sha", "left").select("k", "sha", F.coalesce("keep", "k").alias("keep"), F.coalesce("size", "n").alias("group_size"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return told.select(id_of("k").alias(id_col), id_of("keep").alias("keep_id"), "group_size", ((F.col("k") == F.col("keep")) & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns, whatever their names.

    A null text is empty; of rows that repeat both id and text one stays; no rows
    in, no rows out.
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(key_of(id_col).alias("k"), F.col("text_sha256").alias("sha"))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    named = docs.select(key_of(id_col).alias("k"), sha.alias("sha"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).join(kept, ["k", "sha"], "left_semi")
    # rows that repeat both id and text are interchangeable: one of them stays
    return named.dropDuplicates(["k", "sha"]).select("row.*")
