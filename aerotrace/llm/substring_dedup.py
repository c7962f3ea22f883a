"""Removal of repeated passages by difference-cover anchors.

Of every residue pair modulo 13 some shift below 13 moves both into the cover
{0, 1, 3, 9}, so two equal stretches of 20 words, wherever they start, share an
8-word anchor that starts at a cover position in both.  Only anchors are hashed
and compared at first (4 of 13 positions); around anchors that occur more than
once all 20-word windows are then extended and compared by 128-bit fingerprints,
made of two hashes with nothing in common down to the bytes of the words, and
every window but the first of its word sequence marks its words for removal.

Hot passages: each block of documents sends one entry per distinct anchor or
window, whatever number of documents holds it, so a passage found in a third of
all documents costs as many entries as there are blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import id_of, key_of, shuffle_partitions

PERIOD, COVER = 13, (0, 1, 3, 9)
U = np.uint64
#: Seed of the second hash of words and windows.
SECOND = 0x9FB21C651E98DF25
#: What a row holds of its entries: numbers as 16-bit planes, so that those that are mostly 0 compress away.
PLANES = {"k": 4, "fp": 4, "counts": 2, "pos": 2, "hash": 4, "more": 4}
ENTRY = "pid int, kind int, " + ", ".join(f"{name}{i} binary" for name, n in PLANES.items() for i in range(n))
MARKS = "k long, fp long, marks binary"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _planes(values: np.ndarray, n: int, cuts: np.ndarray) -> list[pa.Array]:
    values = values.astype(U)
    return [tv.binaries((values >> U(16 * i)).astype(np.uint16), cuts) for i in range(n)]


def _entries(kind: int, pid, k, fp, pos, hashes, parts: int):
    """A batch with one row per receiving partition; its entries lie sorted by document.

    kind 0: entries with hashes, to be compared; kind 1: marks on their way to their documents.
    """
    if not len(pos):
        return
    order = np.lexsort((pos, fp, k, pid))
    pid, k, fp, pos = pid[order], k[order], fp[order], pos[order]
    row = tv.group_starts(pid)
    new = np.zeros(len(pid), bool)
    new[row] = True
    new[1:] |= (k[1:] != k[:-1]) | (fp[1:] != fp[:-1])
    doc = np.flatnonzero(new)
    at = np.append(np.searchsorted(doc, row), len(doc))
    cuts = np.append(row, len(pid))
    step = np.diff(k[doc], prepend=0)
    step[at[:-1]] = k[doc][at[:-1]]
    columns = _planes(step.view(U), 4, at) + _planes(fp[doc].view(U), 4, at) + _planes(np.diff(np.append(doc, len(pid))), 2, at) + _planes(pos, 2, cuts)
    if kind == 0:
        h, more = hashes[0][order], hashes[1][order]
        columns += _planes(h, 4, cuts) + _planes(more, 4, cuts)
    else:
        columns += [pa.array([b""] * len(row), pa.binary())] * 8
    yield pa.RecordBatch.from_arrays([pa.array(pid[row].astype(np.int32)), pa.array(np.full(len(row), kind, np.int32)), *columns], schema=_schema(ENTRY))


def _read(batch: pa.RecordBatch):
    """(kind, k, fp, pos, hash, more) of each row."""
    columns = batch.columns
    for i in range(batch.num_rows):
        planes = iter(np.frombuffer(x[i].as_buffer(), np.uint16).astype(U) for x in columns[2:])
        got = {name: sum((next(planes) << U(16 * j) for j in range(n)), np.zeros((), U)) for name, n in PLANES.items()}
        n = got["counts"].astype(np.int64)
        k = np.repeat(np.cumsum(got["k"].view(np.int64)), n)
        yield columns[1][i].as_py(), k, np.repeat(got["fp"].view(np.int64), n), got["pos"].astype(np.int64), got["hash"], got["more"]


def _first_only(k, fp, pos, h, more):
    """Splits entries into the first of each fingerprint by (id, position), with its count, and the others elsewhere."""
    order = np.lexsort((pos, fp, k, more, h))
    h, more, k, fp, pos = (x[order] for x in (h, more, k, fp, pos))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(h)))
    # a row that repeats both id and text has its entries at the same places: they are no others
    lead = np.repeat(at, counts)
    rest = (k != k[lead]) | (fp != fp[lead]) | (pos != pos[lead])
    return (k[new], fp[new], pos[new], h[new], more[new]), counts, (k[rest], fp[rest], pos[rest])


def _ids(batch: pa.RecordBatch):
    return (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("k", "fp"))


def _home(k: np.ndarray, parts: int) -> np.ndarray:
    """Where the marks of a document are gathered."""
    return tv.mix(k.astype(U), 7) % U(parts)


def _gathered(found, send, parts: int):
    """Sends what ``found`` yields in blocks: large enough for full rows, however many partitions receive them."""
    held, n = [], 0
    for x in found:
        held.append(x)
        n += len(x[0])
        if n >= max(400_000, 64 * parts):
            yield from send(*(np.concatenate(y) for y in zip(*held, strict=True)))
            held, n = [], 0
    if n:
        yield from send(*(np.concatenate(y) for y in zip(*held, strict=True)))


def _anchors(window: int, parts: int):
    """Map side: one entry per distinct anchor of a block; what repeats inside the block is marked at once."""
    size = window - PERIOD + 1
    in_cover = np.zeros(PERIOD, bool)
    in_cover[list(COVER)] = True

    def found(batches):
        for batch in batches:
            ks, fps = _ids(batch)
            for c in tv.chunks(batch.column(batch.schema.get_field_index("text"))):
                c.words()
                at, h = c.windows(c.word_hashes(), size)
                local = at - c.w_from[c.w_doc[at]]
                use = in_cover[local % PERIOD] & (c.w_count[c.w_doc[at]] >= window)
                doc = c.first + c.w_doc[at[use]]
                yield ks[doc], fps[doc], local[use], h[use]

    def send(k, fp, pos, h):
        first, counts, rest = _first_only(k, fp, pos, h, np.zeros(len(h), U))
        often = counts > 1
        # the second number says that the block itself has it twice: it is marked here
        yield from _entries(0, first[3] % U(parts), *first[:3], (first[3], often.astype(U)), parts)
        marked = [np.concatenate((a[often], b)) for a, b in zip(first[:3], rest, strict=True)]
        yield from _entries(1, _home(marked[0], parts), *marked, None, parts)

    return lambda batches: _gathered(found(batches), send, parts)


def _windows(window: int, parts: int):
    """Map side of the extension: all windows around marked anchors, one entry per distinct window of a block."""
    size = window - PERIOD + 1

    def found(batches):
        for batch in batches:
            ks, fps = _ids(batch)
            marks = batch.column(batch.schema.get_field_index("marks"))
            for c in tv.chunks(batch.column(batch.schema.get_field_index("text"))):
                c.words()
                at, h = c.windows(c.word_hashes(), window)
                _, more = c.windows(c.word_hashes(seed=SECOND), window, SECOND)
                hit = np.zeros(len(c.w_start) + 1, np.int64)
                for i in range(c.n):
                    p = np.frombuffer(marks[c.first + i].as_buffer(), np.uint32).astype(np.int64)
                    hit[p[p + size <= c.w_count[i]] + c.w_from[i]] = 1
                reach = np.concatenate(([0], np.cumsum(hit)))
                use = reach[at + PERIOD] > reach[at]  # an anchor that starts at one of the first 13 words lies inside
                at, h, more = at[use], h[use], more[use]
                doc = c.first + c.w_doc[at]
                yield ks[doc], fps[doc], at - c.w_from[c.w_doc[at]], h, more

    def send(k, fp, pos, h, more):
        first, _, rest = _first_only(k, fp, pos, h, more)
        yield from _entries(0, first[3] % U(parts), *first[:3], first[3:], parts)
        yield from _entries(1, _home(rest[0], parts), *rest, None, parts)

    return lambda batches: _gathered(found(batches), send, parts)


def _meet(anchors: bool, parts: int):
    """Reduce side: which entries of a partition are marked; marks go on to their documents' partitions."""

    def send(k, fp, pos):
        yield from _entries(1, _home(k, parts), k, fp, pos, None, parts)

    def run(batches):
        held, passed = [], []
        for batch in batches:
            for kind, k, fp, p, h, more in _read(batch):
                (held if kind == 0 else passed).append((k, fp, p, h, more) if kind == 0 else (k, fp, p))
        if passed:
            yield from _gathered(passed, send, parts)
        if not held:
            return
        k, fp, p, h, more = (np.concatenate(x) for x in zip(*held, strict=True))
        del held, passed
        if anchors:
            order = np.argsort(h, kind="stable")
            start = tv.group_starts(h[order])
            size = np.diff(np.append(start, len(h)))
            many = np.empty(len(h), bool)
            many[order] = np.repeat(size > 1, size)
            use = many & (more == 0)
            yield from send(k[use], fp[use], p[use])
        else:
            _, _, rest = _first_only(k, fp, p, h, more)
            yield from send(*rest)

    return run


def _marks(batches):
    """One row per document with its marked positions."""
    held = [x[1:4] for batch in batches for x in _read(batch)]
    if not held:
        return
    k, fp, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((pos, fp, k))
    k, fp, pos = k[order], fp[order], pos[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (fp[1:] != fp[:-1])
    at = np.flatnonzero(new)
    for i in range(0, len(at), 10_000):
        cut = np.append(at, len(k))[i : i + 10_001]
        yield pa.RecordBatch.from_arrays([pa.array(k[cut[:-1]]), pa.array(fp[cut[:-1]]), tv.binaries(pos[cut[0] : cut[-1]].astype(np.uint32), cut - cut[0])], schema=_schema(MARKS))


def _removed(window: int):
    """Which words go, what stays and its digest."""
    sha = hashlib.sha256

    def run(batches):
        for batch in batches:
            ks, _ = _ids(batch)
            marks = batch.column(batch.schema.get_field_index("marks"))
            for c in tv.chunks(batch.column(batch.schema.get_field_index("text"))):
                c.words()
                step = np.zeros(len(c.w_start) + 1, np.int64)
                for i in range(c.n):
                    x = marks[c.first + i].as_buffer()
                    if x is not None:
                        p = np.frombuffer(x, np.uint32).astype(np.int64) + c.w_from[i]
                        np.add.at(step, p, 1)
                        np.add.at(step, p + window, -1)
                gone = np.cumsum(step[:-1]) > 0
                # bytes of the kept words, each with the byte after it, if its document has one, as a space
                keep = ~gone
                inner = ~np.isin(c.w_end, c.offs[1:])
                edge = np.zeros(len(c.buf) + 2, np.int8)
                np.add.at(edge, c.w_start[keep], 1)
                np.add.at(edge, (c.w_end + inner)[keep], -1)
                mask = np.cumsum(edge[:-2], dtype=np.int8) > 0
                buf = c.buf.copy()
                buf[c.w_end[inner]] = 32
                removed = np.bincount(c.w_doc[gone], minlength=c.n)
                texts = [buf[lo:hi][mask[lo:hi]].tobytes().rstrip(b" ") for lo, hi in zip(c.offs[:-1], c.offs[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ks[c.first : c.first + c.n]), pa.array(c.w_count.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([sha(t).hexdigest() for t in texts]), pa.array([t.decode() for t in texts])],
                    names=["k", "n_words", "n_removed", "kept_sha256", "kept_text"],
                )

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, with_text: bool = True) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 and, if asked for, kept_text.

    A word goes if a window of ``window`` words (20 or more, never across
    documents) that covers it has the same word sequence as an earlier window:
    one with a smaller id, or an earlier start in the same document.  A null
    text is empty; a null id counts as larger than all others; texts with fewer
    words than a window stay whole; rows that repeat both id and text are one
    document and all stay; rows that share an id are told apart by a 64-bit hash of
    their texts.  Other columns are ignored; no rows in, no rows out.  Kept words
    are joined by one space.
    """
    if window < PERIOD + 7:
        raise ValueError(f"window must be {PERIOD + 7} words at least")
    parts = shuffle_partitions(docs.sparkSession)
    base = docs.select(key_of(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("fp", F.xxhash64("text"))

    def marked(entries: DataFrame, anchors: bool) -> DataFrame:
        met = entries.repartitionById(parts, F.col("pid")).mapInArrow(_meet(anchors, parts), ENTRY)
        found = met.repartitionById(parts, F.col("pid")).mapInArrow(_marks, MARKS)
        return base.join(found, ["k", "fp"], "left").select("k", "fp", "text", "marks")

    around = marked(base.mapInArrow(_anchors(window, parts), ENTRY), True)
    again = marked(around.filter("marks IS NOT NULL").mapInArrow(_windows(window, parts), ENTRY), False)
    out = again.mapInArrow(_removed(window), "k long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    columns = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
    return out.select(id_of("k").alias(id_col), *columns)
