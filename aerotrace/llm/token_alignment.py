"""Two tokenizers side by side: which of their tokens overlap, and how steadily over a corpus.

A text with one space in front is cut into segments where both tokenizers are bound to begin a
token: a space behind anything else but white space.  Distinct segments of an Arrow partition's texts are
encoded once and go to DuckDB as two tables of token intervals.  There an ASOF
join gives each token of A the token of B that holds its start, a second one with a range
condition each token of B that starts inside a token of A, which together are all overlaps; tokens
that end at one offset cut both sides into groups, numbered by window sums.

Documents are put together from their segments.  A document's distinct id pairs
travel as one compressed value.  Documents that hold a pair are counted per part of some megabytes first,
then in Spark; counts come back to the parts that asked, so neither texts
nor a table of all pairs is sent to every document.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import zlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as tv
from .bpe import pretoken_starts, vocabulary
from .common import stored

#: Bytes of text in a part.
PART_BYTES = 1 << 21
#: A pair's code holds B's id in its lower bits; both ids are below 2**16.
B_BITS, PAIR_BITS = 20, 36

_LINKS = """
    SELECT a.seg, a.id AS a, b.id AS b FROM a ASOF JOIN b ON a.s >= b.s
    UNION ALL SELECT b.seg, a.id, b.id FROM b ASOF JOIN a ON b.s > a.s WHERE b.s < a.e"""
_GROUPS = """
    WITH ends AS (SELECT a.e FROM a JOIN b USING (e)),
    marked AS (SELECT a.s, 0 AS side, ends.e IS NOT NULL AS last FROM a LEFT JOIN ends USING (e) UNION ALL SELECT b.s, 1, ends.e IS NOT NULL FROM b LEFT JOIN ends USING (e))
    SELECT side, s, last, (sum(last::INT) OVER (PARTITION BY side ORDER BY s ROWS UNBOUNDED PRECEDING) - last::INT)::BIGINT AS g FROM marked ORDER BY side, s"""


class Pieces:
    """A SentencePiece model, with the bytes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = range(self.model.get_piece_size())
        said = [bytes([int(self.model.id_to_piece(i)[3:-1], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in names]
        if any(b" " in x.lstrip(b" ") for x in said):
            raise ValueError("a piece holds a space behind other characters, so texts can't be cut at spaces")
        self.width = np.fromiter(map(len, said), np.int64, len(said))
        self.flat = np.frombuffer(b"".join(said), np.uint8)
        self.at = np.cumsum(self.width) - self.width
        self.space = self.model.piece_to_id("▁")

    def encode(self, segments: list[bytes]) -> list[list[int]]:
        """The ids of segments that start with a space; the model puts its own in the place of that one."""
        out = self.model.encode([x[1:].decode() for x in segments], num_threads=1)
        return [x or [self.space] for x in out]


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


@functools.cache
def _engine():
    """DuckDB in this worker: one thread, and no files."""
    return duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True})


def _gathered(flat: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    before = np.cumsum(width) - width
    return flat[np.repeat(at - before, width) + np.arange(int(width.sum()))]


def _spaced(c: tv.Chunk) -> tv.Chunk:
    """The chunk with a space in front of every text that isn't empty."""
    size = np.diff(c.offs)
    wider = size + (size > 0)
    offs = np.append(0, np.cumsum(wider))
    buf = np.full(int(offs[-1]), 0x20, np.uint8)
    keep = np.ones(len(buf), bool)
    keep[offs[:-1][size > 0]] = False
    buf[keep] = c.buf
    return tv.Chunk(buf, offs, c.first)


@functools.cache
def _names(count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal ids below ``count``, each followed by a comma, then by a bar, then by a semicolon: bytes, starts, widths."""
    said = [f"{i}{mark}".encode() for i in range(count) for mark in ",|;"]
    width = np.fromiter(map(len, said), np.int64, len(said))
    return np.frombuffer(b"".join(said), np.uint8), np.cumsum(width) - width, width


class Side:
    """The token intervals of one tokenizer over the good segments: segment, start, end and id of each, in order."""

    def __init__(self, lists: list[list[int]], width: np.ndarray, segs: np.ndarray):
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        self.ids = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(n.sum()))
        self.seg = np.repeat(segs, n)
        self.width = width[self.ids]
        self.ends = np.cumsum(self.width)

    def table(self) -> pa.Table:
        return pa.table({"seg": self.seg, "s": self.ends - self.width, "e": self.ends, "id": self.ids})


class Aligned:
    """The distinct segments of a chunk, aligned: ``bad`` marks those whose bytes B doesn't give back."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: list[list[bytes]], vocab, model: Pieces):
        self.count = len(starts)
        one = vocab.library.encode_single_piece
        a_lists = [[i for w in ws for i in one(w)] for ws in words]
        b_lists = model.encode([b"".join(ws) for ws in words])
        b = Side(b_lists, model.width, np.arange(self.count))
        b_ends = np.cumsum(np.bincount(b.seg, b.width, self.count).astype(np.int64))
        self.bad = ~tv.same_spans(_gathered(model.flat, model.at[b.ids], b.width), np.append(0, b_ends)[:-1], b_ends, buf, starts, ends)
        if self.bad.any():
            good = np.flatnonzero(~self.bad)
            a_lists, b = [a_lists[i] for i in good], Side([b_lists[i] for i in good], model.width, good)
        a = Side(a_lists, vocab.width, np.flatnonzero(~self.bad))
        db = _engine()
        db.register("a", a.table())
        db.register("b", b.table())
        try:
            links, groups = (db.sql(q).to_arrow_table() for q in (_LINKS, _GROUPS))
        finally:
            db.unregister("a")
            db.unregister("b")
        of = lambda t, name: t.column(name).to_numpy().astype(np.int64)
        where, self.times = np.unique(of(links, "seg") << PAIR_BITS | of(links, "a") << B_BITS | of(links, "b"), return_counts=True)
        self.codes = where & ((1 << PAIR_BITS) - 1)
        self.cuts = np.searchsorted(where, np.arange(self.count + 1) << PAIR_BITS)
        last, side, seg, ids = of(groups, "last"), of(groups, "side"), np.concatenate((a.seg, b.seg)), np.concatenate((a.ids, b.ids))
        count = lambda x: np.bincount(x, minlength=self.count)
        self.sums = np.array([count(a.seg), count(b.seg), count(a.seg[last[: len(a.seg)] == 1]), np.diff(np.append(0, np.cumsum(self.times))[self.cuts])])  # n_a, n_b, n_groups, n_links
        # ids by group, A's before B's
        order = np.argsort(of(groups, "g") * 2 + side, kind="stable")
        flat, at, width = _names(1 << 16)
        name = (ids * 3 + last * (1 + side))[order]
        said = _gathered(flat, at[name], width[name]).tobytes()
        cut = np.append(0, np.cumsum(np.bincount(seg[order], width[name], self.count).astype(np.int64))).tolist()
        self.said = np.array([said[i:j] for i, j in itertools.pairwise(cut)], object)


def _segments(c: tv.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pretokens of A, and which of these start a segment."""
    starts = pretoken_starts(c)
    behind = np.ones(len(starts), bool)  # not behind a space; a text's own start always is
    inner = ~np.isin(starts, c.offs)
    behind[inner] = c.buf[starts[inner] - 1] != 0x20
    return starts, np.flatnonzero(behind & (c.buf[starts] == 0x20))


DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, part long, asked binary"


def _packed(sorted_values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted numbers as differences, then a count of each, byte by byte of their rank, compressed."""
    both = np.concatenate((np.diff(sorted_values, prepend=0), counts)).astype("<i8")
    return zlib.compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def _aligned_documents(c: tv.Chunk, vocab, model: Pieces) -> tuple[np.ndarray, list, list, bytes]:
    """Sums, digests and packed pairs of each document of a chunk of texts with their spaces, and the chunk's pairs.

    A chunk's pairs are its distinct codes with how many of its documents hold each; a
    document's are places among these with how often it has each.
    """
    starts, lead = _segments(c)
    seg_start = starts[lead]
    first, kind = tv.numbered(c.buf, seg_start, np.append(seg_start[1:], len(c.buf)))
    bounds, ends = np.append(lead, len(starts)), np.append(starts, len(c.buf))
    data, edge = c.buf.tobytes(), ends.tolist()
    words = [[data[edge[k] : edge[k + 1]] for k in range(i, j)] for i, j in zip(bounds[first].tolist(), bounds[first + 1].tolist(), strict=True)]
    x = Aligned(c.buf, ends[bounds[first]], ends[bounds[first + 1]], words, vocab, model)
    doc_from = np.searchsorted(seg_start, c.offs)
    doc = np.repeat(np.arange(c.n), np.diff(doc_from))
    failed = np.zeros(c.n, bool)
    failed[doc[x.bad[kind]]] = True
    empty = failed | (np.diff(c.offs) == 0)
    sums = np.array([np.bincount(doc, row[kind], c.n) for row in x.sums]).astype(np.int64)
    sums[:, empty] = 0
    said = [None if skip else hashlib.sha256(b"".join(x.said[kind[i:j]])[:-1]).hexdigest() for i, j, skip in zip(doc_from[:-1].tolist(), doc_from[1:].tolist(), empty.tolist(), strict=True)]
    # pairs: distinct segments of each document, then their pairs
    whole = ~empty[doc]
    one, often = np.unique(doc[whole] * max(1, x.count) + kind[whole], return_counts=True)
    owner, seg = one // max(1, x.count), one % max(1, x.count)
    n = np.diff(x.cuts)[seg]
    at = np.repeat(x.cuts[seg] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    codes, local = np.unique(x.codes[at], return_inverse=True)
    width = max(1, len(codes))
    key, place = np.unique(np.repeat(owner, n) * width + local, return_inverse=True)
    times = np.bincount(place, x.times[at] * np.repeat(often, n), len(key)).astype(np.int64)
    cuts = np.searchsorted(key, np.arange(c.n + 1) * width).tolist()
    packed = [_packed(key[i:j] % width, times[i:j]) for i, j in itertools.pairwise(cuts)]
    return sums, ["" if s is None else s for s in said], packed, _packed(codes, np.bincount(key % width, minlength=len(codes)))


def _align(vocab_path: str, model_path: str):
    def run(batches):
        from pyspark import TaskContext

        vocab, model, part = vocabulary(vocab_path), pieces(model_path), TaskContext.get().partitionId() << 32
        for batch in batches:
            for c in tv.chunks(batch.column(1), PART_BYTES):
                sums, said, packed, asked = _aligned_documents(_spaced(c), vocab, model)
                columns = [batch.column(0).slice(c.first, c.n), *map(pa.array, sums), pa.array(said, pa.string()), pa.array(packed, pa.binary()), pa.array(np.full(c.n, part)), pa.array([asked] + [None] * (c.n - 1), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "part", "asked"])
                part += 1

    return run


def _of_parts(batches):
    """Distinct pairs of each part and how many of its documents hold each."""
    for batch in batches:
        for part, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes, docs = _unpacked(data)
            for i in range(0, len(codes), 1 << 16):
                rows = codes[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part)), pa.array(rows), pa.array(docs[i : i + (1 << 16)])], names=["part", "code", "docs"])


def _counted(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    asked = documents.select("part", "asked").filter("asked IS NOT NULL").mapInArrow(_of_parts, "part long, code long, docs long")
    counts = asked.groupBy("code").agg(F.sum("docs").alias("n_docs"))
    # an id of A has at most as many partners as B has pieces
    best = F.col("n_docs") == F.max("n_docs").over(W.partitionBy(F.shiftright("code", B_BITS)))
    return asked, counts.withColumn("best", best)


def _aligned(docs: DataFrame, vocab: str, model: str, id_col: str, text_col: str) -> DataFrame:
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(base.mapInArrow(_align(vocab, model), f"id {base.schema['id'].dataType.simpleString()}, {DOCUMENT}"))


def pair_counts(docs: DataFrame, vocab: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b, n_docs, best: every pair of overlapping tokens, how many documents hold it, and whether no other partner of a is in more."""
    counts = _counted(_aligned(docs, vocab, model, id_col, text_col))[1]
    return counts.select(F.shiftright("code", B_BITS).alias("a"), F.col("code").bitwiseAND((1 << B_BITS) - 1).alias("b"), "n_docs", "best")


def _scored(documents: pa.Table, counts: pa.Table) -> pa.Table:
    # the answers are those of the part's distinct codes, so their order gives the documents' places
    order = np.argsort(counts.column("code").to_numpy())
    n, best = (counts.column(c).to_numpy()[order] for c in ("n_docs", "best"))
    n_best, count_sum = [], []
    for data in documents.column("pairs").to_pylist():
        at, times = _unpacked(data)
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int((times * n[at]).sum()))
    kept = documents.drop_columns(["pairs", "part", "asked"])
    return kept.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def align(docs: DataFrame, vocab: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``vocab`` is a byte-level BPE file of the tokenizers library (A), ``model`` a
    SentencePiece model (B); special tokens' strings are plain text.  n_links
    counts pairs of overlapping tokens, n_best those whose pair is in as many documents as any pair of
    the same A id, count_sum the documents of each link's pair.

    A null or empty text, or one that B doesn't give back byte by byte, has no
    tokens: zeros and an empty digest.  Repeated rows are documents of their own;
    ids may be of any type, null too; other columns are ignored; no rows in, no rows out.
    """
    documents = _aligned(docs, vocab, model, id_col, text_col)
    asked, counts = _counted(documents)
    answers = asked.select("part", "code").join(counts, "code")
    schema = f"id {documents.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = documents.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_scored, schema)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
