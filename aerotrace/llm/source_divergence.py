"""How far the sources of a language differ in their words: term-block dense matrices.

Every language keeps the terms that enough of its documents hold.  A group is a
language and a source; its share p of a term, smoothed by two, is an integer of
billionths.  Two groups differ by the sum of floor((p - q)^2 / (p + q)) over
all kept terms, those that neither holds included, so the counts of a block of
terms are worked on as one dense int64 tile of groups by terms: all pairs of
its groups by broadcasting, and beside it each group's terms of the greatest
excess over the whole language as a heap.  Partial pair matrices are summed and
heaps merged in Spark.

Terms are counted in Arrow batches per language and source before any shuffle.
Blocks hold about ``BLOCK_TERMS`` terms whatever the corpus; where there are
more than ``TILE_GROUPS`` groups, they are dealt to chunks and a tile is a pair
of chunks, so memory is bounded for any number of groups.  What a tile must know of its
groups, their totals, comes to it as rows of the shuffle; nothing is broadcast.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as tv
from .common import shuffle_partitions, stored

#: Parts per whole of a share.
SCALE_STEPS, SCALE_STEP = 3, 1000
#: Bytes of text counted at once; terms per block; groups per chunk; cells of a broadcast.
COUNT_BYTES, BLOCK_TERMS, TILE_GROUPS, CELLS = 1 << 23, 1024, 1024, 1 << 20

_APART = np.ones(256, bool)
_APART[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The spans of a byte array as strings."""
    size = ends - starts
    before = np.cumsum(size) - size
    data = buf[np.repeat(starts - before, size) + np.arange(int(size.sum()))]
    offsets = np.append(before, len(data)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def _counted(batches):
    for batch in batches:
        langs, sources = (batch.column(i).fill_null("").dictionary_encode() for i in (1, 2))
        lang_of, source_of = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources))
        for c in tv.chunks(batch.column(0), COUNT_BYTES):
            low = _LOWER[c.buf]
            c.words(_APART, low)
            if not len(c.w_start):
                continue
            first, term = tv.numbered(low, c.w_start, c.w_end)
            n_terms, rows = len(first), slice(c.first, c.first + c.n)
            groups, group = np.unique(lang_of[rows] * len(sources.dictionary) + source_of[rows], return_inverse=True)
            in_doc, times = np.unique(c.w_doc * n_terms + term, return_counts=True)
            key, at = np.unique(group[in_doc // n_terms] * n_terms + in_doc % n_terms, return_inverse=True)
            own = groups[key // n_terms]
            columns = [
                langs.dictionary.take(pa.array(own // len(sources.dictionary))), sources.dictionary.take(pa.array(own % len(sources.dictionary))),
                _spans(low, c.w_start[first], c.w_end[first]).take(pa.array(key % n_terms)), pa.array(np.bincount(at, times, len(key)).astype(np.int64)), pa.array(np.bincount(at, minlength=len(key)).astype(np.int64)),
            ]
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([x.slice(i, 1 << 16) for x in columns], names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents): a row per term of a group; null texts, langs and sources are empty strings."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    pairs = named.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return pairs.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int = 10) -> DataFrame:
    """lang, source, term, n of the terms that at least ``min_docs`` documents of the language hold, with lang_n, n over the language, and first, true once for each term of a language."""
    term = W.partitionBy("lang", "term")
    x = counts.withColumns({"lang_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "first": F.row_number().over(term.orderBy("source")) == 1})
    return x.filter(F.col("lang_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / total) for 0 <= count <= total < 2**53, by long division, so that no product overflows."""
    whole, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        whole = whole * SCALE_STEP + rest // total
        rest = rest % total
    return whole + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def pair_matrix(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sums over terms of the differences of every row of p with every row of q."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, CELLS // max(1, q.size))
    for i in range(0, len(p), step):
        out[i : i + step] = difference(p[i : i + step, None, :], q[None, :, :]).sum(axis=2)
    return out


class _Tile:
    """What one language has in one pair of chunks: group totals, the sum of its blocks' pair matrices, and heaps."""

    def __init__(self, rows: dict[str, list], top: int, one: int, two: int):
        self.top, self.heaps, self.alone = top, {}, one == two
        by_chunk = {one: [], two: []}
        for name, chunk, n, v, lang_total in zip(*(rows[c] for c in ("source", "chunk", "n", "v", "lang_total")), strict=True):
            by_chunk[chunk].append((name, n))
            self.v, self.lang_total = v, lang_total
        self.sides = [sorted(by_chunk[c]) for c in sorted(by_chunk)]
        self.at = {name: (k, i) for k, side in enumerate(self.sides) for i, (name, _) in enumerate(side)}
        self.sum = np.zeros((len(self.sides[0]), len(self.sides[-1])), np.int64)

    def add(self, rows: dict[str, list], heaps: bool) -> None:
        terms = {t: j for j, t in enumerate(dict.fromkeys(rows["term"]))}
        lang_n = np.zeros(len(terms), np.int64)
        counts = [np.zeros((len(side), len(terms)), np.int64) for side in self.sides]
        for name, term, n, whole in zip(*(rows[c] for c in ("source", "term", "n", "lang_n")), strict=True):
            lang_n[terms[term]] = whole
            if name in self.at:  # else the row only says that the term is kept
                k, i = self.at[name]
                counts[k][i, terms[term]] = n
        totals = [np.array([n for _, n in side], np.int64)[:, None] + 2 * self.v for side in self.sides]
        p = [shares(c + 2, n) for c, n in zip(counts, totals, strict=True)]
        self.sum += pair_matrix(p[0], p[-1])
        if heaps:
            q, names = shares(lang_n + 2, np.int64(self.lang_total + 2 * self.v))[None, :], list(terms)
            value = np.where((counts[0] > 0) & (p[0] > q), difference(p[0], q), -1)
            for (name, _), row in zip(self.sides[0], value, strict=True):
                at = np.flatnonzero(row >= 0)
                if len(at) > self.top:
                    at = at[row[at] >= np.partition(row[at], -self.top)[-self.top]]
                found = [(-int(row[j]), names[j].encode()) for j in at.tolist()]
                self.heaps[name] = heapq.nsmallest(self.top, self.heaps.get(name, []) + found)

    def rows(self, lang: str):
        one, two = self.sides[0], self.sides[-1]
        for i, (a, _) in enumerate(one):
            for j, (b, _) in enumerate(two):
                if not self.alone or i < j:
                    yield lang, a, "pair", b, int(self.sum[i, j])
        for name, heap in self.heaps.items():
            for value, term in heap:
                yield lang, name, "term", term.decode(), -value


TILED = "lang string, source string, part string, item string, value long"


def _blocks(batches):
    """The rows of each tile, language and block: they come sorted, a block's totals before its terms."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("tile", "lang", "block")), strict=True))
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for a, b in itertools.pairwise(cuts):
            if keys[a] != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


def _tiles(top: int, chunks: int):
    def run(batches):
        tile, now = None, None

        def done():
            rows = [] if tile is None else list(tile.rows(now[1]))
            for i in range(0, len(rows), 1 << 15):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + (1 << 15)], strict=True)], names=["lang", "source", "part", "item", "value"])

        for (number, lang, _), table in _blocks(batches):
            known = table.column("term").is_null().to_numpy()
            if (number, lang) != now:
                yield from done()
                tile, now = _Tile(table.filter(pa.array(known)).to_pydict(), top, *divmod(number, chunks)), (number, lang)
            if tile.at and not known.all():  # else none of its groups speaks the language
                tile.add(table.filter(pa.array(~known)).to_pydict(), number // chunks == number % chunks)
        yield from done()

    return run


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank for every language and source that occurs.

    part ``pair``: item is another source of the language, value how far the two
    differ over all kept terms (0 without any).  part ``term``: item is a term of
    the group with a share above the language's, value by how much; ``top`` of
    each group.  rank is from 1 per group and part, value descending, item ascending in UTF-8.

    A null text, language or source is the empty string; every row is a document, repeated ones too;
    a group without terms has shares of nothing but smoothing; a source alone in its
    language has no pairs; an empty table gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    kept = stored(kept_terms(term_counts(docs, text_col, lang_col, source_col), min_docs))
    names = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("first").cast("long")).alias("v"))
    langs = totals.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("n").alias("lang_total"))
    groups = stored(names.join(totals.select("lang", "source", "n"), ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "v", "lang_total"))))
    blocks = max(1, -(-kept.filter("first").count() // BLOCK_TERMS))
    chunks = max(1, -(-groups.count() // TILE_GROUPS))

    chunk = F.pmod(F.xxhash64("source"), F.lit(chunks)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    own = groups.select("lang", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), chunk.alias("chunk"), "source", none("string").alias("term"), "n", F.lit(False).alias("first"), none("long").alias("lang_n"), "v", "lang_total")
    terms = kept.select("lang", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)).cast("int").alias("block"), chunk.alias("chunk"), "source", "term", "n", "first", "lang_n", none("long").alias("v"), none("long").alias("lang_total"))
    # a row goes to the tiles of its chunk, and one row of each term to all, for groups that lack the term
    every = F.sequence(F.lit(0), F.lit(chunks - 1))
    all_tiles = F.flatten(F.transform(every, lambda i: F.transform(F.sequence(i, F.lit(chunks - 1)), lambda j: i * chunks + j)))
    own_tiles = F.transform(every, lambda o: F.least("chunk", o) * chunks + F.greatest("chunk", o))
    x = own.unionByName(terms).withColumn("tile", F.explode(F.when(F.col("first"), all_tiles).otherwise(own_tiles)))
    x = x.repartition(max(1, min(blocks * chunks * chunks, shuffle_partitions(spark))), "block", "tile").sortWithinPartitions("tile", "lang", "block", F.col("term").asc_nulls_first())
    found = x.select("tile", "lang", "block", "chunk", "source", "term", "n", "lang_n", "v", "lang_total").mapInArrow(_tiles(top, chunks), TILED)

    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ways = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).otherwise(F.array(F.struct("source", "item")))
    both = summed.select("lang", "part", "value", F.explode(ways).alias("w")).select("lang", "w.source", "part", "w.item", "value")
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
