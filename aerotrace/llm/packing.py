"""Packing by cutting-stock column generation.

Each document's ids, closed by id 0, are cut into full pieces of one sequence
length, then a piece of a multiple of ``grid`` ids and a tail shorter than that.
So pieces have few distinct lengths, and only their histogram reaches the driver:
at most size / grid + grid numbers.  There a linear program over patterns (how
many pieces of each length share a sequence) is solved by column generation: a
knapsack by dynamic programming prices the next pattern until none saves
anything.  The solution is rounded down; what that leaves, at most a few pieces
per length, is packed by best fit.  Every pattern's places become ranges of
ranks per length, and each piece takes the place of its rank among the pieces of
its length.

Ranks are counted in two levels, inside blocks of documents by hash and over the
blocks' counts, so a length that a third of all documents share is no one task's
work.  The table of places has a row per pattern and length, a few thousand at
most, whatever the input, and is broadcast.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as tv
from .bpe import chunk_ids, vocabulary
from .common import id_of, key_of, saved, shuffle_partitions

CLOSE = 0
#: Pieces but full ones and tails are multiples of this.
GRID = 64


def solve_patterns(lengths: np.ndarray, demand: np.ndarray, size: int, gap: float = 1e-3, most: int = 4000) -> list[tuple[dict[int, int], float]]:
    """Patterns {length: pieces} with their amounts, from the linear program of the cutting-stock problem.

    Revised simplex with an explicit inverse; it stops when a pattern's value
    proves the bound within ``gap``, or after ``most`` patterns.
    """
    m = len(lengths)
    columns = [{i: int(size // lengths[i])} for i in range(m)]
    inverse = np.diag([1.0 / (size // x) for x in lengths])
    amount = inverse @ demand
    for _ in range(most):
        duals = inverse.sum(0)  # every pattern costs one sequence
        value, pattern = price(lengths, duals, size)
        if value <= 1 + gap:
            break
        entering = np.zeros(m)
        for i, n in pattern.items():
            entering[i] = n
        move = inverse @ entering
        usable = move > 1e-9
        ratio = np.where(usable, amount / np.where(usable, move, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        amount = amount - step * move
        amount[out] = step
        pivot = inverse[out] / move[out]
        inverse -= np.outer(move, pivot)
        inverse[out] = pivot
        columns[out] = pattern
    return [({int(lengths[i]): n for i, n in c.items()}, max(0.0, float(a))) for c, a in zip(columns, amount, strict=True)]


def price(lengths: np.ndarray, duals: np.ndarray, size: int) -> tuple[float, dict[int, int]]:
    """The most valuable pattern by knapsack dynamic programming over the used length."""
    worth = np.zeros(size + 1)
    which = np.full(size + 1, -1)
    use = duals > 1e-12
    ls, ds, index = lengths[use], duals[use], np.flatnonzero(use)
    order = np.argsort(ls)
    ls, ds, index = ls[order], ds[order], index[order]
    upto = np.searchsorted(ls, np.arange(size + 1), "right")
    for room in range(1, size + 1):
        k = upto[room]
        worth[room] = worth[room - 1]
        if k:
            got = worth[room - ls[:k]] + ds[:k]
            best = int(np.argmax(got))
            if got[best] > worth[room] + 1e-12:
                worth[room], which[room] = got[best], best
    pattern: dict[int, int] = {}
    room = size
    while room > 0:
        if which[room] < 0:
            room -= 1
        else:
            i = int(index[which[room]])
            pattern[i] = pattern.get(i, 0) + 1
            room -= int(lengths[i])
    return float(worth[size]), pattern


def plan(histogram: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """(sequences, {length: pieces in each}): places for all pieces of the histogram."""
    if not histogram:
        return []
    lengths = np.array(sorted(histogram), np.int64)
    left = dict(histogram)
    made: list[tuple[int, dict[int, int]]] = []
    for pattern, amount in solve_patterns(lengths, np.array([histogram[int(x)] for x in lengths], float), size):
        n = min([int(amount + 1e-6), *(left[x] // k for x, k in pattern.items())])
        if n > 0:
            made.append((n, pattern))
            for x, k in pattern.items():
                left[x] -= n * k
    # the rounding's remainder: best fit, longest first
    rooms: list[list] = []
    by_room: dict[int, list[int]] = {}
    for x in sorted(left, reverse=True):
        for _ in range(left[x]):
            fit = next((r for r in range(x, size + 1) if by_room.get(r)), None)
            if fit is None:
                rooms.append([size - x, {x: 1}])
                at = len(rooms) - 1
            else:
                at = by_room[fit].pop()
                rooms[at][0] -= x
                rooms[at][1][x] = rooms[at][1].get(x, 0) + 1
            by_room.setdefault(rooms[at][0], []).append(at)
    return made + [(1, pattern) for _, pattern in rooms]


def places(made: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, first sequence, sequences, pieces in each, offset) of each pattern and length."""
    ranks: dict[int, int] = {}
    out, sequence = [], 0
    for n, pattern in made:
        offset = 0
        for x in sorted(pattern, reverse=True):
            k = pattern[x]
            out.append((x, ranks.get(x, 0), sequence, n, k, offset))
            ranks[x] = ranks.get(x, 0) + n * k
            offset += k * x
        sequence += n
    return out


def _cuts(total: int, size: int, grid: int) -> list[int]:
    """The starts of a document's pieces, and its end."""
    full = total // size * size
    main = full + (total - full) // grid * grid
    return [*range(0, full, size), *([full] if main > full else []), *([main] if total > main else []), total]


def _pieces(path: str, size: int, grid: int, with_ids: bool):
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            ks = batch.column(batch.schema.get_field_index("k")).to_numpy()
            ties = batch.column(batch.schema.get_field_index("tie")).to_numpy()
            for c in tv.chunks(batch.column(batch.schema.get_field_index("text"))):
                ids, at = chunk_ids(c, v, fast=True)
                ids = np.insert(ids, at[1:], CLOSE).astype("<u4")
                at = at + np.arange(c.n + 1)
                starts, lengths, crcs, lists, doc = [], [], [], [], []
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    cuts = _cuts(b - a, size, grid)
                    for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                        doc.append(c.first + i)
                        starts.append(x)
                        lengths.append(y - x)
                        crcs.append(zlib.crc32(ids[a + x : a + y].tobytes()))
                        lists.append(ids[a + x : a + y].tolist() if with_ids else None)
                total = np.diff(at)[np.array(doc) - c.first]
                yield pa.RecordBatch.from_arrays([pa.array(ks[doc]), pa.array(ties[doc]), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array(total, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["k", "tie", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return run


def pack(docs: DataFrame, vocab: str, size: int = 1024, grid: int = GRID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    A null or empty text is the closing id alone, a piece of length 1.
    Rows that repeat an id are documents of their own; in what order they get
    their places is decided by a hash of the text, and rows alike in both may
    swap places.  Other columns are ignored; no rows in, no rows out.
    """
    spark = docs.sparkSession
    blocks = max(16, 4 * shuffle_partitions(spark))
    base = docs.select(key_of(id_col).alias("k"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    told = base.mapInArrow(_pieces(vocab, size, grid, with_ids), "k long, tie long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>")
    told = saved(told.withColumn("block", F.pmod(F.xxhash64("k", "tie"), F.lit(blocks)).cast("int")))

    counts = told.groupBy("block", "length").agg(F.count("*").alias("n"))
    every = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()
    made = plan({r["length"]: r["n"] for r in every}, size)
    before = W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("block", "length").orderBy("k", "tie", "start")
    ranked = told.withColumn("rank", F.row_number().over(inside) - 1).join(first, ["block", "length"]).withColumn("rank", F.col("rank") + F.col("before"))

    # a length's places lie in order of rank: the last that starts at or before the rank is a piece's own
    by_length: dict[int, list] = {}
    for row in places(made):
        by_length.setdefault(row[0], []).append(row[1:])
    rows = [(x, [r[0] for r in y], [(int(r[1]), int(r[3]), int(r[4])) for r in y]) for x, y in by_length.items()]
    own = spark.createDataFrame(rows or [(-1, [0], [(0, 1, 0)])], "length long, starts array<long>, slots array<struct<sequence:long, each:long, offset:long>>")
    placed = ranked.join(F.broadcast(own), "length").withColumn("at", F.size(F.filter("starts", lambda s: s <= F.col("rank"))))
    slot, nth = F.element_at("slots", F.col("at")), F.col("rank") - F.element_at("starts", F.col("at"))
    return placed.select(
        id_of("k").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        (slot["sequence"] + F.floor(nth / slot["each"])).cast("long").alias("sequence_id"),
        (slot["offset"] + (nth % slot["each"]) * F.col("length")).cast("long").alias("offset"),
        *["ids"] * with_ids,
    )
