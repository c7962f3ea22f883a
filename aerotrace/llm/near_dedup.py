"""Near-duplicate documents by HyperMinHash.

Every document's set of word shingles gives one minimum per bucket of hash
functions, and each minimum is compressed to a register: the count of its leading
zeros and the ten bits after them.  Bands of six registers are the keys under
which documents meet; forty bands miss a pair of similarity 0.8 with a
probability of about 5 in a million.  Registers of two sets can agree by chance;
the share of agreeing registers is corrected for that before it is taken as
an estimate of similarity.  Pairs whose estimate lies within six deviations of
the threshold or above it are verified on their full sets, from whole texts;
at similarity 0.8 a lower estimate has a probability of about 2e-08, so both
together miss such a pair with a probability of 5.3e-06 at most.

Work on groups is kept linear:
* documents with the same set form a class, which is the node of all links: its
  number has nothing to do with ids, so rows that share an id stay apart;
* the members of a band's key are linked to the first of them only (a star), by
  a range partitioning that cuts even a key of very many members, and of each
  document's stars the best estimate is verified first;
* then only keys whose members lie in different components are looked at again:
  there all pairs across components are estimated, members with such a pair bring
  their full sets, and these are compared until the components are united or
  no pair is left.  So no link is lost beyond these misses, and what is passed on are members and
  uniting links, never pairs; keys of very many members are compared by blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import keyfilter
from . import textvec as tv
from .common import id_of, key_of, saved, shuffle_partitions
from .components import compact, components

U = np.uint64
BANDS, ROWS = 40, 6
#: Registers kept for the estimate.
KEPT = 120
MANTISSA = 10
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(77)
FACTORS = _RNG.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2) + U(1)
SHIFTS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * U(2)


def shingle_sets(c: tv.Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct shingle, sorted by both."""
    buf = LOWER[c.buf]
    c.words(buf=buf)
    wh = c.word_hashes(buf)
    at, h = c.windows(wh, words)
    doc = c.w_doc[at]
    short = np.flatnonzero((c.w_count > 0) & (c.w_count < words))
    if len(short):
        whole = tv.mix(c.w_count[short].astype(U), 0xA0761D6478BD642F)
        for j in range(words - 1):
            more = np.flatnonzero(c.w_count[short] > j)
            whole[more] = tv.join(whole[more], wh[c.w_from[short[more]] + j])
        doc, h = np.concatenate((doc, short)), np.concatenate((h, whole))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def registers(h: np.ndarray, starts: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Registers of the sets that start at ``starts``, a row per set."""
    least = np.empty((len(FACTORS), len(starts)), U)
    ends = np.append(starts[1:], len(h))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        part, at = h[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
        for f in range(len(FACTORS)):
            least[f, i:j] = np.minimum.reduceat(part * FACTORS[f] + SHIFTS[f], at)
        i = j
    fraction, exponent = np.frexp(least.astype(np.float64))
    mantissa = np.minimum((fraction * 2 - 1) * (1 << MANTISSA), (1 << MANTISSA) - 1).astype(np.int64)
    return ((np.clip(64 - exponent, 0, 63) << MANTISSA) | np.maximum(mantissa, 0)).astype(np.uint16).T


def _signatures(words: int):
    def run(batches):
        for batch in batches:
            ks, fs = (batch.column(batch.schema.get_field_index(x)) for x in ("k", "f"))
            for c in tv.chunks(batch.column(batch.schema.get_field_index("text"))):
                doc, h = shingle_sets(c, words)
                n = np.bincount(doc, minlength=c.n)
                s1, s2 = np.zeros(c.n, U), np.zeros(c.n, U)
                regs = np.zeros((c.n, KEPT), np.uint16)
                keys = np.zeros((c.n, BANDS), U)
                if len(h):
                    starts = tv.group_starts(doc)
                    own = doc[starts]
                    s1[own], s2[own] = np.add.reduceat(tv.mix(h, 11), starts), np.add.reduceat(tv.mix(h, 13), starts)
                    r = registers(h, starts)
                    regs[own] = r[:, :KEPT]
                    wide = r.astype(U).reshape(len(own), BANDS, ROWS)
                    folded = np.zeros((len(own), BANDS), U)
                    for j in range(ROWS):
                        folded = (folded + wide[:, :, j] + U(1)) * U(0x9E3779B97F4A7C15)
                        folded ^= folded >> U(29)
                    keys[own] = tv.mix(folded + np.arange(BANDS, dtype=U) * U(0xC2B2AE3D27D4EB4F))
                cut = np.arange(c.n + 1)
                yield pa.RecordBatch.from_arrays(
                    [ks.slice(c.first, c.n), fs.slice(c.first, c.n), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), tv.binaries(regs.ravel(), cut * KEPT), pa.ListArray.from_arrays(pa.array((cut * BANDS).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))],
                    names=["k", "f", "n", "s1", "s2", "regs", "bands"],
                )

    return run


STAR = "bkey long, c long, n long, c0 long, edge boolean"


def _stars(batches):
    """Sorted rows of a range: the members of each key that has two or more, with the key's first member.

    The range may start and end inside a key: its first and its last key are
    given whatever their members, and once more as edges.
    """

    def rows(b, c, n, c0, edge):
        return pa.RecordBatch.from_arrays([*(pa.array(np.atleast_1d(x)) for x in (b, c, n, c0)), pa.array(np.full(np.size(b), edge))], names=["bkey", "c", "n", "c0", "edge"])

    lead = None  # the key at work: key, first member, its set's size
    given = True  # whether that member has its own row already
    for batch in batches:
        b, c, n = (batch.column(i).to_numpy() for i in range(3))
        if not len(b):
            continue
        if lead is None:
            lead = (b[0], c[0], n[0])
            yield rows(b[0], c[0], n[0], c[0], True)
            yield rows(b[0], c[0], n[0], c[0], False)
            given, b, c, n = True, b[1:], c[1:], n[1:]
            if not len(b):
                continue
        at = tv.group_starts(b)
        size = np.diff(np.append(at, len(b)))
        c0 = np.repeat(c[at], size)
        alone = np.repeat(size == 1, size)
        if b[0] == lead[0]:
            c0[: size[0]] = lead[1]
            alone[: size[0]] = False
            if not given:
                yield rows(lead[0], lead[1], lead[2], lead[1], False)
                given = True
        if len(at) > 1 or b[0] != lead[0]:
            lead, given = (b[-1], c[at[-1]], n[at[-1]]), size[-1] > 1
        yield rows(b[~alone], c[~alone], n[~alone], c0[~alone], False)
    if lead is not None:
        if not given:
            yield rows(lead[0], lead[1], lead[2], lead[1], False)
        yield rows(lead[0], lead[1], lead[2], lead[1], True)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity from registers: agreeing ones, less those expected to agree by chance.

    The minima of sets of n and m hashes are nearly exponential with these
    rates; a register's bin is about 0.72 of its value wide at one bit, so two
    unlike minima share it with probability 0.72 * 2**-bits * n * m / (n + m)**2.
    """
    agree = (a == b).mean(-1)
    chance = 0.7213 * 2.0**-MANTISSA * (n / (n + m)) * (m / (n + m))
    return (agree - chance) / (1 - chance)


def lowest_estimate(percent: int) -> float:
    """The threshold less six deviations of the estimate."""
    t = percent / 100
    return t - 6 * (t * (1 - t) / KEPT) ** 0.5


def _estimated(percent: int):
    def run(batches):
        low = lowest_estimate(percent)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            regs = [np.frombuffer(b"".join(x[r].to_pylist()), np.uint16).reshape(-1, KEPT) for r in ("r1", "r2")]
            est = estimate(*regs, *(x[r].to_numpy() for r in ("n1", "n2")))
            use = est >= low
            yield pa.RecordBatch.from_arrays([*(pa.array(x[r].to_numpy()[use]) for r in ("c", "c0")), pa.array(est[use])], names=["c", "c0", "est"])

    return run


#: Members of a key, and shingles in their sets, that stand on one side of a comparison in memory.
BLOCK_MEMBERS, BLOCK_SHINGLES = 4096, 1 << 20
#: Parts into which the members of a key are dealt where a key's own row must meet them.
SALTS = 16


def _groups(batches):
    """Runs of rows with equal (bkey, i, j): that key, then the run as a table."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(3)]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
        at = np.append(np.flatnonzero(new), batch.num_rows).tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            this = tuple(int(x[a]) for x in columns)
            if held and this != key:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = this
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _across(percent: int):
    """Members of a block with an estimated pair in another component: each right one is compared with all left ones."""

    def run(batches):
        low = lowest_estimate(percent)
        for key, x in _groups(batches):
            right, c, m, n = (x.column(name).to_numpy() for name in ("right", "c", "m", "n"))
            regs = np.frombuffer(b"".join(x.column("regs").to_pylist()), np.uint16).reshape(-1, KEPT)
            left = np.flatnonzero(~right)
            hit = np.zeros(len(c), bool)
            for r in np.flatnonzero(right):
                other = left[m[left] != m[r]]
                found = other[estimate(regs[r], regs[other], n[r], n[other]) >= low]
                hit[found] = True
                hit[r] |= len(found) > 0
            if hit.any():
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(int(hit.sum()), v)) for v in key), *(pa.array(v[hit]) for v in (right, c, m))], names=["bkey", "i", "j", "right", "c", "m"])

    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            cs = batch.column(batch.schema.get_field_index("c"))
            for c in tv.chunks(batch.column(batch.schema.get_field_index("text"))):
                doc, h = shingle_sets(c, words)
                yield pa.RecordBatch.from_arrays([cs.slice(c.first, c.n), tv.binaries(h, np.searchsorted(doc, np.arange(c.n + 1)))], names=["c", "h"])

    return run


def _joined(percent: int):
    """Links that unite components of a block, on full sets: a right one's intersections with all left ones at once."""

    def run(batches):
        for _, x in _groups(batches):
            right, m = x.column("right").to_numpy(), x.column("m").to_numpy()
            sets = [np.frombuffer(h, U) for h in x.column("h").to_pylist()]
            left = np.flatnonzero(~right)
            if not len(left) or len(left) == len(m):
                continue
            sizes = np.array([len(sets[i]) for i in left])
            starts = np.cumsum(sizes) - sizes
            known, codes = np.unique(np.concatenate([sets[i] for i in left]), return_inverse=True)
            flag = np.zeros(len(known), bool)
            roots, root = np.unique(m, return_inverse=True)
            links = []
            for r in np.flatnonzero(right):
                if (root[left] == root[r]).all():
                    continue
                at = np.minimum(np.searchsorted(known, sets[r]), len(known) - 1)
                own = at[known[at] == sets[r]]
                flag[own] = True
                both = np.add.reduceat(flag[codes], starts, dtype=np.int64)
                flag[own] = False
                for i in left[(100 * both >= percent * (sizes + len(sets[r]) - both)) & (root[left] != root[r])]:
                    if root[i] != root[r]:
                        links.append((roots[root[r]], roots[root[i]]))
                        root[root == root[i]] = root[r]
            yield pa.RecordBatch.from_arrays([pa.array([y[k] for y in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return run


def _verified(percent: int):
    """Pairs with both full sets: those that are similar enough."""

    def run(batches):
        for batch in batches:
            x = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            sets = [[np.frombuffer(h, U) for h in x[y].to_pylist()] for y in ("h1", "h2")]
            total, i, n = np.cumsum([0, *(len(a) + len(b) for a, b in zip(*sets, strict=True))]), 0, batch.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(total, total[i] + (tv.CHUNK_BYTES >> 3), "right")) - 1)
                d = np.concatenate([np.repeat(np.arange(j - i), [len(h) for h in y[i:j]]) for y in sets])
                h = np.concatenate([h for y in sets for h in y[i:j]])
                order = np.lexsort((h, d))
                d, h = d[order], h[order]
                both = np.bincount(d[1:][(d[1:] == d[:-1]) & (h[1:] == h[:-1])], minlength=j - i) if len(d) else np.zeros(j - i, np.int64)
                use = (both > 0) & (100 * both >= percent * (np.diff(total[i : j + 1]) - both))
                yield pa.RecordBatch.from_arrays([pa.array(x[y].to_numpy()[i:j][use]) for y in ("c", "c0")], names=["u", "v"])
                i = j

    return run


def asked_sets(texts: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """c and the full set h of the rows of texts (k, f, text) whose k, f stand in keys (c, k, f), computed once.

    A filter keeps nearly all other texts out of the exact join.  Rows that repeat
    id and text pass once per task.
    """
    n = keys.count()
    shared = keyfilter.build(compact(keys.select(F.xxhash64("k", "f").alias("h")), n), n)

    def run(batches):
        seen = set()
        for batch in batches:
            use = np.flatnonzero(keyfilter.passes(shared.value, batch.column(0).to_numpy()))
            rows = list(zip(*(batch.column(i).to_numpy()[use].tolist() for i in (1, 2)), strict=True))
            new = [i for i, row in zip(use.tolist(), rows, strict=True) if not (row in seen or seen.add(row))]
            yield pa.RecordBatch.from_arrays(batch.columns[1:], names=["k", "f", "text"]).take(pa.array(new, pa.int64()))

    kept = texts.select(F.xxhash64("k", "f").alias("h"), "k", "f", "text").mapInArrow(run, "k long, f long, text string")
    sets = saved(kept.join(keys, ["k", "f"]).select("c", "text").mapInArrow(_sets(words), "c long, h binary").dropDuplicates(["c"]))
    shared.destroy()
    return sets


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id, kept and, if asked for, text_hash (xxhash64, a null text as empty).

    Words are lower-cased (A-Z) and parted by white space; a set is the distinct
    shingles of ``words`` words, of a shorter text its whole word sequence.
    Documents are linked when 100 * intersection >= percent * union, judged on
    full sets; component_id is the smallest id reachable.  A text without words,
    or null, has an empty set and no links, and is kept.  Rows that share an id are
    judged by their own texts; a null id is larger than all others.  Of each
    component one row is kept: one with the smallest id, of several such rows
    the one whose text has the smallest hash.  Other columns are ignored; no
    rows in, no rows out.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    base = docs.select(key_of(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("f", F.xxhash64("text"))
    signed = saved(base.mapInArrow(_signatures(words), "k long, f long, n long, s1 long, s2 long, regs binary, bands array<long>"))
    full = signed.filter("n > 0")
    lead = F.min(F.struct("k", "f"))
    classes = full.groupBy("s1", "s2", "n").agg(lead.alias("lead"), F.first("regs").alias("regs"), F.first("bands").alias("bands"))
    # c numbers the classes, in no order; k and f are those of the class's first document
    classes = saved(classes.select(F.monotonically_increasing_id().alias("c"), "s1", "s2", "n", F.col("lead.k").alias("k"), F.col("lead.f").alias("f"), "regs", "bands"))
    leads = classes.select("c", "k", "f")

    met = saved(classes.select(F.explode("bands").alias("bkey"), "c", "n").repartitionByRange(parts, "bkey", "c").sortWithinPartitions("bkey", "c").mapInArrow(_stars, STAR))
    keys = met.filter("NOT edge").drop("edge")
    # a key that spans ranges has a first member in each, two rows of a range at most: the smallest of them links them
    least: dict[int, set[int]] = {}
    for key, c0 in met.filter("edge").select("bkey", "c0").collect():
        least.setdefault(key, set()).add(c0)
    bridged = spark.createDataFrame([(c, min(x)) for x in least.values() for c in x if c != min(x)], "c long, c0 long")

    tiny = classes.select("c", "n", "regs")
    one, two = (tiny.select(F.col("c").alias(c), F.col("n").alias(n), F.col("regs").alias(r)) for c, n, r in (("c", "n1", "r1"), ("c0", "n2", "r2")))
    pairs = keys.select("c", "c0").filter("c <> c0").union(bridged).distinct().join(one, "c").join(two, "c0")
    likely = pairs.mapInArrow(_estimated(percent), "c long, c0 long, est double")
    best = saved(likely.groupBy("c").agg(F.max_by("c0", F.struct("est", -F.col("c0"))).alias("c0")))
    needed = saved(leads.join(keys.select("c").distinct(), "c"))
    sets = asked_sets(base.select("k", "f", "text"), needed, words)
    verified = best.join(sets.withColumnRenamed("h", "h1"), "c").join(sets.select(F.col("c").alias("c0"), F.col("h").alias("h2")), "c0")
    found = components(saved(verified.mapInArrow(_verified(percent), "u long, v long")))

    grouped = lambda x: x.repartition(parts, "bkey", "i", "j").sortWithinPartitions("bkey", "i", "j")

    def across(some: DataFrame, found: DataFrame) -> DataFrame:
        """Links between components that share a key; members outside a key's largest component are compared with all its members."""
        x = some.join(found.select(F.col("node").alias("c"), F.col("component").alias("m")), "c", "left").select("bkey", "c", "n", F.coalesce("m", "c").alias("m"))
        counts = x.groupBy("bkey", "m").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
        per = counts.groupBy("bkey").agg(F.max_by(F.struct("m", "members", "weight"), F.struct("members", "m")).alias("main"), F.count("*").alias("of"), F.sum("members").alias("members"), F.sum("weight").alias("weight")).filter("of > 1")
        sides = lambda members, weight: F.greatest(F.ceil(members / BLOCK_MEMBERS), F.ceil(weight / BLOCK_SHINGLES))
        per = per.select("bkey", F.col("main.m").alias("main"), sides(F.col("members"), F.col("weight")).alias("lefts"), sides(F.col("members") - F.col("main.members"), F.col("weight") - F.col("main.weight")).alias("rights"))
        salted = per.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        x = x.withColumn("salt", F.pmod(F.hash("c"), F.lit(SALTS)).cast("int")).join(salted, ["bkey", "salt"])
        places = F.expr("""concat(
            transform(sequence(0L, rights - 1), j -> struct(pmod(xxhash64(c, 1), lefts) AS i, j AS j, false AS right)),
            IF(m = main, cast(array() AS array<struct<i: bigint, j: bigint, right: boolean>>), transform(sequence(0L, lefts - 1), i -> struct(i AS i, pmod(xxhash64(c, 2), rights) AS j, true AS right))))""")
        x = x.join(tiny.select("c", "regs"), "c").select("bkey", F.explode(places).alias("at"), "c", "m", "n", "regs").select("bkey", "at.i", "at.j", "at.right", "c", "m", "n", "regs")
        near = saved(grouped(x).mapInArrow(_across(percent), "bkey long, i long, j long, right boolean, c long, m long"))
        return saved(grouped(near.join(sets, "c").select("bkey", "i", "j", "right", "c", "m", "h")).mapInArrow(_joined(percent), "u long, v long"))

    # a tenth of the keys first: it unites most of a large group, whose members then needn't bring their sets to all their keys
    for some in (keys.filter("pmod(bkey, 10) = 0"), keys):
        more = components(across(some, found))
        # links join components: their nodes are components so far
        nodes = found.union(more.select("node", F.col("node").alias("component"))).distinct()
        found = saved(nodes.join(more.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component")))

    first = found.join(leads.withColumnRenamed("c", "node"), "node").groupBy("component").agg(lead.alias("first"))
    placed = found.join(first, "component").select(F.col("node").alias("c"), "first")
    told = classes.select("c", "s1", "s2", "n", F.struct("k", "f").alias("lead")).join(placed, "c", "left").select("s1", "s2", "n", F.coalesce("first", "lead").alias("first"))
    # rows that repeat both id and text are interchangeable: one of them is kept
    rows = signed.groupBy("k", "f", "n", "s1", "s2").agg(F.count("*").alias("rows")).join(told, ["s1", "s2", "n"], "left")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    kept = (F.col("n") == 0) | ((F.col("k") == F.col("first.k")) & (F.col("f") == F.col("first.f")) & (F.col("copy") == 1))
    columns = [F.col("n").alias("n_shingles"), id_of("component").alias("component_id"), kept.alias("kept"), *[F.col("f").alias("text_hash")] * with_hash]
    return rows.withColumn("component", F.coalesce("first.k", "k")).select(id_of("k").alias(id_col), *columns)
