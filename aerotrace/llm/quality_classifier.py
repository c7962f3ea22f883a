"""A quality classifier learnt from trusted positives and unlabelled web text alone.

Texts become shares of pairs of neighbouring character classes and four
numbers about their words, one byte each, in one pass that is kept.  Labels give
positives; every other document is unlabelled, whatever its label says.  A first logistic
model tells positives from unlabelled text, and the class prior is the
least ratio of the unlabelled to the positive documents above any of its scores,
taken on a fold that it hasn't seen.  The classifier then minimises the
unbiased risk of positive-unlabelled learning,

    prior * E_p[l(z)] + max(0, E_u[l(-z)] - prior * E_p[l(-z)]) + ridge,

with logistic loss l by Newton steps; a step that would turn the second part,
the risk on negatives, below zero is halved until it doesn't, so the model cannot
gain by fitting single documents.

Every sum is over all documents, made in the tasks and united on the executors;
one matrix of the features comes to the driver at each step.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import shuffle_partitions, stored

#: Character classes: upper and lower case, digits, space, newline, beyond ASCII, then kinds of signs, then the rest.
SIGNS = (b".", b",", b"!?", b"'\"", b"#*$%&|<>", b"-_", b":;", b"()[]{}", b"/\\@=+~^`")
CLASSES = 16
#: Features: pairs of classes, then words equal to the one before, distinct words, word length, number of words, and a constant.
N = CLASSES * CLASSES + 4
#: Labelled ids that are trusted at most: those with the smallest hashes.
TRUSTED_IDS = 50_000
#: Weight of the squared coefficients; steps of a fit and halvings of a step at most; least change of a step; scores told apart for the prior.
RIDGE, STEPS, HALVINGS, LEAST, BINS = 0.01, 20, 6, 1e-3, 1000
#: Confidence of the prior's bounds.
DELTA = 0.1
#: Folds: crc32 of the id modulo 5; one is held out, one sets the prior.
FOLDS, HELD_OUT, PRIOR_FOLD = 5, 0, 4


def _classes() -> np.ndarray:
    table = np.full(256, CLASSES - 1, np.int64)
    table[ord("A") : ord("Z") + 1], table[ord("a") : ord("z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[32], table[10], table[128:] = 3, 4, 5
    for i, signs in enumerate(SIGNS):
        table[list(signs)] = 6 + i
    return table


_CLASS = _classes()


def features(c: tv.Chunk) -> np.ndarray:
    """A row of N bytes per document: roots of shares, so that rare pairs count too; zeros for an empty text."""
    kind, doc = _CLASS[c.buf], np.repeat(np.arange(c.n), np.diff(c.offs))
    same = doc[1:] == doc[:-1]
    pairs = np.bincount((doc[1:] * CLASSES**2 + kind[:-1] * CLASSES + kind[1:])[same], minlength=c.n * CLASSES**2).reshape(c.n, CLASSES**2)
    share = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    c.words()
    number = tv.numbered(c.buf, c.w_start, c.w_end)[1]
    again = np.zeros(len(number), bool)
    again[1:] = (number[1:] == number[:-1]) & (c.w_doc[1:] == c.w_doc[:-1])
    distinct = np.unique(c.w_doc * max(1, len(number)) + number) // max(1, len(number))
    words = np.maximum(c.w_count, 1)
    length = np.bincount(c.w_doc, c.w_end - c.w_start, c.n) / words
    more = np.column_stack((np.sqrt(np.bincount(c.w_doc[again], minlength=c.n) / words), np.bincount(distinct, minlength=c.n) / words, np.log1p(length) / 8, np.log1p(c.w_count) / 16))
    return np.round(255 * np.clip(np.column_stack((share, more)), 0, 1)).astype(np.uint8)


def _featured(batches):
    for batch in batches:
        for c in tv.chunks(batch.column(batch.schema.get_field_index("text"))):
            x = features(c)
            rest = [batch.column(batch.schema.get_field_index(n)).slice(c.first, c.n) for n in ("id", "fold", "trusted")]
            yield pa.RecordBatch.from_arrays([*rest, pa.FixedSizeBinaryArray.from_buffers(pa.binary(N), c.n, [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())], names=["id", "fold", "trusted", "x"])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """The features as numbers, with the constant."""
    data = b"".join(batch.column(batch.schema.get_field_index("x")).to_pylist())
    return np.column_stack((np.frombuffer(data, np.uint8).reshape(-1, N) / 255.0, np.ones(batch.num_rows)))


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _total(df: DataFrame, sums, size: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of a matrix that ``sums`` makes of a batch: by task, by row of the matrix, then here."""

    def made(batches):
        held = np.zeros(size)
        for batch in batches:
            held += sums(batch)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size[0])), pa.array([r.tobytes() for r in held], pa.binary())], names=["row", "sums"])

    def united(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, data in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                held[row] = held.get(row, 0) + np.frombuffer(data)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([r.tobytes() for r in held.values()], pa.binary())], names=["row", "sums"])

    schema = "row long, sums binary"
    got = df.mapInArrow(made, schema).repartition(min(size[0], shuffle_partitions(df.sparkSession)), "row").mapInArrow(united, schema).collect()
    out = np.zeros(size)
    for row, data in got:
        out[row] = np.frombuffer(data)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def loss(z: np.ndarray) -> np.ndarray:
    """The logistic loss of a margin."""
    return np.logaddexp(0, -z)


@dataclasses.dataclass
class Model:
    """z = weights * (features - mean) / deviation; prior is the estimated share of good documents, negative_risk that of the fit."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    prior: float = 0.5
    negative_risk: float = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -5, 5)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scaled(x) @ self.weights)


def _risks(df: DataFrame, model: Model, prior: float | None) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Of positives and negatives at the model's weights the risks, and the gradient and curvature of their sum.

    Without a prior the risks are of telling positives from unlabelled text, both halves alike.
    """

    def sums(batch):
        x, own = model.scaled(_rows(batch)), _flags(batch, "trusted")
        z = x @ model.weights
        p = sigmoid(z)
        bend = p * (1 - p)
        parts = [x.T * bend @ x, (x[own].T * bend[own]) @ x[own]]
        heads = [(p @ x), (p[own] @ x[own]), x[own].sum(axis=0)]
        tail = np.zeros(N + 1)
        tail[:5] = len(x), own.sum(), loss(-z).sum(), loss(-z[own]).sum(), loss(z[own]).sum()
        return np.vstack((*parts, *heads, tail))

    got = _total(df, sums, (2 * (N + 1) + 4, N + 1))
    all_bend, own_bend, (p_all, p_own, x_own, tail) = got[: N + 1], got[N + 1 : 2 * N + 2], got[2 * N + 2 :]
    n, k, said_all, said_own, lost_own = tail[:5]
    n, k = max(n, 1), max(k, 1)
    if prior is None:
        return lost_own / k / 2, said_all / n / 2, (p_own - x_own) / k / 2 + p_all / n / 2, own_bend / k / 2 + all_bend / n / 2
    # l(z) - l(-z) = -z: the positives' part of both risks together is linear
    return prior * lost_own / k, said_all / n - prior * said_own / k, p_all / n - prior * x_own / k, all_bend / n


def _fit(df: DataFrame, start: Model, prior: float | None) -> Model:
    """Newton steps from ``start``; with a prior none that makes the negatives' risk negative."""
    ridge = np.full(N + 1, RIDGE)
    ridge[-1] = 0
    whole = lambda w, risk: risk + (ridge * w * w).sum() / 2
    model = start
    own, rest, slope, bend = _risks(df, model, prior)
    for _ in range(STEPS):
        step = np.linalg.solve(bend + np.diag(ridge + 1e-9), slope + ridge * model.weights)
        if np.abs(step).max() < LEAST:
            break
        for _ in range(HALVINGS):
            tried = dataclasses.replace(model, weights=model.weights - step)
            got = _risks(df, tried, prior)
            if (prior is None or got[1] >= 0) and whole(tried.weights, got[0] + got[1]) <= whole(model.weights, own + rest):
                break
            step = step / 2
        else:
            break
        model, (own, rest, slope, bend) = tried, got
    return dataclasses.replace(model, negative_risk=rest)


def class_prior(df: DataFrame, model: Model) -> float:
    """The least share of positives that every score allows: of unlabelled documents at or above it to that of positives, with bounds for chance."""

    def sums(batch):
        own, at = _flags(batch, "trusted"), np.minimum((model.scores(_rows(batch)) * BINS).astype(int), BINS - 1)
        return np.vstack((np.bincount(at, minlength=BINS), np.bincount(at[own], minlength=BINS)))

    every, own = (np.cumsum(x[::-1])[::-1] for x in _total(df, sums, (2, BINS)))
    if not own[0]:
        return 0.5
    chance = lambda n: np.sqrt(np.log(4 / DELTA) / 2 / n)
    some = own > 0
    all_share, own_share = every[some] / every[0], own[some] / own[0]
    best = np.argmin((all_share + chance(every[0]) + chance(own[0])) / own_share)
    return float(np.clip((all_share / own_share)[best], 0.01, 0.99))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id", limit: int = TRUSTED_IDS) -> DataFrame:
    """At most ``limit`` ids outside the held-out fold that all their labels call good, by hash."""
    ids = labels.filter(F.col(id_col).isNotNull() & (fold_of(id_col) != HELD_OUT)).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("worst")).filter("worst = 1").select("id")
    return ids.orderBy(F.xxhash64("id"), "id").limit(limit)


def fold_of(id_col: str):
    """crc32 of the id as text modulo 5; 1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS, F.lit(1)).cast("int")


def learnt(rows: DataFrame) -> Model:
    """The classifier of rows: trusted, fold and features x."""
    seen = rows.filter(F.col("fold") != HELD_OUT)

    def moments(batch):
        x = _rows(batch)
        out = np.vstack((x.sum(axis=0), (x * x).sum(axis=0), np.zeros(N + 1)))
        out[2, :2] = len(x), _flags(batch, "trusted").sum()
        return out

    first, second, (n, own) = (lambda m: (m[0], m[1], m[2, :2]))(_total(seen, moments, (3, N + 1)))
    mean = first / max(n, 1)
    deviation = np.sqrt(np.maximum(second / max(n, 1) - mean**2, 0))
    live = deviation > 1e-6
    mean[-1], deviation[~live] = 0, 1e6  # a feature that never changes says nothing
    deviation[-1] = 1
    model = Model(mean, deviation, np.zeros(N + 1))
    if not own:
        return model
    apart = _fit(seen.filter(F.col("fold") != PRIOR_FOLD), model, None)
    prior = class_prior(seen.filter(F.col("fold") == PRIOR_FOLD), apart)
    return dataclasses.replace(_fit(seen, model, prior), prior=prior)


def featured(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fold, trusted and features x of every document, kept in the shared folder."""
    base = docs.select(F.col(id_col).alias("id"), fold_of(id_col).alias("fold"), F.col(text_col).cast("string").alias("text"))
    marked = base.join(F.broadcast(trusted_ids(labels, id_col).select("id", F.lit(True).alias("mark"))), "id", "left").select("id", "fold", F.coalesce("mark", F.lit(False)).alias("trusted"), "text")
    return stored(marked.mapInArrow(_featured, f"id {base.schema['id'].dataType.simpleString()}, fold int, trusted boolean, x binary"))


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1, higher for better texts), predicted (score >= threshold).

    labels: id and quality (1 good, 0 bad).  Documents whose id has a crc32
    divisible by 5 are held out: neither their labels nor their texts are learnt from.
    At most ``TRUSTED_IDS`` labelled ids are trusted; all other documents outside that
    fold are unlabelled text.  Only the text is a feature.

    A null or empty text has features of zero and is scored like any other; repeated rows are documents of their
    own; an id with labels of both kinds isn't trusted; without a trusted document all scores
    are 0.5; no rows in, no rows out.  Other columns are ignored.
    """
    rows = featured(docs, labels, id_col, text_col)
    model = learnt(rows)

    def scored(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(model.scores(_rows(batch)), 9))], names=["id", "fold", "score"])

    out = rows.select("id", "fold", "x").mapInArrow(scored, f"id {rows.schema['id'].dataType.simpleString()}, fold int, score double")
    return out.select(F.col("id").alias(id_col), (F.col("fold") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
