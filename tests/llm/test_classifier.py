import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from aerotrace.llm import quality_classifier as qc
from aerotrace.llm import textvec as tv
from aerotrace.llm.queries import op12_quality_classifier

from .cases import documents, texts

SF = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy_on_whole_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = op12_quality_classifier(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() == len({r.doc_id for r in got})
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    told = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert len(told) > 500
    good, bad = [p for y, p in told if y == 1], [p for y, p in told if y == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05


def made(rng, n, junk):
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 9)))
    return " ".join(word().upper() + "!!" if junk else word() for _ in range(n))


def test_labels_of_the_held_out_fold_change_nothing(spark):
    rng = random.Random(6)
    rows = [(i, made(rng, rng.randint(5, 60), i % 4 == 0)) for i in range(400)] + [(401, None), (402, ""), (403, " \n"), (404, "word " * 20_000), (405, "word"), (405, "word"), (None, "no id")]
    df = documents(spark, rows)
    labels = [(i, int(i % 4 != 0)) for i in range(300)]
    frame = lambda x: spark.createDataFrame(x, "doc_id long, quality int")
    one = qc.quality_classifier(df, frame(labels + [(None, 1), (9999, 1), (404, 0), (404, 1)])).collect()
    two = qc.quality_classifier(df, frame([(i, 1 - y if held(i) else y) for i, y in labels])).collect()
    key = lambda x: sorted((repr(r.doc_id), r.score, r.predicted, r.held_out) for r in x)
    assert len(one) == len(rows) and key(one) == key(two)
    score = {r.doc_id: r.score for r in one}
    judged = [(i % 4 != 0, score[i]) for i in range(400) if held(i)]
    assert np.mean([(s >= 0.3) == y for y, s in judged]) > 0.97
    assert all(0 <= r.score <= 1 for r in one)


def test_without_trusted_documents_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in qc.quality_classifier(documents(spark), labels).collect()} == {0.5}
    assert qc.quality_classifier(documents(spark, []), labels).collect() == []
    named = spark.createDataFrame([("a1", "some text"), ("a2", "OTHER!!")], "doc_id string, text string")
    told = spark.createDataFrame([("a1", 1), ("a2", 0)], "doc_id string, quality int")
    assert {r.doc_id for r in qc.quality_classifier(named, told).collect()} == {"a1", "a2"}


def test_features_by_hand():
    said = ["", None, "ab ab ab\nCD", "#é", *(t for _, t in texts())]
    got = np.concatenate([qc.features(c) for c in tv.chunks(pa.array(said, pa.string()), 500)])
    for text, row in zip(said, got):
        data = (text or "").encode()
        want = np.zeros(qc.N)
        for a, b in zip(data[:-1], data[1:]):
            want[qc._CLASS[a] * qc.CLASSES + qc._CLASS[b]] += 1
        want[:-4] = np.sqrt(want[:-4] / max(1, len(data) - 1))
        words = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", data)]
        n = max(1, len(words))
        want[-4:] = np.sqrt(sum(a == b for a, b in zip(words[:-1], words[1:])) / n), len(set(words)) / n, np.log1p(sum(map(len, words)) / n) / 8, np.log1p(len(words)) / 16
        assert (row == np.round(255 * np.clip(want, 0, 1))).all(), text


def test_risk_is_that_of_the_formula_and_stays_non_negative(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (300, qc.N), np.uint8)
    own = rng.random(300) < 0.3
    df = spark.createDataFrame([(bytearray(r.tobytes()), bool(o), 1) for r, o in zip(x, own)], "x binary, trusted boolean, fold int")
    model = qc.Model(np.append(np.full(qc.N, 0.5), 0), np.append(np.full(qc.N, 0.3), 1), rng.normal(0, 0.1, qc.N + 1))
    z = model.scaled(np.column_stack((x / 255.0, np.ones(300)))) @ model.weights
    up, down = np.log1p(np.exp(-z)), np.log1p(np.exp(z))
    good, bad, slope, bend = qc._risks(df, model, 0.4)
    assert good == pytest.approx(0.4 * up[own].mean()) and bad == pytest.approx(down.mean() - 0.4 * down[own].mean())
    for i in (0, 17, qc.N):
        moved = [qc._risks(df, qc.dataclasses.replace(model, weights=model.weights + d * np.eye(qc.N + 1)[i]), 0.4) for d in (1e-4, -1e-4)]
        assert slope[i] == pytest.approx((sum(moved[0][:2]) - sum(moved[1][:2])) / 2e-4, abs=1e-6)
        assert bend[i] == pytest.approx((moved[0][2] - moved[1][2]) / 2e-4, abs=1e-6)
    assert qc._fit(df, qc.dataclasses.replace(model, weights=np.zeros(qc.N + 1)), 0.9).negative_risk >= 0
