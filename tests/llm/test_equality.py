"""Words, lines and windows that differ but have equal length and letters: no operator may take one for the other."""

import hashlib
import struct

import numpy as np
import pyarrow as pa
import pytest

from aerotrace.llm import textvec as tv
from aerotrace.llm.bpe import encode
from aerotrace.llm.license_scan import Matcher
from aerotrace.llm.near_dedup import near_duplicates
from aerotrace.llm.packing import pack
from aerotrace.llm.quality_rules import quality_rules
from aerotrace.llm.substring_dedup import substring_dedup

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def pair(size: int) -> tuple[str, str]:
    """A Thue-Morse word of a and b, and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(size)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


SIZES = (1024, 2048, 4096)


def rows(make) -> list[tuple[int, str]]:
    return [(10 * n + i, make(x)) for n, size in enumerate(SIZES) for i, x in enumerate(pair(size))]


def test_span_hashes_differ():
    for size in (2, 8, 16, 32, 64, *SIZES):
        a, b = (np.frombuffer(x.encode(), np.uint8) for x in pair(size))
        buf, at = np.concatenate((a, b)), np.array([0, size])
        h = tv.span_hashes(buf, at, at + size)
        assert h[0] != h[1]
        assert tv.numbered(buf, at, at + size)[1].tolist() in ([0, 1], [1, 0])
        # as sequences of words, too
        wh = np.where(np.concatenate((a, b)) == 97, np.uint64(123), np.uint64(456))
        assert len({int(tv.window_hashes(x, size)[0]) for x in (wh[:size], wh[size:])}) == 2


def test_numbered_survives_colliding_hashes(monkeypatch):
    monkeypatch.setattr(tv, "span_hashes", lambda buf, starts, ends, seed=0: np.zeros(len(starts), np.uint64))
    buf = np.frombuffer(b"one two one twq" + b"x" * 100 + b"y" * 100 + b"x" * 100, np.uint8)
    starts, ends = np.array([0, 4, 8, 12, 15, 115, 215]), np.array([3, 7, 11, 15, 115, 215, 315])
    first, number = tv.numbered(buf, starts, ends)
    assert number.tolist() == [0, 1, 0, 2, 3, 4, 3]
    assert first.tolist() == [0, 1, 3, 4, 5]


def test_substring_dedup(spark):
    lead = " ".join(f"x{i}" for i in range(19))
    got = substring_dedup(spark.createDataFrame([(10 * n + i, f"{lead} {x}") for n, size in enumerate(SIZES) for i, x in enumerate(pair(size))], "doc_id long, text string")).collect()
    assert [r.n_removed for r in got] == [0] * 6


def test_quality_rules(spark):
    docs = spark.createDataFrame(rows(lambda x: "\n".join(pair(len(x)))), "doc_id long, text string")
    got = quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert {(r.n_words, r.n_dup_lines, r.n_repeat_words) for r in got} == {(2, 0, 0)}


def test_near_duplicates(spark):
    got = near_duplicates(spark.createDataFrame(rows(lambda x: f"{x} {x}"), "doc_id long, text string"), words=2).collect()
    assert all(r.kept and r.component_id == r.doc_id and r.n_shingles == 1 for r in got) and len(got) == 6


def test_encoding_and_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(str(path))
    library.no_truncation()
    library.no_padding()
    said = dict(rows(str))
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in said.items()}
    docs = spark.createDataFrame(list(said.items()), "doc_id long, text string").coalesce(1)
    digest = lambda ids: hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
    assert {r.doc_id: r.ids_sha256 for r in encode(docs, path).collect()} == {i: digest(x) for i, x in want.items()}
    got: dict[int, list[int]] = {}
    for r in pack(docs, path, with_ids=True).orderBy("doc_id", "start").collect():
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == {i: [*x, 0] for i, x in want.items()}


def test_words_of_licenses():
    a, b = pair(1024)
    found = Matcher({f"{a} {a}": "one"}, {}).chunk(tv.Chunk(*tv.flat(pa.array([f"{a} {a}", f"{b} {b}", f"{a} {b}"])), 0))
    assert [x[1] for x in found] == [1, 0, 0]
