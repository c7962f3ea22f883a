import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from aerotrace.llm import bpe
from aerotrace.llm import textvec as tv
from aerotrace.llm.packing import pack, plan, price
from aerotrace.llm.token_counts import at_limits, token_counts

from .cases import documents, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def truth():
    t = Tokenizer.from_file(PATH)
    return lambda xs: [e.ids for e in t.encode_batch([x or "" for x in xs], add_special_tokens=False)]


@pytest.mark.parametrize("fast", [False, True])
def test_ids_match_the_library_on_awkward_texts(truth, fast):
    rng = random.Random(5)
    alphabet = [*"abst'rlvmd  \n\t éÉ漢123٣½!?.,-_<>|", "<|endoftext|>", "'s", "'ll", "'re", " '", "\r\n", "😀", "\x85"]
    xs = ["", None, "it's  he'll 're", "x<|endoftext|>y", "y" * 3000, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000))]
    v, got = bpe.Vocabulary(PATH), []
    for c in tv.chunks(pa.array(xs, pa.string()), 4000):
        ids, at = bpe.chunk_ids(c, v, fast)
        got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
        assert bpe.decoded(ids, v).tobytes() == c.buf.tobytes()
    assert got == truth(xs)


def test_encode_and_decode(spark, truth):
    rows = texts()
    got = bpe.encode(documents(spark), PATH)
    assert {r.doc_id: r.ids for r in got.collect()} == dict(zip([i for i, _ in rows], truth([t for _, t in rows])))
    back = {r.doc_id: r.text for r in bpe.decode(got.select("doc_id", "ids"), PATH).collect()}
    assert back == {i: t or "" for i, t in rows}
    assert bpe.encode(documents(spark, []), PATH).collect() == []


def test_packing_places_every_id_once(spark, truth):
    rows = texts()
    ids = {i: x + [0] for (i, _), x in zip(rows, truth([t for _, t in rows]))}
    covered, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in pack(documents(spark), PATH, size=256, with_ids=True).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids == part and len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, x in ids.items():
        assert sum(n for _, n in covered[i]) == len(x) and [a for a, _ in sorted(covered[i])] == list(np.cumsum([0, *(n for _, n in sorted(covered[i]))])[:-1])
    for s in sequences.values():
        assert [a for a, _ in sorted(s)] == list(np.cumsum([0, *(n for _, n in sorted(s))])[:-1]) and sum(n for _, n in s) <= 256
    assert len(sequences) <= 1.03 * sum(map(len, ids.values())) / 256 + 2
    assert pack(documents(spark, []), PATH).collect() == []


def test_patterns_fit_and_meet_the_demand():
    rng = random.Random(2)
    histogram = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(40)}
    made = plan(histogram, 100)
    got = collections.Counter()
    for n, pattern in made:
        assert sum(x * k for x, k in pattern.items()) <= 100
        for x, k in pattern.items():
            got[x] += n * k
    assert got == histogram
    value, pattern = price(np.array([30, 50]), np.array([0.3, 0.6]), 100)
    assert value == pytest.approx(1.2) and pattern == {1: 2}


def test_token_counts_answer_every_limit(spark, truth):
    lengths = [len(x) for x in truth([t for _, t in texts()])]
    got = token_counts(documents(spark), PATH).collect()
    assert [r.n_tokens for r in sorted(got, key=lambda r: r.n_tokens)] == sorted(set(lengths))
    for r in got:
        n = r.n_tokens
        assert (r.n_docs, r.docs_at_least, r.docs_before) == (lengths.count(n), sum(x >= n for x in lengths), sum(x < n for x in lengths))
        assert (r.tokens_at_least, r.truncated_total, r.total_tokens) == (sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths), sum(lengths))
        assert r.quantile == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    assert token_counts(documents(spark, []), PATH).collect() == []


def test_limits_between_and_beyond_the_lengths(spark, truth):
    lengths = [len(x) for x in truth([t for _, t in texts()])]
    limits = [0, 1, *(x + 1 for x in sorted(set(lengths))), 1024, 2048, 4096, max(lengths) + 1000]
    got = {r.limit: r for r in at_limits(token_counts(documents(spark), PATH), limits).collect()}
    assert set(got) == set(limits)
    for n, r in got.items():
        assert (r.docs_at_least, r.docs_before, r.total_docs) == (sum(x >= n for x in lengths), sum(x < n for x in lengths), len(lengths))
        assert (r.tokens_at_least, r.truncated_total, r.total_tokens) == (sum(x for x in lengths if x >= n), sum(min(x, n) for x in lengths), sum(lengths))
    assert at_limits(token_counts(documents(spark, []), PATH), [5]).collect() == []
