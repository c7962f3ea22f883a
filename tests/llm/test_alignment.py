import collections
import hashlib
import random

import public_tokenizers as P
import pytest

from aerotrace.llm import token_alignment as ta

from .cases import documents, texts

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    """The tokens of both sides of a whole text, by the libraries: ids and byte ranges, or none where B loses bytes."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    shown = {c: i for i, c in enumerate(sorted(ByteLevel.alphabet(), key=lambda c: (ord(c) if ord(c) < 256 else 1000 + ord(c))))}
    plain = [b for b in range(256) if chr(b) in shown]
    other = [b for b in range(256) if chr(b) not in shown]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def tokens(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        ours = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in ids]
        theirs = [(i, bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        want = (" " + text).encode()
        return (ours, theirs) if b"".join(x for _, x in ours) == want == b"".join(x for _, x in theirs) else ([], [])

    return tokens


def ranges(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((at, at + len(x), i))
        at += len(x)
    return out


def brute(rows, both):
    links, groups, sizes = {}, {}, {}
    for key, text in rows:
        a, b = map(ranges, both(text))
        sizes[key] = len(a), len(b)
        links[key] = collections.Counter((x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1])
        ends = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups[key] = [(",".join(str(i) for s, e, i in a if lo <= s and e <= hi), ",".join(str(i) for s, e, i in b if lo <= s and e <= hi)) for lo, hi in zip([0, *ends], ends)]
    count = collections.Counter(p for x in links.values() for p in x)
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    said = lambda g: hashlib.sha256(";".join("|".join(x) for x in g).encode()).hexdigest() if g else ""
    return {k: (*sizes[k], len(groups[k]), sum(x.values()), sum(n for p, n in x.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in x.items()), said(groups[k])) for k, x in links.items()}, count, most


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def awkward():
    rng = random.Random(8)
    alphabet = [*"abst'rlvmd   \n\t éÉ漢123٣½!?.,-_<>|▁", "<|endoftext|>", "<s>", "<0x0A>", "'ll", "\r\n", "😀", "\x85", " ", "　", "\x00", "ﬁ", "the ", " of", "  \n  "]
    return ["", None, " ", "  ", "\n", "a ", " a", "  a  b ", "a\n b", "a\n  b", "x▁y", "▁", "<s> </s>", "x<|endoftext|>y", "é", "y" * 700, "é" * 300, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500))]


def test_alignment_matches_both_libraries(spark, both):
    rows = list(enumerate(awkward()))
    want, count, most = brute(rows, both)
    df = documents(spark, rows)
    got = ta.align(df, A, B).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.doc_id], rows[r.doc_id]
    pairs = ta.pair_counts(df, A, B).collect()
    assert {(r.a, r.b): (r.n_docs, r.best) for r in pairs} == {p: (n, n == most[p[0]]) for p, n in count.items()}


def test_alignment_over_parts_and_partitions(spark, both, monkeypatch):
    rows = [(i, t if t is None else t[:1500]) for i, t in texts()]
    want = brute(rows, both)[0]
    got = ta.align(documents(spark, rows).repartition(7), A, B).collect()
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in got} == want


def test_parts_of_a_few_bytes_give_the_same(spark):
    import pyarrow as pa

    from aerotrace.llm import textvec as tv
    from aerotrace.llm.bpe import vocabulary

    said, v, m = awkward(), vocabulary(A), ta.pieces(B)
    found = []
    for limit in (50, 1 << 22):
        rows = []
        for c in tv.chunks(pa.array(said, pa.string()), limit):
            sums, digests, _, _ = ta._aligned_documents(ta._spaced(c), v, m)
            rows += list(zip(*sums.tolist(), digests))
        found.append(rows)
    assert found[0] == found[1] and len(found[0]) == len(said)


def test_repeated_rows_other_ids_and_no_rows(spark, both):
    rows = [("x", "the cat"), ("x", "the cat"), (None, "the dog"), ("y", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 AS id", "'p' AS part", "0 AS code", "1 AS a")
    want = brute(list(enumerate(t for _, t in rows)), both)[0]
    got = ta.align(df, A, B).collect()
    assert sorted(map(repr, ((r.doc_id, *(r[c] for c in COLUMNS)) for r in got))) == sorted(repr((k, *want[i])) for i, (k, _) in enumerate(rows))
    assert ta.align(documents(spark, []), A, B).collect() == []
    assert ta.pair_counts(documents(spark, []), A, B).collect() == []


def test_query_is_the_operator(spark, tmp_path, both):
    from aerotrace.llm.queries import op13_token_alignment

    rows = [(i, t if t is None else t[:800]) for i, t in texts()]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows, both)[0]
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in op13_token_alignment(spark, str(tmp_path)).collect()} == want
