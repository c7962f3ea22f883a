import collections
import hashlib
import math
import re

import pytest

from aerotrace.llm.exact_dedup import QuotientFilter, drop_copies, exact_dedup
from aerotrace.llm.near_dedup import BANDS, KEPT, ROWS, estimate, lowest_estimate, near_duplicates, registers
from aerotrace.llm.substring_dedup import COVER, PERIOD, substring_dedup

from .cases import documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def test_cover_moves_any_pair_of_residues_into_itself():
    for a in range(PERIOD):
        for b in range(PERIOD):
            assert any((a + s) % PERIOD in COVER and (b + s) % PERIOD in COVER for s in range(PERIOD))


def substring_truth(rows):
    seen, out = set(), {}
    for i, t in sorted((i, t or "") for i, t in rows):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), sha(kept), kept)
    return out


def test_substring_dedup(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring_dedup(documents(spark)).collect()}
    assert got == substring_truth(texts())


def test_substring_dedup_of_nothing_and_of_null_ids(spark):
    assert substring_dedup(documents(spark, [])).collect() == []
    long = " ".join(map(str, range(30)))
    got = sorted((r.doc_id is None, r.n_removed) for r in substring_dedup(documents(spark, [(None, long), (5, long), (5, long), (7, None)])).collect())
    assert got == [(False, 0), (False, 0), (False, 0), (True, 30)]


def test_exact_dedup(spark):
    rows = [*texts(), (146, "a b\r\nc"), (None, "one")]
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = collections.defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    want = collections.Counter((i, min(x for x in groups[t] if x is not None), len(groups[t]), sha(t)) for i, t in norm)
    got = exact_dedup(documents(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup(documents(spark, [])).collect() == []


def test_drop_copies_keeps_one_of_each_and_all_columns(spark):
    rows = [*texts(), (146, "a b\r\nc")]
    df = documents(spark, rows)
    out = drop_copies(df)
    assert out.columns == df.columns
    assert out.count() == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows})


def test_quotient_filters_merge_without_loss():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) for _ in range(2))
    both = np.concatenate((a, b, a[:50]))
    merged = QuotientFilter.build(a).merge(QuotientFilter.build(np.concatenate((b, a[:50]))))
    want = collections.Counter(both.tolist())
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist(), strict=True)) == want
    parts = [x for _, x in merged.ranges(7)]
    assert sum(len(x.remainders) for x in parts) == len(want)
    assert np.array_equal(np.concatenate([x.fingerprints() for x in parts]), merged.fingerprints())


def near_truth(rows, words, percent=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets[i] = frozenset(tuple(w[j : j + words]) for j in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    chain = [" ".join(f"c{i}" for i in range(a, a + 60)) for a in range(0, 40, 5)]
    rows = [*texts(), *((300 - i, t) for i, t in enumerate(chain))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(documents(spark, rows), words=words).collect()}
    assert got == near_truth(rows, words)


def test_near_duplicates_of_nothing_and_kept(spark):
    assert near_duplicates(documents(spark, [])).collect() == []
    got = sorted((r.doc_id, r.kept) for r in near_duplicates(documents(spark, [(2, "a b c d e f"), (1, "A b c d e f"), (3, None), (4, "")])).collect())
    assert got == [(1, True), (2, False), (3, True), (4, True)]


def test_near_duplicates_tell_rows_of_one_id_apart(spark):
    import corpus_pipeline

    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    rows = [(5, text("a")), (None, text("a") + " z"), (None, text("clean")), (7, text("b")), (7, text("b") + " z"), (7, text("c")), (None, text("d")), (None, text("d") + " z"), (None, text("d") + " z"), (None, ""), (8, text("e")), (8, text("e"))]
    docs = documents(spark, rows)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    a, z = 56, 57
    verdicts = collections.Counter({(5, a, 5, True): 1, (None, z, 5, False): 1, (None, a, None, True): 1, (7, a, 7, True): 1, (None, 0, None, True): 1, (8, a, 8, True): 1, (8, a, 8, False): 1})
    rest = got - verdicts
    # clean b or its copy, and c; one of the three of d
    assert not verdicts - got and sum(rest.values()) == 12 - sum(verdicts.values())
    assert sum(n for (i, *_, kept), n in got.items() if i == 7 and kept) == 2
    assert sum(n for (i, w, c, kept), n in got.items() if i is None and c is None and kept) == 3
    out = [(r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs.filter("doc_id IS NULL OR doc_id <> 8"), "").collect()]
    assert (None, text("clean")) in out and (7, text("c")) in out and (None, text("a") + " z") not in out
    assert sum(t.startswith("b0 ") for _, t in out) == 1 and len({t for _, t in out if t.startswith("d0 ")}) == 1


def test_register_estimate_is_near_the_similarity():
    import numpy as np

    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 63, 1200, dtype=np.uint64) * np.uint64(2)
    a, b = pool[:1000], pool[200:]
    r = registers(np.concatenate((a, b)), np.array([0, 1000]))
    assert abs(estimate(r[0], r[1], np.array(1000), np.array(1000)) - 800 / 1200) < 0.12


def test_estimate_loses_far_fewer_pairs_than_the_bands():
    for percent in (50, 80, 90):
        t, chance = percent / 100, 0.7213 * 2.0**-10 / 4
        agreeing = math.ceil((lowest_estimate(percent) * (1 - chance) + chance) * KEPT)
        lost = sum(math.comb(KEPT, x) * t**x * (1 - t) ** (KEPT - x) for x in range(agreeing))
        assert lost < 1e-6, percent
    assert (1 - 0.8**ROWS) ** BANDS < 6e-6
