import collections
import random
import re

import numpy as np
import pytest

from aerotrace.llm import source_divergence as sd

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, min_docs, top):
    """Rows of (text, lang, source) by plain integers."""
    counts, docs, groups = collections.Counter(), collections.Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [x.translate(LOWER) for x in TERM.findall(text or "")]
        for t in found:
            counts[lang, source, t] += 1
        for t in set(found):
            docs[lang, t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (l, t), n in docs.items() if l == lang and n >= min_docs)
        own = sorted(s for l, s in groups if l == lang)
        share = lambda c: [1 + 10**9 * (x + 2) // (sum(c) + 2 * len(kept)) for x in c]
        table = {s: [counts[lang, s, t] for t in kept] for s in own}
        p = {s: share(c) for s, c in table.items()}
        q = share([sum(c[i] for c in table.values()) for i in range(len(kept))])
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted((-sum(map(f, p[s], p[o])), o.encode()) for o in own if o != s)
            terms = sorted((-f(p[s][i], q[i]), t.encode()) for i, t in enumerate(kept) if table[s][i] > 0 and p[s][i] > q[i])[:top]
            out |= {(lang, s, part, item.decode(), -v, r) for part, x in (("pair", pairs), ("term", terms)) for r, (v, item) in enumerate(x, 1)}
    return out


def corpus():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdeéß漢" for b in ["", "x", "yé", "Zz", "ñ"]]
    rows = []
    for _ in range(160):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "s2", None, "", "é"])
        rows.append((rng.choice([None, "", "1 2 _", *[" ".join(rng.choices(words, [i + 1 + 5 * (source == "s1") * (i % 3) for i in range(len(words))], k=rng.randint(1, 30))).replace(" ", rng.choice([" ", "1", "\n", "_É"]))] * 9]), lang, source))
    return rows + [("alone one", "xx", "only"), (None, "yy", "a"), ("few", "yy", "b"), ("a" * 5000 + " A", "en", "s0")]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    return df.selectExpr("*", "1 AS n", "'t' AS term", "2 AS value", "3 AS rank", "4 AS docs", "'i' AS item")


@pytest.mark.parametrize("groups,terms", [(1024, 1024), (2, 3)])
def test_divergence_against_plain_integers(spark, monkeypatch, groups, terms):
    """The second case has chunks of two groups and blocks of three terms."""
    monkeypatch.setattr(sd, "TILE_GROUPS", groups)
    monkeypatch.setattr(sd, "BLOCK_TERMS", terms)
    rows = corpus()
    got = sd.divergence(frame(spark, rows), min_docs=10, top=4).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, 10, 4)


def test_no_kept_terms_and_no_rows(spark):
    rows = [("a b", "en", "x"), ("c", "en", "y"), (None, None, None)]
    assert {tuple(r) for r in sd.divergence(frame(spark, rows)).collect()} == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    assert sd.divergence(frame(spark, [])).collect() == []


def test_shares_of_counts_beyond_64_bit_products():
    rng = random.Random(1)
    totals = [rng.randint(1, 1 << 52) for _ in range(300)] + [1, 7, (1 << 52) - 1]
    counts = [rng.choice([0, t, rng.randint(0, t)]) for t in totals]
    assert sd.shares(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals)]
