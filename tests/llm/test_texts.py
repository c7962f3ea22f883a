import collections
import hashlib
import random
import re

import pytest

from aerotrace.llm.chat_format import chat_windows, digests, read_back
from aerotrace.llm.exact_dedup import drop_copies
from aerotrace.llm.license_scan import TEMPLATES, Automaton, license_scan
from aerotrace.llm.quality_rules import keep_good, quality_rules
from aerotrace.llm.secret_scan import redact, secret_scan

from .cases import documents, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(t):
    w = WORD.findall(t)
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    cover = [False] * len(w)
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            cover[i : i + 3] = [True] * 3
    lines, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(cover), len(w) < 50 or 100 * sum(cover) > 50 * len(w)


def test_quality_counts_and_verdicts(spark):
    junk = " ".join(f"#$%{i}&*" for i in range(80))
    rows = [*texts(), (200, junk), (201, "a\na\n\na \nb\nb\n"), (202, "|<>#"), (203, "a b c " * 40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(None, 1, 0), (999, 1, 0), (200, 0, 0)], "doc_id long, quality int, toxic int")
    df = documents(spark, rows)
    got = {r.doc_id: r for r in quality_rules(df, labels).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(t or ""), i
    assert not got[200].kept and not got[200].base_failed
    assert all(r.score > got[200].score and r.kept == (not r.base_failed and r.score >= -0.3) for i, r in got.items() if i < 60)
    kept = keep_good(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    nobody = labels.filter("false")
    assert all(r.score == 0 for r in quality_rules(df, nobody).collect())
    assert quality_rules(documents(spark, []), labels).collect() == []


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secrets(x):
    spans = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 12] + [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 18] + [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 16]
    order = ("assign", "access", "hex")
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], order.index(s[1]))))


SECRETS = ["é token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" x", "PassWord:hunter2hunter2", "token: secret = 'abcdefghijklmnop'", "AKIAABCDEFGHIJKLMN AKIAshort", "deadbeefdeadbeef00 and 😀 API_KEY='aaaaaaaaaaaa.b'", "key Xk29fjQ0sLmz81PqTbvR4nY7", "api-key none", "", None, "someLongCamelCaseNameForTheTestOfNames1 thhetionthhetionthhetion"]


def test_secret_spans_and_redaction(spark):
    rows = list(enumerate(SECRETS))
    df = documents(spark, rows)
    got = {r.doc_id: r for r in secret_scan(df).collect()}
    for i, t in rows:
        assert got[i].base_spans == secrets(t or ""), t
        assert set(filter(None, got[i].base_spans.split(","))) <= set(got[i].spans.split(","))
    assert got[5].spans == "random:4:28" and got[9].spans == ""
    clean = redact(df)
    assert clean.columns == df.columns
    out = {r.doc_id: r.text for r in clean.collect()}
    assert out[0] == "é [SECRET]\" x" and out[5] == "key [SECRET]" and out[8] is None and out[6] == "api-key none"
    assert secret_scan(documents(spark, [])).collect() == []


def test_secret_scan_is_native(spark):
    plan = secret_scan(documents(spark))._jdf.queryExecution().toString() + redact(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


TURNS = [
    (1, 0, "system", "be \\ nice </s>"), (1, 1, "user", "[INST]\\[/INST] <s> \\\\ $1"), (1, 2, "assistant", "a " * 700), (1, 3, None, None), (1, 4, "assistant", "x\n[\\INST]"), (1, 5, "user", "b " * 300), (1, 6, "assistant", "c " * 300),
    (None, 0, "assistant", ""), (2, 1, "assistant", "same"), (2, 1, "assistant", "same"), (3, None, "user", "</s>[INST] ok [/INST]"),
    *((4, i, "assistant" if i % 2 else "user", f"turn {i} " * 20) for i in range(60)),
]


def test_chat_windows_read_back(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "'n' AS n", "0 AS window")
    w = chat_windows(df, budget=256)
    turns = collections.defaultdict(list)
    for c, n, r, t in TURNS:
        turns[c].append((-1 if n is None else n, r or "", t or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = digests(w).collect()
    assert {r.conv_id for r in got} == set(turns)
    for r in got:
        own = sorted(turns[r.conv_id])
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{a}\n{t}\n" for _, a, t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    rows = sorted((x.asDict() for x in w.filter("conv_id = 4").collect()), key=lambda x: x["window"])
    assert len(rows) > 3 and all(x["n_context"] <= 2 for x in rows) and rows[0]["n_context"] == 0
    system = [x for x in w.filter("conv_id = 1").collect() if x.window > 0]
    assert system and all(x.formatted.startswith("[INST]system[/INST]") for x in system)
    assert sum(len(x.targets) for x in read_back(w).collect()) == sum(r == "assistant" for _, _, r, _ in TURNS)
    assert chat_windows(df.filter("false")).collect() == []
    assert not re.search("Python|Pandas|Arrow", digests(w)._jdf.queryExecution().toString())


def spans_truth(tokens, budget, history, system):
    """Windows of one block: (turns repeated, own turns) as positions, with the system turn at 0 where there is one."""
    own = tokens[0] if system else 0
    step = (budget - own) // 2
    spans, before, last = [], 0, None
    for i in range(system, len(tokens)):
        n = tokens[i]
        alone = n > step
        part = before // step if step > 0 else 0
        if not spans or alone or last[0] or part != last[1]:
            spans.append([])
        spans[-1].append(i)
        before, last = before + n, (alone, part)
    out = []
    for j, span in enumerate(spans):
        room, again = budget - own - sum(tokens[i] for i in span), []
        for i in range(span[0] - 1, max(system, span[0] - history) - 1, -1):
            room -= tokens[i]
            if room < 0:
                break
            again.insert(0, i)
        out.append(([0] * (system and j > 0) + again, [0] * (system and j == 0) + span))
    return out


def test_chat_windows_keep_their_budget(spark):
    rng = random.Random(11)
    said = {}
    for c in range(60):
        sizes = [rng.choice([1, 5, 20, 60, 120, 400]) for _ in range(rng.randint(1, 40))]
        roles = ["system" if c % 3 == 0 else "user", *rng.choices(["user", "assistant"], k=len(sizes) - 1)]
        if c % 6 == 0:
            sizes[0] = rng.choice([50, 200, 256, 900])
        said[c] = [(c, i, role, " ".join(["w"] * n)) for i, (role, n) in enumerate(zip(roles, sizes))]
    df = spark.createDataFrame([x for y in said.values() for x in y], "conv_id long, turn long, role string, text string")
    got = collections.defaultdict(list)
    for x in chat_windows(df, budget=256, history=3).orderBy("conv_id", "block", "window").collect():
        turns = [re.match(r"\[INST\](.*?)\[/INST\](.*)$", p, re.S).groups() for p in x.formatted.split("</s>")[:-1]]
        got[x.conv_id].append((turns[: x.n_context], turns[x.n_context :], x.tokens))
    over = 0
    for c, rows in said.items():
        tokens, system = [len(t.split()) + 4 for *_, t in rows], int(rows[0][2] == "system")
        want = [([(rows[i][2], rows[i][3]) for i in a], [(rows[i][2], rows[i][3]) for i in b], sum(tokens[i] for i in a + b)) for a, b in spans_truth(tokens, 256, 3, system)] or [([], [rows[0][2:]], tokens[0])]
        assert got[c] == want
        for again, own, n in got[c]:
            regular = own[system:] if own and own[0][0] == "system" else own
            over += n > 256
            assert n <= 256 or len(regular) <= 1
            assert n <= 256 or len([x for x in again if x[0] != "system"]) == 0
    assert over


def test_windows_dont_depend_on_turn_numbers_or_blocks(spark, monkeypatch):
    """3000 turns numbered 0, 1, ... and sparsely, in blocks of 1024 and of 16 ranks, against the spans in plain Python; history reaches over every edge."""
    from aerotrace.llm import chat_format

    rng = random.Random(7)
    sizes = [rng.choice([1, 1, 2, 5, 9, 30, 90]) for _ in range(3000)]
    roles = ["system", *rng.choices(["user", "assistant"], k=2999)]
    numbers = {1: list(range(3000)), 2: [2000 * i for i in range(3000)], 3: sorted(rng.sample(range(-(1 << 60), 1 << 60), 3000))}
    rows = [(c, t, role, f"{i} " + "w " * (n - 1)) for c, at in numbers.items() for i, (t, role, n) in enumerate(zip(at, roles, sizes))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = [[sum(x) for x in ((len(a),), (len(b),))] for a, b in spans_truth([n + 4 for n in sizes], 128, 3, 1)]
    found = []
    for bits in (10, 4):
        monkeypatch.setattr(chat_format, "BLOCK_BITS", bits)
        got = collections.defaultdict(list)
        for x in chat_windows(df, budget=128, history=3).orderBy("conv_id", "block", "window").collect():
            got[x.conv_id].append((x.formatted, x.n_context, x.tokens, x.window, tuple(map(tuple, x.mask))))
        assert got[1] == got[2] == got[3]
        found.append(got[1])
    assert found[0] == found[1]
    place = 0
    for (formatted, n_context, tokens, window, _), (again, own) in zip(found[0], want, strict=True):
        assert (n_context, formatted.count("</s>")) == (again, again + own) and window == place + 1 and (tokens <= 128 or own == 1)
        place += own
    assert place == 3000


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_windows(empty).collect() == [] and digests(chat_windows(empty)).collect() == []


def test_a_long_conversation_is_spread_over_blocks(spark):
    rows = [(1, i, "system" if i == 0 else "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    w = chat_windows(df, budget=64).collect()
    assert {x.block for x in w} == {0, 1, 2} and all(x.tokens <= 64 and x.formatted.startswith("[INST]system[/INST]") for x in w)
    got = digests(chat_windows(df, budget=64)).collect()[0]
    assert got.n_turns == 3000 and got.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert got.loss_sha256 == hashlib.sha256("".join(t for _, _, r, t in rows if r == "assistant").encode()).hexdigest()


def test_columns_with_any_names(spark):
    names = ["m0", "m1", "s0", "s2", "r3", "__t", "__base", "__all", "__limit", "__new", "t", "new", "row", "k", "sha", "__k", "__sha", "f"]
    docs = spark.createDataFrame([(1, "token = abcdefghijkl123", 24), (2, "token = abcdefghijkl123", 24), (3, None, None)], "doc_id long, text string, n_chars long").selectExpr("*", *(f"'{x}' AS `{x}`" for x in names))
    for out, rows in ((redact(docs, chars_col="n_chars"), 3), (drop_copies(docs), 2)):
        got = out.collect()
        assert out.columns == docs.columns and len(got) == rows
        assert all(r[x] == x for r in got for x in names)
    assert {r.text for r in redact(docs).collect()} == {"[SECRET]", None}


def test_license_base_places(spark):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    phrases = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
    rows = [*texts(), (300, "All rights\nreserved. CC-BY cc by; General Public License"), (301, "cc"), (302, "by all rights"), (303, "Licensed under the Apache License, Version 2.0."), (304, "Copyright 2020 A. Person and others. All rights reserved."), (305, "under the terms of the MIT licence")]
    got = {r.doc_id: r for r in license_scan(documents(spark, rows)).collect()}
    for i, t in rows:
        w = word.findall((t or "").translate(low))
        at = [(j, l) for p, l in phrases.items() for j in range(len(w)) if tuple(w[j : j + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({l for _, l in at})))
        assert 0 <= r.score <= 1
    assert got[303].labels == "apache-2.0" and got[303].score == 1 and got[304].labels == "all-rights-reserved,reserved" and got[305].labels == ""
    assert license_scan(documents(spark, [])).collect() == []


def test_automata_accept_exactly_the_mandatory_words():
    a = Automaton("under the <<beginOptional>>terms of the<<endOptional>> mit <<var;max=2>> license")
    yes = ["under the mit license", "under the terms of the mit license", "under the mit open source license"]
    no = ["under the terms mit license", "under mit license", "under the mit a b c license", "under the mit"]
    assert [a.accepts(x.split()) > 0 for x in yes + no] == [True] * 3 + [False] * 4
    assert all(Automaton(t) for ts in TEMPLATES.values() for t in ts)
    with pytest.raises(ValueError):
        Automaton("<<beginOptional>>a<<endOptional>>")


ENCODINGS = {
    # symbols, and the least share found at 20, 32, 64 and 128 characters
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", (0.85, 0.95, 0.98, 0.98)),
    "base62": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", (0.82, 0.95, 0.98, 0.98)),
    "letters": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", (0.3, 0.75, 0.97, 0.98)),
    "BASE32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", (0.45, 0.68, 0.9, 0.98)),
    "base32": ("abcdefghijklmnopqrstuvwxyz234567", (0.45, 0.68, 0.9, 0.98)),
    "BASE36": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", (0.55, 0.83, 0.97, 0.98)),
    "base36": ("abcdefghijklmnopqrstuvwxyz0123456789", (0.55, 0.83, 0.97, 0.98)),
    "HEX": ("0123456789ABCDEF", (0.7, 0.9, 0.98, 0.98)),
}


def test_random_runs_are_found_in_each_encoding_and_words_are_not(spark):
    rng = random.Random(11)
    cases = [(e, n, "".join(rng.choice(a) for _ in range(n))) for e, (a, _) in ENCODINGS.items() for n in (20, 32, 64, 128) for _ in range(200)]
    got = {r.doc_id: r.n_random for r in secret_scan(documents(spark, [(i, f"- {t} -") for i, (_, _, t) in enumerate(cases)])).collect()}
    found = collections.Counter((e, n) for i, (e, n, _) in enumerate(cases) if got[i])
    share = {e: tuple(found[e, n] / 200 for n in (20, 32, 64, 128)) for e in ENCODINGS}
    assert all(x >= y for e, (_, least) in ENCODINGS.items() for x, y in zip(share[e], least, strict=True)), share
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(600)) for _ in range(20)]
    words = ["someLongCamelCaseNameForTheTestOfNames1", "usr/local/lib/python3/site-packages/pip", "SOME_LONG_NAME_OF_A_CONSTANT_2", "donaudampfschifffahrtsgesellschaft", "INTERNATIONALIZATION2OF3", "a-name-in-kebab-case-with-2-digits", "HTTPServerRequestHandlerFactory2", "-" * 40, "=" * 30]
    got = {r.doc_id: r.n_random for r in secret_scan(documents(spark, [(i, t) for i, t in enumerate([*letters, *words])])).collect()}
    assert sum(got[i] for i in range(20)) >= 18 and not any(got[20 + i] for i in range(len(words))), got
