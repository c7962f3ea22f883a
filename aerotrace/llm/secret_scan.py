"""Secrets in whole texts, with DataFrame functions alone.

Three kinds follow fixed patterns.  The method's own kind, ``random``, tests long
runs of encoding characters for randomness.  For each an encoding is inferred
(hexadecimal, base 32, base 36, base 64, or letters alone; upper and lower case)
and three statistics are compared with what an ordinary word of the same length
and alphabet gives:

* chi-squared of the symbol counts against uniformity: it grows with the length
  for words and stays near the alphabet's size for random strings;
* runs of character classes: random strings change class at a rate that the
  alphabet gives, words at a quarter of it;
* serial correlation of neighbouring classes: near 0 for random strings, high for words.

A capital and the small letters after it are one run, and what joins words
(``+/_=-``) has no class, so names of several words change class as seldom as
one.  Letters of one case have one class and are judged by chi-squared alone.
The three deviations are combined (Stouffer, with the correlation of the last
two) into an upper bound of the normal tail, which alone decides.
A short string can't deviate far, so length counts by itself.  The bounds
of one document's runs are judged together by Benjamini-Hochberg at a rate
that bounds the false discoveries among its reported spans.

Positions come from the gaps between matches: splitting a text at a pattern and
extracting all its matches walk over the same matches, so running sums of their
lengths are the starts, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_of, key_of

KINDS = ("assign", "access", "hex", "random")
#: False discoveries allowed among the reported random runs of one document.
RATE = 0.001
#: Shortest run that is tested.
SHORTEST = 20
# The patterns of the base kinds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST

SPANS = "array<struct<start:int,kind:int,stop:int,mark:double>>"


def _matches(text: str, pattern: str, kind: int, length: str, keep: str, mark: str = "0D") -> Column:
    """The kept matches of a pattern: struct of start, kind, stop and a mark."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    empty = f"cast(array() as {SPANS})"
    return F.expr(f"""
        CASE WHEN size(m{kind}) = 0 THEN {empty} ELSE
        aggregate(zip_with(m{kind}, slice(split({text}, '{quoted}', -1), 1, size(m{kind})), (m, gap) -> named_struct('m', m, 'gap', length(gap))),
            named_struct('at', 0, 'spans', {empty}),
            (acc, x) -> named_struct('at', acc.at + x.gap + length(x.m),
                'spans', IF({keep}, concat(acc.spans, array(named_struct('start', acc.at + x.gap, 'kind', {kind}, 'stop', acc.at + x.gap + length(x.m), 'mark', {mark}))), acc.spans)),
            acc -> acc.spans) END""")


#: Inferred alphabets: pattern, symbols, and how often a random string of them changes class (once for a capital and what follows it).
ALPHABETS = (
    ("^([a-z]+|[A-Z]+)$", 26, 0.0),
    ("^([0-9a-f]+|[0-9A-F]+)$", 16, 0.4688),
    ("^([A-Z2-7]+|[a-z2-7]+)=*$", 32, 0.3047),
    ("^([a-z0-9]+|[A-Z0-9]+)$", 36, 0.4012),
    ("^[A-Za-z]+$", 52, 0.375),
    ("", 64, 0.5202),
)
#: A word changes class at this share of the random rate; the serial correlation of its classes.
WORD_STEPS, WORD_SERIAL = 0.25, 0.7


def _tail_bound() -> str:
    """The bound of the tail of one run, as SQL over x.m."""
    n = "length(x.m)"
    alphabet = f"CASE {' '.join(f"WHEN x.m rlike '{p}' THEN named_struct('k', {k}D, 'r', {r}D)" for p, k, r in ALPHABETS)} END"
    squares = f"aggregate(array_distinct(split(x.m, '')), 0D, (a, ch) -> a + pow({n} - length(replace(x.m, ch, '')), 2))"
    # classes of neighbouring characters, as one letter each; what joins words doesn't count
    classes = "translate(regexp_replace(regexp_replace(regexp_replace(x.m, '[a-z]', 'l'), '[A-Z]', 'u'), '[0-9]', 'd'), '+/_=-', '')"
    return f"""aggregate(array(named_struct('n', cast({n} as double), 'a', {alphabet}, 'sq', {squares}, 'c', {classes})), 1D, (a, w) ->
        aggregate(array(named_struct('n', w.n, 'k', w.a.k, 'r', w.a.r, 'sq', w.sq, 'next', cast(greatest(length(w.c) - 1, 1) as double), 'steps', cast(length(regexp_replace(w.c, 'u?l+|u+|d+', 'x')) - 1 as double))), 1D, (b, t) ->
        aggregate(array(named_struct(
            -- a word's symbols repeat with probability 0.066 or so; in hexadecimal words have at least twice the uniform repeats
            'chi', (((t.k - 1) + (t.n - 1) * (t.k * IF(t.k = 16D, 0.125D, 0.066D) - 1)) - (t.k / t.n * t.sq - t.n)) / (2 * sqrt(t.n * t.k * 0.066D) + sqrt(2 * (t.k - 1))),
            'runs', IF(t.r = 0D, 0D, (t.steps - {WORD_STEPS}D * t.r * t.next) / sqrt({WORD_STEPS}D * t.r * (1 - {WORD_STEPS}D * t.r) * t.next)),
            'serial', IF(t.r = 0D, 0D, ({WORD_SERIAL}D - (1 - t.steps / t.next / t.r)) * sqrt(t.next)))), 1D, (c, z) ->
            -- runs and serial correlation go together, so their sum has a variance of up to 4
            aggregate(array((z.chi + z.runs + z.serial) / IF(t.r = 0D, 1D, sqrt(5D))), 1D, (d, s) -> IF(s <= 1D, 1D, exp(-s * s / 2) / (s * 2.5066D))))))"""


def scanned(df: DataFrame, text: str) -> DataFrame:
    """df with __base and __all: arrays of struct(start, kind, stop, mark), sorted by start, then kind."""
    found = df.withColumns({f"m{i}": F.expr(f"regexp_extract_all({text}, '{p}', 0)") for i, p in ((i, p.replace("\\", "\\\\").replace("'", "\\'")) for i, p in enumerate((ASSIGN, ACCESS, HEX, RUN)))})
    quoted = ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
    found = found.withColumns({
        "s0": _matches(text, ASSIGN, 0, "", f"length(regexp_extract(x.m, '{quoted}', 2)) >= 12"),
        "s1": _matches(text, ACCESS, 1, "", "true"),
        "s2": _matches(text, HEX, 2, "", "true"),
        "r3": _matches(text, RUN, 3, "", "true", _tail_bound()),
    })
    found = found.withColumn("__base", F.array_sort(F.concat("s0", "s1", "s2")))
    # Benjamini-Hochberg over the runs of the document: the largest bound that its rank allows
    limit = f"""aggregate(transform(array_sort(transform(r3, x -> x.mark)), (p, i) -> IF(p <= (i + 1) * {RATE}D / size(r3), p, -1D)), -1D, (a, p) -> greatest(a, p))"""
    found = found.withColumn("__limit", F.expr(limit))
    own = "filter(r3, x -> x.mark <= __limit AND NOT exists(__base, b -> b.start <= x.start AND x.stop <= b.stop))"
    return found.withColumn("__all", F.array_sort(F.concat("__base", F.expr(own)))).drop("m0", "m1", "m2", "m3", "s0", "s1", "s2", "r3", "__limit")


def _told(column: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"concat_ws(',', transform({column}, x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.stop)))")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, n_random, base_spans, spans.

    Spans are kind:start:end in code points, by start, then by kind.  A null or
    empty text has none; rows are scanned one by one, so repeated rows stay
    repeated; other columns are ignored.
    """
    x = scanned(docs.select(key_of(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")), "t")
    count = lambda i: F.size(F.filter("__all", lambda s: s["kind"] == i)).cast("long")
    return x.select(id_of("k").alias(id_col), *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), _told("__base").alias("base_spans"), _told("__all").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret replaced by ``mask``; spans that overlap count as one.

    A null text stays null; ``chars_col``, if given, holds the new length of the
    texts that changed.  All rows and columns stay.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # whatever the columns are called
    x = scanned(docs.select(row, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t")), "t")
    new = F.expr(f"""
        aggregate(__all, named_struct('at', 0, 'out', cast(array() AS array<string>)),
            (acc, s) -> named_struct('at', greatest(acc.at, s.stop),
                'out', IF(s.start >= acc.at, concat(acc.out, array(substring(t, acc.at + 1, s.start - acc.at), '{mask}')), acc.out)),
            acc -> concat(array_join(acc.out, ''), substring(t, acc.at + 1, length(t))))""")
    changed = F.size("__all") > 0
    x = x.withColumn("new", F.when(changed, new))
    named = {text_col: F.when(changed, F.col("new")).otherwise(F.col(f"row.`{text_col}`"))}
    if chars_col is not None:
        named[chars_col] = F.when(changed, F.length("new").cast(docs.schema[chars_col].dataType)).otherwise(F.col(f"row.`{chars_col}`"))
    return x.select(*(named.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
