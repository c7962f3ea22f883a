"""License texts by template markup compiled into token automata.

A template is a sequence of words with two kinds of markup: optional regions, and
replaceable regions of a bounded number of words.  It is compiled into a
nondeterministic automaton over words, which becomes deterministic as far as texts
need it.  A text is accepted where all mandatory words stand exactly, in order,
with nothing between them but what the markup allows.  Automata start only at
words that can open a template, so other text costs a table look-up per word.

Base phrases are places of fixed consecutive words, found for all words at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import id_of, key_of
from .near_dedup import LOWER

# The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices by label: <<beginOptional>>...<<endOptional>> may be left out, <<var;max=n>> stands for at most n words.
NOTICES = {
    "apache-2.0": ["licensed under the <<beginOptional>>terms of the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> 2 0"],
    "mit": ["under the <<beginOptional>>terms of the<<endOptional>> mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of <<var;max=8>> to deal in <<var;max=3>> without restriction"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "gpl-2.0": ["gnu general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> <<beginOptional>>version<<endOptional>> 2", "gnu general public license v2"],
    "gpl-3.0": ["gnu general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> <<beginOptional>>version<<endOptional>> 3", "gnu general public license v3"],
    "lgpl": ["gnu <<beginOptional>>lesser<<endOptional>> <<beginOptional>>library<<endOptional>> general public license version 2 1", "gnu lesser general public license"],
    "agpl-3.0": ["gnu affero general public license <<var;max=8>> version 3", "gnu affero general public license v3"],
    "mpl-2.0": ["subject to the terms of the mozilla public license <<beginOptional>>v<<endOptional>> <<beginOptional>>version<<endOptional>> 2 0"],
    "cc-by-4.0": ["licensed under <<beginOptional>>a<<endOptional>> cc by 4 0", "creative commons attribution 4 0 international <<beginOptional>>public<<endOptional>> license"],
    "cc-by-sa-4.0": ["licensed under <<beginOptional>>a<<endOptional>> cc by sa 4 0"],
    "cc-by-nc-4.0": ["licensed under <<beginOptional>>a<<endOptional>> cc by nc 4 0"],
    "all-rights-reserved": ["copyright <<var;max=8>> all rights reserved"],
}

# The wording of licenses and of their standard headers, from their first mandatory word on.
_BSD_TERMS = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
    <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
    <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
    in the documentation and or other materials provided with the distribution"""
_BSD_NAMES = """<<beginOptional>>3<<endOptional>> neither the name of <<var;max=12>> nor the names of its contributors may be used to endorse or promote products
    derived from this software without specific prior written permission"""
_BSD_DISCLAIMER = """this software is provided by <<var;max=12>> as is and any express or implied warranties including but not limited to the implied
    warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;max=12>> be liable for any direct indirect
    incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or
    profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or
    otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""
_GPL_HEADER = """this <<var;max=4>> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
    free software foundation either version {} of the license or at your option any later version this <<var;max=4>> is distributed in the hope that it will be
    useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public
    license for more details"""
#: Whole texts and standard headers by label.
TEXTS = {
    "mit-text": ["""permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software
        to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
        copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice
        and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the
        software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
        fitness for a particular purpose and noninfringement in no event shall <<var;max=10>> be liable for any claim damages or other liability whether in an
        action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"""],
    "isc-text": ["""permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;max=8>> disclaims all
        warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;max=8>> be liable for
        any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of
        contract negligence or other tortious action arising out of or in connection with the use or performance of this software"""],
    "bsd-2-clause-text": [f"{_BSD_TERMS} {_BSD_DISCLAIMER}"],
    "bsd-3-clause-text": [f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_DISCLAIMER}"],
    "apache-2.0-header": ["""licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a
        copy of the license at <<var;max=12>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on
        an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions
        and limitations under the license"""],
    "gpl-2.0-header": [_GPL_HEADER.format(2)],
    "gpl-3.0-header": [_GPL_HEADER.format(3)],
    "mpl-2.0-header": ["""this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you
        can obtain one at"""],
    "zlib-text": ["""this software is provided as is without any express or implied warranty in no event will <<var;max=6>> be held liable for any damages arising from
        the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and
        redistribute it freely subject to the following restrictions"""],
    "unlicense-text": ["""this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
        software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"""],
}
TEMPLATES = NOTICES | TEXTS

SEPARATOR = np.ones(256, bool)
SEPARATOR[0x30:0x3A] = SEPARATOR[0x61:0x7B] = SEPARATOR[0x80:] = False
ANY = "*"


class Automaton:
    """A template as states with edges by word; deterministic state sets are made when first reached."""

    def __init__(self, template: str):
        self.edges: list[list[tuple[str, int]]] = [[]]  # of a state: (word, next)
        self.free: list[list[int]] = [[]]  # of a state: next without a word
        self.words: set[str] = set()
        opened: list[int] = []
        for part in re.findall(r"<<[^>]*>>|[^\s<>]+", template):
            if part == "<<beginOptional>>":
                opened.append(len(self.edges) - 1)
            elif part == "<<endOptional>>":
                self.free[opened.pop()].append(len(self.edges) - 1)
            elif m := re.fullmatch(r"<<var;max=(\d+)>>", part):
                first = len(self.edges) - 1
                for _ in range(int(m[1])):
                    self._step(ANY)
                for s in range(first, len(self.edges) - 1):
                    self.free[s].append(len(self.edges) - 1)
            else:
                self._step(part)
                self.words.add(part)
        if opened:
            raise ValueError(f"an optional region isn't ended: {template}")
        self.final = len(self.edges) - 1
        self.start = self._closed({0})
        self.first = {w for s in self.start for w, _ in self.edges[s]}
        if ANY in self.first or self.final in self.start:
            raise ValueError(f"a template must open with a word: {template}")
        self.table: dict[tuple[frozenset, str], frozenset] = {}

    def _step(self, word: str) -> None:
        self.edges[-1].append((word, len(self.edges)))
        self.edges.append([])
        self.free.append([])

    def _closed(self, states: set[int]) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def accepts(self, words: Iterable[str]) -> int:
        """How many of the words from the first on are matched; 0 if the template doesn't stand there."""
        now = self.start
        for i, w in enumerate(words):
            then = self.table.get((now, w))
            if then is None:
                then = self._closed({n for s in now for x, n in self.edges[s] if x in (w, ANY)})
                self.table[now, w] = then
            if not then:
                return 0
            if self.final in then:
                return i + 1
            now = then
        return 0

    @property
    def longest(self) -> int:
        return len(self.edges) - 1


class Matcher:
    """All phrases and templates over one small vocabulary; every other word is alike."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.automata = [(Automaton(t), label) for label, ts in templates.items() for t in ts]
        self.vocabulary = sorted({w for p, _ in self.phrases for w in p} | {w for a, _ in self.automata for w in a.words})
        self.known = tv.Chunk(*tv.flat(pa.array(self.vocabulary)), 0).words(SEPARATOR)
        self.hashes = self.known.word_hashes()
        self.order = np.argsort(self.hashes)
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.coded = [([number[w] for w in p], label) for p, label in self.phrases]
        self.openers: dict[int, list] = {}
        for a, label in self.automata:
            for w in a.first:
                self.openers.setdefault(number[w], []).append((a, label))

    def numbers(self, c: tv.Chunk) -> np.ndarray:
        """The number of each word of a chunk in the vocabulary, or -1."""
        buf = LOWER[c.buf]
        h = c.words(SEPARATOR, buf).word_hashes(buf)
        at = np.minimum(np.searchsorted(self.hashes[self.order], h), len(self.order) - 1)
        number = np.where(self.hashes[self.order][at] == h, self.order[at], -1)
        hit = np.flatnonzero(number >= 0)
        mine = number[hit]
        same = tv.same_spans(buf, c.w_start[hit], c.w_end[hit], self.known.buf, self.known.w_start[mine], self.known.w_end[mine])
        number[hit[~same]] = -1
        return number

    def chunk(self, c: tv.Chunk) -> list[tuple]:
        """(n_words, n_base, first, last, base_labels, labels, score, spans) of each document."""
        ids = self.numbers(c)
        base: list[list[tuple[int, str]]] = [[] for _ in range(c.n)]
        covered = np.zeros(len(ids) + 1, np.int64)  # where words that phrases and templates hold begin and end
        for phrase, label in self.coded:
            n = len(ids) - len(phrase) + 1
            if n <= 0:
                continue
            hit = c.w_doc[:n] == c.w_doc[len(phrase) - 1 :]
            for j, w in enumerate(phrase):
                hit &= ids[j : n + j] == w
            for i in np.flatnonzero(hit).tolist():
                d = int(c.w_doc[i])
                base[d].append((i - int(c.w_from[d]), label))
                covered[i] += 1
                covered[i + len(phrase)] -= 1
        spans: list[set[tuple[int, int, str]]] = [set() for _ in range(c.n)]
        for i in np.flatnonzero(np.isin(ids, list(self.openers))).tolist():
            d = int(c.w_doc[i])
            end = int(c.w_from[d + 1])
            for a, label in self.openers[int(ids[i])]:
                words = (self.vocabulary[x] if x >= 0 else "" for x in ids[i : min(end, i + a.longest)])
                if n := a.accepts(words):
                    spans[d].add((i - int(c.w_from[d]), i - int(c.w_from[d]) + n, label))
                    covered[i] += 1
                    covered[i + n] -= 1
        inside = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
        out = []
        for d in range(c.n):
            at = [x for x, _ in base[d]]
            labels = {x for _, x in base[d]}
            full = {x for *_, x in spans[d]}
            share = float(inside[c.w_from[d + 1]] - inside[c.w_from[d]]) / max(int(c.w_count[d]), 1)
            score = 1.0 if full & TEXTS.keys() else 0.5 + share / 2 if full else 0.25 + share / 4 if labels else 0.0
            out.append((int(c.w_count[d]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | full)), score, [{"start": a, "stop": b, "label": x} for a, b, x in sorted(spans[d])]))
        return out


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start:long,stop:long,label:string>>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are runs of digits, letters (A-Z lowered) and non-ASCII characters.
    spans are the word ranges that templates accept; a label that ends in -text or
    -header is a whole wording, others are notices.  score is 1 if a whole wording is
    accepted, 0.5 to 1 if notices are, 0.25 to 0.5 if only base phrases stand in the
    text, each by the share of words that they cover, else 0.  A null or empty
    text has no words, places or labels and a score of 0; repeated rows stay
    repeated; other columns are ignored; no rows in, no rows out.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        matcher = Matcher(PHRASES, templates)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string())]))]
        names = [x.split()[0] for x in FIELDS.split(", ")]
        for batch in batches:
            ks = batch.column(batch.schema.get_field_index("k"))
            for c in tv.chunks(batch.column(batch.schema.get_field_index("text"))):
                rows = matcher.chunk(c)
                yield pa.RecordBatch.from_arrays([ks.slice(c.first, c.n), *(pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True))], names=["k", *names])

    base = docs.select(key_of(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, f"k long, {FIELDS}").select(id_of("k").alias(id_col), *(x.split()[0] for x in FIELDS.split(", ")))
