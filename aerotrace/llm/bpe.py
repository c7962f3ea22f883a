"""Byte-level BPE over whole texts by prefix-sharing trie traversal.

Texts are split into pretokens by NumPy over their bytes.  The distinct
pretokens of a chunk, in sorted order, are the depth-first walk of a trie: from
one to the next only the part behind the common prefix is new.  For each trie
node the last token of the encoding of its prefix is kept.  A token that is a
suffix of the prefix is that last token exactly when the merges leave the
boundary between it and the last token before it alone, so a node's state
follows from a shorter prefix, and prefixes that words share are encoded once.

``encode`` and ``decode`` are DataFrame operators; their Arrow functions keep
one vocabulary and a bounded cache of words for each Python worker.
"""

from __future__ import annotations

import functools
import hashlib
import json
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import id_of, key_of

LETTER, NUMBER, SPACE, OTHER = range(4)
NEVER = 1 << 60
#: Words kept per Python worker between chunks.
CACHE_WORDS = 200_000


@functools.cache
def char_classes() -> np.ndarray:
    """The class of every code point."""
    white = {9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[list(white)] = SPACE
    return table


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[ch] for ch in s)
        self.ids = {as_bytes(s): i for s, i in said["model"]["vocab"].items() if all(ch in alphabet for ch in s)}
        self.special = {x["content"].encode(): x["id"] for x in said["added_tokens"]}
        for content in self.special:
            self.ids.pop(content, None)
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: b for b, i in self.special.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(said["model"]["merges"]):
            a, b = (as_bytes(s) for s in (pair.split(" ") if isinstance(pair, str) else pair))
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.pairs[left, right] = rank
            self.made.setdefault(whole, (left, right, rank))
        self.longest = max(map(len, self.ids))
        size = max(self.bytes_of) + 1
        self.width = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self.at = np.concatenate(([0], np.cumsum(self.width)))
        self._edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self._apart: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.cache: dict[bytes, list[int]] = {}

    def edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The tokens at one edge of ``token`` while it is merged, first to last, each with the rank that ends it."""
        found = self._edges.get((token, right))
        if found is None:
            found, t, ends = [], token, NEVER
            while True:
                found.append((t, ends))
                if t not in self.made:
                    break
                a, b, ends = self.made[t]
                t = b if right else a
            self._edges[token, right] = found = found[::-1]
        return found

    def apart(self, a: int, b: int) -> bool:
        """Whether the merges leave the boundary between tokens a and b alone."""
        key = a << 20 | b
        known = self._apart.get(key)
        if known is None:
            left, right = self.edge(a, True), self.edge(b, False)
            i = j = 0
            known = True
            while True:
                (x, ends_x), (y, ends_y) = left[i], right[j]
                rank = self.pairs.get((x, y))
                if rank is not None and rank < ends_x and rank <= ends_y:
                    known = False
                    break
                if ends_x == NEVER and ends_y == NEVER:
                    break
                if ends_x <= ends_y:
                    i += 1
                else:
                    j += 1
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            self._apart[key] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether a token's own bytes are encoded as that token."""
        known = self._whole.get(token)
        if known is None:
            known = token not in self.made or self._joined(token)
            self._whole[token] = known
        return known

    def _joined(self, token: int) -> bool:
        parts = [self.ids[bytes([x])] for x in self.bytes_of[token]]
        while len(parts) > 1:
            rank, i = min((self.pairs.get(p, NEVER), i) for i, p in enumerate(zip(parts[:-1], parts[1:], strict=True)))
            if rank == NEVER:
                return False
            parts[i : i + 2] = [self.ids[self.bytes_of[parts[i]] + self.bytes_of[parts[i + 1]]]]
        return parts == [token]

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """The ids of distinct pretokens, by a depth-first walk of their trie."""
        get, apart, whole, longest = self.ids.get, self.apart, self.whole, self.longest
        known, width = self._apart.get, self.width
        last: list[int] = [0]
        out, before = {}, b""
        for w in sorted(words):
            n, d = len(w), 0
            m = min(n, len(before))
            while d < m and w[d] == before[d]:
                d += 1
            del last[d + 1 :]
            for end in range(d + 1, n + 1):
                for start in range(max(0, end - longest), end):
                    t = get(w[start:end])
                    if t is None:
                        continue
                    if start == 0:
                        if whole(t):
                            break
                        continue
                    ok = known(last[start] << 20 | t)
                    if (apart(last[start], t) if ok is None else ok) and whole(t):
                        break
                else:
                    raise ValueError("the vocabulary doesn't hold every byte")
                last.append(t)
            ids, end = [], n
            while end:
                t = last[end]
                ids.append(t)
                end -= int(width[t])
            out[w] = ids[::-1]
            before = w
        return out

    @functools.cached_property
    def library(self):
        """tiktoken's merging of single pretokens with the same ranks."""
        import tiktoken

        return tiktoken.Encoding("own", pat_str=".", mergeable_ranks=self.ids, special_tokens={})._core_bpe

    def ids_of(self, words: list[bytes], fast: bool = False) -> list[list[int]]:
        if fast:  # the library is faster than keeping its results would be worth in memory
            one = self.library.encode_single_piece
            return [[self.special[w]] if w in self.special else one(w) for w in words]
        cache = self.cache
        if len(cache) + len(words) > CACHE_WORDS:
            cache.clear()
        new = [w for w in words if w not in cache]
        cache.update(self.encode_words([w for w in new if w not in self.special]))
        cache.update((w, [self.special[w]]) for w in new if w in self.special)
        return [cache[w] for w in words]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _is_lead(buf: np.ndarray) -> np.ndarray:
    return (buf & 0xC0) != 0x80


def pretoken_starts(c: tv.Chunk, special=()) -> np.ndarray:
    """Byte offsets at which pretokens of the chunk's documents start."""
    buf, n = c.buf, len(c.buf)
    if not n:
        return np.zeros(0, np.int64)
    table = char_classes()
    cls = table[:256][buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.int64)
        b0, b1, b2, b3 = b[lead], b[lead + 1] & 63, b[lead + 2] & 63, b[lead + 3] & 63
        two, three = b0 < 0xE0, b0 < 0xF0
        cp = np.where(two, (b0 & 31) << 6 | b1, np.where(three, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        kind = table[cp]
        cls[lead] = kind
        cls[lead + 1] = kind
        cls[lead[~two] + 2] = kind[~two]
        cls[lead[~three] + 3] = kind[~three]
    new = np.zeros(n + 1, bool)  # a document or a stretch between special tokens starts
    new[c.offs] = True
    marks = []
    if special:
        data = buf.tobytes()
        for s in special:
            p = data.find(s)
            while p >= 0:
                if not new[p + 1 : p + len(s)].any():
                    marks.append((p, p + len(s)))
                    p = data.find(s, p + len(s))
                else:
                    p = data.find(s, p + 1)
        for a, e in marks:
            new[[a, e]] = True
    run = new[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    at = np.flatnonzero(run)
    spaced = np.zeros(len(at), bool)
    spaced[1:] = (buf[at[1:] - 1] == 0x20) & ~new[at[1:]]
    start = np.zeros(n + 1, bool)
    start[at[(cls[at] == SPACE) | ~spaced]] = True
    # the last character of white space before something else starts a pretoken
    tail = at[1:][(cls[at[1:] - 1] == SPACE) & ~new[at[1:]]] - 1
    for _ in range(3):
        tail = tail - ~_is_lead(buf[tail])
    start[tail] = True
    # contractions
    quote = at[buf[at] == 0x27]
    quote = quote[start[quote]]
    if len(quote):
        ends = np.flatnonzero(new)
        room = ends[np.searchsorted(ends, quote, "right")] - quote
        pad = np.concatenate((buf, np.zeros(2, np.uint8)))
        x, y = pad[quote + 1], pad[quote + 2]
        one = (room >= 2) & np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = (room >= 3) & (((x == 0x72) & (y == 0x65)) | ((x == 0x76) & (y == 0x65)) | ((x == 0x6C) & (y == 0x6C)))
        for which, size in ((one, 2), (two, 3)):
            start[quote[which] + 1] = False
            start[quote[which] + size] = True
    for a, e in marks:
        start[a:e] = False
        start[a] = True
    return np.flatnonzero(start[:n])


def chunk_ids(c: tv.Chunk, v: Vocabulary, fast: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the chunk, and where those of each document start (and the end).

    fast: words are merged by a library instead of the trie; the ids are the same.
    """
    starts = pretoken_starts(c, tuple(v.special))
    if not len(starts):
        return np.zeros(0, np.uint32), np.zeros(c.n + 1, np.int64)
    ends = np.append(starts[1:], len(c.buf))
    first, inverse = tv.numbered(c.buf, starts, ends)
    data = c.buf.tobytes()
    lists = v.ids_of([data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], fast)
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for y in lists for x in y), np.uint32, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    n = sizes[inverse]
    before = np.cumsum(n) - n
    ids = flat[np.repeat(begin[inverse] - before, n) + np.arange(int(n.sum()))]
    total = np.append(before, int(n.sum()))
    return ids, total[np.searchsorted(starts, c.offs)]


def decoded(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The bytes of ids."""
    n = v.width[ids]
    before = np.cumsum(n) - n
    return v.flat[np.repeat(v.at[ids] - before, n) + np.arange(int(n.sum()))]


def _encode(path: str, with_ids: bool):
    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            ks = batch.column(batch.schema.get_field_index("k"))
            for c in tv.chunks(batch.column(batch.schema.get_field_index("text"))):
                ids, at = chunk_ids(c, v)
                digests = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))) if with_ids else pa.nulls(c.n, pa.list_(pa.int32()))
                back = decoded(ids, v)
                edge = np.concatenate(([0], np.cumsum(v.width[ids])))[at]
                said = [hashlib.sha256(back[a:b].tobytes().decode("utf-8", "replace").encode()).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ks.slice(c.first, c.n), pa.array(np.diff(at)), lists, pa.array(digests), pa.array(said)], names=["k", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of docs: id, n_tokens, ids (if asked for), ids_sha256, decoded_sha256.

    ``vocab`` is the path of a byte-level BPE file of the tokenizers library.
    Its special tokens count as such where their strings stand in a text.  A
    null or empty text has no ids; texts are encoded whole; repeated rows stay
    repeated.  Other columns are ignored.
    """
    base = docs.select(key_of(id_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    out = base.mapInArrow(_encode(vocab, with_ids), "k long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
    return out.select(id_of("k").alias(id_col), "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256")


def decode(rows: DataFrame, vocab: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """rows with the text of an array of ids as ``out_col`` in place of ``ids_col``; null ids give an empty text."""
    kept = [c for c in rows.columns if c not in (ids_col, out_col)]

    def run(batches):
        v = vocabulary(vocab)
        for batch in batches:
            texts = [decoded(np.array(x or [], np.int64), v).tobytes().decode("utf-8", "replace") for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(texts, pa.string())], names=[*kept, out_col])

    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept] + [f"`{out_col}` string"])
    return rows.mapInArrow(run, schema)
