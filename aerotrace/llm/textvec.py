"""Whole texts of an Arrow batch as flat byte arrays: words, hashes and windows in NumPy.

A batch of documents is one byte array plus document offsets.  Words, word
hashes and window hashes are computed for all its texts at once, so the cost per
byte doesn't depend on how long a single text is and no text is ever cut.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

U = np.uint64
#: Spans longer than this are hashed one by one.
LONG_SPAN = 64
#: The bits of a load of 8 bytes that belong to a span with so many bytes left.
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], U)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ U(seed)
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of what has hash a followed by what has hash b."""
    return mix(a * U(0x9E3779B97F4A7C15) + b)


def _loads(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a number."""
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: mixed 8 bytes at a time, a long span by BLAKE2b.

    Spans of one length of at most 8 bytes never collide; others do as random numbers would.
    """
    loads, size = _loads(buf), ends - starts
    out = mix(size.astype(U), 0x5851F42D4C957F2D ^ seed)
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    for done in range(0, LONG_SPAN, 8):
        live = live[size[live] > done]
        if not len(live):
            break
        rest = np.minimum(size[live] - done, 8)
        out[live] = join(out[live], loads[starts[live] + done] & _MASKS[rest])
    salt = seed.to_bytes(8, "little")
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, salt=salt).digest(), "little")
    return out


def same_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> np.ndarray:
    """Whether each span of buf holds the same bytes as its partner in other."""
    size = ends - starts
    same = size == ends2 - starts2
    one, two = _loads(buf), _loads(other)
    live = np.flatnonzero(same & (size <= LONG_SPAN))
    for done in range(0, LONG_SPAN, 8):
        live = live[size[live] > done]
        if not len(live):
            break
        differ = ((one[starts[live] + done] ^ two[starts2[live] + done]) & _MASKS[np.minimum(size[live] - done, 8)]) != 0
        same[live[differ]] = False
        live = live[~differ]
    for i in np.flatnonzero(same & (size > LONG_SPAN)).tolist():
        same[i] = buf is other and starts[i] == starts2[i] or bool((buf[starts[i] : ends[i]] == other[starts2[i] : ends2[i]]).all())
    return same


def numbered(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first span of each distinct content, and each span's number among these.

    Spans have one number exactly when their bytes are equal: hashes group them, bytes confirm it.
    """
    _, first, number = np.unique(span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    if not same_spans(buf, starts, ends, buf, starts[first][number], ends[first][number]).all():  # a collision
        known: dict[bytes, int] = {}
        spans = (buf[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
        number = np.fromiter((known.setdefault(x, len(known)) for x in spans), np.int64, len(starts))
        first = np.unique(number, return_index=True)[1]
    return first, number


def window_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of hashes[i : i + size] for each i, from those of windows of 1, 2, 4, ... entries."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out, level, span, at = np.full(n, mix(np.array([size], U), seed)[0], U), hashes, 1, 0
    while True:
        if size & span:
            out = join(out, level[at : at + n])
            at += span
        if 2 * span > size:
            return out
        level = join(level[:-span], level[span:])
        span *= 2


class Chunk:
    """Documents first..last of a batch: ``buf`` bytes, ``offs`` of each document's start and the end."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int):
        self.buf, self.offs, self.first, self.n = buf, offs, first, len(offs) - 1

    def words(self, separators: np.ndarray = SPACE, buf: np.ndarray | None = None):
        """Sets w_start, w_end (byte offsets), w_doc and w_from (first word of each document, then the count)."""
        buf = self.buf if buf is None else buf
        inside = ~separators[buf]
        begin = inside.copy()
        if len(buf):
            begin[1:] &= ~inside[:-1]
            end = inside.copy()
            end[:-1] &= ~inside[1:]
            cut = self.offs[1:-1]
            cut = cut[(cut > 0) & (cut < len(buf))]
            begin[cut] = inside[cut]
            end[cut - 1] = inside[cut - 1]
        else:
            end = begin
        self.w_start = np.flatnonzero(begin)
        self.w_end = np.flatnonzero(end) + 1
        self.w_from = np.searchsorted(self.w_start, self.offs)
        self.w_count = np.diff(self.w_from)
        self.w_doc = np.repeat(np.arange(self.n), self.w_count)
        return self

    def word_hashes(self, buf: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
        return span_hashes(self.buf if buf is None else buf, self.w_start, self.w_end, seed)

    def windows(self, hashes: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of ``size`` words inside one document, and their hashes."""
        n = len(hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U)
        at = np.flatnonzero(self.w_doc[:n] == self.w_doc[size - 1 :])
        return at, window_hashes(hashes, size, seed)[at]

    def text(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()


@functools.cache
def _trim():
    """The C library's call that returns free memory to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def give_back() -> None:
    """Returns what a batch no longer needs to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and its n + 1 offsets; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    if not (wide or pa.types.is_string(texts.type)):
        texts, wide = texts.cast(pa.large_string()), True
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES):
    """The documents of a batch in order, as Chunks of about ``limit`` bytes."""
    buf, offs = flat(texts)
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield Chunk(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j
    give_back()


def group_starts(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def binaries(parts: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """parts[cuts[i]:cuts[i+1]] as a binary array."""
    width = parts.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * width).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(parts).tobytes())]).cast(pa.binary())
