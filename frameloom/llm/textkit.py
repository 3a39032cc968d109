"""Vectorised word scanning over batches of texts.

Texts are handled as UTF-8 bytes in one flat buffer.  A word is a maximal run
of bytes outside ``0x20, 0x09-0x0D``; UTF-8 continuation bytes never fall in
that set, so the byte rule equals the character rule.  Everything here is numpy
over whole batches: no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: The five primes of XXH64 (public specification).
XXH_P1 = np.uint64(11400714785074694791)
XXH_P2 = np.uint64(14029467366897019727)
XXH_P3 = np.uint64(1609587929392839161)
XXH_P4 = np.uint64(9650029242287828579)
XXH_P5 = np.uint64(2870177450012600261)

#: Bytes of zero after the last text, so that 8-byte loads never leave the buffer.
PAD = 64

#: Texts of one step of work; bounds the memory of a task whatever a batch holds.
STEP_BYTES = 4 << 20


def rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * XXH_P2
    x = x ^ (x >> np.uint64(29))
    x = x * XXH_P3
    return x ^ (x >> np.uint64(32))


@dataclass
class Texts:
    """Flat texts: ``buf`` (padded with zeros), and ``offsets`` of n + 1 texts."""

    buf: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def size(self) -> int:
        return int(self.offsets[-1])

    def raw(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def padded(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + PAD, dtype=np.uint8)
    out[: len(data)] = data
    return out


def texts_of(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> Texts:
    """Texts of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return Texts(padded(np.zeros(0, np.uint8)), np.zeros(1, np.int64))
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    flat = flat[offsets[0] : offsets[-1]]
    return Texts(padded(LOWER[flat] if lower else flat), offsets - offsets[0])


def steps(batch: pa.RecordBatch | pa.Table, text: str, target: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``target`` bytes (one text at least)."""
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    block = np.concatenate([[0], np.cumsum(size.astype(np.int64))[:-1]]) // target
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts], [*cuts, n], strict=True):
        yield batch.slice(a, b - a)
    trim()


def trim() -> None:
    """Give freed memory back to the machine: workers outlive their tasks, and several share an executor's limit."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        found = ctypes.CDLL(None)
        return found if hasattr(found, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


@dataclass
class Words:
    """Words of Texts: byte ranges, and the range of words of each text."""

    texts: Texts
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), self.counts)


def words_of(texts: Texts) -> Words:
    n, off = texts.size, texts.offsets
    solid = np.zeros(n + 2, dtype=bool)
    solid[1 : n + 1] = ~SPACE[texts.buf[:n]]
    begins = solid[1:] & ~solid[:-1]
    ends = solid[:-1] & ~solid[1:]
    if n:
        inner = off[(off > 0) & (off < n)]
        both = inner[solid[inner] & solid[inner + 1]]  # a word on either side of a text's edge
        begins[both] = True
        ends[both] = True
    start, end = np.flatnonzero(begins[: n + 1]), np.flatnonzero(ends)
    return Words(texts, start, end, np.searchsorted(start, off))


def lanes_view(buf: np.ndarray, width: int) -> np.ndarray:
    """Little-endian integers of ``width`` bytes that begin at every byte."""
    kind = {8: "<u8", 4: "<u4"}[width]
    return np.ndarray((len(buf) - width + 1,), kind, buf, 0, (1,))


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, eight bytes a step, all ranges at once."""
    size = end - start
    h = (size.astype(np.uint64) + np.uint64(1)) * XXH_P5
    lanes = lanes_view(buf, 8)
    at, left, live = start, size, None
    while True:
        v = lanes[at] & _KEEP[np.minimum(left, 8)]
        if live is None:
            h = rotl(h ^ (v * XXH_P1), 27) * XXH_P2 + XXH_P4
        else:
            h[live] = rotl(h[live] ^ (v * XXH_P1), 27) * XXH_P2 + XXH_P4
        more = np.flatnonzero(left > 8)
        if not len(more):
            return mix64(h)
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8


def word_hashes(words: Words) -> np.ndarray:
    if not len(words):
        return np.zeros(0, np.uint64)
    return hash_ranges(words.texts.buf, words.start, words.end)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` hashes (runs may cross texts; callers mask those)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * XXH_P1 + h[k : k + n]
    return mix64(out)


def window_mask(words: Words, width: int) -> np.ndarray:
    """Whether the run of ``width`` words from each place stays in one text."""
    n = max(len(words) - width + 1, 0)
    ok = np.ones(n, dtype=bool)
    for e in np.unique(words.first[1:-1]):
        ok[max(e - width + 1, 0) : e] = False
    return ok


def joined(words: Words, keep: np.ndarray | None = None) -> Texts:
    """Texts of the (kept) words, with one space between."""
    buf, start, end, counts = words.texts.buf, words.start, words.end, words.counts
    if keep is not None:
        at = np.concatenate([[0], np.cumsum(keep)])
        counts = np.diff(at[words.first])
        start, end = start[keep], end[keep]
    size = end - start
    first = np.concatenate([[0], np.cumsum(counts)])
    glued = size + 1
    to = np.concatenate([[0], np.cumsum(glued)])
    docs_with = counts > 0
    # every word takes its bytes and one space, but for the last of a text
    last = np.zeros(len(start), dtype=np.int64)
    last[first[1:][docs_with] - 1] = 1
    to = to - np.concatenate([[0], np.cumsum(last)])
    out = np.full(int(to[-1]) + PAD, 32, dtype=np.uint8)
    out[int(to[-1]) :] = 0
    if len(start):
        lead = np.repeat(start - to[:-1], size)
        into = np.arange(int(size.sum())) + np.repeat(to[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        out[into] = buf[into + lead]
    return Texts(out, to[first])


def xxh64_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range of a padded buffer: ranges of one length at a time."""
    size = end - start
    out = np.empty(len(start), dtype=np.uint64)
    if not len(start):
        return out
    order = np.argsort(size, kind="stable")
    lens, begin = np.unique(size[order], return_index=True)
    l8, l4 = lanes_view(buf, 8), lanes_view(buf, 4)
    for length, a, b in zip(lens.tolist(), begin, [*begin[1:], len(order)], strict=True):
        rows = order[a:b]
        if b - a < 8 and length > 64:
            import xxhash

            for r in rows:
                out[r] = xxhash.xxh64_intdigest(buf[start[r] : end[r]].tobytes(), seed)
            continue
        at, left = start[rows], length
        if length >= 32:
            s = np.uint64(seed)
            with np.errstate(over="ignore"):
                init = [s + XXH_P1 + XXH_P2, s + XXH_P2, s, s - XXH_P1]
            v = [np.full(len(rows), x, dtype=np.uint64) for x in init]
            while left >= 32:
                for k in range(4):
                    v[k] = rotl(v[k] + l8[at + 8 * k] * XXH_P2, 31) * XXH_P1
                at, left = at + 32, left - 32
            h = rotl(v[0], 1) + rotl(v[1], 7) + rotl(v[2], 12) + rotl(v[3], 18)
            for k in range(4):
                h = (h ^ (rotl(v[k] * XXH_P2, 31) * XXH_P1)) * XXH_P1 + XXH_P4
        else:
            h = np.full(len(rows), (seed + int(XXH_P5)) & ((1 << 64) - 1), dtype=np.uint64)
        h = h + np.uint64(length)
        while left >= 8:
            h = rotl(h ^ (rotl(l8[at] * XXH_P2, 31) * XXH_P1), 27) * XXH_P1 + XXH_P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = rotl(h ^ (l4[at].astype(np.uint64) * XXH_P1), 23) * XXH_P2 + XXH_P3
            at, left = at + 4, left - 4
        while left:
            h = rotl(h ^ (buf[at].astype(np.uint64) * XXH_P5), 11) * XXH_P1
            at, left = at + 1, left - 1
        h = (h ^ (h >> np.uint64(33))) * XXH_P2
        h = (h ^ (h >> np.uint64(29))) * XXH_P3
        out[rows] = h ^ (h >> np.uint64(32))
    return out


def pack(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values, dtype=kind).tobytes()


def unpack(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(blob, dtype=kind)
