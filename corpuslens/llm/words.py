"""Vectorised word helpers over Arrow string columns.

A word is a run of characters other than the ASCII white space ``\\x20`` and
``\\x09-\\x0D``. All helpers work on the UTF-8 bytes of whole texts with numpy;
texts are visited in chunks of bounded size, so memory does not depend on the
size of an Arrow batch (a single very long text is a chunk of its own).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_RNG = np.random.default_rng(0x5EED)
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply), wrapping arithmetic."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, _BASE), dtype=np.uint64)])
    return _POWERS


@dataclass
class Chunk:
    """Consecutive texts ``lo..hi`` of a batch: their bytes and byte offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column (null: empty) into runs of whole texts of about
    ``limit`` bytes; a longer text stands alone."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, buf = texts.buffers()
    offsets = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield Chunk(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a chunk in order: byte range, text number within the chunk,
    and ``first[d] .. first[d + 1]`` as the words of text d."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray


def find_words(c: Chunk, part: np.ndarray | None = None) -> Words:
    """The words of a chunk; ``part`` (a flag for each byte value) says which
    bytes belong to words, all but white space if it is not given."""
    solid = ~_SPACE[c.data] if part is None else part[c.data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    heads = c.offsets[:-1][c.offsets[:-1] < c.offsets[1:]]
    begins[heads] = solid[heads]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    ends[c.offsets[1:][c.offsets[:-1] < c.offsets[1:]] - 1] = solid[c.offsets[1:][c.offsets[:-1] < c.offsets[1:]] - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, c.offsets)
    doc = np.repeat(np.arange(c.hi - c.lo), np.diff(first))
    return Words(start, end, doc, first)


def same_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray,
                other_end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Whether each byte range of ``data`` (not empty) equals that of ``other``."""
    same = end - start == other_end - other_start
    at = np.flatnonzero(same)
    if len(at):
        size = (end - start)[at]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        within = np.arange(int(size.sum())) - np.repeat(begin, size)
        mine = data[within + np.repeat(start[at], size)]
        theirs = other[within + np.repeat(other_start[at], size)]
        same[at] = np.logical_and.reduceat((_LOWER[mine] if lower else mine) == theirs, begin)
    return same


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte range (ranges are disjoint, ascending, not empty)."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    begin = np.concatenate([[0], np.cumsum(size)[:-1]])
    within = np.arange(int(size.sum())) - np.repeat(begin, size)
    picked = data[within + np.repeat(start, size)]
    if lower:
        picked = _LOWER[picked]
    terms = _BYTE_CODE[picked] * _powers(int(size.max()))[within]
    return mix64(np.add.reduceat(terms, begin) + size.astype(np.uint64))
