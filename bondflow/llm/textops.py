"""Vectorised word handling over Arrow string columns.

Words are found and hashed on the UTF-8 bytes of whole batches with numpy, so no
Python string is made per word. Memory is bounded by the block size, or by the
longest single text where that is longer.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 18


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back to the system when a task ends: workers live on and serve others."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return wrapped


def word_bytes(*separators: tuple[int, int]) -> np.ndarray:
    """Table of 256 booleans: which bytes belong to words, given inclusive separator ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in separators:
        table[low : high + 1] = False
    return table


#: `[^\x20\x09-\x0D]+`
NOT_SPACE = word_bytes((0x20, 0x20), (0x09, 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became lower case
ALNUM = word_bytes((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs on every machine."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """The first n of a fixed sequence of odd 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 40)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


#: Masks of the first 0 to 8 bytes of a little-endian word
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def raw(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = pc.fill_null(column, empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `most` bytes: first row, end row, bytes, offsets."""
    data, at = raw(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(at, at[first] + most, side="right")) - 1)
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


class Words:
    """The words of a block of texts: hashes, byte places, and each text's range of words."""

    def __init__(self, data: np.ndarray, at: np.ndarray, table: np.ndarray, lower: bool = True):
        n = len(data)
        text = data.tobytes()  # bytes.translate is several times as fast as an indexed table
        if lower:
            text = text.translate(LOWER)
        self.data = np.frombuffer(text + bytes(8), np.uint8)
        keep = np.frombuffer(text.translate(table.tobytes()), bool)
        edges = np.flatnonzero(keep[1:] != keep[:-1]) + 1
        lead = int(n and keep[0])
        start, end = edges[lead::2], edges[1 - lead :: 2]
        if lead:
            start = np.concatenate([[0], start])
        if n and keep[-1]:
            end = np.concatenate([end, [n]])
        cut = at[(at > 0) & (at < n)]
        cut = np.unique(cut[keep[cut] & keep[cut - 1]])
        if len(cut):  # two texts meet inside what looks like one word
            start = np.insert(start, np.searchsorted(start, cut), cut)
            end = np.insert(end, np.searchsorted(end, cut), cut)
        self.start, self.end = start, end
        self.at = np.searchsorted(start, at)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, taken eight at a time."""
        lens = self.end - self.start
        eights = np.ndarray((len(self.data) - 7,), np.uint64, self.data, strides=(1,))
        out = eights[self.start] & _FIRST[np.minimum(lens, 8)]
        out = mix(out + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        more, at = np.flatnonzero(lens > 8), 8
        while len(more):
            part = eights[self.start[more] + at] & _FIRST[np.minimum(lens[more] - at, 8)]
            out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + part)
            at += 8
            more = more[lens[more] > at]
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.at)


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes; length max(0, len - n + 1)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = words[:m].copy()
    for i in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i : i + m]
    return mix(out ^ np.uint64(n))


def spans(at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text with word range at[i]:at[i+1]: its places where n words start, flat, and their ranges."""
    lens = np.maximum(np.diff(at) - n + 1, 0)
    ends = np.cumsum(lens)
    flat = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens, lens) + np.repeat(at[:-1], lens)
    return flat, np.concatenate([[0], ends])
