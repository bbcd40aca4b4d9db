"""Vectorised splitting and hashing of words over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64-bit and take eight bytes of a word at a
time, each mixed into what was before (of words beyond GIANT bytes, each mixed with its place and summed), so no
repetition of bytes makes them cancel. Equal words have equal hashes everywhere; two different words share one by chance
only (one pair in 2^64).
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
GIANT = 4096
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_GRAM = np.uint64(0xD6E8FEB86659FD93)


def give_back() -> None:
    """Hands memory that earlier tasks of this worker process have left back to the system, as far as the platform can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)


def tidy(run):
    """run, a function over batches, handing memory back when it is through: worker processes outlive their tasks."""

    @wraps(run)
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return through


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def gram(h: np.ndarray) -> np.uint64:
    """The hash of a row of words, as Chunk.grams gives it."""
    acc = h[-1:].copy()
    for x in h[-2::-1]:
        acc = acc * _GRAM + x
    return mix(acc)[0]


@dataclass
class Chunk:
    """Some rows of a batch: their bytes and their words. first[i]:first[i + 1] are the words of row i."""

    rows: slice
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[:-8] = LOWER[self.data] if lower else self.data
        at = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))  # the eight bytes from each place on
        size = self.ends - self.starts
        h = mix(size.astype(np.uint64) * _BASE)
        live, spot, left = np.arange(len(size)), self.starts, size
        if (giant := np.flatnonzero(size > GIANT)).size:
            for i in giant:
                whole = np.zeros(-(-size[i] // 8) * 8, np.uint8)
                whole[: size[i]] = data[self.starts[i] : self.ends[i]]
                lanes = whole.view("<u8") * _BASE
                h[i : i + 1] += mix(lanes ^ mix(np.arange(len(lanes), dtype=np.uint64))).sum()
            live = np.flatnonzero(size <= GIANT)
            spot, left = spot[live], left[live]
        while len(live):
            part = at[spot] & _MASKS[np.minimum(left, 8)]
            h[live] = mix(h[live] ^ part * _BASE)
            more = left > 8
            live, spot, left = live[more], spot[more] + 8, left[more] - 8
        return h

    def grams(self, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words from each word on, and whether all n lie in the word's own row."""
        if len(h) < n:
            return np.zeros(len(h), np.uint64), np.zeros(len(h), bool)
        out = np.zeros(len(h), np.uint64)
        acc = h[n - 1 :].copy()
        for j in range(n - 2, -1, -1):
            acc *= _GRAM
            acc += h[j : len(h) - n + 1 + j]
        out[: len(acc)] = mix(acc)
        whole = np.zeros(len(h), bool)
        last = np.repeat(self.first[1:], np.diff(self.first))
        whole[:] = np.arange(len(h)) + n <= last
        return out, whole


def chunks(text: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES, fold: np.ndarray | None = None) -> Iterator[Chunk]:
    """Rows of a string column in pieces of about `most` bytes, never parting a row; nulls count as empty. fold: replaces each byte."""
    pa.default_memory_pool().release_unused()  # of the batches before
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    text = pc.fill_null(text, "" if pa.types.is_string(text.type) or pa.types.is_large_string(text.type) else b"")
    if not len(text):
        return
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    _, at, data = text.buffers()
    at = np.frombuffer(at, np.int64 if wide else np.int32, len(text) + 1, text.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        part = data[at[i] : at[j]]
        yield _chunk(slice(i, j), part if fold is None else fold[part], at[i : j + 1] - at[i])
        i = j


def _chunk(rows: slice, data: np.ndarray, offsets: np.ndarray) -> Chunk:
    word = ~_SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return Chunk(rows, data, starts, ends, np.searchsorted(starts, offsets), offsets)
