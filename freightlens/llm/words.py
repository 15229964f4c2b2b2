"""Vectorised words, word hashes and shingles over Arrow text columns.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
A word's hash is a polynomial over random byte codes, taken from running sums, so a
whole slice of texts is hashed by a few numpy passes; the hash of a word does not
depend on where it stands.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SLICE_BYTES = 1 << 18
#: Words as the operators define them, for Spark and DuckDB regular expressions.
WORD = r"[^\x20\x09-\x0D]+"

_rng = np.random.default_rng(20240229)
CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
CODES[65:91] = CODES[97:123]
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: All ASCII but letters and digits: for words without their punctuation.
MARKS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base^0 .. base^(n - 1); short ones are kept by the worker."""
    kept = worker_state().setdefault("powers", {})
    found = kept.get(int(base))
    if found is None or len(found) < n:
        found = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        found[0] = 1
        found = np.multiply.accumulate(found)
        if len(found) <= 4 * SLICE_BYTES:
            kept[int(base)] = found
    return found[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and each row's offsets; null counts as empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE_BYTES):
    """Cut a batch into runs of rows of about ``size`` bytes: (first row, bytes, offsets)."""
    raw, offsets = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    pa.default_memory_pool().release_unused()


def _pieces(raw: np.ndarray, size: int):
    """Cut one long buffer at spaces into pieces of about ``size`` bytes."""
    lo, n = 0, len(raw)
    while n - lo > 2 * size:
        ends = np.flatnonzero(SPACES[raw[lo + size : lo + 2 * size]])
        hi = lo + size + int(ends[0]) if len(ends) else n
        yield lo, hi
        lo = hi
    yield lo, n


class Words:
    """Words of some texts: per text the index of its first word, per word its place and hashes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, prefix: int = 0, spaces: np.ndarray = SPACES):
        found = [self._scan(raw[lo:hi], offsets - lo, prefix, lo, spaces) for lo, hi in _pieces(raw, SLICE_BYTES)]
        self.start, self.end, self.hash, self.stem = (np.concatenate(x) for x in zip(*found))
        self.first = np.searchsorted(self.start, offsets, "left")

    @staticmethod
    def _scan(raw, offsets, prefix, lo, spaces):
        n = len(raw)
        if not n:
            empty = np.zeros(0, np.int64)
            return empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        solid = ~spaces[raw]
        before = np.empty(n, bool)
        before[0], before[1:] = False, solid[:-1]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts] = False
        start = np.flatnonzero(solid & ~before)
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, solid[1:]
        after[cuts - 1] = False
        end = np.flatnonzero(solid & ~after) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(CODES[raw] * powers(BASE, n), out=sums[1:])
        back = powers(INVERSE, n)[start]
        whole = mix((sums[end] - sums[start]) * back)
        stem = mix((sums[np.minimum(start + prefix, end)] - sums[start]) * back) if prefix else whole[:0]
        if not prefix:
            stem = whole
        return start + lo, end + lo, whole, stem


def shingles(first: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-word shingles; a text of fewer words is one shingle, an empty one has none."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(count)])
    if not starts[-1]:
        return starts, np.zeros(0, np.uint64)
    at = np.arange(starts[-1]) - np.repeat(starts[:-1] - first[:-1], count)
    left = np.repeat(first[1:], count) - at
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = left > j
        word = hashes[np.where(inside, at + j, at)]
        out = np.where(inside, out * STEP + word, out)
    return starts, mix(out * STEP + np.minimum(left, k).astype(np.uint64))


def sets(first: np.ndarray, hashes: np.ndarray, k: int):
    """Each text's sorted distinct shingle hashes."""
    starts, values = shingles(first, hashes, k)
    for a, b in zip(starts[:-1], starts[1:]):
        yield np.unique(values[a:b])


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list column of numpy arrays."""
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat, type=kind))


def worker_state() -> dict:
    """What a Python worker keeps from one task to the next."""
    return sys.__dict__.setdefault("_llm_worker_state", {})
