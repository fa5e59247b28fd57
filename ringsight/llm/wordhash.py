"""Hashes of words and word n-grams over whole Arrow batches, without a Python loop over words.

A word's hash is a polynomial in its bytes modulo 2**64. Prefix sums of the polynomial over the
byte buffer give the hash of every word (or byte range) by two look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 1 << 20  # texts are hashed in slices of about 1 MB; a longer text is one slice

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
# Separators for words of letters and digits only; bytes of other scripts count as letters.
SYMBOLS = np.ones(256, bool)
SYMBOLS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """BASE**i and its inverse for i < n, kept per process; sent to executors without the numbers."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(2 * SLICE_BYTES, 1 << int(n).bit_length())
            up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Row slices with about SLICE_BYTES of text each; null texts become empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        filled = pc.fill_null(batch.column(at), "").cast(pa.large_string())
        batch = batch.set_column(at, text, filled)
        ends = np.cumsum(pc.binary_length(filled).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """The words of a slice of texts: byte ranges, hashes, and the word range of each row."""

    def __init__(self, texts: pa.Array, lower: bool = True, blank: np.ndarray = _BLANK) -> None:
        n = len(texts)
        buffers = texts.buffers()
        edges = np.frombuffer(buffers[1], np.int64, n + 1, texts.offset * 8)
        size = int(edges[-1] - edges[0])
        data = buffers[2]
        self.bytes = (
            np.frombuffer(data, np.uint8, size, int(edges[0])) if data is not None and size else np.empty(0, np.uint8)
        )
        self.row_bytes = edges - edges[0]
        if lower:
            self.bytes = _LOWER[self.bytes]
        inside = ~blank[self.bytes]
        first = np.zeros(size + 1, bool)
        first[self.row_bytes] = True
        begins, closes = inside.copy(), inside.copy()
        if size:
            begins[1:] &= ~inside[:-1] | first[1:size]
            closes[:-1] &= ~inside[1:] | first[1:size]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(closes) + 1
        self.rows = np.searchsorted(self.starts, self.row_bytes)  # word range of row r: rows[r]..rows[r+1]
        self._prefix: np.ndarray | None = None

    def span_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of byte ranges; equal bytes give equal hashes wherever they stand."""
        up, down = _POWERS.upto(len(self.bytes) + 1)
        if self._prefix is None:
            self._prefix = np.zeros(len(self.bytes) + 1, np.uint64)
            np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)], out=self._prefix[1:])
        raw = (self._prefix[ends] - self._prefix[starts]) * down[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    @property
    def hashes(self) -> np.ndarray:
        return self.span_hash(self.starts, self.ends)


ODD = mix(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles in order, and the range of each row.

    A row with fewer words has its whole word sequence as one shingle, a row without words none.
    """
    h = words.hashes
    counts = np.diff(words.rows)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    edges = np.concatenate([[0], np.cumsum(made)])
    rolled = np.zeros(max(len(h) - size + 1, 0), np.uint64)
    for j in range(size):
        rolled += h[j : j + len(rolled)] * ODD[j]
    at = np.arange(edges[-1]) - np.repeat(edges[:-1], made) + np.repeat(words.rows[:-1], made)
    out = np.zeros(edges[-1], np.uint64)
    long = np.repeat(counts >= size, made)
    out[long] = rolled[at[long]]
    for r in np.flatnonzero((counts > 0) & (counts < size)):
        part = h[words.rows[r] : words.rows[r + 1]]
        out[edges[r]] = (part * ODD[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    return mix(out), edges


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lists(values: np.ndarray, edges: np.ndarray, kind: pa.DataType = pa.int64()) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values, kind))
