"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19  # bytes of text worked on at once; a longer text is a chunk of its own

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_table: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > CHUNK_BYTES * 2:
        return _powers(_BASE, n), _powers(_INVERSE, n)
    if len(_table[0]) < n:
        _table[:] = [_powers(_BASE, n), _powers(_INVERSE, n)]
    return _table[0], _table[1]


@dataclass
class Words:
    """Words of consecutive texts: byte spans, the text each is of, and 64-bit hashes."""

    data: np.ndarray  # bytes of the texts
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray  # number of a word's text, in the chunk
    hashes: np.ndarray
    first: np.ndarray  # for each text its first word, and the number of all words last
    row: int  # number of the chunk's first text in the batch

    @property
    def n_docs(self) -> int:
        return len(self.first) - 1

    def windows(self, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of `size` words, and whether a run lies in one text."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        weights = mix(np.arange(1, size + 1, dtype=np.uint64) + _U(1000 * seed)) | _U(1)
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out += self.hashes[j : j + n] * weights[j]
        return mix(out), self.doc[:n] == self.doc[size - 1 :]


def cut_words(data: np.ndarray, offsets: np.ndarray, row: int, lower: bool) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    word = ~_SPACE[data]
    head = np.zeros(n + 1, bool)
    head[offsets] = True  # a text's first byte parts it from the text before
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | head[:n]))
    ends = np.flatnonzero(np.append(before, word[-1:]) & (head | ~np.append(word, False))) if n else starts
    powers, inverse = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * powers[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts]) if len(starts) else np.zeros(0, np.uint64)
    first = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, starts, ends, doc, hashes, first, row)


def text_words(texts: pa.Array, lower: bool = False, chunk: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a string column, chunk by chunk; null texts have none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if len(texts) == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + chunk, "right")) - 1)
        stop = min(stop, len(texts))
        a, b = offsets[row], offsets[stop]
        yield cut_words(data[a:b], offsets[row : stop + 1] - a, row, lower)
        row = stop
