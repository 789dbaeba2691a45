"""Numpy kernels over Arrow string columns: words, hashes and n-grams of many texts at once.

A column's texts are one flat byte array with offsets; no per-character Python runs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text handled at once; the arrays of a slice take some 60 times as much.
SLICE_BYTES = 1 << 19


def slices(ids, texts, limit: int = SLICE_BYTES):
    """(ids, texts) in runs of at most `limit` bytes; a longer text is a run of its own."""
    sizes = np.array([0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()], np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield ids.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def flat(texts) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each (null as empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pa.compute.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE ** (0 .. n - 1) modulo 2 ** 64, or the inverses."""
    table = _POWERS[inverse]
    if len(table) < n:
        with np.errstate(over="ignore"):
            table = np.full(max(n, 1 << 16), INVERSE if inverse else BASE, U64)
            table[0] = 1
            table = np.multiply.accumulate(table)
        _POWERS[inverse] = table
    return table[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running sum over the data."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * powers(len(data)), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * powers(len(data) + 1, inverse=True)[starts]
        return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text index of the runs of bytes other than white space."""
    letter = ~spaces(data)
    before = np.zeros(len(data), bool)
    before[1:] = letter[:-1]
    first = offsets[:-1][offsets[:-1] < len(data)]
    before[first] = False
    starts = np.flatnonzero(letter & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = letter[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(letter & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def text_of(texts) -> list[str]:
    return ["" if t is None else t for t in texts.to_pylist()]
