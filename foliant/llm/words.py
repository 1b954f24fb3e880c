"""Words of texts as 64-bit numbers, for numpy work inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Odd multipliers for combining and mixing 64-bit numbers.
MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xBF58476D1CE4E5B9)
MIX_C = np.uint64(0x94D049BB133111EB)

_one = xxhash.xxh3_64_intdigest


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that changes every bit with any other."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * MIX_C
    return x ^ (x >> np.uint64(31))


def split(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``: exactly what ``bytes.split`` takes as blank."""
    return text.split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_one, words), np.uint64, len(words))


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Numbers of all runs of ``size`` words, by position of their first word."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, size):
        out = mixed(out * MIX_A) + h[j : j + n]
    return mixed(out)


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct shingles, A-Z as a-z; a shorter text is one shingle, no word is none."""
    h = hashes(split(text.lower()))
    if not len(h):
        return h
    return np.unique(grams(h, min(size, len(h))))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that results of few long texts stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
