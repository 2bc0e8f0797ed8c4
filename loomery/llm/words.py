"""Words of texts as arrays of 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text split into words at once, for one batch or one long text.
SLICE = 4 << 20

SPACES = re.compile(rb"[\x09-\x0d\x20]")


def slices(data: bytes, size: int | None = None) -> Iterator[bytes]:
    """``data`` cut at white space into parts of about ``size`` bytes."""
    size, at = size or SLICE, 0
    while at < len(data):
        end = at + size
        if end < len(data):
            gap = SPACES.search(data, end)
            end = gap.start() if gap else len(data)
        yield data[at:end]
        at = end


def hash_words(data: bytes) -> np.ndarray:
    """XXH64 of each word; words are runs of bytes other than 0x20 and 0x09 to 0x0D."""
    parts = []
    for part in slices(data):
        words = part.split()
        parts.append(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(h: np.ndarray, n: int, factor: int) -> np.ndarray:
    """A hash of h[i:i+n] for each i; two factors give independent hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out, by = h[:m].copy(), np.uint64(factor)
    for k in range(1, n):
        out *= by
        out += h[k : k + m]
    return mix(out)


#: Odd factors of run_hashes.
FACTOR_A, FACTOR_B = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def binary(column: pa.Array) -> Iterator[bytes]:
    """The values of a binary column; nulls are empty."""
    for value in column:
        yield value.as_py() or b""


def groups(column: pa.Array, size: int | None = None) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts): rows in runs of about ``size`` bytes; nulls are empty."""
    size, first, held, total = size or SLICE, 0, [], 0
    for row, value in enumerate(binary(column)):
        held.append(value)
        total += len(value)
        if total >= size:
            yield first, held
            first, held, total = row + 1, [], 0
    if held:
        yield first, held
