"""Shared text primitives: ASCII lower-casing, word splitting, 64-bit rolling hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: A-Z to a-z, all other bytes as they are. bytes.split() then cuts at 0x20 and 0x09-0x0D alone.
FOLD = bytes.maketrans(UPPER, LOWER)
#: Also every ASCII byte that is neither a letter nor a digit to a space.
ALNUM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in FOLD)

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim.argtypes = [ctypes.c_size_t]
except (OSError, AttributeError):  # not glibc
    _libc = None


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null becomes empty."""
    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in binary.to_pylist()]


def trim() -> None:
    """Give freed memory back: worker processes live on, and an executor has several."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `most` bytes of text (or one row)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, base = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            yield batch.slice(start, stop - start)
            start, base = stop, int(ends[stop - 1])
        trim()


def _constants(seed: int) -> tuple[np.ndarray, int, int]:
    rng = np.random.Generator(np.random.PCG64(seed))
    table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(2**61, 2**62)) * 2 + 1
    return table, base, pow(base, -1, 2**64)


_TABLE, _BASE, _INVERSE = _constants(20240229)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        made = []
        for x in (_BASE, _INVERSE):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.multiply.accumulate(steps))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that low and high bits are alike usable."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the `width`-word shingles of a text.

    A-Z count as a-z; words are runs of anything but 0x20 and 0x09-0x0D. A text of
    fewer words is one shingle; one without words has none. The hash is a polynomial
    over the words joined by single spaces, so it is the same wherever it is computed.
    """
    words = text.translate(FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    line = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _power(len(line) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(line) + 1, np.uint64)
        np.cumsum(_TABLE[line] * up[: len(line)], out=sums[1:])
        gaps = np.flatnonzero(line == 0x20)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.concatenate((gaps, [len(line)]))
        k = min(width, len(words))
        starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
        hashes = (sums[ends] - sums[starts]) * down[starts]
        hashes += (ends - starts).astype(np.uint64)
    return np.unique(mix(hashes))
