"""Rolling hashes over byte buffers and word boundaries, by whole numpy arrays.

Hashes nominate candidates; where an operator lets two of them, 128 bits, decide that strings are equal
without a look at the bytes, it says so.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest so far is kept for a process."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which :func:`spans` takes the hash of any span."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=out[1:])
    return out


def spans(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans; equal bytes give equal hashes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(_INVERSE, len(prefix))[starts])


def every(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all spans of ``size`` bytes, one per start."""
    count = max(0, len(prefix) - size)
    return mix((prefix[size:] - prefix[:count]) * powers(_INVERSE, len(prefix))[:count])


def slices(lengths: np.ndarray, limit: int):
    """``(first, last)`` runs of rows whose lengths sum to about ``limit``; a longer row comes alone."""
    first, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and held + n > limit:
            yield first, i
            first, held = i, 0
        held += n
    if len(lengths) > first:
        yield first, len(lengths)


def buffer_of(column):
    """The bytes of an Arrow binary column and the offsets of its rows (null rows are empty)."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    return data, offsets


#: Bytes of words, after A-Z became a-z: 0-9, a-z and all bytes of characters beyond ASCII.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lowered bytes; no word crosses a cut."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = WORD[data]
    begins = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    at = cuts[(cuts > 0) & (cuts < len(data))]
    begins[at] = inside[1:-1][at]
    closes[at - 1] = inside[1:-1][at - 1]
    return np.flatnonzero(begins), np.flatnonzero(closes) + 1
