"""Words of UTF-8 texts as NumPy arrays: byte bounds and 64-bit hashes, found without a Python loop over words.

A 256-entry table first turns every separator byte into a space and A-Z into a-z. All bytes of a non-ASCII
character are word bytes, so bounds never cut a character, and they hold for the original text too, because the
table keeps every byte in its place. Long texts are worked off in pieces cut at separators: memory is bounded by
the piece, or by the longest single word.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 17
_RANDOM = np.random.default_rng(20240229)
_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def byte_table(separators: Iterable[int]) -> bytes:
    """For ``bytes.translate``: separators become spaces, A-Z becomes a-z, all else stays."""
    table = bytearray(range(256))
    table[0x41:0x5B] = bytes(range(0x61, 0x7B))
    for b in separators:
        table[b] = 0x20
    return bytes(table)


#: words of ASCII letters, digits and all non-ASCII characters
ALNUM = byte_table([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: words of everything but ASCII white space
SPACED = byte_table([0x20, *range(0x09, 0x0E)])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        room = max(PIECE, n)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(room, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1]


def _piece(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = b != 0x20
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(b))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUES[b] * up, out=sums[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((sums[ends] - sums[starts]) * down[starts] + lengths * np.uint64(0xC2B2AE3D27D4EB4F)), starts, ends


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and end bytes (exclusive) of the words of a text that went through a byte table."""
    view, n = np.frombuffer(data, np.uint8), len(data)
    if n <= PIECE:
        return _piece(view)
    found, at = [], 0
    while at < n:
        end = min(n, at + PIECE)
        if end < n:
            cut = data.rfind(b" ", at + 1, end)
            if cut < 0:
                cut = data.find(b" ", end)
            end = cut if cut > 0 else n
        h, s, e = _piece(view[at:end])
        found.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every ``k`` consecutive words."""
    m = len(h) - k + 1
    if m <= 0:
        return h[:0]
    out = h[:m].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[j:m + j]
    return mix(out)


def texts(column) -> Iterator[bytes | None]:
    """UTF-8 bytes of an Arrow string column, None for null."""
    for value in column:
        yield value.as_buffer().to_pybytes() if value.is_valid else None
