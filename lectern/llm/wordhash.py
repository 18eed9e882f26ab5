"""Word hashes of texts, computed for many texts at once with numpy.

Words are runs of bytes other than space and 0x09-0x0D; a word's hash takes in its length and then eight bytes
at a time, each time through a bijection that spreads every bit, and that of a word over 256 bytes is xxh3's. Equal
words have equal hashes everywhere; words of equal length up to eight bytes never share one.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_rng = np.random.default_rng(20240607)
#: One random 64-bit number a byte; the odd base of the polynomial and its inverse modulo 2**64.
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.int64).view(np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
GAP = np.zeros(256, bool)
GAP[[0x20, *range(0x09, 0x0E)]] = True


class Powers:
    """Powers of BASE and of its inverse, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            with np.errstate(over="ignore"):
                self.up = np.concatenate([[np.uint64(1)], np.full(size - 1, BASE)]).cumprod(dtype=np.uint64)
                self.down = np.concatenate([[np.uint64(1)], np.full(size - 1, INVERSE)]).cumprod(dtype=np.uint64)
        return self.up, self.down


POWERS = Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: Masks that keep the first bytes of eight; bytes from which a span is hashed alone.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG = 256


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hash of the bytes in each [start, end): its length, then eight bytes at a time, mixed in by turns."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    size = end - start
    out = mix(size.astype(np.uint64) + BASE)
    own = np.flatnonzero((size > 0) & (size <= LONG))
    done = 0
    while len(own):
        out[own] = mix(out[own] ^ (eight[start[own] + done] & FIRST[np.minimum(size[own] - done, 8)]))
        done += 8
        own = own[size[own] > done]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = xxh3_64_intdigest(raw[start[i] : end[i]].tobytes())
    return out


def words_of(bodies: list[bytes], gaps: np.ndarray = GAP, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts, in order, and the number of words of each text; ``first``: of so many bytes of each word."""
    raw = np.frombuffer(b"\x20".join(bodies) + b"\x20", np.uint8)
    gap = gaps[raw]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    start, end = edge[::2], edge[1::2]
    if len(end) < len(start):
        end = np.append(end, len(raw))
    if first is not None:
        end = np.minimum(end, start + first)
    ends = np.cumsum([len(b) + 1 for b in bodies])
    counts = np.diff(np.searchsorted(start, ends), prepend=0)
    return span_hash(raw, start, end), counts


def chain(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours in ``hashes``; shorter input has none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        out = hashes[:size].copy()
        for k in range(1, n):
            out = mix(out * BASE + hashes[k : k + size])
    return out
