"""Vectorised rolling hashes of code-point windows, and winnowing.

A text is an array of code points. Its window hashes come from one cumulative sum modulo 2**64: with powers of an odd
base B, hash(i, k) = (sum of c[j] * B**j for i <= j < i + k) * B**-i, then mixed. Equal windows have equal hashes in
every text; unequal ones collide with probability about 2**-60.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
#: characters worked on at once, so that memory is bounded for texts of any length
CHUNK = 1 << 17


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = (np.full(n, b, dtype=np.uint64) for b in (BASE, inverse))
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@lru_cache(1)
def _char_hash() -> np.ndarray:
    """Mixed values of the code points of the basic plane."""
    return _mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(BASE))


def char_values(cp: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values of the code points, so that low bits of the sums are good too."""
    table = _char_hash()
    if cp.size and int(cp.max()) >= 1 << 16:
        return _mix((cp.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))
    return table[cp]


def window_hashes(cp: np.ndarray, k: int) -> np.ndarray:
    """Hash of every window of k code points (at most CHUNK + k of them at once)."""
    n = cp.size
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = _powers(1 << max(18, (n + 1).bit_length()))
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(char_values(cp) * up[:n], out=sums[1:])
    return _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def span_hashes(cp: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of each span [start, stop) in constant time: equal spans have equal hashes, spans of other lengths others."""
    n = cp.size
    up, down = _powers(1 << max(18, (n + 1).bit_length()))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(char_values(cp) * up[:n], out=sums[1:])
    return _mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every window of w values, in time independent of w (block-wise prefix and suffix minima)."""
    n = a.size
    if n < w:
        return a[:0]
    full = -(-n // w) * w
    padded = np.full(full, np.iinfo(a.dtype).max, dtype=a.dtype)
    padded[:n] = a
    blocks = padded.reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


def sliding_max(a: np.ndarray, w: int) -> np.ndarray:
    return ~sliding_min(~a, w)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after another, each text's start and, at last, the end)."""
    ends = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=ends[1:])
    return code_points("".join(texts)), ends


def winnow(cp: np.ndarray, starts: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the k-windows whose hash is the minimum of some w successive ones of the same text.

    Of equal minima all are taken, so which position is taken depends on those w windows alone: two texts that share
    k + w - 1 code points share a taken window, at the same place of the shared part. cp, starts: as from `joined`;
    worked on in pieces of CHUNK that overlap.
    """
    n, reach = cp.size, k + w - 1
    found, values = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
    for a in range(0, max(n - reach + 1, 0), CHUNK):
        # spans of `reach` that begin in [a, a + CHUNK)
        b = min(n, a + CHUNK + reach - 1)
        h = window_hashes(cp[a:b], k)
        low = sliding_min(h, w)
        begin = np.arange(a, a + low.size)
        text_of_end = np.searchsorted(starts, begin, side="right")
        low[starts[np.minimum(text_of_end, starts.size - 1)] < begin + reach] = 0  # a span over the end of its text
        pad = np.zeros(w - 1, dtype=h.dtype)
        p = np.flatnonzero(sliding_max(np.concatenate([pad, low, pad]), w) == h)
        p = p[h[p] != 0]
        found.append(p + a)
        values.append(h[p])
    p, first = np.unique(np.concatenate(found), return_index=True)
    return p, np.concatenate(values)[first]
