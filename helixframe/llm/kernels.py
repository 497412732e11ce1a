"""Vectorised text kernels shared by the operators: code points, rolling hashes, window minima, min-wise values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd multiplier of the polynomial


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def concat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offsets (one more than texts)."""
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    off = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lens, out=off[1:])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, off


def chunks(texts: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together (more if a single text is longer): bounds the arrays."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= most:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def pieces(texts: list[str], size: int, overlap: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts longer than size cut into pieces that overlap, so that every window of overlap + 1 lies in one of them: the
    pieces, the text each comes from, and where in it each begins."""
    out, row, at = [], [], []
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - overlap), size - overlap) if len(t) > size else (0,):
            out.append(t[lo : lo + size])
            row.append(i)
            at.append(lo)
    return out, np.array(row, dtype=np.int64), np.array(at, dtype=np.int64)


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hash of every window of k code points: sum c[i+j] * B^(k-1-j) mod 2^64, finalised.

    Windows are built by doubling, so the cost is log k passes. Result has len(codes) - k + 1 values."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U)
    power, width, bit = mix(codes.astype(U) + U(1)), 1, BASE  # power[i]: hash of the window of `width` at i
    out, have = None, 0
    left = k
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                out = power if out is None else out[: len(codes) - have - width + 1] * bit + power[have : have + len(codes) - have - width + 1]
                have += width
            left >>= 1
            if left:
                m = len(codes) - 2 * width + 1
                power = power[:m] * bit + power[width : width + m]
                bit = bit * bit
                width *= 2
    return mix(out[:n])


def sliding(v: np.ndarray, w: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over every w consecutive values; len(v) - w + 1 results."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    width = 1
    while width * 2 <= w:
        v = op(v[: len(v) - width], v[width:])
        width *= 2
    return op(v[:n], v[w - width : w - width + n])


def inside(off: np.ndarray, k: int) -> np.ndarray:
    """For every position of the concatenation that starts a window of k: does the window end in the same text?"""
    total = int(off[-1])
    n = max(0, total - k + 1)
    ok = np.ones(n, dtype=bool)
    for e in off[1:-1]:
        ok[max(0, e - k + 1) : min(n, e)] = False
    return ok


def anchors(codes: np.ndarray, off: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: of every window of n code points inside one text, the k-windows with the least hash.

    The choice depends on the window's content alone (all ties are taken), so texts that share n code points share an
    anchor at the same place in them. Returns positions in the concatenation and their hashes."""
    h = rolling(codes, k)
    if len(codes) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    least = sliding(h, n - k + 1, np.minimum)
    ok = inside(off, n)
    most = np.where(ok, least, U(0))
    # position p is taken if some valid window that contains it has h[p] as its minimum, that is its largest minimum
    w = n - k + 1
    padded = np.concatenate([np.zeros(w - 1, dtype=U), most, np.zeros(w - 1, dtype=U)])
    at = np.flatnonzero((sliding(padded, w, np.maximum)[: len(h)] == h) & (h > 0))
    return at, h[at]


def minima(elements: np.ndarray, off: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """min-wise values: for each segment (none may be empty) and each seed pair, the least (x ^ b) * a mod 2^32."""
    x = mix(elements.astype(U)).astype(np.uint32)
    out = np.empty((len(off) - 1, len(seeds)), dtype=np.uint32)
    starts = off[:-1]
    with np.errstate(over="ignore"):
        for j, (a, b) in enumerate(seeds):
            out[:, j] = np.minimum.reduceat((x ^ b) * a, starts)
    return out


def seeds(m: int, salt: int) -> np.ndarray:
    r = np.random.default_rng(salt)
    s = r.integers(0, 2**32, size=(m, 2), dtype=np.uint64).astype(np.uint32)
    s[:, 0] |= np.uint32(1)
    return s


def hash_rows(m: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hash of every row of a matrix of unsigned integers."""
    h = np.full(m.shape[0], salt + 1, dtype=U)
    with np.errstate(over="ignore"):
        for j in range(m.shape[1]):
            h = mix(h * BASE + m[:, j].astype(U))
    return h


def obj(values: list) -> pd.Series:
    """A column of Python objects (strings, lists), also where it is empty."""
    return pd.Series(values, dtype=object)
