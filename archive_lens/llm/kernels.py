"""Vectorised text kernels shared by the operators: words of UTF-8 buffers, their 64-bit hashes, and packing."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
STEP = 1 << 19
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything that is no ASCII letter or digit and no part of a longer character.
_MARK = np.ones(256, bool)
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a bijection)."""
    x = (x ^ (x >> U(30))) * C2
    x = (x ^ (x >> U(27))) * C3
    return x ^ (x >> U(31))


def lower_ascii(text: str) -> str:
    return text.translate(_LOWER_MAP)


_LOWER_MAP = {c: c + 32 for c in range(65, 91)}


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def steps(data: np.ndarray, offs: np.ndarray, limit: int = STEP):
    """(first, last, bytes, offsets) of runs of whole documents of about limit bytes."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of some documents: start and end byte, document, hash; first[d] is the index of document d's first word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False, bare: bool = False):
        """lower: A-Z count as a-z; bare: marks and symbols part words as white space does."""
        if lower:
            data = _LOWER[data]
        n = len(data)
        inside = ~(_MARK if bare else _SPACE)[data]
        before = np.empty(n, bool)
        before[1:] = inside[:-1]
        cuts = offs[:-1][offs[:-1] < n]
        before[:1] = False
        before[cuts] = False
        self.data = data
        self.start = np.flatnonzero(inside & ~before)
        nxt = np.zeros(n, bool)
        nxt[:-1] = inside[1:]
        ends = offs[1:] - 1
        nxt[ends[(ends >= 0) & (ends < n)]] = False
        self.end = np.flatnonzero(inside & ~nxt) + 1
        self.doc = np.searchsorted(offs, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offs)
        lens = self.end - self.start
        if len(lens):
            at = np.cumsum(lens) - lens
            x = data[inside].astype(U)
            x |= (np.arange(len(x)) - np.repeat(at, lens)).astype(U) << U(8)
            x += U(1)
            x *= C1
            x ^= x >> U(32)
            x *= C2
            x ^= x >> U(29)
            self.hash = mix(np.add.reduceat(x, at) + lens.astype(U) * C3)
        else:
            self.hash = np.zeros(0, U)

    def __len__(self) -> int:
        return len(self.start)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    out = np.ones(max(n, 1), U)
    out[1:] = U(base)
    return np.multiply.accumulate(out)[:n]


BASE = 0x2545F4914F6CDD1D
INVERSE = pow(BASE, -1, 1 << 64)


def gram_hashes(h: np.ndarray, w: int) -> np.ndarray:
    """Hash of each w consecutive elements, at all len(h)-w+1 places (document ends are not looked at)."""
    n = len(h)
    if n < w:
        return np.zeros(0, U)
    s = np.zeros(n + 1, U)
    np.cumsum(h * powers(BASE, n), out=s[1:])
    return mix((s[w:] - s[:-w]) * powers(INVERSE, n - w + 1))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
