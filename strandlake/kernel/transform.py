"""Inverse transforms of whole blocks; each pass works on all rows or columns at once."""

from __future__ import annotations

import math

import numpy as np

from strandlake.kernel import spec

#: 2^14 cos(k pi / 64).
_COS = [math.floor(16384 * math.cos(k * math.pi / 64) + 0.5) for k in range(33)]
#: 2^14 * 2 sqrt(2) / 3 * sin(k pi / 9).
SINES = [0, *(math.floor(16384 * 2 * math.sqrt(2) / 3 * math.sin(k * math.pi / 9) + 0.5) for k in range(1, 5))]


def cosine(angle: int) -> int:
    angle %= 128
    if angle > 64:
        angle = 128 - angle
    return _COS[angle] if angle <= 32 else -_COS[64 - angle]


def sine(angle: int) -> int:
    return cosine(angle - 32)


def _rounded(x: np.ndarray) -> np.ndarray:
    return (x + (1 << 13)) >> 14


def _reversed_bits(x: int, n: int) -> int:
    return int(f"{x:0{n}b}"[::-1], 2)


def _turn(a: np.ndarray, b: np.ndarray, angle: int) -> tuple[np.ndarray, np.ndarray]:
    """Both parts of a rotation, not rounded."""
    c, s = cosine(angle), sine(angle)
    return a * c - b * s, a * s + b * c


class _Lanes(list):
    """Values of a butterfly network: one array per line."""

    def turn(self, a: int, b: int, angle: int, swap: bool = False) -> None:
        x, y = (_rounded(v) for v in _turn(self[a], self[b], angle))
        self[a], self[b] = (y, x) if swap else (x, y)

    def cross(self, a: int, b: int, swap: bool = False) -> None:
        a, b = (b, a) if swap else (a, b)
        self[a], self[b] = self[a] + self[b], self[a] - self[b]


def _dct(t: _Lanes, n: int) -> None:
    """The network of 2^n lines in bit-reversed order; the first half is the network of 2^(n-1)."""
    full, half, quarter = 1 << n, 1 << (n - 1), 1 << (n - 2)
    if n == 2:
        t.turn(0, 1, 16, True)
    else:
        _dct(t, n - 1)
    for i in range(quarter):
        t.turn(half + i, full - 1 - i, 32 - _reversed_bits(half + i, 5))
    if n >= 3:
        for i in range(quarter):
            t.cross(half + 2 * i, half + 2 * i + 1, bool(i & 1))
    if n == 5:
        for i in range(2):
            for j in range(2):
                t.turn(30 - 8 * j - 4 * i, 17 + 8 * j + 4 * i, 28 - 16 * i + 56 * j, True)
        for i in range(2):
            for j in range(4):
                t.cross(16 + 4 * j + i, 19 + 4 * j - i, bool(j & 1))
    if n >= 4:
        for i in range(2 if n == 5 else 1):
            for j in range(2):
                t.turn(full - n + 2 - i - quarter * j, half + n - 3 + i + quarter * j, 24 + 48 * j, True)
        for j in range(2):
            for i in range(2 * n - 6):
                t.cross(half + quarter * j + i, half + quarter - 1 + quarter * j - i, bool(j))
    if n >= 3:
        for i in range(quarter // 2):
            t.turn(full - quarter // 2 - 1 - i, half + quarter // 2 + i, 16, True)
    for i in range(half):
        t.cross(i, full - 1 - i)


def _inverse_dct(rows: list[np.ndarray], n: int) -> list[np.ndarray]:
    t = _Lanes(rows[_reversed_bits(i, n)] for i in range(1 << n))
    _dct(t, n)
    return t


def _inverse_adst4(t: list[np.ndarray]) -> list[np.ndarray]:
    a, b, c, d = t
    x = SINES[1] * a + SINES[4] * c + SINES[2] * d
    y = SINES[2] * a - SINES[1] * c - SINES[4] * d
    z, w = SINES[3] * (a - c + d), SINES[3] * b
    return [_rounded(v) for v in (x + w, y + w, z, x + y - w)]


def _inverse_adst(rows: list[np.ndarray], n: int) -> list[np.ndarray]:
    """8 or 16 lines: input order, rounds of unrounded rotations whose sums are rounded, output order, signs."""
    if n == 2:
        return _inverse_adst4(rows)
    full, half = 1 << n, 1 << (n - 1)
    t = _Lanes(rows[full - 1 - i] if i % 2 == 0 else rows[i - 1] for i in range(full))
    s: dict[int, np.ndarray] = {}

    def turned(a: int, b: int, angle: int) -> None:
        s[b], s[a] = _turn(t[a], t[b], angle)

    def summed(a: int, b: int) -> None:
        t[a], t[b] = _rounded(s[a] + s[b]), _rounded(s[a] - s[b])

    for i in range(half):
        turned(2 * i, 2 * i + 1, (30 - 8 * i) if n == 3 else 31 - 4 * i)
    for i in range(half):
        summed(i, half + i)
    if n == 4:
        for i in range(4):
            turned(8 + 2 * i, 9 + 2 * i, 28 - 16 * i)
        for i in range(4):
            summed(8 + i, 12 + i)
        for i in range(4):
            t.cross(i, 4 + i)
    groups = range(0, full, 8)
    for g in groups:
        for j in range(2):
            turned(g + 4 + 3 * j, g + 5 + j, 24 - 16 * j)
    for g in groups:
        for i in range(2):
            summed(g + 4 + i, g + 6 + i)
            t.cross(g + i, g + 2 + i)
    for i, g in enumerate(groups):
        for j in range(2):
            if n == 3:
                t.turn(2 + 4 * j, 3 + 4 * j, 16, True)
            else:
                t.turn(g + 2 + 4 * j, g + 3 + 4 * j, 48 + 64 * (i ^ j))

    def source(k: int) -> int:
        bits = [k >> (n - 1 - i) & 1 for i in range(n)]
        return sum((bits[n - 1 - i] ^ (bits[n - 2 - i] if n - 2 - i >= 0 else 0)) << (n - 1 - i) for i in range(n))

    out = [t[source(k)] for k in range(full)]
    for k in range(1, 8, 2) if n == 3 else (1, 3, 13, 15):
        out[k] = -out[k]
    return out


def _inverse_walsh(t: list[np.ndarray], shift: int) -> list[np.ndarray]:
    a, c, d, b = (v >> shift for v in t)
    a, d = a + c, d - b
    e = (a - d) >> 1
    b, c = e - b, e - c
    return [a - b, b, c, d + c]


def inverse(blocks: np.ndarray, tx: int, kind: int, lossless: bool) -> np.ndarray:
    """Residual samples of squares of dequantized coefficients (int64; any number of them in the leading axes)."""
    n = tx + 2
    for axis in (-1, -2):
        lines = [blocks.take(i, axis) for i in range(1 << n)]
        if lossless:
            lines = _inverse_walsh(lines, 2 if axis == -1 else 0)
        elif kind in ((spec.DCT_ADST, spec.ADST_ADST) if axis == -1 else (spec.ADST_DCT, spec.ADST_ADST)):
            lines = _inverse_adst(lines, n)
        else:
            lines = _inverse_dct(lines, n)
        blocks = np.stack(lines, axis)
    shift = min(n + 2, 6)
    return blocks if lossless else (blocks + (1 << (shift - 1))) >> shift


def inverse_first(value: int, tx: int) -> int:
    """The residual sample that all of a square has whose only coefficient is the first (cosine transforms, not lossless)."""
    for _ in range(2):
        value = (value * _COS[16] + (1 << 13)) >> 14
    shift = min(tx + 4, 6)
    return (value + (1 << (shift - 1))) >> shift
