"""Prediction of samples: from neighbours, and from reference frames."""

from __future__ import annotations

import numpy as np

from strandlake.kernel import spec


def _smooth2(a, b):
    return (a + b + 1) >> 1


def _smooth3(a, b, c):
    return (a + 2 * b + c + 2) >> 2


def _plain(plane: np.ndarray, part: np.ndarray, x: int, y: int, n: int, left: bool, above: bool, mode: int, base: int, top: int) -> bool:
    """Predict part by mode V, H, DC or TM where all neighbours that exist lie inside of the frame; false for other modes."""
    if mode == spec.V:
        part[:] = plane[y - 1, x : x + n] if above else base - 1
    elif mode == spec.H:
        part[:] = plane[y : y + n, x - 1 : x] if left else base + 1
    elif mode == spec.DC:
        total = (int(plane[y - 1, x : x + n].sum()) if above else 0) + (int(plane[y : y + n, x - 1].sum()) if left else 0)
        count = n * (above + left)
        part[:] = (total + (count >> 1)) // count if count else base
    elif mode == spec.TM:
        row = plane[y - 1, x : x + n].astype(np.int32) if above else np.full(n, base - 1, np.int32)
        side = plane[y : y + n, x - 1].astype(np.int32) if left else np.full(n, base + 1, np.int32)
        corner = int(plane[y - 1, x - 1]) if above and left else base + 1 if above else base - 1
        part[:] = np.minimum(np.maximum(row + (side - corner)[:, None], 0), top)
    else:
        return False
    return True


def intra(plane: np.ndarray, x: int, y: int, left: bool, above: bool, more_right: bool, tx: int, mode: int, last_x: int, last_y: int, depth: int) -> None:
    """Predict the square of a transform block at (x, y) in place.

    left, above: whether those neighbours exist; more_right: whether samples above and to
    the right may be read (4x4 blocks only, others repeat the last one).
    """
    n, base = 4 << tx, 1 << (depth - 1)
    part = plane[y : y + n, x : x + n]
    if x + n - 1 <= last_x and y + n - 1 <= last_y and _plain(plane, part, x, y, n, left, above, mode, base, (1 << depth) - 1):
        return
    edge = np.full(2 * n + 1, base - 1, np.int64)  # corner, then above
    if above:
        row = plane[y - 1]
        edge[1 : n + 1] = row[np.minimum(np.arange(x, x + n), last_x)]
        edge[n + 1 :] = row[np.minimum(np.arange(x + n, x + 2 * n), last_x)] if more_right and tx == 0 else edge[n]
        edge[0] = row[min(x - 1, last_x)] if left else base + 1
    side = plane[np.minimum(np.arange(y, y + n), last_y), x - 1].astype(np.int64) if left else np.full(n, base + 1, np.int64)
    top, out = edge[1:], np.empty((n, n), np.int64)
    i, j = np.arange(n)[:, None], np.arange(n)[None, :]

    if mode == spec.DC:
        parts = [p for p, have in ((side, left), (top[:n], above)) if have]
        count = n * len(parts)
        out[:] = (sum(int(p.sum()) for p in parts) + (count >> 1)) // count if parts else base
    elif mode == spec.V:
        out[:] = top[:n]
    elif mode == spec.H:
        out[:] = side[:, None]
    elif mode == spec.TM:
        out = np.minimum(np.maximum(top[None, :n] + side[:, None] - edge[0], 0), (1 << depth) - 1)
    elif mode == spec.D45:
        s = i + j
        reach = np.append(top, top[-1])
        out = np.where(s + 2 < 2 * n, _smooth3(reach[s], reach[s + 1], reach[np.minimum(s + 2, 2 * n)]), top[2 * n - 1])
    elif mode == spec.D63:
        s = i // 2 + j
        out = np.where(i & 1, _smooth3(top[s], top[s + 1], top[s + 2]), _smooth2(top[s], top[s + 1]))
    elif mode == spec.D207:
        # along the left side downwards, its last sample repeated
        reach = np.concatenate([side, np.full(n + 2, side[-1])])
        s = i + j // 2
        out = np.where(j & 1, _smooth3(reach[s], reach[s + 1], reach[s + 2]), _smooth2(reach[s], reach[s + 1]))
    else:
        # from the left side's end over the corner to the end of the row above
        around = np.concatenate([side[::-1], edge[: n + 1]])  # around[n] is the corner
        if mode == spec.D135:
            k = n - i + j
            out = _smooth3(around[k - 1], around[k], around[k + 1])
        elif mode == spec.D117:
            up = j - i // 2  # how far right of the corner, in steps of two rows
            k = n + up
            even, odd = _smooth2(around[np.clip(k, 0, 2 * n)], around[np.clip(k + 1, 0, 2 * n)]), _smooth3(around[np.clip(k - 1, 0, 2 * n)], around[np.clip(k, 0, 2 * n)], around[np.clip(k + 1, 0, 2 * n)])
            down = np.clip(n + 2 * j - i + 1, 1, 2 * n - 1)  # columns that the side feeds
            steep = _smooth3(around[down - 1], around[down], around[down + 1])
            out = np.where(i > 2 * j + 1, steep, np.where(i & 1, odd, even))
        else:  # D153
            over = i - j // 2  # how far below the corner, in steps of two columns
            k = n - over
            even, odd = _smooth2(around[np.clip(k - 1, 0, 2 * n)], around[np.clip(k, 0, 2 * n)]), _smooth3(around[np.clip(k - 1, 0, 2 * n)], around[np.clip(k, 0, 2 * n)], around[np.clip(k + 1, 0, 2 * n)])
            right = np.clip(n - 1 + j - 2 * i, 1, 2 * n - 1)  # columns that the row above feeds
            flat = _smooth3(around[right - 1], around[right], around[right + 1])
            out = np.where(j > 2 * i + 1, flat, np.where(j & 1, odd, even))
    plane[y : y + n, x : x + n] = out


_FILTERS = np.array(spec.FILTERS, np.int64)


def block_from(ref: np.ndarray, x: int, y: int, step_x: int, step_y: int, w: int, h: int, kind: int, depth: int) -> np.ndarray:
    """Interpolate w x h samples of a reference plane from (x, y) on, in sixteenths; edges repeat."""
    top = (1 << depth) - 1
    rows = (((h - 1) * step_y + 15) >> 4) + 8
    ys = np.clip((y >> 4) + np.arange(rows) - 3, 0, ref.shape[0] - 1)
    px = x + step_x * np.arange(w)
    xs = np.clip((px >> 4)[:, None] + np.arange(8)[None] - 3, 0, ref.shape[1] - 1)
    taken = ref[ys].astype(np.int64)[:, xs]
    mid = np.minimum(np.maximum((np.einsum("rwt,wt->rw", taken, _FILTERS[kind][px & 15]) + 64) >> 7, 0), top)
    py = (y & 15) + step_y * np.arange(h)
    out = np.einsum("htw,ht->hw", mid[(py >> 4)[:, None] + np.arange(8)[None]], _FILTERS[kind][py & 15])
    return np.minimum(np.maximum((out + 64) >> 7, 0), top)


def towards_zero(value: int, by: int) -> int:
    """value / by, rounded to the nearest with halves away from zero."""
    return (value + by // 2) // by if value >= 0 else -((-value + by // 2) // by)


def clamped_mv(mv: tuple[int, int], mi_row: int, mi_col: int, size: int, mi_rows: int, mi_cols: int, sx: int, sy: int) -> tuple[int, int]:
    """A vector in sixteenths of a plane's samples, kept near the frame."""

    def kept(v: int, at: int, extent: int, total: int, s: int) -> int:
        low, high = -(at * 128) >> s, ((total - extent - at) * 128) >> s
        reach = (4 + (extent * 8 >> s)) << 4
        return min(max(2 * v >> s, low - reach), high + reach - 16)

    return kept(mv[0], mi_row, spec.HIGH8[size], mi_rows, sy), kept(mv[1], mi_col, spec.WIDE8[size], mi_cols, sx)


def scaled_start(at: int, mv: int, ref: int, own: int, s: int) -> tuple[int, int]:
    """Start and step along one axis in sixteenths of the reference's samples."""
    scale = (ref << 14) // own
    fraction = ((16 * (at << s) * scale) >> 14) & 15
    return (((at * scale) >> 14) << 4) + ((mv * scale) >> 14) + fraction, (16 * scale) >> 14
