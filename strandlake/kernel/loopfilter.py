"""The loop filter: edges of each superblock, verticals before horizontals, in runs of one mode-info unit."""

from __future__ import annotations

import numpy as np

from strandlake.kernel import spec
from strandlake.kernel.headers import Header


def levels(h: Header) -> list[list[list[int]]]:
    """Filter level by segment, reference and mode type."""
    step, out = 1 << (h.lf_level >> 5), []
    for segment in range(8):
        level, value = h.lf_level, h.feature(segment, spec.ALT_L)
        if value is not None:
            level = min(63, max(0, value if h.absolute else level + value))
        if h.deltas_on:
            out.append([[min(63, max(0, level + h.ref_deltas[r] * step + (h.mode_deltas[m] * step if r else 0))) for m in range(2)] for r in range(4)])
        else:
            out.append([[level] * 2] * 4)
    return out


def strength(level: int, sharpness: int, depth: int) -> tuple[int, int, int]:
    shift = 2 if sharpness > 4 else 1 if sharpness else 0
    limit = max(1, min(9 - sharpness, level >> shift) if sharpness else level >> shift)
    return limit << (depth - 8), (2 * (level + 2) + limit) << (depth - 8), (level >> 4) << (depth - 8)


def filtered(s: np.ndarray, tx: int, limit: int, blimit: int, thresh: int, depth: int) -> np.ndarray:
    """Samples across one edge (a row each: 8 before, 8 behind, or 4 and 4) after filtering with one size and strength."""
    spare = 8 - s.shape[1] // 2
    lanes = np.pad(s, ((0, 0), (spare, spare)), mode="edge").T.astype(np.int32)
    _filter(lanes, *(np.full(len(s), v, np.int32) for v in (tx, limit, blimit, thresh)), depth)
    return lanes[spare : 16 - spare].T


def _filter(s: np.ndarray, width: np.ndarray, limit: np.ndarray, blimit: np.ndarray, thresh: np.ndarray, depth: int) -> np.ndarray:
    """Filter 8 samples before and 8 behind an edge, a line of s each, in place; the other arguments go with its columns.

    width: 0 for four samples, 1 for eight, 2 for sixteen. Returns the columns that changed.
    """
    step = np.abs(np.diff(s[4:12], axis=0))  # between neighbours; the edge lies in step[3]
    use = 2 * step[3] + np.abs(s[6] - s[9]) // 2 <= blimit
    use &= (step[[0, 1, 2, 4, 5, 6]] <= limit).all(axis=0)
    at = np.flatnonzero(use)
    if not len(at):
        return at
    t, even, wide = s[:, at], 1 << (depth - 8), width[at]
    near = (np.abs(t[4:7] - t[7]) <= even).all(axis=0) & (np.abs(t[9:12] - t[8]) <= even).all(axis=0)
    flat = near & (wide > 0)
    flatter = flat & (wide > 1)
    if flatter.any():
        flatter &= (np.abs(t[0:4] - t[7]) <= even).all(axis=0) & (np.abs(t[12:16] - t[8]) <= even).all(axis=0)
    out = t.copy()
    if len(c := np.flatnonzero(~flat)):
        sharp = np.maximum(step[2, at[c]], step[4, at[c]]) > thresh[at[c]]
        half, top = 1 << (depth - 1), (128 << (depth - 8)) - 1
        clamp = lambda v: np.minimum(np.maximum(v, -top - 1), top)
        p1, p0, q0, q1 = t[6:10, c] - half
        f = clamp(np.where(sharp, clamp(p1 - q1), 0) + 3 * (q0 - p0))
        f1, f2 = clamp(f + 4) >> 3, clamp(f + 3) >> 3
        f3 = np.where(sharp, 0, (f1 + 1) >> 1)
        out[6:10, c] = clamp(np.stack([p1 + f3, p0 + f2, q0 - f1, q1 - f3])) + half
    for log2, c in ((3, np.flatnonzero(flat & ~flatter)), (4, np.flatnonzero(flatter))):
        if len(c):
            n = (1 << (log2 - 1)) - 1
            # sums over windows of 2n + 1 lines, the outermost ones repeated
            lines = t[8 + np.clip(np.arange(-2 * n, 2 * n), -n - 1, n)][:, c]
            sums = np.concatenate([np.zeros((1, len(c)), np.int32), np.cumsum(lines, axis=0, dtype=np.int32)])
            out[8 - n : 8 + n, c] = (sums[2 * n + 1 :] - sums[: 2 * n] + lines[n : 3 * n] + (1 << (log2 - 1))) >> log2
    s[:, at] = out
    return at


def _units(grid: list[list], h: Header, sx: int, sy: int) -> dict[str, np.ndarray]:
    """What edges ask of the block at each mode-info unit."""
    table, known = levels(h), {}
    for line in grid[: h.mi_rows]:
        for b in line[: h.mi_cols]:
            if id(b) not in known:
                moving = b.mode in (spec.NEAREST, spec.NEAR, spec.NEW)
                outer = max(b.size, spec.B16)
                known[id(b)] = (b.tx, spec.uv_tx(b.size, b.tx, sx, sy), spec.WIDE8[b.size], spec.HIGH8[b.size], spec.WIDE8[outer], spec.HIGH8[outer], b.refs[0] == spec.INTRA or not b.skip, table[b.segment][b.refs[0]][moving])
    cells = np.array([[known[id(b)] for b in line[: h.mi_cols]] for line in grid[: h.mi_rows]], np.int32)
    return dict(zip(("tx", "uv_tx", "wide", "high", "outer_wide", "outer_high", "inner", "level"), np.moveaxis(cells, 2, 0), strict=True))


def _edges(units: dict[str, np.ndarray], h: Header, chroma: bool, across_rows: bool, px: int, py: int) -> tuple[np.ndarray, ...]:
    """Edges to filter in a plane, as runs of one unit: number of the edge, unit along it, filter width, level."""
    own, along = (py, px) if across_rows else (px, py)  # subsampling across the edges and along them
    across, beside = (h.mi_rows, h.mi_cols) if across_rows else (h.mi_cols, h.mi_rows)
    edge, unit = np.meshgrid(np.arange(-(-8 * across // (4 << own))), np.arange(beside), indexing="ij")
    far = edge * (4 << own)  # in luma samples
    block, other = (far >> 3) >> own << own, unit >> along << along
    at = (block, other) if across_rows else (other, block)
    tx = units["uv_tx" if chroma else "tx"][at]
    # subsampled planes judge the edges of blocks under 16x16 as theirs
    size = units[("outer_" if own else "") + ("high" if across_rows else "wide")][at]
    inside = edge % (16 >> own)
    at_block, at_tx = far % (8 * size) == 0, inside % (1 << tx) == 0
    if across_rows and px == 1 and h.mi_cols % 2 == 1:
        at_tx &= ~((inside % 2 == 1) & (unit == h.mi_cols - 1))
    level = units["level"][at]
    wanted = (edge > 0) & (level > 0) & (at_block | at_tx & (units["inner"][at] > 0))
    width = np.where((tx == 0) & (inside % 8 == 0), 1, np.minimum(tx, 2))
    if own:
        width[(width == 2) & (far >> 3 == across - 1)] = 1
    return tuple(x[wanted] for x in (edge, unit, width, level))


def waves(row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Superblocks in turn: one waits for its left neighbour and for those above, up to the one above to the right."""
    return col + 2 * row


def filter_frame(planes: list[np.ndarray], grid: list[list], h: Header, sx: int, sy: int, depth: int, turns=waves) -> None:
    """Filter all planes in place. grid: the block of each mode-info unit.

    What one edge number takes from all superblocks of a turn is filtered at once: they
    touch no sample in common.
    """
    units = _units(grid, h, sx, sy)
    strengths = np.array([strength(level, h.sharpness, depth) for level in range(64)], np.int32)
    for plane_at, plane in enumerate(planes):
        px, py = (sx, sy) if plane_at else (0, 0)
        wide = plane.shape[1] + 16
        samples = np.pad(plane.astype(np.int32), 8).reshape(-1)
        found = []
        for across_rows in (False, True):
            edge, unit, width, level = _edges(units, h, plane_at > 0, across_rows, px, py)
            own, along = (py, px) if across_rows else (px, py)
            sb, beside = edge // (16 >> own), unit // 8
            turn = turns(sb, beside) if across_rows else turns(beside, sb)
            # the runs' first samples; a run has 8 of them, or 4
            across_at, along_at = 8 + edge * 4, 8 + unit * (8 >> along)
            first = across_at * wide + along_at if across_rows else along_at * wide + across_at
            found.append(np.stack([turn * 64 + 32 * across_rows + edge % (16 >> own), first, width, level, np.full(len(edge), across_rows)]))
        order, first, width, level, kind = np.concatenate(found, axis=1)
        ranked = np.argsort(order, kind="stable")
        cuts = np.flatnonzero(np.diff(order[ranked])) + 1
        for run in np.split(ranked, cuts) if len(ranked) else []:
            across_rows = bool(kind[run[0]])
            n, step, aside = (8 >> px, wide, 1) if across_rows else (8 >> py, 1, wide)
            base = (first[run][:, None] + aside * np.arange(n)).reshape(-1)
            place = (np.arange(-8, 8) * step)[:, None] + base
            lanes = samples[place]
            limits = np.repeat(strengths[level[run]], n, axis=0)
            changed = _filter(lanes, np.repeat(width[run], n), limits[:, 0], limits[:, 1], limits[:, 2], depth)
            if len(changed):
                samples[place[1:15, changed]] = lanes[1:15, changed]
        plane[:] = samples.reshape(-1, wide)[8:-8, 8:-8]
