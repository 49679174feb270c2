"""Decoding of tiles: partitions, modes, motion vectors, coefficients."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from strandlake.kernel import predict, spec, transform
from strandlake.kernel.bits import BitstreamError, BoolDecoder
from strandlake.kernel.contexts import Compressed, new_counts
from strandlake.kernel.headers import Color, Header
from strandlake.kernel.tables import Tables

Mv = tuple[int, int]
NO_MV: Mv = (0, 0)
#: How far a tile's arithmetic decoder may end from its data, in bits read past it and left over.
MOST_OVER, MOST_UNUSED = 128, 1024


@dataclass(slots=True)
class Block:
    """What is known of a block after its modes are read."""

    size: int = 0
    skip: bool = False
    tx: int = 0
    mode: int = spec.DC
    uv_mode: int = spec.DC
    sub_modes: tuple[int, ...] = (spec.DC,) * 4
    segment: int = 0
    refs: tuple[int, int] = (spec.INTRA, 0)
    mvs: tuple[list[Mv], list[Mv]] = field(default_factory=lambda: ([NO_MV] * 4, [NO_MV] * 4))
    interp_filter: int = 0

    def mv(self, which: int) -> Mv:
        return self.mvs[which][3]


@dataclass
class Reference:
    """A picture that later frames may predict from: planes cut to its size."""

    planes: list[np.ndarray]
    width: int
    height: int
    color: Color


def tile_bytes(data: bytes, count: int) -> list[bytes]:
    """All tiles but the last are preceded by their size."""
    out = []
    for i in range(count):
        size = len(data)
        if i + 1 < count:
            if len(data) < 4:
                raise BitstreamError("InvalidTileSize")
            size, data = int.from_bytes(data[:4], "big"), data[4:]
        if len(data) < size:
            raise BitstreamError("InvalidTileSize")
        out.append(data[:size])
        data = data[size:]
    return out


def tile_start(tile: int, mis: int, log2: int) -> int:
    return min(((tile * ((mis + 7) >> 3)) >> log2) << 3, mis)


#: Squares of 4x4 coefficients that are transformed at once.
TOGETHER = 1 << 14


class FrameDecoder:
    """Decodes the tiles of one frame into planes and a grid of blocks."""

    def __init__(self, h: Header, color: Color, compressed: Compressed, tables: Tables, refs: list[Reference | None], previous: list[list[Block]] | None, segments: np.ndarray, opened=BoolDecoder):
        self.h, self.color, self.c, self.tables, self.refs, self.previous, self.segments, self.opened = h, color, compressed, tables, refs, previous, segments, opened
        self.probs = {name: p.tolist() for name, p in compressed.context.items()}
        self.counts = new_counts(compressed.context)
        rows, cols = -(-h.mi_rows // 8) * 8, -(-h.mi_cols // 8) * 8
        self.shape = [(color.sx if p else 0, color.sy if p else 0) for p in range(3)]
        self.planes = [np.zeros((rows * 8 >> sy, cols * 8 >> sx), np.uint16) for sx, sy in self.shape]
        self.grid: list[list[Block | None]] = [[None] * cols for _ in range(rows)]
        #: Coefficients of inter blocks that are still to be added, by plane, size and kind.
        self.waiting: dict[tuple[int, int, int], list[tuple]] = {}
        self.above_partition, self.left_partition = [0] * cols, [0] * 8
        self.above_nonzero, self.left_nonzero = [[0] * (2 * cols + 16) for _ in range(3)], [[0] * 32 for _ in range(3)]
        self.above_predicted, self.left_predicted = [0] * (cols + 8), [0] * 8
        q = [min(255, max(0, v if h.absolute else h.base_q + v)) if (v := h.feature(s, spec.ALT_Q)) is not None else h.base_q for s in range(8)]
        depth = (color.bit_depth - 8) // 2
        at = lambda table, i: table[depth][min(255, max(0, i))]
        self.quant = [[(at(tables.dc_quant, i + h.q_y_dc), at(tables.ac_quant, i)), (at(tables.dc_quant, i + h.q_uv_dc), at(tables.ac_quant, i + h.q_uv_ac))] for i in q]

    def decode(self, data: bytes) -> None:
        h = self.h
        rows, cols = 1 << h.tile_rows_log2, 1 << h.tile_cols_log2
        for i, tile in enumerate(tile_bytes(data, rows * cols)):
            top, left = divmod(i, cols)
            self.left, self.right = (tile_start(left + k, h.mi_cols, h.tile_cols_log2) for k in (0, 1))
            self.d = self.opened(tile)
            for row in range(tile_start(top, h.mi_rows, h.tile_rows_log2), tile_start(top + 1, h.mi_rows, h.tile_rows_log2), 8):
                self.left_partition, self.left_predicted = [0] * 8, [0] * 8
                self.left_nonzero = [[0] * 32 for _ in range(3)]
                for col in range(self.left, self.right, 8):
                    self.partition(row, col, spec.B64)
            over, unused = self.d.slack()
            if over > MOST_OVER or unused > MOST_UNUSED:
                raise BitstreamError("CorruptTile")
        self.add_waiting()

    # partitions

    def partition(self, row: int, col: int, size: int) -> None:
        h = self.h
        if row >= h.mi_rows or col >= h.mi_cols:
            return
        n = spec.WIDE8[size]
        half, log2 = n >> 1, n.bit_length() - 1
        has_rows, has_cols = row + half < h.mi_rows, col + half < h.mi_cols
        bit = 1 << (3 - log2)
        above = any(a & bit for a in self.above_partition[col : col + n])
        left = any(a & bit for a in self.left_partition[row % 8 : row % 8 + n])
        ctx = log2 * 4 + 2 * left + above
        probs = spec.KF_PARTITION[ctx] if h.intra else self.probs["partition"][ctx]
        if has_rows and has_cols:
            kind = self.d.tree(spec.PARTITION_TREE, probs)
        elif has_cols:
            kind = spec.SPLIT if self.d.read(probs[1]) else spec.HORZ
        elif has_rows:
            kind = spec.SPLIT if self.d.read(probs[2]) else spec.VERT
        else:
            kind = spec.SPLIT
        if not h.intra:
            self.counts["partition"][ctx][kind] += 1
        part = spec.sub_size(kind, size)
        if part is None:
            raise BitstreamError("InvalidPartition")
        if part < spec.B8 or kind == spec.NONE:
            self.block(row, col, part)
        elif kind == spec.SPLIT:
            for i in (0, half):
                for j in (0, half):
                    self.partition(row + i, col + j, part)
        else:
            self.block(row, col, part)
            if kind == spec.HORZ and has_rows:
                self.block(row + half, col, part)
            elif kind == spec.VERT and has_cols:
                self.block(row, col + half, part)
        if size == spec.B8 or kind != spec.SPLIT:
            w, hh = spec.SIZES[part]
            self.above_partition[col : col + n] = [15 >> (w.bit_length() - 1)] * n
            self.left_partition[row % 8 : row % 8 + n] = [15 >> (hh.bit_length() - 1)] * n

    def block(self, row: int, col: int, size: int) -> None:
        self.row, self.col = row, col
        self.above_block = self.grid[row - 1][col] if row > 0 else None
        self.left_block = self.grid[row][col - 1] if col > self.left else None
        b = self.intra_frame_block(size) if self.h.intra else self.inter_frame_block(size)
        if spec.plane_size(max(size, spec.B8), self.color.sx, self.color.sy) is None:
            raise BitstreamError("InvalidPartition")
        for r in b.refs:
            if r > spec.INTRA:
                ref = self.refs[r - spec.LAST]
                if ref is None:
                    raise BitstreamError("MissingReference")
                if ref.width > 2 * self.h.width or ref.height > 2 * self.h.height:
                    raise BitstreamError("RefFrameSizeOutOfRange")
        coded = self.residual(b)
        if b.refs[0] > spec.INTRA and size >= spec.B8 and not coded:
            b.skip = True
        for y in range(row, min(row + spec.HIGH8[size], len(self.grid))):
            line = self.grid[y]
            for x in range(col, min(col + spec.WIDE8[size], len(line))):
                line[x] = b

    # modes

    def counted(self, name: str, at, value: int) -> int:
        if not self.h.intra:
            self.counts[name][at][value] += 1
        return value

    def decided(self, name: str, ctx: int) -> int:
        return self.counted(name, ctx, self.d.read(self.probs[name][ctx]))

    def read_segment(self) -> int:
        return self.d.tree(spec.SEGMENT_TREE, self.h.tree_probs)

    def predicted_segment(self, size: int) -> int:
        r, c = self.row, self.col
        return int(self.segments[r : min(r + spec.HIGH8[size], self.h.mi_rows), c : min(c + spec.WIDE8[size], self.h.mi_cols)].min())

    def inter_segment(self, size: int) -> int:
        h = self.h
        if not h.seg_on:
            return 0
        guess = self.predicted_segment(size)
        if not h.seg_update_map:
            return guess
        if not h.seg_temporal:
            return self.read_segment()
        at, n, m = self.row % 8, spec.HIGH8[size], spec.WIDE8[size]
        kept = self.d.read(h.pred_probs[self.left_predicted[at] + self.above_predicted[self.col]])
        segment = guess if kept else self.read_segment()
        self.above_predicted[self.col : self.col + m] = [kept] * m
        self.left_predicted[at : at + n] = [kept] * n
        return segment

    def read_skip(self, segment: int) -> bool:
        if self.h.feature(segment, spec.SKIP) is not None:
            return True
        ctx = sum(1 for b in (self.above_block, self.left_block) if b is not None and b.skip)
        return bool(self.decided("skip", ctx))

    def read_tx(self, size: int, may_select: bool) -> int:
        largest = spec.LARGEST_TX[size]
        if not may_select or self.c.tx_mode != spec.TX_SELECT or size < spec.B8:
            return min(largest, spec.BIGGEST_TX[self.c.tx_mode])
        above, left = (None if b is None else largest if b.skip else b.tx for b in (self.above_block, self.left_block))
        if above is None and left is None:
            above = left = largest
        above = left if above is None else above
        left = above if left is None else left
        ctx = int(above + left > largest)
        name = f"tx{largest}"
        return self.counted(name, ctx, self.d.tree(spec.TX_TREES[largest], self.probs[name][ctx]))

    def sub_block_modes(self, size: int, read) -> tuple[int, ...]:
        """Modes of the four quarters of a block below 8x8; read(quarter, modes so far)."""
        w, h = spec.SIZES[size]
        modes = [spec.DC] * 4
        for y in range(0, 2, h):
            for x in range(0, 2, w):
                mode = read(2 * y + x, modes)
                for k in range(h):
                    for j in range(w):
                        modes[2 * (y + k) + x + j] = mode
        return tuple(modes)

    def intra_frame_block(self, size: int) -> Block:
        b = Block(size)
        b.segment = self.read_segment() if self.h.seg_on and self.h.seg_update_map else 0
        b.skip = self.read_skip(b.segment)
        b.tx = self.read_tx(size, True)

        def read(quarter: int, modes: list[int]) -> int:
            above = modes[quarter - 2] if quarter >= 2 else self.above_block.sub_modes[quarter + 2] if self.above_block else spec.DC
            left = modes[quarter - 1] if quarter & 1 else self.left_block.sub_modes[quarter + 1] if self.left_block else spec.DC
            return self.d.tree(spec.INTRA_TREE, self.tables.kf_y_mode[above][left])

        b.sub_modes = self.sub_block_modes(size, read) if size < spec.B8 else (read(0, []),) * 4
        b.mode = b.sub_modes[3]
        b.uv_mode = self.d.tree(spec.INTRA_TREE, spec.KF_UV_MODE[b.mode])
        return b

    def inter_frame_block(self, size: int) -> Block:
        b = Block(size)
        b.segment = self.inter_segment(size)
        b.skip = self.read_skip(b.segment)
        around = [n for n in (self.above_block, self.left_block) if n is not None]
        reference = self.h.feature(b.segment, spec.REF_FRAME)
        if reference is not None:
            inter = reference != spec.INTRA
        else:
            intra = sum(n.refs[0] == spec.INTRA for n in around)
            ctx = (3 if intra == 2 else intra) if len(around) == 2 else 2 * intra
            inter = bool(self.decided("is_inter", ctx))
        b.tx = self.read_tx(size, not b.skip or not inter)
        if not inter:
            group = spec.SIZE_GROUP[size] if size >= spec.B8 else 0
            read = lambda *_: self.counted("y_mode", group, self.d.tree(spec.INTRA_TREE, self.probs["y_mode"][group]))
            b.sub_modes = self.sub_block_modes(size, read) if size < spec.B8 else (read(),) * 4
            b.mode = b.sub_modes[3]
            b.uv_mode = self.counted("uv_mode", b.mode, self.d.tree(spec.INTRA_TREE, self.probs["uv_mode"][b.mode]))
            return b
        b.refs = (reference, 0) if reference is not None else self.read_refs()
        used = [r for r in b.refs if r > spec.INTRA]
        found = [self.candidates(size, r, None) for r in used]
        ctx = found[0][1]
        best = [self.settled(size, mvs) for mvs, _ in found]
        near = [list(mvs) for mvs in best]
        read_mode = lambda: spec.NEAREST + self.counted("inter_mode", ctx, self.d.tree(spec.INTER_TREE, self.probs["inter_mode"][ctx]))
        b.mode = spec.ZERO
        if self.h.feature(b.segment, spec.SKIP) is None and size >= spec.B8:
            b.mode = read_mode()
        if self.h.interp_filter == spec.SWITCHABLE:
            kinds = [3 if n is None or n.refs[0] == spec.INTRA else n.interp_filter for n in (self.left_block, self.above_block)]
            at = kinds[0] if kinds[0] == kinds[1] else kinds[1] if kinds[0] == 3 else kinds[0] if kinds[1] == 3 else 3
            b.interp_filter = self.counted("interp_filter", at, self.d.tree(spec.FILTER_TREE, self.probs["interp_filter"][at]))
        else:
            b.interp_filter = self.h.interp_filter

        def vector(i: int) -> Mv:
            return self.read_mv(best[i][0]) if b.mode == spec.NEW else near[i][b.mode - spec.NEAREST] if b.mode in (spec.NEAREST, spec.NEAR) else NO_MV

        if size >= spec.B8:
            for i in range(len(used)):
                b.mvs[i][:] = [vector(i)] * 4
            return b

        def read_quarter(quarter: int, _) -> int:
            b.mode = read_mode()
            if b.mode in (spec.NEAREST, spec.NEAR):
                for i, r in enumerate(used):
                    near[i] = self.quarter_candidates(size, quarter, r, b.mvs[i])
            w, h = spec.SIZES[size]
            for i, mv in enumerate([vector(i) for i in range(len(used))]):
                for k in range(h):
                    for j in range(w):
                        b.mvs[i][quarter + 2 * k + j] = mv
            return b.mode

        self.sub_block_modes(size, read_quarter)
        return b

    # references

    def read_refs(self) -> tuple[int, int]:
        mode = self.c.reference_mode
        if mode == spec.SELECT:
            mode = self.decided("comp_mode", self.comp_mode_ctx())
        if mode == spec.COMPOUND:
            at = self.h.sign_bias[self.c.fixed_ref]
            other = self.c.var_refs[self.decided("comp_ref", self.comp_ref_ctx())]
            return (other, self.c.fixed_ref) if at else (self.c.fixed_ref, other)
        ctx = self.single_ref_ctx()
        if not self.counted("single_ref", (ctx, 0), self.d.read(self.probs["single_ref"][ctx][0])):
            return (spec.LAST, 0)
        ctx = self.golden_ref_ctx()
        return (spec.ALTREF if self.counted("single_ref", (ctx, 1), self.d.read(self.probs["single_ref"][ctx][1])) else spec.GOLDEN, 0)

    def neighbours(self) -> list[Block]:
        return [n for n in (self.above_block, self.left_block) if n is not None]

    def comp_mode_ctx(self) -> int:
        around, fixed = self.neighbours(), self.c.fixed_ref
        single = [n for n in around if n.refs[1] == 0]
        hits = sum(n.refs[0] == fixed for n in single)
        if not around:
            return 1
        if len(around) == 1:
            return hits if single else 3
        if len(single) == 2:
            return hits & 1
        if len(single) == 1:
            return 2 + (single[0].refs[0] in (fixed, spec.INTRA))
        return 4

    def comp_ref_ctx(self) -> int:
        fixed, (first, second) = self.c.fixed_ref, self.c.var_refs
        variable = 1 - self.h.sign_bias[fixed]
        around = self.neighbours()
        inter = [n for n in around if n.refs[0] != spec.INTRA]
        kept = lambda n: n.refs[0] if n.refs[1] == 0 else n.refs[variable]
        if not inter:
            return 2
        if len(around) == 1:
            return (3 if inter[0].refs[1] == 0 else 4) * (kept(inter[0]) != second)
        if len(inter) == 1:
            return 1 + 2 * (kept(inter[0]) != second)
        a, b = (kept(n) for n in inter)
        singles = [n.refs[1] == 0 for n in inter]
        if a == b == second:
            return 0
        if all(singles):
            if {a, b} == {fixed, first}:
                return 4
            return 3 if a == b else 1
        if any(singles):
            alone, paired = (a, b) if singles[0] else (b, a)
            if paired == second != alone:
                return 1
            return 2 if alone == second != paired else 4
        return 4 if a == b else 2

    def single_ref_ctx(self) -> int:
        """Context of whether the reference is the last frame."""
        around = self.neighbours()
        inter = [n for n in around if n.refs[0] != spec.INTRA]
        last = [spec.LAST in n.refs for n in inter]
        if not inter:
            return 2
        single = [n.refs[1] == 0 for n in inter]
        if len(inter) == 1:
            return 4 * last[0] if single[0] else 1 + last[0]
        if all(single):
            return 2 * sum(last)
        if not any(single):
            return 1 + any(last)
        alone, paired = last if single[0] else last[::-1]
        return 3 + paired if alone else int(paired)

    def golden_ref_ctx(self) -> int:
        """Context of whether the reference is the golden or the alternate frame."""
        around = self.neighbours()
        inter = [n for n in around if n.refs[0] != spec.INTRA]
        golden = [spec.GOLDEN in n.refs for n in inter]
        if not inter:
            return 2
        single = [n.refs[1] == 0 for n in inter]
        if len(around) == 1:
            if not single[0]:
                return 3 * golden[0]
            return 2 if inter[0].refs[0] == spec.LAST else 4 * golden[0]
        if len(inter) == 1:
            if not single[0]:
                return 1 + 2 * golden[0]
            return 3 if inter[0].refs[0] == spec.LAST else 4 * golden[0]
        if all(single):
            last = [n.refs[0] == spec.LAST for n in inter]
            if all(last):
                return 3
            return 4 * any(golden) if any(last) else 2 * sum(golden)
        if not any(single):
            return 3 * golden[0] if inter[0].refs == inter[1].refs else 2
        (alone, paired) = (inter[0], golden[1]) if single[0] else (inter[1], golden[0])
        return {spec.GOLDEN: 3 + paired, spec.ALTREF: int(paired)}.get(alone.refs[0], 1 + 2 * paired)

    # motion vectors

    def read_mv(self, best: Mv) -> Mv:
        precise = self.h.high_precision and self.small(best)
        joint = self.counted("mv_joint", (), self.d.tree(spec.JOINT_TREE, self.probs["mv_joint"]))
        return (best[0] + (self.read_component(0, precise) if joint >= 2 else 0), best[1] + (self.read_component(1, precise) if joint & 1 else 0))

    def read_component(self, i: int, precise: bool) -> int:
        d, p = self.d, self.probs
        negative = self.decided("mv_sign", i)
        kind = self.counted("mv_class", i, d.tree(spec.CLASS_TREE, p["mv_class"][i]))
        if kind == 0:
            whole = self.decided("mv_class0", i)
            fraction = self.counted("mv_class0_fr", (i, whole), d.tree(spec.FRACTION_TREE, p["mv_class0_fr"][i][whole]))
            name, base = "mv_class0_hp", 0
        else:
            whole = 0
            for k in range(kind):
                whole |= self.counted("mv_bits", (i, k), d.read(p["mv_bits"][i][k])) << k
            fraction = self.counted("mv_fr", i, d.tree(spec.FRACTION_TREE, p["mv_fr"][i]))
            name, base = "mv_hp", 2 << (kind + 2)
        # the last bit counts even where it isn't coded
        high = self.counted(name, i, d.read(p[name][i]) if precise else 1)
        size = base + (whole << 3 | fraction << 1 | high) + 1
        return -size if negative else size

    @staticmethod
    def small(mv: Mv) -> bool:
        return abs(mv[0]) >> 3 < 8 and abs(mv[1]) >> 3 < 8

    def within(self, mv: Mv, size: int, border: int) -> Mv:
        def kept(v: int, at: int, n: int, total: int) -> int:
            return min(max(v, -at * 64 - border), (total - n - at) * 64 + border)

        return kept(mv[0], self.row, spec.HIGH8[size], self.h.mi_rows), kept(mv[1], self.col, spec.WIDE8[size], self.h.mi_cols)

    def candidates(self, size: int, ref: int, quarter: int | None) -> tuple[list[Mv], int]:
        """Up to two vectors for a reference from neighbours and the previous frame, and the mode context."""
        found: list[Mv] = []
        bias = self.h.sign_bias

        def add(mv: Mv) -> None:
            if len(found) < 2 and mv not in found:
                found.append(mv)

        def same(n: Block) -> None:
            for k in (0, 1):
                if n.refs[k] == ref:
                    return add(n.mv(k))

        def other(n: Block) -> None:
            first, second = n.mv(0), n.mv(1)
            for k, mv in ((0, first), (1, second)):
                r = n.refs[k]
                if r > spec.INTRA and r != ref and not (k and first == second):
                    add((-mv[0], -mv[1]) if bias[r] != bias[ref] else mv)

        around = []
        counter = 0
        for k, (dr, dc) in enumerate(spec.MV_CANDIDATES[size]):
            r, c = self.row + dr, self.col + dc
            n = self.grid[r][c] if 0 <= r < self.h.mi_rows and self.left <= c < self.right else None
            inside = 0 <= r < self.h.mi_rows and self.left <= c < self.right
            if not inside:
                continue
            n = n or Block()  # not decoded yet
            around.append(n)
            if k < 2:
                counter += spec.MODE_COUNTER[n.mode]
                for j in (0, 1):
                    if n.refs[j] == ref:
                        add(n.mvs[j][3 if quarter is None else spec.SUB_BLOCK[quarter][int(dc == 0)]])
                        break
            else:
                same(n)
        before = self.previous[self.row][self.col] if self.previous else None
        if before:
            same(before)
        for n in around:
            other(n)
        if before:
            other(before)
        return [self.within(mv, size, BORDER) for mv in (found + [NO_MV] * 2)[:2]], spec.COUNTER_CONTEXT[min(counter, 18)]

    def settled(self, size: int, mvs: list[Mv]) -> list[Mv]:
        """Candidates at the precision that the frame allows, kept nearer to it."""
        out = []
        for mv in mvs:
            if not (self.h.high_precision and self.small(mv)):
                mv = tuple(v - (v > 0) + (v < 0) if v & 1 else v for v in mv)
            out.append(self.within(mv, size, NEAR_BORDER))
        return out

    def quarter_candidates(self, size: int, quarter: int, ref: int, mvs: list[Mv]) -> list[Mv]:
        found, _ = self.candidates(size, ref, quarter)
        if quarter == 0:
            return found
        out: list[Mv] = []
        for mv in [mvs[i] for i in ((0,) if quarter < 3 else (2, 1, 0))] + found:
            if len(out) < 2 and mv not in out:
                out.append(mv)
        return (out + [NO_MV])[:2]

    # samples

    def residual(self, b: Block) -> int:
        """Predict the block and add its coefficients; returns how many transform blocks had any."""
        h, coded = self.h, 0
        inter = b.refs[0] > spec.INTRA
        outer = max(b.size, spec.B8)
        if not inter and self.waiting:
            self.add_waiting()  # intra prediction reads samples beside the block
        for p in range(3):
            sx, sy = self.shape[p]
            tx = spec.uv_tx(b.size, b.tx, *self.shape[1]) if p else b.tx
            step = 1 << tx
            wide, high = spec.SIZES[spec.plane_size(outer, sx, sy)]
            x0, y0 = self.col * 8 >> sx, self.row * 8 >> sy
            end_x, end_y = h.mi_cols * 8 >> sx, h.mi_rows * 8 >> sy
            if inter:
                self.predict_inter(b, p, x0, y0, wide, high)
            above, left = self.above_nonzero[p], self.left_nonzero[p]
            at = 0
            for i in range(0, high, step):
                for j in range(0, wide, step):
                    x, y, some = x0 + 4 * j, y0 + 4 * i, 0
                    if x < end_x and y < end_y:
                        if not inter:
                            mode = b.uv_mode if p else b.mode if b.size >= spec.B8 else b.sub_modes[at]
                            predict.intra(self.planes[p], x, y, self.left_block is not None or j > 0, self.above_block is not None or i > 0, j + step < wide, tx, mode, end_x - 1, end_y - 1, self.color.bit_depth)
                        if not b.skip:
                            kind = self.tx_kind(b, p, tx, at, inter)
                            some = self.coefficients(b, p, x, y, tx, kind, inter)
                    coded += some
                    above[x >> 2 : (x >> 2) + step] = [some] * step
                    first = (y >> 2) % 16
                    left[first : first + step] = [some] * step
                    at += 1
        return coded

    def tx_kind(self, b: Block, p: int, tx: int, at: int, inter: bool) -> int:
        if p or tx == 3 or tx == 0 and (self.h.lossless or inter):
            return spec.DCT_DCT
        return spec.TX_TYPE[b.sub_modes[at] if tx == 0 and b.size < spec.B8 else b.mode]

    def coefficients(self, b: Block, p: int, x: int, y: int, tx: int, kind: int, inter: bool) -> int:
        """Read a transform block and add it to the plane; 1 if it has coefficients."""
        d, n, n4 = self.d, 4 << tx, 1 << tx
        sx, sy = self.shape[p]
        x4, y4 = x >> 2, y >> 2
        ends = min(n4, max(0, (2 * self.h.mi_cols >> sx) - x4)), min(n4, max(0, (2 * self.h.mi_rows >> sy) - y4))
        ctx = any(self.above_nonzero[p][x4 : x4 + ends[0]]) + any(self.left_nonzero[p][y4 % 16 : y4 % 16 + ends[1]])
        probs = self.probs["coef"][tx][p > 0][inter]
        tokens, more = self.counts["token"][tx, int(p > 0), int(inter)], self.counts["more"][tx, int(p > 0), int(inter)]
        name = {spec.ADST_DCT: "row", spec.DCT_ADST: "col"}.get(kind, "default") if tx < 3 else "default"
        scan = self.tables.scans[f"{name}{n}"]
        bands = spec.BAND_4X4 if tx == 0 else spec.BAND_LARGER
        energy = [0] * (n * n)
        values: dict[int, int] = {}
        asked = True
        c = 0
        while c < n * n:
            at = scan[c]
            band = bands[c] if c < len(bands) else 5
            if c:
                i, j = divmod(at, n)
                up, back = (at - n if i else at - 1), (at - 1 if j else at - n)
                if i and j and name != "default":
                    up = back = at - n if kind == spec.DCT_ADST else at - 1
                ctx = (1 + energy[up] + energy[back]) >> 1
            pr = probs[band][ctx]
            if asked:
                follows = d.read(pr[0])
                more[band, ctx, follows] += 1
                if not follows:
                    break
            if not d.read(pr[1]):
                token = 0
            elif not d.read(pr[2]):
                token = 1
            else:
                token = self.larger_token(pr[2])
            tokens[band, ctx, min(token, 2)] += 1
            energy[at] = spec.ENERGY[token]
            asked = token > 0
            if token:
                value = self.token_value(token)
                values[at] = -value if d.read(128) else value
            c += 1
        if c == 0:
            return 0
        dc, ac = self.quant[b.segment][p > 0]
        places = list(values)
        scaled = [abs(v) * (ac if at else dc) // (2 if tx == 3 else 1) * (-1 if v < 0 else 1) for at, v in values.items()]
        if inter:
            # inter prediction reads no sample of this frame: these blocks wait and are transformed together
            self.waiting.setdefault((p, tx, kind), []).append((x, y, places, scaled))
        elif places == [0] and kind == spec.DCT_DCT and not self.h.lossless:
            self.add(p, x, y, n, transform.inverse_first(scaled[0], tx))
        else:
            block = np.zeros(n * n, np.int64)
            block[places] = scaled
            self.add(p, x, y, n, transform.inverse(block.reshape(n, n), tx, kind, self.h.lossless))
        return 1

    def add(self, p: int, x: int, y: int, n: int, residual) -> None:
        part = self.planes[p][y : y + n, x : x + n]
        part[:] = np.minimum(np.maximum(part.astype(np.int32) + residual, 0), (1 << self.color.bit_depth) - 1)

    def add_waiting(self) -> None:
        """Transform and add the coefficients of inter blocks, all of one size and kind at once."""
        for (p, tx, kind), found in self.waiting.items():
            n = 4 << tx
            for first in range(0, len(found), TOGETHER >> 2 * tx):
                part = found[first : first + (TOGETHER >> 2 * tx)]
                blocks = np.zeros((len(part), n * n), np.int64)
                for line, (_, _, places, scaled) in zip(blocks, part, strict=True):
                    line[places] = scaled
                for (x, y, _, _), residual in zip(part, transform.inverse(blocks.reshape(-1, n, n), tx, kind, self.h.lossless), strict=True):
                    self.add(p, x, y, n, residual)
        self.waiting = {}

    def larger_token(self, p: int) -> int:
        pareto = self.tables.pareto_probs(p)
        at = 4
        while True:
            at = spec.TOKEN_TREE[at + self.d.read(pareto[(at >> 1) - 2])]
            if at <= 0:
                return -at

    def token_value(self, token: int) -> int:
        value, extra = spec.TOKEN_BASE[token], spec.EXTRA_BIT_PROBS[token]
        probs = [255] * (self.color.bit_depth - 8) + extra if token == 10 else extra
        offset = 0
        for p in probs:
            offset = offset << 1 | self.d.read(p)
        return value + offset

    def predict_inter(self, b: Block, p: int, x0: int, y0: int, wide: int, high: int) -> None:
        sx, sy = self.shape[p]
        parts = [(x0, y0, 4 * wide, 4 * high, 0)] if b.size >= spec.B8 else [(x0 + 4 * j, y0 + 4 * i, 4, 4, i * wide + j) for i in range(high) for j in range(wide)]
        for x, y, w, h, at in parts:
            made = []
            for k, r in enumerate(b.refs):
                if r == spec.INTRA:
                    continue
                ref, mvs = self.refs[r - spec.LAST], b.mvs[k]
                mv = mvs[at]
                if p and b.size < spec.B8 and (sx or sy):
                    group = mvs if sx and sy else (mvs[at], mvs[at + (1 if sx else 2)])
                    mv = tuple(predict.towards_zero(sum(v[i] for v in group), len(group)) for i in (0, 1))
                row, col = predict.clamped_mv(mv, self.row, self.col, b.size, self.h.mi_rows, self.h.mi_cols, sx, sy)
                start_x, step_x = predict.scaled_start(x, col, ref.width, self.h.width, sx)
                start_y, step_y = predict.scaled_start(y, row, ref.height, self.h.height, sy)
                made.append(predict.block_from(ref.planes[p], start_x, start_y, step_x, step_y, w, h, b.interp_filter, self.color.bit_depth))
            self.planes[p][y : y + h, x : x + w] = made[0] if len(made) == 1 else (made[0] + made[1] + 1) >> 1


#: How far candidates may point out of the frame, in eighths of a sample: when found, and when used.
BORDER, NEAR_BORDER = 128, (160 - 4) << 3
