"""Synthetic streams: writers for headers and tiles, the inverse of the parsers.

They make small streams whose pictures follow from their modes, for tests and for
queries that need bytes to decode.
"""

from __future__ import annotations

import copy
import random
import struct

from strandlake.kernel import spec
from strandlake.kernel.bits import BitstreamError, BitWriter, BoolDecoder, BoolEncoder
from strandlake.kernel.headers import FEATURE_BITS, FILTER_CODES, SYNC, Header, tile_log2_bounds
from strandlake.kernel.tables import Tables, load


def write_header(h: Header) -> bytes:
    """The uncompressed header; sizes are always coded, features always sent where segmentation is on."""
    w = BitWriter().f(2, 2).f(h.profile & 1, 1).f(h.profile >> 1, 1)
    if h.profile == 3:
        w.f(0, 1)
    if h.show_existing is not None:
        return w.f(1, 1).f(h.show_existing, 3).done()
    w.f(0, 1).f(not h.key, 1).f(h.show, 1).f(h.resilient, 1)

    def color() -> None:
        c = h.color
        if h.profile >= 2:
            w.f(c.bit_depth == 12, 1)
        w.f(c.space, 3)
        if c.space != 7:
            w.f(c.full_range, 1)
            if h.profile & 1:
                w.f(c.sx, 1).f(c.sy, 1).f(0, 1)
        else:
            w.f(0, 1)

    def size() -> None:
        w.f(h.width - 1, 16).f(h.height - 1, 16)

    if h.key:
        w.f(SYNC, 24)
        color()
        size()
    else:
        if not h.show:
            w.f(h.intra_only, 1)
        if not h.resilient:
            w.f(h.reset_context, 2)
        if h.intra_only:
            w.f(SYNC, 24)
            if h.profile:
                color()
            w.f(h.refresh, 8)
            size()
        else:
            w.f(h.refresh, 8)
            for i in range(3):
                w.f(h.refs[i], 3).f(h.sign_bias[i + 1], 1)
            w.f(0, 3)
            size()
    w.f(0, 1)  # shown as it is
    if not h.intra:
        w.f(h.high_precision, 1).f(h.interp_filter == 4, 1)
        if h.interp_filter != 4:
            w.f(FILTER_CODES.index(h.interp_filter), 2)
    if not h.resilient:
        w.f(h.refresh_context, 1).f(h.parallel, 1)
    w.f(h.context, 2).f(h.lf_level, 6).f(h.sharpness, 3).f(h.deltas_on, 1)
    if h.deltas_on:
        w.f(1, 1)
        for v in (*h.ref_deltas, *h.mode_deltas):
            w.f(1, 1).s(v, 6)
    w.f(h.base_q, 8)
    for v in (h.q_y_dc, h.q_uv_dc, h.q_uv_ac):
        w.f(v != 0, 1)
        if v:
            w.s(v, 4)
    w.f(h.seg_on, 1)
    if h.seg_on:
        w.f(h.seg_update_map, 1)
        if h.seg_update_map:
            for p in h.tree_probs:
                w.f(1, 1).f(p, 8)
            w.f(h.seg_temporal, 1)
            if h.seg_temporal:
                for p in h.pred_probs:
                    w.f(1, 1).f(p, 8)
        w.f(1, 1).f(h.absolute, 1)
        for segment in h.features:
            for value, (bits, signed) in zip(segment, FEATURE_BITS, strict=True):
                w.f(value is not None, 1)
                if value is not None:
                    if bits:
                        w.f(abs(value), bits)
                    if signed:
                        w.f(value < 0, 1)
    least, most = tile_log2_bounds(h.width)
    for _ in range(h.tile_cols_log2 - least):
        w.f(1, 1)
    if h.tile_cols_log2 < most:
        w.f(0, 1)
    w.f(h.tile_rows_log2 > 0, 1)
    if h.tile_rows_log2:
        w.f(h.tile_rows_log2 - 1, 1)
    return w.f(h.compressed_size, 16).done()


def write_compressed(h: Header, tx_mode: int = 0) -> bytes:
    """A compressed header without updates. tx_mode: up to 3 (no choice per block)."""
    e = BoolEncoder()
    if not h.lossless:
        e.literal(tx_mode, 2)
        if tx_mode == 3:
            e.literal(0, 1)
    for _ in range(spec.BIGGEST_TX[tx_mode] + 1):
        e.literal(0, 1)
    kept = 3
    if not h.intra:
        kept += 7 * 3 + (8 if h.interp_filter == spec.SWITCHABLE else 0) + 4
    for _ in range(kept):
        e.write(0, 252)
    if not h.intra:
        if h.sign_bias[2] != h.sign_bias[1] or h.sign_bias[3] != h.sign_bias[1]:
            e.literal(0, 1)
        for _ in range(10 + 36 + 48 + 3 + 2 * (1 + 10 + 1 + 10) + 2 * (6 + 3) + (4 if h.high_precision else 0)):
            e.write(0, 252)
    return e.done()


def assembled(h: Header, compressed: bytes, tiles: list[bytes]) -> bytes:
    h = copy.copy(h)
    h.compressed_size = len(compressed)
    sized = [struct.pack(">I", len(t)) + t for t in tiles[:-1]]
    return b"".join([write_header(h), compressed, *sized, tiles[-1]])


class TileWriter:
    """Writes blocks of 8x8 without coefficients in coding order, by running the decoder's own choices backwards.

    plan(row, col) gives a block's fields: segment, mode, uv_mode, ref (0: intra). All blocks
    skip. Contexts are those that such a plan leads to.
    """

    def __init__(self, h: Header, tables: Tables | None = None):
        self.h, self.tables = h, tables or load(None)

    def write(self, left: int, right: int, plan) -> bytes:
        h, e = self.h, BoolEncoder()
        modes: dict[tuple[int, int], dict] = {}
        above = [0] * (-(-h.mi_cols // 8) * 8)
        for sb_row in range(0, h.mi_rows, 8):
            side = [0] * 8
            for sb_col in range(left, right, 8):
                self._partition(e, sb_row, sb_col, 8, above, side, modes, left, plan)
        return e.done()

    def _partition(self, e, row, col, n, above, side, modes, left, plan) -> None:
        h = self.h
        if row >= h.mi_rows or col >= h.mi_cols:
            return
        half, log2 = n >> 1, n.bit_length() - 1
        bit = 1 << (3 - log2)
        ctx = log2 * 4 + 2 * any(s & bit for s in side[row % 8 : row % 8 + n]) + any(a & bit for a in above[col : col + n])
        probs = spec.KF_PARTITION[ctx] if h.intra else spec.INITIAL["partition"][ctx]
        kind = spec.NONE if n == 1 else spec.SPLIT
        has_rows, has_cols = row + half < h.mi_rows, col + half < h.mi_cols
        if has_rows and has_cols:
            e.tree(spec.PARTITION_TREE, probs, kind)
        elif has_cols:
            e.write(1, probs[1])
        elif has_rows:
            e.write(1, probs[2])
        if n > 1:
            for i in (0, half):
                for j in (0, half):
                    self._partition(e, row + i, col + j, half, above, side, modes, left, plan)
            return
        self._block(e, row, col, modes, left, plan)
        above[col] = side[row % 8] = 15 >> 1

    def _block(self, e, row, col, modes, left, plan) -> None:
        h, b = self.h, {"segment": 0, "mode": spec.DC, "uv_mode": spec.DC, "ref": 0} | plan(row, col)
        up, back = modes.get((row - 1, col)), modes.get((row, col - 1)) if col > left else None
        modes[row, col] = b
        if h.seg_on and h.seg_update_map and not h.seg_temporal:
            e.tree(spec.SEGMENT_TREE, h.tree_probs, b["segment"])
        if h.feature(b["segment"], spec.SKIP) is None:
            e.write(1, spec.INITIAL["skip"][(up is not None) + (back is not None)])
        if h.intra:
            e.tree(spec.INTRA_TREE, self.tables.kf_y_mode[up["mode"] if up else 0][back["mode"] if back else 0], b["mode"])
            e.tree(spec.INTRA_TREE, spec.KF_UV_MODE[b["mode"]], b["uv_mode"])
            return
        if h.feature(b["segment"], spec.REF_FRAME) is None:
            raise ValueError("inter plans steer the reference by a segment feature")
        if h.feature(b["segment"], spec.SKIP) is None:
            raise ValueError("inter plans steer the mode by a segment feature")


def ivf(frames: list[bytes], width: int = 16, height: int = 16, times: list[int] | None = None) -> bytes:
    """An IVF file of chunks; times: their numbers by default."""
    head = struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, b"VP90", width, height, 30, 1, len(frames), 0)
    return head + b"".join(struct.pack("<IQ", len(f), t) + f for t, f in zip(times or range(len(frames)), frames, strict=True))


def _element(name: int, body: bytes, unknown: bool = False) -> bytes:
    raw = name.to_bytes((name.bit_length() + 7) // 8, "big")
    return raw + (b"\x01" + b"\xff" * 7 if unknown else struct.pack(">Q", len(body) | 1 << 56)) + body


def webm(blocks: list[bytes], width: int, height: int, unknown: bool = False, per_cluster: int = 3) -> bytes:
    """A WebM file with a video and a sound track. unknown: segment and clusters don't tell their size. Every second block stands in a group."""
    from strandlake.kernel import containers as c

    video = _element(c.VIDEO, _element(c.PIXEL_WIDTH, struct.pack(">H", width)) + _element(c.PIXEL_HEIGHT, struct.pack(">H", height)))
    track = _element(c.TRACK, _element(c.NUMBER, b"\x01") + _element(c.KIND, b"\x01") + _element(c.CODEC, b"V_VP9") + video)
    sound = _element(c.TRACK, _element(c.NUMBER, b"\x02") + _element(c.KIND, b"\x02") + _element(c.CODEC, b"A_OPUS"))
    held = [_element(c.SIMPLE_BLOCK, b"\x81\0\0\x80" + b) if i % 2 == 0 else _element(c.GROUP, _element(c.BLOCK, b"\x81\0\0\0" + b)) for i, b in enumerate(blocks)]
    clusters = [b"".join(held[i : i + per_cluster]) + _element(c.SIMPLE_BLOCK, b"\x82\0\0\x80sound") for i in range(0, len(held), per_cluster)]
    return _element(0x1A45DFA3, b"") + _element(c.SEGMENT, _element(c.TRACKS, sound + track) + b"".join(_element(c.CLUSTER, x, unknown) for x in clusters), unknown)


def key_header(width: int = 16, height: int = 16, **fields) -> Header:
    from strandlake.kernel.headers import Color

    return Header(**({"key": True, "show": True, "resilient": True, "width": width, "height": height, "refresh": 0xFF, "color": Color()} | fields))


def frame(h: Header, plan, tables: Tables | None = None) -> bytes:
    """A whole frame of 8x8 blocks: header, empty updates, one tile per column."""
    from strandlake.kernel.tiles import tile_start

    cols = 1 << h.tile_cols_log2
    edges = [tile_start(i, h.mi_cols, h.tile_cols_log2) for i in range(cols + 1)]
    writer = TileWriter(h, tables)
    return assembled(h, write_compressed(h), [writer.write(a, b, plan) for a, b in zip(edges, edges[1:], strict=False)])


def demo_stream() -> bytes:
    """Key frame, a hidden and a shown inter frame in one chunk, and a repeated picture."""
    key = frame(key_header(), lambda r, c: {"mode": spec.V if r == 0 else spec.H, "uv_mode": spec.DC})
    steer = [[None, None, spec.LAST, 0], *[[None] * 4 for _ in range(7)]]
    inter = dict(key=False, resilient=True, width=16, height=16, refs=[0, 0, 0], interp_filter=0, seg_on=True, seg_update_map=False, features=steer)
    hidden = frame(Header(show=False, refresh=2, **inter), lambda r, c: {})
    shown = frame(Header(show=True, refresh=1, **inter), lambda r, c: {})
    from strandlake.kernel.headers import join_superframe

    return ivf([key, join_superframe([hidden, shown]), write_header(Header(show_existing=1)), key])


class Chooser(BoolDecoder):
    """Takes the place of the arithmetic decoder: draws each decision by its probability and notes it."""

    def __init__(self, draw: random.Random):
        self.draw, self.noted = draw, []

    def read(self, p: int) -> int:
        bit = int(self.draw.random() * 256 >= p)
        self.noted.append((bit, p))
        return bit

    def slack(self) -> tuple[int, int]:
        return 0, 0

    def coded(self) -> bytes:
        e = BoolEncoder()
        for bit, p in self.noted:
            e.write(bit, p)
        return e.done()


def random_stream(headers: list[Header], seed: int = 0, tables: Tables | None = None) -> tuple[list[bytes], list]:
    """A sound frame for each header with random modes, vectors, coefficients and updates, and what decoding them gave while choosing.

    Draws that the format forbids are drawn again.
    """
    from strandlake.kernel.decoder import Decoder

    draw, frames, given, decoder = random.Random(seed), [], [], Decoder(tables)
    for h in headers:
        h = copy.copy(h)
        tiles = 1 << h.tile_cols_log2 + h.tile_rows_log2
        h.compressed_size = 1
        blank = write_header(h) + b"\0" + b"\0\0\0\1\0" * (tiles - 1) + b"\0"
        while True:
            opened: list[Chooser] = []

            def choose(_, opened=opened) -> Chooser:
                opened.append(Chooser(draw))
                return opened[-1]

            trial = copy.deepcopy(decoder)
            trial.opened = choose
            try:
                given.append(trial.decode_frame(blank))
            except BitstreamError:
                continue
            break
        decoder = trial
        decoder.opened = BoolDecoder
        frames.append(assembled(h, opened[0].coded(), [c.coded() for c in opened[1:]]))
    return frames, given


def demo_headers(width: int = 72, height: int = 40, **color) -> list[Header]:
    """A key frame and inter frames with all tools: adaptation, compound and scaled prediction, segments, filter levels."""
    from strandlake.kernel.headers import Color

    profile = 0 if not color else 3 if color.get("bit_depth", 8) > 8 else 1
    common = dict(profile=profile, show=True, resilient=False, parallel=False, refresh_context=True)
    features = [[None] * 4 for _ in range(8)]
    features[1], features[2], features[3] = [-20, 10, None, None], [None, None, spec.LAST, None], [None, None, spec.GOLDEN, 0]
    inter = dict(common, key=False, refs=[0, 1, 2], sign_bias=[0, 0, 0, 1], high_precision=True)
    return [
        Header(**common, key=True, width=width, height=height, refresh=255, color=Color(**color), base_q=70, lf_level=20, sharpness=2),
        Header(**inter, width=width, height=height, refresh=1, base_q=40, lf_level=33, seg_on=True, seg_update_map=True, tree_probs=[128] * 7, features=features),
        Header(**inter, width=width, height=height, refresh=2, base_q=90, lf_level=8, deltas_on=True, ref_deltas=[2, 0, -2, -3], mode_deltas=[1, -1], seg_on=True, seg_update_map=True, seg_temporal=True, tree_probs=[100] * 7, pred_probs=[90] * 3, features=features),
        Header(**inter, width=width - 16, height=height - 8, refresh=4, base_q=0, interp_filter=2),
        Header(**dict(common, show=False), intra_only=True, width=width, height=height, refresh=8, base_q=120, color=Color(8, 1) if not profile else Color(**color), reset_context=2, context=1),
        Header(**inter, width=width, height=height, refresh=0, base_q=30, lf_level=63, context=2),
    ]
