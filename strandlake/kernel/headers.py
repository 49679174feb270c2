"""Containers of frames and the uncompressed header."""

from __future__ import annotations

from dataclasses import dataclass, field

from strandlake.kernel.bits import BitReader, BitstreamError

SYNC = 0x498342


def split_superframe(chunk: bytes) -> list[bytes]:
    """The frames of a chunk. A broken index makes the whole chunk one frame; bytes between the last frame and the index are skipped."""
    if not chunk or chunk[-1] & 0xE0 != 0xC0:
        return [chunk]
    marker = chunk[-1]
    count, width = (marker & 7) + 1, (marker >> 3 & 3) + 1
    index = 2 + count * width
    if len(chunk) < index or chunk[-index] != marker:
        return [chunk]
    sizes = [int.from_bytes(chunk[-index + 1 + i * width : -index + 1 + (i + 1) * width], "little") for i in range(count)]
    if sum(sizes) > len(chunk) - index:
        return [chunk]
    frames, at = [], 0
    for size in sizes:
        frames.append(chunk[at : at + size])
        at += size
    return frames


def join_superframe(frames: list[bytes]) -> bytes:
    width = max(1, -(-max(map(len, frames)).bit_length() // 8))
    marker = bytes([0xC0 | (width - 1) << 3 | (len(frames) - 1)])
    return b"".join([*frames, marker, *(len(f).to_bytes(width, "little") for f in frames), marker])


@dataclass
class Persistent:
    """What headers carry from frame to frame."""

    ref_sizes: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)] * 8)
    ref_deltas: list[int] = field(default_factory=lambda: [1, 0, -1, -1])
    mode_deltas: list[int] = field(default_factory=lambda: [0, 0])
    features: list[list[int | None]] = field(default_factory=lambda: [[None] * 4 for _ in range(8)])
    absolute: bool = False


@dataclass
class Color:
    bit_depth: int = 8
    space: int = 0
    full_range: bool = False
    sx: int = 1
    sy: int = 1


@dataclass
class Header:
    profile: int = 0
    show_existing: int | None = None
    key: bool = False
    show: bool = False
    resilient: bool = False
    intra_only: bool = False
    reset_context: int = 0
    color: Color | None = None
    width: int = 0
    height: int = 0
    render_width: int = 0
    render_height: int = 0
    refresh: int = 0
    refs: list[int] = field(default_factory=lambda: [0, 0, 0])
    sign_bias: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    high_precision: bool = False
    interp_filter: int = 4
    refresh_context: bool = False
    parallel: bool = True
    context: int = 0
    lf_level: int = 0
    sharpness: int = 0
    deltas_on: bool = False
    ref_deltas: list[int] = field(default_factory=lambda: [1, 0, -1, -1])
    mode_deltas: list[int] = field(default_factory=lambda: [0, 0])
    base_q: int = 0
    q_y_dc: int = 0
    q_uv_dc: int = 0
    q_uv_ac: int = 0
    seg_on: bool = False
    seg_update_map: bool = False
    seg_temporal: bool = False
    tree_probs: list[int] = field(default_factory=lambda: [255] * 7)
    pred_probs: list[int] = field(default_factory=lambda: [255] * 3)
    absolute: bool = False
    features: list[list[int | None]] = field(default_factory=lambda: [[None] * 4 for _ in range(8)])
    tile_cols_log2: int = 0
    tile_rows_log2: int = 0
    compressed_size: int = 0
    size: int = 0

    @property
    def intra(self) -> bool:
        return self.key or self.intra_only

    @property
    def lossless(self) -> bool:
        return not (self.base_q or self.q_y_dc or self.q_uv_dc or self.q_uv_ac)

    @property
    def mi_cols(self) -> int:
        return (self.width + 7) >> 3

    @property
    def mi_rows(self) -> int:
        return (self.height + 7) >> 3

    def feature(self, segment: int, which: int) -> int | None:
        """The value of a segment's feature, None where it is off."""
        return self.features[segment][which] if self.seg_on else None


def tile_log2_bounds(width: int) -> tuple[int, int]:
    sbs = (width + 63) >> 6
    least = max(0, (sbs - 1).bit_length() - 6)
    return least, max(0, sbs.bit_length() - 3)


def _color(r: BitReader, profile: int) -> Color:
    depth = (12 if r.flag() else 10) if profile >= 2 else 8
    space = r.f(3)
    if space != 7:
        full = r.flag()
        if profile & 1:
            sx, sy = r.f(1), r.f(1)
            r.f(1)
        else:
            sx = sy = 1
    else:
        if not profile & 1:
            raise BitstreamError("InvalidColorConfig")
        full, sx, sy = True, 0, 0
        r.f(1)
    return Color(depth, space, full, sx, sy)


#: Coded interpolation filters.
FILTER_CODES = [1, 0, 2, 3]
#: Bits of segment features, and whether a sign follows.
FEATURE_BITS = [(8, True), (6, True), (2, False), (0, False)]


def parse_header(data: bytes, kept: Persistent) -> Header:
    """The uncompressed header of a frame; `size` is its length in bytes."""
    r, h = BitReader(data), Header()
    if r.f(2) != 2:
        raise BitstreamError("InvalidFrameMarker")
    h.profile = r.f(1) + 2 * r.f(1)
    if h.profile == 3:
        r.f(1)
    if r.flag():
        h.show_existing = r.f(3)
        h.size = r.bytes_read()
        return h
    h.key, h.show, h.resilient = not r.flag(), r.flag(), r.flag()

    def synced() -> None:
        if r.f(24) != SYNC:
            raise BitstreamError("InvalidSyncCode")

    def sized(w: int | None = None, hh: int | None = None) -> None:
        h.width, h.height = (w, hh) if w is not None else (r.f(16) + 1, r.f(16) + 1)
        h.render_width, h.render_height = (r.f(16) + 1, r.f(16) + 1) if r.flag() else (h.width, h.height)

    if h.key:
        synced()
        h.color = _color(r, h.profile)
        sized()
        h.refresh = 0xFF
    else:
        h.intra_only = not h.show and r.flag()
        h.reset_context = 0 if h.resilient else r.f(2)
        if h.intra_only:
            synced()
            h.color = _color(r, h.profile) if h.profile else Color(8, 1)
            h.refresh = r.f(8)
            sized()
        else:
            h.refresh = r.f(8)
            for i in range(3):
                h.refs[i], h.sign_bias[1 + i] = r.f(3), r.f(1)
            sized(*next((kept.ref_sizes[i] for i in h.refs if r.flag()), ()))
            h.high_precision = r.flag()
            h.interp_filter = 4 if r.flag() else FILTER_CODES[r.f(2)]
    if not h.resilient:
        h.refresh_context, h.parallel = r.flag(), r.flag()
    h.context = r.f(2)
    fresh = Persistent() if h.intra or h.resilient else kept

    h.lf_level, h.sharpness, h.deltas_on = r.f(6), r.f(3), r.flag()
    h.ref_deltas, h.mode_deltas = list(fresh.ref_deltas), list(fresh.mode_deltas)
    if h.deltas_on and r.flag():
        for deltas in (h.ref_deltas, h.mode_deltas):
            for i in range(len(deltas)):
                if r.flag():
                    deltas[i] = r.s(6)

    h.base_q = r.f(8)
    h.q_y_dc, h.q_uv_dc, h.q_uv_ac = (r.s(4) if r.flag() else 0 for _ in range(3))

    h.seg_on = r.flag()
    h.features, h.absolute = [list(f) for f in fresh.features], fresh.absolute
    if h.seg_on:
        prob = lambda: r.f(8) if r.flag() else 255
        h.seg_update_map = r.flag()
        if h.seg_update_map:
            h.tree_probs = [prob() for _ in range(7)]
            h.seg_temporal = r.flag()
            if h.seg_temporal:
                h.pred_probs = [prob() for _ in range(3)]
        if r.flag():
            h.absolute = r.flag()
            for segment in h.features:
                for i, (bits, signed) in enumerate(FEATURE_BITS):
                    segment[i] = None
                    if r.flag():
                        value = r.f(bits) if bits else 0
                        segment[i] = -value if signed and r.flag() else value

    least, most = tile_log2_bounds(h.width)
    h.tile_cols_log2 = least
    while h.tile_cols_log2 < most and r.flag():
        h.tile_cols_log2 += 1
    h.tile_rows_log2 = r.f(1)
    if h.tile_rows_log2:
        h.tile_rows_log2 += r.f(1)
    h.compressed_size = r.f(16)
    h.size = r.bytes_read()
    return h
