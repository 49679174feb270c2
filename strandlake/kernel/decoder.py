"""The decoder of one stream: frames in, pictures and facts out, state kept between them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from strandlake.kernel import contexts, loopfilter
from strandlake.kernel.bits import BitstreamError, BoolDecoder
from strandlake.kernel.headers import Color, Header, Persistent, parse_header, split_superframe
from strandlake.kernel.tables import Tables, load
from strandlake.kernel.tiles import FrameDecoder, Reference

MAX_SAMPLES = 1 << 27


@dataclass
class Picture:
    """A shown frame: planes cut to its size, uint8 at 8 bits, else uint16."""

    width: int
    height: int
    color: Color
    planes: list[np.ndarray]

    def i420(self) -> bytes:
        """Y, U, V one after the other; wider samples as 16 bits, little-endian."""
        return b"".join(p.tobytes() for p in self.planes)


@dataclass
class Decoded:
    """What a frame gave: its header (None for a repeated picture) and picture (None if hidden or superseded in its chunk)."""

    header: Header | None
    picture: Picture | None
    blocks: list | None = None


def cut(planes: list[np.ndarray], width: int, height: int, color: Color) -> list[np.ndarray]:
    return [planes[0][:height, :width], *(p[: (height + color.sy) >> color.sy, : (width + color.sx) >> color.sx] for p in planes[1:])]


class Decoder:
    """Decodes a stream's chunks in order; see decode_chunk(). An error leaves the state that the frame had reached."""

    def __init__(self, tables: Tables | None = None, opened=BoolDecoder):
        """opened: makes the arithmetic decoder of some bytes."""
        self.tables, self.opened = tables or load(None), opened
        self.kept = Persistent()
        self.contexts = [contexts.initial(self.tables) for _ in range(4)]
        self.color: Color | None = None
        self.slots: list[Reference | None] = [None] * 8
        self.size: tuple[int, int] | None = None
        self.shown = False
        self.grid: list | None = None
        self.segments: np.ndarray | None = None
        self.after_key = False

    def decode_chunk(self, chunk: bytes) -> list[Decoded]:
        """All frames of a chunk; only the last shown one keeps its picture. The first error ends the chunk."""
        out = [self.decode_frame(f) for f in split_superframe(chunk)]
        shown = [d for d in out if d.picture is not None]
        for d in shown[:-1]:
            d.picture = None
        return out

    def headers_only(self, chunk: bytes) -> list[Header]:
        """The headers of a chunk, as if all its frames decoded well."""
        out = []
        for data in split_superframe(chunk):
            h = parse_header(data, self.kept)
            if h.show_existing is None:
                self._keep_header(h)
            out.append(h)
        return out

    def _keep_header(self, h: Header) -> None:
        k = self.kept
        k.ref_sizes = [(h.width, h.height) if h.refresh >> i & 1 else s for i, s in enumerate(k.ref_sizes)]
        k.ref_deltas, k.mode_deltas, k.features, k.absolute = h.ref_deltas, h.mode_deltas, h.features, h.absolute

    def _picture(self, ref: Reference) -> Picture:
        kind = np.uint8 if ref.color.bit_depth == 8 else np.dtype("<u2")
        return Picture(ref.width, ref.height, ref.color, [np.ascontiguousarray(p, dtype=kind) for p in ref.planes])

    def decode_frame(self, data: bytes) -> Decoded:
        h = parse_header(data, self.kept)
        if h.show_existing is not None:
            if self.slots[h.show_existing] is None:
                raise BitstreamError("MissingReferenceFrame")
            return Decoded(None, self._picture(self.slots[h.show_existing]))
        color = h.color or self.color or Color()
        if h.intra:
            self.color = color
        end = h.size + h.compressed_size
        if end > len(data):
            raise BitstreamError("TruncatedFrame")
        fresh = h.intra or h.resilient
        moving = not fresh and self.size == (h.width, h.height) and self.shown
        if h.width * h.height > MAX_SAMPLES:
            raise BitstreamError("FrameSizeTooLarge")
        if fresh or self.size != (h.width, h.height):
            self.segments = np.zeros((h.mi_rows, h.mi_cols), np.uint8)
        if fresh:
            if h.key or h.resilient or h.reset_context == 3:
                self.contexts = [contexts.initial(self.tables) for _ in range(4)]
            elif h.reset_context == 2:
                self.contexts[h.context] = contexts.initial(self.tables)
        slot = 0 if fresh else h.context
        start = self.contexts[slot]
        compressed = contexts.parse_compressed(data[h.size : end], h, start, self.opened)
        refs = [None] * 3 if h.intra else [self.slots[i] for i in h.refs]
        for r in refs:
            if r is not None and (r.color.bit_depth, r.color.sx, r.color.sy) != (color.bit_depth, color.sx, color.sy):
                raise BitstreamError("RefFrameFormatMismatch")
        frame = FrameDecoder(h, color, compressed, self.tables, refs, self.grid if moving else None, self.segments, self.opened)
        frame.decode(data[end:])
        if h.lf_level:
            loopfilter.filter_frame(frame.planes, frame.grid, h, color.sx, color.sy, color.bit_depth)
        if h.seg_on and h.seg_update_map:
            self.segments = np.array([[b.segment for b in line[: h.mi_cols]] for line in frame.grid[: h.mi_rows]], np.uint8)
        if h.refresh_context:
            self.contexts[slot] = contexts.refreshed(h, start, compressed, frame.counts, self.after_key)
        made = Reference([p.copy() for p in cut(frame.planes, h.width, h.height, color)], h.width, h.height, color)
        self.slots = [made if h.refresh >> i & 1 else s for i, s in enumerate(self.slots)]
        self._keep_header(h)
        self.size, self.shown, self.after_key, self.grid = (h.width, h.height), h.show, h.key, frame.grid
        return Decoded(h, self._picture(made) if h.show else None, frame.grid)
