"""Byte containers: IVF both ways, WebM reading, PNG writing."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from strandlake.kernel.decoder import Picture


class ContainerError(ValueError):
    pass


@dataclass
class IvfHeader:
    version: int
    header_length: int
    fourcc: str
    width: int
    height: int
    tb_den: int
    tb_num: int
    frame_count: int


def ivf_header(data: bytes) -> IvfHeader:
    """Fields of an IVF file; version, four-character code and frame count are not judged."""
    if len(data) < 32:
        raise ContainerError("TooShort")
    magic, version, length, code, width, height, den, num, count, _ = struct.unpack_from("<4sHH4sHHIIII", data)
    if magic != b"DKIF":
        raise ContainerError("InvalidMagic")
    if length < 32 or length > len(data):
        raise ContainerError("InvalidHeaderLength")
    return IvfHeader(version, length, code.decode("latin-1"), width, height, den, num, count)


def ivf_chunks(data: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(time, bytes) of the records from the header's end on; a truncated one gives (0, None) and is the last."""
    at = ivf_header(data).header_length
    while at < len(data):
        if at + 12 > len(data):
            yield 0, None
            return
        size, time = struct.unpack_from("<IQ", data, at)
        if at + 12 + size > len(data):
            yield 0, None
            return
        yield time, data[at + 12 : at + 12 + size]
        at += 12 + size


def write_ivf(chunks: list[bytes], width: int, height: int, den: int = 30, num: int = 1) -> bytes:
    head = struct.pack("<4sHH4sHHIIII", b"DKIF", 0, 32, b"VP90", width, height, den, num, len(chunks), 0)
    return head + b"".join(struct.pack("<IQ", len(c), i) + c for i, c in enumerate(chunks))


# Element ids of WebM.
SEGMENT, TRACKS, TRACK, NUMBER, KIND, CODEC, VIDEO, PIXEL_WIDTH, PIXEL_HEIGHT, CLUSTER, SIMPLE_BLOCK, GROUP, BLOCK = (
    0x18538067, 0x1654AE6B, 0xAE, 0xD7, 0x83, 0x86, 0xE0, 0xB0, 0xBA, 0x1F43B675, 0xA3, 0xA0, 0xA1,
)
#: Ids that stand directly below a segment: one of them ends a cluster of unknown size.
TOP_LEVEL = {CLUSTER, TRACKS, 0x114D9B74, 0x1549A966, 0x1C53BB6B, 0x1941A469, 0x1043A770, 0x1254C367}


def _vint(data: bytes, at: int, end: int, keep_marker: bool) -> tuple[int | None, int]:
    """A variable-length integer and where it ends; all ones without the marker: None (unknown)."""
    if at >= end or not data[at]:
        raise ContainerError("InvalidVint")
    length = 9 - data[at].bit_length()
    if at + length > end or keep_marker and length > 4:
        raise ContainerError("InvalidVint")
    value = int.from_bytes(data[at : at + length], "big")
    if not keep_marker:
        value &= (1 << 7 * length) - 1
        if value == (1 << 7 * length) - 1:
            value = None
    return value, at + length


def _elements(data: bytes, at: int, end: int, until: set[int] = frozenset()) -> Iterator[tuple[int, int, int, bool]]:
    """(id, start, end, size known) of the elements between two places; ends before an id of `until`."""
    while at < end:
        name, body = _vint(data, at, end, True)
        if name in until:
            return
        size, body = _vint(data, body, end, False)
        stop = end if size is None else body + size
        if stop > end:
            raise ContainerError("ElementTooLong")
        if size is None and name == CLUSTER:
            inner = list(_elements(data, body, end, TOP_LEVEL))
            stop = inner[-1][2] if inner else body
        yield name, body, stop, size is not None
        at = stop


def webm_chunks(data: bytes) -> tuple[int, int, list[bytes]]:
    """Width, height and the blocks of the first VP9 video track, clusters in file order."""
    segment = next(((a, b) for name, a, b, _ in _elements(data, 0, len(data)) if name == SEGMENT), None)
    if segment is None:
        raise ContainerError("NoSegment")
    found, chunks = None, []
    for name, a, b, _ in _elements(data, *segment):
        if name == TRACKS and found is None:
            for t, c, d, _ in _elements(data, a, b):
                fields = {k: (e, f) for k, e, f, _ in _elements(data, c, d)} if t == TRACK else {}
                number = lambda k, fields=fields: int.from_bytes(data[slice(*fields[k])], "big")
                if found is None and {NUMBER, KIND, CODEC, VIDEO} <= set(fields) and number(KIND) == 1 and data[slice(*fields[CODEC])].rstrip(b"\0") == b"V_VP9":
                    sizes = {k: int.from_bytes(data[e:f], "big") for k, e, f, _ in _elements(data, *fields[VIDEO])}
                    if max(sizes.get(PIXEL_WIDTH, 0), sizes.get(PIXEL_HEIGHT, 0)) > 0xFFFF:
                        raise ContainerError("DimensionsTooLarge")
                    found = (number(NUMBER), sizes.get(PIXEL_WIDTH, 0), sizes.get(PIXEL_HEIGHT, 0))
        elif name == CLUSTER:
            if found is None:
                raise ContainerError("NoTrack")
            blocks = []
            for k, c, d, _ in _elements(data, a, b):
                blocks += [(c, d)] if k == SIMPLE_BLOCK else [(e, f) for g, e, f, _ in _elements(data, c, d) if g == BLOCK] if k == GROUP else []
            for c, d in blocks:
                track, at = _vint(data, c, d, False)
                if at + 3 > d:
                    raise ContainerError("BlockTooShort")
                if track == found[0]:
                    if data[at + 2] & 0x06:
                        raise ContainerError("LacedBlock")
                    chunks.append(data[at + 3 : d])
    if found is None:
        raise ContainerError("NoTrack")
    return found[1], found[2], chunks


def rgb(picture: Picture) -> np.ndarray:
    """BT.601 limited range with repeated chroma, for 8-bit pictures of halved chroma."""
    c = picture.color
    if (c.bit_depth, c.sx, c.sy) != (8, 1, 1):
        raise ValueError("8-bit 4:2:0 pictures only")
    y, u, v = (p.astype(np.float32) for p in picture.planes)
    u, v = (np.repeat(np.repeat(p, 2, 0), 2, 1)[: y.shape[0], : y.shape[1]] - np.float32(128) for p in (u, v))
    y = np.float32(1.164) * (y - np.float32(16))
    out = np.stack([y + np.float32(1.596) * v, y - np.float32(0.392) * u - np.float32(0.813) * v, y + np.float32(2.017) * u], axis=-1)
    return np.clip(np.floor(out + np.float32(0.5)), 0, 255).astype(np.uint8)


def png(picture: Picture) -> bytes:
    """An RGB file without filters and compression."""
    pixels = rgb(picture)
    rows = np.concatenate([np.zeros((pixels.shape[0], 1), np.uint8), pixels.reshape(pixels.shape[0], -1)], axis=1)

    def part(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", picture.width, picture.height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes(), 0)) + part(b"IEND", b"")
