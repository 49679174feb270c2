"""Closed-form integer operators of the video format as Column expressions; they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest frame that is decoded, in luma samples.
MAX_SAMPLES = 1 << 27


def clip3(low, high, x) -> Column:
    return F.greatest(F.lit(low) if not isinstance(low, Column) else low, F.least(F.lit(high) if not isinstance(high, Column) else high, x))


def round2(x: Column, bits: int) -> Column:
    """x / 2^bits, halves upwards; 0 bits: x."""
    return x if bits == 0 else F.shiftright(x + (1 << (bits - 1)), bits)


def image_size(width: Column, height: Column) -> dict[str, Column]:
    """Sizes in blocks of 8 and of 64."""
    mi_cols, mi_rows = F.shiftright(width + 7, 3), F.shiftright(height + 7, 3)
    return {"mi_cols": mi_cols, "mi_rows": mi_rows, "sb64_cols": F.shiftright(mi_cols + 7, 3), "sb64_rows": F.shiftright(mi_rows + 7, 3)}


def min_log2_tile_cols(sb64_cols: Column) -> Column:
    """Least k with 64 * 2^k >= sb64_cols."""
    return F.greatest(F.lit(0), F.ceil(F.log2(sb64_cols / 64.0))).cast("int")


def max_log2_tile_cols(sb64_cols: Column) -> Column:
    """Greatest k with sb64_cols / 2^k >= 4, at least 0."""
    return F.greatest(F.lit(0), F.floor(F.log2(F.greatest(sb64_cols, F.lit(1)) / 4.0))).cast("int")


def tile_offset(tile: Column, mis: Column, log2: Column) -> Column:
    """First block of 8 of a tile."""
    sbs = F.shiftright(mis + 7, 3)
    return F.least(F.floor(tile * sbs / F.pow(F.lit(2), log2)).cast("long") * 8, mis.cast("long"))


def merge_prob(pre: Column, ct0: Column, ct1: Column, saturation: int = 20, factor: int = 128) -> Column:
    """A probability moved towards the counted one, by a weight that saturates."""
    den = ct0 + ct1
    seen = F.when(den == 0, F.lit(128)).otherwise(clip3(1, 255, F.floor((ct0 * 256 + F.shiftright(den, 1)) / F.greatest(den, F.lit(1))).cast("long")))
    weight = F.floor(factor * F.least(den, F.lit(saturation)) / saturation).cast("long")
    return F.shiftright(pre * (256 - weight) + seen * weight + 128, 8)


def qindex(base: Column, enabled: Column, absolute: Column, data: Column) -> Column:
    return F.when(enabled, clip3(0, 255, F.when(absolute, data).otherwise(base + data))).otherwise(base)


def filter_strength(level: Column, sharpness: Column, bit_depth: Column) -> dict[str, Column]:
    shift = F.when(sharpness > 4, 2).when(sharpness > 0, 1).otherwise(0)
    scaled = F.when(shift == 2, F.shiftright(level, 2)).when(shift == 1, F.shiftright(level, 1)).otherwise(level)
    limit = F.when(sharpness > 0, F.greatest(F.lit(1), F.least(9 - sharpness, scaled))).otherwise(F.greatest(scaled, F.lit(1)))
    depth = F.pow(F.lit(2), bit_depth - 8).cast("int")
    return {"lim": limit * depth, "blimit": (2 * (level + 2) + limit) * depth, "thresh": F.shiftright(level, 4) * depth}


def filter_level(frame: Column, segment: Column, ref: Column, ref_delta: Column, mode_delta: Column) -> Column:
    """Level of a segment, reference and mode; the shift comes from the frame's level, intra blocks (ref 0) have no mode delta."""
    step = F.when(F.shiftright(frame, 5) == 1, 2).otherwise(1)
    return clip3(0, 63, segment + ref_delta * step + F.when(ref == 0, 0).otherwise(mode_delta * step))


def clamp_mv(mv: Column, border: int, mi: Column, size: Column, mis: Column) -> Column:
    """A motion vector component kept within the frame's edge plus a border (eighths of a sample)."""
    return clip3(-(mi * 64) - border, (mis - size - mi) * 64 + border, mv)


def inv_recenter(v: Column, m: Column) -> Column:
    return F.when(v > 2 * m, v).when(v % 2 == 1, m - F.shiftright(v + 1, 1)).otherwise(m + F.shiftright(v, 1))


def compound_setup(last: Column, golden: Column, altref: Column) -> dict[str, Column]:
    """Fixed and variable references (1 last, 2 golden, 3 altref) from the sign biases."""
    pick = lambda a, b, c: F.when(last == golden, a).when(last == altref, b).otherwise(c)
    return {"fixed_ref": pick(3, 2, 1), "var_ref0": pick(1, 1, 2), "var_ref1": pick(2, 3, 3)}


def context_reset(key: Column, resilient: Column, reset: Column) -> Column:
    return F.when(key | resilient | (reset == 3), "all").when(reset == 2, "slot").otherwise("none")


def yuv_to_rgb(y: Column, u: Column, v: Column) -> dict[str, Column]:
    """BT.601 limited range, 8 bits."""
    c, d, e = 1.164 * (y - 16), u - 128, v - 128
    channel = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(x + 0.5))).cast("int")
    return {"r": channel(c + 1.596 * e), "g": channel(c - 0.392 * d - 0.813 * e), "b": channel(c + 2.017 * d)}


def little_endian(data: Column, at: int, size: int) -> Column:
    """An unsigned little-endian integer of `size` bytes at a 0-based place of a binary column, as decimal(20,0)."""
    raw = F.hex(F.substring(data, at + 1, size))
    turned = F.concat(*(F.substring(raw, 2 * (size - i) - 1, 2) for i in range(size)))
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def effective_context(intra: Column, resilient: Column, coded: Column) -> Column:
    """The context slot that a frame uses: the first one if it starts afresh."""
    return F.when(intra | resilient, 0).otherwise(coded)


def scaled_mv(mv: Column, bias: Column, ref_bias: Column) -> Column:
    """A candidate of another reference, turned around where the sign biases differ."""
    return F.when(bias != ref_bias, -mv).otherwise(mv)


def precise_mv(row: Column, col: Column) -> Column:
    """Whether a vector is small enough for the last bit of precision."""
    return (F.shiftright(F.abs(row), 3) < 8) & (F.shiftright(F.abs(col), 3) < 8)


def mean_mv(total: Column, n: int) -> Column:
    """A sum of n components over n, rounded to the nearest with halves away from zero."""
    size = F.floor((F.abs(total) + n // 2) / n).cast("int")
    return F.when(total < 0, -size).otherwise(size)
