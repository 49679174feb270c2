"""The decoder's own formulas and the Column expressions that the SQL checks are one and the same: both on the same random arguments."""

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import arith
from strandlake.kernel import containers, contexts, fixtures, headers, loopfilter, predict, spec, tiles
from strandlake.kernel.decoder import Picture
from strandlake.kernel.headers import Color, Header


def both(spark, names, rows, columns, plain):
    """The Column expressions and the plain function give equal tuples."""
    table = spark.createDataFrame([tuple(map(int, r)) for r in rows], ", ".join(f"{n} int" for n in names))
    got = [tuple(int(x) for x in r) for r in table.select(*columns).collect()]
    assert got == [tuple(int(x) for x in plain(*r)) for r in rows]


@pytest.fixture()
def draw():
    return random.Random(11)


def test_filter_strength(spark, draw):
    rows = [(draw.randrange(64), draw.randrange(8), draw.choice((8, 10, 12))) for _ in range(300)]
    out = arith.filter_strength(F.col("l"), F.col("s"), F.col("d"))
    both(spark, "lsd", rows, [out["lim"], out["blimit"], out["thresh"]], loopfilter.strength)


def test_filter_levels(spark, draw):
    rows = []
    for _ in range(60):
        h = Header(key=True, lf_level=draw.randrange(1, 64), deltas_on=True, ref_deltas=[draw.randrange(-63, 64) for _ in range(4)], mode_deltas=[draw.randrange(-63, 64) for _ in range(2)])
        table = loopfilter.levels(h)
        rows += [(h.lf_level, ref, h.ref_deltas[ref], h.mode_deltas[mode], table[0][ref][mode]) for ref in range(4) for mode in range(2)]
    both(spark, "frmdw", rows, [arith.filter_level(F.col("f"), F.col("f"), F.col("r"), F.col("m"), F.col("d"))], lambda f, r, m, d, w: (w,))


@pytest.mark.parametrize("saturation, factor", [(20, 128), (24, 112), (24, 128)])
def test_merged_probabilities(spark, draw, saturation, factor):
    rows = [(draw.randrange(1, 256), draw.choice((0, draw.randrange(50))), draw.choice((0, draw.randrange(5000)))) for _ in range(300)]
    both(spark, "pab", rows, [arith.merge_prob(F.col("p"), F.col("a"), F.col("b"), saturation, factor)], lambda p, a, b: (contexts.merged(p, a, b, saturation, factor),))


def test_tiles(spark, draw):
    rows = [(t, mis, log2) for mis in [*range(1, 80), *(draw.randrange(80, 8192) for _ in range(80))] for log2 in range(4) for t in (0, 1 << log2, draw.randrange(1 << log2))]
    both(spark, "tml", rows, [arith.tile_offset(F.col("t"), F.col("m"), F.col("l"))], lambda t, m, l: (tiles.tile_start(t, m, l),))
    widths = [(w,) for w in [*range(1, 600), *(draw.randrange(600, 65536) for _ in range(200))]]
    sbs = arith.image_size(F.col("w"), F.col("w"))["sb64_cols"]
    both(spark, "w", widths, [arith.min_log2_tile_cols(sbs), arith.max_log2_tile_cols(sbs)], headers.tile_log2_bounds)
    size = arith.image_size(F.col("w"), F.col("w"))
    both(spark, "w", widths, [size["mi_cols"], size["mi_rows"]], lambda w: (Header(width=w).mi_cols, Header(height=w).mi_rows))


def test_motion_vectors(spark, draw):
    rows = [(draw.randrange(-3000, 3000), draw.randrange(-3000, 3000)) for _ in range(300)] + [(a, b) for a in range(-70, 70, 3) for b in (-64, -63, 0, 63, 64)]
    both(spark, "ab", rows, [arith.mean_mv(F.col("a"), 2), arith.mean_mv(F.col("a"), 4), arith.precise_mv(F.col("a"), F.col("b")).cast("int")], lambda a, b: (predict.towards_zero(a, 2), predict.towards_zero(a, 4), tiles.FrameDecoder.small((a, b))))
    frame = tiles.FrameDecoder.__new__(tiles.FrameDecoder)
    frame.h = Header(width=544, height=360)
    rows = [(draw.randrange(-20000, 20000), draw.randrange(68), draw.randrange(13)) for _ in range(300)]

    def kept(mv, at, size):
        frame.row, frame.col = 0, at
        return (frame.within((0, mv), size, 1248)[1],)

    extent = F.element_at(F.array(*(F.lit(spec.WIDE8[s]) for s in range(13))), F.col("s") + 1)
    both(spark, "vms", rows, [arith.clamp_mv(F.col("v"), 1248, F.col("m"), extent, F.lit(68))], kept)


def test_recentred_differences(spark):
    """Below the middle the decoder's remapping is the recentred value itself."""
    rows = [(i, p, spec.INV_MAP[i], p - 1) for i in range(0, len(spec.INV_MAP), 3) for p in range(1, 129, 5)]
    both(spark, "ipvm", rows, [arith.inv_recenter(F.col("v"), F.col("m")) + 1], lambda i, p, v, m: (contexts._remapped(i, p),))


def test_segment_quantizers(spark, draw):
    from strandlake.kernel.tables import load

    table = load(None)
    rows = []
    for _ in range(100):
        base, absolute, value = draw.randrange(256), draw.randrange(2), draw.randrange(-255, 256)
        features = [[value, None, None, None], *[[None] * 4 for _ in range(7)]]
        h = fixtures.key_header(base_q=base, seg_on=True, absolute=bool(absolute), features=features)
        frame = tiles.FrameDecoder(h, Color(), contexts.Compressed(0, contexts.initial(table)), table, [None] * 3, None, None)
        rows += [(base, 1, absolute, value, frame.quant[0][0][1]), (base, 0, absolute, value, frame.quant[1][0][1])]
    index = arith.qindex(F.col("b"), F.col("e") == 1, F.col("a") == 1, F.col("v"))
    steps = F.array(*(F.lit(x) for x in table.ac_quant[0]))
    both(spark, "beavw", rows, [F.element_at(steps, (index + 1).cast("int"))], lambda b, e, a, v, w: (w,))


def test_colours(spark, draw):
    import numpy as np

    rows = [(draw.randrange(256), draw.randrange(256), draw.randrange(256)) for _ in range(500)]
    out = arith.yuv_to_rgb(F.col("y"), F.col("u"), F.col("v"))

    def plain(y, u, v):
        plane = lambda x, n: np.full((n, n), x, np.uint8)
        return containers.rgb(Picture(2, 2, Color(), [plane(y, 2), plane(u, 1), plane(v, 1)]))[0, 0].tolist()

    table = spark.createDataFrame(rows, "y int, u int, v int").select(out["r"], out["g"], out["b"]).collect()
    # single and double precision round a value in some thousands apart
    assert sum(abs(int(a) - b) for r, row in zip(table, rows, strict=True) for a, b in zip(r, plain(*row), strict=True)) <= 2
