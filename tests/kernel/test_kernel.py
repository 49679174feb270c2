"""The decoding kernel against hand-derived values, recurrences and inverse writers."""

import math

import numpy as np
import pytest

from strandlake.kernel import contexts, fixtures, loopfilter, predict, spec, transform
from strandlake.kernel.bits import BitReader, BitstreamError, BitWriter, BoolDecoder, BoolEncoder
from strandlake.kernel.decoder import Decoder
from strandlake.kernel.headers import Color, Header, Persistent, join_superframe, parse_header, split_superframe
from strandlake.kernel.tables import standin


def test_bits_round_trip():
    w = BitWriter().f(5, 3).s(-9, 6).f(1, 1).f(300, 9)
    r = BitReader(w.done())
    assert (r.f(3), r.s(6), r.flag(), r.f(9), r.f(40)) == (5, -9, True, 300, 0)


def test_bool_coder_round_trip():
    rng = np.random.default_rng(1)
    p, b = rng.integers(1, 256, 5000).tolist(), rng.integers(0, 2, 5000).tolist()
    e = BoolEncoder()
    for bit, prob in zip(b, p, strict=True):
        e.write(bit, prob)
    d = BoolDecoder(e.done())
    assert [d.read(prob) for prob in p] == b and d.slack()[0] <= 8
    with pytest.raises(BitstreamError, match="InvalidMarker"):
        BoolDecoder(b"\xff\xff")
    with pytest.raises(BitstreamError, match="EmptyBuffer"):
        BoolDecoder(b"")


@pytest.mark.parametrize("tree", [spec.PARTITION_TREE, spec.SEGMENT_TREE, spec.INTRA_TREE, spec.INTER_TREE, spec.CLASS_TREE, spec.TOKEN_TREE])
def test_trees_round_trip(tree):
    leaves = sorted(-n for n in tree if n <= 0)
    probs = [37 + 17 * i for i in range(len(tree) // 2)]
    e = BoolEncoder()
    for leaf in leaves:
        e.tree(tree, probs, leaf)
    d = BoolDecoder(e.done())
    assert [d.tree(tree, probs) for _ in leaves] == leaves


def test_superframes():
    frames = [b"abc", b"", b"x" * 300]
    assert split_superframe(join_superframe(frames)) == frames
    broken = b"abc" + bytes([0xC1, 200, 1, 0xC1])
    assert split_superframe(broken) == [broken] and split_superframe(b"") == [b""]


def test_headers_round_trip():
    features = [[None] * 4 for _ in range(8)]
    features[3] = [-12, 20, 2, 0]
    for h in (
        fixtures.key_header(700, 64, lf_level=9, sharpness=3, deltas_on=True, ref_deltas=[1, -2, 3, -4], mode_deltas=[5, -6], base_q=60, q_y_dc=-3, tile_cols_log2=1, tile_rows_log2=2),
        fixtures.key_header(profile=3, color=Color(10, 2, False, 0, 0), seg_on=True, seg_update_map=True, tree_probs=[9] * 7, absolute=True, features=features),
        Header(show=False, intra_only=True, resilient=False, reset_context=2, color=Color(8, 1), width=40, height=24, refresh=6, parallel=False, refresh_context=True, context=1),
        Header(show=True, resilient=False, width=40, height=24, refresh=3, refs=[1, 2, 7], sign_bias=[0, 1, 0, 1], high_precision=True, interp_filter=2, context=3),
    ):
        got = parse_header(fixtures.write_header(h), Persistent())
        for name in vars(h):
            if name not in ("size", "render_width", "render_height"):
                assert getattr(got, name) == getattr(h, name), name
    with pytest.raises(BitstreamError, match="InvalidFrameMarker"):
        parse_header(b"\0\0\0", Persistent())
    with pytest.raises(BitstreamError, match="InvalidSyncCode"):
        parse_header(b"\x82\0\0\0\0", Persistent())


def test_inverse_map_and_remapping():
    assert len(spec.INV_MAP) == 255 and spec.INV_MAP[:3] == [7, 20, 33] and spec.INV_MAP[19:22] == [254, 1, 2] and spec.INV_MAP[-2:] == [253, 253]
    for prob in range(1, 256):
        assert len({contexts._remapped(i, prob) for i in range(254)}) == 254


def test_merging():
    assert contexts.merged(200, 0, 0, 20, 128) == 200
    assert contexts.merged(128, 100, 0, 20, 128) == (128 * 128 + 255 * 128 + 128) >> 8


@pytest.mark.parametrize("tx", [0, 1, 2, 3])
def test_transforms_against_floats(tx):
    """Inverse DCT and ADST of single coefficients lie next to the real basis functions."""
    n = 4 << tx
    for kind in (spec.DCT_DCT, spec.ADST_DCT, spec.DCT_ADST, spec.ADST_ADST) if tx < 3 else (spec.DCT_DCT,):

        def basis(k, sine):
            if not sine:
                return [math.cos((2 * i + 1) * k * math.pi / (2 * n)) * (math.sqrt(0.5) if k == 0 else 1) for i in range(n)]
            if n == 4:
                return [math.sin((2 * k + 1) * (i + 1) * math.pi / 9) * 2 * math.sqrt(2) / 3 for i in range(n)]
            return [math.sin((2 * i + 1) * (2 * k + 1) * math.pi / (4 * n)) for i in range(n)]

        for i, j in ((0, 0), (1, 2), (3, 1), (n - 1, n - 1)):
            block = np.zeros((n, n), np.int64)
            block[i, j] = 1600
            want = 1600 * np.outer(basis(i, kind in (1, 3)), basis(j, kind in (2, 3))) / (1 << min(tx + 4, 6))
            assert np.abs(transform.inverse(block, tx, kind, False) - want).max() <= 1.5


def test_walsh_spreads_the_mean():
    block = np.zeros((4, 4), np.int64)
    block[0, 0] = 64
    assert (transform.inverse(block, 0, 0, True) == 4).all()


def recurrences(mode, n, top, left, corner):
    """The three steep modes, cell by cell."""
    s2, s3 = (lambda a, b: (a + b + 1) >> 1), (lambda a, b, c: (a + 2 * b + c + 2) >> 2)
    above = lambda k: corner if k < 0 else top[k]
    out = [[0] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if mode == spec.D135:
                if i and j:
                    v = out[i - 1][j - 1]
                elif j:
                    v = s3(above(j - 2), above(j - 1), above(j))
                elif i:
                    v = s3(corner if i == 1 else left[i - 2], left[i - 1], left[i])
                else:
                    v = s3(left[0], corner, top[0])
            elif mode == spec.D117:
                if i == 0:
                    v = s2(above(j - 1), above(j))
                elif i == 1:
                    v = s3(above(j - 2), above(j - 1), above(j)) if j else s3(left[0], corner, top[0])
                elif j:
                    v = out[i - 2][j - 1]
                else:
                    v = s3(corner, left[0], left[1]) if i == 2 else s3(left[i - 3], left[i - 2], left[i - 1])
            else:
                if j == 0:
                    v = s2(left[i - 1] if i else corner, left[i])
                elif j == 1:
                    v = s3(left[0], corner, top[0]) if i == 0 else s3(corner if i == 1 else left[i - 2], left[i - 1], left[i])
                elif i:
                    v = out[i - 1][j - 2]
                else:
                    v = s3(above(j - 3), above(j - 2), above(j - 1))
            out[i][j] = v
    return out


@pytest.mark.parametrize("mode", [spec.D135, spec.D117, spec.D153])
@pytest.mark.parametrize("tx", [0, 1, 2])
def test_steep_intra_modes(mode, tx):
    rng, n = np.random.default_rng(tx), 4 << tx
    plane = rng.integers(0, 256, (64, 64)).astype(np.uint16)
    top, left, corner = plane[15, 16 : 16 + n].tolist(), plane[16 : 16 + n, 15].tolist(), int(plane[15, 15])
    predict.intra(plane, 16, 16, True, True, False, tx, mode, 63, 63, 8)
    assert plane[16 : 16 + n, 16 : 16 + n].tolist() == recurrences(mode, n, top, left, corner)


def test_interpolation_of_whole_samples_copies():
    ref = np.random.default_rng(0).integers(0, 256, (40, 40)).astype(np.uint16)
    assert (predict.block_from(ref, 5 << 4, 7 << 4, 16, 16, 8, 8, 0, 8) == ref[7:15, 5:13]).all()
    assert (predict.block_from(np.full((9, 9), 77, np.uint16), -300, 5, 17, 32, 16, 8, 2, 8) == 77).all()
    assert all(sum(row) == 128 for f in spec.FILTERS for row in f)


def test_flat_edges_are_smoothed():
    s = np.array([[10] * 8 + [12] * 8], np.int64)
    out = loopfilter.filtered(s, 2, 20, 60, 2, 8)
    assert (np.diff(out[0]) >= 0).all() and out[0, 0] == 10 and out[0, -1] == 12
    assert (loopfilter.filtered(np.array([[0] * 4 + [255] * 4]), 0, 5, 20, 1, 8) == [[0] * 4 + [255] * 4]).all()


def test_key_frame_edges():
    """V without a row above gives 127, H without a column to the left 129."""
    stream = fixtures.frame(fixtures.key_header(), lambda r, c: {"mode": spec.V if c == 0 else spec.H, "uv_mode": spec.H})
    picture = Decoder().decode_chunk(stream)[0].picture
    y, u, _ = picture.planes
    assert y.shape == (16, 16) and u.shape == (8, 8)
    assert (y[:, :8] == 127).all() and (u == 129).all()
    high = fixtures.key_header(512, 64, profile=3, color=Color(10, 2, False, 0, 0), tile_cols_log2=1)
    picture = Decoder().decode_chunk(fixtures.frame(high, lambda r, c: {"mode": spec.V if c < 32 else spec.H, "uv_mode": spec.V if c < 32 else spec.H}))[0].picture
    assert all((p[:, :256] == 511).all() and (p[:, 256:] == 513).all() for p in picture.planes)


def steered(ref, **fields):
    features = [[None, None, ref, 0], *[[None] * 4 for _ in range(7)]]
    return Header(**({"show": True, "resilient": True, "width": 16, "height": 16, "refresh": 0, "refs": [0, 1, 2], "interp_filter": 0, "seg_on": True, "features": features} | fields))


def test_references_by_segment():
    d = Decoder()
    vertical = fixtures.frame(fixtures.key_header(), lambda r, c: {"mode": spec.V, "uv_mode": spec.V})
    d.decode_chunk(vertical)
    other = fixtures.frame(Header(intra_only=True, resilient=True, width=16, height=16, refresh=2, color=Color(8, 1)), lambda r, c: {"mode": spec.H, "uv_mode": spec.H})
    assert d.decode_chunk(other)[0].picture is None
    assert (d.decode_chunk(fixtures.frame(steered(spec.GOLDEN), lambda r, c: {}))[0].picture.planes[0] == 129).all()
    assert (d.decode_chunk(fixtures.frame(steered(spec.LAST), lambda r, c: {}))[0].picture.planes[0] == 127).all()
    chunk = join_superframe([fixtures.frame(steered(spec.LAST), lambda r, c: {}), fixtures.frame(steered(spec.GOLDEN), lambda r, c: {})])
    first, second = d.decode_chunk(chunk)
    assert first.picture is None and (second.picture.planes[0] == 129).all()
    assert (d.decode_chunk(fixtures.write_header(Header(show_existing=1)))[0].picture.planes[0] == 129).all()


def test_loop_filter_level_by_segment():
    """Rows 127 and 129 meet at y = 8."""
    plan = lambda r, c: {"mode": spec.V if r == 0 else spec.H, "uv_mode": spec.DC, "segment": 0}
    rows = {}
    for alt in (0, 63):
        features = [[None, alt, None, None], *[[None] * 4 for _ in range(7)]]
        h = fixtures.key_header(lf_level=1, seg_on=True, seg_update_map=True, tree_probs=[128] * 7, absolute=True, features=features)
        rows[alt] = Decoder().decode_chunk(fixtures.frame(h, plan))[0].picture.planes[0][:, 0].tolist()
    assert rows[0][7:9] == [127, 129]
    assert rows[63][6:10] == [128] * 4 and rows[63][5] == 127 and rows[63][10] == 129


def test_reference_sizes():
    d = Decoder()
    d.decode_chunk(fixtures.frame(fixtures.key_header(64, 256), lambda r, c: {}))
    with pytest.raises(BitstreamError, match="RefFrameSizeOutOfRange"):
        d.decode_chunk(fixtures.frame(steered(spec.LAST, width=64, height=64), lambda r, c: {}))
    d = Decoder()
    d.decode_chunk(fixtures.frame(fixtures.key_header(64, 128), lambda r, c: {}))
    picture = d.decode_chunk(fixtures.frame(steered(spec.LAST, width=64, height=64), lambda r, c: {}))[0].picture
    assert all((p == 128).all() for p in picture.planes)


def test_errors_are_named():
    d = Decoder()
    with pytest.raises(BitstreamError, match="MissingReferenceFrame"):
        d.decode_chunk(fixtures.write_header(Header(show_existing=3)))
    key = fixtures.frame(fixtures.key_header(), lambda r, c: {})
    with pytest.raises(BitstreamError, match="TruncatedFrame"):
        d.decode_chunk(key[:12])
    with pytest.raises(BitstreamError, match="MissingReference"):
        d.decode_chunk(fixtures.frame(steered(spec.LAST), lambda r, c: {}))


@pytest.mark.parametrize("seed", range(6))
def test_random_tiles_return(seed):
    """Random bytes behind a sound header decode or raise a named error; every tool gets used."""
    rng = np.random.default_rng(seed)
    d = Decoder()
    for _ in range(6):
        inter = bool(d.slots[0]) and rng.random() < 0.7
        common = dict(width=72, height=40, base_q=int(rng.integers(0, 256)), lf_level=int(rng.integers(0, 64)), resilient=False, parallel=False, refresh_context=True, show=True)
        h = Header(**common, refresh=int(rng.integers(1, 256)), refs=[0, 1, 2], sign_bias=[0, 0, 1, 0], high_precision=True) if inter else fixtures.key_header(**common)
        compressed = rng.integers(0, 128, 1, dtype=np.uint8).tobytes() + rng.integers(0, 256, 400, dtype=np.uint8).tobytes()
        tile = b"\x10" + rng.integers(0, 256, 1500, dtype=np.uint8).tobytes()
        try:
            d.decode_chunk(fixtures.assembled(h, fixtures.write_compressed(h, 0 if h.lossless else 3) if rng.random() < 0.5 else compressed, [tile]))
        except BitstreamError:
            pass


@pytest.mark.parametrize("seed, color", [(0, {}), (1, {}), (2, {"bit_depth": 10, "sx": 0, "sy": 0}), (3, {"bit_depth": 12}), (4, {"sx": 0, "sy": 0}), (5, {"sx": 1, "sy": 0}), (6, {"sx": 0, "sy": 1})])
def test_random_streams_round_trip(seed, color):
    """Streams with every tool decode to what their choices gave."""
    frames, given = fixtures.random_stream(fixtures.demo_headers(**color), seed)
    d, used = Decoder(), set()
    for data, want in zip(frames, given, strict=True):
        got = d.decode_frame(data)
        assert (got.picture is None) == (want.picture is None)
        assert got.picture is None or got.picture.i420() == want.picture.i420()
        used |= {b.mode for line in want.blocks for b in line if b}
    assert len(used) > 4


def test_tiles_and_their_order():
    h = fixtures.key_header(520, 136, resilient=False, parallel=False, refresh_context=True, base_q=50, lf_level=30, tile_cols_log2=1, tile_rows_log2=1)
    frames, given = fixtures.random_stream([h], 9)
    assert Decoder().decode_frame(frames[0]).picture.i420() == given[0].picture.i420()


def test_standin_shapes():
    assert standin().pareto_probs(2) == [100] * 8


def test_random_streams_use_all_modes():
    used = {(b.mode, b.size < spec.B8, len([r for r in b.refs if r])) for seed in range(8) for d in fixtures.random_stream(fixtures.demo_headers(136, 104), seed)[1] for line in d.blocks for b in line if b}
    assert {m for m, *_ in used} == set(range(14)) and {n for *_, n in used} == {0, 1, 2} and {s for _, s, _ in used} == {False, True}
