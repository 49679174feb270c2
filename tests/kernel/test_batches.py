"""What is done at once gives what is done one after another."""

import numpy as np
import pytest

from strandlake.kernel import fixtures, loopfilter, predict, spec, transform
from strandlake.kernel.decoder import Decoder


@pytest.mark.parametrize("width, height, color", [(200, 136, {}), (65, 150, {}), (136, 72, {"bit_depth": 10, "sx": 1, "sy": 0}), (72, 136, {"bit_depth": 12, "sx": 0, "sy": 0})])
def test_superblocks_of_a_turn_touch_no_sample_in_common(monkeypatch, width, height, color):
    """The loop filter in waves against one superblock after another, in raster order."""
    frames, _ = fixtures.random_stream(fixtures.demo_headers(width, height, **color)[:3], 5)
    whole, calls = loopfilter.filter_frame, []

    def compared(planes, grid, h, sx, sy, depth):
        one_by_one = [p.copy() for p in planes]
        whole(one_by_one, grid, h, sx, sy, depth, turns=lambda row, col: row * 1000 + col)
        before = [p.copy() for p in planes]
        whole(planes, grid, h, sx, sy, depth)
        calls.append(any((a != b).any() for a, b in zip(planes, before, strict=True)))
        assert all((a == b).all() for a, b in zip(planes, one_by_one, strict=True))

    monkeypatch.setattr(loopfilter, "filter_frame", compared)
    decoder = Decoder()
    for f in frames:
        decoder.decode_frame(f)
    assert len(calls) == 3 and any(calls)


@pytest.mark.parametrize("tx", range(4))
def test_transforms_of_many_squares(tx):
    rng = np.random.default_rng(tx)
    n = 4 << tx
    blocks = rng.integers(-300, 300, (7, n, n)) * (rng.random((7, n, n)) < 0.2)
    for kind in range(4 if tx < 3 else 1):
        for lossless in (False, True) if tx == 0 and kind == 0 else (False,):
            together = transform.inverse(blocks, tx, kind, lossless)
            assert all((together[i] == transform.inverse(blocks[i], tx, kind, lossless)).all() for i in range(7))


@pytest.mark.parametrize("tx", range(4))
def test_a_single_first_coefficient_gives_one_sample(tx):
    n = 4 << tx
    for value in (*range(-70, 70, 9), -32768, -1000, 1023, 20000, 32767, 500000):
        block = np.zeros((n, n), np.int64)
        block[0, 0] = value
        assert (transform.inverse(block, tx, spec.DCT_DCT, False) == transform.inverse_first(value, tx)).all()


def test_plain_modes_agree_with_the_general_way(monkeypatch):
    rng = np.random.default_rng(7)
    for _ in range(200):
        tx, mode, depth = int(rng.integers(0, 4)), int(rng.choice([spec.V, spec.H, spec.DC, spec.TM])), int(rng.choice([8, 10]))
        plane = rng.integers(0, 1 << depth, (96, 96)).astype(np.uint16)
        x, y = (int(v) * (4 << tx) for v in rng.integers(0, 2, 2))
        left, above = bool(x) and bool(rng.integers(0, 2)), bool(y) and bool(rng.integers(0, 2))
        arguments = (x, y, left, above, True, tx, mode, 95, 95, depth)
        quick, general = plane.copy(), plane.copy()
        predict.intra(quick, *arguments)
        with monkeypatch.context() as m:
            m.setattr(predict, "_plain", lambda *a: False)
            predict.intra(general, *arguments)
        assert (quick == general).all()
