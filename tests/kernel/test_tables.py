"""The shipped tables: shapes (checked as they are read) and spot values of the public specification."""

from strandlake.kernel.decoder import Decoder
from strandlake.kernel.fixtures import TileWriter, key_header
from strandlake.kernel.tables import load, standin


def test_spot_values():
    t = load(None)
    assert t.kf_y_mode[0][0] == [137, 30, 42, 148, 151, 207, 70, 52, 91] and t.kf_y_mode[0][9] == [59, 67, 44, 140, 161, 202, 78, 67, 119]
    assert t.coef[0][0][0][0][:3] == [[195, 29, 183], [84, 49, 136], [8, 42, 71]] and t.coef[0][0][0][2][5] == [1, 28, 47]
    assert t.pareto[0] == [3, 86, 128, 6, 86, 23, 88, 29] and t.pareto_probs(2) == [6, 86, 128, 11, 87, 42, 91, 52]
    assert t.dc_quant[0][:6] == [4, 8, 8, 9, 10, 11] and t.dc_quant[2][252:] == [18949, 19718, 20521, 21387]
    assert t.ac_quant[0][:6] == [4, 8, 9, 10, 11, 12] and t.ac_quant[2][252:] == [27599, 28143, 28687, 29247]
    assert t.scans["default4"] == [0, 4, 1, 5, 8, 2, 12, 9, 3, 6, 13, 10, 7, 14, 11, 15]
    assert t.scans["row4"][:8] == [0, 1, 4, 2, 5, 3, 6, 8] and t.scans["col8"][:8] == [0, 8, 16, 1, 24, 9, 32, 17]


def test_quantizers_rise():
    t = load(None)
    for steps in (*t.dc_quant, *t.ac_quant):
        assert steps == sorted(steps)


def test_shipped_tables_are_the_default():
    assert Decoder().tables == TileWriter(key_header(16, 16)).tables == load(None) != standin()
