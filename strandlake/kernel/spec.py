"""Constants of the format. Tables over 200 entries are built from rules, or come from a file; see tables.py."""

from __future__ import annotations

# block sizes by width and height in units of 4 samples
SIZES = [(1, 1), (1, 2), (2, 1), (2, 2), (2, 4), (4, 2), (4, 4), (4, 8), (8, 4), (8, 8), (8, 16), (16, 8), (16, 16)]
B8, B16, B64 = SIZES.index((2, 2)), SIZES.index((4, 4)), SIZES.index((16, 16))
WIDE8 = [max(1, w // 2) for w, _ in SIZES]
HIGH8 = [max(1, h // 2) for _, h in SIZES]
LARGEST_TX = [min(w, h).bit_length() - 1 if min(w, h) < 8 else 3 for w, h in SIZES]
NONE, HORZ, VERT, SPLIT = range(4)


def sub_size(partition: int, size: int) -> int | None:
    """The size of the parts, None where a block can't be parted so."""
    w, h = SIZES[size]
    if partition == NONE:
        return size
    if w != h or w < 2:
        return None
    return SIZES.index((w if partition == HORZ else w // 2, h if partition == VERT else h // 2))


def plane_size(size: int, sx: int, sy: int) -> int | None:
    """The size of a block in a subsampled plane, None if there is none."""
    shape = (SIZES[size][0] >> sx, SIZES[size][1] >> sy)
    return SIZES.index(shape) if shape in SIZES else None


def uv_tx(size: int, tx: int, sx: int, sy: int) -> int:
    return 0 if size < B8 else min(tx, LARGEST_TX[plane_size(size, sx, sy)])


# intra modes, then inter modes
DC, V, H, D45, D135, D117, D153, D207, D63, TM, NEAREST, NEAR, ZERO, NEW = range(14)
INTRA, LAST, GOLDEN, ALTREF = range(4)
SINGLE, COMPOUND, SELECT = range(3)
SWITCHABLE, TX_SELECT = 4, 4
BIGGEST_TX = [0, 1, 2, 3, 3]
# transform types: of columns and rows
DCT_DCT, ADST_DCT, DCT_ADST, ADST_ADST = range(4)
TX_TYPE = [DCT_DCT, ADST_DCT, DCT_ADST, DCT_DCT, ADST_ADST, ADST_DCT, DCT_ADST, DCT_ADST, ADST_DCT, ADST_ADST, DCT_DCT, DCT_DCT, DCT_DCT, DCT_DCT]
ALT_Q, ALT_L, REF_FRAME, SKIP = range(4)

# Code trees (a leaf is 0 or negative).
PARTITION_TREE = [-NONE, 2, -HORZ, 4, -VERT, -SPLIT]
SEGMENT_TREE = [2, 4, 6, 8, 10, 12, 0, -1, -2, -3, -4, -5, -6, -7]
INTRA_TREE = [-DC, 2, -TM, 4, -V, 6, 8, 12, -H, 10, -D135, -D117, -D45, 14, -D63, 16, -D153, -D207]
TX_TREES = [[], [0, -1], [0, 2, -1, -2], [0, 2, -1, 4, -2, -3]]
INTER_TREE = [-(ZERO - NEAREST), 2, 0, 4, -(NEAR - NEAREST), -(NEW - NEAREST)]
FILTER_TREE = [0, 2, -1, -2]
JOINT_TREE = [0, 2, -1, 4, -2, -3]
CLASS_TREE = [0, 2, -1, 4, 6, 8, -2, -3, 10, 12, -4, -5, -6, 14, 16, 18, -7, -8, -9, -10]
FRACTION_TREE = [0, 2, -1, 4, -2, -3]
TOKEN_TREE = [0, 2, -1, 4, 6, 10, -2, 8, -3, -4, 12, 14, -5, -6, 16, 18, -7, -8, -9, -10]
# zero, one, more: what tokens count as
COUNTED_TOKEN_TREE = [0, 2, -1, -2]

# Probabilities of intra frames.
KF_PARTITION = [
    [158, 97, 94], [93, 24, 99], [85, 119, 44], [62, 59, 67], [149, 53, 53], [94, 20, 48], [83, 53, 24], [52, 18, 18],
    [150, 40, 39], [78, 12, 26], [67, 33, 11], [24, 7, 5], [174, 35, 49], [68, 11, 27], [57, 15, 9], [12, 3, 3],
]
KF_UV_MODE = [
    [144, 11, 54, 157, 195, 130, 46, 58, 108], [118, 15, 123, 148, 131, 101, 44, 93, 131], [113, 12, 23, 188, 226, 142, 26, 32, 125],
    [120, 11, 50, 123, 163, 135, 64, 77, 103], [113, 9, 36, 155, 111, 157, 32, 44, 161], [116, 9, 55, 176, 76, 96, 37, 61, 149],
    [115, 9, 28, 141, 161, 167, 21, 25, 193], [120, 12, 32, 145, 195, 142, 32, 38, 86], [116, 12, 64, 120, 140, 125, 49, 115, 121],
    [102, 19, 66, 162, 182, 122, 35, 59, 128],
]

# Initial probabilities of a frame context (all but those of coefficients).
INITIAL = {
    "uv_mode": [
        [120, 7, 76, 176, 208, 126, 28, 54, 103], [48, 12, 154, 155, 139, 90, 34, 117, 119], [67, 6, 25, 204, 243, 158, 13, 21, 96],
        [97, 5, 44, 131, 176, 139, 48, 68, 97], [83, 5, 42, 156, 111, 152, 26, 49, 152], [80, 5, 58, 178, 74, 83, 33, 62, 145],
        [86, 5, 32, 154, 192, 168, 14, 22, 163], [85, 5, 32, 156, 216, 148, 19, 29, 73], [77, 7, 64, 116, 132, 122, 37, 126, 120],
        [101, 21, 107, 181, 192, 103, 19, 67, 125],
    ],
    "tx1": [[100], [66]],
    "tx2": [[20, 152], [15, 101]],
    "tx3": [[3, 136, 37], [5, 52, 13]],
    "skip": [192, 128, 64],
    "inter_mode": [[2, 173, 34], [7, 145, 85], [7, 166, 63], [7, 94, 66], [8, 64, 46], [17, 81, 31], [25, 29, 30]],
    "interp_filter": [[235, 162], [36, 255], [34, 3], [149, 144]],
    "is_inter": [9, 102, 187, 225],
    "comp_mode": [239, 183, 119, 96, 41],
    "single_ref": [[33, 16], [77, 74], [142, 142], [172, 170], [238, 247]],
    "comp_ref": [50, 126, 123, 221, 226],
    "y_mode": [[65, 32, 18, 144, 162, 194, 41, 51, 98], [132, 68, 18, 165, 217, 196, 45, 40, 78], [173, 80, 19, 176, 240, 193, 64, 35, 46], [221, 135, 38, 194, 248, 121, 96, 85, 29]],
    "partition": [
        [199, 122, 141], [147, 63, 159], [148, 133, 118], [121, 104, 114], [174, 73, 87], [92, 41, 83], [82, 99, 50], [53, 39, 39],
        [177, 58, 59], [68, 26, 63], [52, 79, 25], [17, 14, 12], [222, 34, 30], [72, 16, 44], [58, 32, 12], [10, 7, 6],
    ],
    "mv_joint": [32, 64, 96],
    "mv_sign": [128, 128],
    "mv_class": [[224, 144, 192, 168, 192, 176, 192, 198, 198, 245], [216, 128, 176, 160, 176, 176, 192, 198, 198, 208]],
    "mv_class0": [216, 208],
    "mv_bits": [[136, 140, 148, 160, 176, 192, 224, 234, 234, 240], [136, 140, 148, 160, 176, 192, 224, 234, 234, 240]],
    "mv_class0_fr": [[[128, 128, 64], [96, 112, 64]], [[128, 128, 64], [96, 112, 64]]],
    "mv_fr": [[64, 96, 64], [64, 96, 64]],
    "mv_class0_hp": [160, 160],
    "mv_hp": [128, 128],
}

# Tokens of coefficients.
BAND_4X4 = [0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 5, 5, 5]
BAND_LARGER = [0, 1, 1, 2, 2, 2, 3, 3, 3, 3, *[4] * 11]  # then 5
ENERGY = [0, 1, 2, 3, 3, 4, 4, 5, 5, 5, 5]
TOKEN_BASE = [0, 1, 2, 3, 4, 5, 7, 11, 19, 35, 67]
EXTRA_BIT_PROBS = [[], [], [], [], [], [159], [165, 145], [173, 148, 140], [176, 155, 140, 135], [180, 157, 141, 134, 130], [254, 254, 254, 252, 249, 243, 230, 196, 177, 153, 140, 133, 130, 129]]

# Where candidates for motion vectors are looked up, as (row, column) offsets per block size.
_SMALL = [(-1, 0), (0, -1), (-1, -1), (-2, 0), (0, -2), (-2, -1), (-1, -2), (-2, -2)]
MV_CANDIDATES = [
    _SMALL, _SMALL, _SMALL, _SMALL,
    [(0, -1), (-1, 0), (1, -1), (-1, -1), (0, -2), (-2, 0), (-2, -1), (-1, -2)],
    [(-1, 0), (0, -1), (-1, 1), (-1, -1), (-2, 0), (0, -2), (-1, -2), (-2, -1)],
    [(-1, 0), (0, -1), (-1, 1), (1, -1), (-1, -1), (-3, 0), (0, -3), (-3, -3)],
    [(0, -1), (-1, 0), (2, -1), (-1, -1), (-1, 1), (0, -3), (-3, 0), (-3, -3)],
    [(-1, 0), (0, -1), (-1, 2), (-1, -1), (1, -1), (-3, 0), (0, -3), (-3, -3)],
    [(-1, 1), (1, -1), (-1, 2), (2, -1), (-1, -1), (-3, 0), (0, -3), (-3, -3)],
    [(0, -1), (-1, 0), (4, -1), (-1, 2), (-1, -1), (0, -3), (-3, 0), (2, -1)],
    [(-1, 0), (0, -1), (-1, 4), (2, -1), (-1, -1), (-3, 0), (0, -3), (-1, 2)],
    [(-1, 3), (3, -1), (-1, 4), (4, -1), (-1, -1), (-1, 0), (0, -1), (-1, 6)],
]
MODE_COUNTER = [9, 9, 9, 9, 9, 9, 9, 9, 9, 9, 0, 0, 3, 1]
COUNTER_CONTEXT = [2, 3, 4, 1, 3, 9, 0, 9, 9, 5, 5, 9, 5, 9, 9, 9, 9, 9, 6]
SUB_BLOCK = [[1, 2], [1, 3], [3, 2], [3, 3]]
SIZE_GROUP = [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 3]

# The first half of the interpolation filters' positions (0 to 8 sixteenths).
_HALF_FILTERS = [
    [[0, 0, 0, 128, 0, 0, 0, 0], [0, 1, -5, 126, 8, -3, 1, 0], [-1, 3, -10, 122, 18, -6, 2, 0], [-1, 4, -13, 118, 27, -9, 3, -1], [-1, 4, -16, 112, 37, -11, 4, -1],
     [-1, 5, -18, 105, 48, -14, 4, -1], [-1, 5, -19, 97, 58, -16, 5, -1], [-1, 6, -19, 88, 68, -18, 5, -1], [-1, 6, -19, 78, 78, -19, 6, -1]],
    [[0, 0, 0, 128, 0, 0, 0, 0], [-3, -1, 32, 64, 38, 1, -3, 0], [-2, -2, 29, 63, 41, 2, -3, 0], [-2, -2, 26, 63, 43, 4, -4, 0], [-2, -3, 24, 62, 46, 5, -4, 0],
     [-2, -3, 21, 60, 49, 7, -4, 0], [-1, -4, 18, 59, 51, 9, -4, 0], [-1, -4, 16, 57, 53, 12, -4, -1], [-1, -4, 14, 55, 55, 14, -4, -1]],
    [[0, 0, 0, 128, 0, 0, 0, 0], [-1, 3, -7, 127, 8, -3, 1, 0], [-2, 5, -13, 125, 17, -6, 3, -1], [-3, 7, -17, 121, 27, -10, 5, -2], [-4, 9, -20, 115, 37, -13, 6, -2],
     [-4, 10, -23, 108, 48, -16, 8, -3], [-4, 10, -24, 100, 59, -19, 9, -3], [-4, 11, -24, 90, 70, -21, 10, -4], [-4, 11, -23, 80, 80, -23, 11, -4]],
]
#: All positions: the second half mirrors the first; the last filter is linear.
FILTERS = [[*half, *(row[::-1] for row in reversed(half[1:8]))] for half in _HALF_FILTERS]
FILTERS.append([[0, 0, 0, 128 - 8 * i, 8 * i, 0, 0, 0] for i in range(16)])

#: How coded differences of probabilities are ordered: every 13th first, then the others, the last twice.
INV_MAP = [7 + 13 * i for i in range(20)]
INV_MAP += [v for v in range(1, 254) if v not in set(INV_MAP)] + [253]
