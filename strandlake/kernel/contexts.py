"""Frame contexts: forward updates from the compressed header, backward adaptation from counts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from strandlake.kernel import spec
from strandlake.kernel.bits import BoolDecoder
from strandlake.kernel.headers import Header
from strandlake.kernel.tables import Tables

Context = dict[str, np.ndarray]

#: Trees of the probabilities that have one; all others are single decisions.
TREES = {
    "uv_mode": spec.INTRA_TREE, "y_mode": spec.INTRA_TREE, "tx1": spec.TX_TREES[1], "tx2": spec.TX_TREES[2], "tx3": spec.TX_TREES[3], "inter_mode": spec.INTER_TREE, "interp_filter": spec.FILTER_TREE,
    "partition": spec.PARTITION_TREE, "mv_joint": spec.JOINT_TREE, "mv_class": spec.CLASS_TREE, "mv_class0_fr": spec.FRACTION_TREE, "mv_fr": spec.FRACTION_TREE,
}


def initial(tables: Tables) -> Context:
    return {name: np.array(p, np.int64) for name, p in (spec.INITIAL | {"coef": tables.coef}).items()}


def copied(context: Context) -> Context:
    return {name: p.copy() for name, p in context.items()}


def new_counts(context: Context) -> dict[str, np.ndarray]:
    """Counters of the same layout: per decision two, per tree as many as it has leaves; of coefficients tokens (0, 1, more) and whether more follow."""
    out = {}
    for name, p in context.items():
        if name == "coef":
            out["token"], out["more"] = np.zeros((*p.shape[:-1], 3), np.int64), np.zeros((*p.shape[:-1], 2), np.int64)
        elif name in TREES:
            out[name] = np.zeros((*p.shape[:-1], p.shape[-1] + 1), np.int64)
        else:
            out[name] = np.zeros((*p.shape, 2), np.int64)
    return out


def _remapped(coded: int, prob: int) -> int:
    """The probability that a coded difference leads to."""
    v, m = spec.INV_MAP[coded], prob - 1

    def recentred(v: int, m: int) -> int:
        return v if v > 2 * m else m - ((v + 1) >> 1) if v & 1 else m + (v >> 1)

    return 1 + recentred(v, m) if 2 * m <= 255 else 255 - recentred(v, 254 - m)


def _difference(d: BoolDecoder) -> int:
    for bits, base in ((4, 0), (4, 16), (5, 32)):
        if not d.literal(1):
            return d.literal(bits) + base
    v = d.literal(7)
    return v + 64 if v < 65 else (v << 1) - 1 + d.literal(1)


def _update(d: BoolDecoder, probs: np.ndarray) -> None:
    flat = probs.reshape(-1)
    for i in range(flat.size):
        if d.read(252):
            flat[i] = _remapped(_difference(d), int(flat[i]))


def _update_mv(d: BoolDecoder, probs: np.ndarray, at) -> None:
    part = np.atleast_1d(probs[at])
    for i in range(part.size):
        if d.read(252):
            part.reshape(-1)[i] = d.literal(7) << 1 | 1
    probs[at] = part if np.ndim(probs[at]) else part[0]


@dataclass
class Compressed:
    tx_mode: int
    context: Context
    reference_mode: int = spec.SINGLE
    fixed_ref: int = 0
    var_refs: tuple[int, int] = (0, 0)


def parse_compressed(data: bytes, h: Header, start: Context, opened=BoolDecoder) -> Compressed:
    """The compressed header: modes of the frame and its updated probabilities."""
    d, c = opened(data), copied(start)
    tx_mode = 0
    if not h.lossless:
        tx_mode = d.literal(2)
        if tx_mode == 3:
            tx_mode += d.literal(1)
    out = Compressed(tx_mode, c)
    if tx_mode == spec.TX_SELECT:
        for name in ("tx1", "tx2", "tx3"):
            _update(d, c[name])
    for tx in range(spec.BIGGEST_TX[tx_mode] + 1):
        if d.literal(1):
            for plane, inter, band in np.ndindex(2, 2, 6):
                _update(d, c["coef"][tx, plane, inter, band, : 3 if band == 0 else 6])
    _update(d, c["skip"])
    if h.intra:
        return out
    _update(d, c["inter_mode"])
    if h.interp_filter == spec.SWITCHABLE:
        _update(d, c["interp_filter"])
    _update(d, c["is_inter"])
    bias = h.sign_bias
    if bias[spec.GOLDEN] != bias[spec.LAST] or bias[spec.ALTREF] != bias[spec.LAST]:
        out.reference_mode = spec.SINGLE if not d.literal(1) else spec.COMPOUND + d.literal(1)
    if out.reference_mode != spec.SINGLE:
        out.fixed_ref = spec.ALTREF if bias[1] == bias[2] else spec.GOLDEN if bias[1] == bias[3] else spec.LAST
        out.var_refs = tuple(r for r in (spec.LAST, spec.GOLDEN, spec.ALTREF) if r != out.fixed_ref)
    if out.reference_mode == spec.SELECT:
        _update(d, c["comp_mode"])
    if out.reference_mode != spec.COMPOUND:
        _update(d, c["single_ref"])
    if out.reference_mode != spec.SINGLE:
        _update(d, c["comp_ref"])
    _update(d, c["y_mode"])
    _update(d, c["partition"])
    _update_mv(d, c["mv_joint"], slice(None))
    for i in range(2):
        for name in ("mv_sign", "mv_class", "mv_class0", "mv_bits"):
            _update_mv(d, c[name], i)
    for i in range(2):
        for name in ("mv_class0_fr", "mv_fr"):
            _update_mv(d, c[name], i)
    if h.high_precision:
        for i in range(2):
            for name in ("mv_class0_hp", "mv_hp"):
                _update_mv(d, c[name], i)
    return out


def merged(pre: int, zero: int, one: int, saturation: int, factor: int) -> int:
    total = zero + one
    seen = 128 if total == 0 else min(255, max(1, (zero * 256 + (total >> 1)) // total))
    weight = factor * min(total, saturation) // saturation
    return (pre * (256 - weight) + seen * weight + 128) >> 8


def _adapt_tree(tree, probs, counts, saturation: int, factor: int) -> None:
    def below(at: int) -> int:
        left, right = (int(counts[-n]) if n <= 0 else below(n) for n in (tree[at], tree[at + 1]))
        probs[at >> 1] = merged(int(probs[at >> 1]), left, right, saturation, factor)
        return left + right

    below(0)


def adapt_coefficients(c: Context, counts: dict[str, np.ndarray], factor: int) -> None:
    for at in np.ndindex(*c["coef"].shape[:-1]):
        if at[3] == 0 and at[4] >= 3:
            continue
        more, token = counts["more"][at], counts["token"][at]
        if more.any() or token.any():
            p = c["coef"][at]
            _adapt_tree(spec.COUNTED_TOKEN_TREE, p[1:], token, 24, factor)
            p[0] = merged(int(p[0]), int(more[0]), int(more[1]), 24, factor)


def adapt_others(c: Context, counts: dict[str, np.ndarray], h: Header, tx_mode: int) -> None:
    for name, p in c.items():
        if name == "coef" or name == "interp_filter" and h.interp_filter != spec.SWITCHABLE or name in ("tx1", "tx2", "tx3") and tx_mode != spec.TX_SELECT:
            continue
        if name in ("mv_class0_hp", "mv_hp") and not h.high_precision:
            continue
        n = counts[name]
        if name in TREES:
            for at in np.ndindex(*p.shape[:-1]):
                _adapt_tree(TREES[name], p[at], n[at], 20, 128)
        else:
            for at in np.ndindex(*p.shape):
                p[at] = merged(int(p[at]), int(n[at][0]), int(n[at][1]), 20, 128)


def refreshed(h: Header, start: Context, compressed: Compressed, counts: dict[str, np.ndarray], after_key: bool) -> Context:
    """The context that a frame leaves behind."""
    if h.resilient or h.parallel:
        return copied(compressed.context)
    c = copied(start)
    adapt_coefficients(c, counts, 128 if after_key and not h.intra else 112)
    if h.intra:
        for name in ("tx1", "tx2", "tx3", "skip"):
            c[name] = compressed.context[name].copy()
    else:
        adapt_others(c, counts, h, compressed.tx_mode)
    return c
