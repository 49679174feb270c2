"""The format's large tables, which come from a file.

A JSON object with kf_y_mode (10 x 10 x 9: above, left, node), coef (4 x 2 x 2 x 6 x 6 x 3),
pareto (128 x 8), dc_quant and ac_quant (3 x 256: 8, 10, 12 bits) and scans (names
default4, row4, col4, default8, row8, col8, default16, row16, col16, default32). The
values are those of the public bitstream specification; tables.json beside this module holds
them and is read where no path is given. standin() builds tables of the same shapes from rules.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache
from importlib import resources

SHAPES = {"kf_y_mode": (10, 10, 9), "coef": (4, 2, 2, 6, 6, 3), "pareto": (128, 8), "dc_quant": (3, 256), "ac_quant": (3, 256)}
SCANS = {f"{kind}{n}": n for n in (4, 8, 16) for kind in ("default", "row", "col")} | {"default32": 32}


@dataclass(frozen=True)
class Tables:
    kf_y_mode: list
    coef: list
    pareto: list
    dc_quant: list
    ac_quant: list
    scans: dict

    def __post_init__(self):
        import numpy as np

        for name, shape in SHAPES.items():
            if np.shape(getattr(self, name)) != shape:
                raise ValueError(f"{name} has shape {np.shape(getattr(self, name))}, not {shape}")
        for name, n in SCANS.items():
            if sorted(self.scans[name]) != list(range(n * n)):
                raise ValueError(f"{name} is no scan of {n} x {n}")

    def pareto_probs(self, p: int) -> list[int]:
        """Probabilities of the token tree's nodes from 2 on, given that of node 1; even ones lie between two rows."""
        x = (p - 1) // 2
        return self.pareto[x] if p & 1 else [(a + b) >> 1 for a, b in zip(self.pareto[x], self.pareto[x + 1], strict=True)]


@lru_cache(maxsize=8)
def load(path: str | None) -> Tables:
    """The tables of a file; None: the format's own, which come with this package."""
    if path is None:
        return Tables(**json.loads(resources.files(__package__).joinpath("tables.json").read_text(encoding="utf-8")))
    with open(path, encoding="utf-8") as f:
        return Tables(**json.load(f))


def standin() -> Tables:
    """Tables from rules: even probabilities, linear quantizers, scans by diagonal, row and column."""

    def scan(n: int, key) -> list[int]:
        return sorted(range(n * n), key=lambda p: key(*divmod(p, n)))

    orders = {"default": lambda i, j: (i + j, i), "row": lambda i, j: (2 * i + j, i), "col": lambda i, j: (i + 2 * j, j)}
    return Tables(
        kf_y_mode=[[[128] * 9] * 10] * 10,
        coef=[[[[[[128] * 3] * 6] * 6] * 2] * 2] * 4,
        pareto=[[min(255, 100 + i)] * 8 for i in range(128)],
        dc_quant=[[(4 + i) << (2 * d) for i in range(256)] for d in range(3)],
        ac_quant=[[(4 + i + i // 4) << (2 * d) for i in range(256)] for d in range(3)],
        scans={name: scan(n, orders[name.rstrip("0123456789")]) for name, n in SCANS.items()},
    )
