"""Words whose letters are set apart and mixed with look-alikes."""

import random

import numpy as np
import pytest
import regex

from strandlake.llm import toxicity

CORPUS = "you are a stupid man and such an idiot again, what a stupid idea of the idiot who came at noon at 9 9 with 5 apples. " * 40


@pytest.fixture(scope="module")
def model():
    s = np.concatenate([[0, 0], toxicity.symbols(CORPUS), [0]]).astype(int)
    n = toxicity.SYMBOLS
    counts = np.bincount((s[:-2] * n + s[1:-1]) * n + s[2:], minlength=n**3).reshape(n, n, n)
    return toxicity.ToxicityModel(toxicity.language_model(counts), {}, 0.0, 1.0, 0.0, 0.0)


@pytest.mark.parametrize("typed, meant", [
    ("what s t u p 1 d man", "what stupid man"), ("1 d 1 0 t", "idiot"), ("an i.d.1.0.t again", "an idiot again"),
    ("$-t-u-p-!-d", "stupid"), ("s t u p i d", "stupid"), ("1 2 3 4 5", "1 2 3 4 5"), ("s t u p 1 d 9 9", "stupid 9 9"),
])
def test_restored(model, typed, meant):
    assert model.restored(typed) == meant


def test_quick_look_misses_no_stretch():
    draw = random.Random(4)
    for _ in range(20000):
        text = "".join(draw.choice("ab1é$!( ._-\n,") for _ in range(draw.randrange(12))).lower()
        if any(regex.search(r"\p{L}", m[0]) for m in toxicity._SPACED.finditer(text)):
            assert toxicity.suspicious(text), text
