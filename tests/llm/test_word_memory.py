"""The memory of the word encoder: what it keeps, and that texts of one batch stay apart."""

import itertools
from collections import Counter

import public_tokenizers
import pytest

from strandlake.llm import token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_words_of_every_batch_pass_the_library_once(library, monkeypatch):
    """A full memory gives up what was met seldom, not the words that each batch repeats."""
    monkeypatch.setattr(token_files, "REMEMBERED", 300)
    encoder, passed = token_files.WordEncoder(PATH), Counter()
    words = encoder._words
    monkeypatch.setattr(encoder, "_words", lambda tokenizer, new: (passed.update(new), words(tokenizer, new))[1])
    fresh = map("".join, itertools.product("bdéklm", "aeiou", "nrst", "aeiou", "lmn"))
    common = list(itertools.islice(fresh, 100))
    for _ in range(15):
        text = " ".join([*common, *itertools.islice(fresh, 100)])
        assert encoder.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert {passed[c] for c in common} == {1} and len(passed) == 1600


def test_texts_of_a_batch_against_the_library(library, monkeypatch):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    monkeypatch.setattr(token_files, "REMEMBERED", 20)
    encoder = token_files.WordEncoder(PATH)
    signs = st.sampled_from("aA.,'sté÷×ÀÿßµªÃ \n\t\x0b\x1c\x85\xa0\0İſ1…😀中д<|≯́-ΣJ̌")
    words = st.sampled_from(["the", "the.", "été,", "été", " \n", "foo…,", "÷,", "Ÿ.", "слово,", "слово", "<|endoftext|>", "it's", "don't.", "x'", "a.b", "!?", "≠", ""])

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.one_of(st.none(), st.text(signs, max_size=12), st.lists(words, max_size=6).map(" ".join), st.lists(words, max_size=4).map("".join)), max_size=6))
    def same(texts):
        assert [x.tolist() for x in encoder.encode_batch(texts)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]

    same()
