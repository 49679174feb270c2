"""Queries that SQL can't express, against plain Python versions of their contracts on the smallest tables."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from test_edges import brute_force_components

from strandlake.llm import fingerprints, language_id, queries, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in queries.documents(spark, SF).select("doc_id", "text").collect()}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*parts):
    """Spark's hash of several columns: each seeds the next."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else struct.pack("<i", p), h)
    return signed(h)


def one_permutation(text):
    words = WORD.findall(text)
    shingles = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    least = {}
    for s in shingles:
        h = chained(*s)
        b = (h >> 57) + 64
        least[b] = min(h, least.get(b, h))
    if not least:
        return []
    out = []
    for i in range(128):
        draws = [i] if i in least else [chained(i, t) % 128 for t in range(1, fingerprints.PROBES + 1)]
        hit = next((d for d in draws if d in least), None)
        x = least[hit] if hit is not None else least[min(least, key=lambda b: chained(i, b))]
        out.append(x & 255)
    return out


def alike(a, b):
    if not a or not b:
        return float(not a and not b)
    return max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 128 - 1 / 256) / (1 - 1 / 256))


def test_op3(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op3_fingerprints(spark, SF).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for d, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        text, following = texts[d] or "", texts[after] or ""
        q = len(text) // 4
        edited = text[: len(text) - q] + following[:q]
        own, other, beyond = one_permutation(text), one_permutation(edited), one_permutation(following)
        r = rows[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (bytes(own).hex(), bytes(other).hex())
        assert r["near_edited"] == pytest.approx(alike(own, other)) and r["near_next"] == pytest.approx(alike(own, beyond))


def test_op5(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_truncation()
    library.no_padding()
    rows = {r["doc_id"]: r for r in queries.op5_bpe(spark, SF).collect()}
    assert set(rows) == set(texts)
    for d, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        r = rows[d]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()


def test_op7(spark, texts):
    def bits(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        votes = Counter()
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            votes.update(b for b in range(64) if h >> b & 1)
        return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))

    want = {d: bits(t) for d, t in texts.items()}
    linked = brute_force_components([(d, signed(f)) for d, f in want.items()])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, SF).collect()}
    assert got == {d: (f"{f:016x}", linked[d]) for d, f in want.items()}


def test_op1_is_the_smallest_encoding(spark, texts):
    """The query's answers are those of its own model, taken text by text; held-out rows change nothing of it."""
    docs = queries.documents(spark, SF)
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    encoders = language_id.Encoders(model)
    for r in queries.op1_language_id(spark, SF).collect():
        t = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if not t or not re.search(r"[^\W\d_]", t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        sizes = encoders.sizes(t)
        assert r["lang_pred"] == model.languages[int(np.argmin(np.maximum(sizes, 1)))] and 0 < r["score"] <= 1


def test_long_texts_are_learnt(spark):
    """All texts of a language may be long; what tells it may lie anywhere in them."""
    draw = np.random.default_rng(4)
    stems = {"aa": ["bala", "dona", "mira", "sota"], "bb": ["chuth", "greck", "plosh", "wring"]}
    body = lambda lang, n: " ".join(draw.choice(stems[lang]) + str(x) for x in draw.integers(0, 9, n))
    rows = [(body(lang, 9000), lang) for lang in stems for _ in range(20)]
    assert min(len(t) for t, _ in rows) > 2 * language_id.SAMPLED_CHARS
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["aa", "bb"]
    assert all(r["lang"] == r["lang_pred"] for r in language_id.identify(docs, model).collect())


def test_op2_on_labelled_rows(spark, texts):
    """Scores are those of the model, and tell most held-out labels."""
    rows = {r["doc_id"]: r for r in queries.op2_toxicity(spark, SF).collect()}
    assert set(rows) == set(texts)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in rows.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(labels[d], r["predicted"]) for d, r in rows.items() if labels.get(d) is not None and r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.85 * len(held)


def _noisy(word, kind):
    if kind == "spaced":
        return " ".join(word)
    if kind == "repeated":
        return word[:-1] + word[-1] * 4
    return word.translate(str.maketrans("oiea", "01 34".replace(" ", "")))


@pytest.mark.parametrize("kind", ["look-alikes", "spaced", "repeated"])
def test_planted_noise_is_undone(spark, kind):
    """Insults in disguise in texts that the model never saw are found as the plain ones are; clean texts stay clean."""
    draw = np.random.default_rng(9)
    plain = "the weather in this little town was good and all of them went home to eat bread with their friends".split()
    insults = ["idiot", "moron", "loser", "vermin"]
    clean = lambda n: [str(w) for w in draw.choice(plain, n)]
    rows = []
    for i in range(400):
        words = clean(40)
        if i % 2:
            words[20:20] = [str(draw.choice(insults)), str(draw.choice(insults))]
        rows.append((i, " ".join(words), i % 2))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, y int"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    caught = [model.score(" ".join([*clean(15), _noisy(w, kind), *clean(15), _noisy(w, kind), *clean(10)])) >= 0.5 for w in insults for _ in range(10)]
    false = [model.score(" ".join(clean(40))) >= 0.5 for _ in range(40)]
    assert sum(caught) >= 0.9 * len(caught) and not any(false)


def test_words_of_long_labelled_texts_count(spark):
    """A labelled text of any length takes part in the fit, to its end."""
    draw = np.random.default_rng(3)
    vocabulary = [f"{a}{b}{c}" for a in ("ba", "do", "mi", "ru") for b in ("len", "rat", "sok", "tim") for c in ("a", "e", "us", "or")]
    filler = lambda: " ".join(draw.choice(vocabulary, 12_000))
    rows = [(i, f"{filler()} " + ("scumbag met scumbag and scumbag" if i % 2 else "neighbour met neighbour and neighbour")) for i in range(40)]
    assert min(len(t.encode()) for _, t in rows) > 1 << 16
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int"))
    assert model.weights.get("scumbag", 0) > 1 and "neighbour" not in model.weights
