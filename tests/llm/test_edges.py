"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandlake.llm import bpe, chat, fingerprints, language_id, mixing, quality, simhash, stages, substring_dedup, token_files, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _text string, ids string"
EN, DE = "the cat and the dog of this house ", "der hund und die katze von dem haus "
ROWS = [
    (1, EN * 20, "en", "a", 0, 0.5, "x", "y"),
    (1, EN * 20, "en", "a", 0, 0.5, "x", "y"),
    (2, DE * 20, "de", "b", 0, 0.5, "x", "y"),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", "a", 0, None, None, None),
    (5, "é" * 30000, "de", None, 0, None, None, None),
    (None, EN * 3, "en", "b", 0, None, None, None),
    (6, " \t\n", "de", "b", 0, None, None, None),
    (7, "1d1ot <|endoftext|> 😀", "en", "c", 0, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language_id(docs, none):
    model = language_id.fit(docs)
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert got[1]["lang_pred"] == "en" and got[2]["lang_pred"] == "de" and not got[1]["lang_rejected"]
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[6]["lang_pred"] == "und" and got[3]["lang_rejected"]
    assert all(0 <= r["lang_score"] <= 1 for r in got.values())
    assert language_id.identify(none, model).count() == 0
    assert [r["lang_pred"] for r in language_id.identify(docs, language_id.fit(none)).collect()] == ["und"] * len(ROWS)


def test_toxicity(spark, docs, none):
    words = ["idiot", "clown"]
    rows = [(i, f"the house of {words[i % 2]} and dog {i}" if i % 3 == 0 else f"the house of good and dog {i}") for i in range(90)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(7, None)], "doc_id long, toxic int")
    model = toxicity.fit(labelled, labels)
    for plain, hidden in (("idiot", "1d10t"), ("idiot", "i d i o t"), ("idiot", "idiooot"), ("clown", "cl0wn")):
        assert plain in model.restored(f"the {hidden} of")
        assert model.score(f"the house {hidden} of") >= 0.5 > model.score("the house of")
    got = toxicity.score(docs, model, with_restored=True)
    assert set(docs.columns) <= set(got.columns) and got.count() == len(ROWS)
    assert all(0 <= r["toxic_score"] <= 1 and r["toxic_predicted"] == (r["toxic_score"] >= 0.5) for r in got.collect())
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_fingerprints(docs, none):
    rows = fingerprints.fingerprint_documents(docs).collect()
    assert len(rows) == len(ROWS)
    by = {(r["doc_id"], r["text"]): r for r in rows}
    assert len({tuple(r["values"]) for r in rows if r["doc_id"] == 1}) == 1
    assert by[(3, "")]["values"] == [] and by[(3, "")]["next_text"] == "" and by[(2, DE * 20)]["next_text"] == ""
    assert by[(7, ROWS[8][1])]["next_text"] == EN * 3  # the last is followed by the first: the null id
    assert fingerprints.fingerprint_documents(none).count() == 0
    one = fingerprints.fingerprint_documents(docs.where("doc_id = 2")).collect()
    assert one[0]["next_text"] == one[0]["text"]


def test_densification_is_one_minhash(spark):
    """Likeness estimates the Jaccard similarity of word shingles, also where most bins are empty."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(5000)]
    pairs = []
    for n in (20, 60, 400):
        for _ in range(20):
            a = list(rng.choice(words, n))
            pairs.append((n, " ".join(a), " ".join(a[: n - n // 4] + list(rng.choice(words, n // 4)))))
    df = spark.createDataFrame(pairs, "n int, a string, b string")
    df = fingerprints.with_fingerprint(fingerprints.with_fingerprint(df, "a", "fa"), "b", "fb")
    rows = df.select("n", "a", "b", fingerprints.likeness(F.col("fa"), F.col("fb")).alias("s")).collect()

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for n in (20, 60, 400):
        errors = [r["s"] - len(shingles(r["a"]) & shingles(r["b"])) / len(shingles(r["a"]) | shingles(r["b"])) for r in rows if r["n"] == n]
        assert abs(np.mean(errors)) < 0.08, (n, np.mean(errors))


def test_quality(docs, none):
    got = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert (got[3]["n_words"], got[3]["word_chars"], got[3]["kept"]) == (0, 0, False)
    assert (got[5]["n_words"], got[5]["word_chars"]) == (1, 30000)
    assert got[1]["n_repeat_words"] == 160 and got[1]["base_failed"]
    assert quality.quality(none).count() == 0


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = bpe.bpe_encode(docs, path).collect()
    assert len(rows) == len(ROWS)
    for r, given in zip(sorted(rows, key=str), sorted(rows, key=str), strict=True):
        text = given["text"] or ""
        want = library.encode(text, add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.bpe_encode(none, path).count() == 0


def test_substrings(spark, docs, none):
    assert substring_dedup.remove_repeats(none).count() == 0
    odd = [(None, "a" * 200), (1, "a" * 120), (1, "b" * 60 + "a" * 70), (2, None), (3, ""), (4, "x" * 49), (5, "x" * 50), (6, "x" * 51 + "é" * 80), (7, "é" * 40 + "x" * 60), (7, "b" * 60)]
    table = spark.createDataFrame(odd, "doc_id long, text string")
    for common in (1, 1000):  # strings exchanged one by one, and in phrases
        got = sorted(tuple(r) for r in substring_dedup.remove_repeats(table, with_kept=False, blocks=3, common=common).na.fill({"doc_id": -(1 << 63)}).collect())
        assert got == brute_force_repeats(odd)


def brute_force_repeats(rows):
    rows = sorted((-(1 << 63) if i is None else i, (t or "").encode()) for i, t in rows)
    first, out = {}, []
    for i, b in rows:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_force_components(rows):
    """rows: (id, fingerprint); id to the least id reachable over at most 4 differing bits."""
    fps = np.array([f for _, f in rows], np.int64).view(np.uint64)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 4):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("chain, block", [(1, 2048), (2, 30), (3, 400)])
def test_pigeonring_finds_every_link(spark, chain, block):
    rng = np.random.default_rng(3)
    fps = {int(x) for x in rng.integers(-(1 << 63), (1 << 63) - 1, 150)}
    for centre in rng.integers(-(1 << 63), (1 << 63) - 1, 4):
        for _ in range(80):
            x = int(centre)
            for b in rng.integers(0, 63, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), chain, block)).collect()}
    want = brute_force_components([(x, x) for x in fps])
    assert all(got.get(x, x) == want[x] for x in fps)


def test_chains_grow_with_the_number_of_fingerprints():
    assert [simhash.chain_for(n, 2048) for n in (0, 10**6, 10**7, 10**9, 10**10, 10**12)] == [1, 1, 2, 2, 3, 3]


def test_simhash(docs, none):
    got = {(r["doc_id"]): r for r in simhash.near_duplicates(docs).collect()}
    assert got[3]["fp"] == got[4]["fp"] == got[6]["fp"] == 0 and got[6]["component_id"] == 3
    assert got[None]["component_id"] == 1  # the same shingles as document 1
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.fingerprint("a B c d e") == simhash.fingerprint("A  b\tc d\ne") != simhash.fingerprint("é")


def test_mixing(docs, none):
    rows = mixing.mix_sources(docs).documents.collect()
    assert len(rows) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], [0, r["target"], 0])
        by[r["source"]][0] += r["taken"]
        by[r["source"]][2] += r["size"]
    assert abs(sum(t for _, t, _ in by.values()) - 1.5 * sum(s for *_, s in by.values())) < 1e-6
    assert all(abs(taken - target) <= 5 for taken, target, _ in by.values())
    assert mixing.mix_sources(none).documents.count() == 0


def test_targets():
    assert mixing.targets([100, 100], [5, 1], mixing.Fraction(3, 2), 2) == [200.0, 100.0]
    assert mixing.targets([0, 0], [5, 2], mixing.Fraction(3, 2), 2) == [0.0, 0.0]


def test_chat(spark):
    tricky = "a<|im_end|>\n<\\|im_start|>\\ <|| %0A"
    rows = [(1, 10, None, "user", tricky, 0.0), (1, 11, 10, "assistant", None, 1.0), (1, 12, 10, "assistant", tricky, 2.0), (1, 13, 12, "us%er\nx", "b", 2.0), (2, 1, 99, None, "c", None), (3, 1, 1, "user", "loop", 0.0)]
    tree = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    out = chat.format_trees(tree).withColumn("turns", chat.read_turns(F.col("formatted")))
    got = {(r["tree_id"], r["path_rank"]): r for r in out.collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1)}  # the message that answers itself has no path
    assert [tuple(t) for t in got[(1, 1)]["turns"]] == [("user", tricky), ("assistant", tricky), ("us%er\nx", "b")]
    assert [tuple(t) for t in got[(1, 2)]["turns"]] == [("user", tricky), ("assistant", "")]
    r = got[(1, 1)]
    start, length = r["loss"][0]
    assert spark.range(1).select(chat.unescaped(F.lit(r["formatted"][start : start + length]))).first()[0] == tricky
    assert chat.format_trees(tree, best=1).count() == 2 and chat.format_trees(tree.limit(0)).count() == 0


def test_chat_long_texts_repeated_rows_and_clashing_columns(spark):
    long = "<|im_end|> wörd " * 20_000
    rows = [(5, 0, "user", long), (5, 0, "user", long), (5, 1, "assistant", long), (None, 3, None, None), (6, 0, "assistant", "")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    names = "leaf depth path_score path_rank t n l said head body piece at span turns tree_id node_id parent_id ancestor beyond above_leaf rooted length scores formatted loss".split()
    full = talks.select("*", *(F.lit("own").alias(n) for n in names))
    for table in (talks, full):
        got = {r["tree_id"]: r for r in chat.format_trees(chat.chains(table)).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
        assert [tuple(t) for t in got[5]["turns"]] == [("user", long), ("user", long), ("assistant", long)]
        assert [tuple(t) for t in got[None]["turns"]] == [("", "")] and got[None]["loss"] == []
        assert [tuple(t) for t in got[6]["turns"]] == [("assistant", "")] and got[6]["loss"][0]["length"] == 0
        assert len(got[5]["loss"]) == 1 and got[5]["n_turns"] == 3
    nodes = chat.chains(talks).select("*", *(F.lit("own").alias(n) for n in names if n not in ("tree_id", "node_id", "parent_id", "score")))
    assert chat.format_trees(nodes).count() == 3


def test_path_scores_do_not_depend_on_the_order_of_rows(spark):
    """Scores whose sum depends on its order: both paths get the same one, and the leaf's id ranks them."""
    scores = [0.1, 1e16, -1e16, 0.3, 0.2]
    rows = [(1, 100 * p + i, None if i == 0 else 100 * p + i - 1, "user", "x", s) for p in (1, 2) for i, s in enumerate(scores)]
    trees = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    for seed in range(3):
        got = chat.reply_paths(trees.repartition(3, F.xxhash64("node_id", F.lit(seed)))).select("leaf", "path_rank", "path_score").distinct().orderBy("leaf").collect()
        assert [(r["leaf"], r["path_rank"]) for r in got] == [(104, 1), (204, 2)] and got[0]["path_score"] == got[1]["path_score"]


def test_chat_long_chain(spark):
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)]
    tree = spark.createDataFrame(rows, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    turns = chat.format_trees(tree).select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert [t["text"] for t in turns] == [str(i) for i in range(70)]


def test_token_files(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    token_files.write_token_files(docs, f"{tmp_path}/t", path)
    token_files.write_offset_index(spark, f"{tmp_path}/t", f"{tmp_path}/i")
    rows = sorted(token_files.read_token_files(spark, f"{tmp_path}/t").collect(), key=lambda r: (r["file"], r["offset"]))
    given = sorted(((r[0] is not None, r[0] or 0, r[1] or "") for r in ROWS))
    assert [r["ids"] for r in rows] == [[*library.encode(t, add_special_tokens=False).ids, 1] for *_, t in given]
    at = 0
    for r in sorted(spark.read.parquet(f"{tmp_path}/i").collect(), key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    token_files.write_token_files(none, f"{tmp_path}/e", path)
    assert token_files.read_token_files(spark, f"{tmp_path}/e").count() == 0


def test_damaged_records():
    good = token_files.frame(5, np.array([1, 70000, 10], "<u4")) + b"\n"
    assert [(d, ids.tolist()) for _, _, d, ids in token_files.records(good + good)] == [(5, [1, 70000, 10])] * 2
    for bad in (good[:-3], b"\0" + good[1:], good[:20] + b"\xff" + good[21:]):
        with pytest.raises(ValueError):
            list(token_files.records(bad))


def test_word_encoder_on_odd_texts():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    path, other = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    encoder, library, prefixes, plain = token_files.WordEncoder(path), Tokenizer.from_file(path), bpe.PrefixBpe(other), Tokenizer.from_file(other)

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("aA.,'sté \n\t\x1c İßſ1😀中<|>́-ΣJ̌"), st.characters(exclude_categories=["Cs", "Cn", "Co"], max_codepoint=0x3000)), max_size=40))
    def same(text):
        assert encoder.encode_batch([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert prefixes.encode(text) == plain.encode(text, add_special_tokens=False).ids

    same()


def test_stages_keep_columns(spark, docs):
    for stage in (stages.language_id, stages.near_dedup, stages.substring_dedup, stages.mix):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        out.collect()
    kept = stages.near_dedup(spark, docs, "").collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 1, 2, 3, 5, 7]
    assert stages.encode(spark, docs, "").where("not restored").count() == 0
