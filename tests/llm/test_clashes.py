"""Columns of the documents may bear any name, those of helpers and results included: their values stay, and results don't change."""

import pytest
from pyspark.sql import functions as F

from strandlake.llm import bpe, fingerprints, language_id, mixing, quality, simhash, stages, substring_dedup, toxicity
import public_tokenizers

NAMES = (
    "size n d s m i mark words round_1 round_2 taken key bucket block place kind a b c e at base inner total n_removed n_bytes n_spans kept kept_sha256 kept_text text_now "
    "_id _n _kept fp _fp root component_id kept_id kept_fp first node _lang_pred _lang_rejected lang_pred lang_score lang_rejected _text _words _lines _packed _bits _hits _windows "
    "_sorted _filled _k _b _to _next c0 c1 c2 c7 ids decoded toxic_score toxic_predicted held_out doc source_size target"
).split()


def tables(spark):
    """The same documents bare and with a column of each name."""
    words = "the house of this old man stood by that river and all dogs were in it as he came from town with bread".split()
    rows = []
    for i in range(40):
        text = " ".join(words[(i * 7 + j * (1 + i % 3)) % len(words)] + ("" if j % 5 else str(i)) for j in range(30 + i)) + "\nline two of it\n"
        rows.append((i, text if i % 10 else rows[-1][1] if rows else text, ("en", "de")[i % 2], ("x", "y", None)[i % 3], len(text)))
    bare = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").coalesce(2)
    return bare, bare.select("*", *(F.lit(f"own {n}").alias(n) for n in NAMES))


@pytest.mark.parametrize("stage", [stages.language_id, stages.near_dedup, stages.substring_dedup, stages.mix])
def test_stages(spark, stage):
    bare, full = tables(spark)
    want = sorted(map(tuple, stage(spark, bare, "").collect()), key=str)
    out = stage(spark, full, "")
    assert out.columns == full.columns and out.schema["n_chars"].dataType == full.schema["n_chars"].dataType
    rows = out.collect()
    assert want and sorted((tuple(r[c] for c in bare.columns) for r in rows), key=str) == want
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES)


def test_last_stage(spark):
    bare, full = tables(spark)
    assert sorted(stages.encode(spark, full, "").collect(), key=str) == sorted(stages.encode(spark, bare, "").collect(), key=str)


def same(bare, full, results):
    """Results don't change, and all columns that aren't replaced stay."""
    rows = full.collect()
    assert sorted((tuple(r[c] for c in results) for r in rows), key=str) == sorted(map(tuple, bare.select(*results).collect()), key=str)
    replaced = {c.lower() for c in results}
    assert all(r[n] == f"own {n}" for r in rows for n in NAMES if n.lower() not in replaced)


def test_operators(spark):
    bare, full = tables(spark)
    model = language_id.fit(bare)
    assert language_id.fit(full) == model
    same(*(language_id.identify(t, model) for t in (bare, full)), ["doc_id", "lang_pred", "lang_score", "lang_margin", "lang_rejected"])
    labels = bare.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    toxic = toxicity.fit(bare, labels)
    same(*(toxicity.score(t, toxic) for t in (bare, full)), ["doc_id", "toxic_score", "toxic_predicted"])
    same(*(fingerprints.with_fingerprint(t, "text", "values") for t in (bare, full)), ["doc_id", "values"])
    same(*(fingerprints.with_next(t, "doc_id", ["text"]) for t in (bare, full)), ["doc_id", "next_text"])
    same(*(quality.quality(t) for t in (bare, full)), ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words", "base_failed", "kept"])
    same(*(bpe.bpe_encode(t, public_tokenizers.path("byte_bpe_50k.json")) for t in (bare, full)), ["doc_id", "ids", "decoded"])
    for f in (simhash.near_duplicates, lambda t: mixing.mix_sources(t).documents, lambda t: substring_dedup.remove_repeats(t, carried=[])):
        assert sorted(f(full).collect(), key=str) == sorted(f(bare).collect(), key=str)
    cut = substring_dedup.remove_repeats(full, carried=["block", "bucket", "kept", "size"]).collect()
    assert all((r["block"], r["bucket"], r["size"]) == ("own block", "own bucket", "own size") and r["kept"] != "own kept" for r in cut)
