"""Copies, repeated ids and large groups: what they must not change."""

import random

from pyspark.sql import functions as F

from strandlake.llm import language_id, simhash, stages


def _worded(spark, lang, stem, n):
    return spark.range(n).select(F.concat_ws(" ", *(F.concat(F.lit(stem), F.translate(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"{lang}{i}"))), "0123456789", "ghijklmnop")) for i in range(3))).alias("text"), F.lit(lang).alias("lang"))


def test_language_of_many_copies_is_learnt(spark):
    """10 texts, none of them among the first 160/3000 by hash, 300 copies each."""
    few = _worded(spark, "xx", "ba", 200).where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) >= (1 << 40) * 160 // 3000).orderBy("text").limit(10)
    copied = few.crossJoin(spark.range(300)).drop("id")
    model = language_id.fit(copied.unionByName(_worded(spark, "yy", "do", 50)))
    assert model.languages == ["xx", "yy"]
    assert all(language_id.normalized(r["text"]) in model.dictionaries[0] for r in few.collect())


def test_copies_change_no_dictionary(spark):
    once = _worded(spark, "xx", "ba", 500).unionByName(_worded(spark, "yy", "do", 90))
    least = once.where("lang = 'xx'").orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 40))).limit(1)
    model = language_id.fit(once)
    assert language_id.fit(once.unionByName(least.crossJoin(spark.range(2000)).drop("id"))) == model
    assert len(model.dictionaries[0].split()) == 3 * language_id.ROWS_PER_LANGUAGE


def test_sample_grows_where_hashes_leave_too_few(spark):
    """Texts with hashes in the upper half only: the share drawn first finds none."""
    upper = _worded(spark, "xx", "ba", 2000).where(F.pmod(F.xxhash64("text"), F.lit(1 << 40)) >= 1 << 39)
    assert len(language_id.fit(upper).dictionaries[0].split()) == 3 * language_id.ROWS_PER_LANGUAGE


def test_texts_of_a_repeated_id_go_with_their_own_groups(spark):
    """Id 5 has a text of its own, one in two near forms, and a copy of document 1."""
    own = [" ".join(f"{stem}{i}" for i in range(60)) for stem in ("apple", "river", "stone", "cloud")]
    rows = [(1, own[0]), (5, own[0]), (5, own[1]), (5, own[2]), (5, own[2].upper()), (7, own[2]), (9, own[3]), (None, own[3])]
    docs = spark.createDataFrame([(i, t, "xx", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    kept = sorted((r["doc_id"] or 0, r["text"].lower()) for r in stages.near_dedup(spark, docs, "").collect())
    assert kept == [(0, own[3]), (1, own[0]), (5, own[1]), (5, own[2]), (9, own[3])]


def test_no_task_holds_a_large_key(spark, monkeypatch):
    """600 fingerprints of one key, few of them linked, in blocks of 32: groups stay small, and links are those of all pairs."""
    draw = random.Random(6)
    fps = [draw.getrandbits(50) << 13 | 5 for _ in range(540)]
    fps = sorted({*fps, *(f ^ (1 << draw.randrange(13, 63)) ^ (1 << draw.randrange(13, 63)) for f in fps[:60])})
    largest, whole = [], simhash._edges

    def spied(keyed):
        largest.append(keyed.groupBy("key", "block").count().agg(F.max("count")).first()[0])
        return whole(keyed)

    monkeypatch.setattr(simhash, "_edges", spied)
    table = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(table, 1, 32)).collect()}
    assert len(largest) == 2 and max(largest) < 5 * 32
    want = {f: {f} for f in fps}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4 and want[a] is not want[b]:
                want[a] |= want[b]
                for x in want[b]:
                    want[x] = want[a]
    assert got == {f: min(s) for f, s in want.items() if len(s) > 1}
