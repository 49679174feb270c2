"""The registered queries against brute force and SQL on a small scale."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.llm import queries, simhash

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == want


def test_simhash(spark):
    from test_edges import brute_force_components

    rows = queries.op7_simhash(spark, SF).collect()
    signed = [(r["doc_id"], int.from_bytes(bytes.fromhex(r["fingerprint"]), "big", signed=True)) for r in rows]
    texts = {r["doc_id"]: r["text"] for r in queries.documents(spark, SF).collect()}
    assert all(simhash.fingerprint(texts[d]) == f for d, f in signed)
    want = brute_force_components(signed)
    assert all(r["component_id"] == want[r["doc_id"]] for r in rows)


def test_language_accuracy(spark):
    rows = queries.op1_language_id(spark, SF).join(queries.documents(spark, SF).select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)


def test_token_files(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r["doc_id"]: r for r in queries.op10_token_files(spark, SF).collect()}
    at = 0
    for r in queries.documents(spark, SF).orderBy("doc_id").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        got = rows[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_fingerprints(spark):
    rows = queries.op3_fingerprints(spark, SF).collect()
    held = [r for r in rows if r["n_chars"] > 300]
    assert sum(r["near_edited"] > 0.4 for r in held) > 0.9 * len(held)
    assert sum(r["near_next"] < 0.2 for r in held) > 0.9 * len(held)


def test_pipeline_against_its_operators(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    docs = queries.documents(spark, SF)
    kept = {r["doc_id"] for r in queries.op7_simhash(spark, SF).where("doc_id = component_id").collect()}
    ids = {r["doc_id"] for r in out.collect()}
    assert ids <= kept <= {r["doc_id"] for r in docs.select("doc_id").collect()} and len(ids) > 0.8 * len(kept)
    assert out.where("not restored").count() == 0
    assert out.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
