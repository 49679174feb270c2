"""Queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, chat, fingerprints, language_id, mixing, quality, simhash, substring_dedup, token_files, toxicity
from strandlake.llm._common import scratch_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", language_id.held_out(F.col("doc_id")))
    model = language_id.fit(docs.where("not held_out"))
    out = language_id.identify(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_margin", "lang_rejected")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", language_id.held_out(F.col("doc_id")))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~language_id.held_out(F.col("doc_id")))
    model = toxicity.fit(docs.where("not held_out"), labels, corpus=docs)
    out = toxicity.score(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.fingerprint_documents(documents(spark, sf_dir))
    rows = rows.withColumn("edited", fingerprints.edited(F.col("text"), F.col("next_text"))).drop("next_text")
    rows = fingerprints.with_fingerprint(rows, "edited", "edited_values")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprints.packed(F.col("values")).alias("fingerprint"),
        fingerprints.packed(F.col("edited_values")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("values"), F.col("edited_values")).alias("near_edited"),
        fingerprints.likeness(F.col("values"), F.col("next_values")).alias("near_next"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.quality(documents(spark, sf_dir).select("doc_id", "text")).select(*columns)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), BYTE_BPE)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(documents(spark, sf_dir), with_kept=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(documents(spark, sf_dir))
    return mix.documents.select("doc_id", "size", "source_size", "target", "taken")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = chat.END + chat.START + "assistant ok"
    added = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(tricky)).toDF(*rows.columns)
    out = chat.format_trees(chat.chains(rows.unionByName(added)))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted")))
    learned = F.transform("loss", lambda s: chat.unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    out = out.withColumn("learned", F.array_join(learned, ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        F.col("tree_id").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), path, WORD_BPE)
    token_files.write_offset_index(spark, path, path + "-index")
    return spark.read.parquet(path + "-index").select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    from strandlake.llm.oracle import SQL

    return SQL
