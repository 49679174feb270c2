"""Stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame.

Each takes documents (doc_id, text, lang, source, n_chars and whatever else, under any
names) and, but for the last, returns the same columns. n_chars is renewed where a stage
changes a text. Inside of a stage columns bear numbered names, so no column of the
documents can be taken for a helper.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandlake.llm import bpe, language_id as lid, mixing, simhash, substring_dedup as repeats
from strandlake.llm._common import plain_names, written


def _given_back(rows: DataFrame, docs: DataFrame, names: dict[str, str], text: Column | None = None) -> DataFrame:
    """The columns of docs under their own names; with another text, and its length where they have one."""
    own = {c: F.col(n) for c, n in names.items()}
    if text is not None:
        rows = rows.withColumn("text_now", text)
        own["text"] = F.col("text_now")
        if "n_chars" in own:
            own["n_chars"] = F.length("text_now").cast(docs.schema["n_chars"].dataType)
    return rows.select(*(x.alias(c) for c, x in own.items()))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: no letter, or an encoding margin that is too narrow.

    The dictionaries are learnt from the rows of docs with a language. Null and empty texts go.
    """
    rows, at = plain_names(docs)
    found = lid.identify(rows, lid.fit(rows, text=at["text"], lang=at["lang"]), text=at["text"], prefix="lang_")
    return _given_back(found.where("not lang_rejected"), docs, at)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked fingerprints: one with the least id, and of those with the least fingerprint.

    Where an id repeats with different texts, each text goes with its own group. Documents
    with a null id stay as they are. Fingerprints are taken twice, so that texts are
    shuffled once, for the join with the kept ids and fingerprints.
    """
    rows, at = plain_names(docs)
    doc_id, text = at["doc_id"], at["text"]
    least = simhash.classes(rows, doc_id, text).where("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("fp").alias("kept_fp"))
    kept = written(least.select(F.col("doc_id").alias("kept_id"), "kept_fp"), "kept-ids")
    marked = simhash.with_fingerprint(rows, "fp", text).join(kept, (F.col(doc_id) == F.col("kept_id")) & (F.col("fp") == F.col("kept_fp")), "left_semi")
    first = Window.partitionBy(doc_id, "fp").orderBy(F.xxhash64(text))
    marked = marked.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "fp")
    return _given_back(marked.unionByName(rows.where(F.col(doc_id).isNull())), docs, at)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what repeats from documents with smaller ids; documents of which nothing is left go.

    Bytes are judged and cut by the operator; where a cut leaves part of a character, that
    part goes too. All columns travel with the texts through the operator's blocks, so
    no join is needed and repeated or null ids keep a row each.
    """
    rows, at = plain_names(docs)
    doc_id, text = at["doc_id"], at["text"]
    cut = repeats.remove_repeats(rows, doc_id, text, with_kept=True, carried=[c for c in at.values() if c not in (doc_id, text)])
    cut = cut.where("n_removed = 0 or n_removed < n_bytes").withColumn(doc_id, F.col("doc_id").cast(docs.schema["doc_id"].dataType)).withColumn(text, F.col("text"))
    return _given_back(cut, docs, at, F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Read each document as often as the mix takes it: 0 to 2 rows, each with the words of the blocks that the schedule reads.

    A source's slots read its blocks in order and begin again behind the last one, so what a
    round reads of a document is all of it, or the words before the last block's end, with
    all bytes between them as they are. Rows of one id, source and text are matched in
    order of a hash of their other columns.
    """
    rows, at = plain_names(docs)
    doc_id, text, source = at["doc_id"], at["text"], at["source"]
    rows = rows.withColumn("mark", F.xxhash64(text))
    taken = mixing.mix_sources(rows, id_col=doc_id, source=source, text=text, mark="mark").documents
    taken = taken.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("mark").alias("m"), "size", "round_1", "round_2")
    taken = taken.withColumn("i", F.row_number().over(Window.partitionBy("d", "s", "m").orderBy("round_1", "round_2")))
    taken = written(taken, "mix-taken")
    hashed = [f.name for f in rows.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(doc_id, source, "mark").orderBy(F.xxhash64(*hashed))))
    rows = rows.join(taken, F.col(doc_id).eqNullSafe(F.col("d")) & F.col(source).eqNullSafe(F.col("s")) & (F.col("mark") == F.col("m")) & (F.col("n") == F.col("i")))
    rows = rows.withColumn("words", F.explode(F.filter(F.array("round_1", "round_2"), lambda w: w > 0)))
    return _given_back(rows, docs, at, F.when(F.col("words") == F.col("size"), F.col(text)).otherwise(mixing.first_words(F.col(text), F.col("words"))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts: doc_id, lang, source, n_tokens, ids, and whether decoding gives the text back."""
    rows = docs.select("doc_id", "text", "lang", "source")
    rows = bpe.bpe_encode(rows, public_tokenizers.path("byte_bpe_50k.json"))
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("restored"))
