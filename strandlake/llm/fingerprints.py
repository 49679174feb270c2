"""One-permutation MinHash with optimal densification and packed low-order bits.

Every expression is native. A text's word shingles are hashed once; the hash's
upper part names a bin, the smallest hash of a bin is its value. An empty bin draws
bins at random, the same for every text, until one is filled. Of each value BITS
low-order bits are kept, and likeness corrects for bits that agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm._common import shuffle_width, unused_name, words_of

BINS, BITS, SHINGLE = 128, 8, 5
#: Draws of an empty bin before it ranks the filled ones.
PROBES = 6


def shingle_hashes(words: Column, k: int = SHINGLE) -> Column:
    """XXH64 of every k-word shingle, in place; fewer words: one hash of all; none: an empty array."""
    spaced = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1))), lambda i: F.xxhash64(*(F.get(words, i - 1 + j) for j in range(k))))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(spaced)


def _bin(x: Column, bins: int) -> Column:
    """The bin of a hash: its upper bits, numbered in the order in which signed hashes sort."""
    return (F.shiftright(x, 64 - (bins.bit_length() - 1)) + bins // 2).cast("int")


def _low(x: Column, bits: int) -> Column:
    return x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _densified(kept: Column, filled: Column, bins: int, bits: int) -> Column:
    """The values of all bins from the least hash of each filled bin (kept) and those bins' numbers (filled)."""

    def value(i: Column) -> Column:
        at = F.array_position(filled, i)
        # an empty bin draws bins until one is filled; after PROBES misses it takes the filled bin that its own order ranks first, a draw just as even
        probes = F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda t: F.array_position(filled, F.pmod(F.xxhash64(i, t), F.lit(bins)).cast("int")))
        hit = F.get(F.filter(probes, lambda p: p > 0), F.lit(0))
        ranked = F.array_min(F.transform(kept, lambda x: F.struct(F.xxhash64(i, _bin(x, bins)).alias("order"), x.alias("x"))))["x"]
        return _low(F.when(at > 0, F.get(kept, (at - 1).cast("int"))).otherwise(F.coalesce(F.get(kept, (hit - 1).cast("int")), ranked)), bits)

    return (
        F.when(F.size(kept) == 0, F.array().cast("array<int>"))
        .when(F.size(kept) == bins, F.transform(kept, lambda x: _low(x, bits)))
        .otherwise(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), value))
    )


def packed(values: Column, bits: int = BITS) -> Column:
    """The low-order bits of all bins as one hexadecimal string."""
    digits = -(-bits // 4)
    return F.array_join(F.transform(values, lambda v: F.lpad(F.lower(F.hex(v)), digits, "0")), "")


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints, corrected for bits that agree by chance; two empty ones: 1, one: 0."""
    chance = 2.0**-bits
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    corrected = F.greatest(F.lit(0.0), (same / F.size(a) - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(corrected)


def with_fingerprint(df: DataFrame, text: str, out: str, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Add the fingerprint of whole texts (null: empty): an array of `bits`-bit values of all bins, empty for texts without a word.

    bins has to be a power of two. No shuffle; each step is a projection of its own, so that none is computed twice.
    """
    words, ordered, kept, filled = (unused_name(df, f"_{c}") for c in ("words", "sorted", "kept", "filled"))
    df = df.withColumn(words, words_of(F.col(f"`{text}`")))
    df = df.withColumn(ordered, F.sort_array(shingle_hashes(F.col(words))))
    first = F.filter(ordered, lambda x, i: (i == 0) | (_bin(x, bins) != _bin(F.get(ordered, i - 1), bins)))
    df = df.withColumn(kept, first).withColumn(filled, F.transform(kept, lambda x: _bin(x, bins)))
    return df.withColumn(out, _densified(F.col(kept), F.col(filled), bins, bits)).drop(words, ordered, kept, filled)


def with_next(df: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """Add next_<c> of the row that follows in ascending key (the first follows the last), for each carried column.

    Keys are cut into buckets at quantiles, at most 4 a shuffle partition, and each
    bucket is one window partition. The first row of each bucket also goes, marked, to
    the bucket before, so that no window holds more than a bucket. One shuffle. Equal
    keys are ordered by the carried columns, null keys come first.
    """
    spark = df.sparkSession
    ids = df.select(F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("k"))
    n = 4 * shuffle_width(spark)
    cuts = sorted(set(ids.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10 * n)).first()[0] or []))
    span = 1 << max(1, len(cuts)).bit_length()
    table = F.split(F.lit(",".join(map(str, [*cuts, *[(1 << 63) - 1] * (2 * span - len(cuts))]))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << s) for s in reversed(range(span.bit_length()))))

    def bucket(k: Column) -> Column:
        """How many cuts are at most k, by halving."""
        return F.aggregate(steps, F.lit(0), lambda b, s: F.when((b + s <= len(cuts)) & (k >= F.get(table, b + s - 1)), b + s).otherwise(b))

    firsts = {r["b"]: r["k"] for r in ids.select("k", bucket(F.col("k")).alias("b")).groupBy("b").agg(F.min("k").alias("k")).collect()}
    filled = sorted(firsts)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    first = F.split(F.lit(",".join(str(firsts.get(b, 0)) for b in range(len(cuts) + 1))), ",").cast("array<bigint>")
    previous = F.split(F.lit(",".join(str(before.get(b, 0)) for b in range(len(cuts) + 1))), ",").cast("array<int>")
    k = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    at_key, of_bucket, to, after = (unused_name(df, f"_{c}") for c in ("k", "b", "to", "next"))
    rows = df.withColumn(at_key, k).withColumn(of_bucket, bucket(F.col(at_key)))
    here = F.struct(F.col(of_bucket).alias("at"), F.lit(False).alias("extra"))
    there = F.struct(F.get(previous, F.col(of_bucket)).alias("at"), F.lit(True).alias("extra"))
    rows = rows.withColumn(to, F.explode(F.when(F.get(first, F.col(of_bucket)) == F.col(at_key), F.array(here, there)).otherwise(F.array(here))))
    order = Window.partitionBy(f"{to}.at").orderBy(f"{to}.extra", at_key, *carried)
    following = F.lead(F.struct(*carried)).over(order)
    rows = rows.withColumn(after, following).where(~F.col(f"{to}.extra"))
    given = [c for c in df.columns if c.lower() not in {f"next_{c}".lower() for c in carried}]
    return rows.select(*given, *(F.col(f"{after}.{c}").alias(f"next_{c}") for c in carried))


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter of code points replaced by the first as many (or all) of the following text."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - quarter), F.substr(following, F.lit(1), quarter))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of whole texts and of the successor in ascending id.

    Returns doc_id, text (null: empty), values (array), next_text and next_values.
    Every row of docs gives one row; a single row follows itself.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return with_next(with_fingerprint(rows, "text", "values"), "doc_id", ["text", "values"])
