"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import json
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm._common import SPACES, WORD, written

#: Points are t * STEP mod 2^31, with STEP / 2^31 next to the golden ratio's fraction (odd: all points differ).
STEP, RANGE = 1327217885, 1 << 31
#: Slots whose ranks one window task counts.
CHUNK = 1 << 16
#: Hex digits of a document's shuffling key that name its bucket (4096 buckets a source).
BUCKET_DIGITS = 3


def targets(sizes: list[int], weights: list[int], epochs: Fraction, cap: int) -> list[float]:
    """Shares of epochs * sum(sizes) by weight, none above cap * its size; what is cut off is shared again by weight."""
    capped: set[int] = set()
    total = epochs * sum(sizes)
    while True:
        rest = total - sum(cap * sizes[i] for i in capped)
        open_weight = sum(w for i, w in enumerate(weights) if i not in capped)
        share = {i: rest * w / open_weight for i, w in enumerate(weights) if i not in capped}
        above = {i for i, x in share.items() if x > cap * sizes[i]}
        if not above:
            return [float(cap * sizes[i]) if i in capped else float(share[i]) for i in range(len(sizes))]
        capped |= above


@dataclass
class Mix:
    """documents: a row per input row with its words taken; slots: the schedule, a row per block to read, in order of slot."""

    documents: DataFrame
    slots: DataFrame
    block: int


def _literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def _position(point: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most point, by halving."""
    steps = [1 << k for k in reversed(range(max(1, len(bounds)).bit_length()))]
    held = F.split(F.lit(",".join(map(str, [*bounds, *[RANGE] * (2 * steps[0] - len(bounds))]))), ",").cast("array<bigint>")
    return F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda at, s: F.when(point >= F.element_at(held, at + s), at + s).otherwise(at))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: Fraction = Fraction(3, 2), cap: int = 2, block: int | None = None, id_col: str = "doc_id", source: str = "source", text: str = "text", mark: str | None = None) -> Mix:
    """Mix documents of all sources to target weights.

    Sizes are words (null text: 0). Sources in order of code points, null last, take
    the weights in turn; targets() sets their words. Each source's documents, in the
    order of a hash of their ids, form one stream that is cut into blocks of `block`
    words (None: 1/2^20 of the mix, 1 to 1024). Slot t of the schedule goes to the
    source in whose share of the cumulative weights point t falls, the r-th slot of a
    source reads its block r modulo their number; slots beyond `cap` rounds are void.

    Running sums are split by (source, bucket of the hash) and ranks by (source, chunk
    of slots), so that no source's rows meet in one task; what joins them are totals of
    4096 buckets a source and of chunks. The driver holds one row per source, so the
    number of sources has to be moderate (names, not URLs). Texts are read once, for
    their sizes. Repeated rows are mixed each on its own; rows without a word are
    taken 0 times; an empty table gives no rows. mark: a column that comes along as `mark`
    and orders what is equal otherwise.
    """
    spark = docs.sparkSession
    marks = [] if mark is None else ["mark"]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        *(F.col(f"`{mark}`").alias(m) for m in marks),
        F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = written(rows.withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-sizes")
    sums = sorted(((r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda x: (x[0] is None, (x[0] or "").encode()))
    goals = targets([n for _, n in sums], [weights[i % len(weights)] for i in range(len(sums))], epochs, cap) if sums else []
    wanted = epochs * sum(n for _, n in sums)
    block = block or int(max(1, min(1024, wanted // (1 << 20))))
    table, bounds, so_far = [], [], Fraction(0)
    for i, ((name, size), goal) in enumerate(zip(sums, goals, strict=True)):
        so_far += Fraction(goal)
        bounds.append(int(so_far / wanted * RANGE) if wanted else 0)
        table.append({"s": i, "name": name, "source_size": size, "target": goal, "blocks": -(-size // block)})
    known = _literal_table(spark, table, "s: int, name: string, source_size: bigint, target: double, blocks: bigint")

    # the streams: where each document begins in its source
    streams = rows.join(known, rows["source"].eqNullSafe(known["name"])).drop("name").withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    inside = Window.partitionBy("s", "bucket").orderBy("key", "size", "doc_id", *marks)
    streams = streams.withColumn("n", F.row_number().over(inside)).withColumn("inner", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    totals = rows.join(known, rows["source"].eqNullSafe(known["name"])).groupBy("s", F.substring("key", 1, BUCKET_DIGITS).alias("bucket")).agg(F.sum("size").alias("total"))
    totals = totals.select("s", "bucket", F.coalesce(F.sum("total").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    streams = streams.join(totals, ["s", "bucket"]).withColumn("at", F.col("base") + F.col("inner"))

    # the schedule: slots by point, ranks per source
    count = int(wanted // block) + 1 if wanted else 0
    slots = spark.range(count).select(F.col("id").alias("slot"), (F.col("id") % RANGE * STEP % RANGE).alias("point"))
    slots = slots.select("slot", _position(F.col("point"), bounds[:-1]).alias("s"), F.expr(f"slot div {CHUNK}").alias("chunk"))
    slots = slots.withColumn("n", F.row_number().over(Window.partitionBy("s", "chunk").orderBy("slot")))
    chunks = slots.groupBy("s", "chunk").agg(F.count("*").alias("total"))
    chunks = chunks.select("s", "chunk", F.coalesce(F.sum("total").over(Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    slots = slots.join(chunks, ["s", "chunk"]).withColumn("rank", F.col("base") + F.col("n") - 1).join(known.select("s", "name", "source_size", "blocks"), "s")
    slots = slots.where(F.col("rank") < cap * F.col("blocks")).select(
        "slot", "s", F.col("name").alias("source"), "rank", (F.col("rank") % F.col("blocks")).alias("block"), (F.col("rank") % F.col("blocks") * block).alias("first_word"), F.least((F.col("rank") % F.col("blocks") + 1) * block, F.col("source_size")).alias("end_word")
    )

    # the join of slots and blocks: how often each block is read, and what that takes from each document
    times = slots.groupBy("s", "block").agg(F.count("*").alias("times"))
    parts = streams.select("s", "bucket", "n", "at", "size", F.explode(F.when(F.col("size") > 0, F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}")))).alias("block"))
    overlap = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("at"), F.col("block") * block)
    parts = parts.join(times, ["s", "block"]).groupBy("s", "bucket", "n").agg(
        F.sum(overlap * F.col("times")).alias("taken"), *(F.sum(F.when(F.col("times") > k, overlap).otherwise(0)).alias(f"round_{k + 1}") for k in range(cap))
    )
    out = streams.join(parts, ["s", "bucket", "n"], "left").select("doc_id", "source", *marks, "size", "source_size", "target", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("taken", *(f"round_{k + 1}" for k in range(cap)))))
    return Mix(out, slots.drop("s"), block)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, all bytes between words as they are."""
    pieces = F.regexp_extract_all(text, F.lit(SPACES.replace("+", "*") + WORD), F.lit(0))
    return F.array_join(F.slice(pieces, 1, F.greatest(n, F.lit(1)).cast("int")), "")
