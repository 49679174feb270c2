"""Quality rules: a threshold table compiled into one projection of text ratios."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm._common import unused_name, words_of

# Function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in a is that for on with as was it by are be this at from or an "
    "der die das und in zu den ist von mit im für auf nicht ein eine des dem sich als "
    "de la que el en y los del se las un por con una su para es al lo como "
    "le les des et du une est dans pour qui sur par au pas plus avec"
).split()


@dataclass(frozen=True)
class Rule:
    """numerator / denominator has to lie in [low, high]; a zero denominator passes."""

    name: str
    numerator: str
    denominator: str
    low: float | None = None
    high: float | None = None


#: Ratios are of the measures that measures() adds. The bounds leave clean prose of four languages inside: short texts
#: with a boilerplate line or two repeat a third of their lines, none of them more than that and up to a half.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.2),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 0.5),
)
MIN_WORDS = 50


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the base measures of whole texts; null texts count as empty.

    Added (long, replacing columns of the same names): n_words, word_chars,
    n_symbols, n_lines (lines with a word), n_dup_lines, n_stop_words,
    n_repeat_words. No shuffle: everything is computed where a row is read.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words"]
    kept = [c for c in docs.columns if c.lower() not in names]
    words, lines, bits, windows, hits = (unused_name(docs, f"_{c}") for c in ("words", "lines", "bits", "windows", "hits"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    held = F.col(words)
    out = docs.select(
        *(F.col(f"`{c}`") for c in kept),
        words_of(F.col(f"`{text}`")).alias(words),
        F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
        (F.length(body) - F.length(F.regexp_replace(body, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
    )
    # each window is one long: a hash above, its place in the low bits
    out = out.withColumn(bits, F.length(F.bin(F.size(held))).cast("int"))
    packed = f"shiftleft(xxhash64({words}[i], {words}[i + 1], {words}[i + 2]), {bits}) | cast(i as bigint)"
    out = out.withColumn(windows, F.expr(f"case when size({words}) < 3 then cast(array() as array<bigint>) else sort_array(transform(sequence(0, size({words}) - 3), i -> {packed})) end"))
    # equal windows stand side by side after the sort of longs; their words are compared too, so that hash collisions don't count
    place = f"cast({windows}[{{k}}] & (shiftleft(1L, {bits}) - 1) as int)"
    equal = f"shiftrightunsigned({windows}[k], {bits}) = shiftrightunsigned({windows}[{{o}}], {bits}) and " + " and ".join(f"{words}[{place.format(k='k')} + {j}] = {words}[{place.format(k='{o}')} + {j}]" for j in range(3))
    hit = f"((k > 0 and {equal.replace('{o}', 'k - 1')}) or (k + 1 < size({windows}) and {equal.replace('{o}', 'k + 1')}))"
    out = out.withColumn(hits, F.expr(f"case when size({windows}) < 2 then cast(array() as array<int>) else sort_array(transform(filter(sequence(0, size({windows}) - 1), k -> {hit}), k -> {place.format(k='k')})) end"))
    stop = F.array(*(F.lit(w) for w in dict.fromkeys(STOP_WORDS)))
    return out.select(
        *(F.col(f"`{c}`") for c in kept),
        F.size(held).cast("long").alias("n_words"),
        F.length(F.array_join(held, "")).cast("long").alias("word_chars"),
        F.col("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(held, lambda w: F.array_contains(stop, F.rtrim(F.lower(w), F.lit(".,"))))).cast("long").alias("n_stop_words"),
        F.expr(f"case when size({hits}) = 0 then 0L else cast(3 + aggregate(sequence(1, size({hits})), 0, (s, k) -> s + case when k < size({hits}) then least(3, {hits}[k] - {hits}[k - 1]) else 0 end) as bigint) end").alias("n_repeat_words"),
    )


def verdict(rules: Sequence[Rule] = RULES) -> Column:
    """The table as one boolean expression over the measures."""
    passed = F.lit(True)
    for r in rules:
        top, bottom = F.col(r.numerator), F.col(r.denominator)
        if r.low is not None:
            passed = passed & ((bottom == 0) | (top >= F.lit(r.low) * bottom))
        if r.high is not None:
            passed = passed & ((bottom == 0) | (top <= F.lit(r.high) * bottom))
    return passed


def quality(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, min_words: int = MIN_WORDS) -> DataFrame:
    """Add the measures, base_failed and kept; see measures().

    base_failed: fewer than min_words words, or more than half of the words inside
    repeated 3-word windows. kept: not base_failed and within all thresholds.
    Rows are never merged, so repeated rows get equal verdicts; an empty table gives none.
    """
    clear = docs.drop(*[c for c in docs.columns if c.lower() in ("base_failed", "kept")])
    out = measures(clear, text)
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
