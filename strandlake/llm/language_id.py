"""Language identification by compression.

One zstandard raw-content dictionary per language; a text belongs to the language
whose dictionary encodes it in the fewest bytes. Narrow margins are rejected.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm._common import release_memory, slices, unused_name

UNDETERMINED = "und"
#: Bounds of the fit: different texts sampled per language, characters of a sampled text that count, bytes of a dictionary.
ROWS_PER_LANGUAGE, SAMPLED_CHARS, DICTIONARY_BYTES = 160, 1 << 14, 64 << 10
#: Places of a long text that an excerpt is made of.
EXCERPTS = 8
#: Bytes of text that are encoded at once; texts are cut into pieces of this size so that the dictionary stays in reach to the end.
PIECE = 1 << 12
#: Texts of fewer bytes are encoded behind several carriers, whose own size is taken off: single bytes would round away what tells
#: short texts apart. Those of fewer than FINE bytes take the thorough search and all carriers, others the fast one and half of them.
SHORT, FINE, CARRIERS, CARRIER_WORDS = 600, 100, 16, 32
#: The least share by which the runner-up has to be larger.
MARGIN = 0.001
_LETTER = regex.compile(r"\p{L}")
#: ASCII apart from small letters becomes a space.
_PLAIN = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def normalized(text: str) -> bytes:
    """Lower-case words only: what tells languages apart."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split())


@dataclass
class LanguageModel:
    """languages in order of code points, the dictionary of each, and carriers with words of all."""

    languages: list[str]
    dictionaries: list[bytes]
    carriers: list[bytes]


class Encoders:
    """The encoders of a model, and what its carriers take under each."""

    def __init__(self, model: LanguageModel):
        def built(strategy: int, min_match: int) -> list[zstandard.ZstdCompressor]:
            parameters = zstandard.ZstdCompressionParameters(
                window_log=18, chain_log=16, hash_log=16, search_log=3, min_match=min_match, target_length=16, strategy=strategy, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=parameters) for d in model.dictionaries]

        self.fast, self.fine, self.carriers = built(zstandard.STRATEGY_FAST, 4), built(zstandard.STRATEGY_BTLAZY2, 3), model.carriers
        self.some = model.carriers[: len(model.carriers) // 2]
        self.fast_own = [sum(len(e.compress(c)) for c in self.some) for e in self.fast]
        self.fine_own = [sum(len(e.compress(c)) for c in self.carriers) for e in self.fine]

    def sizes(self, text: str) -> np.ndarray:
        """Bytes that the whole text takes under each dictionary (for short texts the mean behind all carriers)."""
        body = normalized(text)
        if len(body) >= SHORT:
            return np.array([sum(len(e.compress(body[i : i + PIECE])) for i in range(0, len(body), PIECE)) for e in self.fast], dtype=np.float64)
        some, encoders, own = (self.carriers, self.fine, self.fine_own) if len(body) < FINE else (self.some, self.fast, self.fast_own)
        return np.array([(sum(len(e.compress(c + body)) for c in some) - n) / len(some) for e, n in zip(encoders, own, strict=True)])


def excerpt(text: Column, chars: int) -> Column:
    """A text of at most so many characters as it is; of a longer one as many, from places at even distances."""
    part = chars // EXCERPTS
    places = [F.substr(text, (F.floor(F.length(text) * i / EXCERPTS) + 1).cast("int"), F.lit(part)) for i in range(EXCERPTS)]
    return F.when(F.length(text) <= chars, text).otherwise(F.concat_ws(" ", *places))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", rows: int = ROWS_PER_LANGUAGE, chars: int = SAMPLED_CHARS, dictionary_bytes: int = DICTIONARY_BYTES) -> LanguageModel:
    """Learn the dictionaries from labelled rows (null labels and texts don't count).

    Different texts, of any size, are counted over all rows; of each language the `rows`
    with the least hashes are used (all, where it has fewer), of a long one excerpts of
    `chars` characters. Copies of a text change nothing: it comes to the driver once, with
    few more than `rows` others. Texts fill a dictionary in order of their hash.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    known = known.withColumn("h", F.xxhash64("t"))
    counts = {r["l"]: r["n"] for r in known.groupBy("l").agg(F.count_distinct("h").alias("n")).collect()}
    if not counts:
        return LanguageModel([], [], [])
    rank = F.pmod("h", F.lit(1 << 40))
    sample: dict[str, list[tuple[int, str]]] = {}
    shares = {name: min(1.0, (rows + 8 * math.sqrt(rows)) / n) for name, n in counts.items()}
    while shares:
        wanted = F.lit(False)
        for name, share in shares.items():
            wanted = wanted | ((F.col("l") == name) & (rank < int(share * (1 << 40))))
        found: dict[str, list[tuple[int, str]]] = {}
        for r in known.where(wanted).groupBy("l", "h").agg(F.min(excerpt(F.col("t"), chars)).alias("t")).collect():
            found.setdefault(r["l"], []).append((r["h"] % (1 << 40), r["t"]))
        sample |= {name: sorted(found.get(name, []))[:rows] for name in shares}
        # hashes that leave fewer below the share than it was drawn for: a larger one
        shares = {name: min(1.0, 4 * share) for name, share in shares.items() if len(sample[name]) < min(rows, counts[name])}
    languages = sorted(sample)
    bodies = [b" ".join(normalized(t) for _, t in sample[name]) for name in languages]
    # the carriers' words come from behind the dictionaries, or from all of a body where it has no more
    pools = [(b[dictionary_bytes:].split() or b.split() or [b"a"]) for b in bodies]
    draw, carriers = random.Random(5), []
    for _ in range(CARRIERS):
        words = [draw.choice(p) for p in pools for _ in range(-(-CARRIER_WORDS // len(pools)))]
        draw.shuffle(words)
        carriers.append(b" ".join(words) + b" ")
    return LanguageModel(languages, [(b + b" " * 8)[:dictionary_bytes] for b in bodies], carriers)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", margin: float = MARGIN, prefix: str = "lang_") -> DataFrame:
    """Add <prefix>pred, <prefix>score, <prefix>margin and <prefix>rejected for whole texts.

    pred: the language of the smallest encoding (ties: the first by code point), or
    `und` for null texts and texts without a letter. margin: by which share the
    runner-up is larger. score: the share of belief in pred when a byte more halves it
    per 1/64 of the text's size, 0 for und. rejected: und, or margin below `margin`.
    Other columns stay; columns named like the new ones are replaced. No shuffle; a
    task holds the dictionaries and one Arrow batch.
    """
    new = [f"{prefix}pred", f"{prefix}score", f"{prefix}margin", f"{prefix}rejected"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in new}])
    source = unused_name(docs, "_text")
    kept = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{new[0]}` string", f"`{new[1]}` double", f"`{new[2]}` double", f"`{new[3]}` boolean"])

    def one(text: str | None, encoders: Encoders) -> tuple[str, float, float]:
        if not text or not model.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, 0.0
        sizes = np.maximum(encoders.sizes(text), 1.0)
        best = int(sizes.argmin())
        rest = np.delete(sizes, best)
        beliefs = np.exp2(-64.0 * (sizes - sizes[best]) / max(64, sizes[best]))
        return model.languages[best], float(1 / beliefs.sum()), float(rest.min() / sizes[best] - 1) if rest.size else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(model)
        for batch in slices(batches, source):
            found = [one(t, encoders) for t in batch.column(batch.schema.get_field_index(source)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.float64())]
            columns.append(pa.array([x[0] == UNDETERMINED or x[2] < margin for x in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])
        del encoders
        release_memory()

    return docs.withColumn(source, F.col(f"`{text}`")).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that take no part in fitting: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
