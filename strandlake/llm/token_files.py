"""Token-id files: length-delimited binary records with masked checksums and an offset index.

A record is ``u64 length | u32 masked CRC-32 of length | payload | u32 masked CRC-32 of payload | 0x0A``,
little-endian. The payload is ``u8 has_id | i64 doc_id | u8 width | ids`` with ids
of 2 or 4 bytes. The closing byte 0x0A is the record separator of Spark's text
writer, through which the files reach whatever store Spark can write to; lengths
alone delimit records, so payloads may hold any byte.
"""

from __future__ import annotations

import itertools
import json
import os
import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from strandlake.llm._common import release_memory, shuffle_width, slices, text_bytes

#: Chunks that a worker remembers; half of the memory is given up when it is full, which changes no result.
REMEMBERED = 500_000
_SPACE, _LETTER, _SIGN = 1, 2, 3
#: Kinds of UTF-8 bytes. 0xC3 leads the small letters from U+00DF to U+00FF, of which 0xB7 would be the sign U+00F7.
_KINDS = np.zeros(256, np.uint8)
_KINDS[list(b" \t\n\v\f\r")] = _SPACE
_KINDS[[*string.ascii_lowercase.encode(), 0xC3, *range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = _LETTER
_KINDS[list(string.punctuation.encode())] = _SIGN
#: Bytes of text whose ids go to one file, and the least ones, where fewer would leave tasks without work.
FILE_BYTES, LEAST_BYTES = 64 << 20, 4 << 20
HEAD = struct.Struct("<QI")
PAYLOAD = struct.Struct("<BqB")
TAIL = struct.Struct("<I")


# The normalizer and splitter of the word vocabularies that WordEncoder may take apart.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def masked_checksum(data: bytes) -> int:
    """CRC-32 rotated right by 15 bits plus a constant, so that checksums of data that hold checksums stay sound."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = 4 if ids.size and int(ids.max()) > 0xFFFF else 2
    payload = PAYLOAD.pack(doc_id is not None, doc_id or 0, wide) + ids.astype(f"<u{wide}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join([length, TAIL.pack(masked_checksum(length)), payload, TAIL.pack(masked_checksum(payload))])


def records(content: bytes | memoryview) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """Offset, length, doc_id and ids (u32) of each record; a ValueError names the first damaged offset."""
    at = 0
    while at < len(content):
        if at + HEAD.size > len(content):
            raise ValueError(f"truncated record at byte {at}")
        length, check = HEAD.unpack_from(content, at)
        if masked_checksum(content[at : at + 8]) != check:
            raise ValueError(f"bad length checksum at byte {at}")
        end = at + HEAD.size + length
        payload = content[at + HEAD.size : end]
        if end + 5 > len(content) or TAIL.unpack_from(content, end)[0] != masked_checksum(payload):
            raise ValueError(f"bad payload checksum at byte {at}")
        has_id, doc_id, wide = PAYLOAD.unpack_from(payload)
        yield at, end + 5 - at, doc_id if has_id else None, np.frombuffer(payload, f"<u{wide}", offset=PAYLOAD.size).astype("<u4")
        at = end + 5


def _pieces(texts: list[bytes]) -> tuple[pa.LargeStringArray, np.ndarray]:
    """The chunks of UTF-8 texts between white space, and the places among them where each text begins and the last one ends.

    A chunk of small letters of Latin-1 and signs behind them is cut in two.
    """
    data = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    kinds = _KINDS[data]
    runs = np.flatnonzero(kinds[1:] != kinds[:-1]) + 1
    kind = np.concatenate([kinds[:1], kinds[runs], kinds[-1:]])
    before, here, after = kind[:-2], kind[1:-1], kind[2:]
    begins = (before == _SPACE) & (here != _SPACE)
    begins[1:] |= (here[1:] == _SIGN) & (after[1:] == _SPACE) & (before[1:] == _LETTER) & begins[:-1]
    # white space is left out, so that pieces lie side by side
    sizes = np.diff(runs, append=data.size) * (here != _SPACE)
    starts = np.append((np.cumsum(sizes) - sizes)[begins], sizes.sum())
    bounds = np.searchsorted(runs[begins], np.cumsum([1, *(len(x) + 1 for x in texts)]))
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(data[kinds != _SPACE])), bounds


def _strings(array: pa.LargeStringArray, which: np.ndarray) -> list[str]:
    return array.filter(pa.array(which)).to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """The tokenizers library behind a memory of white-space delimited chunks: chunk to ids.

    The tokenizer normalizes, lower-cases, drops white space and never joins text across
    it, so the ids of a text are those of its chunks in order. Texts are lowered before
    the look-up where that and normalization can be swapped. Chunks are cut as bytes of
    a whole batch and only its different ones are looked up. New chunks that are
    normalized words of small letters pass the library's model without normalizer and
    splitter, which would leave them as they are; signs behind a word are a piece of
    their own. All other chunks go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] != NORMALIZER or spec["pre_tokenizer"] != SPLITTER or spec["model"]["type"] != "BPE" or spec["model"]["end_of_word_suffix"] != "</w>":
            raise ValueError("not a vocabulary of lower-case words")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # ASCII letters stand for themselves in byte-level vocabularies, other letters take a byte-level pass
        self.ascii, self.plain = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # chunk known[k] has the ids from at[k] to at[k + 1] and was met in hits[k] batches
        self.known, self.ids, self.at, self.hits = pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def _lowered(self, text: str | None) -> bytes:
        text = text or ""
        if "<|" not in text:  # special tokens are found as they are written
            low = text.lower()
            if text.isascii() or "\u03a3" not in text and unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low):
                text = low
        return text.encode("utf-8")

    def _add(self, chunks: pa.LargeStringArray, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Remember new chunks, whose ids lie side by side: their numbers."""
        count = len(self.known)
        self.known = pa.concat_arrays([self.known, chunks])
        self.at = np.concatenate([self.at, ends + self.at[-1]])
        self.ids = np.concatenate([self.ids, ids])
        self.hits = np.concatenate([self.hits, np.zeros(len(chunks), np.int64)])
        return np.arange(count, len(self.known))

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many chunks side by side, and where those of each end."""
        starts = self.at[numbers]
        sizes = self.at[numbers + 1] - starts
        ends = np.cumsum(sizes)
        places = np.repeat(starts - ends + sizes, sizes)
        places += np.arange(places.size)
        return self.ids[places], ends

    def _numbers(self, chunks: pa.LargeStringArray) -> np.ndarray:
        """The numbers of chunks; unknown ones are encoded first."""
        count = len(self.known)
        # what is known comes first, so that its places in the dictionary are its numbers
        found = pa.concat_arrays([self.known, chunks]).dictionary_encode()
        numbers, new = found.indices.to_numpy()[count:].copy(), found.dictionary[count:]
        del found
        if len(new):
            numbers = np.concatenate([np.arange(count), self._learn(new)])[numbers]
        self.hits[numbers] += 1
        return numbers

    def _whole(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [chunks[i : i + 1000] for i in range(0, len(chunks), 1000)]
        ids = [np.array(e.ids, "<u4") for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, "<u4"), *ids]), np.cumsum([x.size for x in ids], dtype=np.int64)

    def _words(self, tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [" ".join(words[i : i + 2048]) for i in range(0, len(words), 2048)]
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(tokenizer.encode_batch_fast([part], add_special_tokens=False)[0].ids, "<u4") for part in parts)])
        return ids, np.flatnonzero(self.ends[ids]) + 1

    def _learn(self, new: pa.LargeStringArray) -> np.ndarray:
        """Encode and remember different chunks that are not known yet: their numbers."""
        stems = pa.compute.ascii_rtrim(new, string.punctuation)
        alone = pa.compute.equal(stems, new).to_numpy(zero_copy_only=False)
        ascii = pa.compute.string_is_ascii(new).to_numpy(zero_copy_only=False)
        # small letters of Latin-1 are seen to be so at once, others one by one
        small = pa.compute.match_substring_regex(stems, "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$").to_numpy(zero_copy_only=False)
        small[~small] = [not b.isascii() and b.isalpha() and b == b.lower() and unicodedata.is_normalized("NFC", b) for b in _strings(stems, ~small)]
        numbers = np.zeros(len(new), np.int64)
        for which, encoded in (
            (~small, self._whole(_strings(new, ~small))),
            (small & alone & ascii, self._words(self.ascii, _strings(new, small & alone & ascii))),
            (small & alone & ~ascii, self._words(self.plain, _strings(new, small & alone & ~ascii))),
        ):
            numbers[which] = self._add(new.filter(pa.array(which)), *encoded)
        which = small & ~alone
        if which.any():
            bases = _strings(stems, which)
            tails = [c[len(b) :] for c, b in zip(_strings(new, which), bases, strict=True)]
            pairs = self._numbers(pa.array(bases + tails, pa.large_string())).reshape(2, -1)
            ids, ends = self._gather(pairs.T.ravel())
            numbers[which] = self._add(new.filter(pa.array(which)), ids, ends[1::2])
        return numbers

    def _forget(self) -> None:
        """Keep the half of the memory that was met in most batches, the newer of equals."""
        kept = np.sort(np.argsort(self.hits, kind="stable")[len(self.hits) // 2 :])
        self.ids, ends = self._gather(kept)
        self.known, self.at, self.hits = self.known.take(pa.array(kept)), np.concatenate([[0], ends]), self.hits[kept] >> 1

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self._forget()
        pieces, bounds = _pieces([self._lowered(t) for t in texts])
        del texts
        spans = pieces.dictionary_encode()
        del pieces
        numbers = self._numbers(spans.dictionary)[spans.indices.to_numpy()]
        del spans
        pa.default_memory_pool().release_unused()  # before arrays of ids take memory of their own
        ids, ends = self._gather(numbers)
        cuts = np.concatenate([[0], ends])[bounds].tolist()
        return [ids[a:b] for a, b in itertools.pairwise(cuts)]


_LOADED: dict[str, WordEncoder] = {}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts and write them as record files in ascending id order.

    File names sort like the ids in them: rows are dealt to files by ranges of the
    id and sorted inside each. Files are as many as the bytes of the texts ask for
    (FILE_BYTES), so none grows with the input. One shuffle moves the texts; ids are
    encoded after it and go straight to the files. Null texts count as empty (the end
    id only), null ids come first, rows with equal ids stay side by side, ordered by a
    hash of the text, by which a range can be cut too. The committer of Spark's writer
    makes retried tasks safe.
    """
    spark = docs.sparkSession
    size = text_bytes(docs, text)
    files = max(1, -(-size // FILE_BYTES), min(shuffle_width(spark), -(-size // LEAST_BYTES)))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("mark", F.xxhash64("text")).repartitionByRange(files, "doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").drop("mark")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _LOADED:
            _LOADED[tokenizer] = WordEncoder(tokenizer)
        for batch in slices(batches, "text"):
            ids = _LOADED[tokenizer].encode_batch(batch.column(1).to_pylist())
            framed = [frame(d, np.append(x, np.uint32(end_id))) for d, x in zip(batch.column(0).to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(framed, pa.binary())], names=["record"])
            del ids, framed
        release_memory()

    framed = rows.mapInArrow(run, "record binary")
    framed.select(F.col("record").cast("string").alias("value")).write.text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """All records of the files: file, offset, length, doc_id, n_tokens, ids_crc32 and ids (array).

    Damaged records raise. Files are read whole, one at a time per task; the writer bounds their size.
    """
    schema = T.StructType.fromDDL("file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, ids array<long>")
    return _parsed(spark, path, schema, with_ids=True)


def _parsed(spark: SparkSession, path: str, schema: T.StructType, with_ids: bool) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int64()))] * with_ids)])
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows = batch.column(0)[i].as_py(), []
                for at, length, doc_id, ids in records(memoryview(batch.column(1)[i].as_buffer())):
                    rows.append((name, at, length, doc_id, ids.size, zlib.crc32(ids.tobytes()), *([ids.astype(np.int64)] * with_ids)))
                    if len(rows) == (200 if with_ids else 20_000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)
        release_memory()

    return files.mapInArrow(run, schema)


def write_offset_index(spark: SparkSession, path: str, index: str) -> None:
    """Write the index of a folder of record files as Parquet, apart from them.

    Per record: file, ordinal in it, offset, length, doc_id, n_tokens, ids_crc32 and
    start (ids of all records before it in file order). Starts need one running sum
    per file and one over the files' totals: one task, with a row per file.
    """
    schema = T.StructType.fromDDL("file string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long")
    rows = _parsed(spark, path, schema, with_ids=False)
    inside = Window.partitionBy("file").orderBy("offset")
    rows = rows.withColumn("ordinal", F.row_number().over(inside)).withColumn("inner", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    rows.write.parquet(index + "-raw")
    rows = spark.read.parquet(index + "-raw")
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    rows = rows.join(totals, "file").withColumn("start", F.col("base") + F.coalesce("inner", F.lit(0))).drop("base", "inner")
    rows.write.parquet(index)
