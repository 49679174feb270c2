"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a piece of text exactly one token can come last in its
encoding. An automaton reports the vocabulary entries that end at each byte; of
these, the last token is the one that is compatible with the last token of what
precedes it. Following the stored tokens backwards emits the ids. Two tokens are
compatible when no merge reaches across their border before both are complete.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._common import release_memory, slices, unused_name

NEVER = 1 << 60
#: Distinct pieces whose ids a worker remembers; the memory is emptied when it is full, which changes no result.
REMEMBERED = 250_000
#: Pairs of tokens whose border is remembered, likewise.
REMEMBERED_PAIRS = 300_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixBpe:
    """A byte-level BPE tokenizer file, encoded by the last token of each prefix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level vocabulary")
        alphabet, model = byte_alphabet(), spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {k: v for k, v in model["vocab"].items() if k not in self.special}
        self.bytes_of = {i: bytes(alphabet[c] for c in token) for token, i in vocabulary.items()}
        self.bytes_of |= {i: text.encode() for text, i in self.special.items()}
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, made = vocabulary[left], vocabulary[right], vocabulary[left + right]
            self.pair_rank.setdefault((a, b), rank)
            if made not in self.parts:
                self.parts[made], self.rank[made] = (a, b), rank
                if max(self.rank.get(a, -1), self.rank.get(b, -1)) >= rank:
                    raise ValueError("a merge precedes its parts")
        self.fits: dict[tuple[int, int], bool] = {}
        self._matcher = ahocorasick.Automaton()
        sound = set()
        for token in sorted((t for t in self.bytes_of if t not in self.special.values()), key=lambda t: self.rank.get(t, -1)):
            # a token is met only if encoding its own bytes gives it back
            parts = self.parts.get(token)
            if parts is None and len(self.bytes_of[token]) > 1 or parts and not (sound.issuperset(parts) and self._border(*parts, whole=token)):
                continue
            sound.add(token)
            self._matcher.add_word(self.bytes_of[token].decode("latin-1"), (len(self.bytes_of[token]), token))
        self._matcher.make_automaton()
        self._specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        # The splitting pattern of byte-level vocabularies.
        self._pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        self._known: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> list[int]:
        """What stands at one end of a token as it grows, the single byte first."""
        out = [token]
        while out[-1] in self.parts:
            out.append(self.parts[out[-1]][side])
        return out[::-1]

    def _border(self, a: int, b: int, whole: int | None = None) -> bool:
        """Whether a and b complete before a merge across their border applies; whole: but for the merge of both into it."""
        left, right, i, j = self._spine(a, 1), self._spine(b, 0), 0, 0
        while True:
            grow_a = self.rank[left[i + 1]] if i + 1 < len(left) else NEVER
            grow_b = self.rank[right[j + 1]] if j + 1 < len(right) else NEVER
            across = self.pair_rank.get((left[i], right[j]), NEVER)
            if across < grow_a and across <= grow_b:  # of equal merges, the left one comes first
                return whole is not None and i + 1 == len(left) and j + 1 == len(right)
            if grow_a == grow_b == NEVER:
                return True
            if grow_a <= grow_b:
                i += 1
            else:
                j += 1

    def encode_piece(self, piece: bytes) -> list[int]:
        last: list[tuple[int, int] | None] = [None] * (len(piece) + 1)
        fits = self.fits
        for end, match in self._matcher.iter(piece.decode("latin-1")):
            end += 1
            if last[end] is not None:
                continue
            before = end - match[0]
            if before == 0:
                last[end] = match
            elif last[before] is not None:
                pair = (last[before][1], match[1])
                if (ok := fits.get(pair)) is None:
                    if len(fits) > REMEMBERED_PAIRS:
                        fits.clear()
                    ok = fits[pair] = self._border(*pair)
                if ok:
                    last[end] = match
        out, at = [], len(piece)
        while at:
            size, token = last[at]
            out.append(token)
            at -= size
        return out[::-1]

    def _packed(self, text: str) -> bytes:
        """The ids of text without special tokens, as packed native int32."""
        known, out = self._known, []
        for piece in self._pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = np.array(self.encode_piece(piece.encode("utf-8")), dtype=np.int32).tobytes()
                if len(piece) <= 256:
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)

    def encode_packed(self, text: str) -> bytes:
        if self._specials is None or "<" not in text and not any(s in text for s in self.special):
            return self._packed(text)
        out, at = [], 0
        for m in self._specials.finditer(text):
            out += [self._packed(text[at : m.start()]), np.int32(self.special[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._packed(text[at:])])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype=np.int32).tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", errors="replace")


_LOADED: dict[str, PrefixBpe] = {}


def loaded(path: str) -> PrefixBpe:
    """One tokenizer per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = PrefixBpe(path)
    return _LOADED[path]


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the token ids of whole texts and the text decoded from them.

    tokenizer: path of a byte-level ``tokenizers`` file that every executor can
    open. No shuffle: each Arrow batch is encoded where it is read, so memory is
    bounded by a batch, and lost executors only repeat their tasks.

    Null texts count as empty: no ids, decoded to the empty string. Repeated rows
    stay. Columns of df that are named like the new ones are replaced.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in (ids.lower(), decoded.lower())])
    source = unused_name(df, "_text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"`{ids}` array<int>", f"`{decoded}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(tokenizer)
        for batch in slices(batches, source):
            packed = [model.encode_packed(t or "") for t in batch.column(batch.schema.get_field_index(source)).to_pylist()]
            values = np.frombuffer(b"".join(packed), dtype=np.int32)
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            back = [model.decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)]
            kept = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != source]
            names = [n for n in batch.schema.names if n != source]
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(back, pa.string())], names=[*names, ids, decoded])
        release_memory()

    return df.withColumn(source, F.col(f"`{text}`")).mapInArrow(run, schema)
