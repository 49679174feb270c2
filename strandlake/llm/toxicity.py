"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

What was typed is taken as a noisy form of what was meant: letters replaced by
look-alikes, words spaced out, letters repeated. A suspicious stretch becomes a
lattice of what each character may stand for; Viterbi decoding under a character
trigram model of the whole corpus picks the reading. Words of the restored text,
and their beginnings, then testify by how much oftener toxic texts use them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import simhash
from strandlake.llm._common import slices, unused_name

#: Bound of the fit: labelled rows, in expectation. Their texts count whole.
SAMPLE_ROWS = 8000
#: Restored tokens that a worker remembers; the memory is emptied when full, which changes no result.
REMEMBERED = 300_000
# What look-alikes may stand for.
LOOK_ALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
#: Costs (nats) of the channel: a look-alike for a letter, a dropped repetition, a dropped separator, a symbol that stands for itself.
REPLACED, REPEATED, SPACED, ITSELF = 1.0, 0.7, 1.0, 2.0
#: Symbols of the model: space and punctuation, a to z, other letters, digits and signs.
SPACE, OTHER, SIGN, SYMBOLS = 0, 27, 28, 29
_CODE = np.full(256, SIGN, np.uint8)
_CODE[[*b" \t\n\r\x0b\x0c.,;:!?'\"()-"]] = SPACE
_CODE[0x61:0x7B] = np.arange(1, 27)
_CODE[0xC0:] = OTHER
_CODE[0x80:0xC0] = 255  # the rest of a character that its first byte stands for

_LOOK = "".join(map(regex.escape, LOOK_ALIKES))
#: Where a token turns suspicious: look-alikes between letters, before the first or (one or two, not `!`) after the last one; a letter three times in a row.
_ANCHOR = regex.compile(rf"\p{{L}}[{_LOOK}]+\p{{L}}|(?<![^\s\"'])[0-9@$+€|!]+\p{{L}}|\p{{L}}[0-9@$+€]{{1,2}}(?![^\s.,;:!?])|(\p{{L}})\1\1")
#: Three and more single letters or look-alikes set apart by one sign each (stretches without a letter stay as they are).
_SPACED = regex.compile(rf"(?<!\S)[\p{{L}}{_LOOK}](?:([ ._*\-])[\p{{L}}{_LOOK}])(?:\1[\p{{L}}{_LOOK}])+(?![^\s.,;:!?])")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_TOKENS = re.compile(r"(\s+)")
#: Signs at the edges of a token that only decorate it.
_EDGES = regex.compile(r"^(?:([^\p{L}\p{N}\s])\1{2,}|[\"'(\[{<*_.,;:]+)+|(?:([^\p{L}\p{N}\s])\2{2,}|[\"')\]}>*_.,;:!?|]+)+$")
_NOT_WORD = regex.compile(r"[^\p{L}\p{M}\p{N}]+")


_LETTER, _LOOKS, _LEADS, _APART, _SPACES, _ENDS = (np.zeros(256, bool) for _ in range(6))
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOOKS[[*b"0123456789@$+"]] = True
_LEADS[[*b"0123456789@$+!|("]] = True
_APART[[*b" ._*-"]] = True
_SPACES[[*b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"]] = _SPACES[0x80:] = True
_ENDS[[*b".,;:!?"]] = True
_ENDS |= _SPACES | _APART


def suspicious(text: str) -> bool:
    """Whether a lower-case text may hold a suspicious stretch (never false where it does): a quick look at its bytes."""
    b = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)
    if not text.isascii():
        b = b[(b & 0xC0) != 0x80]  # each letter by its first byte
        if "€" in text or _TRIPLE.search(text):
            return True
    letter, look = _LETTER[b], _LOOKS[b]
    if (look[1:] & letter[:-1]).any() or (_LEADS[b[:-1]] & letter[1:]).any():
        return True
    same = (b[1:] == b[:-1]) & letter[1:] & (b[1:] < 0x80)
    if (same[1:] & same[:-1]).any():
        return True
    if len(b) < 7:
        return False
    # two of a stretch side by side, one of them a letter
    single = letter | _LEADS[b]
    pair = single[1:-3] & _APART[b[2:-2]] & single[3:-1] & (letter[1:-3] | letter[3:-1])
    return bool((pair & (_SPACES[b[:-4]] | _APART[b[:-4]]) & _ENDS[b[4:]]).any())


def symbols(text: str) -> np.ndarray:
    codes = _CODE[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    return codes[codes != 255]


def count_trigrams(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Trigram counts of the symbols of all texts, each between two spaces.

    Counted per task and summed by the trigram's number: at most SYMBOLS^3 rows leave a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches, "text"):
            for t in batch.column(0).to_pylist():
                s = np.concatenate([[SPACE, SPACE], symbols(t or ""), [SPACE]]).astype(np.int32)
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["trigram", "n"])

    out = np.zeros(SYMBOLS**3, np.int64)
    counted = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        out[r["trigram"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Costs (-log p) of a symbol after two others, by interpolation of trigrams, bigrams and single symbols."""
    single = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + SYMBOLS)
    pairs = counts.sum(axis=0)
    double = (pairs + 20 * single) / (pairs.sum(axis=1, keepdims=True) + 20)
    triple = (counts + 20 * double[None]) / (counts.sum(axis=2, keepdims=True) + 20)
    return -np.log(triple)


def _code(c: str) -> int:
    if "a" <= c <= "z":
        return ord(c) - 96
    return SPACE if c == " " else OTHER if c.isalpha() else SIGN


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """What each character may stand for, with the channel's costs; '' is a dropped one."""
    out: list[list[tuple[str, float]]] = []
    for i, c in enumerate(stretch):
        if c in LOOK_ALIKES:
            repeated = i > 0 and stretch[i - 1] == c
            out.append([*((x, REPLACED) for x in LOOK_ALIKES[c]), (c, ITSELF), *([("", REPEATED)] if repeated else [])])
        elif c.isalpha():
            alone = i == 0 or stretch[i - 1] != c
            out.append([(c, 0.0)] if alone or c * 3 not in stretch[max(0, i - 2) : i + 3] else [(c, 0.0), ("", REPEATED)])
        else:
            out.append([(c, 0.0), ("", SPACED)])
    return out


def decode(stretch: str, costs) -> tuple[str, float]:
    """The cheapest reading of a lower-case stretch, and its cost (Viterbi; ties: the reading met first)."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(SPACE, SPACE): (0.0, None)}
    for choices in lattice(stretch):
        following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, back) in states.items():
            for c, more in choices:
                if c:
                    k = _code(c)
                    state, total = (b, k), cost + more + costs[a][b][k]
                    link = (c, back)
                else:
                    state, total, link = (a, b), cost + more, back
                if state not in following or total < following[state][0]:
                    following[state] = (total, link)
        states = following
    (a, b), (cost, link) = min(states.items(), key=lambda s: s[1][0] + costs[s[0][0]][s[0][1]][SPACE])
    out, cost = [], cost + costs[a][b][SPACE]
    while link:
        out.append(link[0])
        link = link[1]
    return "".join(reversed(out)), cost


def decode_spaced(stretch: str, costs) -> str:
    """Letters and look-alikes set apart are one word, or stay as they are: whichever the model finds cheaper; more separators than letters of a word cost the channel once.

    Look-alikes before the first or after the last letter may belong to the word or stand for themselves.
    """
    singles = stretch[::2]
    letters = [i for i, c in enumerate(singles) if c not in LOOK_ALIKES]
    if not letters:
        return stretch

    def apart(part: str) -> float:
        a = b = SPACE
        cost = 0.0
        for i, c in enumerate(part):
            k = SPACE if i % 2 else _code(c)
            cost, a, b = cost + costs[a][b][k], b, k
        return cost

    out, least = stretch, apart(stretch + " ")
    for first in sorted({0, letters[0]}):
        for last in sorted({letters[-1] + 1, len(singles)}, reverse=True):
            if last - first < 3:
                continue
            before, after = stretch[: 2 * first], stretch[2 * last :]
            joined, together = decode(singles[first:last], costs)
            together += SPACED + apart(before) + (apart(after + " ") if after else 0.0)
            if together < least:
                out, least = before + joined + stretch[2 * last - 1 : 2 * last] + after, together
    return out


#: Lengths of word beginnings that may testify.
BEGINNINGS = range(4, 9)


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)]


#: From which weight on a word is strong, and the bounds of what all words and strong words testify.
STRONG, MOST_RATIO, MOST_STRONG = 3.5, 30.0, 5.0


def bounded(weights: list[float]) -> tuple[float, float]:
    return max(-MOST_RATIO, min(MOST_RATIO, sum(weights))), min(MOST_STRONG, sum(w for w in weights if w >= STRONG))


class _TokenWeights(dict):
    """White-space delimited tokens to the summed weights of their words."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> float:
        self[token] = out = sum(map(self.model.weight, [token] if token.isalpha() else _NOT_WORD.sub(" ", token).split()))
        return out


@dataclass
class ToxicityModel:
    """The language model's costs, the log ratio of each telling word or beginning (`word` or `beginning*`), and the calibration."""

    costs: np.ndarray
    weights: dict[str, float]
    plain: float
    slope: float
    strong_slope: float
    shift: float
    _known: dict[str, str] = field(default_factory=dict)
    _tokens: _TokenWeights | None = None
    _lists: list | None = None
    _heads: frozenset[str] = frozenset()

    def __post_init__(self):
        self.testify(self.weights)

    def testify(self, weights: dict[str, float]) -> None:
        self.weights, self._tokens = weights, None
        self._heads = frozenset(f.rstrip("*")[: BEGINNINGS[0]] for f in weights)

    def __getstate__(self):
        return {**self.__dict__, "_known": {}, "_tokens": None, "_lists": None}

    def restored(self, text: str) -> str:
        """The text in lower case with suspicious stretches replaced by their readings."""
        text = text.lower()
        if not suspicious(text):
            return text
        self._lists = self._lists or self.costs.tolist()
        text = _SPACED.sub(lambda m: decode_spaced(m[0], self._lists), text)
        return "".join([t if t.isspace() or t.rstrip(".,").isalpha() and not _TRIPLE.search(t) else self._read(t) for t in _TOKENS.split(text)])

    def _read(self, token: str) -> str:
        if (out := self._known.get(token)) is None:
            if len(self._known) > REMEMBERED:
                self._known.clear()
            core = _EDGES.sub("", token) if _ANCHOR.search(token) else None
            out = self._known[token] = token if core is None else decode(core, self._lists)[0]
        return out

    def words(self, text: str) -> list[str]:
        return _NOT_WORD.sub(" ", self.restored(text)).split()

    def evidence(self, text: str) -> tuple[float, float]:
        """The log likelihood ratio of the text's words, and what strong words alone testify; both bounded."""
        if self._tokens is None:
            self._tokens = _TokenWeights(self)
        elif len(self._tokens) > REMEMBERED:
            self._tokens.clear()
        weights = list(map(self._tokens.__getitem__, self.restored(text).split()))
        return bounded(weights)

    def weight(self, word: str) -> float:
        if word[: BEGINNINGS[0]] not in self._heads:
            return self.plain
        found = [self.weights[f] for f in features(word) if f in self.weights]
        return max(found) if found else self.plain

    def score(self, text: str | None) -> float:
        ratio, strong = self.evidence(text or "")
        x = self.slope * ratio + self.strong_slope * strong + self.shift
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", corpus: DataFrame | None = None, rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """Learn from labelled rows; the character model from all texts of `corpus` (None: docs).

    Of the labelled ids (null labels don't count; an id with several labels counts as
    toxic if one is) about `rows` are chosen by a hash of the id; that bound makes their
    broadcast safe. Their whole texts are restored where they lie; what is shuffled and
    comes to the driver are the different words of each, with their counts, once for equal texts.
    """
    model = ToxicityModel(language_model(count_trigrams(docs if corpus is None else corpus, text)), {}, 0.0, 1.0, 0.0, 0.0)
    marked = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label).cast("int").alias("y"))
    n = marked.count()
    if n > rows:
        marked = marked.where(F.pmod(F.xxhash64("i"), F.lit(1 << 40)) < int(rows / n * (1 << 40)))
    texts = docs.select(F.col(id_col).alias("d"), F.col(text).alias("t"))
    chosen = texts.join(F.broadcast(marked), F.col("d") == F.col("i")).select("t", "y", F.xxhash64(F.coalesce("t", F.lit(""))).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            texts = [t or "" for t in batch.column(0).to_pylist()]
            found = [sorted(Counter(model.words(t)).items()) for t in texts]
            columns = [pa.array(map(simhash.fingerprint, texts), pa.int64()), pa.array([[w for w, _ in f] for f in found], pa.list_(pa.string())), pa.array([[c for _, c in f] for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=["y", "h", "fp", "words", "counts"])

    sample = chosen.mapInArrow(run, "y int, h long, fp long, words array<string>, counts array<long>").groupBy("h", "y").agg(F.min(F.struct("fp", "words", "counts")).alias("s"))
    # columns, not objects: the driver holds each word as a number
    sample = sample.select("h", "y", "s.fp", "s.words", "s.counts").toArrow().sort_by([("h", "ascending"), ("y", "ascending")])
    use = _without_near_copies(sample.column("fp").to_numpy().view(np.uint64))
    toxic = sample.column("y").to_numpy() == 1
    lists, numbers = (pa.chunked_array(sample.column(c).chunks, sample.column(c).type).combine_chunks() for c in ("words", "counts"))
    encoded, times = lists.flatten().dictionary_encode(), numbers.flatten().to_numpy()
    vocabulary, word = encoded.dictionary.to_pylist(), encoded.indices.to_numpy()
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    both, tokens = [], []
    for chosen_rows in (use & ~toxic, use & toxic):
        here = chosen_rows[row]
        both.append(np.bincount(word[here], weights=times[here], minlength=len(vocabulary)).astype(np.int64))
        tokens.append(int(times[here].sum()))
    if not tokens[0] or not tokens[1]:
        model.shift = -3.0 if not tokens[1] else 3.0
        return model
    texts_with: Counter = Counter()
    starts = np.searchsorted(row, np.arange(len(lists) + 1))
    for r in np.flatnonzero(use & toxic).tolist():
        texts_with.update({f for i in word[starts[r] : starts[r + 1]].tolist() for f in features(vocabulary[i])})
    counts: list[Counter] = [Counter(), Counter()]
    for y in (0, 1):
        for i in np.flatnonzero(both[y]).tolist():
            for f in features(vocabulary[i]):
                counts[y][f] += int(both[y][i])
    share, telling, excess = tokens[1] / tokens[0], {}, 0.0
    for f, c in counts[1].items():
        expected = counts[0][f] * share
        if c >= 4 and texts_with[f] >= 3 and c > 3 * expected and (c - expected) ** 2 / (expected + 1) > 15:
            telling[f] = math.log((c + 1) / (expected + 1))
    for i in np.flatnonzero(both[1]).tolist():
        if any(f in telling for f in features(vocabulary[i])):
            excess += max(0.0, int(both[1][i]) - int(both[0][i]) * share)
    model.plain = math.log1p(-min(0.5, excess / tokens[1]))
    model.testify(telling)
    weights = np.array([model.weight(w) for w in vocabulary])[word]
    told = weights * times
    ratio, strong = (np.bincount(row, weights=x, minlength=len(lists))[use] for x in (told, np.where(weights >= STRONG, told, 0.0)))
    x = np.column_stack([np.clip(ratio, -MOST_RATIO, MOST_RATIO), np.minimum(strong, MOST_STRONG)])
    model.slope, model.strong_slope, model.shift = _calibrated(x, toxic[use].astype(float))
    return model


def _without_near_copies(fingerprints: np.ndarray) -> np.ndarray:
    """Which texts' SimHash doesn't lie near that of an earlier one that stays: copies would make chance words telling."""
    seen, kept = np.zeros(len(fingerprints), np.uint64), []
    for i, fp in enumerate(fingerprints):
        if not kept or int(np.bitwise_count(seen[: len(kept)] ^ fp).min()) > simhash.DISTANCE:
            seen[len(kept)] = fp
            kept.append(i)
    use = np.zeros(len(fingerprints), bool)
    use[kept] = True
    return use


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on both testimonies, by Newton's method with a little shrinkage; slopes aren't negative."""
    design, w = np.column_stack([x, np.ones(len(x))]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 0.1 * np.eye(3), design.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(max(w[1], 0.0)), float(w[2])


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", prefix: str = "toxic_", with_restored: bool = False) -> DataFrame:
    """Add <prefix>score (0 to 1) and <prefix>predicted (score >= 0.5) of whole texts, and <prefix>restored if asked for.

    Null and empty texts have no evidence and get the score of that. Other columns stay; columns named like the
    new ones are replaced. No shuffle; a task holds the model (its trigram costs and telling words are bounded by
    the alphabet and the sample) and one Arrow batch.
    """
    new = [f"{prefix}score", f"{prefix}predicted", *([f"{prefix}restored"] if with_restored else [])]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {n.lower() for n in new}])
    source, kept = unused_name(docs, "_text"), docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{new[0]}` double", f"`{new[1]}` int", *([f"`{new[2]}` string"] if with_restored else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source):
            texts = batch.column(batch.schema.get_field_index(source)).to_pylist()
            scores = [model.score(t) for t in texts]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            columns += [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]
            if with_restored:
                columns.append(pa.array([model.restored(t or "") for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return docs.withColumn(source, F.col(f"`{text}`")).mapInArrow(run, schema)
