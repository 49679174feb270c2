"""Exact substring deduplication by prefix-free parsing.

Texts are bytes. A rolling hash of KMER bytes runs over them; a place is a trigger if its
hash is the least in some window of WIDTH bytes, so every string of WIDTH bytes has exactly
one trigger of its own, found from its content alone. What a trigger owns starts side by
side: one stretch of text, with the WIDTH - 1 bytes behind it. Equal strings have equal
triggers, so a hash of the trigger deals all stretches that can repeat to buckets.

A bucket's stretches are highly repetitive text, and there prefix-free parsing runs whole:
a short rolling hash whose value is 0 modulo MODULUS ends a phrase; the different phrases
are the dictionary, each stretch is parsed into their numbers. The suffix array of the
dictionary and that of the parse, both by prefix doubling, combine into the order of all
places of the bucket: first by the rest of the phrase that a place stands in, then by the
rest of the parse. In that order equal strings of WIDTH bytes lie side by side, and the
least document of each run decides what is removed.

Three passes over blocks of documents exchange packed arrays, never one row per byte: which
triggers any other document has; their stretches; the least documents. Blocks and buckets
are sized by bytes, so no task grows with the input. The blocks' texts are shuffled once,
the passes reuse that exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._common import release_memory, shuffle_width, text_bytes, unused_name

WIDTH, KMER = 50, 20
#: The short rolling hash that parses a bucket: bytes it covers, and what it is taken modulo.
SHORT, MODULUS = 4, 16
#: Bytes of text of a block and of a bucket, and the least ones, where fewer would leave tasks without work.
BLOCK_BYTES, BUCKET_BYTES, LEAST_BYTES = 6 << 20, 4 << 20, 1 << 19
#: Bytes of a block's texts that are hashed at once; places inside have to fit the low bits of the sorting keys.
TILE, PLACE = 1 << 18, np.uint64((1 << 24) - 1)
#: A trigger with so many different stretches, counted in each block and summed, is common: its strings are exchanged one by one
#: under hashes of their own, so that the many continuations of a common passage don't meet in one task. Their bytes go along and
#: decide what is equal.
COMMON_STRETCHES = 4096
FIRST = -(1 << 63)
#: The base of the rolling hash (modulo 2^64; odd, so it has an inverse), and a random number for each byte.
BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(50).integers(0, 1 << 64, 256, np.uint64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rolling(body: np.ndarray, k: int) -> np.ndarray:
    """The rolling hash (Karp and Rabin's) of the k bytes from each place on: differences of one running sum, its low bits mixed."""
    n = len(body) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(max(len(body), TILE + WIDTH))
    sums = np.zeros(len(body) + 1, np.uint64)
    np.cumsum(_BYTE[body] * up[: len(body)], out=sums[1:])
    return _mixed((sums[k:] - sums[:n]) * down[:n])


def _words(body: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as integers; places near the end are padded with zeros."""
    n = len(body)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = body
    out = np.empty(n + 8 - n % 8, "<u8")
    for o in range(8):
        out[o::8] = padded[o : o + len(out)].view("<u8")[: len(out) // 8]
    return out[:n]


def _stirred(*words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of several words each."""
    h = words[0] * np.uint64(0x9E3779B97F4A7C15)
    for w in words[1:]:
        h ^= h >> np.uint64(32)
        h += w
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def string_hashes(body: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the WIDTH bytes from each place on."""
    w = _words(body)
    return _stirred(*(w[at + o] for o in (*range(0, WIDTH - 8, 8), WIDTH - 8)))


def different(hashes: np.ndarray, body: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the WIDTH bytes from each place on, one index of each different string, in order of hash and bytes, and the number of each place among them.

    Equal hashes are held against the bytes, a stretch at a time; where they differ, the bytes order them.
    """
    n = len(at)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(body, WIDTH)
    order = np.argsort(hashes, kind="stable")
    head = np.concatenate([[True], hashes[order[1:]] != hashes[order[:-1]]])
    clash = []
    for a in range(0, n, SORTED):
        same = np.flatnonzero(~head[a : a + SORTED]) + a
        other = same[(windows[at[order[same]]] != windows[at[order[same - 1]]]).any(axis=1)]
        clash += np.unique(hashes[order[other]]).tolist()
    ranked = hashes[order] if clash else hashes
    for h in set(clash):
        a, b = np.searchsorted(ranked, np.uint64(h), "left"), np.searchsorted(ranked, np.uint64(h), "right")
        strings = windows[at[order[a:b]]].reshape(-1).view(f"S{WIDTH}")
        rank = np.argsort(strings, kind="stable")
        order[a:b], strings = order[a:b][rank], strings[rank]
        head[a + 1 : b] = strings[1:] != strings[:-1]
    of = np.empty(n, np.int64)
    of[order] = np.cumsum(head) - 1
    return order[head], of


def stretches(body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the trigger, first and last start of owned strings, for every stretch of the texts body[starts:ends].

    Works through tiles of the body; a stretch that a tile cuts becomes two with one trigger.
    """
    found = []
    n = len(body) - WIDTH + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(len(body) + 1, np.int8)
    long = ends - starts >= WIDTH
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - WIDTH + 1, -1)
    whole = np.cumsum(edge, dtype=np.int8)[:n] > 0  # a string of one text starts here
    breaks = np.zeros(n, bool)
    breaks[starts[long]] = True
    for a in range(0, n, TILE):
        b = min(n, a + TILE)
        h = rolling(body[a : b + WIDTH - 1], KMER)  # of all triggers that strings of this tile can have
        least = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while reach * 2 <= WIDTH - KMER + 1:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        rest = WIDTH - KMER + 1 - reach
        owner = (np.minimum(least[: b - a], least[rest : rest + b - a]) & PLACE).astype(np.int64)
        ok = whole[a:b]
        head = ok.copy()
        head[1:] &= (owner[1:] != owner[:-1]) | ~ok[:-1] | breaks[a + 1 : b]
        tail = ok.copy()
        tail[:-1] &= head[1:] | ~ok[1:]
        first = np.flatnonzero(head)
        # least hashes are small: stirred again, their upper bits deal evenly
        found.append((_stirred(h[owner[first]]), first + a, np.flatnonzero(tail) + a))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


class Block:
    """The texts of a block in ascending order of id, as one body, and their stretches."""

    def __init__(self, table: pa.Table, bits: int):
        ids = [FIRST if i is None else i for i in table.column("doc_id").to_pylist()]
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in table.column("text").to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.ids = np.array([ids[i] for i in self.order], np.int64)
        texts = [texts[i] for i in self.order]
        self.ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        self.starts = self.ends - np.array([len(t) for t in texts], dtype=np.int64)
        self.raw = b"".join(texts)
        self.body = np.frombuffer(self.raw, np.uint8)
        del texts
        self.hashes, self.first, self.last = stretches(self.body, self.starts, self.ends)
        self.hashes = _sent(self.hashes, bits)
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def shared(self, hashes: np.ndarray) -> np.ndarray:
        """Which stretches have one of the sorted hashes."""
        if not len(hashes):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(hashes, self.hashes), len(hashes) - 1)
        return np.flatnonzero(hashes[at] == self.hashes)

    def entries(self, which: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The different stretches among `which`, in order of first occurrence; of each occurrence the number; of each stretch its least and greatest id."""
        number: dict[bytes, int] = {}
        raw = self.raw
        of = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(self.first[which].tolist(), (self.last[which] + WIDTH).tolist(), strict=True)), np.int64, len(which))
        return list(number), of, *_extremes(of, self.ids[self.doc[which]], len(number))

    def strings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All strings of the stretches `which`: starts, texts; a place and the hash of each different one, in order of hash; of each start the number; of each different one its least and greatest id."""
        sizes = self.last[which] - self.first[which] + 1
        at = np.repeat(self.first[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        doc = np.repeat(self.doc[which], sizes)
        hashes = string_hashes(self.body, at) if len(at) else np.empty(0, np.uint64)
        first, of = different(hashes, self.body, at)
        return at, doc, at[first], hashes[first], of, *_extremes(of, self.ids[doc], len(first))


def _extremes(of: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(n, (1 << 63) - 1, np.int64), np.full(n, FIRST, np.int64)
    np.minimum.at(low, of, ids)
    np.maximum.at(high, of, ids)
    return low, high


def _bucketed(hashes: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Slices of sorted hashes by their upper bits."""
    if not len(hashes):
        return
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[a]), slice(a, b)


#: Bits of a trigger's hash that are sent besides the bucket's: those behind them. Triggers that agree in so many only make more candidates.
SENT_BITS = 48


def _packed(hashes: np.ndarray, bits: int) -> bytes:
    """SENT_BITS of each hash behind the bucket's bits."""
    low = hashes << np.uint64(bits) >> np.uint64(64 - SENT_BITS)
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SENT_BITS // 8].tobytes()


def _unpacked(blob, bucket: int, bits: int) -> np.ndarray:
    """The hashes, zero where nothing was sent."""
    part = np.frombuffer(blob.as_buffer(), np.uint8).reshape(-1, SENT_BITS // 8)
    whole = np.zeros((len(part), 8), np.uint8)
    whole[:, : SENT_BITS // 8] = part
    return (whole.view("<u8").reshape(-1) << np.uint64(64 - SENT_BITS) >> np.uint64(bits)) | np.uint64(bucket << (64 - bits))


def _sent(hashes: np.ndarray, bits: int) -> np.ndarray:
    """What _unpacked() gives back."""
    spare = np.uint64(max(0, 64 - SENT_BITS - bits))
    return hashes >> spare << spare


# what the passes exchange: packed arrays from one block to a bucket (or back), as columns a to e of one kind
MESSAGE = "bucket int, block int, kind int, a binary, b binary, c binary, d binary, e binary"
TRIGGERS, STRETCHES, STRINGS, SHARED, LEAST, LEAST_STRINGS = range(6)
_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcde")])


def _messages(rows: list[tuple]) -> pa.Table:
    rows = [(*r, *[b""] * (8 - len(r))) for r in rows]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 8, _ARROW, strict=True)], schema=_ARROW)


def _array(blob, kind) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), kind)


def _told(table: pa.Table, kind: int) -> list[dict]:
    """The messages of a kind, their columns as Arrow scalars."""
    kinds = table.column("kind").to_pylist()
    return [{c: table.column(c)[i] for c in table.column_names} for i, k in enumerate(kinds) if k == kind]


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _send_triggers(bits: int):
    """A block's triggers; whether several of its documents have each, and how many different stretches (8 times its binary logarithm, rounded)."""

    def run(key, table):
        block = Block(table, bits)
        if not len(block.hashes):
            return _messages([])
        # a stretch is told by its first and last string and its length: together they cover it
        content = _stirred(string_hashes(block.body, block.first), string_hashes(block.body, block.last), (block.last - block.first).astype(np.uint64))
        order = np.lexsort((content, block.hashes))
        hashes, content, ids = block.hashes[order], content[order], block.ids[block.doc[order]]
        heads = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (content[1:] != content[:-1])])
        amount = np.round(8 * np.log2(np.add.reduceat(new.astype(np.int64), heads))).astype(np.uint8)
        # rows with one id are one document
        several = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)
        hashes = hashes[heads]
        rows = [(u, key[0].as_py(), TRIGGERS, _packed(hashes[s], bits), np.packbits(several[s]).tobytes(), amount[s].tobytes()) for u, s in _bucketed(hashes, bits)]
        del block
        release_memory()
        return _messages(rows)

    return run


def _answer_triggers(bits: int, common: int):
    def run(key, table):
        told, bucket = _told(table, TRIGGERS), key[0].as_py()
        parts = [_unpacked(m["a"], bucket, bits) for m in told]
        hashes = _joined(parts, np.uint64)
        several = _joined([np.unpackbits(_array(m["b"], np.uint8), count=len(p)) for m, p in zip(told, parts, strict=True)], np.uint8).astype(np.int64)
        amounts = np.exp2(_joined([_array(m["c"], np.uint8) for m in told], np.uint8) / 8)
        order = np.argsort(hashes, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(hashes[order]) != 0]))
        blocks = np.diff(np.concatenate([heads, [len(hashes)]]))
        is_common = np.add.reduceat(amounts[order], heads) >= common
        seen = np.repeat(np.where((blocks > 1) | (np.add.reduceat(several[order], heads) > 0), np.where(is_common, 2, 1), 0), blocks)
        state = np.empty(len(hashes), np.int64)
        state[order] = seen
        rows, at = [], 0
        for m, own in zip(told, parts, strict=True):
            s = state[at : at + len(own)]
            at += len(own)
            if s.any():
                rows.append((bucket, m["block"].as_py(), SHARED, _packed(own[s == 1], bits), _packed(own[s == 2], bits)))
        release_memory()
        return _messages(rows)

    return run


def _chosen(block: Block, told: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's stretches that other documents may have, and those of common triggers."""
    shared = _told(told, SHARED)
    return tuple(block.shared(np.sort(_joined([_unpacked(m[c], m["bucket"].as_py(), bits) for m in shared], np.uint64))) for c in "ab")


def _send_stretches(bits: int):
    def run(key, docs, told):
        if not docs.num_rows or not told.num_rows:
            return _messages([])
        block, rows = Block(docs, bits), []
        few, many = _chosen(block, told, bits)
        texts, of, low, high = block.entries(few)
        owner = np.empty(len(texts), np.uint64)
        owner[of] = block.hashes[few]
        order = np.argsort(owner, kind="stable")
        name = key[0].as_py()
        for u, s in _bucketed(owner[order], bits):
            own = order[s]
            held = [texts[i] for i in own.tolist()]
            several = low[own] != high[own]
            sizes = np.array([len(x) for x in held], np.uint8) | (several.astype(np.uint8) << 7)
            rows.append((u, name, STRETCHES, b"".join(held), sizes.tobytes(), low[own].tobytes(), high[own][several].tobytes(), own.astype(np.uint32).tobytes()))
        _, _, places, hashes, _, low, high = block.strings(many)
        for u, s in _bucketed(hashes, bits):
            held = b"".join(block.raw[p : p + WIDTH] for p in places[s].tolist())
            rows.append((u, name, STRINGS, hashes[s].tobytes(), low[s].tobytes(), high[s].tobytes(), np.arange(s.start, s.stop, dtype=np.uint32).tobytes(), held))
        del block, texts
        release_memory()
        return _messages(rows)

    return run


#: Strings that are compared at once.
SORTED = 1 << 17


def suffix_ranks(first: np.ndarray, covered: int, left: np.ndarray) -> np.ndarray:
    """The suffix array as ranks, by prefix doubling: how many suffixes precede each; equal suffixes have equal ranks.

    first: keys of the first `covered` symbols of each suffix; left: how many symbols each
    suffix has. A suffix that ends inside of what is compared precedes its extensions. Each
    round sorts only the suffixes that tie and don't all end yet.
    """
    n = len(first)
    rank, act, key = np.zeros(n, np.int64), np.arange(n), first
    while True:
        order = np.argsort(key)
        act, key = act[order], key[order]
        head = np.append(True, key[1:] != key[:-1])[: len(act)]
        # what ties in this order has one old rank; a new one begins where the key changes
        old = rank[act]
        start = np.flatnonzero(np.append(True, old[1:] != old[:-1])[: len(act)])
        heads = np.flatnonzero(head)
        group = np.searchsorted(start, heads, "right") - 1
        sizes = np.diff(np.append(heads, len(act)))
        new = np.repeat(old[heads] + heads - start[group], sizes)
        rank[act] = new
        tied = np.repeat(sizes > 1, sizes)
        act, new = act[tied], new[tied]
        if not len(act):
            return rank
        heads = np.flatnonzero(np.append(True, new[1:] != new[:-1]))
        goes_on = np.maximum.reduceat(left[act], heads) > covered
        keep = np.repeat(goes_on, np.diff(np.append(heads, len(act))))
        act, new = act[keep], new[keep]
        if not len(act):
            return rank
        beyond = np.where(left[act] > covered, rank[np.minimum(act + covered, n - 1)] + 1, 0)
        key = new * (n + 1) + beyond
        covered *= 2


def corpus_order(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Indexes of the places `at` in the order of what follows them in their stretch body[starts:ends], by prefix-free parsing.

    Stretches are taken one after another, each closed by SHORT bytes that no text has.
    """
    sizes = ends - starts
    closed = np.full(len(body) + SHORT * len(starts), 0xFF, np.uint8)
    shift = np.arange(len(starts)) * SHORT
    moved = np.arange(len(body)) + np.repeat(shift, sizes)
    closed[moved] = body
    begin = starts + shift
    last = begin + sizes  # where a stretch's closing bytes start
    # the parse: a phrase reaches from a trigger (or the stretch's begin) to the end of the next trigger
    cut = np.concatenate([rolling(closed[a : a + TILE + SHORT - 1], SHORT) % np.uint64(MODULUS) == 0 for a in range(0, len(closed) - SHORT + 1, TILE)])
    for o in range(1 - SHORT, SHORT):  # strings with a closing byte aren't triggers
        beside = last + o
        cut[beside[beside < len(cut)]] = False
    cut[begin] = True
    phrase = np.flatnonzero(cut)  # where phrases start
    stretch = np.searchsorted(begin, phrase, "right") - 1
    ends_here = np.append(stretch[1:] != stretch[:-1], True)
    end = np.where(ends_here, last[stretch], np.append(phrase[1:], 0)) + SHORT
    # the dictionary: different phrases in order of first occurrence, one after another
    raw, number = closed.tobytes(), {}
    of = np.fromiter((number.setdefault(raw[a:b], len(number)) for a, b in zip(phrase.tolist(), end.tolist(), strict=True)), np.int64, len(phrase))
    dictionary = np.frombuffer(b"".join(number), np.uint8)
    length = np.fromiter(map(len, number), np.int64, len(number))
    stop = np.cumsum(length)
    base = stop - length
    left = np.repeat(stop, length) - np.arange(len(dictionary))
    words = _words(dictionary).byteswap()
    short = left < 8
    spare = (64 - 8 * left[short]).astype(np.uint64)  # bits of the next phrase
    words[short] = words[short] >> spare << spare
    rest = suffix_ranks(words, 8, left)  # the suffix array of the dictionary, as ranks
    # the parse's suffix array, over the ranks of phrases
    symbols = rest[base][of]
    remaining = np.flatnonzero(ends_here)[stretch] + 1 - np.arange(len(phrase))
    parse = suffix_ranks(symbols, 1, remaining)
    following = np.where(ends_here, 0, np.append(parse[1:], 0) + 1)
    # both combine: what is left of the phrase, then what follows it in the parse
    where = moved[at]
    own = np.searchsorted(phrase, where, "right") - 1
    return np.argsort(rest[base[of[own]] + where - phrase[own]] * (len(phrase) + 1) + following[own])


def least_documents(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For the strings at each place, the least id of equal ones: runs in corpus order whose neighbours share WIDTH bytes."""
    order = corpus_order(body, starts, ends, at)
    windows = np.lib.stride_tricks.sliding_window_view(body, WIDTH)
    head = np.ones(len(order), bool)
    for a in range(1, len(order), SORTED):
        here = order[a : a + SORTED]
        head[a : a + len(here)] = (windows[at[here]] != windows[at[order[a - 1 : a - 1 + len(here)]]]).any(axis=1)
    heads = np.flatnonzero(head)
    out = np.empty(len(at), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(ids[order], heads), np.diff(np.append(heads, len(order))))
    return out


def _answer_stretches(key, table):
    rows = []
    if told := _told(table, STRETCHES):
        dictionary: dict[bytes, int] = {}  # the different stretches
        low: list[int] = []
        of: list[np.ndarray] = []
        for m in told:
            raw, sizes = m["a"].as_buffer().to_pybytes(), (_array(m["b"], np.uint8) & 0x7F).astype(np.int64)
            ends = np.cumsum(sizes)
            numbers = []
            for a, b, d in zip((ends - sizes).tolist(), ends.tolist(), _array(m["c"], np.int64).tolist(), strict=True):
                i = dictionary.setdefault(raw[a:b], len(low))
                numbers.append(i)
                if i == len(low):
                    low.append(d)
                elif d < low[i]:
                    low[i] = d
            of.append(np.array(numbers, np.int64))
        sizes = np.array([len(x) for x in dictionary], np.int64)
        ends = np.cumsum(sizes)
        counts = sizes - WIDTH + 1
        base = np.cumsum(counts) - counts  # where a stretch's strings stand
        at = np.repeat(ends - sizes - base, counts) + np.arange(counts.sum())
        body = np.frombuffer(b"".join(dictionary), np.uint8)
        del dictionary
        least = least_documents(body, ends - sizes, ends, at, np.repeat(np.array(low, np.int64), counts))
        for m, numbers in zip(told, of, strict=True):
            # runs of strings of a stretch with one least document, where that precedes a document of the block
            c = counts[numbers]
            entry = np.repeat(np.arange(len(numbers)), c)
            offset = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            value = least[np.repeat(base[numbers], c) + offset]
            high, several = _array(m["c"], np.int64).copy(), _array(m["b"], np.uint8) > 0x7F
            high[several] = _array(m["d"], np.int64)
            use = value < np.repeat(high, c)
            head = use.copy()
            head[1:] &= (entry[1:] != entry[:-1]) | (value[1:] != value[:-1]) | ~use[:-1]
            tail = use.copy()
            tail[:-1] &= head[1:] | ~use[1:]
            heads, tails = np.flatnonzero(head), np.flatnonzero(tail)
            if len(heads):
                numbers = _array(m["e"], np.uint32)[entry[heads]]
                rows.append((0, m["block"].as_py(), LEAST, numbers.tobytes(), offset[heads].astype(np.uint8).tobytes(), offset[tails].astype(np.uint8).tobytes(), value[heads].tobytes()))
    if told := _told(table, STRINGS):
        parts = [_array(m["a"], np.uint64) for m in told]
        hashes, body = np.concatenate(parts), np.concatenate([_array(m["e"], np.uint8) for m in told])
        first, of = different(hashes, body, np.arange(len(hashes)) * WIDTH)
        low, _ = _extremes(of, np.concatenate([_array(m["b"], np.int64) for m in told]), len(first))
        value, at = low[of], 0
        for m, own in zip(told, parts, strict=True):
            v = value[at : at + len(own)]
            at += len(own)
            use = v < _array(m["c"], np.int64)
            if use.any():
                rows.append((0, m["block"].as_py(), LEAST_STRINGS, _array(m["d"], np.uint32)[use].tobytes(), v[use].tobytes()))
    release_memory()
    return _messages(rows)


def _repeated(block: Block, told: pa.Table, bits: int) -> np.ndarray:
    """Places of the block where a string starts that a document with a smaller id has."""
    few, many = _chosen(block, told, bits)
    out = []
    if runs := _told(told, LEAST):
        texts, of, _, _ = block.entries(few)
        number, a, b, value = (np.concatenate([_array(m[c], k) for m in runs]) for c, k in (("a", np.uint32), ("b", np.uint8), ("c", np.uint8), ("d", np.int64)))
        order = np.argsort(number, kind="stable")
        number, a, b, value = number[order], a[order].astype(np.int64), b[order].astype(np.int64), value[order]
        lo, hi = np.searchsorted(number, of, "left"), np.searchsorted(number, of, "right")
        n = hi - lo
        phrase = np.repeat(few, n)
        run = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        use = value[run] < block.ids[block.doc[phrase]]
        phrase, run = phrase[use], run[use]
        size = b[run] - a[run] + 1
        out.append(np.repeat(block.first[phrase] + a[run] - (np.cumsum(size) - size), size) + np.arange(size.sum()))
    if single := _told(told, LEAST_STRINGS):
        at, doc, places, _, of, _, _ = block.strings(many)
        least = np.full(len(places), (1 << 63) - 1, np.int64)
        for m in single:
            least[_array(m["a"], np.uint32)] = _array(m["b"], np.int64)
        out.append(at[least[of] < block.ids[doc]])
    return _joined(out, np.int64)


def _finish(bits: int, carried: list[str], with_kept: bool):
    def run(key, docs, told):
        block = Block(docs, bits)
        edge = np.zeros(len(block.body) + 1, np.int8)  # at most WIDTH strings cover a byte
        if told.num_rows:
            places = np.unique(_repeated(block, told, bits))
            np.add.at(edge, places, 1)
            np.add.at(edge, places + WIDTH, -1)
        gone = np.cumsum(edge, dtype=np.int8)[:-1] > 0
        rows = []
        for i, (a, b) in enumerate(zip(block.starts.tolist(), block.ends.tolist(), strict=True)):
            g = gone[a:b]
            removed = int(g.sum())
            kept = block.body[a:b][~g].tobytes() if removed else block.raw[a:b]
            spans = int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if removed else 0
            rows.append((b - a, removed, spans, hashlib.sha256(kept).hexdigest(), *((kept, kept.decode("utf-8", "ignore")) if with_kept and removed else (None, None))))
        out = docs.take(pa.array(block.order, pa.int64())).select(["doc_id", *(["text"] if with_kept else []), *carried])
        for name, column, kind in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")[: 4 + 2 * with_kept], zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()), strict=False):
            out = out.append_column(name, pa.array(column, kind))
        del block, rows
        release_memory()
        return out

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", with_kept: bool = True, carried: list[str] = (), blocks: int | None = None, common: int = COMMON_STRETCHES) -> DataFrame:
    """Mark for removal each byte that a string of WIDTH bytes covers which also starts in a document with a smaller id.

    Returns per row doc_id, n_bytes, n_removed, n_spans, kept_sha256, if with_kept also
    text, kept (binary: the remaining bytes where any are removed, else null) and kept_text
    (the same without parts of characters that a cut left), and the `carried` columns, which go
    along with the texts (one that is named like a result is left out). Strings are judged on
    the input. Null texts are empty; null ids precede all others; rows with equal ids are one
    document and never remove from each other. A text shorter than WIDTH loses nothing.

    blocks: how many (None: by the bytes of the texts, see BLOCK_BYTES); a block's texts are
    held by one task, and so is a bucket's share of their stretches. A key that a third of the
    rows share reaches a bucket once per block.
    """
    spark = docs.sparkSession
    results = ["doc_id", *(["text"] if with_kept else []), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"]
    carried = [c for c in carried if c.lower() not in results]
    size, width = text_bytes(docs, text), shuffle_width(spark)
    at_least = min(width, -(-size // LEAST_BYTES))
    blocks = blocks or max(1, at_least, -(-size // BLOCK_BYTES))
    bits = max(1, (max(at_least, -(-size // BUCKET_BYTES)) - 1).bit_length())
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), *(F.col(f"`{c}`") for c in carried))
    place = unused_name(rows, "block")
    rows = rows.withColumn(place, F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    held = rows.groupBy(place)
    triggers = held.applyInArrow(_send_triggers(bits), MESSAGE)
    shared = triggers.groupBy("bucket").applyInArrow(_answer_triggers(bits, common), MESSAGE)
    sent = held.cogroup(shared.groupBy("block")).applyInArrow(_send_stretches(bits), MESSAGE)
    least = sent.groupBy("bucket").applyInArrow(_answer_stretches, MESSAGE)
    told = shared.unionByName(least)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    result = ["doc_id long", *(["text string"] if with_kept else []), *(f"`{c}` {kinds[c]}" for c in carried), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["kept binary, kept_text string"] if with_kept else [])]
    return held.cogroup(told.groupBy("block")).applyInArrow(_finish(bits, list(carried), with_kept), ", ".join(result))
