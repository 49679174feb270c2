"""Strings of common triggers are told apart by their bytes, whatever their hashes."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import substring_dedup as repeats

BITS = 2


def removed(blocks, common):
    """The passes on one machine: doc_id to bytes removed."""
    keys = [(pa.scalar(i),) for i in range(len(blocks))]
    tables = [pa.table({"doc_id": pa.array([d for d, _ in b], pa.int64()), "text": [t for _, t in b]}) for b in blocks]

    def by(table, column):
        return {k: table.filter(pa.compute.equal(table[column], k)) for k in set(table[column].to_pylist())}

    none = repeats._messages([])
    triggers = pa.concat_tables([repeats._send_triggers(BITS)(k, t) for k, t in zip(keys, tables, strict=True)])
    shared = pa.concat_tables([repeats._answer_triggers(BITS, common)((pa.scalar(u),), t) for u, t in by(triggers, "bucket").items()])
    asked = by(shared, "block")
    sent = pa.concat_tables([repeats._send_stretches(BITS)(k, t, asked.get(i, none)) for i, (k, t) in enumerate(zip(keys, tables, strict=True))])
    told = by(pa.concat_tables([shared, *(repeats._answer_stretches((pa.scalar(u),), t) for u, t in by(sent, "bucket").items())]), "block")
    out = [repeats._finish(BITS, [], False)(k, t, told.get(i, none)) for i, (k, t) in enumerate(zip(keys, tables, strict=True))]
    return {r["doc_id"]: r["n_removed"] for t in out for r in t.to_pylist()}


def brute_force(docs):
    first = {}
    for d, t in sorted(docs):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], d)
    return {d: len({q for p in range(len(t) - 49) if first[t[p : p + 50]] < d for q in range(p, p + 50)}) for d, t in docs}


@pytest.mark.parametrize("bits", [0, 1, 64])
def test_colliding_hashes_remove_nothing(monkeypatch, bits):
    """One passage with another continuation in each document; hashes of strings cut to a few bits."""
    whole = repeats.string_hashes
    monkeypatch.setattr(repeats, "string_hashes", lambda body, at: whole(body, at) & np.uint64((1 << bits) - 1))
    draw = random.Random(3)
    word = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    passage = word(70)
    docs = [(i, word(40) + passage + word(80)) for i in range(9)] + [(9, passage[:40] + word(90))]
    blocks = [docs[:4], docs[4:7], docs[7:]]
    assert removed(blocks, common=1) == removed(blocks, common=1000) == brute_force(docs)


def test_corpus_order_is_that_of_sorted_suffixes():
    """Prefix-free parsing against a plain sort, on repetitive stretches that share beginnings, ends and whole parts."""
    draw = random.Random(8)
    for alphabet in ("ab", "abcdefgh \x00", "é€x"):
        parts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 60))) for _ in range(12)]
        texts = sorted({("".join(draw.choice(parts) for _ in range(6)) + "z" * 50).encode()[:200] for _ in range(80)})
        texts = [t for t in texts if len(t) >= 50]
        draw.shuffle(texts)
        body = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        at = np.concatenate([np.arange(a, b - 49) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        end_of = np.repeat(ends, ends - starts - 49)
        suffixes = [body[a:b].tobytes() + b"\xff" for a, b in zip(at.tolist(), end_of.tolist(), strict=True)]
        order = repeats.corpus_order(body, starts, ends, at)
        assert [suffixes[i] for i in order] == sorted(suffixes)
        ids = np.array([draw.randrange(50) for _ in at], np.int64)
        least = {}
        for a, i in zip(at.tolist(), ids.tolist(), strict=True):
            s = body[a : a + 50].tobytes()
            least[s] = min(i, least.get(s, i))
        got = repeats.least_documents(body, starts, ends, at, ids)
        assert got.tolist() == [least[body[a : a + 50].tobytes()] for a in at.tolist()]


def test_rolling_hash_depends_on_its_bytes_only():
    draw = np.random.default_rng(2)
    body = draw.integers(97, 100, 5000).astype(np.uint8)
    for k in (repeats.SHORT, repeats.KMER):
        got, seen = repeats.rolling(body, k), {}
        assert len(got) == 5000 - k + 1
        for i, h in enumerate(got.tolist()):
            assert seen.setdefault(body[i : i + k].tobytes(), h) == h
        assert len(set(seen.values())) == len(seen)
