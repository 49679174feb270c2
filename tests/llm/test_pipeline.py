"""run() against a brute-force version of all stages on one machine."""

import hashlib
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import regex

from strandlake.llm import language_id, mixing, simhash
from test_edges import brute_force_components

SF = "/root/testdata/sf0.001"


def told_apart(rows, model):
    encoders = language_id.Encoders(model)
    for r in rows:
        if r["text"] and regex.search(r"\p{L}", r["text"]):
            sizes = sorted(np.maximum(encoders.sizes(r["text"]), 1.0))
            if sizes[1] / sizes[0] - 1 >= language_id.MARGIN:
                yield r


def without_near_copies(rows):
    least = brute_force_components([(r["doc_id"], simhash.fingerprint(r["text"])) for r in rows])
    return [r for r in rows if least[r["doc_id"]] == r["doc_id"]]


def without_repeats(rows):
    first = {}
    ordered = sorted(rows, key=lambda r: r["doc_id"])
    for r in ordered:
        b = r["text"].encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], r["doc_id"])
    for r in ordered:
        b = r["text"].encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < r["doc_id"]:
                gone[p : p + 50] = b"\1" * 50
        if sum(gone) < len(b) or not b:
            yield r | {"text": bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")}


def mixed(rows):
    words = {id(r): re.findall(r"[^\x20\x09-\x0D]+", r["text"]) for r in rows}
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    streams = {s: sorted((r for r in rows if r["source"] == s), key=lambda r: (hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), len(words[id(r)]), r["doc_id"])) for s in sources}
    sizes = [sum(len(words[id(r)]) for r in streams[s]) for s in sources]
    goals = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], Fraction(3, 2), 2)
    wanted = Fraction(3, 2) * sum(sizes)
    block = int(max(1, min(1024, wanted // (1 << 20))))
    edges = [int(sum(map(Fraction, goals[: i + 1])) / wanted * mixing.RANGE) for i in range(len(sources) - 1)]
    times = [Counter() for _ in sources]
    ranks = [0] * len(sources)
    for slot in range(int(wanted // block) + 1):
        s = sum(e <= slot % mixing.RANGE * mixing.STEP % mixing.RANGE for e in edges)
        blocks = -(-sizes[s] // block)
        if ranks[s] < 2 * blocks:
            times[s][ranks[s] % blocks] += 1
        ranks[s] += 1
    for s, name in enumerate(sources):
        at = 0
        for r in streams[name]:
            own = words[id(r)]
            for k in (1, 2):
                taken = sum(times[s][(at + i) // block] >= k for i in range(len(own)))
                if taken:
                    ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+", r["text"])]
                    yield r | {"text": r["text"] if taken == len(own) else r["text"][: ends[taken - 1]]}
            at += len(own)


def test_run_against_brute_force(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    rows = list(mixed(list(without_repeats(without_near_copies(list(told_apart(rows, language_id.fit(docs))))))))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids)) for r in rows)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
