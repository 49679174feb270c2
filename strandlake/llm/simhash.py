"""SimHash near-duplicates, found by pigeonring filtering.

A fingerprint is a ring of five segments. If two differ in at most four bits, then
from some segment on every run of l consecutive segments differs in at most
floor(l * 4 / 5) bits: none in one segment, one in two, two in three, three in four.
Fingerprints meet under the first links of such chains; pairs that meet are pruned
by the growing chain before their full Hamming distance is taken.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm._common import shuffle_width, slices, written
from strandlake.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: Lowest bit and width of the ring's segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints under one key that one task compares; more are dealt to blocks.
BLOCK = 2048


def fingerprint(text: str | None) -> int:
    """64 bits, as a signed integer; a bit is set if over half of the shingle hashes have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(SHINGLE, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp of whole texts (no word: 0); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, fp long")


def with_fingerprint(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """docs and, under a name of its own, the fingerprint of their texts; no shuffle."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = pa.array([fingerprint(t) for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{name}` long"]))


def _turned(i: int, chain: int) -> list[int]:
    """What `chain` segments from segment i on may differ by: bits of the key, so that every shorter run keeps its budget too."""
    found = [(0, 0)]
    for l in range(1, chain + 1):
        width, budget = SEGMENTS[(i + l - 1) % len(SEGMENTS)][1], l * DISTANCE // len(SEGMENTS)
        choices = [(sum(1 << b for b in bits), len(bits)) for n in range(budget + 1) for bits in itertools.combinations(range(width), n)]
        found = [(mask << width | more, used + n) for mask, used in found for more, n in choices if used + n <= budget]
    return [mask for mask, _ in found]


def _width(i: int, chain: int) -> int:
    return sum(SEGMENTS[(i + l) % len(SEGMENTS)][1] for l in range(chain))


def chain_for(n: int, block: int) -> int:
    """The shortest chain (3 at most) under whose keys n fingerprints of even spread stay well below `block`."""
    return next((l for l in (1, 2) if all(n * len(_turned(i, l)) <= block / 2 * 2 ** _width(i, l) for i in range(len(SEGMENTS)))), 3)


def _keys(distinct: DataFrame, chain: int) -> DataFrame:
    """fp and key of all chain heads: `chain` segments side by side, with what may differ turned."""
    rows = []
    for i in range(len(SEGMENTS)):
        own = F.lit(0).cast("long")
        for l in range(chain):
            low, width = SEGMENTS[(i + l) % len(SEGMENTS)]
            own = F.shiftleft(own, width).bitwiseOR(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)))
        rows.append(F.transform(F.array(*(F.lit(i << 56 | m).cast("long") for m in _turned(i, chain))), own.bitwiseXOR))
    return distinct.select("fp", F.explode(F.concat(*rows)).alias("key"))


def _chain_masks(i: int) -> list[tuple[np.uint64, int]]:
    """Masks of 1 to 5 segments from segment i on, with their budgets."""
    out, mask = [], 0
    for l in range(1, len(SEGMENTS) + 1):
        low, width = SEGMENTS[(i + l - 1) % len(SEGMENTS)]
        mask |= ((1 << width) - 1) << low
        out.append((np.uint64(mask), l * DISTANCE // len(SEGMENTS)))
    return out


def _near(diff: np.ndarray, masks: list[tuple[np.uint64, int]]) -> np.ndarray:
    """Indexes of the differences that pass the growing chain, the whole ring last."""
    left = np.arange(len(diff))
    for mask, budget in masks:
        left = left[np.bitwise_count(diff[left] & mask) <= budget]
        if not left.size:
            break
    return left


def _forest(fps: np.ndarray, masks: list[tuple[np.uint64, int]]) -> list[tuple[int, int]]:
    """Edges that connect what is linked among fps; found members are compared with the rest only, so dense groups are quick."""
    rest, edges = fps, []
    while rest.size > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and rest.size:
            x = queue.pop()
            hit = _near(rest ^ x, masks)
            if hit.size:
                found = rest[hit]
                edges += zip([int(x)] * found.size, found.tolist(), strict=True)
                queue += list(found)
                keep = np.ones(rest.size, bool)
                keep[hit] = False
                rest = rest[keep]
    return edges


def _edges(keyed: DataFrame) -> DataFrame:
    """(key, block, fp) to edges (a, b) that connect all links inside each block of a key."""
    spark = keyed.sparkSession
    rows = keyed.select("key", "block", "fp").repartition(shuffle_width(spark), "key", "block").sortWithinPartitions("key", "block", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(key: np.ndarray, block: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            edges: list[tuple[int, int]] = []
            sizes = ends - starts
            group = np.repeat(np.arange(len(starts)), sizes)
            small = sizes <= 64
            for i in range(len(SEGMENTS)):
                masks = _chain_masks(i)
                ring = (key >> 56) == i
                here = np.flatnonzero(ring & small[group])
                g, f = group[here], fp[here]
                for step in range(1, int(sizes[small & ring[starts]].max(initial=0))):
                    same = np.flatnonzero(g[step:] == g[:-step])
                    if not same.size:
                        break
                    hit = same[_near(f[same] ^ f[same + step], masks)]
                    edges += zip(f[hit].tolist(), f[hit + step].tolist(), strict=True)
                for s in np.flatnonzero(~small & ring[starts]):
                    edges += _forest(np.unique(fp[starts[s] : ends[s]]), masks)
            return edges

        def emitted(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            both = np.array(list(set(edges)), dtype=np.uint64).reshape(-1, 2).view(np.int64)  # longer chains meet more than once
            return pa.RecordBatch.from_arrays([pa.array(both.max(axis=1)), pa.array(both.min(axis=1))], names=["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            key, block, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            fp = fp.astype(np.int64).view(np.uint64)
            if len(key):
                held.append((key, block, fp))
                if held[0][0][0] == key[-1] and held[0][1][0] == block[-1]:
                    continue  # one block so far
                key, block, fp = (np.concatenate(c) for c in zip(*held, strict=True))
                last = int(np.flatnonzero((key != key[-1]) | (block != block[-1]))[-1]) + 1
                held = [(key[last:], block[last:], fp[last:])]
                if edges := linked(key[:last], block[:last], fp[:last]):
                    yield emitted(edges)
        if held:
            key, block, fp = (np.concatenate(c) for c in zip(*held, strict=True))
            if edges := linked(key, block, fp):
                yield emitted(edges)

    return rows.mapInArrow(run, "a long, b long")


def links(distinct: DataFrame, chain: int | None = None, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between different fingerprints (column fp) whose components are those of all links.

    Fingerprints under a key of at most `block` rows are compared in one task. A larger
    key is dealt to blocks at first; what the links found so far, from all keys, leave
    outside of the key's largest component is dealt to groups of about `block` rows, and
    each group is compared with every block. So each pair that isn't connected anyway is
    compared, and no task holds more than a group and a block of a large key at once.
    chain: segments of a key (None: as many as keep keys small at that number of
    fingerprints, see chain_for()); links are the same under any.
    """
    chain = chain or chain_for(distinct.count(), block)
    keyed = _keys(distinct, chain)
    large = keyed.groupBy("key").count().where(F.col("count") > block)
    large = written(large.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "simhash-large")
    dealt = keyed.join(large, "key", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("fp"), "blocks").cast("int"), F.lit(0)))
    edges = written(_edges(dealt), "simhash-edges")
    if large.isEmpty():
        return edges
    known = components(edges).select(F.col("node").alias("fp"), "root")
    hot = written(dealt.where("blocks is not null").join(known, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-hot")
    sizes = hot.groupBy("key", "root").count()
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    others = hot.join(main, "key").where("root != main").select("key", "blocks", "fp")
    groups = others.groupBy("key").agg(F.ceil(F.count("*") / block).cast("long").alias("groups"))
    mine = others.join(groups, "key").withColumn("group", F.pmod(F.xxhash64("fp", F.lit(1)), "groups"))
    place = (F.col("group") * F.col("blocks") + F.col("block")).alias("block")
    across = mine.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", place, "fp")
    touched = hot.join(groups, "key").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("key", place, "fp")
    return edges.unionByName(_edges(touched.unionByName(across).distinct()))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chain: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable over links) of every row.

    Texts are read once; ids and fingerprints go to the shared folder. Equal
    fingerprints become one node before anything is compared. Null texts and texts
    without a word have fingerprint 0 and are linked like any other. Null ids take
    part, but a component's id is its least id that isn't null (null if all are).
    """
    return classes(docs, id_col, text, chain, block).drop("root")


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", chain: int | None = None, block: int = BLOCK) -> DataFrame:
    """near_duplicates() and root, a fingerprint of each component: where ids repeat, components can share their least id."""
    rows = written(fingerprints(docs, id_col, text), "simhash")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), chain, block))
    nodes = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("first").alias("component_id"))
    found = nodes.join(least, "root").select(F.col("fp").alias("f"), "component_id", "root")
    return rows.join(found, F.col("fp") == F.col("f")).select("doc_id", "fp", "component_id", "root")
