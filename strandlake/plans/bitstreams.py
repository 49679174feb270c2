"""Registered queries on bitstreams that they build themselves, and their SQL.

No table of the test data holds a bitstream. Container and catalogue queries read streams of
random content; their SQL parses the same bytes, given as hexadecimal VALUES. Decoding queries
read streams whose pictures follow from their modes alone (the sample values of the format's
edge rules, copied along); their SQL states those samples and nothing of the decoder. Header
queries are held against what the headers were written from. Random content that was drawn
through the decoder itself has no SQL.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import arith
from strandlake.kernel import fixtures, spec
from strandlake.kernel.headers import Color, Header, join_superframe
from strandlake.plans import streams
from strandlake.sources import containers

# streams


@lru_cache(maxsize=1)
def demo_files() -> tuple[tuple[str, bytes], ...]:
    """Three random streams, a small one with a superframe and a repeated picture, a truncated and an empty one."""
    files = [(f"random-{i}", fixtures.ivf(fixtures.random_stream(fixtures.demo_headers(), i)[0], 72, 40)) for i in range(3)]
    return (*files, ("demo", fixtures.demo_stream()), ("broken", fixtures.demo_stream()[:-5]), ("empty", b""))


def _steered(ref: int, **fields) -> Header:
    """An inter frame whose blocks all copy one reference."""
    features = [[None, None, ref, 0], *[[None] * 4 for _ in range(7)]]
    return Header(**({"show": True, "resilient": True, "width": 16, "height": 16, "refs": [0, 1, 2], "interp_filter": 0, "seg_on": True, "features": features} | fields))


def _all(mode: int):
    return lambda row, col: {"mode": mode, "uv_mode": mode}


@lru_cache(maxsize=1)
def golden() -> dict[str, tuple[list[bytes], list[tuple]]]:
    """Chunks of each stream, and its frames: chunk, number in it, kind, intra, width, height, samples in SQL (None: no picture), error.

    Samples: 128 where nothing is known, 127 below a missing row, 129 behind a missing column, at 10 bits 512, 511 and 513.
    """
    flat = lambda byte, n: f"repeat('{byte:02X}', {n})"
    key = lambda h, plan: fixtures.frame(h, plan)
    copy = lambda ref, **f: fixtures.frame(_steered(ref, **f), lambda r, c: {})
    out: dict[str, tuple[list[bytes], list[tuple]]] = {}
    one = lambda h, plan, samples: ([key(h, plan)], [(0, 0, "new_shown", True, h.width, h.height, samples, None)])
    out["dc"] = one(fixtures.key_header(40, 24), _all(spec.DC), flat(128, 40 * 24 * 3 // 2))
    out["vertical"] = one(fixtures.key_header(36, 20), _all(spec.V), flat(127, 36 * 20 * 3 // 2))
    out["horizontal"] = one(fixtures.key_header(70, 33), _all(spec.H), flat(129, 70 * 33 + 2 * 35 * 17))
    out["motion"] = one(fixtures.key_header(24, 24), _all(spec.TM), flat(129, 24 * 24 * 3 // 2))
    sides = lambda r, c: {"mode": spec.V if c < 32 else spec.H, "uv_mode": spec.V if c < 32 else spec.H}
    out["two-tiles"] = one(fixtures.key_header(512, 64, profile=3, color=Color(10, 2, False, 0, 0), tile_cols_log2=1), sides, "repeat(repeat('FF01', 256) || repeat('0102', 256), 192)")
    rows = lambda r, c: {"mode": spec.V if r == 0 else spec.H, "uv_mode": spec.DC}
    for level, samples in ((0, f"{flat(127, 128)} || {flat(129, 128)}"), (63, f"{flat(127, 96)} || {flat(128, 64)} || {flat(129, 96)}")):
        features = [[None, level, None, None], *[[None] * 4 for _ in range(7)]]
        h = fixtures.key_header(lf_level=1, seg_on=True, seg_update_map=True, tree_probs=[128] * 7, absolute=True, features=features)
        out[f"edge-{level}"] = one(h, rows, f"{samples} || {flat(128, 128)}")
    # a key frame, a hidden frame beside the picture, copies of both in one chunk, a repeated picture, another key frame
    up, side = flat(127, 384), flat(129, 384)
    hidden = key(Header(intra_only=True, resilient=True, width=16, height=16, refresh=2, color=Color(8, 1)), _all(spec.H))
    chunks = [key(fixtures.key_header(), _all(spec.V)), hidden, copy(spec.GOLDEN), join_superframe([copy(spec.LAST), copy(spec.GOLDEN)]), join_superframe([copy(spec.GOLDEN), copy(spec.LAST, show=False)]), fixtures.write_header(Header(show_existing=1)), key(fixtures.key_header(), _all(spec.V))]
    frames = [(0, 0, "new_shown", True, up), (1, 0, "new_hidden", True, None), (2, 0, "new_shown", False, side), (3, 0, "new_shown", False, None), (3, 1, "new_shown", False, side), (4, 0, "new_shown", False, side), (4, 1, "new_hidden", False, None), (5, 0, "show_existing", None, side), (6, 0, "new_shown", True, up)]
    out["copies"] = chunks, [(c, n, kind, intra, None if s is None else 16, None if s is None else 16, s, None) for c, n, kind, intra, s in frames]
    # errors end a stream with their chunk
    lost = fixtures.write_header(_steered(spec.LAST, compressed_size=9))
    first = (0, 0, "new_shown", True, 16, 16, up, None)
    out["truncated"] = [chunks[0], join_superframe([copy(spec.LAST), lost]), chunks[0]], [first, (1, 1, None, None, None, None, None, "TruncatedFrame")]
    out["no-reference"] = [fixtures.write_header(Header(show_existing=3)), chunks[0]], [(0, 0, None, None, None, None, None, "MissingReferenceFrame")]
    out["bad-marker"] = [chunks[0], b"\x00\x01"], [first, (1, 0, None, None, None, None, None, "InvalidFrameMarker")]
    return out


def _chunks(spark: SparkSession, files) -> DataFrame:
    return containers.chunks_of(spark.createDataFrame([(name, bytearray(data)) for name, data in files], "stream_id string, content binary"))


def _demo_chunks(spark: SparkSession) -> DataFrame:
    return _chunks(spark, demo_files())


def _golden_catalog(spark: SparkSession) -> DataFrame:
    return streams.frame_catalog(_chunks(spark, [(name, fixtures.ivf(chunks)) for name, (chunks, _) in golden().items()]))


@lru_cache(maxsize=1)
def webm_files() -> tuple[tuple[str, bytes, int, int, tuple[bytes, ...]], ...]:
    """Name, file, width, height and blocks: clusters of known and unknown size, simple blocks and groups, a track of sound between."""
    blocks = [c for chunks, _ in golden().values() for c in chunks]
    return tuple((name, fixtures.webm(own, 640 + i, 360, unknown=i % 2 == 1), 640 + i, 360, tuple(own)) for i, (name, own) in enumerate([("short", blocks[:1]), ("unknown-sizes", blocks[1:6]), ("long", blocks), ("bare", [])]))


# queries


def ivf_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header fields of files by native byte slicing."""
    files = spark.createDataFrame([("demo", bytearray(fixtures.demo_stream()))], "stream_id string, content binary")
    fields = {"header_length": (6, 2), "width": (12, 2), "height": (14, 2), "tb_den": (16, 4), "tb_num": (20, 4), "frame_count": (24, 4)}
    return files.select("stream_id", *(arith.little_endian(F.col("content"), at, size).cast("long").alias(name) for name, (at, size) in fields.items()))


def ivf_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _demo_chunks(spark).select("stream_id", "chunk_idx", F.col("pts").cast("long").alias("pts"), F.octet_length("data").cast("long").alias("n_bytes"), F.md5("data").alias("digest"), "error")


def ivf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers.ivf_files(_demo_chunks(spark)).select("stream_id", F.md5("content").alias("digest"))


def webm_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the video track of WebM files."""
    files = spark.createDataFrame([(name, bytearray(data)) for name, data, *_ in webm_files()], "stream_id string, content binary")
    rows = containers.chunks_of(files, "webm")
    return rows.select("stream_id", "chunk_idx", F.col("header.width").alias("width"), F.col("header.height").alias("height"), F.md5("data").alias("digest"), "error")


def frame_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.frame_catalog(_demo_chunks(spark))
    return rows.select("stream_id", "chunk_idx", F.col("pts").cast("long").alias("pts"), *(F.col(c) for c in rows.columns if c not in ("stream_id", "chunk_idx", "pts", "frame")), F.md5("frame").alias("digest"))


def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.stream_summary(streams.frame_catalog(_demo_chunks(spark)))


#: Fields of headers that are compared, lists as JSON.
PLAIN = ["profile", "show_existing", "key", "show", "resilient", "intra_only", "reset_context", "width", "height", "refresh", "high_precision", "interp_filter", "refresh_context", "parallel", "context", "lf_level", "sharpness", "deltas_on", "base_q", "q_y_dc", "q_uv_dc", "q_uv_ac", "seg_on", "seg_update_map", "seg_temporal", "absolute", "tile_cols_log2", "tile_rows_log2"]
LISTS = ["refs", "sign_bias", "ref_deltas", "mode_deltas", "tree_probs", "pred_probs", "features"]


def frame_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of the random streams."""
    rows = streams.frame_headers(streams.frame_catalog(_chunks(spark, demo_files()[:3])))
    return rows.select("stream_id", "chunk_idx", "sub_idx", *PLAIN, *(F.to_json(c).alias(c) for c in LISTS), "error")


def decoded_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.decode(_golden_catalog(spark), planes=False)
    return rows.select("stream_id", "chunk_idx", "sub_idx", "kind", F.col("info.frame_is_intra").alias("frame_is_intra"), F.col("frame.width").alias("width"), F.col("frame.height").alias("height"), "md5", "error")


def decoded_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pictures by their planes."""
    rows = streams.decode(_golden_catalog(spark)).where("frame is not null")
    return rows.select("stream_id", "chunk_idx", "sub_idx", F.md5(F.concat("frame.y", "frame.u", "frame.v")).alias("md5"), (F.octet_length("frame.y") + F.octet_length("frame.u") + F.octet_length("frame.v")).cast("long").alias("n_bytes"))


def marked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame with its error, those behind a stream's first one included."""
    return streams.decode(_golden_catalog(spark), planes=False, policy="mark").groupBy("stream_id").agg(F.count("*").alias("frames"), F.count("md5").alias("pictures"), F.count("error").alias("errors"))


def frame_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.frame_digests(streams.decode(_golden_catalog(spark), planes=False)).select("stream_id", F.col("display_idx").cast("long").alias("display_idx"), "md5")


def block_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streams.block_modes(_golden_catalog(spark).where("stream_id in ('dc', 'vertical', 'horizontal', 'motion', 'two-tiles', 'edge-0', 'edge-63')"))
    return rows.select("stream_id", "mi_row", "mi_col", "size", "skip", "tx", "mode", "uv_mode", "segment", "ref0")


def random_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of random content, which only the decoder itself can tell."""
    return streams.frame_digests(streams.decode(streams.frame_catalog(_demo_chunks(spark)), planes=False))


def pictures_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.pictures_png(streams.decode(streams.frame_catalog(_demo_chunks(spark))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (ivf_headers, ivf_chunks, ivf_round_trip, webm_chunks, frame_catalog, stream_summary, frame_headers, decoded_frames, decoded_planes, marked_frames, frame_digests, block_modes, random_digests, pictures_png)
}


# SQL


def _text(x) -> str:
    if x is None:
        return "NULL"
    return str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(_text, r)) + ")" for r in rows)


def _byte(h: str, at: str) -> str:
    """The byte at a place (from 0) of hexadecimal text."""
    return f"((strpos('0123456789ABCDEF', substr({h}, 2 * ({at})::INT + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr({h}, 2 * ({at})::INT + 2, 1)) - 1)::BIGINT"


def _little(h: str, at: str, n: int) -> str:
    return "(" + " + ".join(f"{_byte(h, f'{at} + {i}')} * {1 << 8 * i}" for i in range(n)) + ")"


def _hex(x: str, n: int) -> str:
    """A number as n bytes, little-endian."""
    return " || ".join(f"substr('0123456789ABCDEF', ((({x}) // {1 << 8 * i}) % 256 // 16 + 1)::INT, 1) || substr('0123456789ABCDEF', ((({x}) // {1 << 8 * i}) % 16 + 1)::INT, 1)" for i in range(n))


def _walk() -> str:
    """files and chunks: the records of the demo files; a truncated one has size null."""
    size = _little("h", "p", 4)
    return f"""
        files(stream_id, h) AS ({_values((name, data.hex().upper()) for name, data in demo_files())}),
        sound AS (SELECT stream_id, h, length(h) // 2 AS n, {_little("h", "6", 2)} AS head FROM files WHERE length(h) >= 64),
        steps(stream_id, h, n, chunk_idx, p) AS (
          SELECT stream_id, h, n, 0::BIGINT, head FROM sound
          UNION ALL SELECT stream_id, h, n, chunk_idx + 1, p + 12 + {size} FROM steps WHERE p + 12 <= n AND p + 12 + {size} < n
        ),
        records AS (SELECT *, CASE WHEN p + 12 <= n AND p + 12 + {size} <= n THEN {size} END AS size FROM steps WHERE p < n),
        chunks AS (SELECT stream_id, chunk_idx, CASE WHEN size IS NOT NULL THEN {_little("h", "p + 4", 4)} END AS pts, substr(h, (2 * (p + 12) + 1)::INT, (2 * size)::INT) AS d, size FROM records)"""


def _frames() -> str:
    """frames: the chunks' frames by superframe index, with the facts of their first bits."""
    marker, first = _byte("d", "size - 1"), _byte("d", "size - (2 + number * width)")
    coded = "CASE width " + " ".join(f"WHEN {w} THEN {_little('d', 'size - (2 + number * width) + 1 + i * width', w)}" for w in (1, 2, 3, 4)) + " END"
    return f"""{_walk()},
        marked AS (SELECT *, {marker} AS marker, (({marker} >> 3) & 3) + 1 AS width FROM chunks WHERE size > 0),
        counted AS (SELECT *, (marker & 7) + 1 AS number FROM marked),
        indexed AS (SELECT *, (marker & 224) = 192 AND size >= 2 + number * width AND {first} = marker AS there FROM counted),
        sizes AS (SELECT *, {coded} AS own FROM (SELECT *, unnest(range(0, number)) AS i FROM indexed WHERE there)),
        placed AS (SELECT *, sum(own) OVER (PARTITION BY stream_id, chunk_idx ORDER BY i ROWS UNBOUNDED PRECEDING) - own AS start, sum(own) OVER (PARTITION BY stream_id, chunk_idx) AS total FROM sizes),
        parts AS (
          SELECT stream_id, chunk_idx, pts, i AS sub_idx, substr(d, (2 * start + 1)::INT, (2 * own)::INT) AS f FROM placed WHERE total <= size - (2 + number * width)
          UNION ALL SELECT stream_id, chunk_idx, pts, 0 AS sub_idx, d AS f FROM indexed
          WHERE NOT there OR EXISTS (SELECT 1 FROM placed p WHERE p.stream_id = indexed.stream_id AND p.chunk_idx = indexed.chunk_idx AND p.total > p.size - (2 + p.number * p.width))
        ),
        bits AS (SELECT *, {_byte("f", "0")} * 256 + CASE WHEN length(f) >= 4 THEN {_byte("f", "1")} ELSE 0 END AS b FROM parts),
        profiled AS (SELECT *, ((b >> 13) & 1) + 2 * ((b >> 12) & 1) AS profile FROM bits),
        shifted AS (SELECT *, CASE WHEN profile = 3 THEN b * 2 ELSE b END AS s FROM profiled),
        flagged AS (SELECT *, (s >> 11) & 1 = 1 AS show_existing FROM shifted),
        facts AS (SELECT *, NOT show_existing AND (s >> 10) & 1 = 0 AS is_key, show_existing OR (s >> 9) & 1 = 1 AS show_frame, CASE WHEN NOT show_existing THEN (s >> 8) & 1 = 1 END AS error_resilient FROM flagged),
        frames AS (
          SELECT stream_id, chunk_idx, pts, sub_idx::INT AS sub_idx, profile::INT AS profile, show_existing, is_key, show_frame, error_resilient, (length(f) // 2)::INT AS coded_bytes,
                 sum(CASE WHEN is_key THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY chunk_idx, sub_idx ROWS UNBOUNDED PRECEDING)::BIGINT AS gop_id,
                 coalesce(sub_idx = max(CASE WHEN show_frame THEN sub_idx END) OVER (PARTITION BY stream_id, chunk_idx), FALSE) AS keeps_pixels, md5(unhex(f)) AS digest
          FROM facts
        )"""


def _written_headers() -> list[tuple]:
    """What the random streams' headers were written from; deltas and features go on from frame to frame, and an intra or resilient frame begins anew."""
    rows = []
    for name in ("random-0", "random-1", "random-2"):
        kept = Header()
        for i, h in enumerate(fixtures.demo_headers()):
            before = Header() if h.intra or h.resilient else kept
            deltas, segments = h if h.deltas_on else before, h if h.seg_on else before
            now = {n: getattr(h, n) for n in PLAIN} | {n: getattr(h, n) for n in LISTS}
            now |= {"ref_deltas": deltas.ref_deltas, "mode_deltas": deltas.mode_deltas, "features": segments.features, "absolute": segments.absolute}
            rows.append((name, i, 0, *(now[n] for n in PLAIN), *(json.dumps(now[n], separators=(",", ":")) for n in LISTS), None))
            kept = Header(ref_deltas=deltas.ref_deltas, mode_deltas=deltas.mode_deltas, features=segments.features, absolute=segments.absolute)
    return rows


def _typed(rows: list[tuple], names: list[str], kinds: dict[str, str]) -> str:
    """A table of constants with types."""
    quoted = {n: f'"{n}"' for n in names}
    return f"SELECT {', '.join(f'{q}::{kinds[n]} AS {q}' if n in kinds else q for n, q in quoted.items())} FROM ({_values(rows)}) t({', '.join(quoted.values())})"


def _golden_sql(columns: str, where: str = "TRUE") -> str:
    rows = [f"SELECT {_text(s)} AS stream_id, {c}::BIGINT AS chunk_idx, {n}::INT AS sub_idx, {_text(kind)}::VARCHAR AS kind, {_text(intra)}::BOOLEAN AS frame_is_intra, {_text(w)}::INT AS width, {_text(h)}::INT AS height, {samples or 'NULL'}::VARCHAR AS samples, {_text(error)}::VARCHAR AS error" for s, (_, frames) in golden().items() for c, n, kind, intra, w, h, samples, error in frames]
    return f"WITH golden AS ({' UNION ALL '.join(rows)}) SELECT {columns} FROM golden WHERE {where}"


def _mode_rows() -> list[tuple]:
    """Stream, unit row and column, mode and chroma mode of the flat key frames, as they were planned."""
    rows = []
    single = {"dc": (40, 24, spec.DC), "vertical": (36, 20, spec.V), "horizontal": (70, 33, spec.H), "motion": (24, 24, spec.TM)}
    for name, (w, h, mode) in single.items():
        rows += [(name, r, c, mode, mode) for r in range(-(-h // 8)) for c in range(-(-w // 8))]
    rows += [("two-tiles", r, c, m := spec.V if c < 32 else spec.H, m) for r in range(8) for c in range(64)]
    rows += [(f"edge-{level}", r, c, spec.V if r == 0 else spec.H, spec.DC) for level in (0, 63) for r in range(2) for c in range(2)]
    return rows


@lru_cache(maxsize=1)
def sql() -> dict[str, str]:
    head = {"header_length": ("6", 2), "width": ("12", 2), "height": ("14", 2), "tb_den": ("16", 4), "tb_num": ("20", 4), "frame_count": ("24", 4)}
    rewritten = f"""
        SELECT files.stream_id, md5(unhex('444B49460000200056503930' || {_hex("coalesce(w, 0)", 2)} || {_hex("coalesce(hh, 0)", 2)} || {_hex("30", 4)} || {_hex("1", 4)} || {_hex("coalesce(n, 0)", 4)} || '00000000' || coalesce(body, ''))) AS digest
        FROM files LEFT JOIN (SELECT stream_id, {_little("h", "12", 2)} AS w, {_little("h", "14", 2)} AS hh FROM sound) s USING (stream_id)
        LEFT JOIN (SELECT stream_id, count(*) AS n, string_agg({_hex("size", 4)} || {_hex("chunk_idx", 4)} || '00000000' || d, '' ORDER BY chunk_idx) AS body FROM chunks WHERE size IS NOT NULL GROUP BY stream_id) c USING (stream_id)"""
    broken = [(name, i, len(chunks[i])) for name, (chunks, frames) in golden().items() for i in [next((f[0] for f in frames if f[7]), None)] if i is not None]
    errors = {name: i for name, i, _ in broken}
    totals = []
    for name, (chunks, frames) in golden().items():
        sound = [f for f in frames if not f[7]]
        end = errors.get(name)
        # behind the frame with the error every other one has a row too
        late = 0 if end is None else len(chunks) - end - 1
        totals.append((name, len(sound) + (0 if end is None else 1 + late), sum(f[6] is not None for f in sound), 0 if end is None else 1 + late))
    header_kinds = {n: "BOOLEAN" for n in PLAIN if isinstance(getattr(Header(), n), bool)} | {n: "INT" for n in PLAIN if not isinstance(getattr(Header(), n), bool)}
    return {
        "ivf_headers": f"WITH f(stream_id, h) AS ({_values([('demo', fixtures.demo_stream().hex().upper())])}) SELECT stream_id, " + ", ".join(f"{_little('h', at, n)} AS {name}" for name, (at, n) in head.items()) + " FROM f",
        "ivf_chunks": f"""
        WITH RECURSIVE {_walk()}
        SELECT stream_id, chunk_idx, pts, size::BIGINT AS n_bytes, CASE WHEN size IS NOT NULL THEN md5(unhex(d)) END AS digest, CASE WHEN size IS NULL THEN 'TruncatedFrame' END AS error FROM chunks
        UNION ALL SELECT stream_id, 0::BIGINT, NULL, NULL, NULL, 'TooShort' FROM files WHERE length(h) < 64""",
        "ivf_round_trip": f"WITH RECURSIVE {_walk()} {rewritten}",
        "webm_chunks": _typed(
            [(name, i, w, h, b.hex().upper(), None) for name, _, w, h, blocks in webm_files() for i, b in enumerate(blocks)],
            ["stream_id", "chunk_idx", "width", "height", "digest", "error"], {"chunk_idx": "BIGINT", "width": "INT", "height": "INT", "error": "VARCHAR"},
        ).replace('"digest",', 'md5(unhex("digest")) AS "digest",', 1),
        "frame_catalog": f"WITH RECURSIVE {_frames()} SELECT * FROM frames",
        "stream_summary": f"WITH RECURSIVE {_frames()} SELECT stream_id, count(*) AS frames, sum(is_key::INT)::BIGINT AS key_frames, sum((NOT show_frame)::INT)::BIGINT AS hidden_frames, sum(coded_bytes)::BIGINT AS coded_bytes FROM frames GROUP BY stream_id",
        "frame_headers": _typed(_written_headers(), ["stream_id", "chunk_idx", "sub_idx", *PLAIN, *LISTS, "error"], {"chunk_idx": "BIGINT", "sub_idx": "INT", **header_kinds, "error": "VARCHAR"}),
        "decoded_frames": _golden_sql("stream_id, chunk_idx, sub_idx, kind, frame_is_intra, width, height, CASE WHEN samples IS NOT NULL THEN md5(unhex(samples)) END AS md5, error"),
        "decoded_planes": _golden_sql("stream_id, chunk_idx, sub_idx, md5(unhex(samples)) AS md5, (length(samples) // 2)::BIGINT AS n_bytes", "samples IS NOT NULL"),
        "marked_frames": _typed(totals, ["stream_id", "frames", "pictures", "errors"], dict.fromkeys(["frames", "pictures", "errors"], "BIGINT")),
        "frame_digests": _golden_sql("stream_id, (row_number() OVER (PARTITION BY stream_id ORDER BY chunk_idx, sub_idx) - 1)::BIGINT AS display_idx, md5(unhex(samples)) AS md5", "samples IS NOT NULL"),
        "block_modes": f"SELECT stream_id, mi_row::INT AS mi_row, mi_col::INT AS mi_col, {spec.B8}::INT AS size, TRUE AS skip, 0::INT AS tx, mode::INT AS mode, uv_mode::INT AS uv_mode, 0::INT AS segment, {spec.INTRA}::INT AS ref0 FROM ({_values(_mode_rows())}) t(stream_id, mi_row, mi_col, mode, uv_mode)",
    }
