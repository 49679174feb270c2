"""Streams as DataFrames: containers, catalogue, decoding, order and errors."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.kernel import containers, fixtures, spec
from strandlake.kernel.decoder import Decoder
from strandlake.kernel.headers import Header, join_superframe, split_superframe
from strandlake.plans import streams
from strandlake.sources import containers as source


@pytest.fixture(scope="module")
def chunks(spark):
    demo = fixtures.demo_stream()
    return source.chunks_of(spark.createDataFrame([("a", bytearray(demo)), ("b", bytearray(demo[:-5])), ("c", bytearray(b"no"))], "stream_id string, content binary"))


def test_ivf(chunks, spark, tmp_path):
    rows = {(r["stream_id"], r["chunk_idx"]): r for r in chunks.collect()}
    assert len(rows) == 9 and rows["c", 0]["error"] == "TooShort" and rows["b", 3]["error"] == "TruncatedFrame"
    assert rows["a", 2]["pts"] == 2 and rows["a", 0]["header"]["fourcc"] == "VP90"
    back = {r["stream_id"]: bytes(r["content"]) for r in source.ivf_files(chunks).collect()}
    assert back["a"] == fixtures.demo_stream()
    (tmp_path / "x.ivf").write_bytes(back["a"])
    assert source.read_chunks(spark, str(tmp_path)).where("error is null").count() == 4
    with pytest.raises(containers.ContainerError, match="InvalidMagic"):
        containers.ivf_header(b"x" * 40)


def element(name, body, unknown=False):
    raw = name.to_bytes((name.bit_length() + 7) // 8, "big")
    return raw + (b"\x01" + b"\xff" * 7 if unknown else struct.pack(">Q", len(body) | 1 << 56)) + body


@pytest.mark.parametrize("unknown", [False, True])
def test_webm(spark, unknown):
    c = containers
    video = element(c.VIDEO, element(c.PIXEL_WIDTH, b"\x10") + element(c.PIXEL_HEIGHT, b"\x20"))
    track = element(c.TRACK, element(c.NUMBER, b"\x01") + element(c.KIND, b"\x01") + element(c.CODEC, b"V_VP9") + video)
    other = element(c.TRACK, element(c.NUMBER, b"\x02") + element(c.KIND, b"\x02") + element(c.CODEC, b"A_OPUS") + video)
    first = element(c.SIMPLE_BLOCK, b"\x81\0\0\x80one") + element(c.SIMPLE_BLOCK, b"\x82\0\0\x80sound")
    second = element(c.GROUP, element(c.BLOCK, b"\x81\0\0\0two"))
    data = element(0x1A45DFA3, b"") + element(c.SEGMENT, element(c.TRACKS, other + track) + element(c.CLUSTER, first, unknown) + element(c.CLUSTER, second, unknown), unknown)
    assert c.webm_chunks(data) == (16, 32, [b"one", b"two"])
    rows = source.chunks_of(spark.createDataFrame([("w", bytearray(data)), ("x", bytearray(data[:40]))], "stream_id string, content binary"), "webm").collect()
    assert sorted(bytes(r["data"] or b"") for r in rows) == [b"", b"one", b"two"]
    with pytest.raises(c.ContainerError, match="LacedBlock"):
        c.webm_chunks(element(c.SEGMENT, element(c.TRACKS, track) + element(c.CLUSTER, element(c.SIMPLE_BLOCK, b"\x81\0\0\x02x"))))


def test_native_superframes_agree_with_the_kernel(spark):
    rng = np.random.default_rng(5)
    cases = [b"", b"a", b"abc" + bytes([0xC1, 200, 1, 0xC1]), b"\xc0", b"\xc0\x00\xc0", join_superframe([b"x"]), join_superframe([b"a" * 300, b"", b"b" * 70000])]
    for _ in range(60):
        frames = [rng.bytes(int(rng.integers(0, 40))) for _ in range(int(rng.integers(1, 9)))]
        data = join_superframe(frames)
        cases += [data, data[:-1], b"zz" + data, data[1:]]
    rows = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, data binary").select("i", streams.superframe(F.col("data")).alias("f")).collect()
    assert all([bytes(x) for x in r["f"]] == split_superframe(cases[r["i"]]) for r in rows)


def test_catalogue_agrees_with_headers(chunks):
    catalog = streams.frame_catalog(chunks)
    heads = {(r["stream_id"], r["chunk_idx"], r["sub_idx"]): r for r in streams.frame_headers(catalog).collect()}
    rows = catalog.collect()
    assert len(rows) == len(heads) == 9
    for r in rows:
        h = heads[r["stream_id"], r["chunk_idx"], r["sub_idx"]]
        assert (r["profile"], r["is_key"], r["show_existing"]) == (h["profile"], h["key"], h["show_existing"] is not None)
        assert r["show_existing"] or (r["show_frame"], r["error_resilient"]) == (h["show"], h["resilient"])
    assert [r["gop_id"] for r in sorted(rows, key=lambda r: (r["stream_id"], r["chunk_idx"], r["sub_idx"]))][:5] == [1, 1, 1, 1, 2]


def test_profile_three_flags(spark):
    h = fixtures.key_header(profile=3, show=False, resilient=False, color=fixtures.key_header().color.__class__(12, 2, False, 1, 0))
    row = streams.frame_catalog(spark.createDataFrame([("s", 0, None, bytearray(fixtures.write_header(h)))], "stream_id string, chunk_idx bigint, pts decimal(20,0), data binary")).first()
    assert (row["profile"], row["is_key"], row["show_frame"], row["error_resilient"]) == (3, True, False, False)


def test_decoding_agrees_with_one_decoder(chunks):
    demo = [c for _, c in containers.ivf_chunks(fixtures.demo_stream())]
    d, want = Decoder(), []
    for c in demo:
        want += [hashlib.md5(x.picture.i420()).hexdigest() for x in d.decode_chunk(c) if x.picture]
    decoded = streams.decode(streams.frame_catalog(chunks))
    got = [r["md5"] for r in streams.frame_digests(decoded).where("stream_id = 'a'").orderBy("display_idx").collect()]
    assert got == want and len(got) == 4
    rows = decoded.where("stream_id = 'a' and frame is not null").collect()
    assert all(hashlib.md5(bytes(r["frame"]["y"]) + bytes(r["frame"]["u"]) + bytes(r["frame"]["v"])).hexdigest() == r["md5"] for r in rows)
    assert [r["png"][:4] for r in streams.pictures_png(decoded).collect()] == [b"\x89PNG"] * 7
    blocks = streams.block_modes(streams.frame_catalog(chunks)).where("stream_id = 'a' and chunk_idx = 0").collect()
    assert {(b["mi_row"], b["mode"]) for b in blocks} == {(0, spec.V), (1, spec.H)}


def test_random_streams_decode_side_by_side(spark):
    made = {f"r{i}": fixtures.random_stream(fixtures.demo_headers() * 2, i) for i in range(3)}
    files = spark.createDataFrame([(n, bytearray(fixtures.ivf(frames))) for n, (frames, _) in made.items()], "stream_id string, content binary")
    catalog = streams.frame_catalog(source.chunks_of(files).repartition(4))
    got = {(r["stream_id"], r["display_idx"]): r["md5"] for r in streams.frame_digests(streams.decode(catalog, planes=False)).collect()}
    for n, (_, given) in made.items():
        want = [hashlib.md5(d.picture.i420()).hexdigest() for d in given if d.picture]
        assert [got[n, i] for i in range(len(want))] == want
    assert catalog.select("stream_id", "gop_id").distinct().count() == 6


def test_errors_end_a_stream(spark):
    key = fixtures.frame(fixtures.key_header(), lambda r, c: {})
    lost = fixtures.write_header(Header(show=True, resilient=True, width=16, height=16, refs=[0, 0, 0], interp_filter=0, compressed_size=9))
    rows = [("s", i, None, bytearray(c)) for i, c in enumerate([key, join_superframe([key, lost]), key])]
    catalog = streams.frame_catalog(spark.createDataFrame(rows, "stream_id string, chunk_idx bigint, pts decimal(20,0), data binary"))
    stop = streams.decode(catalog, planes=False).orderBy("chunk_idx", "sub_idx").collect()
    assert [(r["chunk_idx"], r["error"]) for r in stop] == [(0, None), (1, "TruncatedFrame")]
    on = streams.decode(catalog, planes=False, policy="continue").orderBy("chunk_idx", "sub_idx").collect()
    assert [(r["chunk_idx"], r["error"]) for r in on] == [(0, None), (1, "TruncatedFrame"), (2, None)]


def test_streaming_waits_for_order(spark, tmp_path):
    from strandlake.streaming.ordered import stream_headers

    demo = [c for _, c in containers.ivf_chunks(fixtures.demo_stream())]
    schema = "stream_id string, chunk_idx bigint, data binary"
    for n, order in enumerate(((2, 1), (0, 3))):
        spark.createDataFrame([("s", i, bytearray(demo[i])) for i in order], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_headers(live).writeStream.format("memory").queryName("headers").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    rows = spark.table("headers").collect()
    assert sorted((r["chunk_idx"], r["sub_idx"]) for r in rows) == [(0, 0), (1, 0), (1, 1), (2, 0), (3, 0)]
    assert [r["is_key"] for r in sorted(rows, key=lambda r: (r["chunk_idx"], r["sub_idx"]))] == [True, False, False, False, True]


def test_streaming_gives_up_on_a_missing_chunk(spark, tmp_path):
    """Five chunks wait for number 1; a sixth ends the stream, and what comes later is ignored."""
    from strandlake.streaming.ordered import stream_headers

    key = fixtures.frame(fixtures.key_header(), lambda r, c: {})
    schema = "stream_id string, chunk_idx bigint, data binary"
    for order in ((0, 2, 3), (4, 5, 6, 7), (1, 8)):
        spark.createDataFrame([("s", i, bytearray(key)) for i in order], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_headers(live, patience=5).writeStream.format("memory").queryName("given_up").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["chunk_idx"], r["error"] or "") for r in spark.table("given_up").collect()) == [(0, ""), (1, "MissingChunk")]


def test_waiting_chunks_keep_their_headers_only():
    from strandlake.streaming.ordered import HEAD, heads_of

    draw = np.random.default_rng(1)
    for n in (1, 2, 5):
        frames = [fixtures.write_header(h) + draw.bytes(int(draw.integers(0, 3000))) for h in fixtures.demo_headers()[:n]]
        chunk = join_superframe(frames) if n > 1 else frames[0]
        short = heads_of(chunk)
        assert len(short) <= min(len(chunk), n * HEAD + 40)
        assert [vars(h) for h in Decoder().headers_only(short)] == [vars(h) for h in Decoder().headers_only(chunk)]


def test_frames_behind_an_error_are_marked(spark):
    key = fixtures.frame(fixtures.key_header(), lambda r, c: {})
    lost = fixtures.write_header(Header(show=True, resilient=True, width=16, height=16, refs=[0, 0, 0], interp_filter=0, compressed_size=9))
    rows = [("s", i, None, bytearray(c)) for i, c in enumerate([key, join_superframe([key, lost, key]), join_superframe([lost, key]), key])]
    catalog = streams.frame_catalog(spark.createDataFrame(rows, "stream_id string, chunk_idx bigint, pts decimal(20,0), data binary"))
    for planes in (False, True):
        got = streams.decode(catalog, planes=planes, policy="mark").orderBy("chunk_idx", "sub_idx").collect()
        assert [(r["chunk_idx"], r["sub_idx"], r["error"], r["frame"] is not None) for r in got] == [(0, 0, None, True), (1, 1, "TruncatedFrame", False), (1, 2, streams.AFTER_ERROR, False), (2, 0, streams.AFTER_ERROR, False), (2, 1, streams.AFTER_ERROR, False), (3, 0, streams.AFTER_ERROR, False)]


def test_a_key_frame_inside_of_a_chunk(spark):
    """A chunk isn't split between runs, whichever of its frames are key frames."""
    key = fixtures.frame(fixtures.key_header(), lambda r, c: {"mode": spec.V, "uv_mode": spec.V})
    other = fixtures.frame(fixtures.key_header(32, 16), lambda r, c: {"mode": spec.H, "uv_mode": spec.H})
    again = fixtures.write_header(Header(show_existing=0))
    rows = [("s", i, None, bytearray(c)) for i, c in enumerate([key, join_superframe([again, other]), again, key])]
    catalog = streams.frame_catalog(spark.createDataFrame(rows, "stream_id string, chunk_idx bigint, pts decimal(20,0), data binary"))
    got = streams.decode(catalog, planes=False).where("md5 is not null").orderBy("chunk_idx", "sub_idx").collect()
    assert [(r["chunk_idx"], r["sub_idx"], r["frame"]["width"]) for r in got] == [(0, 0, 16), (1, 1, 32), (2, 0, 32), (3, 0, 16)]
