"""Streams as DataFrames: a catalogue of frames, their headers, pictures and digests."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.kernel.bits import BitstreamError
from strandlake.kernel.decoder import Decoder
from strandlake.kernel.headers import Persistent, parse_header
from strandlake.kernel.tables import load
from strandlake.operators import framestate


def _byte(data: Column, at: Column) -> Column:
    """The byte at a 1-based place, as an int."""
    return F.conv(F.hex(F.substr(data, at, F.lit(1))), 16, 10).cast("int")


def superframe(data: Column) -> Column:
    """The frames of a chunk as array<binary>, in native expressions; a broken index makes the chunk one frame."""
    size = F.octet_length(data)
    marker = F.coalesce(_byte(data, size), F.lit(0))
    count, width = marker.bitwiseAND(F.lit(7)) + 1, F.shiftright(marker, 3).bitwiseAND(F.lit(3)) + 1
    start = size - (2 + count * width) + 1  # of the index
    there = (marker.bitwiseAND(F.lit(0xE0)) == 0xC0) & (start >= 1) & (F.coalesce(_byte(data, start), F.lit(-1)) == marker)

    def coded(i: Column) -> Column:
        """A little-endian size of `width` bytes."""
        parts = [F.when(F.lit(b) < width, F.coalesce(_byte(data, start + 1 + i * width + b), F.lit(0)).cast("long") * (1 << 8 * b)).otherwise(0) for b in range(4)]
        return sum(parts[1:], parts[0])

    sizes = F.when(there, F.transform(F.sequence(F.lit(0), count - 1), coded))
    ends = F.transform(F.sequence(F.lit(1), count), lambda n: F.aggregate(F.slice(sizes, 1, n), F.lit(0).cast("long"), lambda s, x: s + x))
    fits = there & (F.element_at(ends, -1) <= start - 1)
    frames = F.zip_with(sizes, ends, lambda n, e: F.substr(data, (e - n + 1).cast("int"), n.cast("int")))
    return F.when(fits, frames).otherwise(F.array(data))


def frame_catalog(chunks: DataFrame) -> DataFrame:
    """One row per frame with the facts of its first bytes; no kernel, one shuffle by stream.

    Adds sub_idx, frame (binary), coded_bytes, profile, show_existing, is_key, show_frame,
    error_resilient (null for repeated pictures), gop_id and keeps_pixels (the last shown of its chunk).
    """
    rows = chunks.where("data is not null").select("stream_id", "chunk_idx", "pts", F.posexplode(superframe(F.col("data"))).alias("sub_idx", "frame"))
    first, second = F.coalesce(_byte(F.col("frame"), F.lit(1)), F.lit(0)), F.coalesce(_byte(F.col("frame"), F.lit(2)), F.lit(0))
    # the first 16 bits; a reserved bit follows profile 3
    rows = rows.withColumn("_bits", first * 256 + second).withColumn("profile", F.expr("(_bits >> 13 & 1) + 2 * (_bits >> 12 & 1)"))
    rows = rows.withColumn("_bits", F.when(F.col("profile") == 3, F.shiftleft("_bits", 1)).otherwise(F.col("_bits")))
    bit = lambda n: F.expr(f"(_bits >> {n} & 1) = 1")
    new = lambda c: F.when(~F.col("show_existing"), c)
    rows = rows.withColumn("show_existing", bit(11))
    rows = rows.withColumns({"is_key": ~F.col("show_existing") & ~bit(10), "show_frame": F.col("show_existing") | bit(9), "error_resilient": new(bit(8)), "coded_bytes": F.octet_length("frame")}).drop("_bits")
    rows = framestate.group_of_pictures(rows, "stream_id", ["chunk_idx", "sub_idx"], "is_key")
    return framestate.last_shown(rows, ["stream_id", "chunk_idx"], "sub_idx", "show_frame")


def stream_summary(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("stream_id").agg(F.count("*").alias("frames"), F.sum(F.col("is_key").cast("int")).alias("key_frames"), F.sum((~F.col("show_frame")).cast("int")).alias("hidden_frames"), F.sum("coded_bytes").alias("coded_bytes"))


_HEADERS = {
    "profile": "int", "show_existing": "int", "key": "boolean", "show": "boolean", "resilient": "boolean", "intra_only": "boolean", "reset_context": "int", "width": "int", "height": "int",
    "render_width": "int", "render_height": "int", "refresh": "int", "refs": "array<int>", "sign_bias": "array<int>", "high_precision": "boolean", "interp_filter": "int", "refresh_context": "boolean",
    "parallel": "boolean", "context": "int", "lf_level": "int", "sharpness": "int", "deltas_on": "boolean", "ref_deltas": "array<int>", "mode_deltas": "array<int>", "base_q": "int", "q_y_dc": "int",
    "q_uv_dc": "int", "q_uv_ac": "int", "seg_on": "boolean", "seg_update_map": "boolean", "seg_temporal": "boolean", "tree_probs": "array<int>", "pred_probs": "array<int>", "absolute": "boolean",
    "tile_cols_log2": "int", "tile_rows_log2": "int", "compressed_size": "int",
}
_COLOR = "struct<bit_depth int, space int, full_range boolean, sx int, sy int>"
_KINDS = {"int": pa.int32(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
_COLOR_ARROW = pa.struct([("bit_depth", pa.int32()), ("space", pa.int32()), ("full_range", pa.bool_()), ("sx", pa.int32()), ("sy", pa.int32())])
_PLACE = [("stream_id", pa.string()), ("chunk_idx", pa.int64()), ("sub_idx", pa.int32())]


def _in_order(table: pa.Table) -> list[dict]:
    return table.select(["stream_id", "chunk_idx", "sub_idx", "frame"]).sort_by([("chunk_idx", "ascending"), ("sub_idx", "ascending")]).to_pylist()


def frame_headers(catalog: DataFrame) -> DataFrame:
    """Every field of the uncompressed headers, by an ordered scan of each group of pictures.

    Sizes and deltas that headers inherit are carried as if all frames decoded. A header
    that can't be parsed gives an error and ends its group.
    """
    schema = pa.schema([*_PLACE, *((n, _KINDS[k]) for n, k in _HEADERS.items()), ("color", _COLOR_ARROW), ("features", pa.list_(pa.list_(pa.int32()))), ("error", pa.string())])

    def run(key, table):
        scan, rows = Decoder.__new__(Decoder), []
        scan.kept = Persistent()
        for r in _in_order(table):
            row = {k: r[k] for k in ("stream_id", "chunk_idx", "sub_idx")}
            try:
                h = parse_header(r["frame"], scan.kept)
                if h.show_existing is None:
                    scan._keep_header(h)
                row |= {n: getattr(h, n) for n in _HEADERS} | {"color": vars(h.color) if h.color else None, "features": h.features}
                rows.append(row)
            except BitstreamError as e:
                rows.append(row | {"error": e.kind})
                break
        return pa.Table.from_pylist(rows, schema=schema)

    ddl = "stream_id string, chunk_idx bigint, sub_idx int, " + ", ".join(f"{n} {k}" for n, k in _HEADERS.items()) + f", color {_COLOR}, features array<array<int>>, error string"
    return catalog.groupBy("stream_id", "gop_id").applyInArrow(run, ddl)


_INFO = "struct<intra_only boolean, frame_is_intra boolean, reset_frame_context int, segmentation_enabled boolean, seg_features_active array<boolean>>"
_FRAME = "struct<width int, height int, bit_depth int, subsampling_x int, subsampling_y int, y binary, u binary, v binary>"
#: The error of frames behind a stream's first one, where they keep a row.
AFTER_ERROR = "AfterError"
DECODED = f"stream_id string, chunk_idx bigint, sub_idx int, gop_id bigint, kind string, info {_INFO}, frame {_FRAME}, md5 string, error string"


#: Bytes of pictures that leave a task at once.
BATCH = 16 << 20


def _written(rows: DataFrame) -> DataFrame:
    """Rows as Parquet in the folder that driver and executors share, read back: pictures are decoded once, however often they are read."""
    spark = rows.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/strandlake/decoded-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _in_runs(catalog: DataFrame, one: bool = False) -> DataFrame:
    """The catalogue's frames, dealt to tasks by runs and in order inside: from a chunk that begins with a key frame to the next (one: a stream is one run)."""
    starts = F.sum((F.col("is_key") & (F.col("sub_idx") == 0)).cast("int")).over(Window.partitionBy("stream_id").orderBy("chunk_idx", "sub_idx"))
    rows = catalog.select("stream_id", "chunk_idx", "sub_idx", "gop_id", "keeps_pixels", "frame", (F.lit(0) if one else starts).alias("_run"))
    return rows.repartition("stream_id", "_run").sortWithinPartitions("stream_id", "_run", "chunk_idx", "sub_idx")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Run (stream, number) and frames of each chunk, in order."""
    now, frames = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            r = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
            at = (r["stream_id"], r["_run"], r["chunk_idx"])
            if at != now and frames:
                yield now[:2], frames
                frames = []
            now = at
            frames.append(r)
    if frames:
        yield now[:2], frames


def decode(catalog: DataFrame, planes: bool = True, tables: str | None = None, policy: str = "stop_stream") -> DataFrame:
    """Decode frames: kind (new_shown, new_hidden, show_existing), info, frame, md5 of Y, U, V, error.

    tables: path of the format's tables (see kernel.tables), readable on every executor;
    None: the shipped ones. planes=False leaves the samples out and keeps the digests.

    Runs of chunks from one that begins with a key frame to the next decode side by side; a
    task reads its runs frame by frame and gives pictures away in batches, so it holds a
    batch and the reference slots, however long a run is. An error drops all other results
    of its chunk; of the shown frames of a chunk only the last keeps its picture.

    policy, for what follows a stream's first error: "stop_stream" drops it; "mark" keeps a
    row of each frame with error AfterError and nothing else; "continue" takes each stream
    as one run, whose decoder goes on. The first two compare places, not pictures: with
    planes the rows are written to the shared folder first.
    """
    if policy not in ("stop_stream", "mark", "continue"):
        raise ValueError(policy)
    info = pa.struct([("intra_only", pa.bool_()), ("frame_is_intra", pa.bool_()), ("reset_frame_context", pa.int32()), ("segmentation_enabled", pa.bool_()), ("seg_features_active", pa.list_(pa.bool_()))])
    frame = pa.struct([("width", pa.int32()), ("height", pa.int32()), ("bit_depth", pa.int32()), ("subsampling_x", pa.int32()), ("subsampling_y", pa.int32()), ("y", pa.binary()), ("u", pa.binary()), ("v", pa.binary())])
    schema = pa.schema([*_PLACE, ("gop_id", pa.int64()), ("kind", pa.string()), ("info", info), ("frame", frame), ("md5", pa.string()), ("error", pa.string())])

    def facts(d, keeps: bool) -> dict:
        h, p = d.header, d.picture
        row = {"kind": "show_existing" if h is None else "new_shown" if h.show else "new_hidden"}
        if h is not None:
            active = [h.seg_on and any(s[i] is not None for s in h.features) for i in range(4)]
            row["info"] = {"intra_only": h.intra_only, "frame_is_intra": h.intra, "reset_frame_context": h.reset_context, "segmentation_enabled": h.seg_on, "seg_features_active": active}
        if p is not None and keeps:
            y, u, v = (x.tobytes() if planes else None for x in p.planes)
            row["frame"] = {"width": p.width, "height": p.height, "bit_depth": p.color.bit_depth, "subsampling_x": p.color.sx, "subsampling_y": p.color.sy, "y": y, "u": u, "v": v}
            row["md5"] = hashlib.md5(p.i420()).hexdigest()
        return row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, decoder, ended, rows, held = None, None, False, [], 0
        for at, frames in _chunks(batches):
            if at != known:
                known, decoder, ended = at, Decoder(load(tables)), False
            made = []
            for r in frames:
                row = {k: r[k] for k in ("stream_id", "chunk_idx", "sub_idx", "gop_id")}
                if ended:
                    made.append(row | {"error": AFTER_ERROR})
                    continue
                try:
                    made.append(row | facts(decoder.decode_frame(r["frame"]), r["keeps_pixels"]))
                except BitstreamError as e:
                    rest = [{k: x[k] for k in row} | {"error": AFTER_ERROR} for x in frames if x["sub_idx"] > r["sub_idx"]]
                    made = [row | {"error": e.kind}, *(rest if policy == "mark" else [])]
                    ended = policy != "continue"
                    break
            rows += [r for r in made if policy == "mark" or r.get("error") != AFTER_ERROR]
            held += sum(len(r["frame"][k] or b"") for r in made if "frame" in r for k in "yuv")
            if held >= BATCH or len(rows) >= 4096:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    out = _in_runs(catalog, policy == "continue").mapInArrow(run, DECODED)
    if policy == "continue":
        return out
    place = F.struct("chunk_idx", "sub_idx")
    if planes:
        out = _written(out)
        ends = out.where("error is not null").groupBy("stream_id").agg(F.min(place).alias("_end"))
        out = out.join(ends, "stream_id", "left")
    else:
        out = out.withColumn("_end", F.min(F.when(F.col("error").isNotNull(), place)).over(Window.partitionBy("stream_id")))
    after = F.coalesce(place > F.col("_end"), F.lit(False))
    if policy == "stop_stream":
        out = out.where(~after)
    else:
        out = out.withColumns({c: F.when(~after, F.col(c)) for c in ("kind", "info", "frame", "md5")} | {"error": F.when(after, F.lit(AFTER_ERROR)).otherwise(F.col("error"))})
    return out.select(*schema.names)


def frame_digests(decoded: DataFrame) -> DataFrame:
    """stream_id, display_idx, md5 of the displayed frames in order."""
    order = Window.partitionBy("stream_id").orderBy("chunk_idx", "sub_idx")
    return decoded.where("md5 is not null").select("stream_id", (F.row_number().over(order) - 1).alias("display_idx"), "md5")


def block_modes(catalog: DataFrame, tables: str | None = None) -> DataFrame:
    """One row per 8x8 unit of each decoded frame: size, skip, transform size, modes, segment, references, vectors and filter.

    A run ends with its first error. Rows leave frame by frame.
    """
    names = [("mi_row", pa.int32()), ("mi_col", pa.int32()), ("size", pa.int32()), ("skip", pa.bool_()), ("tx", pa.int32()), ("mode", pa.int32()), ("uv_mode", pa.int32()), ("segment", pa.int32()), ("ref0", pa.int32()), ("ref1", pa.int32()), ("mv_row", pa.int32()), ("mv_col", pa.int32()), ("interp_filter", pa.int32())]
    schema = pa.schema([*_PLACE, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, decoder = None, None
        for at, frames in _chunks(batches):
            if at != known:
                known, decoder = at, Decoder(load(tables))
            for r in frames if decoder else []:
                try:
                    d = decoder.decode_frame(r["frame"])
                except BitstreamError:
                    decoder = None
                    break
                if d.header is None:
                    continue
                cells = [(y, x, b.size, b.skip, b.tx, b.mode, b.uv_mode, b.segment, *b.refs, *b.mv(0), b.interp_filter) for y, line in enumerate(d.blocks[: d.header.mi_rows]) for x, b in enumerate(line[: d.header.mi_cols])]
                place = [pa.array([r[n]] * len(cells), k) for n, k in _PLACE]
                yield pa.RecordBatch.from_arrays([*place, *(pa.array(c, k) for c, (_, k) in zip(zip(*cells, strict=True), names, strict=True))], schema=schema)

    kinds = {pa.int32(): "int", pa.bool_(): "boolean"}
    ddl = "stream_id string, chunk_idx bigint, sub_idx int, " + ", ".join(f"{n} {kinds[k]}" for n, k in names)
    return _in_runs(catalog).mapInArrow(run, ddl)


def pictures_png(decoded: DataFrame) -> DataFrame:
    """stream_id, chunk_idx, sub_idx, png of decoded 8-bit 4:2:0 pictures (which need planes=True)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strandlake.kernel.containers import png
        from strandlake.kernel.decoder import Color, Picture

        for batch in batches:
            out = []
            for f in batch.column(3).to_pylist():
                w, h = f["width"], f["height"]
                y, u, v = (np.frombuffer(f[k], np.uint8) for k in "yuv")
                out.append(png(Picture(w, h, Color(), [y.reshape(h, w), u.reshape((h + 1) // 2, -1), v.reshape((h + 1) // 2, -1)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["stream_id", "chunk_idx", "sub_idx", "png"])

    shown = decoded.where("frame is not null and frame.y is not null and frame.bit_depth = 8 and frame.subsampling_x = 1 and frame.subsampling_y = 1")
    return shown.select("stream_id", "chunk_idx", "sub_idx", "frame").mapInArrow(run, "stream_id string, chunk_idx bigint, sub_idx int, png binary")
