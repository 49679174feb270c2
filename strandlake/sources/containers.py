"""Container files as DataFrames of chunks, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.kernel import containers

HEADER = "struct<version int, header_length int, fourcc string, width int, height int, tb_den bigint, tb_num bigint, frame_count bigint>"
CHUNKS = f"stream_id string, chunk_idx bigint, pts decimal(20,0), data binary, header {HEADER}, error string"
_HEADER = pa.struct([("version", pa.int32()), ("header_length", pa.int32()), ("fourcc", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("tb_den", pa.int64()), ("tb_num", pa.int64()), ("frame_count", pa.int64())])
_ARROW = pa.schema([("stream_id", pa.string()), ("chunk_idx", pa.int64()), ("pts", pa.decimal128(20, 0)), ("data", pa.binary()), ("header", _HEADER), ("error", pa.string())])
#: Bytes of chunks that go into one Arrow batch.
BATCH = 4 << 20


def _rows(stream: str, data: bytes, kind: str) -> Iterator[tuple]:
    try:
        if kind == "webm":
            width, height, chunks = containers.webm_chunks(data)
            header = {"version": 0, "header_length": 0, "fourcc": "VP90", "width": width, "height": height, "tb_den": 0, "tb_num": 0, "frame_count": len(chunks)}
            found = enumerate(chunks)
        else:
            header = vars(containers.ivf_header(data))
            found = containers.ivf_chunks(data)
        for i, (time, chunk) in enumerate(found):
            yield stream, i, None if chunk is None else time, chunk, header, "TruncatedFrame" if chunk is None else None
    except containers.ContainerError as e:
        yield stream, 0, None, None, None, str(e)


def chunks_of(files: DataFrame, kind: str = "ivf") -> DataFrame:
    """files (stream_id, content) to chunk rows, in their order; broken files and truncated records give a row with an error. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            for i in range(batch.num_rows):
                rows, held = [], 0
                for r in _rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b"", kind):
                    rows.append((r[0], r[1], None if r[2] is None else Decimal(r[2]), *r[3:]))
                    held += len(r[3] or b"")
                    if held >= BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, x, strict=True)) for x in rows], schema=_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, x, strict=True)) for x in rows], schema=_ARROW)

    return files.select(F.col("stream_id").cast("string"), "content").mapInArrow(run, CHUNKS)


def read_chunks(spark: SparkSession, path: str, kind: str = "ivf") -> DataFrame:
    """Chunks of all container files below a path; the stream id is the file's path. A file is one row of Spark's binary reader: up to 2 GB."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").option("recursiveFileLookup", "true").load(path)
    return chunks_of(files.select(F.col("path").alias("stream_id"), "content"), kind)


def ivf_files(chunks: DataFrame) -> DataFrame:
    """stream_id, content: one IVF file per stream, chunks in order, times renumbered. A stream's bytes meet in one task."""

    def run(key, table):
        order = table.sort_by("chunk_idx")
        header = next((h for h in order.column("header").to_pylist() if h), None) or {"width": 0, "height": 0}
        data = [d for d in order.column("data").to_pylist() if d is not None]
        content = containers.write_ivf(data, header["width"], header["height"])
        return pa.table({"stream_id": pa.array([key[0].as_py()], pa.string()), "content": pa.array([content], pa.binary())})

    return chunks.select("stream_id", "chunk_idx", "data", "header").groupBy("stream_id").applyInArrow(run, "stream_id string, content binary")
