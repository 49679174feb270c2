"""State that frames carry, as relational operators over a catalogue of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOTS = 8


def last_shown(frames: DataFrame, chunk: list[str], order: str, shown: str, out: str = "keeps_pixels") -> DataFrame:
    """Mark the last shown frame of each chunk; the others of a chunk give no picture."""
    last = F.max(F.when(F.col(shown), F.col(order))).over(Window.partitionBy(*chunk))
    return frames.withColumn(out, F.coalesce(F.col(order) == last, F.lit(False)))


def reference_slots(frames: DataFrame, stream: str, order: str, frame: str, mask: str) -> DataFrame:
    """(stream, frame, slot, held): which frame each of the 8 slots holds before a frame is decoded.

    Each frame writes the slots of its mask. One shuffle by (stream, slot): a hot stream is
    spread over 8 tasks at least, and its rows are sorted by order inside each.
    """
    slots = frames.select(stream, order, frame, mask, F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    written = F.when(F.expr(f"shiftright(cast({mask} as int), slot) & 1") == 1, F.col(frame))
    before = Window.partitionBy(stream, "slot").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return slots.select(stream, frame, "slot", F.last(written, ignorenulls=True).over(before).alias("held"))


def group_of_pictures(frames: DataFrame, stream: str, order: list[str], key: str, out: str = "gop_id") -> DataFrame:
    """Number the stretches that start with a key frame: a key frame reads no earlier state and renews all of it."""
    so_far = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn(out, F.sum(F.col(key).cast("long")).over(so_far))


def carried(frames: DataFrame, stream: str, order: list[str], column: str, default: Column, out: str) -> DataFrame:
    """The last value that isn't null up to each frame, or the default before any."""
    so_far = Window.partitionBy(stream).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn(out, F.coalesce(F.last(column, ignorenulls=True).over(so_far), default))


def uses_previous_motion(frames: DataFrame, stream: str, order: list[str], out: str = "use_prev_mvs") -> DataFrame:
    """Whether a frame predicts motion from the one before: neither intra nor error resilient, equal size, and that one was shown."""
    w = Window.partitionBy(stream).orderBy(*order)
    same = (F.lag("width").over(w) == F.col("width")) & (F.lag("height").over(w) == F.col("height")) & F.lag("show_frame").over(w)
    return frames.withColumn(out, F.coalesce(~F.col("frame_is_intra") & ~F.col("error_resilient") & same, F.lit(False)))


def segment_minimum(blocks: DataFrame, cells: DataFrame, cell: int = 8) -> DataFrame:
    """Least segment id of the previous map under each block: blocks (block, row, col, rows, cols), cells (row, col, segment).

    A range join, made an equi-join by tiles of cell x cell: each block goes to the tiles it touches.
    """
    tiles = blocks.withColumn("tr", F.explode(F.sequence(F.expr(f"row div {cell}"), F.expr(f"(row + rows - 1) div {cell}"))))
    tiles = tiles.withColumn("tc", F.explode(F.sequence(F.expr(f"col div {cell}"), F.expr(f"(col + cols - 1) div {cell}"))))
    c = cells.select(F.col("row").alias("r"), F.col("col").alias("c"), "segment", F.expr(f"row div {cell}").alias("tr"), F.expr(f"col div {cell}").alias("tc"))
    inside = (F.col("r") >= F.col("row")) & (F.col("r") < F.col("row") + F.col("rows")) & (F.col("c") >= F.col("col")) & (F.col("c") < F.col("col") + F.col("cols"))
    return tiles.join(c, ["tr", "tc"]).where(inside).groupBy("block").agg(F.min("segment").alias("segment"))
