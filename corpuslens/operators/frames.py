"""Frames: parts of a file that decode on their own, and lookups by place.

A frame table is (file, frame, compressed_offset, compressed_size, decoded_offset,
decoded_size, first_line, last_line). Lookups of places have the file and a cell of lines or
bytes as equality keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions.scalars import cells

#: Lines and bytes of a cell: about what one frame holds.
LINE_CELL, BYTE_CELL = 1 << 16, 1 << 22


def place_frames(sizes: DataFrame) -> DataFrame:
    """Offsets of frames from (file, frame, compressed_size, decoded_size), by running sums."""
    before = Window.partitionBy("file").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    return sizes.withColumn("compressed_offset", start("compressed_size")).withColumn("decoded_offset", start("decoded_size"))


def place_lines(frames: DataFrame) -> DataFrame:
    """first_line and last_line of frames from their numbers of lines (``lines``)."""
    before = Window.partitionBy("file").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("lines").over(before), F.lit(0)) + 1
    return frames.withColumn("first_line", first.cast("long")).withColumn("last_line", (first + F.col("lines") - 1).cast("long"))


def fixed_frames(lines: DataFrame, size: int) -> DataFrame:
    """Frames of whole lines of about ``size`` bytes: (file, frame, decoded_offset, ...)."""
    frame = F.floor(F.col("byte_offset") / size).alias("frame")
    ends = F.max(F.col("byte_offset") + F.col("n_bytes") + 1)
    return lines.groupBy("file", frame).agg(F.min("byte_offset").alias("decoded_offset"), (ends - F.min("byte_offset")).cast("long").alias("decoded_size"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))


def of_lines(frames: DataFrame, requests: DataFrame) -> DataFrame:
    """(file, value, frame) for requested lines; lines that no frame holds are left out."""
    r = requests.select(F.col("file").alias("f"), F.col("value").cast("long").alias("value")).distinct()
    inside = F.col("value").between(F.col("first_line"), F.col("last_line"))
    celled = frames.withColumn("cell", F.explode(cells(F.col("first_line"), F.col("last_line"), LINE_CELL)))
    same = (F.col("f") == F.col("file")) & (F.floor(F.col("value") / LINE_CELL) == F.col("cell"))
    return r.join(celled, same & inside).select("file", "value", "frame")


def of_offsets(frames: DataFrame, requests: DataFrame) -> DataFrame:
    """(file, value, frame) for requested decoded offsets; null outside the file."""
    r = requests.select(F.col("file").alias("f"), F.col("value").cast("long").alias("value")).distinct()
    inside = (F.col("value") >= F.col("decoded_offset")) & (F.col("value") < F.col("decoded_offset") + F.col("decoded_size"))
    celled = frames.withColumn("cell", F.explode(cells(F.col("decoded_offset"), F.col("decoded_offset") + F.col("decoded_size") - 1, BYTE_CELL)))
    same = (F.col("f") == F.col("file")) & (F.floor(F.col("value") / BYTE_CELL) == F.col("cell"))
    return r.join(celled, same & inside, "left").select(F.col("f").alias("file"), "value", "frame")


def overlapping(frames: DataFrame, ranges: DataFrame) -> DataFrame:
    """(file, low, high, frame): frames that share a byte with the ranges [low, high)."""
    r = ranges.select(F.col("file").alias("f"), "low", "high").distinct()
    shared = (F.col("decoded_offset") < F.col("high")) & (F.col("decoded_offset") + F.col("decoded_size") > F.col("low"))
    return r.join(frames, (F.col("f") == F.col("file")) & shared).select("file", "low", "high", "frame")


def with_neighbours(wanted: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames with those beside them, which context lines may need."""
    near = wanted.select("file", F.explode(F.array(F.col("frame") - 1, F.col("frame"), F.col("frame") + 1)).alias("frame")).distinct()
    return near.join(frames.select("file", "frame"), ["file", "frame"], "left_semi")


def summary(frames: DataFrame) -> DataFrame:
    """Totals of each framed file."""
    target = F.min_by("decoded_size", "frame")
    return frames.groupBy("file").agg(F.count("*").alias("frames"), F.sum("compressed_size").alias("compressed_size"), F.sum("decoded_size").alias("decoded_size"), target.alias("frame_size"), F.max("last_line").alias("lines"))
