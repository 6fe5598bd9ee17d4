"""The relation of lines: (file, line_no, byte_offset, n_bytes, line).

Only ``\\n`` ends a line; ``\\r`` is content. A last line without ``\\n`` counts, and a
final ``\\n`` makes no further line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.functions import arrays

def split_lines(text: Column) -> Column:
    """The lines of a text, without their ends; none for a null or empty text."""
    body = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return F.when(text != "", F.split(body, "\n", -1)).otherwise(F.expr("cast(array() as array<string>)"))


def placed_lines(text: Column) -> Column:
    """array<struct<at, line>>: the lines with their byte offsets, by running sums in the row."""

    few = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<at:bigint,line:string>>)").alias("out"))
    add = lambda acc, line: F.struct((acc["at"] + F.octet_length(line) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), line.alias("line")))).alias("out"))

    def many(lines: Column) -> Column:
        starts = arrays.sums_before(F.transform(lines, lambda x: F.octet_length(x) + 1), levels=2)
        return F.zip_with(starts, lines, lambda at, line: F.struct(at.alias("at"), line.alias("line")))

    ends = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(ends >= arrays.STEP, arrays.let(split_lines(text), many)).otherwise(F.aggregate(split_lines(text), few, add, lambda acc: acc["out"]))


def lines_of(table: DataFrame, file: str, text: str, *, by_window: bool = False) -> DataFrame:
    """Lines of a string column; each row is a file named by ``file``.

    Offsets are running sums inside the row, so nothing is shuffled. For rows of very many
    lines ``by_window`` numbers the exploded lines in a window over each file instead.
    """
    if by_window:
        cut = table.select(F.col(file).alias("file"), F.posexplode(split_lines(F.col(text))).alias("pos", "line"))
        before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        at = F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long")
        return cut.select("file", (F.col("pos") + 1).cast("long").alias("line_no"), at.alias("byte_offset"), F.octet_length("line").cast("long").alias("n_bytes"), "line")
    cut = table.select(F.col(file).alias("file"), F.posexplode(placed_lines(F.col(text))).alias("pos", "x"))
    return cut.select("file", (F.col("pos") + 1).cast("long").alias("line_no"), F.col("x.at").alias("byte_offset"), F.octet_length("x.line").cast("long").alias("n_bytes"), F.col("x.line").alias("line"))


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Line numbers and byte offsets within each split, as its rows stream by."""
    path, block, line, at = None, None, 0, 0
    for batch in batches:
        paths, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        size = pc.binary_length(batch.column("line")).to_numpy(zero_copy_only=False).astype(np.int64)
        i = 0
        while i < len(paths):
            if (paths[i], blocks[i]) != (path, block):
                path, block, line, at = paths[i], blocks[i], 0, 0
            j = i
            while j < len(paths) and paths[j] == path and blocks[j] == block:
                j += 1
            ends = at + np.cumsum(size[i:j] + 1)
            rows = batch.slice(i, j - i)
            yield pa.record_batch([rows.column("file"), rows.column("block"), pa.array(np.arange(line + 1, line + 1 + j - i)), pa.array(ends - size[i:j] - 1), pa.array(size[i:j]), rows.column("line")], names=["file", "block", "line_no", "byte_offset", "n_bytes", "line"])
            line, at, i = line + j - i, int(ends[-1]), j


def lines_of_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of text files, split over tasks, with exact numbers and offsets.

    Each split numbers its own lines as they are read; what the earlier splits of a file
    hold is added from one row a split. Lines are never shuffled. Gzip, bzip2 and zstd
    files (by extension) are decoded by the reader and numbered in their decoded text.
    Bytes that are no UTF-8 are kept in the line and show as U+FFFD to patterns.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))
    local = raw.mapInArrow(_number, "file string, block long, line_no long, byte_offset long, n_bytes long, line binary")
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).cast("long").alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("file").alias("f"), F.col("block").alias("b"), F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))
    joined = local.join(starts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return joined.select("file", (F.col("line_no") + F.col("lines_before")).alias("line_no"), (F.col("byte_offset") + F.col("bytes_before")).alias("byte_offset"), "n_bytes", F.col("line").cast("string").alias("line"))


def split_counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, splits): into how many parts the reader cuts each file."""
    text = spark.read.option("lineSep", "\n").text(paths)
    parts = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).distinct()
    return parts.groupBy("file").agg(F.count("*").alias("splits"))
