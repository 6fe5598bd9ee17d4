"""Sparse indexes: checkpoints by line or by bytes, and lookups of the last one before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def every_n_lines(lines: DataFrame, n: int) -> DataFrame:
    """(file, line_no, byte_offset) of the first line and of every n-th."""
    return lines.filter((F.col("line_no") == 1) | (F.col("line_no") % n == 0)).select("file", "line_no", "byte_offset")


def _emit(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, due = None, 0
        for batch in batches:
            files = batch.column("file").to_pylist()
            numbers, offsets = batch.column("line_no").to_numpy(), batch.column("byte_offset").to_numpy()
            keep, i = [], 0
            while i < len(files):
                if files[i] != file:
                    file, due = files[i], 0
                j = i + 1
                while j < len(files) and files[j] == file:
                    j += 1
                while (k := i + int(np.searchsorted(offsets[i:j], due))) < j:
                    keep.append(k)
                    due = int(offsets[k]) + step
                i = j
            yield batch.take(pa.array(keep, pa.int64())) if keep else batch.slice(0, 0)
            del numbers

    return run


def every_n_bytes(lines: DataFrame, step: int) -> DataFrame:
    """(file, line_no, byte_offset) of the first line at least ``step`` after the one before.

    Each emission sets the next, so a file's lines stream through one task in order, of
    which only places are shuffled.
    """
    places = lines.select("file", "line_no", "byte_offset")
    sorted_ = places.repartition("file").sortWithinPartitions("file", "line_no")
    return sorted_.mapInArrow(_emit(step), places.schema)


def buckets_of_bytes(lines: DataFrame, step: int) -> DataFrame:
    """(file, line_no, byte_offset) of the first line in each ``step`` of bytes: an aggregate."""
    first = F.min(F.struct("line_no", "byte_offset")).alias("x")
    return lines.groupBy("file", F.floor(F.col("byte_offset") / step).alias("bucket")).agg(first).select("file", "x.line_no", "x.byte_offset")


def last_checkpoint(lines: DataFrame, checkpoints: DataFrame, by: str = "line_no") -> DataFrame:
    """``lines`` with the last checkpoint at or before each, in one ordered window per file."""
    marks = checkpoints.select(F.col("file"), F.col("line_no").alias("cl"), F.col("byte_offset").alias("co")).withColumn("at", F.col("cl") if by == "line_no" else F.col("co"))
    points = lines.withColumn("at", F.col(by)).withColumn("is_line", F.lit(1))
    both = points.unionByName(marks.withColumn("is_line", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy("file").orderBy("at", "is_line").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("checkpoint", F.last(F.when(F.col("is_line") == 0, F.struct(F.col("cl").alias("line_no"), F.col("co").alias("byte_offset"))), ignorenulls=True).over(order))
    return found.filter("is_line = 1").select(*lines.columns, F.col("checkpoint.line_no").alias("checkpoint_line"), F.col("checkpoint.byte_offset").alias("checkpoint_offset"))


def nearest(checkpoints: list[tuple[int, int]], target: int, by: int = 0) -> tuple[int, int]:
    """The last (line, offset) at or before a target in a sorted list; (1, 0) for an empty one."""
    import bisect

    if not checkpoints:
        return (1, 0)
    at = bisect.bisect_right([c[by] for c in checkpoints], target) - 1
    return tuple(checkpoints[max(0, at)])
