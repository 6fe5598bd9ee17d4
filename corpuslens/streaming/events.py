"""Event windows, for batches and streams alike, and searches over arriving lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from corpuslens.functions.patterns import Patterns
from corpuslens.operators.trace import trace


def _aggregates(value: str):
    return F.count("*").alias("n"), F.sum(value).alias("total")


def tumbling(events: DataFrame, size: str = "1 hour", *, ts: str = "ts", value: str = "value", by: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    """(window_start, *by, n, total) of fixed windows; ``late`` sets a stream's watermark."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.window(ts, size).alias("w"), *by).agg(*_aggregates(value))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "30 minutes", *, ts: str = "ts", value: str = "value", by: tuple[str, ...] = (), late: str | None = None) -> DataFrame:
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.window(ts, size, step).alias("w"), *by).agg(*_aggregates(value))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", *, ts: str = "ts", value: str = "value", by: str = "user_id", late: str | None = None) -> DataFrame:
    """(by, session_start, session_end, n, total); a session ends one gap after its last event."""
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), by).agg(*_aggregates(value))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def arriving_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(file, line) of text files as they appear in a folder; numbers need whole files."""
    text = spark.readStream.option("lineSep", "\n").text(folder)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def watch(lines: DataFrame, patterns: Patterns, each: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A stream writer that hands every batch's matches to ``each``, once a batch."""
    hits = trace(lines.withColumn("byte_offset", F.lit(None).cast("long")).withColumn("line_no", F.lit(None).cast("long")), patterns)
    return hits.select("pattern", "file", "line").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def count_files(batch: DataFrame) -> DataFrame:
    """(file, rows) of a batch, for per-file events."""
    return batch.groupBy("file").agg(F.count("*").alias("rows"))
