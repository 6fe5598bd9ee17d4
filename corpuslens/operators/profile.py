"""Profiles: one row of line statistics for each file, from one aggregation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.scalars import blank, human_size


def _zero(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(0.0))


def statistics(length: Column, is_blank: Column, sample_deviation: bool) -> dict[str, Column]:
    """Counts of lines and the distribution of the lengths of those that are not blank."""
    of = F.when(~is_blank, length)
    spread = F.stddev_samp(of) if sample_deviation else F.stddev_pop(of)
    return {
        "line_count": F.count("*"),
        "empty_line_count": F.count_if(is_blank),
        "line_length_max": F.coalesce(F.max(of), F.lit(0)).cast("long"),
        "line_length_avg": _zero(F.avg(of)),
        "line_length_median": _zero(F.percentile(of, F.lit(0.5))),
        "line_length_p95": _zero(F.percentile(of, F.lit(0.95))),
        "line_length_p99": _zero(F.percentile(of, F.lit(0.99))),
        "line_length_stddev": _zero(spread),
    }


def longest(length: Column, is_blank: Column) -> Column:
    """struct<line_no, byte_offset> of the first of the longest lines that are not blank."""
    return F.max_by(F.struct("line_no", "byte_offset"), F.when(~is_blank, F.struct(length, -F.col("line_no"))))


def profile(lines: DataFrame, **custom: Column) -> DataFrame:
    """A row for each file: counts, lengths in characters, the longest line, sizes.

    ``custom`` are further aggregates over the lines, by name.
    """
    size, is_blank = F.length("line"), blank(F.col("line"))
    stats = statistics(size, is_blank, sample_deviation=False)
    aggregates = [c.alias(k) for k, c in {**stats, **custom}.items()]
    out = lines.groupBy("file").agg(*aggregates, longest(size, is_blank).alias("top"), F.sum(F.col("n_bytes") + 1).cast("long").alias("line_bytes"))
    return out.withColumn("line_length_max_line_number", F.col("top.line_no")).withColumn("line_length_max_byte_offset", F.col("top.byte_offset")).drop("top")


def index_statistics(lines: DataFrame) -> DataFrame:
    """The statistics that an index keeps: lengths in bytes, the sample deviation."""
    return lines.groupBy("file").agg(*(c.alias(k) for k, c in statistics(F.col("n_bytes"), blank(F.col("line")), sample_deviation=True).items()))


def line_ending(text: Column) -> Column:
    """LF, CRLF, CR or mixed, by the line ends of a text; LF without any."""
    crlf = F.regexp_count(text, F.lit("\r\n")) > 0
    cr = F.regexp_count(text, F.lit("\r(?!\n)")) > 0
    lf = F.regexp_count(text, F.lit("(?<!\r)\n")) > 0
    kinds = crlf.cast("int") + cr.cast("int") + lf.cast("int")
    return F.when(kinds > 1, "mixed").when(crlf, "CRLF").when(cr, "CR").otherwise("LF")


def ending_of_lines(lines: DataFrame) -> DataFrame:
    """(file, line_ending) from lines, which keep their ``\\r``.

    Lines end in ``\\n``; whether a file's last one does, lines do not say, so it is taken
    to.
    """
    crlf, cr = F.endswith(F.col("line"), F.lit("\r")), F.rlike(F.col("line"), F.lit("\r(?!$)"))
    kinds = lines.groupBy("file").agg(F.max(crlf).alias("a"), F.max(cr).alias("b"), F.max(~crlf).alias("c"))
    many = F.col("a").cast("int") + F.col("b").cast("int") + F.col("c").cast("int") > 1
    return kinds.select("file", F.when(many, "mixed").when(F.col("a"), "CRLF").when(F.col("b"), "CR").otherwise("LF").alias("line_ending"))


def with_files(profiles: DataFrame, files: DataFrame) -> DataFrame:
    """Profiles beside file metadata; files without lines get zeros."""
    joined = files.join(profiles.withColumnRenamed("file", "__f"), F.col("path") == F.col("__f"), "left").drop("__f")
    zeros = {c: 0 for c, t in profiles.dtypes if t in ("bigint", "double") and not c.startswith("line_length_max_")}
    return joined.fillna(zeros, subset=[*zeros]).withColumn("size_human", human_size(F.col("size")))


def newlines(text: Column) -> Column:
    """How many line ends a text holds."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("long")


def with_line_hook(lines: DataFrame, hook: Callable, schema: str) -> DataFrame:
    """A user's per-file accumulation: ``hook`` maps a file's lines (pandas) to rows."""
    return lines.groupBy("file").applyInPandas(hook, schema)
