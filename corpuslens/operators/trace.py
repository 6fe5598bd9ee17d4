"""Trace: many patterns over lines in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions import spans
from corpuslens.functions.patterns import Patterns


def matching_lines(lines: DataFrame, patterns: Patterns) -> DataFrame:
    """Lines with a match of any pattern (without one, if inverted)."""
    hit = patterns.any_hit(F.col("line"))
    return lines.filter(~hit if patterns.options.invert else hit)


def owners(line: Column, patterns: Patterns) -> Column:
    """The ids of the patterns that match a line; inverted searches go to the first."""
    ids = [*patterns.ids]
    if patterns.options.invert:
        return F.array(F.lit(ids[0]))
    return F.array_compact(F.array(*(F.when(patterns.hit(line, p), F.lit(p)) for p in ids)))


def trace(lines: DataFrame, patterns: Patterns, *, with_submatches: bool = False) -> DataFrame:
    """(pattern, file, offset, line_no, line [, submatches]): a row for each line and pattern.

    One scan serves all patterns: lines without a match go first, then the rest are given
    to the patterns that match them. Nothing is shuffled. Order and limits are
    :func:`ordered`'s.
    """
    hits = matching_lines(lines, patterns)
    if len(patterns.ids) == 1:
        owned = hits.withColumn("pattern", F.lit([*patterns.ids][0]))
    else:
        owned = hits.withColumn("pattern", F.explode(owners(F.col("line"), patterns)))
    out = owned.select("pattern", "file", F.col("byte_offset").alias("offset"), "line_no", "line")
    return add_submatches(out, patterns) if with_submatches else out


def add_submatches(matches: DataFrame, patterns: Patterns) -> DataFrame:
    """Match rows with the places of their pattern's matches; none for inverted searches."""
    found = F.expr("cast(array() as array<struct<text:string,start:int,end:int>>)")
    if not patterns.options.invert:
        for p, java in patterns.java.items():
            found = F.when(F.col("pattern") == p, spans.submatches(F.col("line"), java)).otherwise(found)
    return matches.withColumn("submatches", found)


def ordered(matches: DataFrame, patterns: Patterns | None = None, max_results: int | None = None) -> DataFrame:
    """By file, offset and pattern (p2 before p10), and the first ``max_results`` of these."""
    turn = F.substring("pattern", 2, 9).cast("int")
    out = matches.orderBy("file", "offset", turn)
    limit = max_results if max_results is not None else patterns.options.max_results if patterns else None
    return out if limit is None else out.limit(limit)


def occurrences(lines: DataFrame, patterns: Patterns) -> DataFrame:
    """(pattern, file, offset, text): a row for each match, at its own byte offset."""
    rows = trace(lines, patterns, with_submatches=True)
    each = rows.select("pattern", "file", "offset", F.explode("submatches").alias("s"))
    return each.select("pattern", "file", (F.col("offset") + F.col("s.start")).alias("offset"), F.col("s.text").alias("text"))


def file_ids(files: DataFrame) -> DataFrame:
    """(file, file_id f1, f2, ...) in the order of names; one window over the listing."""
    from pyspark.sql.window import Window

    number = F.row_number().over(Window.orderBy("file"))
    return files.select("file").distinct().withColumn("file_id", F.concat(F.lit("f"), number.cast("string")))


def counts(matches: DataFrame) -> DataFrame:
    """(file, lines, rows): matched lines and match rows of each file."""
    return matches.groupBy("file").agg(F.countDistinct("offset").alias("lines"), F.count("*").alias("rows"))


#: Schema of scanner events as JSON; malformed events become null.
EVENT = "type string, data struct<path:struct<text:string>, lines:struct<text:string>, line_number:bigint, absolute_offset:bigint, submatches:array<struct<match:struct<text:string>,start:int,end:int>>>"


def scanner_events(raw: DataFrame, column: str = "value") -> DataFrame:
    """(type, file, line_no, offset, line, submatches) from JSON events of a line scanner."""
    e = F.from_json(F.col(column), EVENT)
    parsed = raw.select(e.alias("e")).filter("e.type IS NOT NULL")
    found = F.transform("e.data.submatches", lambda s: F.struct(s["match"]["text"].alias("text"), s["start"].alias("start"), s["end"].alias("end")))
    return parsed.select(F.col("e.type").alias("type"), F.col("e.data.path.text").alias("file"), F.col("e.data.line_number").alias("line_no"), F.col("e.data.absolute_offset").alias("offset"), F.rtrim(F.col("e.data.lines.text"), F.lit("\n")).alias("line"), found.alias("submatches"))


def to_scanner_events(matches: DataFrame) -> DataFrame:
    """Matches with submatches as JSON events."""
    subs = F.transform("submatches", lambda s: F.struct(F.struct(s["text"].alias("text")).alias("match"), s["start"].alias("start"), s["end"].alias("end")))
    data = F.struct(F.struct(F.col("file").cast("string").alias("text")).alias("path"), F.struct(F.concat("line", F.lit("\n")).alias("text")).alias("lines"), F.col("line_no").alias("line_number"), F.col("offset").alias("absolute_offset"), subs.alias("submatches"))
    return matches.select(F.to_json(F.struct(F.lit("match").alias("type"), data.alias("data"))).alias("value"))
