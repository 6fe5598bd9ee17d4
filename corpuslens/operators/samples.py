"""Samples: lines at requested line numbers or byte offsets, with context.

Requests are a table (file, value). A request that names no line gives an empty list, not
an error. All joins carry the file as an equality key, and with it the line or the cell of
bytes, so that one large file is many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.scalars import cells, strip_line_end

#: Bytes of a cell of offsets.
CELL = 1 << 16


def line_to_offset(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """(file, value, offset): the byte offset of each requested line, -1 without one."""
    r = requests.select(F.col("file").alias("f"), F.col("value").cast("long").alias("value")).distinct()
    found = r.join(lines.select("file", "line_no", "byte_offset"), (F.col("f") == F.col("file")) & (F.col("value") == F.col("line_no")), "left")
    return found.select(F.col("f").alias("file"), "value", F.coalesce("byte_offset", F.lit(-1).cast("long")).alias("offset"))


def offset_to_line(lines: DataFrame, requests: DataFrame) -> DataFrame:
    """(file, value, line_no): the line that holds each requested byte offset, -1 without one."""
    r = requests.select(F.col("file").alias("f"), F.col("value").cast("long").alias("value")).distinct()
    inside = (F.col("value") >= F.col("byte_offset")) & (F.col("value") <= F.col("byte_offset") + F.col("n_bytes"))
    places = lines.select("file", "line_no", "byte_offset", "n_bytes", F.explode(cells(F.col("byte_offset"), F.col("byte_offset") + F.col("n_bytes"), CELL)).alias("cell"))
    same = (F.col("f") == F.col("file")) & (F.floor(F.col("value") / CELL) == F.col("cell"))
    found = r.join(places, same & inside, "left")
    return found.select(F.col("f").alias("file"), "value", F.coalesce("line_no", F.lit(-1).cast("long")).alias("line_no"))


def by_line(lines: DataFrame, requests: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """(file, value, lines): the requested lines with their context, clipped to the file."""
    r = requests.select(F.col("file").alias("f"), F.col("value").cast("long").alias("value")).distinct()
    known = r.join(lines.select("file", "line_no"), (F.col("f") == F.col("file")) & (F.col("value") == F.col("line_no")), "left_semi")
    wanted = known.select("f", "value", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("value") - before), F.col("value") + after)).alias("want"))
    found = wanted.join(lines.select("file", "line_no", "line"), (F.col("f") == F.col("file")) & (F.col("want") == F.col("line_no")))
    packed = found.groupBy("f", "value").agg(F.sort_array(F.collect_list(F.struct("line_no", strip_line_end(F.col("line")).alias("line")))).alias("rows"))
    all_of = r.join(packed.select(F.col("f").alias("g"), F.col("value").alias("v"), "rows"), (F.col("f") == F.col("g")) & (F.col("value") == F.col("v")), "left")
    texts = F.transform("rows", lambda x: x["line"])
    return all_of.select(F.col("f").alias("file"), "value", F.coalesce(texts, F.expr("cast(array() as array<string>)")).alias("lines"))


def by_offset(lines: DataFrame, requests: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """(file, value, line_no, lines): the same for byte offsets."""
    at = offset_to_line(lines, requests)
    asked = at.select("file", F.col("line_no").alias("value"))
    found = by_line(lines, asked, before, after).select(F.col("file").alias("g"), F.col("value").alias("v"), "lines")
    both = at.join(found, (F.col("file") == F.col("g")) & (F.col("line_no") == F.col("v")), "left")
    return both.select("file", "value", "line_no", F.coalesce("lines", F.expr("cast(array() as array<string>)")).alias("lines"))


def between(lines: DataFrame, file: str, start: int, count: int) -> DataFrame:
    """``count`` lines of a file from line ``start`` on, in order."""
    inside = (F.col("file") == file) & F.col("line_no").between(max(1, start), start + count - 1)
    return lines.filter(inside).select("line_no", "line").orderBy("line_no")
