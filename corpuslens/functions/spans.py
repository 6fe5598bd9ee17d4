"""Matches of a pattern in a line with their places, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions import arrays

def submatches(line: Column, java: str) -> Column:
    """Non-overlapping matches as array<struct<text, start, end>>, in bytes of the line.

    The line is split at its matches; running sums over the gaps and matches give the
    places. Matches without text are not listed.
    """
    both = F.zip_with(F.split(line, java, -1), F.regexp_extract_all(line, F.lit(java), F.lit(0)), lambda gap, hit: F.struct(F.coalesce(F.octet_length(gap), F.lit(0)).alias("gap"), hit.alias("hit")))

    def placed(parts: Column) -> Column:
        before = arrays.sums_before(F.transform(parts, lambda x: x["gap"] + F.coalesce(F.octet_length(x["hit"]), F.lit(0))))
        at = lambda x, b: (b + x["gap"]).cast("int")
        found = F.zip_with(parts, before, lambda x, b: F.struct(x["hit"].alias("text"), at(x, b).alias("start"), (at(x, b) + F.octet_length(x["hit"])).alias("end")))
        return F.filter(found, lambda s: F.length(s["text"]) > 0)

    return arrays.let(both, placed)


def absolute(offset: Column, found: Column) -> Column:
    """Byte offsets of submatches in the file."""
    return F.transform(found, lambda s: offset + s["start"])


def highlight(line: Column, java: str, start: str = "\x1b[91m", end: str = "\x1b[0m") -> Column:
    """The line with each match between two marks."""
    return F.regexp_replace(line, F.lit(f"({java})"), F.lit(f"{start}$1{end}"))
