"""Running sums and maxima over arrays, in column expressions.

A fold that appends to an array copies it at every step. Here only blocks of values are
folded that way, and the totals of the blocks are run the same way (``levels`` times): of
a million values some 10**9 references are copied with one level, and 10**8 with two. More
levels make plans that take longer to resolve.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many values are one block.
STEP = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(values: Column, first: Column, add: Callable[[Column, Column], Column]) -> Column:
    empty = F.struct(first.alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    step = lambda acc, v: F.struct(add(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, empty, step, lambda acc: acc["out"])


def _running(values: Column, first: Column, add: Callable[[Column, Column], Column], levels: int) -> Column:
    def blocked(v: Column) -> Column:
        step = F.lit(STEP) if levels > 1 else F.ceil(F.sqrt(F.size(v))).cast("int")
        starts = F.sequence(F.lit(1), F.size(v), step)
        totals = F.transform(starts, lambda i: F.aggregate(F.slice(v, i, step), first, add))
        before = _running(totals, first, add, levels - 1) if levels > 1 else _fold(totals, first, add)
        return F.flatten(F.zip_with(starts, before, lambda i, b: _fold(F.slice(v, i, step), b, add)))

    return let(values, lambda v: F.when(F.size(v) <= STEP, _fold(v, first, add)).otherwise(blocked(v)))


def sums_before(values: Column, levels: int = 1) -> Column:
    """For each of the numbers the sum of those before it, as longs."""
    return _running(values, F.lit(0).cast("long"), lambda a, v: a + v, levels)


def most_before(values: Column, least: int = -1, levels: int = 1) -> Column:
    """For each of the numbers the largest before it, ``least`` if there is none larger."""
    return _running(values, F.lit(least).cast("long"), lambda a, v: F.greatest(a, F.coalesce(v, F.lit(least))), levels)


PART = 4_096


def parts_of(text: Column) -> Column:
    """A text as an array of parts of ``PART`` characters, for :func:`cut`."""
    return F.when(F.length(text) <= PART, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0)))


def cut(parts: Column, start: Column, length: Column) -> Column:
    """``length`` characters from ``start`` (from 0) on, without going over the text before."""
    first = F.floor(start / PART).cast("int")
    count = F.floor((start + length) / PART).cast("int") - first + 1
    return F.substring(F.array_join(F.slice(parts, first + 1, F.greatest(F.lit(1), count)), ""), (start - first * PART + 1).cast("int"), F.greatest(F.lit(0), length).cast("int"))
