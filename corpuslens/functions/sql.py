"""Functions for SQL: lines of a text as a table, and a pattern's complexity."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpuslens.functions import complexity


class TextLines:
    """text_lines(text): (line_no, byte_offset, line) of a text."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        at = 0
        for i, line in enumerate(text.removesuffix("\n").split("\n") if text else (), 1):
            yield i, at, line
            at += len(line.encode()) + 1


def register(spark: SparkSession) -> None:
    """Make ``text_lines`` and ``pattern_is_dangerous`` known to SQL."""
    spark.udtf.register("text_lines", F.udtf(TextLines, returnType="line_no: int, byte_offset: long, line: string"))
    spark.udf.register("pattern_is_dangerous", lambda p: None if p is None else complexity.dangerous(p), "boolean")
