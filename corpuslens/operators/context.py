"""Context: the lines around a match or a requested place.

Two forms give the same rows. The window form keeps a file's neighbouring lines beside
each line and suits searches that hit many lines. The join form spreads each match over
the line numbers that it needs and joins these by equality, which suits few matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_window(lines: DataFrame, matches: DataFrame, before: int, after: int) -> DataFrame:
    """(pattern, file, offset, line_no, context_no, context_offset, context) in file windows."""
    around = Window.partitionBy("file").orderBy("line_no").rowsBetween(-before, after)
    near = lines.withColumn("near", F.collect_list(F.struct(F.col("line_no").alias("context_no"), F.col("byte_offset").alias("context_offset"), F.col("line").alias("context"))).over(around))
    keyed = matches.select("pattern", F.col("file").alias("f"), "offset")
    hit = near.join(keyed, (F.col("file") == F.col("f")) & (F.col("byte_offset") == F.col("offset")))
    return hit.select("pattern", "file", "offset", "line_no", F.explode("near").alias("x")).select("pattern", "file", "offset", "line_no", "x.*")


def by_join(lines: DataFrame, matches: DataFrame, before: int, after: int) -> DataFrame:
    """The same rows by an equality join on file and line number."""
    wanted = matches.select("pattern", F.col("file").alias("f"), "offset", F.col("line_no").alias("at"), F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("line_no") - before), F.col("line_no") + after)).alias("want"))
    near = lines.select("file", F.col("line_no").alias("context_no"), F.col("byte_offset").alias("context_offset"), F.col("line").alias("context"))
    both = wanted.join(near, (F.col("f") == F.col("file")) & (F.col("want") == F.col("context_no")))
    return both.select("pattern", "file", "offset", F.col("at").alias("line_no"), "context_no", "context_offset", "context")


def context(lines: DataFrame, matches: DataFrame, before: int = 3, after: int = 3, *, dense: bool = False) -> DataFrame:
    return (by_window if dense else by_join)(lines, matches, before, after)


def groups(rows: DataFrame) -> DataFrame:
    """(key pattern:file:offset, lines): each match's context lines in order, as one array."""
    key = F.concat_ws(":", "pattern", F.col("file").cast("string"), F.col("offset").cast("string"))
    line = F.struct(F.col("context_no").alias("line_no"), F.col("context_offset").alias("offset"), F.col("context").alias("line"))
    return rows.groupBy(key.alias("key")).agg(F.sort_array(F.collect_list(line)).alias("lines"))


def merged(rows: DataFrame) -> DataFrame:
    """(file, line_no, line, hit): every context line once, matched lines marked."""
    return rows.groupBy("file", F.col("context_no").alias("line_no")).agg(F.first("context").alias("line"), F.max(F.col("context_no") == F.col("line_no")).alias("hit"))
