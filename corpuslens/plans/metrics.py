"""Metrics as aggregates: cumulative histograms, counters, observations of a running query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Upper bounds of the histograms' buckets, in seconds, bytes or counts.
BUCKETS = {
    "trace_seconds": (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0),
    "samples_seconds": (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0),
    "complexity_seconds": (0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0),
    "analyse_seconds": (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0),
    "patterns_per_request": (1, 2, 3, 5, 10, 20, 50, 100),
    "matches_per_request": (0, 1, 5, 10, 50, 100, 500, 1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000),
    "complexity_score": (1, 5, 10, 20, 30, 50, 60, 80, 100, 150, 200, 300, 500, 1_000),
    "parallel_tasks": (1, 2, 4, 8, 12, 16, 20, 24, 32, 48, 64, 100, 200),
}


def histogram(rows: DataFrame, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """(le, n): how many values are at most each bound, cumulative, +Inf last.

    Values are counted in disjoint buckets first; the running sum is over one row a bound.
    """
    totals = rows.agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(value).alias("rest"))
    pairs = F.array(*(F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("rest").alias("n")))
    return totals.select(F.explode(pairs).alias("x")).select("x.le", "x.n")


def counters(rows: DataFrame, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count("*").alias("n"))


def observed(rows: DataFrame, **aggregates: Column) -> tuple[DataFrame, Observation]:
    """``rows`` whose next action also fills an observation, without another pass."""
    seen = Observation("corpuslens")
    return rows.observe(seen, *(c.alias(k) for k, c in aggregates.items())), seen


def scan_totals(matches: DataFrame, files: DataFrame) -> DataFrame:
    """(files, bytes, matches, files_with_matches) of a search."""
    hit = matches.agg(F.count("*").alias("matches"), F.countDistinct("file").alias("files_with_matches"))
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).crossJoin(F.broadcast(hit))
