"""Caches of results as side tables, valid while their files are unchanged.

A trace cache keeps (file, size, modified_at, patterns_hash, pattern, offset, line_no
[, frame]); texts are looked up again when it is used. Sources whose size or time differ
from the cached ones are read afresh. Patterns keep their own text in the cache, so the
order in which a search names them does not matter.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.options import EngineOptions, SearchOptions


def patterns_hash(patterns: list[str], options: SearchOptions = SearchOptions()) -> str:
    body = json.dumps({"patterns": sorted(patterns), "flags": options.cache_key()}, sort_keys=True)
    return hashlib.sha256(body.encode()).hexdigest()[:16]


class TraceCache:
    """A Parquet table partitioned by patterns_hash under a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, key: str) -> str:
        return f"{self.folder}/trace/patterns_hash={key}"

    def save(self, matches: DataFrame, files: DataFrame, patterns: dict[str, str], options: SearchOptions = SearchOptions()) -> None:
        """Append the complete matches of ``files`` (path, size, modified_at), empty ones too."""
        texts = F.create_map(*(F.lit(x) for kv in patterns.items() for x in kv))
        rows = matches.select("file", F.element_at(texts, F.col("pattern")).alias("pattern"), "offset", "line_no")
        kept = files.select(F.col("path").alias("f"), "size", "modified_at")
        out = kept.join(rows, F.col("f") == F.col("file"), "left").select(F.col("f").alias("file"), "size", "modified_at", "pattern", "offset", "line_no")
        out.write.mode("append").parquet(self._path(patterns_hash([*patterns.values()], options)))

    def load(self, patterns: dict[str, str], options: SearchOptions = SearchOptions()) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._path(patterns_hash([*patterns.values()], options)))
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    @staticmethod
    def split(cached: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(cached rows of unchanged files, files that must be read)."""
        now = files.select(F.col("path").alias("p"), F.col("size").alias("s"), F.col("modified_at").alias("t"))
        same = (F.col("file") == F.col("p")) & (F.col("size") == F.col("s")) & (F.col("modified_at") == F.col("t"))
        served = cached.join(now, same, "left_semi")
        known = served.select(F.col("file").alias("k")).distinct()
        return served.filter("pattern IS NOT NULL"), files.join(known, F.col("path") == F.col("k"), "left_anti")

    @staticmethod
    def rehydrate(served: DataFrame, lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
        """Match rows with their texts, by an equality join on file and line number."""
        ids = F.create_map(*(F.lit(x) for k, v in patterns.items() for x in (v, k)))
        keyed = served.select(F.element_at(ids, F.col("pattern")).alias("pattern"), F.col("file").alias("f"), "offset", F.col("line_no").alias("at"))
        both = keyed.join(lines.select("file", "line_no", "line"), (F.col("f") == F.col("file")) & (F.col("at") == F.col("line_no")))
        return both.select("pattern", "file", "offset", "line_no", "line")

    def info(self, patterns: dict[str, str], options: SearchOptions = SearchOptions()) -> DataFrame | None:
        """(file, matches, patterns) of what is cached."""
        rows = self.load(patterns, options)
        return None if rows is None else rows.groupBy("file").agg(F.count("pattern").alias("matches"), F.sort_array(F.collect_set("pattern")).alias("patterns"))


class ProfileCache:
    """Profiles by path hash, valid while size and time are those of the file."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.path = spark, f"{folder.rstrip('/')}/profiles"

    def save(self, profiles: DataFrame) -> None:
        """Append ``profiles``: path, size, modified_at and any further columns."""
        profiles.withColumn("path_hash", F.substring(F.sha2("path", 256), 1, 16)).write.mode("append").parquet(self.path)

    def load(self, files: DataFrame) -> DataFrame | None:
        try:
            rows = self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        now = files.select(F.col("path").alias("p"), F.col("size").alias("s"), F.col("modified_at").alias("t"))
        same = (F.col("path") == F.col("p")) & (F.col("size") == F.col("s")) & (F.col("modified_at") == F.col("t"))
        return rows.join(now, same, "left_semi").dropDuplicates(["path_hash"])


def frames_with_matches(cached: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames that hold cached matches, the only ones that need decoding."""
    inside = (F.col("offset") >= F.col("decoded_offset")) & (F.col("offset") < F.col("decoded_offset") + F.col("decoded_size"))
    places = cached.select(F.col("file").alias("f"), "offset").distinct()
    return frames.join(places, (F.col("f") == F.col("file")) & inside, "left_semi")


def clear(spark: SparkSession, folder: str) -> bool:
    """Remove a cache folder; whether there was one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(path) and fs.delete(path, True))


def default_folder(options: EngineOptions = EngineOptions()) -> str:
    return options.cache_dir
