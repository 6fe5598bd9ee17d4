"""Side tables of files: indexes, frames and whole lines, valid while a file is unchanged."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SideTables:
    """Tables under a folder, one for each kind and file, with the file's size and time."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def where(self, kind: str, path: str) -> str:
        return f"{self.folder}/{kind}/{hashlib.sha256(path.encode()).hexdigest()[:16]}"

    def save(self, kind: str, path: str, rows: DataFrame) -> str:
        stat = os.stat(path)
        target = self.where(kind, path)
        stamped = rows.withColumn("source_path", F.lit(path)).withColumn("source_size", F.lit(stat.st_size)).withColumn("source_mtime", F.lit(stat.st_mtime))
        stamped.write.mode("overwrite").parquet(target)
        return target

    def load(self, kind: str, path: str) -> DataFrame | None:
        """The table if it was saved for the file's present size and time."""
        rows = self._read(self.where(kind, path))
        if rows is None or not os.path.exists(path):
            return None
        stat = os.stat(path)
        valid = rows.filter((F.col("source_size") == stat.st_size) & (F.col("source_mtime") == stat.st_mtime))
        return valid.drop("source_path", "source_size", "source_mtime") if valid.limit(1).count() else None

    def get_or_build(self, kind: str, path: str, build) -> DataFrame:
        found = self.load(kind, path)
        if found is None:
            self.save(kind, path, build())
            found = self.load(kind, path)
        return found

    def info(self, kind: str, path: str) -> dict | None:
        rows = self._read(self.where(kind, path))
        if rows is None:
            return None
        first = rows.select("source_path", "source_size", "source_mtime").first()
        return {"path": self.where(kind, path), "rows": rows.count(), "valid": self.load(kind, path) is not None, **(first.asDict() if first else {})}

    def delete(self, kind: str, path: str) -> bool:
        return self._remove(self.where(kind, path))

    def listing(self, kind: str) -> list[str]:
        """The files that have a table of a kind."""
        try:
            rows = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.folder}/{kind}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted(r["source_path"] for r in rows.select("source_path").distinct().collect())

    def clear(self, kind: str) -> bool:
        return self._remove(f"{self.folder}/{kind}")

    def _read(self, target: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(target)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def _remove(self, target: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(target)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return bool(fs.exists(path) and fs.delete(path, True))


class LineStore:
    """Lines as Parquet, dealt by file and sorted by line number inside.

    A lookup of some lines then reads the row groups whose bounds hold them; in raw text
    there is nothing to skip by. ``buckets`` folders keep many small files together.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _bucket(self, file: Column) -> Column:
        return F.pmod(F.xxhash64(file), F.lit(self.buckets)).cast("int")

    def save(self, lines: DataFrame) -> None:
        placed = lines.withColumn("bucket", self._bucket(F.col("file")))
        ranged = placed.repartitionByRange("bucket", "file", "line_no").sortWithinPartitions("bucket", "file", "line_no")
        ranged.write.mode("append").partitionBy("bucket").parquet(self.folder)

    def lines(self) -> DataFrame:
        return self.spark.read.parquet(self.folder).drop("bucket")

    def between(self, file: str, low: int, high: int) -> DataFrame:
        """Lines low to high of a file: one bucket, and the row groups that hold them."""
        rows = self.spark.read.parquet(self.folder)
        bucket = self.spark.range(1).select(self._bucket(F.lit(file)).alias("b")).first()["b"]
        return rows.filter((F.col("bucket") == bucket) & (F.col("file") == file) & F.col("line_no").between(low, high)).drop("bucket")
