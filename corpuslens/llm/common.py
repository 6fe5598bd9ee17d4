"""What the operators of this subpackage share: the shared folder, tables, chunks."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and Spark runs in one process (as in tests) is a
    temporary folder used in its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="corpuslens-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter does
        pass


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what it holds is removed when Python exits."""
    path = f"{shared_dir(spark)}/corpuslens-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path.rpartition("/")[0])
    return path


#: Whether Spark removes an execution's shuffle files when it has ended, or whenever the
#: driver collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, kept if executors are lost.
    The shuffle files it took are removed.

    ``by`` is a last column whose values, never null, become folders.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than this part of all rows is hot; there are at most as many hot keys.
HOT_PART = 1_000


def spread_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``rows`` with the ``values`` of ``table`` (keys, values, k) for their keys, or nulls.

    ``table`` has each key once, with the number k of rows that it had when counted. The
    keys that hold more than a ``HOT_PART``-th of all rows, fewer than ``HOT_PART``, are
    broadcast, so no task gets all rows of a hot key; only the others are shuffled.
    ``table`` is read three times: give a written one.
    """
    total = table.agg(F.sum("k")).first()[0] or 0
    hot = F.broadcast(table.filter(F.col("k") * HOT_PART > total).select(*keys, *values))
    cold = table.filter(F.col("k") * HOT_PART <= total).select(*keys, *values)
    return rows.join(hot, [*keys], "inner").unionByName(rows.join(hot.select(*keys), [*keys], "left_anti").join(cold, [*keys], "left"))


def give_back() -> None:
    """Memory that Arrow and the C library keep without use goes back to the system.

    Without it a worker holds the holes between blocks still in use: the library by itself
    returns the end of its heap only. Where it has no such call, nothing is done.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def spare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches. What is kept without use of those before goes back to the system."""
    for batch in batches:
        yield batch
        give_back()
    del batches
    give_back()


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def light(run: Run) -> Run:
    """``run``, which leaves its worker light: Python workers stay for later tasks, more of
    them than run at once where a task has several functions, and each kept its largest task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(spare(batches))
        give_back()  # the run's own tables are gone

    return of


def chunks(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to ``most`` or little more; a large row is alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
