"""What the vector searches share: usable rows, query blocks, batches as arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import written

#: Queries that are held at a time, on the driver and in every task.
BLOCK = 4_096


def usable(vectors: DataFrame, vec_id: str, embedding: str, nonzero: bool) -> DataFrame:
    """(row, vec_id, embedding) of the rows that take part; ``row`` tells rows of one id apart.

    Null ids and vectors, those with null or non-finite components, and (if ``nonzero``)
    those without a component other than zero do not. A written table, so that numbers of
    rows stay the same in every pass.
    """
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine))
    if nonzero:
        rows = rows.filter(F.exists("embedding", lambda v: v != 0))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"), "vectors")


def of_length(rows: DataFrame, length: int) -> DataFrame:
    return rows.filter(F.size("embedding") == length)


def query_lengths(rows: DataFrame, condition: Column) -> list[int]:
    """The lengths of the vectors that ask; vectors of different lengths have no product."""
    return [r[0] for r in rows.filter(condition).select(F.size("embedding").alias("d")).distinct().orderBy("d").collect()]


def query_blocks(rows: DataFrame, condition: Column, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, ids, matrix) of the rows that ask, all of one length, about ``block`` at a time."""
    asked = written(rows.filter(condition).withColumn("turn", F.xxhash64("row")), "queries")
    blocks = max(1, math.ceil(asked.count() / block))
    for b in range(blocks):
        part = asked.filter(F.pmod("turn", F.lit(blocks)) == b).orderBy("vec_id", "row").collect()  # one block
        if part:
            yield np.array([r["row"] for r in part], np.int64), np.array([r["vec_id"] for r in part], np.int64), np.array([r["embedding"] for r in part], np.float64).reshape(len(part), -1)


def arrays(batch: pa.RecordBatch, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, ids and float64 matrices of up to ``rows`` rows, sorted by id, and their order."""
    for i in range(0, batch.num_rows, rows):
        part = batch.slice(i, rows)
        ids = part.column("vec_id").to_numpy()
        flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        order = np.argsort(ids, kind="stable")
        yield part.column("row").to_numpy()[order], ids[order], flat.reshape(len(ids), len(flat) // len(ids))[order], order


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query row's few found rows, with their rank from 1."""
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
