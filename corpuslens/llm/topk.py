"""Exact top-k search by distributed histogram selection.

Every row is scored against a block of queries. Instead of sorting, each pass counts the
scores in equal bins of every query's current range; in the summed histograms a running
sum finds the bin with the k-th highest score, which becomes the next range, until the
range is one value. Rows above that value are results. Where more rows than are needed
hold the value itself, the same refinement over ids finds the smallest ids among them. A
last pass filters, and each query's few rows are ranked, ties to the smaller id.

A task reports only its bins down to its own k-th score (the global one is not below it)
and at most k rows, so neither grows with the rows of a task; histograms are summed and
cut by the executors, and the driver gets one row a query.

Vectors are turned into whole numbers, floor(scale * x), without a limit; scores are exact
inner products. Where products could pass 64 bits they are taken modulo 2**64, which is
exact for every score that a long can hold; the few pairs that may not fit are worked out
in whole numbers of any size, and those that do not count as the nearest long.

Defined results: rows that :func:`corpuslens.llm.vectors.usable` leaves out take no part;
every row that asks is a query of its own, also where rows share an id, and only the row
itself is not its candidate; vectors of another length are no candidates, as they have no
inner product; repeated rows are separate candidates; fewer than k candidates are all
returned; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslens.llm.common import written
from corpuslens.llm.vectors import BLOCK, arrays, of_length, query_blocks, query_lengths, ranked, usable

BINS = 1_024
ROWS = 2_048
#: Ties that may be passed on to the ranking of a query.
TIES = 64
FOUND = "query long, query_id long, vec_id long, score long"
TOP = 2**63 - 1


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as floats that hold whole numbers."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(scale * x))


def _modulo(x: np.ndarray) -> np.ndarray:
    """Whole numbers modulo 2**64."""
    size = np.fmod(np.abs(x), 2.0**64).astype(np.uint64)
    return np.where(x < 0, np.uint64(0) - size, size)


def _product(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, in floating point where that is exact."""
    with np.errstate(over="ignore", invalid="ignore"):
        bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * rows.shape[1]
        if bound < 2**53:
            return (queries @ rows.T).astype(np.int64)
        out = (_modulo(queries) @ _modulo(rows).T).view(np.int64)
        if bound < 2**62:
            return out
        unsure = ~(np.abs(queries) @ np.abs(rows).T < 2.0**62)
    for i, j in np.argwhere(unsure):
        exact = sum(int(a) * int(b) for a, b in zip(queries[i].tolist(), rows[j].tolist(), strict=True))
        out[i, j] = max(-TOP, min(TOP, exact))
    return out


def _place(x: np.ndarray) -> np.ndarray:
    """Longs as unsigned numbers in the same order, whose differences do not overflow."""
    return np.asarray(x, np.int64).view(np.uint64) ^ np.uint64(1 << 63)


class Scan:
    """One pass: the scores of a batch's rows for each query, own rows masked out."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, scale: float) -> None:
        self.rows, self.ids, self.queries, self.scale = rows, ids, whole(queries, scale), scale

    def scores(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for rows, ids, matrix, _ in arrays(batch, ROWS):
                yield ids, _product(self.queries, whole(matrix, self.scale)), self.rows[:, None] != rows


HISTOGRAM = "query int, bin int, n long, need long"


def _histograms(scan: Scan, low: np.ndarray, width: np.ndarray, need: np.ndarray, k: int, ids_at: np.ndarray | None = None):
    """(query, bin, n, need): counts of scores in bins from ``low``; the highest bin is open.

    With ``ids_at`` the counts are of ids of rows with exactly that score, smallest first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = len(low)
        total = np.zeros(q * (BINS + 1), np.int64)
        for ids, scores, other in scan.scores(batches):
            if ids_at is None:
                value, fit = _place(scores), other
            else:
                value, fit = np.broadcast_to(_place(ids), scores.shape), other & (scores == ids_at[:, None])
            fit = fit & (value >= low[:, None])
            at = np.minimum((value - low[:, None]) // width[:, None], np.uint64(BINS)).astype(np.int64) + np.arange(q)[:, None] * (BINS + 1)
            total += np.bincount(at[fit], minlength=len(total))
        table = total.reshape(q, BINS + 1)
        ordered = table[:, ::-1] if ids_at is None else table
        before = np.cumsum(ordered, axis=1) - ordered
        row, place = np.nonzero((before < k) & (ordered > 0))
        yield pa.record_batch([row.astype(np.int32), (BINS - place if ids_at is None else place).astype(np.int32), ordered[row, place], need[row]], names=["query", "bin", "n", "need"])

    return run


def _cuts(rows: DataFrame, run, q: int, downwards: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the bin in which the running sum reaches what is needed (else the last
    that holds any), the sum before it, and its count."""
    counted = rows.mapInArrow(run, HISTOGRAM).groupBy("query", "bin").agg(F.sum("n").alias("n"), F.first("need").alias("need"))
    order = Window.partitionBy("query").orderBy(F.desc("bin") if downwards else F.asc("bin"))  # BINS + 1 rows at most
    upto = counted.withColumn("upto", F.sum("n").over(order)).filter("upto - n < need")
    last = upto.groupBy("query").agg(F.max("upto").alias("upto"), F.max_by("bin", "upto").alias("bin"), F.max_by("n", "upto").alias("n"))
    out = np.zeros((3, q), np.int64)
    for r in last.collect():  # one row a query of a block
        out[:, r["query"]] = r["bin"], r["upto"] - r["n"], r["n"]
    return out[0].astype(np.uint64), out[1], out[2]


def _thresholds(rows: DataFrame, scan: Scan, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k-th highest score, and the largest id that is taken among its ties."""
    q = len(scan.rows)
    peak = rows.select(F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))).alias("s")).agg(F.max("s")).first()[0] or 0.0
    with np.errstate(over="ignore"):
        reach = np.abs(scan.queries).sum(axis=1) * (peak * scan.scale + 1) + 1
    reach = np.array([int(r) if r < 2.0**62 else TOP for r in reach.tolist()], np.int64)
    low, high, need = _place(-reach), _place(reach), np.full(q, k)
    one, short, left, ties = np.uint64(1), np.zeros(q, bool), need, np.zeros(q, np.int64)
    first = True
    while first or (high > low)[~short].any():
        width = (high - low) // np.uint64(BINS) + one
        at, above, ties = _cuts(rows, _histograms(scan, low, width, need, k), q, True)
        if first:
            short = above + ties < k  # all candidates are results
        left = k - above
        low = np.where(short, low, low + at * width)
        high = np.where(short, low, np.minimum(high, low + (width - one)))
        first = False
    worst = np.where(short, -TOP - 1, (low ^ np.uint64(1 << 63)).view(np.int64))
    most = np.full(q, TOP)
    wide = ~short & (ties > np.maximum(left, TIES))
    if wide.any():
        span = rows.agg(F.min("vec_id"), F.max("vec_id")).first()
        near, far, need = np.full(q, _place(span[0])), np.full(q, _place(span[1])), left.copy()
        impossible = np.where(wide, worst, -TOP - 1)
        while (wide & (far > near)).any():
            width = (far - near) // np.uint64(BINS) + one
            at, before, _ = _cuts(rows, _histograms(scan, near, width, need, k, impossible), q, False)
            near = np.where(wide, near + at * width, near)
            far = np.where(wide, np.minimum(far, near + (width - one)), far)
            need = np.where(wide, need - before, need)
        most = np.where(wide, (far ^ np.uint64(1 << 63)).view(np.int64), most)
    return worst, most


def _filtered(scan: Scan, worst: np.ndarray, most: np.ndarray, short: int):
    """Rows up to the thresholds, the first ``short`` of a query in each slice of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, scores, other in scan.scores(batches):
            fit = other & ((scores > worst[:, None]) | (scores == worst[:, None]) & (ids <= most[:, None]))
            many = np.flatnonzero(fit.sum(axis=1) > short)
            for i in many:
                at = np.flatnonzero(fit[i])
                fit[i, at[np.lexsort((ids[at], ~scores[i, at]))[short:]]] = False
            row, at = np.nonzero(fit)
            yield pa.record_batch([scan.rows[row], scan.ids[row], ids[at], scores[row, at]], names=["query", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: Column, *, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores for the rows where ``queries``.

    ``queries`` is a condition on the columns vec_id and embedding.
    """
    every = usable(vectors, vec_id, embedding, nonzero=False)
    found = vectors.sparkSession.createDataFrame([], FOUND)
    for length in query_lengths(every, queries):
        rows = of_length(every, length)
        for own, ids, matrix in query_blocks(rows, queries, block):
            scan = Scan(own, ids, matrix, scale)
            worst, most = _thresholds(rows, scan, k)
            found = found.unionByName(written(rows.select("row", "vec_id", "embedding").mapInArrow(_filtered(scan, worst, most, k), FOUND), "found"))
    return ranked(found, k)
