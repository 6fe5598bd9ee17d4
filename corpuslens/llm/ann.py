"""Nearest neighbours by score-aware anisotropic quantisation and a bound on its error.

Vectors are scaled to length one, so that the largest cosine is the largest inner product.
Each pair of components has a codebook of 16 centres (four bits). Codes and centres are
fitted to the anisotropic loss |r|^2 + (eta - 1) (r . x)^2 of the residual r of a unit
vector x: error along x changes the scores of the queries that matter, so it costs eta
times as much as error across it. Codebooks are fitted on a bounded sample
(``SAMPLE_ROWS``, by hash of the row); every row is encoded and kept, with its vector and
the length of its coded vector along and across it, in an index table.

A search takes the queries in blocks. For each, tables hold the products of the query's
components with all centres, joined by pairs into 256 entries for a byte of two codes; the
scan adds one entry a byte. The best ``RERANK`` rows of every ``ROWS`` scanned are scored
exactly, in double precision, on the original vectors; they are a first batch and no cap.
After it every other row that can still reach the k-th exact score t is scored too: a coded
vector h x + w, with w across x, has with a query of cosine s the approximate score
h s + w . q, and |w . q| is at most |w| sqrt(1 - s^2), so rows below the least of that for
s >= t cannot. Near copies, which have nearly the same codes, all pass, and the result is
that of brute force.

Defined results: rows that :func:`corpuslens.llm.vectors.usable` leaves out, and zero
vectors, take no part; every row that asks is a query of its own, also where rows share an
id, and only the row itself is not its candidate; vectors of another length are no
candidates, as they have no cosine (each length has an index of its own); repeated rows are
separate candidates; equal vectors have equal approximate and exact scores, ties going to
the smaller id; fewer than k candidates are all returned; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.common import written
from corpuslens.llm.vectors import BLOCK, arrays, of_length, query_blocks, query_lengths, ranked, usable

SAMPLE_ROWS = 8_192
CENTRES = 16
PAIR = 2
#: The cosine from which scores matter; it sets eta.
THRESHOLD = 0.2
RERANK = 96
ROWS = 8_192
QUERIES = 256
FOUND = "query long, query_id long, vec_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantiser:
    """Codebooks (parts, 16, 2) for unit vectors of one length."""

    def __init__(self, size: int) -> None:
        self.parts = -(-size // PAIR)
        self.parts += self.parts % 2
        self.pad = self.parts * PAIR - size
        self.eta = max(1.0, (size - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        self.centres = np.zeros((self.parts, CENTRES, PAIR))

    def split(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.pad))).reshape(len(x), self.parts, PAIR)

    def codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Coordinate descent over the parts, from the nearest centres."""
        p = self.split(x)
        code = np.empty((len(x), self.parts), np.int64)
        for m in range(self.parts):
            code[:, m] = ((p[:, m, None] - self.centres[m]) ** 2).sum(axis=2).argmin(axis=1)
        along = np.einsum("nmd,nmd->nm", p - self.centres[np.arange(self.parts), code], p)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.parts):
                r = p[:, m, None] - self.centres[m]
                part = (r * p[:, m, None]).sum(axis=2)
                rest = total - along[:, m]
                code[:, m] = ((r**2).sum(axis=2) + (self.eta - 1) * (rest[:, None] + part) ** 2).argmin(axis=1)
                along[:, m] = part[np.arange(len(x)), code[:, m]]
                total = rest + along[:, m]
        return code

    def spread(self, x: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lengths of the coded vectors along and across their unit vectors."""
        coded = self.centres[np.arange(self.parts), code]
        along = np.einsum("nmd,nmd->n", coded, self.split(x))
        across = coded - along[:, None, None] * self.split(x)
        return along, np.sqrt(np.einsum("nmd,nmd->n", across, across))

    def fit(self, x: np.ndarray, rounds: int = 6) -> Quantiser:
        rnd = np.random.default_rng(17)
        p = self.split(x)
        for m in range(self.parts):
            self.centres[m] = p[rnd.choice(len(x), CENTRES, replace=len(x) < CENTRES), m]
        for _ in range(rounds):
            code = self.codes(x, 1)
            along = np.einsum("nmd,nmd->nm", p - self.centres[np.arange(self.parts), code], p)
            total = along.sum(axis=1)
            for m in range(self.parts):
                rest = total - along[:, m]
                square = (p[:, m] ** 2).sum(axis=1)
                for j in range(CENTRES):
                    own = code[:, m] == j
                    if not own.any():
                        continue
                    y = p[own, m]
                    left = own.sum() * np.eye(PAIR) + (self.eta - 1) * (y.T @ y)
                    right = y.sum(axis=0) + (self.eta - 1) * ((rest + square)[own, None] * y).sum(axis=0)
                    self.centres[m, j] = np.linalg.solve(left, right)
                new = ((p[:, m] - self.centres[m, code[:, m]]) * p[:, m]).sum(axis=1)
                total, along[:, m] = rest + new, new
        return self

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """(queries, parts / 2, 256): products with all pairs of centres of two parts."""
        t = np.einsum("qmd,mjd->qmj", self.split(queries), self.centres)
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(queries), self.parts // 2, CENTRES**2).astype(np.float32)


def build(rows: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, Quantiser]:
    """The index table (row, vec_id, embedding, code, along, across) of usable rows of one
    length, of which there are some, and its codebooks."""
    turn = F.pmod(F.xxhash64("row"), F.lit(2**30))
    picked = rows.filter(turn < int(2**30 * min(1, sample_rows / rows.count())) + 1)
    sample = picked.orderBy("row").collect() or rows.limit(CENTRES).collect()  # about SAMPLE_ROWS rows
    x = unit(np.array([r["embedding"] for r in sample], np.float64))
    quantiser = Quantiser(x.shape[1]).fit(x)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                flat = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                x = unit(flat.reshape(part.num_rows, -1))
                code = quantiser.codes(x)
                along, across = quantiser.spread(x, code)
                packed = (code[:, 0::2] * CENTRES + code[:, 1::2]).astype(np.uint8)
                yield pa.record_batch([part.column("row"), part.column("vec_id"), part.column("embedding"), pa.array([c.tobytes() for c in packed], pa.binary()), along, across], names=["row", "vec_id", "embedding", "code", "along", "across"])

    return written(rows.mapInArrow(encode, f"row long, vec_id long, embedding {rows.schema['embedding'].dataType.simpleString()}, code binary, along double, across double"), "index"), quantiser


def _scan(asking: np.ndarray, ids: np.ndarray, matrix: np.ndarray, quantiser: Quantiser, k: int, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, norm = quantiser.tables(unit(matrix)), np.sqrt((matrix * matrix).sum(axis=1))
        best_ids, best = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0)] * len(ids)
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                part = batch.slice(i, ROWS)
                places, own, rows, order = next(arrays(part, ROWS))
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(own), -1)[order]
                size = np.sqrt((rows * rows).sum(axis=1))
                along, across = (part.column(c).to_numpy()[order] for c in ("along", "across"))
                slack = tables.shape[1] * np.finfo(np.float32).eps * np.hypot(along, across) + 1e-9  # of sums in single precision
                for a in range(0, len(ids), QUERIES):
                    t = tables[a : a + QUERIES]
                    score = np.zeros((len(t), len(own)), np.float32)
                    for m in range(t.shape[1]):
                        score += np.take(t[:, m], code[:, m], axis=1)
                    score[asking[a : a + QUERIES, None] == places] = -np.inf
                    batch_size = min(max(rerank, k), len(own))
                    top = np.argpartition(-score, batch_size - 1, axis=1)[:, :batch_size]
                    for j in range(len(t)):

                        def rerank_rows(at: np.ndarray, q: int = a + j) -> None:
                            exact = (rows[at] * matrix[q]).sum(axis=1) / (size[at] * norm[q])
                            all_ids, scores = np.concatenate((best_ids[q], own[at])), np.concatenate((best[q], exact))
                            first = np.lexsort((all_ids, -scores))[:k]
                            best_ids[q], best[q] = all_ids[first], scores[first]

                        left = np.isfinite(score[j])
                        rerank_rows(top[j][left[top[j]]])
                        left[top[j]] = False
                        if len(best[a + j]) == k:
                            least = best[a + j][-1]
                            left &= score[j] >= np.minimum(along * least, along) - across * np.sqrt(max(0.0, 1 - max(0.0, least) ** 2)) - slack
                        rerank_rows(np.flatnonzero(left))
        if any(len(x) for x in best):
            count = [len(x) for x in best]
            yield pa.record_batch([np.repeat(asking, count), np.repeat(ids, count), np.concatenate(best_ids), np.concatenate(best)], names=["query", "query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: Column, *, k: int = 5, rerank: int = RERANK, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows where ``queries``, the k nearest.

    ``queries`` is a condition on the columns vec_id and embedding; score is the cosine.
    """
    every = usable(vectors, vec_id, embedding, nonzero=True)
    found = vectors.sparkSession.createDataFrame([], FOUND)
    for length in query_lengths(every, queries):
        index, quantiser = build(of_length(every, length))
        for own, ids, matrix in query_blocks(index.select("row", "vec_id", "embedding"), queries, block):
            found = found.unionByName(index.mapInArrow(_scan(own, ids, matrix, quantiser, k, rerank), FOUND))
    return ranked(found, k)
