"""Lloyd's k-means: centroids are broadcast (k of them), vectors stay where they are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators.knn import _vectors, distances


def assigned(vectors: DataFrame, centroids: np.ndarray, metric: str = "l2", keep: bool = False, copies: int = 1) -> DataFrame:
    """`vectors` (id, embedding) to (id, cell, distance): the nearest centroid, the lowest number of equals; with `keep` the embedding too. With
    `copies` a row for each of the nearest ones."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                d = distances(_vectors(batch.column(1)), held.value, metric)
                cell = d.argmin(axis=1)[:, None] if copies == 1 else np.argsort(d, axis=1, kind="stable")[:, :copies]
                row = np.repeat(np.arange(len(d)), cell.shape[1])
                ids, x = (batch.column(i).take(pa.array(row)) for i in (0, 1))
                columns = [ids, pa.array(cell.ravel().astype(np.int64)), pa.array(d[row, cell.ravel()]), *([x] if keep else [])]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cell", "distance", "embedding"][: len(columns)])

    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(each, "id long, cell long, distance double" + (", embedding array<double>" if keep else ""))


def _sums(vectors: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], tuple[int, np.ndarray]]:
    """Count and sum by (part, cell): summed in every batch, then by cell and dimension in Spark. centroids: (parts, cells, width)."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def each(batches):
        parts, k, wide = held.value.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(0))
            for j in range(parts):
                own = x[:, j * wide : (j + 1) * wide]
                cell = distances(own, held.value[j], "l2").argmin(axis=1)
                cells, sums = np.unique(cell), np.zeros((k, wide))
                np.add.at(sums, cell, own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), j)), pa.array(cells), pa.array(np.bincount(cell)[cells]), pa.array(sums[cells].tolist(), pa.list_(pa.float64()))], ["part", "cell", "n", "sums"])

    rows = vectors.select(F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(each, "part long, cell long, n long, sums array<double>")
    totals = rows.select("part", "cell", "n", F.posexplode("sums").alias("dim", "x")).groupBy("part", "cell", "dim").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = totals.groupBy("part", "cell").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("x"))
    return {(r["part"], r["cell"]): (r["n"], np.array([e["x"] for e in r["x"]])) for r in whole.collect()}  # a row a cell


def train(vectors: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """Centroids after some rounds from given ones. An empty cell takes half of the largest (the last of equals): both get its
    centroid, moved apart by 1e-4 * (1 + |x|), and half its count."""
    return train_parts(vectors, start[None], rounds)[0]


def train_parts(vectors: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    """The same for each of several parts of the vectors, consecutive and of equal width, in one pass a round."""
    centroids = start.astype(np.float64)
    for _ in range(rounds):
        found = _sums(vectors, centroids)
        for j, own in enumerate(centroids):
            counts = np.array([found.get((j, c), (0, None))[0] for c in range(len(own))], np.float64)
            for c in np.flatnonzero(counts):
                own[c] = found[j, c][1] / counts[c]
            _refill(own, counts)
    return centroids


def _refill(cells: np.ndarray, counts: np.ndarray) -> None:
    """Puts every empty cell beside the fullest one of the moment, which it halves; both in place."""
    for c in np.flatnonzero(counts == 0):
        pair = [c, np.flatnonzero(counts == counts.max())[-1]]
        middle = cells[pair[1]]
        cells[pair] = middle + np.multiply.outer([1, -1], 1e-4 * (1 + np.abs(middle)))
        counts[pair] = counts[pair[1]] / 2


def random_start(vectors: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """The vectors of k ids, those of the least hash under a seed; fewer than k vectors are an error."""
    rows = vectors.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k).select("embedding").collect()
    if len(rows) < k:
        raise ValueError(f"{k} cells need as many vectors, not {len(rows)}")
    return np.array([r["embedding"] for r in rows], np.float64)


def first_vectors(vectors: DataFrame, ids: list[int]) -> np.ndarray:
    """The embeddings of some ids, in that order."""
    rows = {r["id"]: r["embedding"] for r in vectors.where(F.col("id").isin(ids)).select("id", "embedding").collect()}
    return np.array([rows[i] for i in ids], np.float64)
