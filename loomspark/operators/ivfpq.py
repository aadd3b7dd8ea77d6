"""Inverted file with product quantization: cells by k-means, residuals as a code for each sub-vector.

A search never turns codes back into vectors. For each query and cell it probes there is one table of the distances between each sub-vector
of the query's residual and each codeword; a vector's distance is the sum of the entries that its codes name. Only a constant of a cell's
entries depends on the cell, so a query needs one table for all of its cells, whose sums are rounded; what they leave is summed again exactly.
Queries and entries meet in the shuffle: small cells are packed into bins and large ones cut into several, queries are dealt into blocks, and each bin
meets each block in a task of its own that gives out k rows a query, so rows grow with bins and not with cells.

The index is a table (cell, id, codes). Saved, it is partitioned by cell, so a search reads the cells it probes and no others, and grows by
versions (see `sources.versions`). Centroids and codewords are of bounded number and broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.vector import INNER_PRODUCT
from loomspark.functions.vector import distance as vector_distance
from loomspark.operators import kmeans
from loomspark.operators.knn import TILE, _nearest, _vectors, distances, ranked
from loomspark.sources import versions

#: Cells of an index: twice the root of its vectors within these bounds; and vectors a cell that it is trained on, at most.
LEAST_CELLS, MOST_CELLS, PER_CELL = 8, 1 << 16, 64
#: Entries of a bin of cells that one task scores, about, queries that it scores them for by codes, and by vectors.
PART, BLOCK, WIDE = 1 << 16, 2048, 8192
#: Entries whose codes are looked up at once.
LOOKED = 2048
#: Rows (query, cell) that a task makes at once.
ROUTES = 1 << 15


def cells_for(vectors: int) -> int:
    return max(LEAST_CELLS, min(MOST_CELLS, round(2 * vectors**0.5)))


def sample_for(vectors: DataFrame, n: int, cells: int) -> DataFrame:
    """(id, embedding) of every so manieth id: `PER_CELL` vectors a cell, about; `n` vectors in all."""
    step = max(1, n // (PER_CELL * cells))
    return vectors.where(F.col("id") % step == 0).select("id", "embedding")


@dataclass
class Index:
    """centroids (cells, dim), codewords (m, words, dim / m), entries (cell, id, codes)."""

    centroids: np.ndarray
    codewords: np.ndarray
    metric: str
    entries: DataFrame | None = None

    @property
    def bytes_per_vector(self) -> int:
        return len(self.codewords) + 4


def trained(sample: DataFrame, cells: int, m: int, words: int, rounds: int, metric: str = "l2") -> Index:
    """From a bounded sample (id, embedding): cells start at the vectors of the first ids, codewords at the residuals of the next ones.
    With too few vectors the other codewords stay zero and can be chosen."""
    ids = [r["id"] for r in sample.orderBy("id").select("id").limit(cells + words).collect()]
    if len(ids) < cells:
        raise ValueError(f"{cells} cells need as many vectors, not {len(ids)}")
    centroids = kmeans.train(sample, kmeans.first_vectors(sample, ids[:cells]), rounds)
    residuals = residual(sample, centroids)
    wide, ids = centroids.shape[1] // m, ids[cells:]
    codewords = np.zeros((m, words, wide))
    if ids:
        first = kmeans.first_vectors(residuals, ids)
        codewords[:, : len(ids)] = kmeans.train_parts(residuals, np.stack([first[:, j * wide : (j + 1) * wide] for j in range(m)]), rounds)
    return Index(centroids, codewords, metric)


def residual(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, embedding) less the nearest centroid."""
    held = vectors.sparkSession.sparkContext.broadcast(centroids)

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(1))
                rest = x - held.value[distances(x, held.value, "l2").argmin(axis=1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rest.tolist(), pa.list_(pa.float64()))], ["id", "embedding"])

    return vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(each, "id long, embedding array<double>")


def encoded(vectors: DataFrame, index: Index) -> DataFrame:
    """(id, embedding) to (cell, id, codes): the cell by the index's metric, the nearest codeword of each sub-vector, the first of equals."""
    held, metric = vectors.sparkSession.sparkContext.broadcast((index.centroids, index.codewords)), index.metric

    def each(batches):
        centroids, codewords = held.value
        wide = codewords.shape[2]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1))
            cell = distances(x, centroids, metric).argmin(axis=1)
            rest = x - centroids[cell]
            codes = np.stack([distances(rest[:, j * wide : (j + 1) * wide], codewords[j], "l2").argmin(axis=1) for j in range(len(codewords))], axis=1)
            ends = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), batch.column(0), pa.ListArray.from_arrays(ends, pa.array(codes.astype(np.int32).ravel()))], ["cell", "id", "codes"])

    return vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(each, "cell long, id long, codes array<int>")


class Tables:
    """Distances of queries to the coded entries (of the cell of each, by its place in `centroids`, codes (entries, m)) by lookup tables. All is taken relative to the
    middle of the centroids, in units of the largest number of the model, in single precision."""

    def __init__(self, codewords: np.ndarray, centroids: np.ndarray, cell: np.ndarray, codes: np.ndarray, metric: str):
        self._words, self._ip = codewords, metric == INNER_PRODUCT
        self._centroids, self._cell, self._codes = centroids, cell, codes
        self._middle = np.zeros(centroids.shape[1]) if self._ip else centroids.mean(axis=0)
        self._unit = max(np.abs(centroids - self._middle).max(), np.abs(codewords).max()) or 1.0
        self._near, words, wide = (centroids - self._middle) / self._unit, codewords / self._unit, codewords.shape[2]
        self._scaled, self._own = words, np.zeros(len(cell))
        for j in range(0 if self._ip else len(words)):  # what an entry adds for any query
            w = words[j][codes[:, j]]
            self._own += (w * (w + 2 * self._near[cell, j * wide : (j + 1) * wide])).sum(axis=1)
        self._by_part = np.ascontiguousarray(codes.T)

    def rounded(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, entries): distances up to scale and a number of each query's own; and by how much one can be off, of each query."""
        q, wide = (queries - self._middle) / self._unit, self._scaled.shape[2]
        tables = np.stack([w @ q[:, j * wide : (j + 1) * wide].T * (-1 if self._ip else -2) for j, w in enumerate(self._scaled)]).astype(np.float32)
        base = distances(q, self._near, INNER_PRODUCT if self._ip else "l2")
        base -= base.min(axis=1, keepdims=True)
        out = base.astype(np.float32)[:, self._cell]
        for i in range(0, out.shape[1], LOOKED):
            sums = np.repeat(self._own[i : i + LOOKED, None].astype(np.float32), len(q), axis=1)
            part = np.empty_like(sums)
            for table, codes in zip(tables, self._by_part):
                sums += np.take(table, codes[i : i + LOOKED], axis=0, out=part, mode="clip")
            out[:, i : i + LOOKED] += sums.T
        most = base.max(axis=1) + np.abs(self._own).max(initial=0.0) + np.abs(tables).max(axis=1).sum(axis=0)
        return out, 2.0**-22 * (len(tables) + 4) * most

    def exact(self, queries: np.ndarray, entries: np.ndarray) -> np.ndarray:
        """Distances of pairs of a query and an entry, part by part."""
        m, _, wide = self._words.shape
        x, centroids = queries.reshape(-1, m, wide), self._centroids[self._cell[entries]]
        w = self._words[np.arange(m), self._codes[entries]]
        parts = -(x * w).sum(axis=2) if self._ip else ((x - centroids.reshape(-1, m, wide) - w) ** 2).sum(axis=2)
        out = -(queries * centroids).sum(axis=1) if self._ip else np.zeros(len(queries))
        for j in range(m):
            out += parts[:, j]
        return out

    def least(self, queries: np.ndarray, usable: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, id, distance) of the k least (distance, id) of each query among its usable entries (queries, entries)."""
        d, slack = self.rounded(queries)
        d[~usable] = np.inf
        bound = np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * slack if d.shape[1] > k else np.full(len(d), np.inf)
        q, i = np.nonzero((d <= bound[:, None]) & usable)
        near = np.concatenate([np.zeros(0), *(self.exact(queries[q[j : j + 16384]], i[j : j + 16384]) for j in range(0, len(q), 16384))])
        order = np.lexsort((ids[i], near, q))
        q, i, near = q[order], i[order], near[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[keep], ids[i[keep]], near[keep]


def routed(queries: DataFrame, centroids: np.ndarray, probes: int, metric: str) -> DataFrame:
    """`queries` (qid, embedding) to (cell, turn, qid, embedding): a row for each of the `probes` nearest cells, the nearest first (turn 0)."""
    held = queries.sparkSession.sparkContext.broadcast(centroids)

    def each(batches):
        for batch in batches:
            step = max(1, ROUTES // len(held.value))
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                near = np.argsort(distances(_vectors(part.column(1)), held.value, metric), axis=1, kind="stable")[:, :probes]
                rows = pa.array(np.repeat(np.arange(part.num_rows), near.shape[1]))
                turn = np.tile(np.arange(near.shape[1]), len(near)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int64)), pa.array(turn), part.column(0).take(rows), part.column(1).take(rows)], ["cell", "turn", "qid", "embedding"])

    rows = queries.where("qid is not null and embedding is not null").select(F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(each, "cell long, turn int, qid long, embedding array<double>")


def _bins(entries: DataFrame, cells: int, part: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The first bin of each cell, the number of its bins (one, but for a cell of over `part` entries), and the number of all. A bin holds `part` entries and a cell more at most."""
    sizes = np.zeros(cells, np.int64)
    for r in entries.groupBy("cell").count().collect():  # a row a cell
        sizes[r["cell"]] = r["count"]
    many = np.maximum(1, -(-sizes // part))
    small = np.where(many == 1, sizes, 0)
    first = (np.cumsum(small) - small) // part
    used = int(first[many == 1].max(initial=-1)) + 1
    large = many > 1
    first[large] = used + np.cumsum(many[large]) - many[large]
    return first, many, used + int(many[large].sum())


def meeting(entries: DataFrame, queries: DataFrame, centroids: np.ndarray, probes: int, metric: str, part: int = PART, block: int = BLOCK):
    """`entries` (cell, id, ...) and `queries` (qid, embedding) grouped to meet: bins of cells with blocks of queries, each pair of them in a group of its
    own. A query stands once in each bin that holds some of its `probes` nearest cells, with these `cells` and their `turns` (0: the nearest)."""
    first, many, bins = _bins(entries, len(centroids), part)
    held = entries.sparkSession.sparkContext.broadcast((centroids, first, many))

    def each(batches):
        centroids, first, many = held.value
        for batch in batches:
            step = max(1, ROUTES // len(centroids))
            for start in range(0, batch.num_rows, step):
                some = batch.slice(start, step)
                cell = np.argsort(distances(_vectors(some.column(1)), centroids, metric), axis=1, kind="stable")[:, :probes]
                row, turn, cell = np.repeat(np.arange(len(cell)), cell.shape[1]), np.tile(np.arange(cell.shape[1]), len(cell)), cell.ravel()
                times = many[cell]
                at = np.repeat(np.arange(len(row)), times)
                bin_ = first[cell[at]] + np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                order = np.lexsort((turn[at], bin_, row[at]))
                at, bin_ = at[order], bin_[order]
                row, turn, cell = row[at], turn[at], cell[at]
                starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bin_[1:] != bin_[:-1])])
                ends = pa.array(np.r_[starts, len(row)], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (cell, turn)]
                own = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays([pa.array(bin_[starts], pa.int32()), some.column(0).take(own), some.column(1).take(own), *lists], ["bin", "qid", "embedding", "cells", "turns"])

    rows = queries.where("qid is not null and embedding is not null").select(F.col("qid").cast("long").alias("qid"), F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = max(1, -(-rows.count() // block))
    right = rows.mapInArrow(each, "bin int, qid long, embedding array<double>, cells array<int>, turns array<int>").withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    if probes < len(centroids):  # a scan of files partitioned by cell reads those that are probed
        near = [r["cell"] for r in right.select(F.explode("cells").alias("cell")).distinct().collect()]  # at most as many as there are cells
        entries = entries if len(near) >= len(centroids) else entries.where(F.col("cell").isin(near))
    bins_of = F.broadcast(entries.sparkSession.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(first, many))], "cell long, first int, many int"))  # a row a cell
    left = entries.join(bins_of, "cell").withColumn("bin", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("many"))).cast("int")).drop("first", "many")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # few groups that take long: dealt over more partitions, which are not merged
    left, right = (x.repartition(min(2048, 8 * bins * blocks), "bin", "block").groupBy("bin", "block") for x in (left, right))
    return left.cogroup(right)


def _met(left: pa.Table, right: pa.Table, column: str):
    """Of a bin and a block: the entries' cells (numbers, and the place of each entry's), ids and values, in order of cells; and for some queries at a time, so that a tile of
    all distances is bounded, their qids, vectors and the turn of each of the cells, -1 where a query doesn't probe it."""
    left, right = left.combine_chunks(), right.combine_chunks()
    cell = left.column("cell").to_numpy()
    order = np.argsort(cell, kind="stable")
    numbers, place = np.unique(cell[order], return_inverse=True)
    flat = left.column(column).chunk(0).flatten().to_numpy(zero_copy_only=False)
    values = flat.reshape(len(cell), -1)[order]

    def some():
        q, qids = _vectors(right.column("embedding").chunk(0)), right.column("qid").to_numpy()
        ends = right.column("cells").chunk(0).offsets.to_numpy()
        cells, turns = (right.column(x).chunk(0).values.to_numpy() for x in ("cells", "turns"))
        step = max(1, TILE // len(cell))
        for i in range(0, len(q), step):
            own = slice(ends[i], ends[min(i + step, len(q))])
            at = np.searchsorted(numbers, cells[own])
            row = np.repeat(np.arange(len(q[i : i + step])), np.diff(ends[i : i + step + 1]))
            turn = np.full((len(q[i : i + step]), len(numbers)), -1, np.int32)
            have = (at < len(numbers)) & (numbers[np.minimum(at, len(numbers) - 1)] == cells[own])  # a probed cell may be empty
            turn[row[have], at[have]] = turns[own][have]
            yield qids[i : i + step], q[i : i + step], turn

    return numbers, place, left.column("id").to_numpy()[order], values, some()


def probed(entries: DataFrame, routes: DataFrame, cells: int) -> DataFrame:
    """The entries of cells that some query probes; a scan of files partitioned by cell reads those alone."""
    near = [r["cell"] for r in routes.select("cell").distinct().collect()]  # at most as many as there are cells
    return entries if len(near) >= cells else entries.where(F.col("cell").isin(near))


def search(index: Index, queries: DataFrame, k: int, probes: int, refine: int = 0, vectors: DataFrame | None = None, part: int = PART, block: int = BLOCK) -> DataFrame:
    """(qid, id, distance, rank) of the k nearest of each query (qid, embedding) by the codes in its `probes` nearest cells; with
    `refine`, k * refine candidates are ranked again by their own vectors (id, embedding). Null queries have no neighbours."""
    metric, keep = index.metric, k * max(1, refine)
    held = index.entries.sparkSession.sparkContext.broadcast((index.centroids, index.codewords))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            centroids, codewords = held.value
            cells, place, ids, codes, blocks = _met(left, right, "codes")
            tables = Tables(codewords, centroids[cells], place, codes, metric)
            for qids, q, turn in blocks:
                n, near, d = tables.least(q, (turn >= 0)[:, place], ids, keep)
                for x, y in zip(out, (qids[n], near, d)):
                    x.append(y)
        columns = [pa.array(np.concatenate(x) if x else [], t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64()))]
        return pa.Table.from_arrays(columns, ["qid", "id", "distance"])

    groups = meeting(index.entries.select("cell", "id", "codes"), queries, index.centroids, probes, metric, part, block)
    found = ranked(groups.applyInArrow(met, "qid long, id long, distance double"), keep, "qid")
    return reranked(found, queries, vectors, k, metric) if refine else found


def reranked(found: DataFrame, queries: DataFrame, vectors: DataFrame, k: int, metric: str) -> DataFrame:
    """Candidates (qid, id) ranked by the distances of their own vectors (id, embedding)."""
    pairs = found.select("qid", "id").join(vectors.select("id", F.col("embedding").alias("_x")), "id").join(queries.select("qid", F.col("embedding").alias("_q")), "qid")
    return ranked(pairs.select("qid", "id", vector_distance(metric, F.col("_q"), F.col("_x")).alias("distance")), k, "qid")


def search_cells(vectors: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, probes: int, metric: str = "l2", part: int = PART, block: int = WIDE) -> DataFrame:
    """(qid, id, distance, rank) of the k nearest of the vectors (id, embedding) in the `probes` cells nearest to each query, without codes."""
    return ranked(cell_candidates(vectors, centroids, queries, k, [probes], metric, part, block).drop("turn"), k, "qid")


def cell_candidates(vectors: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, widths: list[int], metric: str = "l2", part: int = PART, block: int = WIDE) -> DataFrame:
    """(qid, turn, id, distance): of each bin of cells the k nearest among those of a query's cells of turns (the nearest cell being turn 0) from one of the `widths`, or 0, to the next;
    `turn` is where these begin. Those of turns below a width are what a search of so many cells ranks, so one pass serves all widths."""
    entries = kmeans.assigned(vectors.where("id is not null and embedding is not null"), centroids, metric, keep=True).select("cell", "id", "embedding")
    steps = sorted(set(widths))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            _, place, ids, x, blocks = _met(left, right, "embedding")
            for qids, q, turn in blocks:
                for low, high in zip([0, *steps], steps):
                    n, near, d = _nearest(q, x, ids, k, metric, ((turn >= low) & (turn < high))[:, place])
                    for to, values in zip(out, (qids[n], np.full(len(n), low, np.int32), near, d)):
                        to.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in out], ["qid", "turn", "id", "distance"])

    return meeting(entries, queries, centroids, max(steps), metric, part, block).applyInArrow(met, "qid long, turn int, id long, distance double")


def saved(index: Index, path: str) -> None:
    """The model, and the entries as the first version of a table partitioned by cell; their ids are places in the order of the ids they had."""
    spark = index.entries.sparkSession
    rows = [("centroid", i, 0, v.tolist()) for i, v in enumerate(index.centroids)] + [("codeword", c, j, v.tolist()) for j, words in enumerate(index.codewords) for c, v in enumerate(words)]
    spark.createDataFrame([(*r, index.metric) for r in rows], "kind string, number int, part int, v array<double>, metric string").write.parquet(f"{path}/model")
    versions.appended(index.entries.select("cell", "codes", F.col("id").alias("own_id")), path, ["own_id"], ["cell"])


def loaded(spark: SparkSession, path: str, version: int | None = None) -> Index:
    """The index as of a version, the last if none is named."""
    rows = spark.read.parquet(f"{path}/model").orderBy("kind", "part", "number").collect()  # of bounded number
    centroids = np.array([r["v"] for r in rows if r["kind"] == "centroid"])
    words = [r for r in rows if r["kind"] == "codeword"]
    parts = 1 + max(r["part"] for r in words)
    codewords = np.array([r["v"] for r in words]).reshape(parts, len(words) // parts, -1)
    return Index(centroids, codewords, rows[0]["metric"], versions.read(spark, path, version).select("cell", "id", "codes", "own_id"))


def added(index: Index, vectors: DataFrame, path: str) -> tuple[int, int]:
    """More vectors (id, embedding) for a saved index, as a version; (first id, vectors): ids go on after the last one, in the order of the ids given,
    also where several writers add at once."""
    return versions.appended(encoded(vectors, index).select("cell", "codes", F.col("id").alias("own_id")), path, ["own_id"], ["cell"])
