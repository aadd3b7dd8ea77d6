"""Approximate neighbours by layered proximity graphs, one for each cell of the vectors.

Cells are those of k-means; a vector stands in a few of the nearest ones. The index is a table of nodes with their links, saved by cell: a
search routes each query to the cells nearest to it, reads those alone, takes their graphs as they are, and merges the ranked results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions.sampling import Random
from loomspark.operators import ivfpq, kmeans
from loomspark.operators.knn import _vectors, ranked
from loomspark.shared import written


#: Not a vector, in rows of links and of walks.
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Candidates that a walk opens at once, queries that walk together, vectors that are added together.
OPENED, TOGETHER, ADDED = 8, 256, 512


def _keys(far: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances and rows as numbers in the order of both; the lowest bit, of those that a walk has opened, is unset."""
    bits = (far.astype(np.float32) + np.float32(0)).view(np.uint32)
    bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
    return bits.astype(np.uint64) << np.uint64(32) | rows.astype(np.uint64) << np.uint64(1)


def _rows(keys: np.ndarray) -> np.ndarray:
    return ((keys >> np.uint64(1)) & np.uint64(0x7FFFFFFF)).astype(np.int64)


def _padded(group: np.ndarray, keys: np.ndarray, groups: int) -> np.ndarray:
    """(groups, most of a group): the keys of each group, and none behind them."""
    order = np.argsort(group, kind="stable")
    group, keys = group[order], keys[order]
    counts = np.bincount(group, minlength=groups)
    out = np.full((groups, counts.max(initial=0)), _NONE)
    out[group, np.arange(len(group)) - (np.cumsum(counts) - counts)[group]] = keys
    return out


class _Layer:
    """Links of some of the rows: `place` of a row in `to`, whose rows are padded by -1."""

    def __init__(self, rows: np.ndarray, n: int, most: int):
        self.most, self.rows, self.place = most, rows, np.full(n, -1, np.int32)
        self.place[rows] = np.arange(len(rows), dtype=np.int32)
        self.to, self.count = np.full((len(rows), most), -1, np.int32), np.zeros(len(rows), np.int32)


class Graph:
    """A graph over the rows of `vectors`; links by layer and row. Many queries walk it together, a step of all of them at a time, and many rows are
    added together: each finds those before it by a walk, or, among the rows added with it, by all distances."""

    def __init__(self, vectors: np.ndarray, m: int, metric: str, levels: np.ndarray):
        self.m, self._ip, self._exact = m, metric == "ip", vectors
        self._middle = np.zeros(vectors.shape[1]) if self._ip or not len(vectors) else vectors.mean(axis=0)
        self._scale = np.abs(vectors - self._middle).max(initial=0.0) or 1.0
        self._x = self._near(vectors)
        self.layers = [_Layer(np.flatnonzero(levels >= i), len(levels), m * (1 if i else 2)) for i in range(1 + levels.max(initial=0))]
        self._levels = levels

    def _near(self, vectors: np.ndarray) -> np.ndarray:
        """Rounded, as a walk compares them; what it finds is measured again."""
        return ((vectors - self._middle) / self._scale).astype(np.float32)

    def _far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of vectors along the last axis."""
        return -np.einsum("...j,...j->...", a, b) if self._ip else np.einsum("...j,...j->...", d := a - b, d)

    def _walk(self, q: np.ndarray, start: np.ndarray, width: int, layer: int, visited: np.ndarray | None = None) -> np.ndarray:
        """Best-first from a row for each query: keys of the `width` nearest found, nearest first; ends when all of them have been opened."""
        links, best = self.layers[layer], np.full((len(q), width), _NONE)
        best[:, 0] = _keys(self._far(q, self._x[start]), start)
        wide = len(links.rows) + 1  # the last place is that of no link, -1
        seen = np.zeros(len(q) * wide, bool)
        seen[np.arange(len(q)) * wide - 1] = True
        seen[np.arange(len(q)) * wide + links.place[start]] = True
        if visited is not None:
            visited += 1
        live = np.arange(len(q))
        while len(live):
            at = best[live]
            turn = (fresh := at & np.uint64(1) == 0).cumsum(axis=1, dtype=np.int16)
            row, place = np.nonzero(fresh & (turn <= OPENED))
            opened, turn = links.place[_rows(at[row, place])], turn[row, place]
            at[row, place] |= np.uint64(1)
            whose, found = [], []
            for i in range(1, OPENED + 1):
                own = np.flatnonzero(turn == i)
                to = links.to.take(opened[own], axis=0)
                places = (live[row[own]] * wide)[:, None] + (to if layer == 0 else np.where(to < 0, -1, links.place[to]))
                new = np.flatnonzero(~seen.take(places.ravel(), mode="wrap"))
                seen[places.ravel()[new]] = True
                whose.append(row[own[new // to.shape[1]]])
                found.append(to.ravel()[new])
            who, to = np.concatenate(whose), np.concatenate(found)
            if visited is not None:
                visited[live] += np.bincount(who, minlength=len(live))
            keys = _keys(self._far(self._x.take(to, axis=0), q.take(live[who], axis=0)), to)
            nearer = keys < at[who, -1]
            at = np.sort(np.concatenate([at, _padded(who[nearer], keys[nearer], len(live))], axis=1), axis=1)[:, :width]
            best[live] = at
            live = live[(at & np.uint64(1) == 0).any(axis=1)]
        return np.where(best == _NONE, best, best & ~np.uint64(1))

    def _diverse(self, keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates, nearest first, those that are farther from each one chosen than from the centre: (centres, most) rows, padded by -1, and their number."""
        out, count = np.full((len(keys), most), -1, np.int32), np.zeros(len(keys), np.int32)
        chosen = np.zeros((len(keys), most, self._x.shape[1]), np.float32)
        slots = np.arange(most)
        left = np.arange(len(keys))
        for j in range(keys.shape[1]):
            left = left[(keys[left, j] != _NONE) & (count[left] < most)]
            if not len(left):
                break
            rows, wide = _rows(keys[left, j]), count[left].max()
            x = self._x[rows]
            between = self._far(chosen[left, :wide], x[:, None])
            # as keys, so that rounding is the same on both sides
            nearer = (_keys(between, np.zeros_like(between)) >> np.uint64(32) <= (keys[left, j] >> np.uint64(32))[:, None]) & (slots[:wide] < count[left][:, None])
            own = ~nearer.any(axis=1)
            to = left[own]
            out[to, count[to]], chosen[to, count[to]] = rows[own], x[own]
            count[to] += 1
        return out, count

    def _linked(self, links: _Layer, rows: np.ndarray, keys: np.ndarray) -> None:
        """Links of new rows to the diverse ones of their candidates, and back."""
        to, count = self._diverse(keys, self.m)
        place = links.place[rows]
        links.to[place, : self.m], links.count[place] = to, count
        back, others = np.repeat(rows, count), to[to >= 0]
        order = np.argsort(others, kind="stable")
        back, others = back[order], links.place[others[order]]
        each, first, more = np.unique(others, return_index=True, return_counts=True)
        full = links.count[each] + more > links.most
        fits = ~np.repeat(full, more)
        at = (links.count[others] + np.arange(len(others)) - np.repeat(first, more))[fits]
        links.to[others[fits], at] = back[fits]
        links.count[each[~full]] += more[~full].astype(np.int32)
        if not full.any():
            return
        crowded = each[full]
        which, have = np.nonzero(links.to[crowded] >= 0)
        which = np.concatenate([which, np.repeat(np.arange(len(crowded)), more[full])])
        rows = np.concatenate([links.to[crowded][links.to[crowded] >= 0], back[~fits]])
        keys = _keys(self._far(self._x[rows], self._x[links.rows[crowded[which]]]), rows)
        links.to[crowded], links.count[crowded] = self._diverse(np.sort(_padded(which, keys, len(crowded)), axis=1), links.most)

    def build(self, width: int) -> None:
        """Adds all rows in order, `ADDED` at a time."""
        top = -1
        entry = 0
        for begin in range(0, len(self._x), ADDED):
            rows = np.arange(begin, min(begin + ADDED, len(self._x)))
            x, levels = self._x[rows], self._levels[rows]
            start = np.full(len(rows), entry)
            found: list[np.ndarray] = []
            for layer in range(max(top, levels.max()), -1, -1):
                own = np.flatnonzero(levels >= layer)
                near = np.full((len(rows), width), _NONE)
                if layer <= top:
                    for others, wide in ((np.flatnonzero(levels < layer), 1), (own, width)):
                        for i in range(0, len(others), TOGETHER):
                            some = others[i : i + TOGETHER]
                            near[some, :wide] = self._walk(x[some], start[some], wide, layer)
                    start = _rows(near[:, 0])
                between = _keys(self._far(x[own, None], x[None, own]), np.broadcast_to(rows[own], (len(own), len(own)))) if len(own) else np.zeros((0, 0), np.uint64)
                between[np.triu_indices(len(own))] = _NONE  # rows before it alone
                found.append(np.sort(np.concatenate([near[own], between], axis=1), axis=1)[:, :width])
            for layer, keys in zip(range(len(found) - 1, -1, -1), found):
                self._linked(self.layers[layer], rows[levels >= layer], keys)
            if levels.max() > top:
                top = int(levels.max())
                entry = int(rows[levels.argmax()])

    def search(self, queries: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row, distance) of the k nearest found of each query, and distances taken by each query."""
        out, visited = [[], [], []], np.zeros(len(queries), np.int64)
        entry = int(self.layers[-1].rows[0])
        for i in range(0, len(queries), TOGETHER):
            exact = queries[i : i + TOGETHER]
            q, start, count = self._near(exact), np.full(len(exact), entry), visited[i : i + TOGETHER]
            for layer in range(len(self.layers) - 1, 0, -1):
                start = _rows(self._walk(q, start, 1, layer, count)[:, 0])
            keys = self._walk(q, start, max(width, k), 0, count)
            rows, who = _rows(keys[keys != _NONE]), np.nonzero(keys != _NONE)[0]
            d = -(self._exact[rows] * exact[who]).sum(axis=1) if self._ip else ((self._exact[rows] - exact[who]) ** 2).sum(axis=1)
            order = np.lexsort((rows, d, who))
            who, rows, d = who[order], rows[order], d[order]
            keep = np.arange(len(who)) - np.searchsorted(who, who) < k
            for to, values in zip(out, (who[keep] + i, rows[keep], d[keep])):
                to.append(values)
        return (*(np.concatenate(x) if x else np.zeros(0, t) for x, t in zip(out, (np.int64, np.int64, np.float64))), visited)

    def links(self) -> pa.ListArray:
        """Of each row its links by layer."""
        ends = np.cumsum(np.r_[0, self._levels + 1])
        counts = np.zeros(ends[-1], np.int64)
        for i, layer in enumerate(self.layers):
            counts[ends[layer.rows] + i] = layer.count
        inner = np.cumsum(np.r_[0, counts])
        values = np.zeros(inner[-1], np.int32)
        for i, layer in enumerate(self.layers):
            row, at = np.nonzero(np.arange(layer.most) < layer.count[:, None])
            values[inner[ends[layer.rows[row]] + i] + at] = layer.to[row, at]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(values)))

    @classmethod
    def of(cls, vectors: np.ndarray, links: pa.ListArray, m: int, metric: str) -> Graph:
        """The graph with the links of its rows as they are."""
        ends, lists = links.offsets.to_numpy(), links.values
        inner, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        graph = cls(vectors, m, metric, np.diff(ends) - 1)
        for i, layer in enumerate(graph.layers):
            at = ends[layer.rows] + i
            layer.count = np.diff(inner)[at]
            row, place = np.nonzero(np.arange(layer.most) < layer.count[:, None])
            layer.to[row, place] = values[inner[at[row]] + place]
        return graph


#: Vectors of one graph, about: what one task builds and searches. Queries that it searches it for. A walk grows with the logarithm of its graph, so
#: few large graphs cost a query less than many small ones.
SHARD, BLOCK = 200_000, 1 << 14
#: Graphs of a table that needs no more: cells of which a query reads a share, so their number doesn't grow.
CELLS = 24
#: Cells that each vector stands in: the nearest ones, so that a query finds the neighbours beyond a border in its own cells.
COPIES = 3
_NODE = "cell long, part int, row int, id long, embedding array<double>, links array<array<int>>"


@dataclass
class Index:
    """Cells by centroids; nodes (cell, part, row, id, embedding, links), links by layer to rows of the same part."""

    centroids: np.ndarray
    nodes: DataFrame
    m: int
    metric: str


def cells_for(vectors: int) -> int:
    """Cells by which queries are routed: as many as keep each within what a task holds, and `CELLS` where that allows it."""
    return max(1, -(-COPIES * vectors // SHARD), min(CELLS, vectors // 30))


def _tasks(cells: int) -> int:
    """Partitions over which cells are dealt, so that few of them share one: they are few, and long to work on."""
    return min(2048, 8 * cells)


def built(vectors: DataFrame, centroids: np.ndarray, m: int = 16, width: int = 200, seed: int = 1, metric: str = "l2", copies: int = COPIES) -> Index:
    """`vectors` (id, embedding) to graphs, one for each cell; a cell of over `SHARD` vectors, such as one of very many equal ones, has several
    parts by the hash of the id, each a graph. A graph is built in its task in the order of ids, so it is the same each time."""
    placed = kmeans.assigned(vectors.where("id is not null and embedding is not null"), centroids, metric, keep=True, copies=copies)
    parts = F.broadcast(placed.groupBy("cell").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("parts")))  # a row a cell
    rows = placed.join(parts, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", "embedding")

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        x = _vectors(table.column("embedding").chunk(0))
        rng = Random(seed)
        levels = np.array([min(15, int(-math.log(1.0 - rng.uniform()) / math.log(m))) for _ in range(len(x))], np.int64)
        graph = Graph(x, m, metric, levels)
        graph.build(width)
        columns = [table.column("cell"), table.column("part"), pa.array(range(len(x)), pa.int32()), table.column("id"), table.column("embedding"), graph.links()]
        return pa.Table.from_arrays(columns, ["cell", "part", "row", "id", "embedding", "links"])

    return Index(centroids, rows.repartition(_tasks(len(centroids)), "cell", "part").groupBy("cell", "part").applyInArrow(one, _NODE), m, metric)


def saved(index: Index, path: str) -> None:
    """The graphs partitioned by cell, and the centroids."""
    spark = index.nodes.sparkSession
    index.nodes.write.partitionBy("cell").parquet(f"{path}/nodes")
    rows = [(i, v.tolist(), index.m, index.metric) for i, v in enumerate(index.centroids)]
    spark.createDataFrame(rows, "cell long, v array<double>, m int, metric string").write.parquet(f"{path}/model")


def loaded(spark: SparkSession, path: str) -> Index:
    rows = spark.read.parquet(f"{path}/model").orderBy("cell").collect()  # a row a cell
    nodes = spark.read.parquet(f"{path}/nodes").withColumn("cell", F.col("cell").cast("long"))
    return Index(np.array([r["v"] for r in rows]), nodes, rows[0]["m"], rows[0]["metric"])


def _graph(table: pa.Table, m: int, metric: str) -> tuple[Graph, np.ndarray]:
    """The graph of a part from its rows, and the ids of its rows."""
    table = table.sort_by("row").combine_chunks()
    graph = Graph.of(_vectors(table.column("embedding").chunk(0)), table.column("links").chunk(0), m, metric)
    return graph, table.column("id").to_numpy()


def walked(index: Index, queries: DataFrame, k: int, probes: int, widths: list[int], block: int = BLOCK) -> DataFrame:
    """(qid, width, turn, part, id, distance, visited): the k nearest of each query (qid, embedding) in each of the `probes` cells nearest to it (turn 0: the
    nearest), for each width of the walk; visited: vectors whose distance was taken in that walk, in each of its rows. Each graph is loaded once
    for all widths and a block of queries. Queries go to their cells by a shuffle."""
    m, metric = index.m, index.metric

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = [("qid", pa.int64()), ("width", pa.int32()), ("turn", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("distance", pa.float64()), ("visited", pa.int64())]
        out = []
        if left.num_rows and right.num_rows:
            graph, ids = _graph(left, m, metric)
            right = right.combine_chunks()
            q, qids, turns, part = _vectors(right.column("embedding").chunk(0)), right.column("qid").to_numpy(), right.column("turn").to_numpy(), left.column("part")[0].as_py()
            for width in widths:
                who, rows, d, visited = graph.search(q, k, width)
                columns = [qids[who], np.full(len(who), width), turns[who], np.full(len(who), part), ids[rows], d, visited[who]]
                out.append(pa.Table.from_arrays([pa.array(x, t) for x, (_, t) in zip(columns, kinds)], [n for n, _ in kinds]))
        return pa.concat_tables(out) if out else pa.schema(kinds).empty_table()

    routes = ivfpq.routed(queries, index.centroids, probes, metric)
    nodes = ivfpq.probed(index.nodes, routes, len(index.centroids))
    counts = F.broadcast(routes.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))  # a row a cell
    parts = F.broadcast(nodes.groupBy("cell").agg((F.max("part") + 1).alias("parts")))
    left = nodes.join(counts, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = routes.join(counts, "cell").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).drop("blocks")
    right = right.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    left, right = (x.repartition(_tasks(len(index.centroids)), "cell", "part", "block").groupBy("cell", "part", "block") for x in (left, right))
    return left.cogroup(right).applyInArrow(met, "qid long, width int, turn int, part int, id long, distance double, visited long")


def search(index: Index, queries: DataFrame, k: int, probes: int, width: int = 128) -> DataFrame:
    """(qid, id, distance, rank) of each query (qid, embedding) over the `probes` cells nearest to it. A vector that stands in several counts once."""
    found = walked(index, queries, k, probes, [width]).groupBy("qid", "id").agg(F.min("distance").alias("distance"))
    return ranked(found, k, "qid")


def edges(index: Index) -> DataFrame:
    """(cell, part, layer, src, dst): all links, as rows."""
    each = index.nodes.select("cell", "part", F.col("row").alias("src"), F.posexplode("links").alias("layer", "to"))
    return each.select("cell", "part", "layer", "src", F.explode("to").alias("dst"))


def mean_degree(index: Index) -> DataFrame:
    """One row: links a vector on layer 0."""
    return index.nodes.agg(F.avg(F.size(F.get("links", 0))).alias("degree"))


def reachable(index: Index) -> DataFrame:
    """(cell, part, vectors, reached): vectors that can be reached on layer 0 from the one a search of the part starts at, by widening the
    frontier with a join a round."""
    top = index.nodes.groupBy("cell", "part").agg(F.max(F.struct(F.size("links").alias("n"), -F.col("row"))).alias("top"), F.count("*").alias("vectors"))
    seen = top.select("cell", "part", (-F.col("top.col2")).alias("src"))
    links, frontier, n = written(edges(index).where("layer = 0").select("cell", "part", "src", "dst"), "links"), seen, -1
    while n != (n := seen.count()):
        frontier = links.join(frontier, ["cell", "part", "src"]).select("cell", "part", F.col("dst").alias("src")).distinct().join(seen, ["cell", "part", "src"], "left_anti")
        seen = written(seen.union(frontier), "seen")
    return top.select("cell", "part", "vectors").join(seen.groupBy("cell", "part").agg(F.count("*").alias("reached")), ["cell", "part"])
