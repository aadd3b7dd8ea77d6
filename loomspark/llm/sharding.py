"""Shards of nearly equal bytes by k-d tree partitioning, with DataFrame operations only.

Documents are points in metadata space (size, source, lang). A node is split along its widest
dimension at the weighted median, or at the share of its left shards where they are odd, and so on down to one
shard a leaf. A median is found by histograms: each pass sums the bytes of `BINS` ranges of every node of
the level at once, and goes on in the range that holds the cut, until the cut is near enough or falls between two
neighbouring points. The driver sees those sums and the cuts, never a point.

Equal texts are one point, so they share a shard. Only a group that holds more bytes than a whole shard may, so that no
law could hold with it in one, is dealt out into salted points of its own. Points are summed up before anything is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.scratch import written

SHARDS = 40
#: Bytes of a document besides its text.
OVERHEAD = 16
BINS = 1024
#: Of a leaf's bytes: how far a cut may be off, and the most that equal texts hold together.
OFF, GROUP = 0.0005, 1.0
#: Rows of a shard that are numbered in one group.
SLOTS = 4096


@dataclass
class _Node:
    leaves: int
    first: int
    dim: int = 0
    cut: int = 0
    left: _Node | None = None
    right: _Node | None = None
    #: Of the search: bounds of the cut, bytes before them, bytes wanted on the left.
    low: int = 0
    high: int = 0
    before: int = 0
    want: float = 0.0

    def open(self) -> list[_Node]:
        """Leaves that hold several shards."""
        if self.left:
            return self.left.open() + self.right.open()
        return [self] if self.leaves > 1 else []


def _tree(node: _Node, xs: list[Column], leaf) -> Column:
    """The value of `leaf` at the leaf a point belongs to."""
    if not node.left:
        return leaf(node)
    return F.when(xs[node.dim] < node.cut, _tree(node.left, xs, leaf)).otherwise(_tree(node.right, xs, leaf))


def _split(points: DataFrame, root: _Node, extent: list[int], leaf_bytes: float, bins: int, off: float) -> None:
    """Splits all open leaves once; extent: of the whole table in each dimension."""
    dims = len(extent)
    xs = [F.col(f"x{i}") for i in range(dims)]
    nodes = {n.first: n for n in root.open()}
    at = _tree(root, xs, lambda n: F.lit(n.first if n.leaves > 1 else -1)).alias("node")
    mine = points.select(at, "bytes", *xs).where("node >= 0")
    sides = [f(x).alias(f"{k}{i}") for i, x in enumerate(xs) for k, f in (("low", F.min), ("high", F.max))]
    for r in mine.groupBy("node").agg(F.sum("bytes").alias("bytes"), *sides).collect():  # a row a node
        n = nodes[r["node"]]
        n.dim = max(range(dims), key=lambda i: ((r[f"high{i}"] >> 32) - (r[f"low{i}"] >> 32)) / max(1, extent[i]))
        n.low, n.high, n.before = r[f"low{n.dim}"], r[f"high{n.dim}"] + 1, 0
        n.want = r["bytes"] * (n.leaves // 2) / n.leaves
    for n in nodes.values():
        if n.high == n.low:
            n.leaves = 1  # no point is in it: its other shards stay empty
    nodes = {k: n for k, n in nodes.items() if n.high > n.low}
    todo = dict(nodes)
    while todo:
        # the coordinate, lower bound and range width of the node a point is in
        pick = lambda f: F.element_at(F.create_map(*[F.lit(v) for k, n in todo.items() for v in (k, f(n))]), F.col("node"))  # noqa: E731, B023
        wide = {k: max(1, -(-(n.high - n.low) // bins)) for k, n in todo.items()}
        x = F.element_at(F.array(*xs), pick(lambda n: n.dim + 1))
        inside = mine.where(F.col("node").isin(list(todo))).select("node", "bytes", x.alias("x"), pick(lambda n: n.low).alias("low"), pick(lambda n: n.high).alias("high"), pick(lambda n: wide[n.first]).alias("wide"))
        inside = inside.where("x >= low and x < high")
        sums = inside.groupBy("node", F.expr("(x - low) div wide").alias("bin")).agg(F.sum("bytes").alias("bytes"), F.min("x").alias("least"), F.max("x").alias("most"))
        ranges: dict[int, list] = {}
        for r in sums.collect():  # at most bins rows a node
            ranges.setdefault(r["node"], []).append(r)
        for k, n in list(todo.items()):
            for r in sorted(ranges[k], key=lambda r: r["bin"]):
                upto = n.before + r["bytes"]
                if upto < n.want:
                    n.before = upto
                    continue
                near = n.want - n.before <= upto - n.want
                if min(n.want - n.before, upto - n.want) <= off * leaf_bytes or r["least"] == r["most"]:
                    n.cut = r["least"] if near else r["most"] + 1
                    del todo[k]
                else:
                    n.low, n.high = r["least"], r["most"] + 1
                break
    for k, n in nodes.items():
        few = n.leaves // 2
        n.left, n.right = _Node(few, n.first), _Node(n.leaves - few, n.first + few)


def _points(rows: DataFrame, dims: int, most: float) -> DataFrame:
    """(text, salt) with bytes and coordinates: a value, then 32 bits that tell points of equal value apart."""
    parts = rows.groupBy("text", "salt").agg(F.sum("size").alias("bytes"), *[F.min(f"v{i}").alias(f"v{i}") for i in range(dims)])
    texts = parts.groupBy("text").agg(F.sum("bytes").alias("_all"), *[F.min(f"v{i}").alias(f"w{i}") for i in range(dims)])
    apart = F.when(F.col("_all") > most, F.xxhash64("text", "salt")).otherwise(F.xxhash64("text"))
    low = apart.bitwiseAND(F.lit(0xFFFFFFFF))
    xs = [F.shiftleft(F.col(f"w{i}"), 32).bitwiseOR(low).alias(f"x{i}") for i in range(dims)]
    return parts.join(texts, "text").select("text", "salt", "bytes", *xs)


def sharded(docs: DataFrame, shards: int = SHARDS, bins: int = BINS, off: float = OFF, group: float = GROUP) -> DataFrame:
    """`docs` (doc_id, text and, if there, source and lang) to one row each: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes and 16. The law is `bytes`: shards 0 to shards - 1 hold sizes as equal as whole
    points allow; grown_shard is null. Equal texts share a shard, unless they hold more than `group` of a shard's bytes. Slots number a shard's
    rows from 0 without gaps. A null text counts as an empty one, with checksum 0; nulls in other columns are values; repeated rows are placed
    each; an empty table gives no rows; a text of any length is one point; other columns, of any name, are ignored. With fewer points than shards
    some shards are empty.
    """
    names = [c for c in ("source", "lang") if c in docs.columns]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    code = [F.shiftright(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), 1) for c in names]
    size = (F.octet_length(text) + OVERHEAD).cast("long")
    values = [v.cast("long").alias(f"v{i}") for i, v in enumerate([size, *code])]
    dims = len(values)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(8 * shards)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text"), salt.alias("salt"), *values)
    rows = written(rows, "sizes")
    sides = [f(f"v{i}").alias(f"{k}{i}") for i in range(dims) for k, f in (("low", F.min), ("high", F.max))]
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("size"), *sides).first()
    leaf = (whole["size"] or 0) / shards
    points = written(_points(rows, dims, group * leaf), "points")
    root = _Node(shards if whole["n"] else 1, 0)
    extent = [(whole[f"high{i}"] or 0) - (whole[f"low{i}"] or 0) for i in range(dims)]
    while root.open():
        _split(points, root, extent, leaf, bins, off)
    shard = _tree(root, [F.col(f"x{i}") for i in range(dims)], lambda n: F.lit(n.first)).alias("shard")
    placed = rows.join(points.select("text", "salt", shard), ["text", "salt"]).select("doc_id", "size", "text_crc32", "shard")
    cells = max(1, whole["n"] // (shards * SLOTS))
    placed = written(placed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells))), "placed")
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    # a row for each SLOTS documents
    counts = counts.select("shard", "cell", (F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    inner = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32"))
    numbered = placed.withColumn("at", inner).join(counts, ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
