"""SimHash near-duplicate components through a segment-popcount grid join.

A 64-bit fingerprint is cut into 32 segments of two bits; the counts of set bits a segment
form a vector whose Manhattan distance never exceeds the Hamming distance. Vectors within
Manhattan distance 3 agree on at least three of six groups of dimensions, so a grid over
each choice of three groups (20 grids) puts every linked pair into one cell. In a cell the
Manhattan bound is applied first, then the exact Hamming distance.
"""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm import bytescan
from loomspark.llm.components import components
from loomspark.llm.scratch import bytes_of, width, written

DISTANCE = 3
WORDS = 3
#: Distinct fingerprints of a cell that are compared pair by pair; fuller cells go the way of `_dense`.
CELL = 2048
_EVEN = 0x5555555555555555
#: First bit and bits of the six groups of dimensions.
_GROUPS = ((0, 10), (10, 10), (20, 10), (30, 10), (40, 12), (52, 12))
_GRIDS = [sum(((1 << n) - 1) << at for at, n in pick) for pick in combinations(_GROUPS, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_of(data: bytes | None, words: int = WORDS, seed: int = 42) -> int:
    """Majority of each bit over the XXH64 of all shingles, repeats included; 0 without words."""
    tokens = bytescan.words_of(data, bytescan.SPACED)
    if not tokens:
        return 0
    joined, starts, ends = bytescan.bounds(tokens)
    k = min(words, len(tokens))
    counts, n, digest = np.zeros(64, np.int64), len(tokens) - k + 1, xxhash.xxh64_digest
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist())
    while block := list(islice(spans, 1 << 16)):
        raw = b"".join([digest(joined[s:e], seed) for s, e in block])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp long) of each row of `docs` (doc_id, text)."""

    def each(batches):
        for batch in batches:
            fps = [_signed(fingerprint_of(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of(F.col("text")).alias("text"))
    return rows.mapInArrow(each, "doc_id long, fp long")


def _counts(fp: Column) -> Column:
    """Set bits of each segment of two bits, packed as the fingerprint is."""
    low, high = fp.bitwiseAND(F.lit(_EVEN)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_EVEN))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _packed(fp: np.ndarray) -> np.ndarray:
    return fp - ((fp >> np.uint64(1)) & np.uint64(_EVEN))


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of vectors with 32 packed counts 0 to 2: a difference of 2 stands as the high bit, of 1 as the low."""
    even, one = np.uint64(_EVEN), np.uint64(1)
    low = (a ^ b) & even  # counts of differing parity differ by 1
    two = ((a ^ b) >> one) & even & ~low  # 0 and 2
    return np.bitwise_count(low) + 2 * np.bitwise_count(two)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links among n members: (member, smallest member reachable), where they differ."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    member = np.flatnonzero(root != np.arange(n))
    return member, root[member]


def _cells(distance: int, cell: int):
    """Sorted (grid, key, fp) rows to links: (a, b) of a spanning forest of each cell, or (fp, null) of a full one."""

    def links(run: np.ndarray, fp: np.ndarray):
        """run: number of the cell, ascending."""
        packed, left, right = _packed(fp), [], []
        at = np.arange(len(fp))
        step = 1
        while len(at := at[at + step < len(fp)]) and len(at := at[run[at] == run[at + step]]):
            close = at[_manhattan(packed[at], packed[at + step]) <= distance]
            close = close[np.bitwise_count(fp[close] ^ fp[close + step]) <= distance]
            left.append(close)
            right.append(close + step)
            step += 1
        if not left or not sum(map(len, left)):
            return
        member, root = _forest(np.concatenate(left), np.concatenate(right), len(fp))
        yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)) for x in (member, root)], ["a", "b"])

    def each(batches):
        kept, full = None, False  # rows of the last cell so far; whether that cell is known to be full
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rows[2] = rows[2].view(np.uint64)
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows)]
            new = np.r_[True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)]
            run, first = np.cumsum(new) - 1, np.flatnonzero(new)
            size = np.diff(np.r_[first, len(run)])
            big = size > cell
            big[0] |= full
            last = first[-1]
            done = np.arange(len(run)) < last
            if len(out := rows[2][big[run] & (done | big[-1])]):
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.nulls(len(out), pa.int64())], ["a", "b"])
            some = done & ~big[run] & (size[run] > 1)
            yield from links(run[some], rows[2][some])
            full = bool(big[-1])
            kept = [x[-1:] if full else x[last:] for x in rows]
        if kept is not None and not full and len(kept[0]) > 1:
            yield from links(np.zeros(len(kept[0]), np.int64), kept[2])

    return each


def _dense(fps: DataFrame, distance: int) -> DataFrame:
    """Links among the fingerprints of full cells without pairs: one sends out all values within 1 bit of
    it, another all within `distance` - 1; the two sets meet exactly if both are within `distance`."""
    flips = {d: [_signed(sum(1 << i for i in c)) for k in range(d + 1) for c in combinations(range(64), k)] for d in {1, distance - 1}}
    near = fps.select("fp", F.explode(F.lit(flips[1])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    far = fps.select("fp", F.explode(F.lit(flips[distance - 1])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    meet = near.groupBy("z").agg(F.min("fp").alias("hub"))
    return near.union(far).join(meet, "z").where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct()


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, cell: int = CELL, full: bool = True) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) with the components of "at most `distance` bits differ".

    Pairs of a cell are never written out: each cell gives a spanning forest of its links. Cells of more than
    `cell` fingerprints give their members to `_dense`, which is linear in them; with `full` false they are left to the caller.
    """
    if not 2 <= distance <= 3:
        raise ValueError("the six groups of dimensions hold for 2 or 3 differing bits")
    spark = fps.sparkSession
    keys = F.array(*[F.struct(F.lit(i).alias("grid"), _counts(F.col("fp")).bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(_GRIDS)])
    rows = fps.select("fp", F.explode(keys).alias("k")).select("k.grid", "k.key", "fp")
    rows = rows.repartition(width(spark), "grid", "key").sortWithinPartitions("grid", "key", "fp")
    found = written(rows.mapInArrow(_cells(distance, cell), "a long, b long"), "links")
    links = found.where("b is not null").distinct()
    rest = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    return links if not full or rest.isEmpty() else links.union(_dense(written(rest, "dense"), distance))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, cell: int = CELL) -> DataFrame:
    """`docs` (doc_id, text) to (doc_id, fingerprint, component_id), one row each.

    Linked are documents whose fingerprints differ by at most `distance` bits; component_id is the smallest
    doc_id reachable. Equal fingerprints are one node, so a group of copies of any size costs one row in the
    search. Null and empty texts have fingerprint zero and are linked like any other. Repeated rows come back
    as often; a null doc_id keeps a null doc_id and doesn't count as smallest; other columns, of any name, are ignored; an
    empty table gives no rows. A very long text is read whole in one task, its shingles a part at a time.
    """
    fps = written(fingerprints(docs, words), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = components(fingerprint_links(nodes.select("fp"), distance, cell))
    nodes = nodes.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    roots = nodes.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = nodes.join(roots, "label").select("fp", "component_id")
    out = fps.join(classes, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
