"""Similarity join of shingle sets under a Jaccard limit: a grouped prefix join.

Shingles are ordered from rare to frequent, by counts over all texts in buckets of their hashes (any order gives the same result).
Two sets that are alike share a shingle of their prefixes, the first few of each in that order. Texts with the same prefix and the same size are
collapsed into one group:

* The lists of the groups that have a shingle in their prefix propose pairs of groups; sizes and places filter them. Short lists give all
  pairs; the groups of a long one are paired with one of them first.
* Pairs of groups, and groups of several sets, are expanded to pairs of their different sets. Bitmaps of parities exclude most that aren't
  alike; all others are verified on the whole sets.
* Sets of a long list that aren't connected by then are compared with each other in blocks, which are dealt out as keys of their
  own, so no task holds a list. A group of very many sets is such a list too. Of each block the pairs nearest by their bitmaps that would
  connect all of it are verified first, then all that still lie between components: a family of near copies takes about as many pairs as
  it has members.

Equal sets are one node from the start, so copies cost one row. Nothing is accepted by chance and no list is cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import bytescan, simhash
from loomspark.llm.components import components
from loomspark.llm.rows import documents
from loomspark.llm.scratch import alone, passing, width, written

#: Members of a list that are all compared at once; of longer lists only those that aren't connected yet. Also the sets of a group that are expanded.
LIST = 16
#: Members of a block of a long list.
BLOCK = 2048
#: Bits of the bucket of a shingle's hash.
BUCKETS = 20
#: Bits of a parity bitmap, and rows that a task gives out at once.
BITS, ROWS = 512, 1 << 16
#: Pairs of shingle sets that are compared at once.
SETS = 64

#: Kinds of rows: a text, a member of a shingle's list, a pair of groups.
_TEXT, _MEMBER, _PAIR = 0, 1, 2
_FOUND = "kind int, a long, b long, node long, size int, place int, bits binary, fp long"
_NODE = ("node", "group", "first", "size", "bits")


@dataclass(frozen=True)
class Alike:
    """Sets of `words`-word shingles, words by a table of `bytescan`, alike if den * shared >= num * all of both."""

    words: int
    num: int
    den: int
    table: bytes

    def set_of(self, data: bytes | None) -> np.ndarray:
        return np.unique(bytescan.shingles(bytescan.words_of(data, self.table), self.words))

    def holds(self, a: np.ndarray, b: np.ndarray) -> bool:
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return self.den * shared >= self.num * (len(a) + len(b) - shared)

    def prefix(self, size: int) -> int:
        """First shingles of a set, of which sets alike share one."""
        return size - -(-self.num * size // self.den) + 1 if size else 0

    def possible(self, n, m, i, j):
        """Whether sets of sizes n, m that first share their i-th and j-th shingles may be alike."""
        n, m = n.astype(np.int64), np.asarray(m, np.int64)
        most = np.minimum(n - i, m - j)
        return (self.den * np.minimum(n, m) >= self.num * np.maximum(n, m)) & ((self.num + self.den) * most >= self.num * (n + m))

    def differ(self, sizes):
        """Shingles in which alike sets of together so many differ at most."""
        return (self.den - self.num) * sizes // (self.den + self.num)


def digest(shingles: np.ndarray, size: int) -> int:
    """64-bit hash of a set and a number, as a signed one."""
    return int(bytescan.mixed(shingles ^ np.uint64(size)).sum(dtype=np.uint64).astype(np.int64))


def parities(shingles: np.ndarray) -> bytes:
    """Bitmap of `BITS`: whether an odd number of shingles falls on a bit. Two sets differ in as many shingles as their bitmaps in bits, at least."""
    return np.packbits(np.bincount((shingles % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def _counts(alike: Alike, bits: int):
    """Texts to (bucket, n): how many shingles of a task's texts, repeats included, fall into each bucket."""

    def each(batches):
        alone()
        total, held, size = np.zeros(1 << bits, np.int64), [], 0
        for batch in batches:
            for data in batch.column(0).to_pylist():
                found = bytescan.shingles(bytescan.words_of(data, alike.table), alike.words)
                held.append((found >> np.uint64(64 - bits)).astype(np.int32))
                size += len(found)
                if size > 1 << bits:
                    total += np.bincount(np.concatenate(held), minlength=1 << bits)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=1 << bits)
        at = np.flatnonzero(total)
        for i in range(0, len(at), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + ROWS].astype(np.int32)), pa.array(total[at[i : i + ROWS]])], ["bucket", "n"])

    return each


def ranks(texts: DataFrame, alike: Alike, bits: int = BUCKETS) -> np.ndarray:
    """Of each bucket of hashes four times the binary logarithm of the count over all texts: a megabyte, whatever the table."""
    sums = texts.select("data").mapInArrow(_counts(alike, bits), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << bits, np.uint8)
    out[sums.column("bucket").to_numpy()] = (4 * np.log2(sums.column("n").to_numpy())).astype(np.uint8) if sums.num_rows else 0
    return out


def _rows(kind: int, a, b, node=None, size=None, place=None, bits=None, fp=None) -> pa.RecordBatch:
    n = len(a)
    size, place = (pa.nulls(n, pa.int32()) if x is None else pa.array(np.asarray(x, np.int32)) for x in (size, place))
    bits = pa.nulls(n, pa.binary()) if bits is None else pa.array(bits, pa.binary())
    a, b, node, fp = (pa.nulls(n, pa.int64()) if x is None else pa.array(np.asarray(x, np.int64)) for x in (a, b, node, fp))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), a, b, node, size, place, bits, fp], ["kind", "a", "b", "node", "size", "place", "bits", "fp"])


def _members(alike: Alike, rank: np.ndarray, fingerprint):
    """(row, data) to texts (row, group, node, size, bitmap) and members (shingle, group, size, place) of the lists of their prefixes."""
    shift = np.uint64(64 - (len(rank) - 1).bit_length())

    def listed(out):
        keys, n = np.concatenate([k for k, _, _ in out]), [len(k) for k, _, _ in out]
        place = np.concatenate([np.arange(x) for x in n])
        return _rows(_MEMBER, keys.view(np.int64), np.repeat([x for _, x, _ in out], n), None, np.repeat([x for _, _, x in out], n), place)

    def each(batches):
        alone()
        seen: set[int] = set()  # groups that this task has listed; told apart again where they meet
        for batch in bytescan.slices(batches, 512):
            nodes, groups, sizes, bits, fps, out, held = [], [], [], [], [], [], 0
            if len(seen) > ROWS:
                seen.clear()
            for data in batch.column(1).to_pylist():
                shingles = alike.set_of(data)
                size = len(shingles)
                first = shingles[np.lexsort((shingles, rank[shingles >> shift]))[: alike.prefix(size)]]
                nodes.append(digest(shingles, size))
                groups.append(digest(first, ~size & 0xFFFFFFFF))
                sizes.append(size)
                bits.append(parities(shingles))
                fps.append(fingerprint(shingles) if fingerprint else 0)
                if size and groups[-1] not in seen:
                    seen.add(groups[-1])
                    out.append((first, groups[-1], size))
                    held += len(first)
                if held > ROWS:
                    yield listed(out)
                    out, held = [], 0
            if out:
                yield listed(out)
            if nodes:
                yield _rows(_TEXT, batch.column(0).to_numpy(), groups, nodes, sizes, None, bits, fps)

    return each


def _pairs(x, y):
    return _rows(_PAIR, np.minimum(x, y), np.maximum(x, y))


def _close(alike: Alike, run, group, size, place):
    """Pairs of members of one list that may be alike; `run` numbers the lists, ascending."""
    at, step = np.arange(len(run)), 1
    while len(at := at[at + step < len(run)]) and len(at := at[run[at] == run[at + step]]):
        close = at[alike.possible(size[at], size[at + step], place[at], place[at + step])]
        for i in range(0, len(close), ROWS):
            yield _pairs(group[close[i : i + ROWS]], group[close[i : i + ROWS] + step])
        step += 1


def _stars(alike: Alike, run, group, size, place):
    """Pairs of each list's members with the least one, which is often the same one in other lists: short paths."""
    if not len(run):
        return
    order = np.lexsort((group, run))
    first = order[np.r_[True, run[order][1:] != run[order][:-1]]]
    hub = np.repeat(first, np.diff(np.r_[np.flatnonzero(np.r_[True, run[1:] != run[:-1]]), len(run)]))
    at = np.flatnonzero(alike.possible(size, size[hub], place, place[hub]) & (hub != np.arange(len(run))))
    yield _pairs(group[at], group[hub[at]])


def _first_pairs(alike: Alike, most: int):
    """Members by (a, size, b) to all pairs of short lists; to a star and the members themselves of long ones. Texts pass."""

    def each(batches):
        kept, full = None, False  # members of the last list so far; whether that list is known to be long
        for batch in batches:
            text = pc.equal(batch.column(0), _TEXT)
            if pc.any(text).as_py():
                yield batch.filter(text)
            batch = batch.filter(pc.invert(text))
            if not batch.num_rows:
                continue
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 4, 5)]
            if kept is not None:
                rows = [np.concatenate(x) for x in zip(kept, rows)]
            # a group that was met in several tasks stands in its lists more than once
            once = np.r_[True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]
            key, group, size, place = rows = [x[once] for x in rows]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            count = np.diff(np.r_[first, len(key)])
            run = np.repeat(np.arange(len(first)), count)
            long = count > most
            long[0] |= full
            done = run < len(first) - 1
            pick = np.flatnonzero(done & ~long[run] & (count[run] > 1))
            yield from _close(alike, run[pick], group[pick], size[pick], place[pick])
            pick = np.flatnonzero(long[run] & (done | long[-1]))
            yield from _stars(alike, run[pick], group[pick], size[pick], place[pick])
            if full:
                pick = pick[1:]  # given out with the batch before
            if len(pick):
                yield _rows(_MEMBER, key[pick], group[pick], None, size[pick], place[pick])
            full = bool(long[-1])
            kept = [x[-1:] if full else x[first[-1] :] for x in rows]
        if kept is not None and not full:
            yield from _close(alike, np.zeros(len(kept[0]), np.int8), *kept[1:])

    return each


def _nearest(a: np.ndarray, b: np.ndarray, far: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (a, b) of a spanning forest over the components `root`, nearest pairs first (Boruvka's way)."""
    order, picked = np.argsort(far, kind="stable"), [np.zeros(0, np.int64)]
    while len(order := order[root[a[order]] != root[b[order]]]):
        x, y, place = root[a[order]], root[b[order]], np.arange(len(order))
        first = np.full(len(root), len(order))
        for ends in (x, y):
            np.minimum.at(first, ends, place)
        pick = np.unique(first[first < len(order)])
        picked.append(order[pick])
        member, least = simhash._forest(x[pick], y[pick], len(root))
        up = np.arange(len(root))
        up[member] = least
        root = up[root]
    return np.concatenate(picked)


def _other_pairs(alike: Alike, nearest: bool):
    """Blocks (key, i, j, block, first, size, place, label, bits) by (key, i, j) to the pairs (x, y) of rows of block i and block j, with different
    labels, that may be alike; with `nearest` only those of a spanning forest."""

    def of(i, j, block, row, size, place, label, bits):
        few, many, far = (np.concatenate(c) for c in zip(*[[np.zeros(0, np.int64)] * 3, *candidates(i, j, block, size, place, label, bits)]))
        if nearest:
            _, first, code = np.unique(label, return_index=True, return_inverse=True)
            pick = _nearest(few, many, far, first[code])
            few, many = few[pick], many[pick]
        for k in range(0, len(few), ROWS):
            yield row[few[k : k + ROWS]], row[many[k : k + ROWS]]

    def candidates(i, j, block, size, place, label, bits):
        """(x, y, distance in shares of the most) of a block, by parts: as many as the block's rows times each other, at most."""
        fold = np.bitwise_xor.reduce(bits, axis=1)
        # labels as numbers by their members here: within a block each is compared with the later ones, the largest with nothing
        _, code, count = np.unique(label, return_inverse=True, return_counts=True)
        at = np.empty(len(count), np.int64)
        at[np.argsort(count, kind="stable")] = np.arange(len(count))
        code = at[code]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        left = left[np.argsort(code[left], kind="stable")]
        for part in np.split(left, np.flatnonzero(np.diff(code[left])) + 1) if len(left) else []:
            mine = code[part[0]]
            others = right[code[right] > mine] if i == j else right[code[right] != mine]
            few, many = (part, others) if len(part) <= len(others) else (others, part)
            for x in few:
                y = many[alike.possible(size[many], size[x], place[many], place[x])]
                limit = alike.differ(size[y].astype(np.int64) + size[x])
                near = np.bitwise_count(fold[y] ^ fold[x]) <= limit
                y, limit = y[near], limit[near]
                differ = np.bitwise_count(bits[y] ^ bits[x]).sum(axis=1, dtype=np.int64)
                near = differ <= limit
                if near.any():
                    yield np.full(near.sum(), x), y[near], differ[near] * 1000 // np.maximum(limit[near], 1)

    def pairs(parts):
        table = pa.Table.from_batches(parts)
        i, j = table.column(1)[0].as_py(), table.column(2)[0].as_py()
        bits = np.frombuffer(b"".join(table.column(8).to_pylist()), np.uint64).reshape(-1, BITS // 64)
        for x, y in of(i, j, *(table.column(c).to_numpy() for c in range(3, 8)), bits):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["x", "y"])

    def each(batches):
        last, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                key = tuple(keys[:, s].tolist())
                if parts and key != last:
                    yield from pairs(parts)
                    parts = []
                last = key
                parts.append(batch.slice(s, e - s))
        if parts:
            yield from pairs(parts)

    return each


def _sets(alike: Alike):
    def each(batches):
        for batch in bytescan.slices(batches, 256):
            sets = [alike.set_of(x).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["row", "shingles"])

    return each


def _verified(alike: Alike):
    def each(batches):
        alone()
        for batch in batches:
            for i in range(0, batch.num_rows, SETS):
                part = batch.slice(i, SETS)
                sets = zip(*(([np.frombuffer(x.as_buffer(), np.uint64) for x in part.column(k)]) for k in (2, 3)))
                yes = [alike.holds(x, y) for x, y in sets]
                yield pa.RecordBatch.from_arrays(part.columns[:2], ["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return each


def _within(alike: Alike):
    """(x, y, sizes, s, t) to the pairs whose bitmaps s, t allow them to be alike."""

    def each(batches):
        for batch in batches:
            s, t = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, BITS // 64) for i in (3, 4))
            yes = np.bitwise_count(s ^ t).sum(axis=1) <= alike.differ(batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["x", "y"]).filter(pa.array(yes))

    return each


def _expanded(pairs: DataFrame, nodes: DataFrame, by: str) -> DataFrame:
    """Pairs (x, y) of nodes or groups to those of different sets: (x, y) as their first rows, with their sizes and bitmaps."""
    x, y = (nodes.select(F.col(by).alias(k), F.col("first").alias(f"{k}_row"), F.col("size").alias(f"{k}_size"), F.col("bits").alias(f"{k}_bits")) for k in "xy")
    both = pairs.join(x, "x").join(y, "y").where("x_row <> y_row and (x <> y or x_row < y_row)")
    return both.select(F.col("x_row").alias("x"), F.col("y_row").alias("y"), (F.col("x_size") + F.col("y_size")).cast("long").alias("sizes"), "x_bits", "y_bits")


def _alike_rows(pairs: DataFrame, texts: DataFrame, alike: Alike) -> DataFrame:
    """Pairs (x, y) of rows to those (a, b) whose shingle sets are alike."""
    pairs = written(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    # written, so that its size is known when the join with the texts is planned
    asked = written(pairs.select(F.col("x").alias("row")).union(pairs.select("y")).distinct(), "asked")
    sets = written(texts.join(asked, "row", "left_semi").select("row", "data").mapInArrow(_sets(alike), "row long, shingles binary"), "shingles")
    both = pairs.join(sets.select(F.col("row").alias("x"), F.col("shingles").alias("s")), "x").join(sets.select(F.col("row").alias("y"), F.col("shingles").alias("t")), "y")
    return written(both.select("x", "y", "s", "t").mapInArrow(_verified(alike), "a long, b long"), "links")


def _blocks(lists: DataFrame, block: int) -> DataFrame:
    """Lists (key, ...) to blocks of members: (key, i, j) holds the members of the blocks i and j, i <= j. Each member stands in as many as its list has blocks."""
    counts = lists.groupBy("key").agg(F.count("*").alias("n"))
    lists = lists.join(counts.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "key")
    lists = lists.withColumn("block", F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return lists.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "first", "size", "place", "label", "bits")


def groups(texts: DataFrame, alike: Alike, fingerprint=None, proposed=None, most: int = LIST, block: int = BLOCK) -> DataFrame:
    """`texts` (row, data), rows unique, to (row, group, size): the smallest row reachable over sets that are alike, and the size of the own set.

    All links are found, but for collisions of 64-bit hashes. Texts with equal sets, empty ones too, are one node, whose smallest row
    stands for it. fingerprint(set) and proposed(nodes (node, fp)) may add pairs (x, y) of nodes to the candidates. Lists of more than
    `most` groups are compared after those that are connected by then are known, `block` members at a time; neither number changes the result.
    """
    spark = texts.sparkSession
    dealt = texts.mapInArrow(_members(alike, ranks(texts, alike), fingerprint), _FOUND)
    dealt = dealt.repartition(width(spark), "kind", "a").sortWithinPartitions("kind", "a", "size", "b")
    found = written(dealt.mapInArrow(_first_pairs(alike, most), _FOUND), "found")
    of = found.where(F.col("kind") == _TEXT).select(F.col("a").alias("row"), F.col("b").alias("group"), "node", "size", "bits", "fp")
    nodes = written(of.groupBy("node").agg(F.min("row").alias("first"), *(F.first(c).alias(c) for c in ("group", "size", "bits", "fp"))), "nodes")
    listed = found.where(F.col("kind") == _PAIR).select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    long = found.where(F.col("kind") == _MEMBER).select(F.col("a").alias("key"), F.col("b").alias("group"), "place")
    several = written(nodes.where("size > 0").groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "several")
    listed = listed.union(several.where(F.col("n") <= most).select(F.col("group").alias("x"), F.col("group").alias("y")))
    full = several.where(F.col("n") > most).select("group")
    if not full.isEmpty():
        # groups of very many sets aren't expanded: they are lists, alone and with each group they are paired with
        left, right = full.select(F.col("group").alias("x")), full.select(F.col("group").alias("y"))
        wide = written(listed.join(left, "x", "left_semi").union(listed.join(right, "y", "left_semi")).distinct(), "wide")
        listed = listed.join(left, "x", "left_anti").join(right, "y", "left_anti")
        key, none = F.xxhash64("x", "y").alias("key"), F.lit(0).alias("place")
        more = full.select(F.col("group").alias("key"), "group", none).union(wide.select(key, "x", none)).union(wide.select(key, "y", none))
        long = written(long.union(more), "long")
        hubs = more.join(nodes.select("group", "node"), "group").select("key", "node")
        hubs = hubs.join(hubs.groupBy("key").agg(F.min("node").alias("hub")), "key").where("node <> hub")
        stars = _expanded(hubs.select(F.col("node").alias("x"), F.col("hub").alias("y")).distinct(), nodes, "node")
    else:
        stars = None
    pairs = _expanded(listed, nodes, "group")
    if stars is not None:
        pairs = pairs.union(stars)
    if proposed is not None:
        pairs = pairs.union(_expanded(proposed(nodes.select("node", "fp")).distinct(), nodes, "node"))
    links = _alike_rows(pairs.mapInArrow(_within(alike), "x long, y long"), texts, alike)
    labels = written(components(links), "labels").withColumnRenamed("node", "first")
    for nearest in () if long.isEmpty() else (True, False):
        known = nodes.join(labels, "first", "left").select("first", "group", "size", F.coalesce("label", "first").alias("label"), "bits")
        # lists within one component have nothing left to compare
        spread = known.groupBy("group").agg(F.min("label").alias("l"), F.max("label").alias("h"))
        open_ = long.join(spread, "group").groupBy("key").agg(F.min("l").alias("l"), F.max("h").alias("h")).where("l <> h").select("key")
        lists = written(long.join(open_, "key", "left_semi").join(known, "group").select("key", "first", "size", "place", "label", "bits"), "lists")
        blocks = _blocks(lists, block).repartition(width(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")
        others = blocks.mapInArrow(_other_pairs(alike, nearest), "x long, y long")
        stars = labels.select(F.col("first").alias("a"), F.col("label").alias("b"))
        labels = written(components(stars.union(_alike_rows(others, texts, alike))), "labels").withColumnRenamed("node", "first")
    nodes = nodes.join(labels, "first", "left").select("node", F.coalesce("label", "first").alias("group"))
    return of.select("row", "node", "size").join(nodes, "node").select("row", "group", "size")


#: The join's own limit: four-word shingles of words between white space, 85 of 100 shared.
ALIKE = Alike(4, 85, 100, bytescan.SPACED)


def linked(docs: DataFrame, alike: Alike = ALIKE, most: int = LIST, block: int = BLOCK) -> DataFrame:
    """`docs` (doc_id, text) to (doc_id, n_shingles, component_id), one row each.

    Linked are documents whose sets of distinct shingles are alike; a text of fewer words than a shingle is one shingle as a whole;
    component_id is the smallest doc_id reachable, itself included. Null, empty and wordless texts have no shingles and are linked with nothing.
    Repeated rows come back as often, linked with each other; a null doc_id stays and doesn't count as smallest, but
    for a component of null ids, which has none; texts of any length are compared whole; other columns, of any name, are ignored; an empty table
    gives no rows.
    """
    with passing(docs.sparkSession):
        known = documents(docs)
        found = groups(known.select("row", "data"), alike, most=most, block=block)
        found = found.select("row", F.when(F.col("size") > 0, F.col("group")).otherwise(F.col("row")).alias("group"), F.col("size").cast("long").alias("n_shingles"))
        if known.where("doc_id is null or row <> doc_id").isEmpty():
            out = found.select(F.col("row").alias("doc_id"), "n_shingles", F.col("group").alias("component_id"))
        else:
            found = written(found.join(known.select("row", "doc_id"), "row"), "linked")
            roots = found.groupBy("group").agg(F.min("doc_id").alias("component_id"))
            out = found.join(roots, "group").select("doc_id", "n_shingles", "component_id")
        out = written(out, "components")
    return out
