"""Batches of texts of about equal lengths, and mergeable samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.shared import written

#: Texts of a batch.
BATCH = 32


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """`rows` with their place from 0 in the order of some columns: dealt out by range, numbered in each range, and the counts of the ranges
    before added (a row a range)."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    sizes = dealt.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    both = dealt.join(F.broadcast(before), F.shiftright("_at", 33) == F.col("_part"))
    return both.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def length_sorted(rows: DataFrame, key: str, length: str, size: int = BATCH) -> DataFrame:
    """`rows` with `batch`, `place` (in it) and `padding` (what the row lacks to the longest of its batch): shortest first, equal ones by `key`, `size`
    to a batch. A batch never holds rows from far apart, so little is padded; results go back to their rows by `key`."""
    placed = numbered(rows, "_place", length, key)
    placed = placed.withColumn("batch", F.floor(F.col("_place") / size)).withColumn("place", F.col("_place") % size).drop("_place")
    longest = F.max(length).over(W.partitionBy("batch"))
    return placed.withColumn("padding", longest - F.col(length))


#: Bytes of a batch whose rows become Python objects at once, about.
SLICE = 1 << 20


def sliced(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `size` bytes each, of a row at least: what a row takes as Python objects is many times its bytes."""
    step = max(1, batch.num_rows * size // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, step):
        yield batch.slice(start, step)


#: Groups of which a task holds rows before it gives them out.
_GROUPS = 4096


def bottom(rows: DataFrame, by: str, key: str, n: int, seed: str = "") -> DataFrame:
    """`rows` with `order`, the n of each group with the least MD5 of `seed` and `key`, equal ones by `key`: a sample that doesn't depend on the order of
    reading. Samples merge: each task keeps n rows a group, and only those meet. Null groups are a group; null keys are left out."""
    rows = rows.where(F.col(key).isNotNull()).withColumn("order", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary")))
    names = rows.columns
    at = [names.index(x) for x in (by, "order", key)]

    def least(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, [(names[i], "ascending") for i in at]))
        group = pc.rank(table.column(at[0]), tiebreaker="dense").to_numpy()  # nulls last, one rank
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.zeros(0, np.int64)
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
        return table.filter(pa.array(place < n))

    def each(batches):
        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = least(part if held is None else pa.concat_tables([held, part]))
            if held.num_rows > n * _GROUPS:
                yield from held.combine_chunks().to_batches()
                held = None
        if held is not None:
            yield from held.combine_chunks().to_batches()

    kept = rows.mapInArrow(each, rows.schema)
    order = W.partitionBy(by).orderBy("order", key)
    return kept.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
