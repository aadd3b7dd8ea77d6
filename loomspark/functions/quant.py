"""Group-wise integer quantization of vectors, as expressions in DOUBLE."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.vector import let
from loomspark.operators.knn import _vectors

GROUP = 32
# Code ranges and the clips tried for each width.
RANGES = {8: (-127, 127), 4: (-8, 7)}
CLIPS = {8: [1.0, 0.98, 0.96, 0.94, 0.92, 0.9], 4: [1.0, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5]}


def groups(v: Column, size: int = GROUP) -> Column:
    """Consecutive groups of `size` entries."""
    n = F.floor((F.size(v) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(v.cast("array<double>"), i * size + 1, size))


def _codes(group: Column, scale: Column, bits: int) -> Column:
    low, high = RANGES[bits]
    one = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), F.round(x / scale).cast("int")))
    return F.transform(group, lambda x: F.when(scale > 0, one(x)).otherwise(F.lit(0)))


def _error(group: Column, codes: Column, scale: Column, importance: Column | None) -> Column:
    square = lambda x, c: (x - c * scale) * (x - c * scale)
    each = F.zip_with(group, codes, square)
    if importance is not None:
        each = F.zip_with(each, importance, lambda e, w: e * w.cast("double"))
    return F.aggregate(each, F.lit(0.0), lambda s, e: s + e)


def quantized(rows: DataFrame, group: str, bits: int, importance: str | None = None, search: bool = True) -> DataFrame:
    """Adds `scale` and `codes` to rows with a column of one group of values.

    The scale is clip * max|x| / high for the clip with the least squared error, weighted by `importance`, the first of
    equals; a group of zeros has scale and codes 0.
    """
    x = F.col(group)
    weight = F.col(importance) if importance else None

    def tried(clip: float, place: int, most: Column) -> Column:
        def coded(scale: Column) -> Column:
            done = lambda codes: F.struct(_error(x, codes, scale, weight).alias("error"), F.lit(place).alias("place"), scale.alias("scale"), codes.alias("codes"))
            return let(_codes(x, scale, bits), done)

        return let(F.lit(clip) * most / RANGES[bits][1], coded)

    clips = CLIPS[bits] if search else [1.0]
    best = let(F.array_max(F.transform(x, F.abs)), lambda most: F.array_min(F.array(*[tried(c, i, most) for i, c in enumerate(clips)])))
    return rows.withColumn("_best", best).withColumns({"scale": F.col("_best.scale"), "codes": F.col("_best.codes")}).drop("_best")


def dequantized(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: c * scale)


def packed_nibbles(codes: Column) -> Column:
    """Two codes a byte: the even one low, the odd one high, each plus 8."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / 2).cast("int"))
    byte = lambda i: F.get(codes, 2 * i) + 8 + F.shiftleft(F.coalesce(F.get(codes, 2 * i + 1), F.lit(-8)) + 8, 4)
    return F.transform(pairs, byte)


def unpacked_nibbles(packed: Column, n: Column) -> Column:
    both = F.flatten(F.transform(packed, lambda b: F.array(b.bitwiseAND(F.lit(15)) - 8, F.shiftright(b, 4) - 8)))
    return F.slice(both, F.lit(1), n)


def channel_scales(means: DataFrame, alpha: float) -> DataFrame:
    """`means` (channel, mean_abs) to (channel, scale): max(mean, 1e-5) ^ alpha over the root of the largest times the smallest, 1e-4 at least."""
    raw = means.withColumn("raw", F.pow(F.greatest(F.col("mean_abs"), F.lit(1e-5)), F.lit(alpha)))
    ends = raw.agg(F.max("raw").alias("most"), F.min("raw").alias("least"))
    return raw.crossJoin(F.broadcast(ends)).select("channel", F.greatest(F.col("raw") / F.sqrt(F.col("most") * F.col("least")), F.lit(1e-4)).alias("scale"))


def channel_means(vectors: DataFrame) -> DataFrame:
    """`vectors` (embedding) to (channel, mean_abs, mean_square)."""
    entries = vectors.select(F.posexplode(F.col("embedding").cast("array<double>")).alias("channel", "x"))
    return entries.groupBy(F.col("channel").cast("long").alias("channel")).agg(F.avg(F.abs("x")).alias("mean_abs"), F.avg(F.col("x") * F.col("x")).alias("mean_square"))


def bfloat16(bits: Column) -> Column:
    """Bits of a 32-bit float (as a number) rounded to the upper 16, to nearest even; a NaN stays one."""
    nan = (bits.bitwiseAND(F.lit(0x7F800000)) == 0x7F800000) & (bits.bitwiseAND(F.lit(0x7FFFFF)) != 0)
    rounded = F.shiftright(bits + 0x7FFF + F.shiftright(bits, 16).bitwiseAND(F.lit(1)), 16)
    return F.when(nan, F.shiftright(bits, 16).bitwiseOR(F.lit(64))).otherwise(rounded)


#: Exponents that a search tries, and what keeps an importance above 0.
ALPHAS = [i / 10 for i in range(11)]
IMPORTANCE_FLOOR = 1e-8


def _row_of(table: DataFrame, *columns: str) -> DataFrame:
    """One row with an array a column, in order of `channel`: as many entries as a matrix has columns."""

    def entries(column: str) -> Column:
        return F.transform("_c", lambda x: x[column].cast("double")).alias(f"_{column}")

    return table.agg(F.array_sort(F.collect_list(F.struct("channel", *columns))).alias("_c")).select(*map(entries, columns))


def checked(rows: DataFrame, multiple: int = GROUP) -> DataFrame:
    """Rows (row, values) of a matrix; a width that isn't a multiple of the group, or differs, is an error when read."""
    right = (F.size("values") > 0) & (F.size("values") % multiple == 0)
    return rows.withColumn("values", F.when(right, F.col("values")).otherwise(F.raise_error(F.lit(f"the width of a matrix has to be a multiple of {multiple}"))))


def scaled_and_quantized(rows: DataFrame, scales: DataFrame, means: DataFrame, bits: int) -> DataFrame:
    """`rows` (row, values), `scales` (channel, scale) and `means` (channel, mean_square) to (row, part, scale, codes): columns times their
    scales, with errors weighed by mean_square / scale^2."""
    both = _row_of(scales.join(means, "channel"), "scale", "mean_square")
    joined = checked(rows).crossJoin(F.broadcast(both))
    values = F.zip_with("values", "_scale", lambda v, c: v.cast("double") * c)
    weight = F.zip_with("_mean_square", "_scale", lambda m, c: m / (c * c) + IMPORTANCE_FLOOR)
    parts = joined.select("row", F.posexplode(F.arrays_zip(groups(values).alias("x"), groups(weight).alias("w"))).alias("part", "g"))
    return quantized(parts.select("row", "part", F.col("g.x").alias("x"), F.col("g.w").alias("w")), "x", bits, "w").select("row", "part", "scale", "codes")


def gram(inputs: DataFrame) -> np.ndarray:
    """The sums of products of each two channels over all `inputs` (embedding), divided by their number: every batch is one matrix product, and the
    products are added up by row and column."""

    def each(batches):
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column(0))
                g = x.T @ x
                ends = pa.array(np.arange(len(g) + 1, dtype=np.int32) * len(g))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(g))), pa.array(np.full(len(g), batch.num_rows)), pa.ListArray.from_arrays(ends, pa.array(g.ravel()))], ["i", "n", "g"])

    parts = inputs.where("embedding is not null").select(F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(each, "i long, n long, g array<double>")
    sums = parts.select("i", "n", F.posexplode("g").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toArrow()  # as many rows as the square of the width
    width = round(sums.num_rows**0.5)
    out = np.zeros((width, width))
    out[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("x").to_numpy() / sums.column("n").to_numpy()
    return out


def searched_scales(rows: DataFrame, inputs: DataFrame, bits: int) -> DataFrame:
    """(alpha, error), the least error first: of quantizing `rows` (row, values) with the channel scales of each exponent, the mean square
    of what the products with all `inputs` (embedding) change by. Exponent 0 scales nothing.

    With G the mean of the inputs' products of channels, a row that changes by d changes its products by d'Gd in the mean square, so the inputs are read
    once, whatever their number, and the rows once for all exponents."""
    means = channel_means(inputs)
    table = means.orderBy("channel").toPandas()  # a row a channel
    send = rows.sparkSession.sparkContext.broadcast((gram(inputs), table["mean_abs"].to_numpy(), table["mean_square"].to_numpy()))

    def each(batches):
        g, mean_abs, mean_square = send.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x, errors = _vectors(batch.column(0)), []
            for alpha in ALPHAS:
                raw = np.maximum(mean_abs, 1e-5) ** alpha
                scale = np.maximum(raw / np.sqrt(raw.max() * raw.min()), 1e-4)
                off = x - _coded_rows(x * scale, mean_square / (scale * scale) + IMPORTANCE_FLOOR, bits) / scale
                errors.append(float(np.einsum("ri,ij,rj->", off, g, off)))
            yield pa.RecordBatch.from_arrays([pa.array(ALPHAS), pa.array(errors), pa.array([batch.num_rows] * len(ALPHAS), pa.int64())], ["alpha", "error", "n"])

    found = checked(rows).select(F.col("values").cast("array<double>").alias("values")).mapInArrow(each, "alpha double, error double, n long")
    return found.groupBy("alpha").agg((F.sum("error") / F.sum("n")).alias("error")).orderBy("error", "alpha")


def _coded_rows(x: np.ndarray, weight: np.ndarray, bits: int) -> np.ndarray:
    """Rows quantized and turned back, as `quantized` does it by group: of the clips the first with the least weighted error."""
    low, high = RANGES[bits]
    groups_, w = x.reshape(len(x), -1, GROUP), weight.reshape(1, -1, GROUP)
    most, best, out = np.abs(groups_).max(axis=2, keepdims=True), None, None
    for clip in CLIPS[bits]:
        scale = clip * most / high
        ratio = np.divide(groups_, scale, out=np.zeros_like(groups_), where=scale > 0)
        back = np.clip(np.sign(ratio) * np.floor(np.abs(ratio) + 0.5), low, high) * scale
        error = (w * (groups_ - back) ** 2).sum(axis=2, keepdims=True)
        better = np.ones_like(error, bool) if best is None else error < best
        best, out = np.where(better, error, best) if best is not None else error, np.where(better, back, out if out is not None else 0.0)
    return out.reshape(x.shape)
