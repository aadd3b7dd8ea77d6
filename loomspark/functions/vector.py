"""Vector columns (ARRAY<FLOAT> or ARRAY<DOUBLE>) as expressions; sums run in DOUBLE, in array order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

L2, INNER_PRODUCT = "l2", "ip"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _double(x: Column) -> Column:
    return x.cast("double")


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once, also where `use` names it inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y))))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Smaller is nearer: squared Euclid, or the negated inner product."""
    if metric not in (L2, INNER_PRODUCT):
        raise ValueError(f"unknown metric {metric}")
    return squared_l2(a, b) if metric == L2 else -dot(a, b)


def cosine_score(d: Column) -> Column:
    """The score of a distance by inner product between unit vectors."""
    return -d


def usable(d: Column) -> Column:
    """Distances that can enter a top-k: neither NaN nor infinite."""
    return ~F.isnan(d) & (d < float("inf"))


def axpy(s: Column, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: _double(b) + _double(s) * _double(a))


def add(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: _double(a) + _double(b))


def padded(v: Column, multiple: int = 8) -> Column:
    """Zeros up to a multiple, which change no distance."""
    v = v.cast("array<double>")
    return F.concat(v, F.array_repeat(F.lit(0.0), F.pmod(-F.size(v), F.lit(multiple))))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit length; the zero vector stays as it is."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: _double(x) / n)).otherwise(v.cast("array<double>")))


def normalized_floor(v: Column, floor: float = 1e-12) -> Column:
    """Divided by the length or `floor`, whichever is larger."""
    return let(F.greatest(norm(v), F.lit(floor)), lambda n: F.transform(v, lambda x: _double(x) / n))


def rms_norm(v: Column, weight: Column, eps: float = 1e-5) -> Column:
    scale = F.lit(1.0) / F.sqrt(dot(v, v) / F.size(v) + eps)
    return let(scale, lambda s: F.zip_with(v, weight, lambda x, w: _double(x) * s * _double(w)))


def layer_norm(v: Column, weight: Column, bias: Column, eps: float = 1e-12) -> Column:
    mean = _sum(F.transform(v, _double)) / F.size(v)
    centred = let(mean, lambda m: F.transform(v, lambda x: _double(x) - m))

    def scaled(c: Column) -> Column:
        deviation = F.sqrt(_sum(F.transform(c, lambda x: x * x)) / F.size(c) + eps)
        by_weight = let(deviation, lambda d: F.zip_with(c, weight, lambda x, w: x / d * _double(w)))
        return F.zip_with(by_weight, bias, lambda x, b: x + _double(b))

    return let(centred, scaled)


def silu_mul(gate: Column, up: Column) -> Column:
    return F.zip_with(gate, up, lambda g, u: _double(g) / (F.lit(1.0) + F.exp(-_double(g))) * _double(u))


def argmax(v: Column) -> Column:
    """Position from 0 of the largest entry, the first of equals; NaN entries don't count."""
    clean = F.transform(v, lambda x: F.when(F.isnan(x), F.lit(float("-inf"))).otherwise(_double(x)))
    return (F.array_position(clean, F.array_max(clean)) - 1).cast("long")


def float_bytes_base64(v: Column) -> Column:
    """Base64 of the little-endian 32-bit floats of a vector, built from each entry's bit pattern."""
    word = lambda x: F.lpad(F.hex(_bits(x)), 8, "0")
    swapped = F.transform(v, lambda x: F.concat(*[F.substring(word(x), i, 2) for i in (7, 5, 3, 1)]))
    return F.base64(F.unhex(F.array_join(swapped, "")))


def _bits(x: Column) -> Column:
    """Bits of a 32-bit float as a number, from sign, exponent and fraction; NaN is the quiet one without a sign."""
    endless = F.abs(_double(x)) == float("inf")
    a = F.when(F.isnan(x) | endless, 0.0).otherwise(F.abs(_double(x)))
    e = F.greatest(F.floor(F.log2(F.when(a > 0, a).otherwise(F.lit(1.0)))), F.lit(-126))
    # the logarithm can be off by one next to powers of two
    e = F.when(a >= F.pow(F.lit(2.0), e + 1), e + 1).when(a < F.pow(F.lit(2.0), e), F.greatest(e - 1, F.lit(-126))).otherwise(e)
    normal = a >= F.pow(F.lit(2.0), F.lit(-126))
    fraction = F.round(F.when(normal, a / F.pow(F.lit(2.0), e) - 1).otherwise(a / F.pow(F.lit(2.0), F.lit(-126))) * (1 << 23)).cast("long")
    exponent = F.when(normal, e + 127).otherwise(F.lit(0)).cast("long")
    sign = F.when(x.cast("string").startswith("-"), F.lit(1 << 31)).otherwise(F.lit(0)).cast("long")  # of -0.0 too
    number = F.when(a > 0, exponent * (1 << 23) + fraction).when(endless, F.lit(0x7F800000)).otherwise(F.lit(0)).cast("long")
    return F.when(F.isnan(x), F.lit(0x7FC00000).cast("long")).otherwise(sign + number)


# Coefficients of a rational Chebyshev fit of the complementary error function, by ascending power; error below 1.2e-7.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erf(x: Column) -> Column:
    z = F.abs(_double(x))

    def right(t: Column) -> Column:
        power = F.lit(0.0)
        for c in reversed(_ERFC):
            power = power * t + c
        return F.lit(1.0) - t * F.exp(power - z * z)

    return let(F.lit(1.0) / (F.lit(1.0) + z * 0.5), lambda t: F.when(_double(x) >= 0, right(t)).otherwise(-right(t)))


def gelu(x: Column) -> Column:
    """x times the normal distribution function of x."""
    return _double(x) * 0.5 * (F.lit(1.0) + erf(_double(x) / math.sqrt(2.0)))


def pooled(rows: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """(by, mean, cls): the mean of the vectors of a group, entry by entry, and its first vector."""
    first = rows.groupBy(by).agg(F.min_by(F.col(column).cast("array<double>"), order).alias("cls"))
    entries = rows.select(by, F.posexplode(F.col(column).cast("array<double>")).alias("_at", "_x")).groupBy(by, "_at").agg(F.avg("_x").alias("_x"))
    means = entries.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda e: e["_x"]).alias("mean"))
    return means.join(first, by)
