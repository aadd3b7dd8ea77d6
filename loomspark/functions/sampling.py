"""Token sampling over rows of logits, reproducible draws, and speculative acceptance."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_MASK = (1 << 64) - 1


class Random:
    """xorshift64* (fixed shifts 12, 25, 27 and multiplier 0x2545F4914F6CDD1D), for draws that must come out the same everywhere."""

    def __init__(self, seed: int):
        self._state = (seed ^ 0x9E3779B97F4A7C15) & _MASK or 1

    def next(self) -> int:
        x = self._state
        x ^= x >> 12
        x ^= (x << 25) & _MASK
        x ^= x >> 27
        self._state = x
        return (x * 0x2545F4914F6CDD1D) & _MASK

    def uniform(self) -> float:
        return (self.next() >> 11) / (1 << 53)

    def below(self, n: int) -> int:
        return self.next() % n

    def exponential(self, mean: float) -> float:
        return -mean * math.log(1.0 - self.uniform())

    def normal(self) -> float:
        return math.sqrt(-2.0 * math.log(1.0 - self.uniform())) * math.cos(2.0 * math.pi * self.uniform())

    def sample(self, n: int, k: int) -> list[int]:
        """k of 0 to n - 1 without repetition, by a partial shuffle that keeps only the places it moved."""
        moved: dict[int, int] = {}
        out = []
        for i in range(min(k, n)):
            j = i + self.below(n - i)
            out.append(moved.get(j, j))
            moved[j] = moved.get(i, i)
        return out


#: What a request that says nothing is sampled with; temperature 0 takes the likeliest token.
DEFAULTS = {"temperature": 0.0, "top_p": 1.0, "top_k": 0, "seed": 0, "max_tokens": 64, "ignore_eos": False}


def arrivals(seed: int, n: int, rate: float) -> Iterator[float]:
    """Poisson arrival times."""
    rng, t = Random(seed), 0.0
    for _ in range(n):
        t += rng.exponential(1.0 / rate)
        yield t


def workload(spark: SparkSession, seed: int, n: int, rate: float, prompt: tuple[int, int], output: tuple[int, int], shared: int, vocabulary: int) -> DataFrame:
    """A load of n requests (req_id, arrival, prompt_tokens: array<int>, max_tokens): exponential gaps that are summed up by range, lengths
    drawn evenly between two bounds, and `shared` first tokens that all prompts have. Draws are hashes of (seed, request, use), so a request is the same
    whatever task makes it."""
    grains = 1 << 53
    draw = lambda *use: F.pmod(F.xxhash64(F.lit(seed), *use), F.lit(grains)) / grains
    between = lambda low, high, *use: (F.lit(low) + F.floor(draw(*use) * (high - low + 1))).cast("int")
    rows = spark.range(n).select(F.col("id").alias("req_id"), (-F.log(1.0 - draw("id", F.lit("gap"))) / rate).alias("gap"), between(*prompt, "id", F.lit("prompt")).alias("size"), between(*output, "id", F.lit("output")).alias("max_tokens"))
    part = F.floor(F.col("req_id") / 10_000)
    sums = rows.groupBy(part.alias("part")).agg(F.sum("gap").alias("all")).select("part", (F.sum("all").over(W.orderBy("part")) - F.col("all")).alias("before"))
    rows = rows.withColumn("part", part).join(sums, "part")
    arrival = F.col("before") + F.sum("gap").over(W.partitionBy("part").orderBy("req_id"))
    token = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.when(i < shared, F.lit(-1).cast("long")).otherwise(F.col("req_id")), i), F.lit(vocabulary)).cast("int")
    tokens = F.transform(F.sequence(F.lit(0), F.greatest(F.col("size"), F.lit(1)) - 1), token)
    return rows.select("req_id", arrival.alias("arrival"), tokens.alias("prompt_tokens"), "max_tokens")


def distribution(logits: DataFrame, temperature: float = 1.0, top_k: int = 0, top_p: float = 1.0) -> DataFrame:
    """`logits` (row, token, logit) to (row, token, rank, p), the most probable first, equal ones by token.

    top_k (0: all) cuts before the softmax; top_p keeps the first tokens whose sum reaches it, and p sums to 1 again.
    """
    by, order = W.partitionBy("row"), W.partitionBy("row").orderBy(F.desc("scaled"), "token")
    rows = logits.withColumn("scaled", F.col("logit").cast("double") / max(temperature, 1e-5))
    rows = rows.withColumn("rank", F.row_number().over(order).cast("long"))
    if top_k:
        rows = rows.where(F.col("rank") <= top_k)
    rows = rows.withColumn("e", F.exp(F.col("scaled") - F.max("scaled").over(by)))
    rows = rows.withColumn("p", F.col("e") / F.sum("e").over(by))
    upto = F.sum("p").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("upto", upto).where(F.col("upto") - F.col("p") < top_p)
    return rows.select("row", "token", "rank", (F.col("p") / F.sum("p").over(by)).alias("p"))


def draw(probabilities: DataFrame, draws: DataFrame) -> DataFrame:
    """`probabilities` (row, token, rank, p) and `draws` (row, u) to (row, token): the first token whose running sum exceeds
    u times the sum, else the last."""
    order = W.partitionBy("row").orderBy("rank")
    rows = probabilities.withColumn("upto", F.sum("p").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("all", F.sum("p").over(W.partitionBy("row")))
    rows = rows.join(draws, "row")
    first = F.min(F.when(F.col("upto") > F.col("u") * F.col("all"), F.struct("rank", "token")))
    return rows.groupBy("row").agg(F.coalesce(first, F.max(F.struct("rank", "token")))["token"].alias("token"))


def accepted(target: Column, draft: Column, u: Column) -> Column:
    """Whether a drafted token stands: with probability min(1, p / q)."""
    return u < F.when(draft > 0, F.least(F.lit(1.0), target / draft)).otherwise(F.lit(1.0))


def residual(target: DataFrame, draft: DataFrame) -> DataFrame:
    """(row, token, p) of what is drawn from after a rejection: max(p - q, 0), summing to 1; the target's if nothing is left."""
    both = target.select("row", "token", "p").join(draft.select("row", "token", F.col("p").alias("q")), ["row", "token"], "left")
    rest = both.withColumn("r", F.greatest(F.col("p") - F.coalesce("q", F.lit(0.0)), F.lit(0.0))).withColumn("all", F.sum("r").over(W.partitionBy("row")))
    return rest.select("row", "token", F.when(F.col("all") > 0, F.col("r") / F.col("all")).otherwise(F.col("p")).alias("p"))


def dense(sparse: DataFrame, rows: DataFrame, vocabulary: int) -> DataFrame:
    """Sparse (row, token, p) with zeros for all other tokens."""
    every = rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(vocabulary - 1))).alias("token"))
    return every.join(sparse, ["row", "token"], "left").select("row", "token", F.coalesce("p", F.lit(0.0)).alias("p"))


def evenly_spaced(tokens: Column, count: int, length: int) -> Column:
    """`count` runs of `length` entries, starting at equal distances over the array."""
    span = F.greatest(F.size(tokens) - length, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.slice(tokens, F.floor(span * i / count).cast("int") + 1, length))


