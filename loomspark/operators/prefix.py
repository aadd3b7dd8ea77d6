"""Reuse of shared prompt prefixes, block by block, with a cache that forgets nothing.

Equality is proved, never hashed: equal blocks of tokens get one number by grouping on the tokens themselves, equal pairs of
neighbours a number by grouping on their two numbers, and so on for runs of 2, 4, 8 blocks: a tree of runs over all prompts. A
prefix is the runs its length is made of in binary, so two prefixes of one length are equal exactly if those numbers are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.shared import written


def _named(rows: DataFrame, *content: str) -> DataFrame:
    """(req_id, at, content) to (req_id, at, run): the first (req_id, at) of all rows with equal content."""
    firsts = rows.groupBy(*content).agg(F.min(F.struct("req_id", "at")).alias("run"))
    return written(rows.join(firsts, list(content)).select("req_id", "at", "run"), "runs")


def runs(blocks: DataFrame) -> list[DataFrame]:
    """`blocks` (req_id, at, tokens) to the levels of the tree, (req_id, at, run) each: level k has the runs of 2^k blocks that start at a multiple
    of it."""
    levels = [_named(blocks, "tokens")]
    while True:
        side = lambda odd: F.max(F.when(F.col("at") % 2 == odd, F.col("run")))
        pairs = levels[-1].groupBy("req_id", F.floor(F.col("at") / 2).alias("at")).agg(side(0).alias("left"), side(1).alias("right")).where("right is not null")
        level = _named(pairs, "left", "right")
        if level.isEmpty():
            return levels
        levels.append(level)


def prefixes(levels: list[DataFrame]) -> DataFrame:
    """(req_id, n, key): for each n the runs that a prompt's first n blocks are made of, the longest first."""
    rows = [level.select("req_id", F.lit(k).alias("k"), "at", "run") for k, level in enumerate(levels)]
    whole = reduce(DataFrame.union, rows).groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("k", "at", "run"))).alias("tree"))  # twice as many as a prompt has blocks
    blocks = F.size(F.filter("tree", lambda x: x["k"] == 0))
    # a level starts in the sorted list behind those below it
    starts = F.aggregate(F.sequence(F.lit(0), F.lit(len(levels))), F.array(F.lit(0)), lambda s, k: F.concat(s, F.array(F.element_at(s, -1) + F.call_function("shiftright", F.col("blocks"), k))))
    whole = whole.withColumn("blocks", blocks).withColumn("starts", starts)

    def key(n):
        bits = F.filter(F.sequence(F.lit(len(levels) - 1), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", n, k).bitwiseAND(F.lit(1)) == 1)
        at = lambda k: F.call_function("shiftright", n, k + 1) * 2
        return F.transform(bits, lambda k: F.element_at("tree", F.element_at("starts", k + 1) + at(k) + 1)["run"])

    return whole.select("req_id", F.explode(F.transform(F.sequence(F.lit(1), F.col("blocks")), lambda n: F.struct(n.alias("n"), key(n).alias("key")))).alias("x")).select("req_id", "x.*")


def block_hits(prompts: DataFrame, block: int) -> DataFrame:
    """`prompts` (req_id, arrival, tokens: array<string>; req_id unique) to (req_id, blocks, hits, cached_tokens).

    A full block is found if an earlier request (by arrival, then req_id) had the same prefix up to its end, and then so are all
    blocks before it. The block that holds the last token is never taken from the cache. Only prompts whose first block another one has
    enter the tree; joins on hot prefixes are split by AQE.
    """
    n = F.greatest(F.floor((F.coalesce(F.size("tokens"), F.lit(0)) - 1) / block), F.lit(0)).cast("int")
    rows = prompts.select("req_id", "arrival", F.col("tokens").cast("array<string>").alias("tokens")).withColumn("blocks", n)
    heads = rows.where("blocks > 0").select("req_id", F.slice("tokens", 1, block).alias("head"))
    shared = heads.groupBy("head").agg(F.count("*").alias("n")).where("n > 1").select("head")
    some = written(heads.join(shared, "head", "left_semi").select("req_id"), "shared")
    cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.slice("tokens", i * block + 1, F.lit(block)))
    blocks = rows.join(some, "req_id", "left_semi").select("req_id", F.posexplode(cut).alias("at", "tokens"))
    levels = runs(blocks)
    each = prefixes(levels).join(rows.select("req_id", "arrival"), "req_id")
    each = written(each.select("n", "key", F.struct("arrival", "req_id").alias("who"), "req_id"), "prefixes")
    firsts = each.groupBy("n", "key").agg(F.min("who").alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    hits = each.join(firsts, ["n", "key"]).where(F.col("who") > F.col("first")).groupBy("req_id").agg(F.count("*").alias("hits"))
    out = rows.select("req_id", F.col("blocks").cast("long").alias("blocks")).join(hits, "req_id", "left")
    return out.select("req_id", "blocks", F.coalesce("hits", F.lit(0).cast("long")).alias("hits")).withColumn("cached_tokens", F.col("hits") * block)
