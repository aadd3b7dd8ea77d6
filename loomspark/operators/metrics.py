"""Evaluation of rankings, answers, likelihoods and load, as aggregations."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from loomspark.functions import vector
from loomspark.functions.text import words
from loomspark.operators.batching import sliced
from loomspark.shared import written


def ndcg(run: DataFrame, qrels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`run` (qid, doc_id, rank), `qrels` (qid, doc_id, rel), `queries` (qid) to (qid, ndcg): linear gain, 0 without an ideal."""
    gain = lambda rel, rank: rel / F.log2(rank + 1)
    found = run.where(F.col("rank") <= k).join(qrels, ["qid", "doc_id"], "left").groupBy("qid").agg(F.sum(gain(F.coalesce("rel", F.lit(0)), F.col("rank"))).alias("dcg"))
    best = qrels.where("rel > 0").withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("rel"), "doc_id"))).where(F.col("place") <= k)
    best = best.groupBy("qid").agg(F.sum(gain(F.col("rel"), F.col("place"))).alias("ideal"))
    joined = queries.select("qid").join(found, "qid", "left").join(best, "qid", "left")
    return joined.select("qid", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(F.lit(0.0)).alias("ndcg"))


def recall_at(run: DataFrame, qrels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, recall): relevant documents among the first k of all relevant ones; 0 without any."""
    relevant = qrels.where("rel > 0")
    hits = run.where(F.col("rank") <= k).join(relevant, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    all_ = relevant.groupBy("qid").agg(F.count("*").alias("total"))
    joined = queries.select("qid").join(all_, "qid", "left").join(hits, "qid", "left")
    return joined.select("qid", F.when(F.col("total") > 0, F.coalesce("hits", F.lit(0)) / F.col("total")).otherwise(F.lit(0.0)).alias("recall"))


def class_scores(run: DataFrame, items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`run` (qid, doc_id, rank), `items` (id, label) and `queries` (qid, label), each one of the items, to (qid, ndcg, recall) where the items of a query's label
    but itself are relevant, all alike; queries without one are left out.

    The judgements, as many as pairs of a label, are never rows: the run meets the labels, and of all relevant ones only the number counts.
    """
    sizes = items.where("label is not null").groupBy("label").agg((F.count("*") - 1).alias("total"))  # a row a label
    asked = queries.select("qid", "label").join(F.broadcast(sizes), "label").where("total > 0")
    judged = run.where(F.col("rank") <= k).join(items.select(F.col("id").alias("doc_id"), F.col("label").alias("own")), "doc_id").where("qid <> doc_id").join(asked, "qid")
    found = judged.where("own = label").groupBy("qid").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.count("*").alias("hits"))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(F.col("total"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = asked.join(found, "qid", "left")
    return rows.select("qid", (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"), (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("recall"))


def neighbour_recall(found: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """One row (recall): shared neighbours (qid, id, rank) of all queries over queries times k, also where fewer were found."""
    hits = found.where(F.col("rank") <= k).join(truth.where(F.col("rank") <= k).select("qid", "id"), ["qid", "id"], "left_semi")
    return hits.agg(F.count("*").alias("hits")).crossJoin(queries.agg(F.count("*").alias("n"))).select((F.col("hits") / (F.col("n") * k)).alias("recall"))


@F.arrow_udf(LongType())
def _shared(prediction: pa.Array, answer: pa.Array) -> pa.Array:
    """Tokens that two texts share, each as often as both have it."""

    def lists(column: pa.Array) -> list:
        ends = column.offsets.to_numpy() - column.offsets[0].as_py()
        tokens = column.flatten().to_numpy(zero_copy_only=False).tolist()
        return [tokens[s:e] for s, e in zip(ends, ends[1:])]

    out = []
    for rows in sliced(pa.RecordBatch.from_arrays([prediction, answer], ["p", "a"])):
        out += [sum((Counter(p) & Counter(a)).values()) for p, a in zip(*map(lists, rows.columns))]
    return pa.array(out, pa.int64())


def token_f1(pairs: DataFrame) -> DataFrame:
    """`pairs` (id, gold, prediction, answer; both in normal form) to (id, em, f1), each the best over the golds; (0, 0) without one.

    Two empty texts are an exact match with f1 0. Only the scores are grouped; tokens stay in their row.
    """
    split = lambda c: F.coalesce(words(F.col(c)), F.array().cast("array<string>"))
    rows = pairs.select("id", "prediction", "answer", split("prediction").alias("p"), split("answer").alias("a"))
    rows = rows.select("id", "prediction", "answer", F.size("p").alias("n"), F.size("a").alias("m"), _shared("p", "a").alias("same"))
    p, r = F.col("same") / F.col("n"), F.col("same") / F.col("m")
    f1 = F.when(F.col("same") > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    em = F.coalesce((F.col("prediction") == F.col("answer")).cast("double"), F.lit(0.0))
    return rows.groupBy("id").agg(F.max(em).alias("em"), F.max(f1).alias("f1"))


def corpus_scores(scores: DataFrame) -> DataFrame:
    """(em, f1) of all questions to one row: 100 times the means."""
    return scores.agg(F.count("*").alias("questions"), *((100 * F.avg(c)).alias(c) for c in ("em", "f1")))


#: Ranges of values that one group is cut into, so that no task sorts a group.
RANGES = 256


def percentiles(values: DataFrame, by: list[str], column: str, wanted: list[float]) -> DataFrame:
    """Nearest rank, half away from zero: entry round(p / 100 * (n - 1)) of the sorted values; no interpolation. Nulls don't count.

    Equal values are counted first. A group is cut into ranges of about equal numbers of values (any cuts give the same
    result); the counts of the ranges tell which one holds a rank, and each is sorted by itself.
    """
    one = F.lit(0).alias("_all")
    counted = values.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    counted = written(counted, "counted").withColumn("_all", one)  # read twice
    group = ["_all", *by]
    cuts = counted.groupBy(*group).agg(F.percentile_approx("_value", [i / RANGES for i in range(1, RANGES)], 4 * RANGES).alias("_cuts"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group]
    placed = counted.alias("l").join(cuts.alias("r"), same).select("l.*", F.size(F.filter(F.array_distinct("_cuts"), lambda x: x < F.col("_value"))).alias("_range"))
    placed = written(placed, "placed")
    sums = placed.groupBy(*group, "_range").agg(F.sum("_n").alias("_size"))
    upto = W.partitionBy(*group)  # RANGES rows a group
    sums = sums.select(*group, "_range", (F.sum("_size").over(upto.orderBy("_range")) - F.col("_size")).alias("_before"), F.sum("_size").over(upto).alias("_total"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, "_range"]]
    rows = placed.alias("l").join(sums.alias("r"), same).select("l.*", "_before", "_total")
    last = F.col("_before") + F.sum("_n").over(W.partitionBy(*group, "_range").orderBy("_value"))
    rows = rows.withColumn("_last", last)
    rank = lambda p: F.floor(F.lit(p / 100.0) * (F.col("_total") - 1) + 0.5)
    at = lambda p: F.max(F.when((rank(p) < F.col("_last")) & (rank(p) >= F.col("_last") - F.col("_n")), F.col("_value")))
    return rows.groupBy(*group).agg(*[F.coalesce(at(p), F.lit(0.0)).alias(f"p{p:g}") for p in wanted]).drop("_all")


def chi_square(counts: DataFrame, seen: str, expected: str) -> DataFrame:
    """One row: the sum of (seen - expected)^2 / expected over rows with something expected, and those rows less one."""
    rows = counts.where(F.col(expected) > 0)
    return rows.agg(F.sum(F.pow(F.col(seen) - F.col(expected), F.lit(2)) / F.col(expected)).alias("chi_square"), (F.count("*") - 1).alias("freedom"))


def cosine(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: the cosine of two columns of vectors, all rows taken as one vector each; 0 where one has no length."""
    dot = lambda x, y: F.sum(vector.dot(F.col(x), F.col(y)))
    sums = pairs.agg(dot(a, b).alias("ab"), dot(a, a).alias("aa"), dot(b, b).alias("bb"))
    return sums.select(F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).otherwise(F.lit(0.0)).alias("cosine"))


def perplexity(tokens: DataFrame, context: int) -> DataFrame:
    """`tokens` (seq, pos, logits, target) to (seq, windows, perplexity) over full windows of `context`; the first position of
    each window isn't scored, the rest of a sequence is dropped."""
    most = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - most.cast("double")))
    nll = F.log(total) + most.cast("double") - F.element_at("logits", (F.col("target") + 1).cast("int")).cast("double")
    return windowed_perplexity(tokens.select("seq", "pos", nll.alias("nll")), context)


def windowed_perplexity(scored: DataFrame, context: int) -> DataFrame:
    """The same of `scored` (seq, pos, nll), each position with the negative log of its target's probability."""
    n = F.count("*").over(W.partitionBy("seq"))
    window = F.floor(F.col("pos") / context)
    kept = scored.withColumn("n", n).where((window < F.floor(F.col("n") / context)) & (F.col("pos") % context > 0))
    return kept.groupBy("seq").agg(F.countDistinct(window).alias("windows"), F.exp(F.avg("nll")).alias("perplexity"))


def load_summary(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """`records` (arrival, first, done, tokens, prompt, finish) to one row: duration over all, tokens and latencies of the finished.

    Finished are `length` and `stop`. Time to first token, time a token after it (two tokens at least) and whole time have
    nearest-rank percentiles; a percentile of nothing is 0.
    """
    by = by or []
    ok = F.col("finish").isin("length", "stop")
    rows = records.select(
        *by, "arrival", "done", ok.alias("ok"), F.when(ok, F.col("tokens")).otherwise(0).alias("tokens"), F.when(ok, F.col("prompt")).otherwise(0).alias("prompt"),
        F.when(ok, F.col("first") - F.col("arrival")).alias("ttft"),
        F.when(ok & (F.col("tokens") > 1), (F.col("done") - F.col("first")) / (F.col("tokens") - 1)).alias("tpot"),
        F.when(ok, F.col("done") - F.col("arrival")).alias("e2e"),
    )

    seconds = F.max("done") - F.min("arrival")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("requests"),
        F.sum((~F.col("ok")).cast("long")).alias("failed"),
        seconds.alias("duration"),
        F.sum("tokens").cast("long").alias("output_tokens"),
        F.sum(F.col("tokens") + F.col("prompt")).cast("long").alias("total_tokens"),
    )
    parts = {"ttft": (50, 90, 99), "tpot": (50, 99), "e2e": (50, 99)}
    long = rows.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("_metric"), F.col(c).alias("_x")) for c in parts))).alias("m")).select(*by, "m.*")
    found = percentiles(long, [*by, "_metric"], "_x", [50, 90, 99])
    picked = found.groupBy(*by).agg(*[F.max(F.when(F.col("_metric") == c, F.col(f"p{p}"))).alias(f"{c}_p{p}") for c, ps in parts.items() for p in ps])
    names = [f"{c}_p{p}" for c, ps in parts.items() for p in ps]
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] or F.lit(True)
    joined = sums.alias("l").join(picked.alias("r"), same, "left")
    return joined.select("l.*", *[F.coalesce(F.col(f"r.{c}"), F.lit(0.0)).alias(c) for c in names])
