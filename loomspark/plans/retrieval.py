"""Whole evaluations: retrieval over judged queries, index sweeps, and prompts for question answering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.functions.text import grounded_prompt
from loomspark.functions.vector import INNER_PRODUCT
from loomspark.operators import batching, hnsw, ivfpq, kmeans, knn, metrics
from loomspark.shared import written


def judged(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with a judgement."""
    return queries.join(qrels.select("qid").distinct(), "qid", "left_semi")


def ordered(queries: DataFrame) -> DataFrame:
    """`queries` (qid, a text) with `place`, their place from 0 in the order of the bytes of qid."""
    return batching.numbered(queries, "place", "qid")


def evaluated(vectors: DataFrame, queries: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """`vectors` (id, embedding), `queries` (qid, embedding; ids of their own vectors) and `qrels` (qid, doc_id, rel) to one row: the mean
    ndcg and recall over all judged queries of an exact search without the query itself."""
    kept = judged(queries, qrels)
    hits = knn.exact(vectors, kept, k + 1, INNER_PRODUCT).where("id <> qid")
    run = hits.select("qid", F.col("id").alias("doc_id"), F.row_number().over(W.partitionBy("qid").orderBy("distance", "id")).cast("long").alias("rank")).where(F.col("rank") <= k)
    scores = metrics.ndcg(run, qrels, kept, k).join(metrics.recall_at(run, qrels, kept, k), "qid")
    return scores.agg(F.count("*").alias("queries"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("recall"), 6).alias("recall"))


def _recalls(found: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`found` (qid, width, id, distance) to (width, recall): the k nearest of each query and width against `truth` (qid, id, rank)."""
    best = knn.ranked(found, k, "qid", "width")
    hits = best.join(truth.where(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    asked = queries.agg((F.count("*") * k).alias("all"))
    return hits.groupBy("width").agg(F.count("hit").alias("hits")).crossJoin(asked).select("width", (F.col("hits") / F.col("all")).alias("recall"))


def probe_sweep(vectors: DataFrame, queries: DataFrame, centroids, truth: DataFrame, k: int, widths: list[int], metric: str = "l2") -> DataFrame:
    """(width, recall, visited) of searches of the `width` nearest cells, for all widths from one pass; visited: the share of the vectors (id, embedding)
    whose distance a query takes."""
    found = written(ivfpq.cell_candidates(vectors, centroids, queries, k, widths, metric), "candidates")
    each = F.explode(F.filter(F.array(*map(F.lit, widths)), lambda w: w > F.col("turn"))).alias("width")
    sizes = kmeans.assigned(vectors, centroids, metric).groupBy("cell").agg(F.count("*").alias("n"))  # a row a cell
    read = ivfpq.routed(queries, centroids, max(widths), metric).select("qid", "cell", each).join(F.broadcast(sizes), "cell").groupBy("width").agg(F.sum("n").alias("read"))
    whole = queries.agg(F.count("*").alias("queries")).crossJoin(vectors.agg(F.count("*").alias("vectors")))
    share = read.crossJoin(whole).select("width", (F.col("read") / (F.col("queries") * F.col("vectors"))).alias("visited"))
    return _recalls(found.select("qid", "id", "distance", each), truth, queries, k).join(share, "width")


def walk_sweep(index: hnsw.Index, queries: DataFrame, truth: DataFrame, k: int, probes: int, widths: list[int], vectors: int) -> DataFrame:
    """(width, recall, visited) of walks of several widths over graphs that are loaded once; visited: distances taken by a query over all vectors."""
    found = written(hnsw.walked(index, queries, k, probes, widths), "walks")
    best = found.groupBy("qid", "width", "id").agg(F.min("distance").alias("distance"))
    read = found.groupBy("qid", "width", "turn", "part").agg(F.max("visited").alias("n")).groupBy("width").agg(F.sum("n").alias("read"))
    share = read.crossJoin(queries.agg(F.count("*").alias("queries"))).select("width", (F.col("read") / (F.col("queries") * vectors)).alias("visited"))
    return _recalls(best, truth, queries, k).join(share, "width")


def prompts(questions: DataFrame, hits: DataFrame, passages: DataFrame, k: int = 3) -> DataFrame:
    """`questions` (qid, question), `hits` (qid, id, rank), `passages` (id, text) to (qid, prompt) with the k best passages in order; a
    question without hits is asked alone."""
    best = hits.where(F.col("rank") <= k).join(passages, "id").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("found"))
    rows = questions.join(best, "qid", "left").withColumn("found", F.coalesce(F.transform("found", lambda x: x["text"]), F.array().cast("array<string>")))
    return rows.select("qid", grounded_prompt(F.col("question"), F.col("found")).alias("prompt"))
