"""Small cases with known results."""

import base64
import hashlib
import json
import math
import struct

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as driver
from loomspark.functions import quant, requests, sampling, text, unicode, vector
from loomspark.operators import batching, chunk, hnsw, ivfpq, kmeans, knn, metrics, prefix, tokens
from loomspark.sources import text as text_source
from loomspark.sources import versions
from loomspark.sources import vectors as vector_source
from loomspark.streaming import detokenize


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_distances(spark):
    zeros, ones, twos = (F.array_repeat(F.lit(v), 8) for v in (0.0, 1.0, 2.0))
    assert one(spark, vector.distance("l2", zeros, ones)) == 8
    assert one(spark, vector.distance("ip", ones, twos)) == -16
    with pytest.raises(ValueError):
        vector.distance("cosine", ones, twos)
    assert one(spark, vector.normalized(zeros)) == [0.0] * 8
    assert one(spark, vector.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    values = [1.0, -2.5, 0.0, 3.1415927, 1e-40, 65504.0]
    assert one(spark, vector.float_bytes_base64(F.array(*[F.lit(v).cast("float") for v in values]))) == base64.b64encode(struct.pack("<6f", *values)).decode()


def test_top_k_order(spark):
    rows = spark.createDataFrame([(0, i, d) for i, d in enumerate([7.5, 0.5, 0.5, 6.0, 2.25, 8.0, 3.0])], "qid int, id long, distance double")
    assert [r.id for r in knn.ranked(rows, 4, "qid").orderBy("rank").collect()] == [1, 2, 4, 6]


def test_exact_search_skips_unusable_distances(spark):
    base = spark.createDataFrame([(0, [1.0, 0.0]), (1, [float("nan"), 0.0]), (2, [float("inf"), 0.0]), (3, None), (4, [0.0, 1.0])], "id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, embedding array<double>")
    assert [(r.id, r.distance) for r in knn.exact(base, q, 5).orderBy("rank").collect()] == [(0, 0.0), (4, 2.0)]


def test_ranking_metrics(spark):
    qrels = spark.createDataFrame([(q, d, 1) for q in (1, 2, 3) for d in "pq"], "qid int, doc_id string, rel int")
    run = spark.createDataFrame([(q, d, i + 1) for q, ds in ((1, "qpr"), (2, "rpz"), (3, "rs")) for i, d in enumerate(ds)], "qid int, doc_id string, rank long")
    queries = qrels.select("qid").distinct()
    got = {r.qid: r.ndcg for r in metrics.ndcg(run, qrels, queries, 10).collect()}
    second = 1 / math.log2(3)
    assert got[1] == pytest.approx(1) and got[2] == pytest.approx(second / (1 + second)) and got[3] == 0
    run = spark.createDataFrame([(1, d, i + 1) for i, d in enumerate("rqp")], "qid int, doc_id string, rank long")
    assert {r.qid: r.recall for r in metrics.recall_at(run, qrels, queries, 2).collect()} == {1: 0.5, 2: 0, 3: 0}


def test_answers(spark):
    cases = {1: "Lake Garda.", 2: "the Garda of Lake", 3: "Como", 4: ""}
    golds = ["the Lake Garda", "Garda"]
    rows = [(i, g, p, a) for i, p in cases.items() for g, a in enumerate(golds if i < 4 else [""])]
    df = spark.createDataFrame(rows, "id int, gold int, prediction string, answer string")
    df = df.select("id", "gold", *[text.answer_normal_form(F.col(c)).alias(c) for c in ("prediction", "answer")])
    got = {r.id: (r.em, round(r.f1, 6)) for r in metrics.token_f1(df).collect()}
    assert got == {1: (1, 1), 2: (0, 0.8), 3: (0, 0), 4: (1, 0)}


def test_splits(spark):
    assert one(spark, text.gpt2_split(F.lit("Good day's  1999??  \n y"))) == ["Good", " day", "'s", " ", " 1999", "??", "  \n", " y"]
    assert one(spark, text.llama3_split(F.lit("WE'LL buy 98765 then.\n\n  go"))) == ["WE", "'LL", " buy", " ", "987", "65", " then", ".\n\n", " ", " go"]
    assert one(spark, text.until_stop(F.lit("abc END x STOP"), ["STOP", "END"])) == "abc "
    assert one(spark, text.size_bytes(F.lit("1.5K"))) == 1536


def test_sampling(spark):
    logits = spark.createDataFrame([(0, t, v) for t, v in enumerate([1.5, 1.0, 0.2, -2.0])], "row int, token int, logit double")
    got = sampling.distribution(logits, top_k=3, top_p=0.95).orderBy("rank").collect()
    assert [r.token for r in got] == [0, 1, 2] and sum(r.p for r in got) == pytest.approx(1)
    sample = sampling.Random(3).sample(50, 20)
    assert len(set(sample)) == 20 and max(sample) < 50
    assert np.mean(list(np.diff(list(sampling.arrivals(1, 4000, 2.0))))) == pytest.approx(0.5, rel=0.1)


def test_speculative_sampling_keeps_the_target(spark):
    """Accepting drafted tokens and drawing from what is left gives the target's frequencies."""
    p, q, n = [0.5, 0.3, 0.2], [0.2, 0.6, 0.2], 6000
    rng, counts = sampling.Random(11), [0, 0, 0]
    rest = [max(a - b, 0) for a, b in zip(p, q)]
    for _ in range(n):
        u, t = rng.uniform(), 0
        while u > sum(q[: t + 1]):
            t += 1
        if rng.uniform() >= min(1, p[t] / q[t]):
            u, t = rng.uniform() * sum(rest), 0
            while u > sum(rest[: t + 1]):
                t += 1
        counts[t] += 1
    assert sum((c - n * a) ** 2 / (n * a) for c, a in zip(counts, p)) < 13.8


def test_percentiles_of_few_values(spark):
    df = spark.createDataFrame([("a", v) for v in (4.0, 1.0, 3.0, 2.0)] + [("b", 7.0)], "k string, v double")
    got = {r.k: (r.p50, r.p99) for r in metrics.percentiles(df, ["k"], "v", [50, 99]).collect()}
    assert got == {"a": (3.0, 4.0), "b": (7.0, 7.0)}


def test_chunks():
    assert chunk.spans([2] * 7, 6, 2) == [(0, 3), (2, 5), (4, 7)]
    assert chunk.spans([8, 2, 1], 3, 6) == [(0, 1), (1, 3)]
    assert chunk.spans([3, 3], 3, 7) == [(0, 1), (1, 2)] and chunk.spans([], 3, 1) == []


def test_quantization(spark):
    x = [0.0] * 32
    rows = spark.createDataFrame([(0, x), (1, [float(i - 16) for i in range(32)])], "i int, x array<double>")
    got = {r.i: r for r in quant.quantized(rows, "x", 8).collect()}
    assert got[0].scale == 0 and set(got[0].codes) == {0} and max(abs(c) for c in got[1].codes) <= 127
    error = {b: quant.quantized(rows, "x", b).withColumn("y", quant.dequantized(F.col("codes"), F.col("scale"))).where("i = 1").select(vector.squared_l2(F.col("x"), F.col("y")).alias("e")).first().e for b in (8, 4)}
    assert error[4] > 4 * error[8]
    bits = struct.unpack("<I", struct.pack("<f", 1.00390625))[0]
    assert one(spark, quant.bfloat16(F.lit(bits))) == 0x3F80
    assert one(spark, quant.bfloat16(F.lit(0x7F800001))) & 0x7F != 0


def _clustered(spark, n, dim):
    rng = np.random.default_rng(12345 + dim)
    centres = rng.normal(size=(20, dim)) * 3
    x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dim))
    q = centres[rng.integers(0, 20, 40)] + rng.normal(size=(40, dim))
    frame = lambda m, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, embedding array<double>")
    return frame(x, "id"), frame(q, "qid")


def test_approximate_search(spark):
    base, queries = _clustered(spark, 2000, 32)
    truth = knn.exact(base, queries, 10).cache()
    recall = lambda found: metrics.neighbour_recall(found, truth, queries, 10).first().recall
    index = ivfpq.trained(base.where("id < 800"), 16, 8, 64, 4)
    graphs = hnsw.built(base, index.centroids, width=80, copies=2)
    graphs.nodes = graphs.nodes.cache()
    wide = recall(hnsw.search(graphs, queries, 10, 7, width=128))
    assert wide >= 0.95 and wide >= recall(hnsw.search(graphs, queries, 10, 7, width=10)) >= recall(hnsw.search(graphs, queries, 10, 1, width=10))
    assert hnsw.mean_degree(graphs).first().degree > 8
    assert all(r.reached >= 0.95 * r.vectors for r in hnsw.reachable(graphs).collect())
    index.entries = ivfpq.encoded(base, index).cache()
    plain = recall(ivfpq.search(index, queries, 10, 8))
    refined = recall(ivfpq.search(index, queries, 10, 8, 10, base))
    assert refined > 0.9 and refined > plain >= recall(ivfpq.search(index, queries, 10, 1))
    assert index.bytes_per_vector == 12


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_lookup_tables_give_the_distances_of_coded_vectors(spark, metric):
    """And however entries and queries are dealt out: the sums of table entries are the distances of what the codes stand for."""
    base, queries = _clustered(spark, 300, 16)
    index = ivfpq.trained(base, 4, 4, 16, 1, metric)
    index.entries = ivfpq.encoded(base, index).cache()
    entries, q = index.entries.collect(), {r.qid: np.array(r.embedding) for r in queries.collect()}
    back = {r.id: (r.cell, index.centroids[r.cell] + np.concatenate([index.codewords[j][c] for j, c in enumerate(r.codes)])) for r in entries}
    far = (lambda x, y: -(x @ y)) if metric == "ip" else (lambda x, y: ((x - y) ** 2).sum())
    want = {}
    for i, x in q.items():
        near = np.argsort(knn.distances(x[None], index.centroids, metric)[0], kind="stable")[:2]
        want[i] = sorted((round(far(x, y), 8), v) for v, (c, y) in back.items() if c in near)[:5]
    for part, block in ((1 << 16, 4096), (20, 3)):
        got = {}
        for r in ivfpq.search(index, queries, 5, 2, part=part, block=block).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append((round(r.distance, 8), r.id))
        assert {i: [d for d, _ in x] for i, x in got.items()} == {i: [d for d, _ in x] for i, x in want.items()}


def test_a_saved_graph_index_reads_the_cells_of_its_queries(spark, tmp_path):
    base, queries = _clustered(spark, 600, 16)
    centroids = ivfpq.trained(base, 8, 4, 4, 2).centroids
    index = hnsw.built(base, centroids, width=60, copies=2)
    hnsw.saved(index, f"{tmp_path}/graphs")
    kept = hnsw.loaded(spark, f"{tmp_path}/graphs")
    assert kept.nodes.count() == 1200
    want = [tuple(r) for r in hnsw.search(index, queries, 5, 3, 64).orderBy("qid", "rank").collect()]
    assert [tuple(r) for r in hnsw.search(kept, queries, 5, 3, 64).orderBy("qid", "rank").collect()] == want
    # some cells go, those that one query isn't routed to: its neighbours stay the same
    one = queries.where("qid = 7")
    cells = [r.cell for r in ivfpq.routed(one, centroids, 3, "l2").collect()]
    assert len(cells) == 3
    kept.nodes = kept.nodes.where(F.col("cell").isin(cells))
    assert [tuple(r) for r in hnsw.search(kept, one, 5, 3, 64).orderBy("rank").collect()] == [r for r in want if r[0] == 7]


def test_very_many_equal_vectors_are_cut_into_parts(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SHARD", 50)
    base = spark.createDataFrame([(i, [1.0, 2.0] if i < 180 else [float(i), 0.5]) for i in range(220)], "id long, embedding array<double>")
    index = hnsw.built(base, np.array([[1.0, 2.0], [200.0, 0.5]]), m=4, width=20, copies=1)
    index.nodes = index.nodes.cache()
    sizes = {(r.cell, r.part): r["count"] for r in index.nodes.groupBy("cell", "part").count().collect()}
    assert len(sizes) == 5 and max(sizes.values()) < 75
    found = hnsw.search(index, spark.createDataFrame([(1, [205.2, 0.5])], "qid long, embedding array<double>"), 3, 1, 20)
    assert [r.id for r in found.orderBy("rank").collect()] == [205, 206, 204]


def test_versions_of_a_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda a, b: spark.range(a, b).selectExpr("id as x", "concat('v', id) as name").repartition(3)
    assert versions.appended(rows(0, 10), path, ["x"]) == (0, 10)
    assert versions.appended(rows(50, 50), path, ["x"]) == (10, 0)
    assert versions.appended(rows(20, 25), path, ["x"]) == (10, 5)
    assert versions.length(spark, path) == 15
    want = [(i, i if i < 10 else i + 10) for i in range(15)]
    assert sorted((r.id, r.x) for r in versions.read(spark, path).collect()) == want
    assert sorted((r.id, r.x) for r in versions.read(spark, path, 1).collect()) == want[:10]
    with pytest.raises(ValueError, match="no such version"):
        versions.read(spark, f"{tmp_path}/none")


def test_appends_at_the_same_time_take_different_numbers(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = f"{tmp_path}/t"
    add = lambda i: versions.appended(spark.range(7).selectExpr("id as x", f"{i} as writer"), path, ["x"])
    with ThreadPoolExecutor(4) as pool:
        taken = sorted(pool.map(add, range(6)))
    assert taken == [(7 * i, 7) for i in range(6)]
    got = versions.read(spark, path).collect()
    assert sorted(r.id for r in got) == list(range(42))
    for first, _ in taken:
        mine = sorted((r.id, r.x, r.writer) for r in got if first <= r.id < first + 7)
        assert [x for _, x, _ in mine] == list(range(7)) and len({w for *_, w in mine}) == 1
    # a draft that lost, or a folder without a version, is never seen
    spark.range(3).selectExpr("id as x", "9 as writer", "id as _at").write.parquet(f"{path}/data/batch=lost")
    assert versions.read(spark, path).count() == 42


def test_empty_cells_split_the_largest(spark):
    df = spark.createDataFrame([(i, [float(i % 2) * 10 + i / 100]) for i in range(40)], "id long, embedding array<double>")
    got = kmeans.train(df, np.array([[0.0], [10.0], [1000.0]]), 5)
    assert len(np.unique(got.round(3))) == 3 and got.max() < 11


def test_prefix_blocks(spark):
    df = spark.createDataFrame([(1, 0.0, [1, 2, 3, 4, 5]), (2, 1.0, [1, 2, 3, 4, 6]), (3, 2.0, [1, 2, 9, 9, 1]), (4, 3.0, [1, 2])], "req_id int, arrival double, tokens array<int>")
    got = {r.req_id: (r.blocks, r.hits) for r in prefix.block_hits(df, 2).collect()}
    assert got == {1: (2, 0), 2: (2, 2), 3: (2, 1), 4: (0, 0)}


def test_word_pieces(spark):
    vocabulary = {t: i for i, t in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "cafe", "!"])}
    df = spark.createDataFrame([(1, "Unaffable café!"), (2, "zzz"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokens.word_pieces(df, vocabulary).collect()}
    assert got == {1: [1, 3, 4, 5, 6, 7, 2], 2: [1, 0, 2], 3: [1, 2]}
    assert one(spark, unicode.nfc(F.lit("é"))) == "é" and one(spark, unicode.nfd(F.lit("é"))) == "é"


def test_byte_bpe_is_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 20")
    run = Tokenizer.from_file(path)
    want = {r.doc_id: run.encode(r.text, add_special_tokens=False).ids for r in df.collect()}
    assert {r.doc_id: r.ids for r in tokens.byte_bpe(df, path).collect()} == want


def test_text_sources(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id":"a","title":"T","text":"x"}\n\n{"_id":"b","text":"y"}\n')
    assert [(r.doc_id, r.text) for r in text_source.corpus(spark, str(tmp_path / "c.jsonl")).orderBy("doc_id").collect()] == [("a", "T x"), ("b", "y")]
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t1\n1\ta\t2\n1\tb\tx\n2\tc\n3\td\t-4\n")
    got = {(r.qid, r.doc_id): r.rel for r in text_source.qrels(spark, str(tmp_path / "q.tsv")).collect()}
    assert got == {("1", "a"): 2, ("1", "b"): 0, ("3", "d"): 0}
    lines = [{"question": f"q{i}", "context": c, "answers": ["x"]} for i, c in enumerate(["two", "one", "two"])]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, lines)))
    contexts, questions = text_source.question_set(spark, str(tmp_path / "s.jsonl"))
    assert {r.context: r.context_id for r in contexts.collect()} == {"two": 0, "one": 1}
    assert [r.context_id for r in questions.orderBy("at").collect()] == [0, 1, 0]
    text_source.append_json_lines(contexts, str(tmp_path / "out"))
    text_source.append_json_lines(contexts, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


def test_vector_files(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "x.fvecs").write_bytes(b"".join(struct.pack("<i", 3) + r.tobytes() for r in x))
    got = vector_source.fvecs(spark, str(tmp_path / "x.fvecs")).orderBy("id").collect()
    assert [r.embedding for r in got] == x.tolist()
    assert vector_source.fvecs(spark, str(tmp_path / "x.fvecs"), 2).count() == 2
    head = json.dumps({"w": {"dtype": "BF16", "shape": [2], "data_offsets": [0, 4]}, "n": {"dtype": "I64", "shape": [1], "data_offsets": [4, 12]}, "__metadata__": {}}).encode()
    (tmp_path / "m.tensors").write_bytes(struct.pack("<Q", len(head)) + head + bytes([0x80, 0x3F, 0x00, 0xC0]) + bytes(8))
    r = vector_source.tensors(spark, str(tmp_path / "m.tensors"), True).collect()
    assert [(t.name, t.dtype, t.shape, t.data) for t in r] == [("w", "BF16", [2], [1.0, -2.0])]


def test_vector_files_in_ranges(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(1000, 7)).astype("<f4")
    raw = np.column_stack([np.full(1000, 7, "<i4"), x.view("<i4")]).tobytes()
    (tmp_path / "x.fvecs").write_bytes(raw)
    read = vector_source.fvecs(spark, f"{tmp_path}/x.fvecs", size=5000)
    assert read.rdd.getNumPartitions() == 7  # 156 records of 32 bytes each
    assert np.array_equal(np.array([r.embedding for r in read.orderBy("id").collect()], "<f4"), x)
    few = vector_source.fvecs(spark, f"{tmp_path}/x.fvecs", 200, 5000)
    assert few.rdd.getNumPartitions() == 2 and sorted(r.id for r in few.collect()) == list(range(200))
    (tmp_path / "i.ivecs").write_bytes(struct.pack("<iii", 2, -5, 6) * 3)
    assert [r.neighbors for r in vector_source.ivecs(spark, f"{tmp_path}/i.ivecs").collect()] == [[-5, 6]] * 3
    for name, bad in (("long", raw + b"x"), ("empty", b""), ("zero", struct.pack("<i", 0)), ("ragged", struct.pack("<ifif", 1, 1.0, 2, 1.0))):
        (tmp_path / name).write_bytes(bad)
        with pytest.raises(Exception, match="vector file|dimension"):
            vector_source.fvecs(spark, f"{tmp_path}/{name}").collect()
    with pytest.raises(ValueError, match="no file"):
        vector_source.fvecs(spark, f"{tmp_path}/none*")
    vector_source.write_fvecs(read.repartition(3), "embedding", f"{tmp_path}/out")
    again = vector_source.fvecs(spark, f"{tmp_path}/out")
    assert sorted(tuple(r.embedding) for r in again.collect()) == sorted(map(tuple, x.tolist()))
    assert len(list((tmp_path / "out").glob("*.fvecs"))) == 3
    with pytest.raises(Exception, match="one positive dimension"):
        vector_source.write_fvecs(spark.sql("SELECT explode(array(array(1f), array(1f, 2f), array(3f))) AS v").coalesce(1), "v", f"{tmp_path}/ragged_out")
    assert not list((tmp_path / "ragged_out").rglob("*.fvecs"))


def test_tensor_files_over_several_shards(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"t{i}", ["F32", "F16", "BF16"][i % 3], shape, rng.normal(size=int(np.prod(shape))).astype("<f4").tolist()) for i, shape in enumerate([[3, 4], [5], [2, 2, 2], [0], [1000], []])]
    df = spark.createDataFrame(rows, "name string, dtype string, shape array<long>, data array<float>").repartition(4, "name")
    vector_source.write_tensors(df, f"{tmp_path}/m")
    index = {r.name: r.file for r in vector_source.index_of(spark, f"{tmp_path}/m").collect()}
    files = {p.name for p in (tmp_path / "m").glob("*.safetensors")}
    assert set(index) == {r[0] for r in rows} and set(index.values()) == files and len(files) > 1
    heads = {r.name: (r.dtype, r.shape, r.path.rsplit("/", 1)[1]) for r in vector_source.tensors(spark, f"{tmp_path}/m").collect()}
    assert heads == {n: (d, s, index[n]) for n, d, s, _ in rows}
    got = {}
    for r in vector_source.tensors(spark, f"{tmp_path}/m", True, 256).orderBy("name", "at").collect():
        assert r.at == len(got.setdefault(r.name, []))
        got[r.name] += r.data
    for name, dtype, _, data in rows:
        want = np.array(data, "<f4")
        step = {"F32": 0, "F16": 2e-3, "BF16": 8e-3}[dtype]
        assert np.allclose(got[name], want, rtol=step, atol=1e-4 if step else 0) and np.array_equal(vector_source.decoded(vector_source.raw_of(np.array(got[name], "<f4"), dtype), dtype), np.array(got[name], "<f4"))
    bad = spark.createDataFrame([*rows[:3], ("short", "F32", [9], [1.0])], df.schema).repartition(4, "name")
    with pytest.raises(Exception, match="wrong dtype or byte length"):
        vector_source.write_tensors(bad, f"{tmp_path}/bad")
    assert not [p for p in (tmp_path / "bad").rglob("*.safetensors")] and not (tmp_path / "bad" / "model.safetensors.index.json").exists()


def test_bytes_of_small_floats():
    x = np.array([1.0, 1 + 2**-8, 1 + 3 * 2**-8, -0.0, np.inf, np.nan, 3.4e38], "<f4")
    back = vector_source.decoded(vector_source.raw_of(x, "BF16"), "BF16")
    assert back[:5].tolist() == [1.0, 1.0, 1 + 2**-6, -0.0, np.inf] and np.isnan(back[5]) and np.isinf(back[6])


def test_detokenizing_in_parts():
    data, stops = "héllo 😀 world. STOP no".encode(), ["STOP", ". X"]
    for size in (1, 2, 3, 7):
        out, held, stopped = "", b"", False
        cuts = [data[i : i + size] for i in range(0, len(data), size)]
        for i, part in enumerate(cuts):
            new, held, stopped = detokenize.emitted(held, stopped, part, stops, i == len(cuts) - 1)
            out += new
            assert "STOP"[: len(out)] != out[-4:] or not out.endswith("STOP")
        assert out == "héllo 😀 world. " and stopped


def test_detokenizing_stream(spark, tmp_path):
    rows = [(r, i, bytes([b]), i == 6) for r in (1, 2) for i, b in enumerate("ab é!E".encode())]
    for k, part in enumerate((rows[:5] + rows[7:9], rows[5:7] + rows[9:])):
        spark.createDataFrame(part, "req_id long, seq long, data binary, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("req_id long, seq long, data binary, last boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = detokenize.texts(source, ["!E"]).writeStream.format("memory").queryName("detokenized").option("checkpointLocation", str(tmp_path / "at")).start()
    run.processAllAvailable()
    run.stop()
    got = {}
    for r in spark.table("detokenized").collect():
        got.setdefault(r.req_id, []).append(r.text)
    assert {k: sorted("".join(v)) for k, v in got.items()} == {k: sorted("ab é") for k in (1, 2)}


def test_driver_contract(spark):
    assert driver.entry(spark).count() == 1
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_trim_is_unicode(spark):
    assert one(spark, text.first_line(F.lit("\n\u00a0\u2003Lyon \t\nnext"))) == "Lyon"
    assert one(spark, text.trimmed(F.lit("\x85 a b\u3000"))) == "a b"
    assert one(spark, text.sse_stream(F.array(F.lit("x"), F.lit("y")))) == "data: x\n\ndata: y\n\ndata: [DONE]\n\n"


def test_text_helpers(spark):
    assert one(spark, text.byte_level(F.lit("hi you"), prefix_space=True)) == [" hi", " you"]
    assert one(spark, text.byte_level(F.lit("hi you"), split=False)) == ["hi you"]
    assert [one(spark, text.chat_format(F.lit(x))) for x in ("a <|im_start|> b", "<|start_header_id|>", "")] == ["chatml", "llama3", "plain"]
    assert one(spark, text.without_special(F.array(*map(F.lit, (5, 1, 7, 1))), [1])) == [5, 7]
    assert one(spark, vector.usable(F.lit(1.0))) and not one(spark, vector.usable(F.lit(float("inf")))) and not one(spark, vector.usable(F.lit(float("nan"))))


def test_samples(spark):
    tokens_ = F.sequence(F.lit(0), F.lit(99))
    assert [x[0] for x in one(spark, sampling.evenly_spaced(tokens_, 4, 10))] == [0, 22, 45, 67]
    rows = spark.range(200).selectExpr("id % 3 as g", "id")
    first = {tuple(r) for r in batching.bottom(rows, "g", "id", 5).collect()}
    want = {(g, i, h) for g in range(3) for h, i in sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(g, 200, 3))[:5]}
    assert first == want == {tuple(r) for r in batching.bottom(rows.repartition(7), "g", "id", 5).collect()}
    odd = spark.createDataFrame([(None, 1), (None, 2), ("a", None), ("a", 3)], "g string, id long")
    assert sorted((str(r.g), r.id) for r in batching.bottom(odd, "g", "id", 1).collect()) == [("None", min((hashlib.md5(str(i).encode()).hexdigest(), i) for i in (1, 2))[1]), ("a", 3)]
    # no window over all rows: only what tasks have kept of each group is sorted
    plan = batching.bottom(spark.range(10_000).selectExpr("id % 2 as g", "id").repartition(4), "g", "id", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Window") < plan.index("MapInArrow")
    sparse = spark.createDataFrame([(0, 2, 0.25), (0, 3, 0.75)], "row int, token int, p double")
    assert [r.p for r in sampling.dense(sparse, sparse.select("row").distinct(), 5).orderBy("token").collect()] == [0, 0, 0.25, 0.75, 0]


@given(st.lists(st.integers(1, 9), max_size=40), st.integers(1, 12), st.integers(0, 12))
def test_spans_follow_the_rule(costs, budget, overlap):
    found = chunk.spans(costs, budget, overlap)
    assert sorted({i for s, e in found for i in range(s, e)}) == list(range(len(costs)))
    for s, e in found:
        assert e == s + 1 or sum(costs[s:e]) <= budget
        assert e == len(costs) or sum(costs[s : e + 1]) > budget
    for (s, e), (t, _) in zip(found, found[1:]):
        assert s < t <= e and (t == s + 1 or sum(costs[t:e]) <= overlap)
        assert t == s + 1 or sum(costs[t - 1 : e]) > overlap


def test_words_of_pieces_agree(spark):
    samples = ["Héllo, wörld!", "漢字 and 한글", "a\tb\nc", "x\u0000y\ufffd", "don't—stop", "$5.00 €", "ÀÉ ñ"]
    df = spark.createDataFrame([(x,) for x in samples], "t string").select("t", unicode.bert_words(unicode.bert_clean(F.col("t"))).alias("w"))
    for r in df.collect():
        assert unicode.bert_words_of(r.t) == r.w
    vocabulary = {x: i for i, x in enumerate(["[UNK]", "[CLS]", "[SEP]", "un", "##able", "a", "##b", ","])}
    cost = tokens.word_cost(vocabulary)
    assert [cost(x) for x in ("unable", "ab,a", "zz", "")] == [2, 4, 1, 0]
    docs = spark.createDataFrame([(1, "unable ab a unable"), (2, " ")], "doc_id long, text string")
    got = {(r.doc_id, r.passage): r.text for r in chunk.by_cost(docs, 6, 1, cost).collect()}
    assert got == {(1, 0): "unable ab", (1, 1): "a unable", (2, 0): " "} or got[1, 0] == "unable ab"


def test_vectors_of_different_lengths(spark):
    base = spark.createDataFrame([(0, [1.0, 0.0, 1.0]), (1, [1.0])], "id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(7, [1.0, 0.0])], "qid long, embedding array<double>")
    with pytest.raises(Exception, match="different dimensions"):
        knn.exact(base, q, 1).collect()


def test_close_vectors_of_large_norm_keep_their_order(spark):
    base = spark.createDataFrame([(i, [1e8 + i * 1e-3, 1e8]) for i in range(20)], "id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(7, [1e8, 1e8])], "qid long, embedding array<double>")
    assert [r.id for r in knn.exact(base, q, 5).orderBy("rank").collect()] == [0, 1, 2, 3, 4]


def test_index_is_kept_and_added_to(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = ivfpq.trained(v, 4, 8, 32, 2)
    index.entries = ivfpq.encoded(v, index)
    ivfpq.saved(index, f"{tmp_path}/index")
    q = v.where("id < 5").withColumnRenamed("id", "qid")
    again = ivfpq.loaded(spark, f"{tmp_path}/index")
    want = [tuple(r) for r in ivfpq.search(index, q, 3, 2).orderBy("qid", "rank").collect()]
    assert [tuple(r) for r in ivfpq.search(again, q, 3, 2).orderBy("qid", "rank").collect()] == want
    assert ivfpq.added(again, v.where("id < 2"), f"{tmp_path}/index") == (300, 2)
    more = ivfpq.loaded(spark, f"{tmp_path}/index")
    assert more.entries.count() == 302 and {r.id for r in more.entries.where("id >= 300").collect()} == {300, 301}
    found = {r.id for r in ivfpq.search(more, q.where("qid = 0"), 2, 4).collect()}
    assert found == {0, 300}


def test_reachable(spark):
    links = [[[1], []], [[2]], [[0]], [[0]]]
    nodes = spark.createDataFrame([(0, 0, i, 10 + i, [1.0], x) for i, x in enumerate(links)], hnsw._NODE)
    assert [tuple(r) for r in hnsw.reachable(hnsw.Index(np.zeros((1, 1)), nodes, 16, "l2")).collect()] == [(0, 0, 4, 3)]


def test_requests(spark):
    rows = [(0, [("user", "hi")], None, 0.0, 0.5), (1, [], None, 1.0, 1.0), (2, [("user", None)], None, 1.0, 1.0), (3, [("user", "x")], 2, 1.0, 1.0), (4, [("user", "x")], 1, 101.0, 1.0), (5, [("user", "x")], 1, 1.0, 0.0), (6, None, 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "i int, messages array<struct<role: string, content: string>>, n int, temperature double, top_p double")
    got = {r.i: r.e for r in df.select("i", requests.chat_error().alias("e")).collect()}
    assert got[0] is None and got[1] == "messages is empty" and got[2] == "message without content" and got[3] == "only n = 1 is supported" and got[4] == got[5] != got[0] and got[6] == "missing messages"
    ids = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, requests.admission_error(ids(1, 2), 3, 9)) is None
    assert one(spark, requests.admission_error(F.array().cast("array<int>"), 3, 9)) == "prompt of 0 tokens; this server fits 1 to 2"
    assert one(spark, requests.admission_error(ids(1, 2, 3), 3, 9)) == "prompt of 3 tokens; this server fits 1 to 2"
    assert one(spark, requests.admission_error(ids(1, 12), 3, 9)) == "token 12 is outside the vocabulary"
    assert one(spark, requests.embedding_error(F.array().cast("array<string>"), F.lit(None).cast("string"))) == "input must not be empty"
    assert one(spark, vector.erf(F.lit(0.5))) == pytest.approx(math.erf(0.5), abs=2e-7) and one(spark, vector.erf(F.lit(-1.2))) == pytest.approx(math.erf(-1.2), abs=2e-7)


@pytest.mark.parametrize("n", [1, 7, 1000, 5000])
def test_percentiles_by_ranges(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.exponential(3, n), 1 if n > 1000 else 3)
    df = spark.createDataFrame([(int(i % 2), float(x)) for i, x in enumerate(values)], "k int, v double").repartition(5)
    for r in metrics.percentiles(df, ["k"], "v", [0, 50, 90, 99, 100]).collect():
        mine = np.sort(values[r.k :: 2])
        assert [r.p0, r.p50, r.p90, r.p99, r.p100] == [mine[math.floor(p / 100 * (len(mine) - 1) + 0.5)] for p in (0, 50, 90, 99, 100)]
    assert metrics.percentiles(df, [], "v", [50]).first().p50 == np.sort(values)[math.floor(0.5 * (n - 1) + 0.5)]


def test_scaled_quantization(spark):
    rng = np.random.default_rng(3)
    w, x = rng.normal(size=(6, 64)), rng.normal(size=(8, 64)) * np.r_[np.full(4, 20.0), np.ones(60)]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(w)], "row int, values array<double>")
    inputs = spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>")
    means = quant.channel_means(inputs)
    scales = quant.channel_scales(means, 0.5)
    s = np.array([r.scale for r in scales.orderBy("channel").collect()])
    got = np.zeros_like(w)
    for r in quant.scaled_and_quantized(rows, scales, means, 4).collect():
        got[r.row, r.part * 32 : r.part * 32 + 32] = np.array(r.codes) * r.scale
    want = np.zeros_like(w)
    for i in range(6):
        for g in range(2):
            at = slice(g * 32, g * 32 + 32)
            v, weight, best = w[i, at] * s[at], (x[:, at] ** 2).mean(axis=0) / s[at] ** 2 + 1e-8, None
            for clip in quant.CLIPS[4]:
                scale = clip * np.abs(v).max() / 7
                codes = np.clip(np.floor(np.abs(v / scale) + 0.5) * np.sign(v), -8, 7)
                error = (weight * (v - codes * scale) ** 2).sum()
                best = min(best or (error + 1, 0), (error, scale)) if best is None or error < best[0] else best
                if best[0] == error:
                    want[i, at] = codes * scale
    assert got == pytest.approx(want)
    found = quant.searched_scales(rows, inputs, 4).collect()
    assert sorted(r.alpha for r in found) == quant.ALPHAS and found[0].error <= min(r.error for r in found if r.alpha == 0)
    mine = {r.alpha: r.error for r in found}
    assert mine[0.5] == pytest.approx(((x @ (w - want / s).T) ** 2).mean())
    with pytest.raises(Exception, match="multiple of 32"):
        quant.checked(spark.createDataFrame([(0, [1.0])], "row int, values array<double>")).collect()


def test_starts_of_cells(spark):
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "id long, embedding array<double>")
    assert len({tuple(x) for x in kmeans.random_start(v, 6)}) == 6
    with pytest.raises(ValueError):
        kmeans.random_start(v, 7)
    cells, counts = np.array([[1.0, 1.0], [4.0, 0.0], [9.0, 9.0]]), np.array([4.0, 4.0, 0.0])
    kmeans._refill(cells, counts)
    assert counts.tolist() == [4, 2, 2] and cells[2] == pytest.approx([4 + 5e-4, 1e-4]) and cells[1] == pytest.approx([4 - 5e-4, -1e-4])


def test_workload(spark):
    load = sampling.workload(spark, 5, 25_000, 2.0, (4, 9), (1, 3), 3, 50)
    rows = load.orderBy("req_id").collect()
    times = np.array([r.arrival for r in rows])
    assert (np.diff(times) > 0).all() and np.diff(times).mean() == pytest.approx(0.5, rel=0.05)
    assert {len(r.prompt_tokens) for r in rows} == set(range(4, 10)) and {r.max_tokens for r in rows} == {1, 2, 3}
    assert len({tuple(r.prompt_tokens[:3]) for r in rows}) == 1 and len({tuple(r.prompt_tokens) for r in rows}) > 15_000
    assert one(spark, text.one_shot(F.lit("Why?"), F.array(F.lit("Because."))))[-1].text.endswith("Question: Why?")
