"""Operators that were written for any size: small cases by hand and by brute force."""

import base64
import json as plain_json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspark.functions import json, model, quant, requests, text, vector
from loomspark.operators import batching, hnsw, ivfpq, knn, logits, metrics, prefix
from loomspark.plans import retrieval
from loomspark.sources import text as text_source
from loomspark.sources import vectors as vector_source
from loomspark.streaming import counters, detokenize


@pytest.mark.parametrize("block", [1, 2, 3])
def test_prefix_tree(spark, block):
    """Against a set of the prefixes themselves, in order of arrival."""
    rng = np.random.default_rng(block)
    prompts = [[str(x) for x in rng.integers(0, 2, rng.integers(0, 25))] for _ in range(60)]
    prompts += [prompts[3], prompts[3] + ["z"] * 9, ["q"] * 40, ["q"] * 40, ["q"] * 23 + ["r"] * 17, None, [None, "a", "b", "c"], [None, "a", "b", "c"], ["ab", "c", "d", "e"], ["a", "bc", "d", "e"]]
    rows = [(i, int(rng.integers(0, 9)), p) for i, p in enumerate(prompts)]
    seen, want = set(), {}
    for i, _, p in sorted(rows, key=lambda r: (r[1], r[0])):
        ends = range(block, len(p or ()), block)
        mine = [tuple(p[:e]) for e in ends]
        want[i] = (len(mine), sum(x in seen for x in mine))
        seen |= set(mine)
    made = spark.createDataFrame(rows, "req_id long, arrival long, tokens array<string>").repartition(5)
    assert {r.req_id: (r.blocks, r.hits) for r in prefix.block_hits(made, block).collect()} == want
    assert prefix.block_hits(made.where("false"), block).count() == 0


def test_strict_json(spark):
    good = {'{"a": 1}': {"a": 1}, " [1, 2]\n": [1, 2], '"\\ud83d\\ude00"': "😀", "null": None, "1.5": 1.5, '{"v": {"end": 0}}': {"v": {"end": 0}}}
    bad = ['{"a":1} x', '{"a":1}{}', '{"a":1', "", "1 2", '1,"c":2', "1},{", '1,"end":0', '{"a":1,"a":2}', "1}", "tru", None]
    rows = spark.createDataFrame([(x,) for x in [*good, *bad]], "x string").select("x", F.to_json(json.parsed(F.col("x"))).alias("y")).collect()
    for r in rows:
        assert (r.y is None) == (r.x not in good), r
        if r.x in good:
            assert plain_json.loads(r.y) == good[r.x]


@settings(max_examples=25, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=20))
def test_quoted_json(spark, text):
    assert plain_json.loads(spark.createDataFrame([(text,)], "x string").select(json.quoted(F.col("x"))).first()[0]) == text


def test_length_sorted_batches(spark):
    rows = [(i, (i * 7) % 23) for i in range(100)]
    got = batching.length_sorted(spark.createDataFrame(rows, "id long, n long").repartition(6), "id", "n", 8).collect()
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for place, (i, n) in enumerate(order):
        longest = max(x for _, x in order[place // 8 * 8 : place // 8 * 8 + 8])
        assert [(r.batch, r.place, r.padding) for r in got if r.id == i] == [(place // 8, place % 8, longest - n)]
    assert batching.length_sorted(spark.createDataFrame([], "id long, n long"), "id", "n").count() == 0


def test_gram_of_all_inputs(spark):
    x = np.random.default_rng(3).normal(size=(500, 6))
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "embedding array<double>").repartition(7)
    assert quant.gram(rows) == pytest.approx(x.T @ x / 500)


def test_counters_of_a_job_and_a_stream(spark, tmp_path):
    rows = [(i % 5, 10 * i, ["length", "stop", "cancelled", "failed"][i % 4]) for i in range(40)]
    made = spark.createDataFrame(rows, "tokens long, prompt long, finish string")
    series = counters.of_requests(F.col("tokens"), F.col("prompt"), F.col("finish"))
    done = [r for r in rows if r[2] in ("length", "stop")]
    want = (40, 20, 10, sum(r[1] for r in done), sum(r[0] for r in done), 4)
    assert tuple(counters.counted(made.repartition(3), series, lambda df: df.write.parquet(f"{tmp_path}/a")).first()) == want
    for k in range(3):
        made.where(F.col("prompt") % 30 == 10 * k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    stream, totals = counters.watched(spark, stream, "requests", series, ("longest",))
    run = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/at").start()
    run.processAllAvailable()
    run.stop()
    for _ in range(100):  # the listener hears of the last batch a little later
        if totals.totals.get("requests") == 40:
            break
        import time

        time.sleep(0.1)
    spark.streams.removeListener(totals)
    assert tuple(totals.totals.values()) == want and totals.batches >= 3


def test_judgements_of_several_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t1\n1\tb\t3\n")
    (tmp_path / "b.tsv").write_text("query-id\tcorpus-id\tscore\n1\ta\t2\n2\tc\t1\n")
    got = {(r.qid, r.doc_id): r.rel for r in text_source.qrels(spark, str(tmp_path)).collect()}
    assert got == {("1", "a"): 2, ("1", "b"): 3, ("2", "c"): 1}


def test_idle_requests_end(spark, tmp_path):
    import time

    schema = "req_id long, seq long, data binary, last boolean"
    spark.createDataFrame([(0, 0, b"hi ST", False)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = detokenize.texts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ["STOP"], 1000)
    run = stream.writeStream.format("memory").queryName("idle").option("checkpointLocation", f"{tmp_path}/at").trigger(processingTime="500 milliseconds").start()
    got, end = [], time.time() + 60
    while got != ["ST", "hi "] and time.time() < end:
        time.sleep(1)
        got = sorted(r.text for r in spark.table("idle").collect())
    run.stop()
    assert got == ["ST", "hi "]


def test_model_sizes(spark):
    args = [F.lit(x) for x in (8, 2, 4, 2, 2, 16, 100, True)]
    # by matrix: q 8x8, k and v 8x4 each, o 8x8, three of 8x16, two norms; the embedding once and the last norm
    want = 2 * (64 + 32 + 32 + 64 + 3 * 128 + 16) + 800 + 8
    got = spark.range(1).select(model.parameters(*args).alias("n"), model.parameters(*args[:-1], F.lit(False)).alias("m"), model.cache_bytes(args[1], args[3], args[4]).alias("b")).first()
    assert (got.n, got.m, got.b) == (want, want + 800, 2 * 2 * 2 * 2 * 4)


def test_fit_measures(spark):
    counts = spark.createDataFrame([(10, 8.0), (6, 8.0), (5, 0.0)], "n long, e double")
    assert tuple(metrics.chi_square(counts, "n", "e").first()) == (1.0, 1)
    pairs = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert metrics.cosine(pairs, "a", "b").first().cosine == pytest.approx(0.5**0.5)
    assert metrics.cosine(pairs.where("a[0] = 0"), "a", "b").first().cosine == 0


def test_order_of_ids_is_that_of_their_bytes(spark):
    ids = ["b", "B", "é", "a", "", "z", "😀", "\uffff", "10", "9"]
    got = [r.qid for r in retrieval.ordered(spark.createDataFrame([(x,) for x in ids], "qid string").repartition(4)).orderBy("place").collect()]
    assert got == sorted(ids, key=str.encode)


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_queries_in_many_blocks(spark, metric):
    """Parts and blocks that meet in the shuffle give the rows of one block, ties, nulls and repeated vectors included."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)] + [(900 + i, [1.0] * 6) for i in range(100)] + [(None, [0.0] * 6), (999, None)]
    base = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    queries = base.where("id % 4 = 0").select(F.col("id").alias("qid"), "embedding").union(spark.createDataFrame([(None, [1.0] * 6), (5, None)], "qid long, embedding array<double>"))
    bytes_ = {"block": 500, "part": 4000}
    key = lambda r: tuple(r)
    assert sorted(knn.exact(base, queries, 7, metric, **bytes_).collect(), key=key) == sorted(knn.exact(base, queries, 7, metric).collect(), key=key)
    plan = knn.exact(base, queries, 7, metric, **bytes_)._jdf.queryExecution().toString()
    assert "CoGroup" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    cells = lambda df: sorted((r.id, q, v) for r in df.collect() for q, v in zip(r.qids, r.values))
    assert cells(knn.products(base, queries, 500, 700)) == cells(knn.products(base, queries))
    assert knn.exact(base.where("false"), queries, 7, metric, **bytes_).count() == 0
    assert knn.exact(base, queries.where("false"), 7, metric, **bytes_).count() == 0


def test_bytes_of_all_floats(spark):
    values = [0.0, -0.0, 1.5, -2.0, float("inf"), float("-inf"), float("nan"), 1e-45, -1e-40, 3.4028235e38, 1.17549435e-38, 0.1]
    row = spark.createDataFrame([(values,), ([],)], "v array<float>").select(vector.float_bytes_base64(F.col("v")).alias("b")).collect()
    assert [base64.b64decode(r.b) for r in row] == [np.array(values, "<f4").tobytes(), b""]


def test_system_text_of_templates(spark):
    start, end = "<|im_start|>system", "<|im_end|>"
    cases = {
        f"{start}\nBe kind.{end}": "Be kind.", f"x{start}\\nBe kind.{end}y": "Be kind.", f"{start}\n{{{{ m }}}}{end}{start}\nTwo\nlines.{end}": "Two\nlines.",
        f"{start}\\nescaped{end}{start}\nreal{end}": "real", f"{start}\n{end}": None, f"{start}\nno end": None, f"{start}\n' + m + '{end}": None, "": None, None: None,
    }
    rows = spark.createDataFrame([(x,) for x in cases], "t string").select("t", text.default_system(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == cases
    said = F.array(F.struct(F.lit("user").alias("role"), F.lit("Hi").alias("text")))
    got = spark.range(1).select(text.templated(said, F.lit("<|im_start|>")).alias("a"), text.templated(said, F.lit(f"{start}\nS{end}")).alias("b")).first()
    assert got.a == "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\n" and got.b == f"{start}\nS{end}\n" + got.a


def test_tokenizer_folders(spark, tmp_path):
    made = {
        "a": ({"added_tokens": [{"id": 9, "content": "<|im_end|>", "special": True}], "model": {"vocab": {"x": 0, "<|im_end|>": 1}}}, {"chat_template": "<|im_start|>system\nS<|im_end|>"}),
        "b": ({"added_tokens": [{"id": 5, "content": "<|eot_id|>"}], "model": {"vocab": {"x": 0, "<|eom_id|>": 7}}}, {"chat_template": "<|start_header_id|>"}),
        "c": ({"model": {"vocab": {"x": 0}}}, None),
    }
    for name, (head, chat) in made.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "tokenizer.json").write_text(plain_json.dumps(head, indent=1))
        if chat:
            (tmp_path / name / "tokenizer_config.json").write_text(plain_json.dumps(chat))
    rows = text_source.tokenizer_folders(spark, str(tmp_path)).collect()
    assert {tuple(map(str, r)) for r in rows} == {("a", "chatml", "S", "3", "[9]"), ("b", "llama3", "None", "3", "[5, 7]"), ("c", "plain", "None", "1", "[]")}


def test_collected_requests(spark):
    events = [(1, 2, 20, None), (1, 1, 10, None), (1, 3, None, "stop"), (1, 4, 40, None), (1, 5, None, "length"), (2, 1, 7, None), (4, 1, 8, None), (9, 1, 1, None)]
    e = spark.createDataFrame(events, "req_id long, seq int, token int, finish string")
    r = spark.createDataFrame([(1,), (2,), (3,), (4,)], "req_id long")
    got = {x.req_id: (x.tokens, x.finish) for x in requests.collected(r, e, ["req_id"], F.col("req_id") == 4).collect()}
    assert got == {1: ([10, 20], "stop"), 2: ([7], "cancelled"), 3: ([], "cancelled"), 4: ([], "rejected: engine stopped")}
    assert requests.collected(r, e.where("false"), ["req_id"]).where("finish = 'cancelled'").count() == 4


def test_small_tensors_share_tasks(spark, tmp_path, monkeypatch):
    """Tasks by bytes of the files, not by tensors; headers of bounded size; the index names all of them."""
    rows = [(f"t{i}", "F32", [2, 2], [float(i), 0.0, -1.0, 0.5]) for i in range(1500)] + [("big", "F32", [3000], [float(i) for i in range(3000)]), ("none", "F32", [0], [])]
    df = spark.createDataFrame(rows, "name string, dtype string, shape array<long>, data array<float>").repartition(2, "name")
    vector_source.write_tensors(df, f"{tmp_path}/m")
    read = vector_source.tensors(spark, f"{tmp_path}/m", True)
    assert read.rdd.getNumPartitions() == len(list((tmp_path / "m").glob("*.safetensors"))) == 2
    for size in (64 << 20, 5000):
        got = {}
        for r in vector_source.tensors(spark, f"{tmp_path}/m", True, size).orderBy("name", "at").collect():
            assert r.at == len(got.setdefault(r.name, []))
            got[r.name] += r.data
        assert got == {name: data for name, _, _, data in rows}
    index = {r.name: r.file for r in vector_source.index_of(spark, f"{tmp_path}/m").collect()}
    assert index == {r.name: r.path.rsplit("/", 1)[1] for r in read.collect()}
    monkeypatch.setattr(vector_source, "HEAD", 1000)
    batch = pa.RecordBatch.from_pylist([{"name": n, "dtype": d, "shape": s, "data": x} for n, d, s, x in rows[:50]], pa.schema([("name", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("data", pa.list_(pa.float32()))]))
    files = vector_source._TensorWriter(str(tmp_path / "many"), False).write([batch]).files
    heads = [vector_source._header(path, (tmp_path / path).stat().st_size)[0] for path, _ in files]
    assert len(files) > 3 and [n for h in heads for n in h] == [r[0] for r in rows[:50]]


@pytest.mark.parametrize("bytes_", [{}, {"block": 500, "part": 3000}])
def test_likelihoods_without_rows_of_logits(spark, bytes_):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    words = base.where("id % 4 = 0").select(F.col("id").alias("qid"), "embedding")
    values = 8 * x @ x[::4].T
    want = np.log(np.exp(values).sum(axis=1)) - values[np.arange(200), np.arange(200) * 7 % 50]
    df = logits.likelihoods(base, words, 7, 8.0, **bytes_)
    got = {r.id: r.nll for r in df.collect()}
    assert [got[i] for i in range(200)] == pytest.approx(want.tolist()) and len(got) == 200
    assert "array<double>" not in " ".join(t for _, t in df.dtypes)
    assert logits.likelihoods(base, words.where("false"), 7, 8.0).count() == 0


@pytest.mark.parametrize("bytes_", [{}, {"block": 500, "part": 3000}])
def test_speculation_over_all_tokens(spark, bytes_):
    """Every pair comes out, also those beyond the likeliest; sums over all of a row."""
    x = np.random.default_rng(4).normal(size=(120, 6))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    rows = base.where("id % 3 = 0").select(F.col("id").alias("qid"), "embedding")
    p, q = (np.exp(t * (x[::3] @ x.T)) for t in (2.0, 1.0))
    p, q = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True)
    rest = np.maximum(p - q, 0) / np.maximum(p - q, 0).sum(axis=1, keepdims=True)
    got = {(r.row, r.token): (r.p, r.target, r.draft) for r in logits.speculative(base, rows, 2.0, 2.0, **bytes_).collect()}
    assert len(got) == 40 * 120
    for i in range(40):
        assert [got[3 * i, j] for j in range(120)] == [pytest.approx(t, abs=1e-12) for t in zip(rest[i].tolist(), p[i].tolist(), q[i].tolist())]


def test_speculation_sums_a_task_and_deals_out_pairs(spark, monkeypatch):
    """Between passes stands a row a query and task, not one a batch; vectors in one partition are dealt out where their pairs are many; p and accepted come as the SQL has them."""
    x = np.random.default_rng(6).normal(size=(120, 6))
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").coalesce(1)
    rows = base.where("id % 3 = 0").select(F.col("id").alias("qid"), "embedding")
    p, q = (np.exp(t * (x[::3] @ x.T)) for t in (2.0, 1.0))
    p, q = p / p.sum(axis=1, keepdims=True), q / q.sum(axis=1, keepdims=True)
    rest = np.maximum(p - q, 0) / np.maximum(p - q, 0).sum(axis=1, keepdims=True)
    sizes, real = [], logits.written
    monkeypatch.setattr(logits, "written", lambda df, name: (sizes.append((out := real(df, name)).count()), out)[1])
    monkeypatch.setattr(logits, "ROWS", 1000, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        plain = logits.speculative(base, rows, 2.0, 2.0)
        assert sizes == [40, 40, 40] and plain.rdd.getNumPartitions() == 5 and plain.count() == 40 * 120
        for bytes_ in ({}, {"block": 500}):
            df = logits.speculative(base, rows, 2.0, 2.0, digits=6, draw=lambda token: np.fmod(token, 10) / 10.0, **bytes_)
            got = {(r.row, r.token): (r.p, r.accepted) for r in df.collect()}
            assert dict(df.dtypes) == {"row": "bigint", "token": "bigint", "p": "double", "accepted": "boolean"} and len(got) == 40 * 120
            assert all(got[3 * i, j] == (round(rest[i, j], 6), bool(j % 10 / 10 < min(1, p[i, j] / q[i, j]))) for i in range(40) for j in range(120))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_products_are_rows_rounded_as_sql_rounds(spark):
    """One row a vector also where the queries are in blocks; a small negative product stays a negative zero; half goes away from zero."""
    assert [repr(float(x)) for x in knn.rounded(np.array([-3e-7, 3e-7, 0.5e-6, -0.5e-6, 1.0000004, np.inf, -np.nan]), 6)] == ["-0.0", "0.0", "1e-06", "-1e-06", "1.0", "inf", "nan"]
    x = np.random.default_rng(5).integers(-3, 4, (90, 6)).astype(float)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(3)
    rows = base.where("id % 3 = 0").select(F.col("id").alias("qid"), "embedding")
    for bytes_ in ((), (500, 700)):
        got = knn.products(base, rows, *bytes_, digits=6).collect()
        assert len(got) == 90 and all(r.qids == list(range(0, 90, 3)) for r in got)
        assert all(r["values"] == (x[r.id] @ x[::3].T).tolist() for r in got)


def test_products_in_blocks_are_not_shuffled(spark, monkeypatch):
    """Whole rows come out of the tasks, however many blocks the queries have; qids only where they are asked for; many products of one partition are dealt out."""
    x = np.random.default_rng(7).integers(-3, 4, (90, 6)).astype(float)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").coalesce(1)
    rows = base.where("id % 3 = 0").select(F.col("id").alias("qid"), "embedding")
    for most, task, parts in ((500, 1 << 20, 1), (500, 700, 4), (1 << 20, 700, 4)):
        monkeypatch.setattr(knn, "PRODUCTS", task, raising=False)
        df = knn.products(base, rows, most, 700, digits=6)
        plan = df._jdf.queryExecution().toString()
        assert "CoGroup" not in plan and "Aggregate" not in plan and df.rdd.getNumPartitions() == parts
        assert {r.id: (r.qids, r["values"]) for r in df.collect()} == {i: (list(range(0, 90, 3)), (x[i] @ x[::3].T).tolist()) for i in range(90)}
    bare = knn.products(base, rows, 500, 700, digits=6, named=False)
    assert bare.columns == ["id", "values"] and {r.id: r["values"] for r in bare.collect()} == {i: (x[i] @ x[::3].T).tolist() for i in range(90)}
    assert knn.products(base, rows.where("false")).count() == 0 and knn.products(base.where("false"), rows).count() == 0


def test_lines_of_several_files_by_name(spark, tmp_path):
    """The last line by name of file holds, however the files are read: larger ones come first there."""
    for i, n in enumerate((1, 400, 3)):
        (tmp_path / f"part-{i}.jsonl").write_text("".join(plain_json.dumps({"_id": "a" if j == 0 else f"x{j}", "text": f"{i}-{j}", "question": f"q{i}-{j}", "context": f"c{i}-{j % 2}", "answers": []}) + "\n" for j in range(n)))
    got = {r.qid: r.text for r in text_source.queries(spark, str(tmp_path)).collect()}
    assert got["a"] == "2-0" and got["x1"] == "2-1" and got["x3"] == "1-3" and len(got) == 400
    contexts, questions = text_source.question_set(spark, str(tmp_path))
    assert {r.context_id: r.context for r in contexts.collect()} == dict(enumerate(["c0-0", "c1-0", "c1-1", "c2-0", "c2-1"])) and questions.count() == 404


def test_routes_are_made_in_bounded_batches(spark, monkeypatch):
    """A batch of queries times their cells isn't held at once; the routes are the same."""
    rng = np.random.default_rng(6)
    x, cells = rng.normal(size=(300, 5)), rng.normal(size=(40, 5))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "qid long, embedding array<double>").coalesce(1)
    want = sorted(map(tuple, ivfpq.routed(q, cells, 30, "l2").select("qid", "turn", "cell").collect()))
    assert len(want) == 300 * 30
    monkeypatch.setattr(ivfpq, "ROUTES", 100)
    assert sorted(map(tuple, ivfpq.routed(q, cells, 30, "l2").select("qid", "turn", "cell").collect())) == want
    order = np.argsort(((x[:, None] - cells[None]) ** 2).sum(axis=2), axis=1)[:, :30]
    assert want == [(i, t, int(c)) for i in range(300) for t, c in enumerate(order[i])]
    made = []
    held = spark.createDataFrame([(0,)], "x int")

    class Rows:  # the function that the tasks run, on a batch of its own
        sparkSession = spark
        where = select = lambda self, *_: self

        def mapInArrow(self, each, schema):
            batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(x.tolist())], ["qid", "embedding"])
            made.extend(b.num_rows for b in each(iter([batch])))
            return held

    ivfpq.routed(Rows(), cells, 30, "l2")
    assert sum(made) == 300 * 30 and max(made) <= 100


def test_scores_of_classes(spark):
    """As by judgements of all pairs of a label, which are never made."""
    rng = np.random.default_rng(7)
    labels = [None if i == 3 else 99 if i == 4 else int(rng.integers(0, 3)) for i in range(60)]
    items = spark.createDataFrame(list(enumerate(labels)), "id long, label int").repartition(3)
    queries = items.where("id % 2 = 0 or id < 5").select(F.col("id").alias("qid"), "label")
    run = spark.createDataFrame([(q, int(d), r + 1) for q in range(0, 60, 2) for r, d in enumerate(rng.permutation(60)[:12])], "qid long, doc_id long, rank long").where("qid <> doc_id and qid <> 8")
    qrels = queries.join(items.withColumnRenamed("id", "doc_id"), "label").where("qid <> doc_id").select("qid", "doc_id", F.lit(1).alias("rel"))
    kept = retrieval.judged(queries, qrels)
    want = {r.qid: (r.ndcg, r.recall) for r in metrics.ndcg(run, qrels, kept, 10).join(metrics.recall_at(run, qrels, kept, 10), "qid").collect()}
    df = metrics.class_scores(run, items, queries, 10)
    got = {r.qid: (r.ndcg, r.recall) for r in df.collect()}
    assert set(got) == set(want) and not {3, 4} & set(got) and 8 in got
    for q, pair in want.items():
        assert got[q] == pytest.approx(pair)


def test_parts_of_a_batch_by_bytes():
    texts = ["x" * n for n in (10, 3000, 0, 5, 2000, 1, 1, 1)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts)], ["doc_id", "text"])
    parts = list(batching.sliced(batch, 1500))
    assert len(parts) > 1 and [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert list(batching.sliced(batch.slice(0, 0))) == [] and len(list(batching.sliced(batch))) == 1 and len(list(batching.sliced(batch, 1))) == 9


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_graphs_are_built_and_walked_together(metric):
    """A query meets as many graphs of a table as of one six times as large; rows added together find each other, and queries find what each finds alone."""
    assert hnsw.cells_for(102_564) == hnsw.cells_for(615_384) == hnsw.CELLS
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 8)) + 1e4 * (metric == "l2")
    levels = np.minimum(15, (-np.log(1 - rng.uniform(size=len(x))) / np.log(8)).astype(int))
    graph = hnsw.Graph(x, 8, metric, levels)
    graph.build(60)
    again = hnsw.Graph.of(x, graph.links(), 8, metric)
    assert again.links().equals(graph.links()) and max(map(len, (layers[0] for layers in graph.links().to_pylist()))) <= 16
    who, rows, d, visited = again.search(x[:300], 10, 80)
    truth = np.argsort(knn.distances(x[:300] - 1e4 * (metric == "l2"), x - 1e4 * (metric == "l2"), metric), axis=1, kind="stable")[:, :10]
    assert sum(len(set(rows[who == i]) & set(t)) for i, t in enumerate(truth)) >= 0.95 * truth.size and visited.max() < len(x)
    for i in (0, 299):
        _, own, own_d, own_visited = again.search(x[i : i + 1], 10, 80)
        assert own.tolist() == rows[who == i].tolist() and own_d.tolist() == d[who == i].tolist() and own_visited[0] == visited[i]


def test_candidates_grow_with_bins_and_not_with_cells(spark):
    """A task gives out k rows a query however many cells it holds; what is ranked is the same, with small and large cells."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(300, 4)), rng.normal(size=(120, 4)) * 0.01 + 3])
    cells = np.concatenate([x[:30], np.full((1, 4), 3.0)])
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[::21])], "qid long, embedding array<double>")
    assert ivfpq.cell_candidates(base, cells, queries, 2, [20]).count() == 2 * 20
    near = np.argsort(((x[::21, None] - cells[None]) ** 2).sum(axis=2), axis=1, kind="stable")
    own = ((x[:, None] - cells[None]) ** 2).sum(axis=2).argmin(axis=1)
    far = ((x[::21, None] - x[None]) ** 2).sum(axis=2)
    for part, block in ((1 << 16, 4096), (50, 7)):
        found = ivfpq.cell_candidates(base, cells, queries, 5, [4, 12], part=part, block=block).collect()
        for width in (4, 12):
            for q in range(20):
                got = sorted((r.distance, r.id) for r in found if r.qid == q and r.turn < width)[:5]
                want = [i for i in np.argsort(far[q], kind="stable") if own[i] in near[q, :width]][:5]
                assert [i for _, i in got] == want


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_rounded_sums_lose_no_candidate(metric, shift):
    rng = np.random.default_rng(10)
    centroids, words = rng.normal(size=(12, 8)) + shift, rng.normal(size=(4, 16, 2))
    cell, codes = np.sort(rng.integers(0, 12, 700)), rng.integers(0, 16, (700, 4)).astype(np.int32)
    codes[:300] = codes[0]  # equal distances within a cell
    q, usable = rng.normal(size=(9, 8)) + shift, rng.random((9, 12)) < 0.5
    ids = rng.permutation(700)
    tables = ivfpq.Tables(words, centroids, cell, codes, metric)
    n, found, d = tables.least(q, usable[:, cell], ids, 6)
    for i in range(9):
        own = np.flatnonzero(usable[i, cell])
        exact = tables.exact(np.repeat(q[i : i + 1], len(own), axis=0), own)
        assert list(zip(d[n == i], found[n == i])) == sorted(zip(exact, ids[own]))[:6]
    back = centroids[cell] + np.concatenate([words[j][codes[:, j]] for j in range(4)], axis=1)
    assert np.allclose(tables.exact(q[[0] * 700], np.arange(700)), knn.distances(q[:1] - shift * (metric == "l2"), back - shift * (metric == "l2"), metric)[0], rtol=1e-9, atol=1e-8)
