import numpy as np

import corpus_pipeline
from loomspark.llm import packing, queries
from loomspark.llm.scratch import written


def test_stages(spark, odd, tmp_path):
    bench = odd.where("text is not null").selectExpr("doc_id as item_id", "substring(text, 1, 200) as text").limit(3)
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = odd
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, left, str(tmp_path)), "stage")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == odd.columns, name
            assert out.count() <= left.count()
            left = out
    assert out.count() > 0


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.selectExpr("count(distinct doc_id) n").first().n > 100


def test_planted_cases(spark, tmp_path):
    """The whole run against what is known of each document: the texts that have to be left, token for token."""
    rng = np.random.default_rng(12)
    prose = lambda n: [f"{rng.choice(list('abcdefghij'))}{rng.choice(list('klmnop'))}{rng.integers(0, 90_000)}" for _ in range(n)]
    words = {i: prose(120) for i in range(20)}
    want = {i: list(w) for i, w in words.items()}
    for i in range(5):  # near copies: one word of 120 differs
        words[20 + i] = [w if j != 60 else "other" for j, w in enumerate(words[i])]
        left, right = prose(40), prose(50)  # a passage of an earlier document
        words[30 + i], want[30 + i] = [*left, *words[5 + i][30:90], *right], [*left, *right]
    item = prose(25)
    for i in range(3):
        left, right = prose(60), prose(30)
        words[40 + i], want[40 + i] = [*left, *item, *right], [*left, *right]
    words[50], words[51] = words[11], item  # an exact copy, and a test item itself
    texts = {i: " ".join(w) for i, w in words.items()} | {60: "123 !! 4", 61: None, 62: ""}
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "x") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    encode = packing.encoder(packing.MODEL, 1)
    got = {i: [x for _, ids in sorted(p) for x in ids] for i, p in pieces.items()}
    assert got == {i: np.frombuffer(encode([" ".join(w)])[0], encode.type).tolist() for i, w in want.items()}


def test_registered():
    names = list(queries.QUERIES)
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))


def test_near_copies_take_no_idle_step(spark, monkeypatch):
    """Near copies are those of the exact join; no step runs whose result it would find by itself."""
    from loomspark.llm import nearcopies, simhash

    def idle(*_, **__):
        raise AssertionError("a step without effect")

    monkeypatch.setattr(simhash, "fingerprint_links", idle)
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, text), (4, "quite another text of its own words")], "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.representatives(docs).collect()) == [1, 4]
