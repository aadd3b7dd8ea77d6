import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import alignment, bottomk, bytescan, chaining, components, cutting, decontam, langid, licenses, nearcopies, ngramjoin, packing, radix, rows, scratch, sharding, simhash, spelling, tokencount

LOWER = {c: c + 32 for c in range(65, 91)}


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- helpers ---


@given(st.text(max_size=60), st.integers(1, 7))
def test_range_hashes_are_those_of_equal_bytes(text, q):
    data = np.frombuffer(text.encode(), np.uint8)
    grams = bytescan.RangeHash(data).grams(q)
    known = {}
    for i, h in enumerate(grams.tolist()):
        assert known.setdefault(data[i : i + q].tobytes(), h) == h
    assert len(set(known.values())) == len(known)


@given(st.lists(st.integers(0, 5), min_size=1, max_size=40), st.integers(1, 9))
def test_sliding_windows(values, w):
    h = np.array(values, np.uint64)
    n = max(0, len(values) - w + 1)
    assert bytescan.sliding_min(h, w).tolist() == [min(values[i : i + w]) for i in range(n)]
    assert bytescan.sliding_argmin(h, w).tolist() == [i + values[i : i + w].index(min(values[i : i + w])) for i in range(n)]
    chosen = set(bytescan.minimizers(h, w).tolist())
    assert all(chosen & set(range(i, i + w)) for i in range(n))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (-5, -4), (200, 200)] + [(300, x) for x in range(301, 360)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == 0 and got[-4] == -5 and got[330] == 300 and got[200] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbered_rows_are_unique_and_ascend(odd, docs):
    got = rows.numbered(odd, 'row').select("row", "doc_id").orderBy("row").collect()
    assert len({r["row"] for r in got}) == odd.count()
    ids = [r["doc_id"] for r in got if r["doc_id"] is not None]
    assert ids == sorted(ids)
    assert all(r["row"] == r["doc_id"] for r in rows.numbered(docs).collect())


def test_columns_of_any_name_are_kept(spark, odd):
    wide = odd.selectExpr("*", "1 as row", "2 as ROW_", "3 as spans", "4 as most", "5 as _text", "6 as _hit", "7 as _data", "8 as _at", "9 as _part", "10 as group", "11 as _tie")
    items = spark.createDataFrame([(1, "lost words of nobody at all in any text of this table")], "item_id long, text string")
    for out in (nearcopies.representatives(wide), chaining.without_passages(wide), decontam.cleaned(wide, items), langid.identified(wide)):
        assert out.columns == wide.columns
        assert {(r["row"], r["ROW_"], r["spans"], r["most"], r["_text"], r["_hit"], r["_data"], r["_at"], r["_part"], r["group"], r["_tie"]) for r in out.collect()} == {tuple(range(1, 12))}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Session:
        conf = {"spark.master": "spark://there:7077"}

    with pytest.raises(ValueError, match="share"):
        scratch.shared_folder(Session())


def test_cut():
    assert cutting.cut("One two, three. four".encode(), [{"start": 1, "end": 3}]) == b"One four"
    assert cutting.cut(b"a b", [{"start": 0, "end": 9}]) is None
    assert cutting.cut("é b!".encode(), [{"start": 1, "end": 2}]).decode() == "é "


# --- 1 ---


def test_shards(docs, odd, empty):
    for df in (docs, odd):
        got = sharding.sharded(df, shards=5).collect()
        assert len(got) == df.count()
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in df.collect())
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
        for s in range(5):
            slots = sorted(r["slot"] for r in got if r["shard"] == s)
            assert slots == list(range(len(slots)))
        assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.sharded(empty).count() == 0


def test_shards_are_even(spark):
    many = spark.range(4000).selectExpr("id as doc_id", "if(id < 1500, repeat('copy ', 20), repeat(cast(id as string), cast(1 + id % 37 as int))) as text", "if(id % 3 = 0, 'hot', cast(id % 11 as string)) as source")
    sizes = Counter()
    for r in sharding.sharded(many).collect():
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(sizes.values()) < 1.05 * mean and min(sizes.values()) > 0.95 * mean


# --- 2 ---


def test_templates():
    a = licenses.Automaton("licensed under [[the|a]] license <<2>> end")
    run = lambda t: a.match(t.encode().split(), 0)
    assert run("licensed under license end") == 4
    assert run("licensed under the license x y end more") == 7
    assert run("licensed under license x y z end") == -1
    assert run("licensed under some license end") == -1
    assert run("licensed under a license end end end end") == 7


@pytest.mark.parametrize(
    ("template", "yes", "no"),
    [
        ("x [[a b|a]] y", ["x a b y", "x a y", "x y"], ["x b y", "x a b b y"]),
        ("x [[a|a b]] y", ["x a b y", "x a y", "x y"], ["x a b b b y"]),
        ("x [[a||b]] y", ["x y", "x a y", "x b y"], ["x a b y"]),
        ("x [[a [[b|c]] d]] y", ["x y", "x a d y", "x a b d y", "x a c d y"], ["x a b c d y", "x b y"]),
        ("x [[a <<2>>]] y", ["x y", "x a y", "x a z z y"], ["x z y", "x a z z z y"]),
        ("x y z", ["x y z"], ["x y"]),
    ],
)
def test_regions_are_compiled(template, yes, no):
    a = licenses.Automaton(template)
    for text in yes:
        assert a.match(text.encode().split(), 0) == len(text.split()), text
    for text in no:
        assert a.match(text.encode().split(), 0) != len(text.split()), text


def test_markup_that_does_not_close():
    for wrong in ("x [[a", "x a]]", "x | y"):
        with pytest.raises(ValueError):
            licenses.Automaton(wrong)


def _license_scan(text):
    """All matches by trying every start and every end of a regular expression made from the markup."""
    w = words(text)
    places, labels, base, covered = [], set(), set(), set()
    for is_base, group in ((True, licenses.BASE), (False, licenses.TEMPLATES)):
        for label, template in group.items():
            parts = re.findall(r"\[\[|\]\]|\||<<\d+>>|[^\s\[\]|<]+", template)
            marks = {"[[": "(?:", "]]": ")?", "|": "|"}
            pattern = re.compile("".join(marks.get(x) or (rf"(?:\S+ ){{0,{x[2:-2]}}}" if x[0] == "<" else x + " ") for x in parts))
            for i in range(len(w)):
                ends = [e for e in range(len(w), i, -1) if pattern.fullmatch("".join(x + " " for x in w[i:e]))]
                if ends:
                    labels.add(label)
                    covered |= set(range(i, ends[0]))
                    if is_base:
                        places.append(i)
                        base.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), len(covered) / len(w) if w else 0.0


def test_license_scan_by_brute_force(spark):
    rng = np.random.default_rng(8)
    wording = [re.sub(r"<<\d+>>", "some one", re.sub(r"[\[\]]+|\|", " ", t)) for t in licenses.TEMPLATES.values()]
    wording += [re.sub(r"<<\d+>>", "", re.sub(r"\[\[.*\]\]", "", t)) for t in licenses.TEMPLATES.values()] + list(licenses.BASE.values())
    filler = "the of apache license under gnu general public cc by all rights reserved copyright c software is free".split()
    rows_ = [(i, " ".join(" ".join([*rng.choice(filler, rng.integers(0, 9)), wording[rng.integers(0, len(wording))]]) for _ in range(rng.integers(0, 3))) + " " + " ".join(rng.choice(filler, rng.integers(0, 12))), "t", 1.0) for i in range(80)]
    got = {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows_, "doc_id long, text string, labels string, score double")).collect()}
    seen = set()
    for i, text, _, _ in rows_:
        r, want = got[i], _license_scan(text)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) == want[:6]
        assert r.score == pytest.approx(want[6])
        seen |= set(want[5].split(","))
    assert len(seen) > 12


def test_license_scan(spark, odd, empty):
    r = licenses.scanned(spark.createDataFrame([(1, "See CC-BY! and cc by; All rights, reserved. x", 0), (2, None, 0)], "doc_id long, text string, labels int"))
    one = by_id(r)[1]
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels) == (10, 3, 1, 6, "cc-by,reserved")
    assert set(one.base_labels.split(",")) <= set(one.labels.split(",")) and 0 < one.score <= 1
    two = by_id(r)[2]
    assert (two.n_words, two.n_base, two.first_word, two.base_labels, two.labels, two.score) == (0, 0, None, "", "", 0)
    found = licenses.scanned(odd).collect()
    assert len(found) == odd.count()
    want = Counter((r["doc_id"], len(words(r["text"]))) for r in odd.collect())
    assert Counter((r["doc_id"], r["n_words"]) for r in found) == want
    assert licenses.scanned(empty).count() == 0


# --- 3 ---


def _shingles(text):
    w = words(text)
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_bottom_k(docs, odd, empty):
    all_ = sorted(texts(docs).items())
    got = by_id(bottomk.compared(docs))
    for i, (doc_id, text) in enumerate(all_):
        text, after = text or "", all_[(i + 1) % len(all_)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r, a, b = got[doc_id], _shingles(text), _shingles(edited)
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        exact = len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - exact) < 0.2
        if len(a | b) <= bottomk.K:
            assert r.near_edited == pytest.approx(exact)
            assert r.edited_within == pytest.approx(len(a & b) / len(b) if b else 1.0) and r.n_distinct == len(a)
    same = {}
    for r in bottomk.compared(odd).collect():
        same.setdefault(r.fingerprint, set()).add(r.doc_id)
    assert bottomk.compared(odd).count() == odd.count() and bottomk.compared(empty).count() == 0


def test_sketches_merge():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    whole = np.concatenate([a, b, a[:2000]])
    assert (bottomk.merged(bottomk.least(a, 128), bottomk.least(np.concatenate([b, a[:2000]]), 128)) == bottomk.least(whole, 128)).all()
    x, y = bottomk.least(a, 128), bottomk.least(np.concatenate([b, a[:2000]]), 128)
    assert abs(bottomk.resemblance(x, y) - 2000 / 8000) < 0.15
    assert abs(bottomk.containment(y, x) - 2000 / 5000) < 0.2
    assert (bottomk.decoded(bottomk.encoded(x)) == x).all()
    assert bottomk.least(np.zeros(10_000, np.uint64), 128).tolist() == [0]


# --- 4 ---


def _fingerprint(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _reachable(fps, distance=3):
    left, out = dict(fps), {}
    while left:
        todo, group = [next(iter(left))], []
        left_fp = {todo[0]: left.pop(todo[0])}
        while todo:
            i = todo.pop()
            group.append(i)
            for j in [j for j, f in left.items() if (f ^ left_fp[i]).bit_count() <= distance]:
                left_fp[j] = left.pop(j)
                todo.append(j)
        out |= {i: min(group) for i in group}
    return out


def test_simhash(docs, odd, empty):
    fps = {i: _fingerprint(t) for i, t in texts(docs).items()}
    want = _reachable(fps)
    got = by_id(simhash.near_duplicates(docs))
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert simhash.near_duplicates(odd).count() == odd.count() and simhash.near_duplicates(empty).count() == 0


def test_xxhash_is_the_built_in_one(spark):
    assert spark.sql("select xxhash64('the cat sat') h").first().h == simhash._signed(xxhash.xxh64_intdigest(b"the cat sat", 42))


@pytest.mark.parametrize("cell", [2048, 3])
def test_links_of_dense_fingerprints(spark, cell):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 62, 12)
    fps = {int(c) for c in centres}
    for c in centres:
        fps |= {int(c) ^ sum(1 << int(b) for b in rng.choice(62, rng.integers(1, 6), replace=False)) for _ in range(15)}
    want = _reachable({f: f for f in fps})
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long").repartition(4), cell=cell)
    got = {r["node"]: r["label"] for r in components.components(links).collect()}
    assert {f: got.get(f, f) for f in fps} == want


def test_near_copies(spark, docs, odd, empty):
    known = [(i, t) for i, t in sorted(texts(docs).items())]
    sets = {i: _shingles(t) for i, t in known}
    alike = {i: {j for j, b in sets.items() if (len(a & b) / len(a | b) if a | b else 1.0) >= 0.8} for i, a in sets.items()}
    want, left = {}, set(sets)
    while left:
        group, todo = set(), {min(left)}
        while todo:
            group |= todo
            todo = {j for i in todo for j in alike[i]} - group
        want |= dict.fromkeys(group, min(group))
        left -= group
    got = {r["row"]: r["group"] for r in nearcopies.groups(docs.selectExpr("doc_id as row", "text")).collect()}
    assert got == want
    kept = nearcopies.representatives(odd)
    assert kept.columns == odd.columns
    assert max(c for i, c in Counter(r["doc_id"] for r in kept.collect()).items() if i is not None) == 1
    assert nearcopies.representatives(empty).count() == 0


def test_fingerprints_of_shingle_sets(spark):
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 7, 40_000):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        raw = h.view(np.uint8).reshape(-1, 8)
        want = np.packbits(2 * np.unpackbits(raw, axis=1).sum(axis=0, dtype=np.int64) > n)
        assert nearcopies.fingerprint(h) == int(want.view(np.int64)[0])
    fps = [int(x) for x in rng.integers(0, 1 << 62, 5)]
    made = spark.createDataFrame([(i, fps[i % 5] ^ (i == 7)) for i in range(12)], "node long, fp long")
    got = {(r.x, r.y) for r in nearcopies._near_fingerprints(made).collect()}
    assert got == {(0, 5), (0, 10), (1, 6), (1, 11), (3, 8), (4, 9), (2, 7)}


def test_a_large_group_of_near_copies(spark):
    words_ = [f"w{i}" for i in range(300)]
    rows_ = [(i, " ".join([*words_[: i % 290], f"x{i}", *words_[i % 290 + 1 :]])) for i in range(400)] + [(1000, " ".join(f"y{i}" for i in range(300)))]
    got = {r["row"]: r["group"] for r in nearcopies.groups(spark.createDataFrame(rows_, "row long, text string").repartition(3)).collect()}
    assert all(got[i] == 0 for i in range(400)) and got[1000] == 1000


def _variants(base, n, parts, edits, seed):
    """`n` texts of each of `parts` rewritings of a third of `base`: alike within a rewriting, at 0.5 to 0.8 across."""
    rng, out = np.random.default_rng(seed), []
    for p in range(parts):
        core = base[: len(base) * 5 // 6] + [f"p{p}w{i}" for i in range(len(base) // 6)]
        for v in range(n):
            w = list(core)
            for i in rng.choice(len(base) * 5 // 6, edits, replace=False):
                w[i] = f"p{p}v{v}e{i}"
            out.append(" ".join(w))
    return out


def _near_groups(texts_):
    """Smallest number reachable over texts alike by 0.8, by brute force; and the resemblances met."""
    sets = [_shingles(t) for t in texts_]
    label, met = list(range(len(sets))), []
    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            met.append(shared / (len(sets[i]) + len(sets[j]) - shared))
            if met[-1] >= 0.8 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return dict(enumerate(label)), met


@pytest.mark.parametrize("most", [ngramjoin.LIST, 2])
def test_near_copies_of_a_family_that_is_less_alike(spark, most):
    base = [f"w{i}" for i in range(240)]
    rows_ = _variants(base, 4, 40, 1, 1)
    rows_ = [rows_[i] for i in np.random.default_rng(2).permutation(len(rows_))]
    want, met = _near_groups(rows_)
    assert sum(0.5 < x < 0.8 for x in met) > 64 * 100 and len(set(want.values())) == 40
    made = spark.createDataFrame(list(enumerate(rows_)), "row long, text string").repartition(3)
    assert {r["row"]: r["group"] for r in nearcopies.groups(made, most=most).collect()} == want


def test_near_copies_of_a_large_family_that_is_less_alike(spark):
    rows_ = _variants([f"w{i}" for i in range(240)], 2, 500, 1, 1)
    met = _near_groups(rows_[:3])[1]
    assert met[0] > 0.9 and 0.5 < met[1] < 0.8 and 0.5 < met[2] < 0.8
    made = spark.createDataFrame(list(enumerate(rows_)), "row long, text string").repartition(3)
    assert {r["row"]: r["group"] for r in nearcopies.groups(made).collect()} == {i: i - i % 2 for i in range(1000)}


@pytest.mark.parametrize("n", [100, 1000])
def test_near_copies_at_the_limit_are_all_found(spark, n):
    rows_ = []
    for p in range(n):
        w = [f"p{p}w{i}" for i in range(130)]
        rows_ += [" ".join(w), " ".join(w[:-14] + [f"p{p}x{i}" for i in range(14)])]
    assert 0.8 <= _near_groups(rows_[:2])[1][0] < 0.81
    made = spark.createDataFrame(list(enumerate(rows_)), "row long, text string").repartition(4)
    assert {r["row"]: r["group"] for r in nearcopies.groups(made).collect()} == {i: i - i % 2 for i in range(2 * n)}


# --- 5 ---


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), max_size=25, unique_by=lambda x: x[0]))
def test_chains_ascend_and_use_each_match_once(matches):
    matches.sort()
    at, there = [a for a, _ in matches], [b for _, b in matches]
    found = chaining.chains(at, there)
    assert sorted(i for c in found for i in c) == list(range(len(at)))
    for c in found:
        assert all(at[i] < at[j] and there[i] < there[j] for i, j in zip(c, c[1:]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 90), st.integers(0, 40)), max_size=30), st.integers(1, 5), st.integers(0, 12))
def test_chains_are_the_best_within_the_window(matches, k, most):
    matches.sort()
    at, there = [a for a, _ in matches], [b for _, b in matches]
    score, before = chaining._scores(at, there, k, 0.1, most)
    want = []
    for i, (a, b) in enumerate(matches):
        near = [want[j] - 0.1 * (a - x + b - y) for j, (x, y) in enumerate(matches[:i]) if 0 < a - x <= most + k and 0 < b - y <= most + k]
        want.append(k + max([0.0, *near]))
        j = before[i]
        if j >= 0:
            assert 0 < a - at[j] <= most + k and 0 < b - there[j] <= most + k
    assert score == pytest.approx(want)


def _prose(rng, n):
    return [f"{rng.choice(list('abcdefghij'))}{rng.integers(0, 3000)}" for _ in range(n)]


def test_a_second_passage_after_a_longer_one_is_one_row(spark):
    rng = np.random.default_rng(4)
    long, fuzzy = _prose(rng, 600), _prose(rng, 200)
    edited = [w if i % 12 else "edit" for i, w in enumerate(fuzzy)]
    rows_ = [(1, " ".join([*_prose(rng, 50), *long, *_prose(rng, 100), *fuzzy])), (2, " ".join([*_prose(rng, 50), *long, *_prose(rng, 100), *edited, *_prose(rng, 80)]))]
    got = sorted((r.start_word, r.end_word, r.source_doc_id) for r in chaining.repeated_passages(spark.createDataFrame(rows_, "doc_id long, text string")).collect())
    assert len(got) == 2 and abs(got[0][0] - 50) < 3 and abs(got[0][1] - 650) < 3 and abs(got[1][0] - 750) < 3 and abs(got[1][1] - 950) < 3


def test_passages_of_two_sources_and_twice_in_a_document(spark):
    rng = np.random.default_rng(5)
    left, right, twice = _prose(rng, 25), _prose(rng, 25), _prose(rng, 60)
    rows_ = [(1, [*_prose(rng, 30), *left, *_prose(rng, 30)]), (2, [*right, *_prose(rng, 30)]), (3, [*_prose(rng, 20), *left, *right, *_prose(rng, 9)]), (4, twice), (5, [*twice, *_prose(rng, 70), *twice]), (6, ["spam"] * 300), (7, [*_prose(rng, 9), *["spam"] * 200])]
    made = spark.createDataFrame([(i, " ".join(w)) for i, w in rows_], "doc_id long, text string")
    want = None
    for parts in (1, 7):
        for hot in (64, 1):
            got = sorted(tuple(r) for r in chaining.repeated_passages(made.repartition(parts), hot=hot).collect())
            want = want or got
            assert got == want
    of = {}
    for r in want:
        of.setdefault(r[0], []).append(r[1:4])
    assert of[3] == [(20, 45, 1), (45, 70, 2)]
    assert sorted(of[5]) == [(0, 60, 4), (130, 190, 4)]
    assert sum(e - s for s, e, _ in of[7]) > 150 and set(of) == {3, 5, 7}


def test_passages_do_not_depend_on_partitions(docs):
    few = sorted(tuple(r) for r in chaining.repeated_passages(docs.coalesce(1)).collect())
    for hot in (64, 2):
        assert sorted(tuple(r) for r in chaining.repeated_passages(docs.repartition(50), hot=hot).collect()) == few


def test_edited_passages_are_found(spark):
    """Passages of several lengths with words replaced at several rates, all alike by 0.8: nine of ten, over four fifths of their words, and little else."""
    rng = np.random.default_rng(6)
    rows_, grid = [], {}
    for size in (45, 60, 100, 200):
        for rate in (0.1, 0.15, 0.2):
            for i in range(40):
                p = _prose(rng, size)
                e = p
                while e == p or sum(x == y for x, y in zip(e, p)) < 0.8 * size:
                    e = [w if x >= rate else f"e{j}" for j, (w, x) in enumerate(zip(p, rng.random(size)))]
                n = len(grid)
                grid[10_000 + n] = (size, rate)
                rows_ += [(n, [*_prose(rng, 20), *p, *_prose(rng, 40)]), (10_000 + n, [*_prose(rng, 30), *e, *_prose(rng, 30)])]
    met, other = Counter(), 0
    for r in chaining.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in rows_], "doc_id long, text string")).collect():
        size = grid[r.doc_id][0]
        inside = min(r.end_word, 30 + size) - max(r.start_word, 30)
        met[r.doc_id] += inside * (r.source_doc_id == r.doc_id - 10_000)
        other += r.end_word - r.start_word - inside
    for kind in set(grid.values()):
        assert sum(met[i] >= 0.8 * k[0] for i, k in grid.items() if k == kind) >= 36, kind
    assert other < len(grid)


def test_lone_chains_are_told_apart_as_by_their_alignment():
    """Chains of one match are left out only where the walk finds no part; bounds of the slices hold."""
    import pyarrow as pa

    rng, k, rows_ = np.random.default_rng(2), 5, []
    for _ in range(3000):
        n, m = rng.integers(5, 60, 2)
        a, b = (rng.integers(0, 3, x).astype(np.uint32) for x in (n, m))
        i, j = int(rng.integers(0, n - 4)), int(rng.integers(0, m - 4))
        size = int(rng.integers(5, 40))
        part = min(size, n - i, m - j)
        b[j : j + part] = a[i : i + part]
        at = [i] if rng.random() < 0.9 else [i, i + 2]
        rows_.append((32, at, a.tobytes(), 64, [x - i + j for x in at], b.tobytes()))
    names = ["a_from", "at", "a", "b_from", "there", "b"]
    types = [pa.int64(), pa.list_(pa.int64()), pa.binary()] * 2
    shift = lambda r: (32, [x + 32 for x in r[1]], r[2], 64, [x + 64 for x in r[4]], r[5])
    batch = pa.RecordBatch.from_arrays([pa.array([shift(r)[c] for r in rows_], t) for c, t in enumerate(types)], names).slice(100)
    worth = chaining._worth(batch, k)
    assert 0.1 < worth.mean() < 0.95
    for keep, (_, at, a, _, there, b) in zip(worth.tolist(), rows_[100:]):
        found = [p for p in chaining.align(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), at, there, k) if p[1] - p[0] >= 2 * k]
        assert keep or (len(at) == 1 and not found)


def test_occurrences_behind_others_are_matched_as_these():
    import pyarrow as pa

    front, behind = chaining._FRONT, chaining._BEHIND
    rows_ = [(front, 5, 1, 2, 9), (behind, 5, 1, 6, 30), (behind, 5, 1, 2, 31), (front, 5, 7, 3, 8), (front, 6, 0, 1, 1), (behind, 6, 0, 8, 2), (behind, 6, 0, 9, 3)]
    batch = lambda r: pa.RecordBatch.from_arrays([pa.array([x[c] for x in r], pa.int64()) for c in range(5)], ["kind", "front", "front_at", "x", "y"])
    for cut in range(len(rows_) + 1):
        out = [tuple(r.values()) for b in chaining._spread([batch(rows_[:cut]), batch(rows_[cut:])]) for r in b.to_pylist()]
        assert out == [(6, 30, 2, 9), (8, 2, 1, 1), (9, 3, 1, 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.booleans(), max_size=40), st.sampled_from([0.5, 0.8, 1.0]))
def test_longest_stretches(same, alike):
    blocks = chaining._runs(same, 3, 5)
    assert sum(b[5] for b in blocks) == len(same) and sum(b[4] for b in blocks) == sum(same)
    found = [(blocks[i][0] - 3, blocks[j][1] - 3) for i, j in chaining._longest(blocks, alike, 1)]
    fits = [(j - i, i, j) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if same[i] and same[j - 1] and sum(same[i:j]) >= alike * (j - i) - 1e-9]
    assert bool(found) == bool(fits)
    assert all((j - i, i, j) in fits for i, j in found) and all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    if fits:
        assert max(j - i for i, j in found) == max(fits)[0]


def test_alignment_bridges_edits():
    a = np.arange(100, dtype=np.uint32)
    b = np.concatenate([np.arange(500, 510), a[:40], [999], a[41:60], a[62:100], np.arange(600, 605)]).astype(np.uint32)
    (found,) = chaining.align(a, b, [10, 45, 70], [20, 55, 78], 8)
    assert found[:4] == (0, 100, 10, 108) and 0.9 < found[4] < 1
    far = np.concatenate([a[:50], np.arange(900, 960), a[50:60]]).astype(np.uint32)
    assert chaining.align(a[:60], far, [0, 20, 52], [0, 20, 112], 8)[0][:4] == (0, 50, 0, 50)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=12))
def test_best_stretches(worth):
    found = chaining._best([float(x) for x in worth])
    sums = lambda i, j: sum(worth[i : j + 1])
    assert all(sums(i, j) > 0 for i, j in found) and all(a[1] < b[0] for a, b in zip(found, found[1:]))
    if any(x > 0 for x in worth):
        most = max(sums(i, j) for i in range(len(worth)) for j in range(i, len(worth)))
        assert max(sums(i, j) for i, j in found) == most
    covered = {i for a, b in found for i in range(a, b + 1)}
    assert all(i in covered for i, x in enumerate(worth) if x > 0)


def test_passages(docs, odd, empty):
    known = texts(docs)
    got = chaining.repeated_passages(docs).collect()
    seen, want = {}, set()
    for i in sorted(known):
        w = words(known[i])
        for j in range(len(w) - 49):
            if seen.setdefault(tuple(w[j : j + 50]), i) != i:
                want.add(i)
    assert want <= {r.doc_id for r in got}
    for r in got:
        a, b = words(known[r.doc_id])[r.start_word : r.end_word], words(known[r.source_doc_id])[r.source_start : r.source_end]
        assert r.source_doc_id < r.doc_id and len(a) >= chaining.WORDS
        assert sum((Counter(a) & Counter(b)).values()) >= 0.8 * len(a)
    rest = chaining.without_passages(docs)
    assert rest.columns == docs.columns
    assert not {r.doc_id for r in chaining.repeated_passages(rest).collect()} & want
    touched = {r.doc_id for r in got}
    for i, t in texts(rest).items():
        assert i in touched or t == known[i]
    assert chaining.repeated_passages(empty).count() == 0 and chaining.without_passages(empty).count() == 0
    assert chaining.without_passages(odd).where("doc_id is null").count() == 2


# --- 6 ---


@pytest.fixture(scope="module")
def counter():
    return tokencount.counter()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokencount.MODEL)


@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(" ▁\nthe ing,.x"), st.characters(exclude_categories=["Cs"])), max_size=60), size=st.integers(1, 30))
def test_token_maps_compose(counter, library, text, size):
    marked = ("▁" if text else "") + text.replace(" ", "▁")
    cuts = [0, *range(size + 1, len(marked), size), len(marked)] if marked else []
    at, total = counter.machine.key(0), 0
    for i, j in zip(cuts, cuts[1:]):
        found = {a: (b, n) for a, b, n in counter.maps(marked[:i], marked[i:j], j == len(marked))}
        assert at in found or i > tokencount.LEAD
        at, n = found[at]
        total += n
    assert total == len(library.encode(text))
    assert (counter.marked(marked) if marked else 0) == (counter.total(marked) if marked else 0) == total


def test_states_of_long_words_merge(counter, library):
    rng = np.random.default_rng(3)
    word = "".join(rng.choice(list("abcdefghijklmnop"), 200_000))
    before = len(counter.machine._keys)
    assert counter.total("▁" + word) == len(library.encode(word))
    assert len(counter.machine._keys) - before < 120_000
    before = len(counter.machine._keys)
    assert counter.total("▁" + "ab" * 100_000) == len(library.encode("ab" * 100_000))
    assert len(counter.machine._keys) - before < 100


def test_states_start_anew(library, monkeypatch):
    monkeypatch.setattr(tokencount, "STATES", 50)
    small = tokencount.Counter(tokencount.counter().machine.rank)
    text = "some words whoseunusuallengthmakesmanystates and others, été"
    assert small.total("▁" + text.replace(" ", "▁")) == small.marked("▁" + text.replace(" ", "▁")) == len(library.encode(text))


def test_token_counts(spark, odd, empty, library):
    rng = np.random.default_rng(4)
    long = [(9000, "a" * 30_000, 1), (9001, "".join(rng.choice(list("abc "), 20_000)), 1), (9002, "  " * 3000 + "x", 1), (9003, "the " * 9000, 1)]
    wide = odd.selectExpr("doc_id", "text", "1 as at").union(spark.createDataFrame(long, "doc_id long, text string, at int"))
    for chunk, group in ((1 << 16, 64), (40, 3), (1000, 2)):
        got = tokencount.token_counts(wide, chunk=chunk, limit=100, group=group).collect()
        want = Counter()
        for r in wide.collect():
            t = r["text"] or ""
            n = len(library.encode(t))
            want[r["doc_id"], len(t.encode()), n, n > 100] += 1
        assert Counter(tuple(r) for r in got) == want
    assert tokencount.token_counts(empty).count() == 0


# --- 7 ---


@pytest.mark.parametrize(("depth", "digit", "hot", "many"), [(100, 40, 256, 4096), (30, 10, 1, 4096), (30, 10, 256, 1), (8, 8, 2, 2), (12, 4, 256, 4096)])
def test_radix(docs, empty, depth, digit, hot, many):
    seen, want = set(), {}
    for i, t in sorted(texts(docs).items()):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - depth + 1):
            if data[p : p + depth] in seen:
                gone[p : p + depth] = b"\1" * depth
            seen.add(data[p : p + depth])
        spans = len(re.findall(b"\1+", bytes(gone)))
        want[i] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in radix.deduplicated(docs, depth, digit, hot, many).collect()}
    assert got == want
    assert radix.deduplicated(empty).count() == 0


def test_radix_with_repeated_rows(odd):
    got = radix.deduplicated(odd).collect()
    assert len(got) == odd.count()
    data = (odd.where("doc_id = 0").first()["text"] or "").encode()
    removed = sorted(r.n_removed for r in got if r.doc_id == 0)
    assert removed[1:] == [len(data)] * 2 if len(data) >= 100 else removed == [0, 0, 0]


# --- 8 ---


def test_gradients():
    network = langid.Network(3, 4, 1)
    network.weights = {k: w.astype(np.float64) for k, w in network.weights.items()}
    data, label = np.random.default_rng(0).integers(97, 105, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    grads, _ = network.gradients(data, label)
    for k, w in network.weights.items():
        at = np.unravel_index(np.abs(grads[k]).argmax(), w.shape)
        old = w[at]
        w[at] = old + 1e-3
        up = network.gradients(data, label)[1]
        w[at] = old - 1e-3
        down = network.gradients(data, label)[1]
        w[at] = old
        assert (up - down) / 2e-3 == pytest.approx(grads[k][at], rel=1e-2, abs=1e-5)


def test_texts_are_read_in_sequences_with_margins():
    network = langid.Network(3, 4, 1)
    texts_ = ["one Tale, of two", "", None, "été", "42", "a" * 50, "x y z " * 9]
    got = langid.Reader(["a", "b", "c"], network, sequence=8, margin=4)(texts_)
    for text, (lang, score) in zip(texts_, got):
        data = langid.letters(text or "")
        if not data:
            assert (lang, score) == ("und", 0)
            continue
        sums = np.zeros(3)
        for at in range(0, len(data), 8):
            own = data[at : at + 8]
            read = (b" " * 4 + data + b" " * 4)[at : at + len(own) + 8]
            sums += network.probabilities(np.frombuffer(read, np.uint8)[None])[4 : 4 + len(own), 0].sum(axis=0)
        assert score == pytest.approx(sums.max() / len(data), rel=1e-4) and lang == "abc"[sums.argmax()]


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = langid.predicted(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").selectExpr("avg(int(lang = lang_pred)) a").first().a
    assert joined > 0.95


def test_identified_keeps_columns_of_any_name(spark):
    made = spark.createDataFrame([(i, "the thing and the others", "en" if i % 2 else None, i, 1.0, "t", i) for i in range(40)] + [(99, "12", "en", 1, 1.0, "t", 9), (98, None, "en", 1, 1.0, "t", 9)], "doc_id long, text string, lang string, lang_pred int, score double, _text string, `_LANG` int")
    kept = langid.identified(made)
    assert kept.columns == made.columns and kept.count() == 40 and kept.where("lang is null").count() == 0


def test_languages(spark, odd, empty):
    tables = {"en": ["the", "and", "thing", "with", "hello"], "fr": ["été", "le", "vous", "être", "où"], "de": ["über", "und", "nicht", "schön", "zeit"]}
    rng = np.random.default_rng(2)
    made = [(i, " ".join(rng.choice(tables[lang], 20)), lang) for i, lang in enumerate(list(tables) * 40)]
    df = spark.createDataFrame([*made, (900, None, "en"), (901, "123 !!", "fr"), (None, "the thing", None)], "doc_id long, text string, lang string")
    got = langid.predicted(df).collect()
    want = {i: lang for i, _, lang in made}
    assert len(got) == df.count()
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    right = [r.lang_pred == want[r.doc_id] for r in got if r.doc_id in want and r.held_out]
    assert np.mean(right) > 0.95
    assert all(r.lang_pred == "und" for r in got if r.doc_id in (900, 901))
    kept = langid.identified(df)
    assert kept.columns == df.columns and kept.count() == df.count() - 2
    assert langid.predicted(empty).count() == 0 and langid.predicted(odd).count() == odd.count()
    assert {r.lang_pred for r in langid.predicted(df.withColumn("lang", df.lang.substr(9, 1).try_cast("int").cast("string"))).collect()} == {"und"}


# --- 9 ---


def _hits(text, items):
    w = words(text)
    hit, found = [0] * len(w), set()
    for item, of in items:
        for j in range(max(1, len(of) - 9)) if of else []:
            window = of[j : j + 10]
            for p in range(len(w) - len(window) + 1):
                if w[p : p + len(window)] == window:
                    hit[p : p + len(window)] = [1] * len(window)
                    found.add(item)
    return len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), any(hit)


@pytest.mark.parametrize("part", [1 << 20, 200])
def test_decontamination(spark, docs, odd, empty, part):
    known = [t for _, t in sorted(texts(docs).items()) if t]
    items = [(10, " ".join(words(known[5])[3:30])), (9, known[5]), (11, " ".join(words(known[8])[:4])), (12, None), (13, ""), (14, known[20] + " end"), (15, " ".join(words(known[9])[:1]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = [(i, words(t)) for i, t in items]
    got = {r.doc_id: tuple(r)[1:6] for r in decontam.decontaminated(docs, bench, part=part).collect()}
    assert got == {i: _hits(t, split) for i, t in texts(docs).items()}
    assert decontam.decontaminated(odd, bench, part=part).count() == odd.count()
    assert decontam.decontaminated(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontam.decontaminated(docs, bench.limit(0)).collect())
    left = decontam.cleaned(docs, bench.where("item_id = 10"))
    assert left.columns == docs.columns and not any(r.contaminated for r in decontam.decontaminated(left, bench.where("item_id = 10")).collect())


# --- 10 ---


@settings(max_examples=60, deadline=None)
@given(totals=st.lists(st.integers(0, 400), min_size=1, max_size=6).filter(any), at=st.floats(0, 1))
def test_shares_never_fall(totals, at):
    shares = packing.Shares(totals)
    k = int(at * shares.total)
    have = shares.before(k)
    assert sum(have) == k and all(0 <= a <= n for a, n in zip(have, totals))
    assert all(a <= b for a, b in zip(have, shares.before(min(shares.total, k + 7))))
    assert all(abs(a - k * n / shares.total) <= len(totals) for a, n in zip(have, totals))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=6).filter(any))
def test_schedule_fills_windows(quota):
    windows = -(-sum(quota) // 512)
    room, given_ = Counter(), Counter()
    for w, q, n in packing.schedule(quota, windows, 512, 64):
        room[w] += n
        given_[q] += n
    assert [given_[q] for q in range(len(quota))] == quota
    assert all(room[w] == 512 for w in range(windows - 1)) and sum(room.values()) == sum(quota)


@pytest.mark.parametrize(("window", "windows"), [(2048, 1024), (64, 3)])
def test_packing(docs, odd, empty, window, windows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.MODEL)
    known = texts(docs)
    pieces, held = {}, {}
    for r in packing.packed(docs, window=window, windows=windows, least=16).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        held.setdefault(r.sequence_id, []).append(r)
    for i, t in known.items():
        ids, at = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s, rs in held.items():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or s == max(held)
    assert packing.packed(empty).count() == 0
    assert packing.packed(odd, queues=1).selectExpr("sum(length) n").first().n == packing.packed(odd).selectExpr("sum(length) n").first().n


def test_packing_of_many_sources(spark):
    rows_ = [(i, " ".join(f"word{i}x{j}" for j in range(3 + i % 5)), f"s{i % 300}", "pack") for i in range(9000)]
    made = spark.createDataFrame(rows_, "doc_id long, text string, source string, queue string").repartition(3)
    out = packing.packed(made, window=512, windows=16, least=16).collect()
    mine, last, pieces = {}, max(r.sequence_id for r in out), {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        if r.sequence_id * 2 < last:
            mine[r.doc_id % 300] = mine.get(r.doc_id % 300, 0) + r.length
    assert all(sum(r.length for r in rs) == rs[0].doc_tokens for rs in pieces.values()) and len(pieces) == 9000
    every = Counter()
    for rs in pieces.values():
        every[rs[0].doc_id % 300] += rs[0].doc_tokens
    assert all(abs(mine[s] / n - 0.5) < 0.1 for s, n in every.items())
    held = Counter()
    for r in out:
        held[r.sequence_id] += r.length
    assert all(n == 512 for s, n in held.items() if s != last)


def test_packing_of_a_text_longer_than_partitions_and_its_ids(spark):
    long = " ".join(f"long {i}" for i in range(5000))
    made = spark.createDataFrame([(1, long, "a"), (2, "short one", "b"), (3, None, None)], "doc_id long, text string, source string")
    run, found = packing.encoder(packing.MODEL, 1), {}
    for r in packing.packed(made, window=64, windows=8, least=16, tokens=True).collect():
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        found.setdefault(r.doc_id, []).append((r.start, r.ids))
    for i, text in ((1, long), (2, "short one"), (3, "")):
        assert [x for _, ids in sorted(found[i]) for x in ids] == np.frombuffer(run([text])[0], run.type).tolist()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\xa0a.'s1é<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words_are_encoded_alone(text):
    run = packing.encoder(packing.MODEL, 1)
    text += "<|endoftext|> it's"
    assert np.frombuffer(run([text])[0], run.type).tolist() == [*run._tokenizer.encode(text, add_special_tokens=False).ids, 1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab.,'s1é\n\t\xa0 "), max_size=60), min_size=1, max_size=4))
def test_new_words_are_encoded_together(texts_):
    run = packing.Encoder(packing.MODEL, 1, packing.RANKS) if not _fresh else _fresh[0]
    _fresh[:] = [run]
    run._led.clear()
    for text, got in zip(texts_, run(texts_)):
        assert np.frombuffer(got, run.type).tolist() == [*run._tokenizer.encode(text, add_special_tokens=False).ids, 1]


_fresh = []


# --- 11 ---

_ODD_TEXTS = ["a  b \n c <|endoftext|> x", None, "", " lead", "trail ", "▁ mark", "a b \x00 c\tt  ", "<s> </s> <0x41> ", "漢字 😀 ok é́", "x" * 5000 + " y", "\n", " ", "foo\n bar", "the end of the end"]


def _aligned_by_hand(known):
    """Two tokenizers' tokens walked side by side; (doc_id, text) rows to the rows wanted."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(alignment.A_MODEL), sentencepiece.SentencePieceProcessor(model_file=alignment.B_MODEL)
    a_lib.encode_special_tokens = True
    plain = {c: i for i, c in enumerate(packing._byte_chars())}
    a_bytes = lambda i: bytes(plain[c] for c in a_lib.id_to_token(i))
    b_bytes = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    rows_, count = [], Counter()
    for doc_id, text in known:
        whole = (" " + (text or "")).encode()
        a, b = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids, b_lib.encode(text or "")
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            rows_.append((doc_id, [], [], [], []))
            continue
        i = j = at_a = at_b = 0
        links, groups, left, right = [], [], [], []
        while i < len(a):
            links.append((a[i], b[j]))
            left += [] if left and left[-1][0] == i else [(i, a[i])]
            right += [] if right and right[-1][0] == j else [(j, b[j])]
            end_a, end_b = at_a + len(a_bytes(a[i])), at_b + len(b_bytes(b[j]))
            if end_a == end_b:
                groups.append(",".join(str(x) for _, x in left) + "|" + ",".join(str(x) for _, x in right))
                left, right = [], []
            if end_a <= end_b:
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                j, at_b = j + 1, end_b
        count.update(links)
        rows_.append((doc_id, a, b, groups, links))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(i, len(a), len(b), len(g), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), digest(g)) for i, a, b, g, x in rows_]


def test_token_alignment(spark, odd, empty):
    known = [(r.doc_id, r.text) for r in odd.collect()] + [(9000 + i, t) for i, t in enumerate(_ODD_TEXTS)]
    made = spark.createDataFrame([(*r, 1, "x") for r in known], "doc_id long, text string, row long, pairs string").repartition(5)
    want = Counter(_aligned_by_hand(known))
    for held in (alignment.HELD, 40, 0):
        got = alignment.aligned(made, held=held)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert Counter(tuple(r) for r in got.collect()) == want
    assert alignment.aligned(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\tthe ing,.x▁<>|"), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=4))
def test_words_are_encoded_as_whole_texts(texts_):
    align = alignment.aligner()
    for got, want in zip(align.ids(texts_), align._encoded(texts_)):
        assert (got is None) == (want is None or not len(want[0]) or got is None)
        if got is not None:
            assert [x.tolist() for x in got] == [np.frombuffer(x, np.int32).tolist() for x in want]


# --- 12 ---


def _four_words(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    k = min(4, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def _joined_by_hand(known):
    """(doc_id, text) rows, ids unique, to {doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {i: _four_words(t) for i, t in known}
    root = {i: i for i in sets}
    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and root[a] != root[b] and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize(("most", "block"), [(ngramjoin.LIST, ngramjoin.BLOCK), (1, 3)])
def test_ngram_join(spark, docs, most, block):
    """Prose, and short texts of three words only, of which many share a prefix and a size, so groups hold many sets."""
    rng = np.random.default_rng(5)
    few = [" ".join(rng.choice(list("abC"), rng.integers(4, 60))) for _ in range(150)] + [" ".join([*"aab" * 20, *rng.choice(list("ab"), 2)]) for _ in range(60)]
    known = [(r.doc_id, r.text) for r in docs.collect()] + [(2000 + i, t) for i, t in enumerate(few)]
    made = spark.createDataFrame([(*r, 1, "x") for r in known], "doc_id long, text string, row long, group string").repartition(4)
    got = ngramjoin.linked(made, most=most, block=block)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == _joined_by_hand(known)


def test_ngram_join_of_odd_rows(spark, odd, empty):
    got = ngramjoin.linked(odd).collect()
    assert len(got) == odd.count() and ngramjoin.linked(empty).count() == 0
    lost = [r for r in got if r.doc_id is None]
    assert sorted((r.n_shingles, r.component_id is None) for r in lost) == [(0, True), (1, True)]
    assert all(r.component_id == 0 for r in got if r.doc_id == 0)
    assert all(r.component_id == r.doc_id and r.n_shingles == 0 for r in got if r.doc_id in (500, 501, 502))


def test_ngram_join_at_the_limit(spark):
    """85 of 100 shingles shared is enough, 85 of 101 isn't."""
    rows_ = []
    for p in range(40):
        w = [f"p{p}w{i}" for i in range(95)]  # 92 shingles
        rows_ += [" ".join(w), " ".join(w[:-7] + [f"p{p}x{i}" for i in range(7 + p % 3)])]
    want = _joined_by_hand(list(enumerate(rows_)))
    sizes = [len(_four_words(rows_[i]) & _four_words(rows_[i + 1])) / len(_four_words(rows_[i]) | _four_words(rows_[i + 1])) for i in (0, 2, 4)]
    assert sizes[0] > sizes[1] == 0.85 > sizes[2]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.linked(spark.createDataFrame(list(enumerate(rows_)), "doc_id long, text string").repartition(3)).collect()} == want


def test_a_long_list_of_unlike_sets_is_dealt_out():
    """50,000 unlike sets in one list: each block of it is compared in bounded time, and holds a bounded number of rows."""
    n = 2 * ngramjoin.BLOCK
    rng = np.random.default_rng(8)
    bits = [x.tobytes() for x in rng.integers(0, 1 << 63, (n, ngramjoin.BITS // 64)).astype(np.uint64)]
    import time

    import pyarrow as pa

    block = np.repeat([3, 7], ngramjoin.BLOCK)
    ids = np.arange(n)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.full(n, 3, np.int32)), pa.array(np.full(n, 7, np.int32)), pa.array(block.astype(np.int32)), pa.array(ids), pa.array(np.full(n, 60, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(ids), pa.array(bits, pa.binary())], ["key", "i", "j", "block", "first", "size", "place", "label", "bits"])
    start = time.process_time()
    assert sum(b.num_rows for b in ngramjoin._other_pairs(ngramjoin.ALIKE, False)([batch])) == 0
    assert time.process_time() - start < 20


def test_blocks_of_a_long_list(spark):
    made = spark.range(50_000).selectExpr("7L as key", "id as first", "60 as size", "0 as place", "id as label", "binary('x') as bits")
    sizes = [r["count"] for r in ngramjoin._blocks(made, ngramjoin.BLOCK).groupBy("i", "j").count().collect()]
    assert len(sizes) == 25 * 26 // 2 and max(sizes) < 2.5 * ngramjoin.BLOCK


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11), st.integers(0, 50)), max_size=40))
def test_nearest_pairs_connect_all(n, edges):
    edges = [(a % n, b % n, d) for a, b, d in edges if a % n != b % n]
    a, b, d = (np.array(x, np.int64) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 3
    pick = ngramjoin._nearest(a, b, d, np.arange(n))
    reach = lambda pairs: {frozenset(g) for g in _sets_of(n, pairs)}
    assert reach(list(zip(a[pick], b[pick]))) == reach(list(zip(a, b)))
    assert len(pick) == n - len(_sets_of(n, list(zip(a, b))))


def _sets_of(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return [[i for i in range(n) if label[i] == x] for x in set(label)]


# --- 13 ---


def _variants_by_hand(known):
    import zlib as z

    count = Counter()
    for doc_id, text in known:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = z.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, others = {}, {}
    for w in n:
        found = [x for x in n if near(w, x)]
        others[w] = len(found)
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], others[w], n[form[w]] if form[w] else None))
    return out


def test_spelling_variants(spark, odd, empty):
    rng = np.random.default_rng(11)
    stems = ["".join(rng.choice(list("abcdeéßÀ×"), rng.integers(5, 9))) for _ in range(40)]
    pool = []
    for s in stems:
        i, c = int(rng.integers(len(s))), str(rng.choice(list("abcé")))
        pool += [s] * 12 + [s[:i] + s[i + 1 :]] * 4 + [s[:i] + c + s[i:]] * 3 + [s[:i] + c + s[i + 1 :]] * 5 + [s[::-1]] * 2
    pool += ["aaaaaa"] * 9 + ["aaaaa"] * 4 + ["aaaaaaa"] * 30 + ["abcabc", "bacabc", "Abcabd"] * 5 + ["x" * 3000, "x" * 3001, "X" * 3000] * 3
    rows_ = [(i, " ".join(rng.choice(pool, 60)) + ("." if i % 3 else "-") + "été2Été") for i in range(60)] + [(r.doc_id, r.text) for r in odd.collect()]
    made = spark.createDataFrame([(*r, "x", 1) for r in rows_], "doc_id long, text string, word string, n long").repartition(5)
    got = spelling.variants(made)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == _variants_by_hand(rows_)
    assert any(f and f != r for _, f, r, *_ in found)
    assert spelling.variants(empty).count() == 0


def test_words_of_many_anagrams_make_few_pairs(spark):
    """Permutations of one word share a key; pairs that are near only come out."""
    from itertools import islice, permutations

    made = spark.createDataFrame([(i, "".join(w) + tail, 5) for i, (w, tail) in enumerate((w, t) for w in islice(permutations("abcdefg"), 2000) for t in ("", "x"))], "id long, word string, n long")
    got = spelling.near(made)
    assert got.count() == 4000 and got.where("length(near) in (7, 8)").count() == 4000


# --- shared parts ---


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_equal_texts_share_a_shard(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = {r.doc_id: r for r in sharding.sharded(docs).collect()}
    whole, of, sizes = sum(r["size"] for r in got.values()) / sharding.SHARDS, {}, Counter()
    for r in docs.select("doc_id", "text").collect():
        of.setdefault(r.text or "", []).append(got[r.doc_id])
    for rows_ in of.values():
        if sum(r["size"] for r in rows_) <= whole:
            assert len({r.shard for r in rows_}) == 1
    for r in got.values():
        sizes[r.shard] += r["size"]
    largest = max(sum(r["size"] for r in rows_) for rows_ in of.values())
    assert max(sizes.values()) - min(sizes.values()) <= max(2 * largest, 0.1 * whole)


def test_numbers_are_no_letters():
    for text in ("½ ² ①", "123 ½", "Ⅷ", "²", "!?", "", None, "٣ ४"):
        assert not langid._lettered(text)
    assert all(map(langid._lettered, ("1 a", "é", "漢", "ª", "ب")))


def test_shared_folder_without_a_setting():
    class Session:
        class sparkContext:
            applicationId = "app-1"

        def __init__(self, **known):
            self.known = known

        @property
        def conf(self):
            return self

        def get(self, key, default=None):
            return self.known.get(key, default)

    local = Session(**{"spark.master": "local[4]"})
    assert scratch.shared_folder(local) == scratch.shared_folder(local) and scratch.shared_folder(local).startswith("file://")
    assert scratch.shared_folder(Session(**{"spark.master": "local", "spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"
    Session.sparkContext.applicationId = "app-2"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session(**{"spark.master": "spark://host:7077"}))


def test_open_tables_are_those_of_a_thread(spark):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    meet = Barrier(2)

    def one(i):
        with scratch.passing(spark):
            scratch.written(spark.range(i), "gone")
            meet.wait(60)
            last = scratch.written(spark.range(10 + i), "last")
            meet.wait(60)
        meet.wait(60)
        return last.count()

    with ThreadPoolExecutor(2) as pool:
        assert sorted(pool.map(one, (1, 2))) == [11, 12]


def test_a_worker_drops_what_others_left():
    kept, others = packing._encoders, tokencount._counters
    before = dict(kept), dict(others)
    kept["x", 1], others["y"] = object(), object()
    try:
        scratch.alone("packing")
        assert ("x", 1) in kept and not others
        scratch.alone()
        assert not kept
    finally:
        kept.clear()
        kept.update(before[0])
        others.update(before[1])


def test_a_text_of_ten_megabytes(spark):
    """Every new operator reads it whole."""
    rng = np.random.default_rng(1)
    pool = np.array(["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(3000)])
    long = " ".join(rng.choice(pool, 1_250_000))
    made = spark.createDataFrame([(1, long), (2, long + " more"), (3, "short words here only"), (4, None)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.linked(made).collect()}
    assert got[1][1] == got[2][1] == 1 and got[2][0] == got[1][0] + 1 > 1_200_000 and got[3] == (1, 3)
    words_ = {r.word: r.n for r in spelling.variants(made).collect()}
    assert sum(words_.values()) > 2_400_000
    tokens_ = {r.doc_id: r for r in alignment.aligned(made).collect()}
    assert tokens_[1].n_links >= max(tokens_[1].n_a, tokens_[1].n_b) > 1_250_000 and tokens_[4].n_a == 0


def test_packing_looks_a_distinct_word_up_once(monkeypatch):
    """However often it stands in a batch; and ids are the library's, with blanks of all kinds."""
    from tokenizers import Tokenizer

    asked = []
    encode, gathered = packing.Encoder(packing.MODEL, 1, packing.RANKS), packing.Encoder._gathered
    monkeypatch.setattr(packing.Encoder, "_gathered", lambda self, lists, known, learn: asked.append(sum(map(len, lists))) or gathered(self, lists, known, learn))
    encode(["one two three " * 400 + "end"] * 50)
    assert sum(asked) <= 60
    texts = ["", " ", "a", "a ", " a", "a  b", "a　 b", "x\n y", "\n", "<s> a <|endoftext|> b", "é 漢字 b", "a\tb c", "a b "]
    library = Tokenizer.from_file(packing.MODEL)
    assert [np.frombuffer(x, encode.type).tolist() for x in encode(texts)] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]
