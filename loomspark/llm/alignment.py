"""Alignment of two tokenizers over a corpus: which tokens of one cover the bytes of which tokens of the other, and how often.

For each text the ends of both token sequences are running sums of token lengths; the ends that both share cut the text into groups; places
of one sequence in the other give each token the range of tokens it overlaps, and repeating each token over its range makes the links. All of
that is NumPy on whole texts. What a text keeps is its distinct (A id, B id) pairs with their counts; these are summed over the
corpus in two shuffles, the first one salted, as some pairs stand in nearly every text.

The counts come back to the texts by a table of the most frequent pairs, of a fixed size, that each task holds; the pairs beyond
it are joined. Both ways are exact, so how many are held changes nothing in the result.
"""

from __future__ import annotations

import hashlib
import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.bytescan import slices
from loomspark.llm.packing import _PLAIN, MODEL, RANKS, _blanks, _byte_chars, _same_ranks
from loomspark.llm.rows import documents
from loomspark.llm.scratch import written

A_MODEL, B_MODEL = MODEL, public_tokenizers.path("piece_bpe_32k.model")
#: Pairs that a task holds with their counts: 16 MB.
HELD = 1 << 20
#: Counts that are told apart when the most frequent pairs are chosen.
_STEPS = 10_000
SALTS = 16
#: Words whose ids a worker remembers, and their most characters.
WORDS, CHARS = 400_000, 40
_MARK = "▁"
_LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


class Aligner:
    """Token ids of a text by both libraries, and what links them.

    Where a space starts a token of both (A splits before a space after other characters than white space, and B's pieces hold a mark
    at their start only) the words of a text are encoded alone, and remembered.
    """

    def __init__(self, a_model: str, b_model: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(a_model), sentencepiece.SentencePieceProcessor(model_file=b_model)
        self._a.encode_special_tokens = True
        plain = {c: i for i, c in enumerate(_byte_chars())}
        self._a_bytes = [b""] * self._a.get_vocab_size()
        for token, i in self._a.get_vocab().items():
            self._a_bytes[i] = bytes(plain[c] for c in token) if all(c in plain for c in token) else token.encode()
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self._b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self._a_size, self._b_size = (np.array(list(map(len, x)), np.int64) for x in (self._a_bytes, self._b_bytes))
        own = json.loads(self._a.to_str())
        self._by_word = (own["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not own["normalizer"] and not any(_MARK in p.lstrip(_MARK) for p in pieces)
        self._ranks = _same_ranks(self._a, RANKS if a_model == MODEL else None)
        #: Ids of words after a space, of both libraries; null for words whose tokens spell something else.
        self._known: dict[str, tuple[bytes, bytes] | None] = {}
        numbers = list(map(str, range(max(len(self._a_bytes), len(self._b_bytes)))))
        self._spelt = [sep + x for sep in ",|;" for x in numbers]
        self._numbers = len(numbers)
        #: Codes of pairs are a * `width` + b.
        self.width = len(self._b_bytes)

    def _a_ids(self, texts: list[str]) -> list[bytes]:
        """Ids of a space and each text; plain words in one pass by the rank file of the same vocabulary."""
        words = [x for x in texts if x and " " not in x and not x[-1].isspace() and _PLAIN.fullmatch(x)] if self._ranks else []
        known = dict(zip(words, self._ranks.led(words, np.dtype(np.int32)) if words else []))
        rest = [x for x in texts if x not in known]
        for x, a in zip(rest, self._a.encode_batch([" " + x for x in rest], add_special_tokens=False)):
            known[x] = np.array(a.ids, np.int32).tobytes()
        return [known[x] for x in texts]

    def _encoded(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """By definition: of a space and each text, and of each text; null where the tokens spell something else."""
        whole = [b" " + x.encode() for x in texts]
        lists = self._b.encode(texts, num_threads=1)
        data, ends = np.fromiter(chain.from_iterable(lists), np.int32).tobytes(), np.cumsum([0, *map(len, lists)]).tolist()
        sides = self._a_ids(texts), [data[4 * i : 4 * j] for i, j in zip(ends, ends[1:])]

        def spelt(side: list[bytes], table: list[bytes]) -> list[bytes]:
            return [b"".join(map(table.__getitem__, np.frombuffer(x, np.int32).tolist())) for x in side]

        def as_one(side: list[bytes], table: list[bytes], size: np.ndarray) -> bool:
            ids, ends = np.frombuffer(b"".join(side), np.int32), np.cumsum([len(x) // 4 for x in side])
            lengths = np.diff(np.r_[0, np.r_[0, np.cumsum(size[ids])][ends]])
            return np.array_equal(lengths, list(map(len, whole))) and b"".join(map(table.__getitem__, ids.tolist())) == b"".join(whole)

        if as_one(sides[0], self._a_bytes, self._a_size) and as_one(sides[1], self._b_bytes, self._b_size):
            return list(zip(*sides))
        both = zip(spelt(sides[0], self._a_bytes), spelt(sides[1], self._b_bytes))
        return [pair if a == x == b else None for pair, x, (a, b) in zip(zip(*sides), whole, both)]

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B; null for texts whose tokens of A or B don't spell a space and the text."""
        if len(self._known) > WORDS:
            self._known.clear()
        # a space after white space doesn't start a token
        split = [x.split(" ") if self._by_word and x and not (_blanks(x) or x.endswith(" ")) else None for x in texts]
        new = list({w for words in split if words for w in words if w not in self._known})
        self._known.update(zip(new, self._encoded(new) if new else []))
        out = []
        for x, words in zip(texts, split):
            found = list(map(self._known.get, words)) if words else [None]
            if None in found:
                found = self._encoded([x]) if x else [None]
            out.append(None if found[0] is None else tuple(np.frombuffer(b"".join(side), np.int32).astype(np.int64) for side in zip(*found)))
        for w in [w for w in new if len(w) > CHARS]:
            del self._known[w]
        return out

    def links(self, a: np.ndarray, b: np.ndarray) -> tuple[int, str, np.ndarray]:
        """Of one text's ids: the number of groups, their SHA-256, and the code of each link's pair."""
        a_size, b_size = self._a_size[a], self._b_size[b]
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)
        group = np.r_[np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)]
        # from the first token of B that ends after one of A starts, to the last that starts before it ends
        first = np.searchsorted(b_end, a_end - a_size, "right")
        n = np.searchsorted(b_end - b_size, a_end, "left") - first
        left = np.repeat(np.arange(len(a)), n)
        right = np.arange(len(left)) + np.repeat(first - (np.cumsum(n) - n), n)
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((side, group))
        group, side = group[order], side[order]
        sep = np.where(np.r_[True, group[1:] != group[:-1]], 2, np.where(np.r_[True, side[1:] != side[:-1]], 1, 0))
        codes = (sep * self._numbers + np.concatenate([a, b])[order]).tolist()
        spelt = "".join(map(self._spelt.__getitem__, codes))[1:]
        return len(cuts), hashlib.sha256(spelt.encode()).hexdigest(), a[left] * self.width + b[right]


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_model: str = A_MODEL, b_model: str = B_MODEL) -> Aligner:
    """One of a worker for two models."""
    if (a_model, b_model) not in _aligners:
        _aligners[a_model, b_model] = Aligner(a_model, b_model)
    return _aligners[a_model, b_model]


def _linked(a_model: str, b_model: str):
    """(row, doc_id, text) to its counts, its groups' digest and its distinct pairs, ascending, with how often each is linked."""

    def each(batches):
        align = aligner(a_model, b_model)
        for batch in slices(batches, 256):
            counts, digests, pairs, times = [], [], [], []
            for found in align.ids([x or "" for x in batch.column(2).to_pylist()]):
                groups, digest, codes = align.links(*found) if found else (0, "", np.zeros(0, np.int64))
                code, n = np.unique(codes, return_counts=True)
                counts.append([*map(len, found or ((), ())), groups, len(codes)])
                digests.append(digest)
                pairs.append(code)
                times.append(n.astype(np.int32))
            offsets = pa.array(np.r_[0, np.cumsum(list(map(len, pairs)))].astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (pairs, times)]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns, pa.array(digests), *lists], ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return each


def _tally(batches):
    """(pairs, times) of texts to (pair, n), summed over a few texts."""
    for batch in slices(batches, 1024):
        code, at = np.unique(batch.column(0).flatten().to_numpy(), return_inverse=True)
        n = np.bincount(at, batch.column(1).flatten().to_numpy(), len(code)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["pair", "n"])


def pair_counts(linked: DataFrame, width: int, salts: int = SALTS) -> DataFrame:
    """(pairs, times) of all texts to (pair, n, best): how many links of the corpus hold a pair, and whether that is the highest of its B id."""
    tally = linked.select("pairs", "times").mapInArrow(_tally, "pair long, n long")
    tally = tally.groupBy("pair", (F.spark_partition_id() % salts).alias("salt")).agg(F.sum("n").alias("n"))
    counts = written(tally.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts").withColumn("b", F.col("pair") % width)
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))  # a row for each entry of B's vocabulary, at most
    return counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _least_held(counts: DataFrame, held: int) -> int | None:
    """The least count of the most frequent pairs, of which there are at most `held`."""
    least = None
    for r in sorted(counts.groupBy(F.least("n", F.lit(_STEPS)).alias("n")).count().collect(), reverse=True):
        if (held := held - r["count"]) < 0:
            break
        least = r["n"]
    return least


def _weighed(pairs: np.ndarray, counts: np.ndarray, best: np.ndarray):
    """(row, ..., pairs, times) with n_best and count_sum of the pairs held, and the pairs that aren't."""

    def each(batches):
        for batch in slices(batches, 1024):
            code, times = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            ends = np.r_[0, np.cumsum(np.diff(batch.column("pairs").offsets.to_numpy()))]
            at = np.minimum(np.searchsorted(pairs, code), max(0, len(pairs) - 1))
            have = pairs[at] == code if len(pairs) else np.zeros(len(code), bool)
            total = lambda x: np.diff(np.r_[0, np.cumsum(x)][ends])
            sums = total(np.where(have, times * counts[at], 0)) if len(pairs) else np.zeros(batch.num_rows, np.int64)
            bests = total(np.where(have & best[at], times, 0)) if len(pairs) else sums
            offsets = pa.array(np.r_[0, np.cumsum(total(~have))].astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~have])) for x in (code, times)]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(bests), pa.array(sums), *rest], [*names, "n_best", "count_sum", "pairs", "times"])

    return each


def aligned(docs: DataFrame, a_model: str = A_MODEL, b_model: str = B_MODEL, held: int = HELD) -> DataFrame:
    """`docs` (doc_id, text) to doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row each.

    A encodes a space and the text, B the text, to which it adds the space, both without special tokens. Null and empty texts, and those that the
    tokens of A or B don't spell byte for byte, have no tokens: zeros and an empty digest. Texts of any length are aligned
    whole. Repeated rows count and come back as often; a null doc_id stays; other columns, of any name, are ignored; an empty table gives no rows. The models
    are paths that all executors have. `held`: pairs with counts that a task holds.
    """
    spark = docs.sparkSession
    texts = documents(docs).select("row", "doc_id", F.col("data").cast("string").alias("text"))
    linked = written(texts.mapInArrow(_linked(a_model, b_model), _LINKED), "linked")
    counts = written(pair_counts(linked, aligner(a_model, b_model).width), "pairs")
    least = _least_held(counts, held)
    top = counts.where(F.col("n") >= least) if least else counts.limit(0)
    top = top.toArrow().sort_by("pair")
    send = spark.sparkContext.broadcast([top.column(c).to_numpy() for c in ("pair", "n", "best")])
    kept = ", ".join(f"{c} long" for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links"))
    weighed = linked.mapInArrow(lambda batches: _weighed(*send.value)(batches), f"{kept}, groups_sha256 string, n_best long, count_sum long, pairs array<long>, times array<long>")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    others = counts.where(F.col("n") < least) if least else counts
    if others.isEmpty():
        return weighed.select(*out)
    weighed = written(weighed, "weighed")
    rest = weighed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    rest = rest.join(others, "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("of_best"))
    zero = F.lit(0).cast("long")
    weighed = weighed.join(rest, "row", "left")
    for name, more in (("n_best", "of_best"), ("count_sum", "sum")):
        weighed = weighed.withColumn(name, F.col(name) + F.coalesce(F.col(more), zero))
    return weighed.select(*out)
