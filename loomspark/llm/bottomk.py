"""Document fingerprints: bottom-k sketches of word shingle hashes.

A sketch is the k least distinct hashes of the shingles of a text. The sketch of several parts is the k least of
their sketches together; two sketches estimate resemblance and containment from the k least of both, and
the k-th hash estimates how many distinct shingles there are.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.bytescan import ALNUM, shingles, words_of
from loomspark.llm.rows import documents
from loomspark.llm.scratch import width

WORDS = 5
K = 128


def sketch(data: bytes | None, k: int = K, words: int = WORDS) -> np.ndarray:
    """Ascending; a text of fewer words is one shingle, one without words has none."""
    return least(shingles(words_of(data, ALNUM), words), k)


def least(hashes: np.ndarray, k: int) -> np.ndarray:
    if len(hashes) > 4 * k:  # distinct ones are among the least, unless the same come again and again
        some = np.unique(np.partition(hashes, 3 * k)[: 3 * k])
        if len(some) >= k:
            return some[:k]
    return np.unique(hashes)[:k]


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return least(np.concatenate([a, b]), k)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of shared among all shingles; 1 for two without any."""
    union = merged(a, b, k)
    return len(np.intersect1d(np.intersect1d(a, union), np.intersect1d(b, union))) / len(union) if len(union) else 1.0


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimate of the distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of a's shingles that b has; 1 if a has none."""
    if not len(a):
        return 1.0
    r, union = resemblance(a, b, k), distinct(merged(a, b, k), k)
    return min(1.0, r * union / distinct(a, k))


def encoded(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def decoded(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compare(k: int, words: int):
    """Documents by (block, copy, row) to results; each waits for the next of its block, whose first may be a copy."""

    def row(doc_id, text, mine, after, theirs):
        edited = _edited(text, after)
        raw = edited.encode()
        other = sketch(raw, k, words)
        return (doc_id, len(text), hashlib.sha256(raw).hexdigest(), encoded(mine), encoded(other), resemblance(mine, other, k), resemblance(mine, theirs, k), distinct(mine, k), containment(other, mine, k))

    def batch_of(out):
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_distinct", "edited_within"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    def each(batches):
        held = None
        for batch in batches:
            out = []
            for block, copy, doc_id, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                text, mine = (data or b"").decode(), sketch(data, k, words)
                if held is not None and held[0] == block:
                    out.append(row(*held[1:], text, mine))
                held = None if copy else (block, doc_id, text, mine)
            if out:
                yield batch_of(out)

    return each


def _blocks(bounds: np.ndarray):
    def each(batches):
        for batch in batches:
            block = np.searchsorted(bounds, batch.column(0).to_numpy(), side="right")
            first = np.unique(block, return_index=True)[0]
            least = [int(batch.column(0).to_numpy()[block == b].min()) for b in first]
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(least, pa.int64())], ["block", "row"])

    return each


def _sent(bounds: np.ndarray, before: dict[int, int]):
    """Each row to its block, the first one of a block also to the block before."""

    def each(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy()
            block = np.searchsorted(bounds, rows, side="right")
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(np.zeros(len(rows), np.int32)), *batch.columns], ["block", "copy", "row", "doc_id", "data"])
            also = [i for i, r in enumerate(rows.tolist()) if r in before]
            if also:
                few = batch.take(pa.array(also))
                to = [before[r] for r in few.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.ones(len(to), np.int32)), *few.columns], ["block", "copy", "row", "doc_id", "data"])

    return each


def compared(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """`docs` (doc_id, text) to one row each: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_distinct (distinct shingles, estimated), edited_within (share of the edited text's shingles that the text has).

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next document by
    ascending doc_id, the first one after the last; a single document is next to itself. Null is an empty
    text; empty texts have an empty fingerprint and are alike. Rows with equal doc_id follow each other in an order
    fixed by their texts; other columns, of any name, are ignored; an empty table gives no rows; a long text is hashed in one task.

    Documents are dealt out once, in blocks of neighbouring ids; the first document of each block also goes
    to the block before, as what follows its last.
    """
    spark = docs.sparkSession
    known = documents(docs)
    n = 4 * width(spark)
    marks = known.select("row").agg(F.percentile_approx("row", [i / n for i in range(1, n)], 10 * n).alias("at")).first()["at"] or []
    bounds = np.unique(np.array(marks, np.int64))  # at most n; a row belongs to the block of the bounds up to it
    firsts = known.select("row").mapInArrow(_blocks(bounds), "block long, row long").groupBy("block").agg(F.min("row").alias("row")).orderBy("block").collect()  # one row a block
    before = {r["row"]: firsts[i - 1]["block"] for i, r in enumerate(firsts)}
    dealt = known.select("row", "doc_id", "data").mapInArrow(_sent(bounds, before), "block long, copy int, row long, doc_id long, data binary")
    dealt = dealt.repartition(width(spark), "block").sortWithinPartitions("block", "copy", "row").select("block", "copy", "doc_id", "data")
    return dealt.mapInArrow(_compare(k, words), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double, edited_within double")
