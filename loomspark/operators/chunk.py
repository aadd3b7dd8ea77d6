"""Documents to passages of a bounded number of words or word pieces."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.text import words
from loomspark.operators.batching import sliced

#: Words whose cost a task remembers.
MEMORY = 200_000


def by_words(docs: DataFrame, most: int) -> DataFrame:
    """`docs` (doc_id, text) to (doc_id, passage, text) of `most` words each, no overlap; a text without words stays as it is."""
    rows = docs.select("doc_id", "text", words(F.col("text")).alias("w"))
    n = F.floor((F.size("w") - 1) / most).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n), lambda i: F.array_join(F.slice("w", i * most + 1, most), " "))
    return rows.select("doc_id", F.posexplode(F.when(F.size("w") > 0, parts).otherwise(F.array("text"))).alias("passage", "text")).withColumn("passage", F.col("passage").cast("long"))


def spans(costs: list[int], budget: int, overlap: int) -> list[tuple[int, int]]:
    """Passages (first word, word after the last) over words of positive cost.

    With `upto[i]` the cost of all words before word i, a passage from word s ends at the last e with upto[e] <= upto[s] + budget, and
    holds word s at least; the next one starts at the first word b with upto[b] >= upto[e] - overlap, and behind s.
    """
    upto = np.cumsum([0, *costs])
    # both ends for every possible start at once; the passages are then one walk over these tables
    ends = np.maximum(np.searchsorted(upto, upto[:-1] + budget, "right") - 1, np.arange(1, len(upto)))
    begins = np.searchsorted(upto, upto - overlap, "left")
    found, at = [], 0
    while at < len(costs):
        found.append((at, int(ends[at])))
        at = len(costs) if ends[at] == len(costs) else max(at + 1, int(begins[ends[at]]))
    return found


def by_cost(docs: DataFrame, most: int, overlap: int, cost: Callable[[str], int]) -> DataFrame:
    """`docs` (doc_id, text) to (doc_id, passage, text) with `cost` for each word (such as `tokens.word_cost`) and two of the `most` kept for the ends of
    a sequence; words of a passage are joined by single spaces. Without words, or with `most` 0, the text stays as it is."""

    def each(batches):
        known: dict[str, int] = {}
        for batch in (part for whole in batches for part in sliced(whole)):
            out = []
            if len(known) > MEMORY:
                known.clear()
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = (text or "").split()
                if not w or most == 0:
                    out.append((doc_id, 0, text))
                    continue
                for x in w:
                    if x not in known:
                        known[x] = max(1, cost(x))
                costs = [known[x] for x in w]
                out += [(doc_id, i, " ".join(w[s:e])) for i, (s, e) in enumerate(spans(costs, max(1, most - 2), overlap))]
            types = [pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["doc_id", "passage", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, passage long, text string")
