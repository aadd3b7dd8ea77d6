"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of the items. Streaming a document's words through it keeps the
longest run that ends at each word; where that run reaches a window of an item, the window's words are hit
and the items at the automaton's state are those it occurs in.

Two neighbouring words of each `step` are looked up first: a window of n words holds one of every n - 1
neighbouring pairs, so where none of those is a pair of an item, no window can stand and the automaton isn't run.
"""

from __future__ import annotations

import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.bytescan import ALNUM, slices, words_of
from loomspark.llm.cutting import without
from loomspark.llm.rows import documents, numbered, unused
from loomspark.llm.scratch import alone, bytes_of, written

WINDOW = 10
#: Share of hit words over which a document goes as a whole.
COVERAGE = 0.5
#: Bytes of items that one automaton holds; more items make more automata, each passed over in turn.
PART = 1 << 20


class SuffixAutomaton:
    """Of word sequences; states with their longest length, suffix link and transitions."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self._items: list[set[int]] = [set()]
        self.short: dict[int, dict[int, set[int]]] = {}
        self._whole: list[tuple[int, list[bytes]]] = []
        self.pairs: set[tuple[bytes, bytes]] = set()
        self.least = window

    def _extend(self, last: int, word: bytes) -> int:
        to = self.next[last].get(word)
        if to is not None:  # the run is there from an earlier item
            return to if self.length[to] == self.length[last] + 1 else self._clone(last, word, to)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at == -1:
            self.link[new] = 0
        else:
            to = self.next[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._clone(at, word, to)
        return new

    def _state(self, length: int, ways: dict) -> int:
        self.next.append(ways)
        self.link.append(0)
        self.length.append(length)
        self._items.append(set())
        return len(self.next) - 1

    def _clone(self, at: int, word: bytes, to: int) -> int:
        copy = self._state(self.length[at] + 1, dict(self.next[to]))
        self.link[copy] = self.link[to]
        self.link[to] = copy
        while at != -1 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def add(self, item: int, words: list[bytes]) -> None:
        if not words:
            return
        self._whole.append((item, words))
        self.least = min(self.least, len(words))
        self.pairs.update(zip(words, words[1:]))
        state = 0
        for word in words:
            state = self._extend(state, word)

    def close(self) -> None:
        """Items of each state: where one of their runs ends, and at all states linked from there."""
        for item, words in self._whole:
            state = 0
            for i, word in enumerate(words):
                state = self.next[state][word]
                at = state
                while at > 0 and self.length[at] >= min(self.window, len(words)) and item not in self._items[at]:
                    self._items[at].add(item)
                    at = self.link[at]
            if len(words) < self.window:
                at = self.suffix(state, len(words))
                self.short.setdefault(len(words), {}).setdefault(at, set()).add(item)
        self._whole = []

    def suffix(self, state: int, length: int) -> int:
        """The state of the last `length` words of a run at `state`."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes], start: int, end: int, hit: bytearray, items: set[int]) -> None:
        """Marks the words of windows within start to end, and gathers the items."""
        state = length = 0
        window, lengths = self.window, sorted(self.short)
        for i in range(start, end):
            word = words[i]
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length >= window:
                at = self.suffix(state, window)
                items |= self._items[at]
                hit[i + 1 - window : i + 1] = b"\1" * window
            for n in lengths:
                if length >= n and (found := self.short[n].get(self.suffix(state, n))):
                    items |= found
                    hit[i + 1 - n : i + 1] = b"\1" * n

    def scan(self, words: list[bytes]) -> tuple[list[dict], set[int]]:
        """Runs of hit words of a document, and the items."""
        hit, items, n, least = bytearray(len(words)), set(), len(words), self.least
        if least < 2 or not self.next[0]:
            if self.next[0]:
                self.hits(words, 0, n, hit, items)
        else:
            step, pairs, done, wide = least - 1, self.pairs, 0, self.window
            ends = [i for i, pair in zip(range(step, n, step), zip(words[step - 1 :: step], words[step::step])) if pair in pairs]
            k = 0
            while k < len(ends):  # regions around the pairs, joined where they overlap
                first = last = ends[k]
                while k + 1 < len(ends) and ends[k + 1] - last <= 2 * wide:
                    k += 1
                    last = ends[k]
                self.hits(words, max(0, first - wide + 1), min(n, last + wide), hit, items)
                k += 1
        spans, end = [], 0
        while (start := hit.find(1, end)) >= 0:
            end = hit.find(0, start)
            end = n if end < 0 else end
            spans.append({"start": start, "end": end})
        return spans, items


_SCHEMA = "doc long, n_words long, spans array<struct<start: long, end: long>>, items array<long>"
_automata: dict[str, SuffixAutomaton] = {}


def _automaton(key: str, items: list, window: int) -> SuffixAutomaton:
    """Built once a worker."""
    if key not in _automata:
        _automata.clear()
        made = _automata[key] = SuffixAutomaton(window)
        for item, data in items:
            made.add(item, words_of(data, ALNUM))
        made.close()
    return _automata[key]


def _scan(items: DataFrame, window: int):
    """A pass of one automaton; `items` is of bounded size."""
    key, held = uuid.uuid4().hex, items.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])

    def each(batches):
        alone("decontam")
        automaton = _automaton(key, held.value, window)
        for batch in slices(batches):
            out = []
            for data in batch.column(1).to_pylist():
                words = words_of(data, ALNUM)
                spans, found = automaton.scan(words)
                out.append((len(words), spans, sorted(x for x in found if x is not None)))
            types = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.int64())]
            cols = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc", "n_words", "spans", "items"])

    return each


def _joined(batches):
    """Spans of several passes made disjoint."""
    for batch in batches:
        out = []
        for spans in batch.column(2).to_pylist():
            merged: list[dict] = []
            for s in sorted(spans, key=lambda x: (x["start"], x["end"])):
                if merged and s["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                else:
                    merged.append(s)
            out.append(merged)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, batch.schema.field(2).type), batch.column(3)], ["doc", "n_words", "spans", "items"])


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, part: int = PART) -> DataFrame:
    """`docs` with `text` cut of its runs of hit words, all columns kept, of any name; documents with a share of hit words over
    `coverage` go. Null and empty texts stay; repeated rows are each cut; without items nothing is cut; an empty table stays empty; a text of any
    length is read whole, in one task."""
    row, spans, most = (unused(docs, x) for x in ("row", "spans", "most"))
    known = numbered(docs, row)
    found = decontaminated(known.select(F.col(row).alias("doc_id"), "text"), benchmark, window, part).where("contaminated")
    hits = found.select(F.col("doc_id").alias(row), F.col("spans").alias(spans), (F.col("n_hit") > coverage * F.col("n_words")).alias(most))
    joined = known.join(hits, row, "left").where(F.col(most).isNull() | ~F.col(most))
    return without(joined.drop(row, most), spans)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part: int = PART) -> DataFrame:
    """`docs` (doc_id, text) and `benchmark` (item_id, text) to one row a document: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated, and spans, the runs of hit words as (start, end).

    Null texts have no words and items without words have no window; no item gives the hash of the empty string.
    Items with a null id have windows like others but aren't listed. Repeated rows come back as often;
    other columns, of any name, are ignored; without documents there are no rows, without items no hits; a text of any length is read whole, in one
    task. The items are sent to
    the executors in parts of about `part` bytes, each of which passes over the documents.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), bytes_of(F.col("text")).alias("data")).where("data is not null")
    parts = max(1, -(-(items.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // part))
    if parts == 1:
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of(F.col("text")).alias("data"))
        found = rows.mapInArrow(_scan(items, window), _SCHEMA).withColumnRenamed("doc", "doc_id")
    else:
        known = written(documents(docs), "documents")
        passes = [known.select("row", "data").mapInArrow(_scan(items.where(F.pmod(F.xxhash64("data"), F.lit(parts)) == k), window), _SCHEMA) for k in range(parts)]
        found = reduce(DataFrame.union, passes).groupBy("doc").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        found = found.mapInArrow(_joined, _SCHEMA).join(known.select(F.col("row").alias("doc"), "doc_id"), "doc")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")
