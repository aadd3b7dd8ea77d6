"""Removal of byte strings of a threshold length that occur earlier, by a depth-limited radix order.

Suffixes are told apart only to `depth` bytes, most significant digit first, and a group of one leaves after
the pass that made it. Every window of `depth` bytes is represented by its anchor, the least-hashed `digit`
bytes in it, so equal windows have equal anchors at equal offsets and the first pass deals out about
2 / (depth - digit) suffixes a byte instead of one.

* Digit 1 is the anchor's bytes.
* Digit 2 is all bytes around it: a run is the windows with the same anchor, and runs with equal bytes
  are equal in every window.
* Digit 3, only for anchors with runs that differ, is each window of the first run of each kind. The runs are sent
  with their bytes and compared byte by byte; those of anchors with very many runs are dealt out window by window.

The first of each group stays; the windows of all others are removed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.bytescan import RangeHash, mixed, slices, sliding_argmin
from loomspark.llm.rows import documents
from loomspark.llm.scratch import width, written

DEPTH = 100
DIGIT = 40
#: Differing runs with one anchor in a batch of rows from which the anchor's runs are dealt out by their own digit.
HOT = 256
#: Differing runs with one anchor in all rows whose windows one task compares; those of more are dealt out.
MANY = 4096

_REMOVED, _RUN, _HOT = 0, 1, 2
#: A span is its start, times 2**32, and its length.
_ROWS = "kind byte, key long, run long, row long, span long"
_PIECES = "kind byte, key long, second long, row long, span long, data binary"
#: The run of the row that tells an anchor's other runs that it is hot; it sorts first.
_MARK = np.iinfo(np.int64).min
#: Base of the second hash of windows.
_OTHER = 0xD6E8FEB86659FD93


def _i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _packed(start, end):
    return (np.asarray(start, np.int64) << 32) | (np.asarray(end, np.int64) - np.asarray(start, np.int64))


def _ends(span: np.ndarray):
    start = span >> 32
    return start, start + (span & 0xFFFFFFFF)


def _batch(kind, key, run, row, span) -> pa.RecordBatch:
    kind = pa.array(np.full(len(row), kind, np.int8))
    return pa.RecordBatch.from_arrays([kind, *(pa.array(np.asarray(x, np.int64)) for x in (key, run, row, span))], ["kind", "key", "run", "row", "span"])


def _merged(row, start, end):
    """Sorted disjoint spans of each row."""
    if not len(row):
        return row, start, end
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    # the furthest end so far in the row: ends are lifted so that rows don't meet
    lift = (np.cumsum(np.r_[False, row[1:] != row[:-1]])) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + lift)
    new = np.r_[True, start[1:] + lift[1:] > reach[:-1]]
    last = np.r_[new[1:], True]
    return row[new], start[new], (reach - lift)[last]


def _runs(depth: int, digit: int, hot: int):
    """Documents to runs. What a batch of rows already tells (later equal runs) is removed before the shuffle."""

    def each(batches):
        for batch in slices(batches):
            rows, found = batch.column(0).to_pylist(), [[], [], [], [], []]
            for row, data in zip(rows, batch.column(1).to_pylist()):
                if data is None or len(data) < depth:
                    continue
                ranges = RangeHash(np.frombuffer(data, np.uint8))
                grams = ranges.grams(digit)
                at = sliding_argmin(grams, depth - digit + 1)
                first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
                end = np.r_[first[1:] - 1, len(at) - 1] + depth
                found[0].append(grams[at[first]])
                found[1].append(ranges(first, end) + mixed((at[first] - first).astype(np.uint64)))
                found[2].append(np.full(len(first), row, np.int64))
                found[3].append(first)
                found[4].append(end)
            if not found[0]:
                continue
            anchor, run, row, start, end = map(np.concatenate, found)
            order = np.lexsort((start, row, run, anchor))
            anchor, run, row, start, end = (x[order] for x in (anchor, run, row, start, end))
            same = np.r_[False, (anchor[1:] == anchor[:-1]) & (run[1:] == run[:-1])]
            spans = _merged(row[same], start[same], end[same])
            none = np.zeros(len(spans[0]), np.int64)
            yield _batch(_REMOVED, _i64(mixed(spans[0].view(np.uint64))), none, spans[0], _packed(*spans[1:]))
            anchor, run, row, span = anchor[~same], run[~same], row[~same], _packed(start, end)[~same]
            group = np.cumsum(np.r_[False, anchor[1:] != anchor[:-1]])
            many = np.bincount(group)[group] > hot
            yield _batch(_RUN, _i64(anchor[~many]), _i64(run[~many]), row[~many], span[~many])
            key = mixed(anchor ^ (run & np.uint64(63)) * np.uint64(0x9E3779B97F4A7C15))
            yield _batch(_HOT, _i64(key[many]), _i64(run[many]), row[many], span[many])
            told = np.unique(anchor[many])
            none = np.zeros(len(told), np.int64)
            yield _batch(_HOT, _i64(told), none + _MARK, none, none)

    return each


def _second_digit(batches):
    """Rows by (key, run, row, span): later equal runs are removed; the first of each kind goes on if the anchor has another
    kind, or is hot. Only the last group's first row is held from batch to batch."""
    last_key = last_run = None
    held, several, hot = None, False, False  # the only run so far of the last key; whether it has others; whether it is hot
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, key, run, row, span = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        gone = kind == _REMOVED
        yield _batch(_REMOVED, key[gone], run[gone], row[gone], span[gone])
        kind, key, run, row, span = (x[~gone] for x in (kind, key, run, row, span))
        if not len(row):
            continue
        goes_on = bool(key[0] == last_key)
        alike = np.r_[goes_on, key[1:] == key[:-1]]
        equal = alike & np.r_[goes_on and run[0] == last_run, run[1:] == run[:-1]]
        marks = span == 0
        later = equal & ~marks
        yield _batch(_REMOVED, key[later], run[later], row[later], span[later])
        group = np.cumsum(~alike) - (not alike[0])
        reps = ~equal & ~marks
        first = np.flatnonzero(np.r_[True, ~alike[1:]])
        hots = kind[first] == _HOT
        kinds = np.bincount(group, weights=reps)
        differ = (kinds > 1) | hots
        if goes_on:
            hots[0] |= hot
            differ[0] = several or hots[0] or kinds[0] + (held is not None) > 1
        if held is not None and (not goes_on or differ[0]):
            if goes_on:
                yield _batch(_HOT if hots[0] else _RUN, *([x] for x in held))
            held = None
        for kind_, pick in ((_RUN, ~hots), (_HOT, hots)):
            on = reps & (differ & pick)[group]
            yield _batch(kind_, key[on], run[on], row[on], span[on])
        several, hot = bool(differ[-1]), bool(hots[-1])
        if not several:
            mine = np.flatnonzero(reps & (group == group[-1]))
            if len(mine):
                i = mine[0]
                held = (key[i], run[i], row[i], span[i])
        last_key, last_run = key[-1], run[-1]


def _pieces(depth: int):
    """(row, data, runs) to runs with their bytes, by anchor, and windows of hot ones, by two hashes; later equal windows of a batch
    come as spans to be removed."""

    def batch_of(kind, key, second, row, span, data=None) -> pa.RecordBatch:
        ints = [pa.array(np.asarray(x, np.int64)) for x in (key, second, row, span)]
        data = pa.nulls(len(row), pa.binary()) if data is None else pa.array(data, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(row), kind, np.int8)), *ints, data], ["kind", "key", "second", "row", "span", "data"])

    def each(batches):
        for batch in slices(batches):
            out, hashes, others, rows, starts = [], [], [], [], []
            for row, data, runs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                p = []
                for r in runs:
                    start, end = r["span"] >> 32, (r["span"] >> 32) + (r["span"] & 0xFFFFFFFF)
                    if r["hot"]:
                        p.append(np.arange(start, end - depth + 1))
                    else:
                        out.append((r["key"], row, r["span"], data[start:end]))
                if p:
                    whole, p = np.frombuffer(data, np.uint8), np.unique(np.concatenate(p))
                    hashes.append(RangeHash(whole)(p, p + depth))
                    others.append(RangeHash(whole, _OTHER)(p, p + depth))
                    rows.append(np.full(len(p), row, np.int64))
                    starts.append(p)
            if out:
                key, row, span, data = zip(*out)
                yield batch_of(_RUN, key, np.zeros(len(key)), row, span, data)
            if not rows:
                continue
            h, other, row, start = map(np.concatenate, (hashes, others, rows, starts))
            order = np.lexsort((start, row, other, h))
            h, other, row, start = h[order], other[order], row[order], start[order]
            same = np.r_[False, (h[1:] == h[:-1]) & (other[1:] == other[:-1])]
            spans = _merged(row[same], start[same], start[same] + depth)
            yield batch_of(_REMOVED, _i64(mixed(spans[0].view(np.uint64))), np.zeros(len(spans[0])), spans[0], _packed(*spans[1:]))
            h, other, row, start = h[~same], other[~same], row[~same], start[~same]
            yield batch_of(_HOT, _i64(h), _i64(other), row, _packed(start, start + depth))

    return each


def _third_digit(depth: int):
    """Pieces by (kind, key, second, row, span) to spans of all windows but the first of each kind."""

    def removed(key, rows, seen, last):
        """Windows of runs with their bytes: `seen` holds those of the anchor `last`."""
        out = []
        for k, row, span, data in zip(key, *(rows.column(i).to_pylist() for i in (3, 4, 5))):
            if k != last:
                seen.clear()
                last = k
            at, start = span >> 32, -1
            for p in range(len(data) - depth + 1):
                w = data[p : p + depth]
                if w in seen:
                    if start < 0:
                        start = p
                else:
                    seen.add(w)
                    if start >= 0:
                        out.append((row, ((at + start) << 32) | (p - 1 + depth - start)))
                        start = -1
            if start >= 0:
                out.append((row, ((at + start) << 32) | (len(data) - start)))
        return out, last

    def spans(row, span) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(row, np.int64)), pa.array(np.asarray(span, np.int64))], ["row", "span"])

    def each(batches):
        seen, anchor, last = set(), None, (None, None)
        for batch in batches:
            if not batch.num_rows:
                continue
            yield batch.filter(pc.equal(batch.column(0), _REMOVED)).select(["row", "span"])
            runs = batch.filter(pc.equal(batch.column(0), _RUN))
            for i in range(0, runs.num_rows, 4096):
                part = runs.slice(i, 4096)
                out, anchor = removed(part.column(1).to_pylist(), part, seen, anchor)
                if out:
                    yield spans(*zip(*out))
            windows = batch.filter(pc.equal(batch.column(0), _HOT))
            if windows.num_rows:
                seen.clear()
                h, other, row, span = (windows.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
                same = np.r_[(h[0], other[0]) == last, (h[1:] == h[:-1]) & (other[1:] == other[:-1])]
                last = (h[-1], other[-1])
                row, start, end = _merged(row[same], *_ends(span[same]))
                yield spans(row, _packed(start, end))

    return each


def _repeated(docs: DataFrame, dealt: DataFrame, depth: int, digit: int, hot: int, many: int) -> DataFrame:
    """(row, doc_id, data) to spans (row, span), overlapping or not, that cover just the bytes of windows of
    `depth` bytes that also start earlier, in a smaller row or before in the same. `dealt` are the same rows, dealt out by row."""
    if not 0 < digit <= depth:
        raise ValueError("a digit has 1 to depth bytes")
    n = width(docs.sparkSession)
    runs = docs.select("row", "data").mapInArrow(_runs(depth, digit, hot), _ROWS)
    runs = runs.repartition(n, "key").sortWithinPartitions("key", "run", "row", "span")
    found = written(runs.mapInArrow(_second_digit, _ROWS).select("kind", "key", "row", "span"), "runs")
    on = found.where(f"kind <> {_REMOVED}").select("row", "key", "span", (F.col("kind") == _HOT).alias("hot"))
    full = written(on.where("not hot").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > many).select("key", F.lit(True).alias("full")), "full")
    if not full.isEmpty():
        on = on.join(full, "key", "left").withColumn("hot", F.col("hot") | F.coalesce("full", F.lit(False)))
    kinds = on.groupBy("row").agg(F.collect_list(F.struct("key", "span", "hot")).alias("runs"))
    # all columns of `dealt` are asked for, as by its other join, so that both read one exchange
    pieces = dealt.join(kinds, "row").select("row", "data", "runs", "doc_id").mapInArrow(_pieces(depth), _PIECES)
    pieces = pieces.repartition(n, "key").sortWithinPartitions("kind", "key", "second", "row", "span")
    later = pieces.mapInArrow(_third_digit(depth), "row long, span long")
    return found.where(f"kind = {_REMOVED}").select("row", "span").union(later)


def _kept(batches):
    for batch in batches:
        out = []
        for doc_id, data, spans in zip(*(batch.column(i).to_pylist() for i in range(3))):
            data = data or b""
            removed, pieces, at, n = 0, [], 0, 0
            if spans:
                _, start, end = _merged(np.zeros(len(spans), np.int64), *_ends(np.array(spans, np.int64)))
                for s, e in zip(start.tolist(), end.tolist()):
                    pieces.append(data[at:s])
                    at, removed, n = e, removed + e - s, n + 1
            pieces.append(data[at:])
            out.append((doc_id, len(data), removed, n, hashlib.sha256(b"".join(pieces)).hexdigest()))
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        types = [pa.int64()] * 4 + [pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def deduplicated(docs: DataFrame, depth: int = DEPTH, digit: int = DIGIT, hot: int = HOT, many: int = MANY) -> DataFrame:
    """`docs` (doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row each.

    Texts are UTF-8 bytes, null is empty; windows never cross documents and are judged on the input. Rows with
    equal doc_id are documents of their own, in an order fixed by their texts; other columns, of any name, are ignored;
    an empty table gives no rows; texts shorter than `depth` stay whole; a long text is hashed in one task and costs memory
    in proportion. Windows are compared byte by byte, or by two hashes of 64 bits each where one anchor has
    over `many` differing runs; equal runs are told by 128 bits.
    """
    # the filter drops nothing; with it both joins below ask for the same exchange of the texts
    known = documents(docs).where("row is not null")
    dealt = known.repartition(width(docs.sparkSession), "row")
    spans = _repeated(known, dealt, depth, digit, hot, many).groupBy("row").agg(F.collect_list("span").alias("spans"))
    whole = dealt.join(spans, "row", "left").select("doc_id", "data", "spans")
    return whole.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
