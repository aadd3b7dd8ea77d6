"""Fuzzy repeated passages by collinear chaining of shared word seeds.

* Seeds are runs of `k` words that hold the least hash of some window of `w` such runs, so equal runs of
  k + w - 1 words of any two documents share one. Every occurrence is matched to the first document with the seed
  only, a star instead of all pairs; occurrences in one document are matched in order.
* The matches of a document with one earlier document are chained: ordered in both, with a cost for gaps, the best
  predecessor within `most` words found in Fenwick trees over the places in the earlier document.
* Chains are aligned on the words themselves: gaps between matches by longest common subsequence, both ends along
  the diagonal while it pays. Parts that overlap or touch are one passage, whichever documents they come from;
  passages long and alike enough remain.

No result depends on how the rows lie in files and batches.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm import bytescan
from loomspark.llm.cutting import without
from loomspark.llm.rows import documents, numbered, unused
from loomspark.llm.scratch import alone, bytes_of, passing, width, written

SEED, SPREAD = 5, 5
#: Words of a passage, and the share of its words that are equal.
WORDS, ALIKE = 40, 0.8
#: Cost of a word between matches, and the most words between two matches of a passage.
GAP, MOST = 0.1, 64
#: Cost of a word that differs, a match being 1, in telling how far a passage goes, and how far the sum falls at most.
LOSS, FALL = 0.75, 4.0
#: Words on both sides of a chain that it may grow over.
SLACK = 20
#: Words on each side of a chain of one match that are looked at for many chains at once.
LOOK = 24
#: Occurrences of a seed in a batch of rows of which only the first by its number in the document is dealt out by the seed.
HOT = 64
#: Slices of texts start and end at multiples of so many words, so that many chains ask for the same ones.
STEP = 16
#: Bytes of slices that a task holds at once, and rows of them that it aligns at once.
PART, ROWS = 4 << 20, 512


def seeds_of(data: bytes | None, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first words of the seeds of a text."""
    words = bytescan.words_of(data, bytescan.ALNUM)
    if len(words) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = bytescan.shingles(words, k)
    at = bytescan.minimizers(hashes, w)
    return hashes[at], at


class Fenwick:
    """Largest (value, who) at places up to one, of those put in so far."""

    def __init__(self, n: int):
        self._best = [(float("-inf"), -1)] * (n + 1)

    def put(self, place: int, value: float, who: int) -> None:
        place += 1
        while place < len(self._best):
            if value > self._best[place][0]:
                self._best[place] = (value, who)
            place += place & -place

    def upto(self, place: int) -> tuple[float, int]:
        found = (float("-inf"), -1)
        place += 1
        while place > 0:
            if self._best[place][0] > found[0]:
                found = self._best[place]
            place -= place & -place
        return found


class Nearby:
    """Largest (value, who) at the `span` places before one. Places are cut into blocks of `span`: what is wanted is the head of
    one block and the rest of the block before, so each block has one tree from its start and one from its end."""

    def __init__(self, span: int):
        self._span, self._blocks = span, {}

    def put(self, place: int, value: float, who: int) -> None:
        block, at = divmod(place, self._span)
        if block not in self._blocks:
            self._blocks[block] = Fenwick(self._span), Fenwick(self._span)
        up, down = self._blocks[block]
        up.put(at, value, who)
        down.put(self._span - 1 - at, value, who)

    def before(self, place: int) -> tuple[float, int]:
        block, at = divmod(place, self._span)
        found = (float("-inf"), -1)
        if at and block in self._blocks:
            found = self._blocks[block][0].upto(at - 1)
        if block - 1 in self._blocks:
            found = max(found, self._blocks[block - 1][1].upto(self._span - 1 - at))
        return found


def _scores(at: list[int], there: list[int], k: int, gap: float, most: int) -> tuple[list[float], list[int]]:
    """The best score of a chain that ends at each match, and the match before it (-1: none).

    A match follows another one that stands at most `most` + k words before it in both documents. Matches are cut into blocks
    of so many words: of the block before, those still near enough are put in from the last one back; of the own block, in order.
    """
    span = most + k
    score, before = [float(k)] * len(at), [-1] * len(at)
    last, i = [], 0
    while i < len(at):
        block = at[i] // span
        own = [i]
        while own[-1] + 1 < len(at) and at[own[-1] + 1] // span == block:
            own.append(own[-1] + 1)
        i = own[-1] + 1
        near, early = Nearby(span), {}
        if last and at[last[0]] // span == block - 1:
            for j in reversed(own):
                while last and at[last[-1]] >= at[j] - span:
                    x = last.pop()
                    near.put(there[x], score[x] + gap * (at[x] + there[x]), x)
                early[j] = near.before(there[j])
        near, waiting = Nearby(span), 0
        for j in own:
            while at[own[waiting]] < at[j]:
                x = own[waiting]
                near.put(there[x], score[x] + gap * (at[x] + there[x]), x)
                waiting += 1
            value, x = max(near.before(there[j]), early.get(j, (float("-inf"), -1)))
            gain = value - gap * (at[j] + there[j])
            if x >= 0 and gain > 0:
                score[j], before[j] = k + gain, x
        last = own
    return score, before


def chains(at: list[int], there: list[int], k: int = SEED, gap: float = GAP, most: int = MOST) -> list[list[int]]:
    """Matches (at, there), ascending by `at`, to chains of their numbers, ascending in both places, each in one at most."""
    score, before = _scores(at, there, k, gap, most)
    out, used = [], [False] * len(at)
    for i in sorted(range(len(at)), key=lambda i: (-score[i], i)):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    if len(a) == len(b) and (a == b).all():
        return len(a)
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        new = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def _extent(a, b, i: int, j: int, step: int) -> list[bool]:
    """Which words from (i, j) on, forwards or backwards, are equal, as far as that pays: a match 1, a difference -`LOSS`, before the sum falls by
    over `FALL`. Most end after a few words, so this is a plain walk."""
    total = best = n = 0
    same: list[bool] = []
    while 0 <= i < len(a) and 0 <= j < len(b):
        equal = a[i] == b[j]
        same.append(equal)
        if equal:
            total += 1
            if total > best:
                best, n = total, len(same)
        else:
            total -= LOSS
            if best - total > FALL:
                break
        i += step
        j += step
    return same[:n]


def _runs(same: list[bool], s: int, t: int) -> list[list[int]]:
    """Words along a diagonal from (s, t) on as blocks (from, to, from there, to there, equal, columns) that are equal or differ throughout."""
    out = []
    for equal, run in groupby(same):
        n = len(list(run))
        out.append([s, s + n, t, t + n, n * equal, n])
        s, t = s + n, t + n
    return out


def _longest(blocks: list[list[int]], alike: float, least: int) -> list[tuple[int, int]]:
    """Stretches (first, last) of blocks, each the longest one with a share `alike` of equal words that begins and ends with an equal block,
    then the longest ones before and behind it, of `least` columns or more."""
    out, todo = [], [(0, len(blocks))]
    while todo:
        start, end = todo.pop()
        worth, columns = [0.0], [0]
        for *_, e, c in blocks[start:end]:
            worth.append(worth[-1] + e - alike * c + 1e-9)
            columns.append(columns[-1] + c)
        if columns[-1] < least:
            continue
        # starts of falling worth from the left; ends from the right, each with the earliest start that isn't above it
        starts = []
        for i in range(end - start):
            if blocks[start + i][4] == blocks[start + i][5] and (not starts or worth[i] < worth[starts[-1]]):
                starts.append(i)
        best = (0, 0, 0)
        for j in range(end - start, 0, -1):
            if blocks[start + j - 1][4] == blocks[start + j - 1][5]:
                while starts and worth[starts[-1]] <= worth[j]:
                    i = starts.pop()
                    if i < j:
                        best = max(best, (columns[j] - columns[i], i, j))
        size, i, j = best
        if size >= least:
            out.append((start + i, start + j - 1))
            todo += [(start, start + i), (start + j, end)]
    return sorted(out)


def _best(worth: list[float]) -> list[tuple[int, int]]:
    """The stretches (first, last) of greatest sums: none can be made longer or shorter for more, and no other pays."""
    stack: list[tuple[int, int, float, float]] = []
    total = 0.0
    for i, x in enumerate(worth):
        before, total = total, total + x
        if x <= 0:
            continue
        first, low = i, before
        while True:
            j = next((j for j in range(len(stack) - 1, -1, -1) if stack[j][2] < low), -1)
            if j < 0 or stack[j][3] >= total:
                stack.append((first, i, low, total))
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
    return [(first, last) for first, last, _, _ in stack]


def align(a: np.ndarray, b: np.ndarray, at: list[int], there: list[int], k: int, alike: float = ALIKE) -> list[tuple[int, int, int, int, float]]:
    """Word hashes of two slices and a chain of matches in them to passages (start, end, start there, end there, share of equal words).

    Matches and the gaps between them are weighed, a difference somewhat less than a match, so a match far off takes nothing from those before it. The best
    stretches grow along the diagonal at both ends while that pays. Of each the longest part with a share `alike` of equal words
    remains, and of the rest what is long enough."""
    u, v = memoryview(a), memoryview(b)
    if len(at) == 1:
        s, t = at[0], there[0]
        left, right = _extent(u, v, s - 1, t - 1, -1), _extent(u, v, s + k, t + k, 1)
        n, m = len(left), len(right)
        if k + n + m < 2 * k:
            return []
        share = (k + sum(left) + sum(right)) / (k + n + m)
        if share >= alike:
            return [(s - n, s + k + m, t - n, t + k + m, share)]
    blocks: list[list[int]] = []  # from, to, from there, to there, equal, columns
    x, y = at[0], there[0]
    for i, j in zip(at, there):
        if i < x or j < y:  # the match overlaps the one before: both ends move on by what is new
            step = max(x - i, y - j)
            if step >= k:
                continue
            i, j, n = i + step, j + step, k - step
        else:
            n = k
        if i > x or j > y:
            if i - x == j - y <= k:
                blocks += _runs([u[x + d] == v[y + d] for d in range(i - x)], x, y)
            else:
                blocks.append([x, i, y, j, _common(a[x:i], b[y:j]), max(i - x, j - y)])
        blocks.append([i, i + n, j, j + n, n, n])
        x, y = i + n, j + n
    out = []
    for first, last in _best([e - LOSS * (c - e) for *_, e, c in blocks]):
        s, _, t, *_ = blocks[first]
        _, e, _, f, *_ = blocks[last]
        left, right = _extent(u, v, s - 1, t - 1, -1)[::-1], _extent(u, v, e, f, 1)
        own = [*_runs(left, s - len(left), t - len(left)), *blocks[first : last + 1], *_runs(right, e, f)]
        for i, j in _longest(own, alike, 2 * k):
            equal, columns = (sum(x[c] for x in own[i : j + 1]) for c in (4, 5))
            out.append((own[i][0], own[j][1], own[i][2], own[j][3], equal / columns))
    return out


#: Kinds of rows: an occurrence by its seed, one that has others of its batch behind it, one that stands behind another (seed: its
#: row, other: its place); after the first step a match, what the occurrence in front is matched to, and one that still stands behind.
_ALONE, _FRONT, _BEHIND = 0, 1, 2
_SEED = "kind byte, seed long, row long, at int, turn int, other int"
_MATCH = "kind byte, row long, at int, first long, there int"


def _batch(names: list[str], kind: int, *columns) -> pa.RecordBatch:
    n = len(columns[0])
    types = [pa.int64() if x in ("seed", "row", "first") else pa.int32() for x in names[1:]]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *(pa.array(c).cast(t) for c, t in zip(columns, types))], names)


def _turns(group: np.ndarray) -> np.ndarray:
    """Number from 0 of each entry in its run of equal ones."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)])
    return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)]))


def _seeds(k: int, w: int, hot: int):
    """(row, data) to the occurrences of seeds, each with its turn among those of its document. Of a seed with over `hot` in the
    batch, the first row's of each turn is dealt out by the seed, and the others stand behind it."""
    names = ["kind", "seed", "row", "at", "turn", "other"]

    def each(batches):
        alone()
        for batch in bytescan.slices(batches):
            found = [[np.zeros(0, t)] for t in (np.uint64, np.int64, np.int64)]
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h, at = seeds_of(data, k, w)
                for kept, x in zip(found, (h, np.full(len(h), row, np.int64), at)):
                    kept.append(x)
            seed, row, at = map(np.concatenate, found)
            if not len(seed):
                continue
            order = np.lexsort((at, row, seed))
            seed, row, at = seed[order], row[order], at[order]
            group = np.cumsum(np.r_[0, (seed[1:] != seed[:-1]) | (row[1:] != row[:-1])])
            turn, group = _turns(group), np.cumsum(np.r_[0, seed[1:] != seed[:-1]])
            many = np.bincount(group)[group] > hot
            few = ~many
            yield _batch(names, _ALONE, seed[few].view(np.int64), row[few], at[few], turn[few], np.zeros(few.sum(), np.int64))
            if not many.any():
                continue
            seed, row, at, turn, group = (x[many] for x in (seed, row, at, turn, group))
            order = np.lexsort((row, turn, group))
            seed, row, at, turn, group = (x[order] for x in (seed, row, at, turn, group))
            new = np.r_[True, (group[1:] != group[:-1]) | (turn[1:] != turn[:-1])]
            front = np.flatnonzero(new)[np.cumsum(new) - 1]
            yield _batch(names, _FRONT, seed[new].view(np.int64), row[new], at[new], turn[new], np.zeros(new.sum(), np.int64))
            yield _batch(names, _BEHIND, row[front][~new], row[~new], at[~new], turn[~new], at[front][~new])

    return each


def _firsts(batches):
    """Occurrences by (seed, row, at) to matches with the first row of their seed, turn by turn, its last place for turns beyond; also
    for those that have others behind them. The places in the first row of the last seed are held from batch to batch."""
    names = ["kind", "row", "at", "first", "there"]
    held = None
    for batch in batches:
        behind = batch.filter(pc.equal(batch.column(0), _BEHIND))
        yield _batch(names, _BEHIND, behind.column(2), behind.column(3), behind.column(1), behind.column(5))
        batch = batch.filter(pc.not_equal(batch.column(0), _BEHIND))
        if not batch.num_rows:
            continue
        kind, seed, row, at, turn = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        before = 0
        if held is not None and held[1][0] == seed[0]:
            before = len(held[0])
            kind, seed, row, at, turn = (np.r_[x, y] for x, y in zip(held, (kind, seed, row, at, turn)))
        start = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
        group = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(seed)]))
        first = row[start][group]
        mine = np.bincount(group, weights=row == first).astype(np.int64)
        there = at[start[group] + np.minimum(turn, mine[group] - 1)]
        new = np.arange(len(seed)) >= before
        pick = new & (row != first)
        yield _batch(names, _ALONE, row[pick], at[pick], first[pick], there[pick])
        pick = new & (kind == _FRONT)
        yield _batch(names, _FRONT, row[pick], at[pick], first[pick], there[pick])
        tail = slice(start[-1], start[-1] + mine[-1])
        held = [x[tail] for x in (kind, seed, row, at, turn)]


def _spread(batches):
    """(kind, front, front_at, x, y) by all of it, a front with what it is matched to before those behind it, to the matches of these."""
    held = np.zeros((4, 1), np.int64) - 1
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, *rest = (batch.column(i).to_numpy() for i in range(5))
        rest = np.c_[held, np.stack(rest)]
        kind = np.r_[_FRONT, kind]
        of = np.maximum.accumulate(np.where(kind == _FRONT, np.arange(len(kind)), 0))
        pick = np.flatnonzero((kind == _BEHIND) & (rest[2] != rest[2][of]))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rest[2][pick], rest[3][pick], rest[2][of[pick]], rest[3][of[pick]])], ["row", "at", "first", "there"])
        held = rest[:, of[-1:]]


def _lone(row, first, at, there, k: int) -> pa.RecordBatch:
    """Chains of one match each."""
    sides = [x for y in (at, there) for x in (np.maximum(0, y - SLACK) // STEP * STEP, -(-(y + k + SLACK) // STEP) * STEP)]
    one = pa.array(np.arange(len(row) + 1, dtype=np.int32))
    lists = [pa.ListArray.from_arrays(one, pa.array(x)) for x in (at, there)]
    return pa.RecordBatch.from_arrays([*map(pa.array, (row, first, *sides)), *lists], ["row", "first", "a_from", "a_to", "b_from", "b_to", "at", "there"])


def _chained(k: int, most: int):
    """Matches by (row, first, at) to chains with the slices of both documents that their alignment needs."""
    def out_of(key, at, there):
        for chain in chains(at, there, k, GAP, most):
            a, b = [at[i] for i in chain], [there[i] for i in chain]
            yield (*key, *_rounded(a[0] - SLACK, a[-1] + k + SLACK), *_rounded(b[0] - SLACK, b[-1] + k + SLACK), a, b)

    def batch_of(rows):
        types = [pa.int64()] * 6 + [pa.list_(pa.int64())] * 2
        names = ["row", "first", "a_from", "a_to", "b_from", "b_to", "at", "there"]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    def each(batches):
        key, at, there = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            # pairs of documents with one match need no chaining; the first and the last may have more in other batches
            columns = [batch.column(i).to_numpy().astype(np.int64) for i in range(4)]
            new = np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1]), True]
            lone = new[:-1] & new[1:]
            lone[[0, -1]] = False
            if lone.any():
                yield _lone(*(c[lone] for c in columns), k)
            out = []
            for row, first, a, b in zip(*(c[~lone].tolist() for c in columns)):
                if (row, first) != key:
                    if at:
                        out += out_of(key, at, there)
                    key, at, there = (row, first), [], []
                at.append(a)
                there.append(b)
            if out:
                yield batch_of(out)
        if at:
            yield batch_of(list(out_of(key, at, there)))

    return each


def _rounded(start: int, end: int) -> tuple[int, int]:
    return max(0, start) // STEP * STEP, -(-end // STEP) * STEP


def _slices(batches):
    """(row, asked, doc_id, data) to the hashes of each run of words that is asked for, in batches of about `PART` bytes."""

    def batch_of(rows):
        types = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["row", "from", "to", "doc_id", "words"])

    for batch in bytescan.slices(batches):
        out, size = [], 0
        for row, asked, doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
            joined, starts, ends = bytescan.bounds(bytescan.words_of(data.as_py(), bytescan.ALNUM))
            hashes = bytescan.RangeHash(np.frombuffer(joined, np.uint8))(starts, ends).astype(np.uint32)
            for x in asked.as_py():
                out.append((row, x["from"], x["to"], doc_id, hashes[x["from"] : x["to"]].tobytes()))
                size += len(out[-1][-1])
                if size > PART:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)


_PART = "row long, doc_id long, start_word long, end_word long, source_doc_id long, source_start long, source_end long, alike double"


def _part_batch(rows) -> pa.RecordBatch:
    names = ["row", "doc_id", "start_word", "end_word", "source_doc_id", "source_start", "source_end", "alike"]
    types = [pa.int64()] * 7 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _reach(a, b, i, j, low, high, step: int) -> tuple[np.ndarray, np.ndarray]:
    """What `_extent` gives for many places at once: words that pay from (i, j) on, in words a and b between low and high of each side, and
    whether the walk ended within `LOOK` words."""
    n, best, total = np.zeros(len(i), np.int64), np.zeros(len(i)), np.zeros(len(i))
    at = np.arange(len(i))
    for t in range(1, LOOK + 1):
        inside = (i[at] >= low[0][at]) & (i[at] < high[0][at]) & (j[at] >= low[1][at]) & (j[at] < high[1][at])
        at = at[inside]
        if not len(at):
            break
        total[at] += np.where(a[i[at]] == b[j[at]], 1.0, -LOSS)
        up = at[total[at] > best[at]]
        best[up], n[up] = total[up], t
        at = at[best[at] - total[at] <= FALL]
        i, j = i + step, j + step
    ended = np.ones(len(n), bool)
    ended[at] = False
    return n, ended


def _worth(batch: pa.RecordBatch, k: int) -> np.ndarray:
    """Which chains may hold a part: those of several matches, and those of one around which enough is alike."""
    sides, low, high = [], [], []
    for start, at, words in (("a_from", "at", "a"), ("b_from", "there", "b")):
        data, lists = batch.column(words), batch.column(at)
        ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64) // 4
        first = lists.flatten().to_numpy()[np.cumsum(lists.value_lengths().to_numpy()) - lists.value_lengths().to_numpy()]
        sides.append((np.frombuffer(data.buffers()[2], np.uint32), ends[:-1] + first - batch.column(start).to_numpy()))
        low.append(ends[:-1])
        high.append(ends[1:])
    (a, i), (b, j) = sides
    left, done = _reach(a, b, i - 1, j - 1, low, high, -1)
    right, also = _reach(a, b, i + k, j + k, low, high, 1)
    return (batch.column("at").value_lengths().to_numpy() > 1) | ~done | ~also | (left + right >= k)


def _aligned(k: int, alike: float):
    """Chains with both slices to parts of passages; seeds that nothing is alike around are none."""

    def each(batches):
        alone()
        for batch in batches:
            out = []
            batch = batch.filter(pa.array(_worth(batch, k))) if batch.num_rows else batch
            for part in bytescan.slices([batch], ROWS):
                columns = (part.column(c).to_pylist() for c in ("row", "doc_id", "a_from", "at", "a", "source_doc_id", "b_from", "there", "b"))
                for row, doc_id, a_from, at, a, source, b_from, there, b in zip(*columns):
                    a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
                    for s, e, t, f, share in align(a, b, [x - a_from for x in at], [x - b_from for x in there], k, alike):
                        if e - s >= 2 * k and share >= alike:
                            out.append((row, doc_id, s + a_from, e + a_from, source, t + b_from, f + b_from, share))
            yield _part_batch(out)

    return each


def _whole(k: int, least: int, alike: float):
    """Parts by (row, start_word) to those of passages long and alike enough: parts that overlap or stand at most k words apart are one."""

    def passage(parts):
        cover, at, i = [], parts[0][2], 0  # the fewest parts that reach from the first word to the last
        while i < len(parts):
            best = parts[i]
            at = max(at, best[2])
            while i < len(parts) and parts[i][2] <= at:
                best = max(best, parts[i], key=lambda p: p[3])
                i += 1
            if best[3] > at:
                cover.append(best)
                at = best[3]
        end, equal = parts[0][2], 0.0
        for p in cover:
            equal += (p[3] - max(end, p[2])) * p[7]
            end = p[3]
        size = end - parts[0][2]
        if size >= least and equal >= alike * size:
            return cover
        return [p for p in parts if p[3] - p[2] >= least]

    def each(batches):
        held, end = [], 0
        for batch in batches:
            out = []
            for p in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (p[0] != held[0][0] or p[2] > end + k):
                    out += passage(held)
                    held = []
                end = max(end, p[3]) if held else p[3]
                held.append(p)
            if out:
                yield _part_batch(out)
        if held:
            yield _part_batch(passage(held))

    return each


def _chains(known: DataFrame, n: int, k: int, w: int, hot: int, most: int) -> DataFrame:
    """(row, data) to chains (row, first, at, there) with the slices that their alignment needs."""
    seeds = known.select("row", "data").mapInArrow(_seeds(k, w, hot), _SEED)
    dealt = seeds.repartition(n, "seed").sortWithinPartitions("seed", "row", "at")
    found = written(dealt.mapInArrow(_firsts, _MATCH), "matches")
    matches = found.where(f"kind = {_ALONE}").select("row", "first", "at", "there")
    behind = found.where(f"kind = {_BEHIND}").select("row", "at", F.col("first").alias("front"), F.col("there").alias("front_at"))
    if not behind.isEmpty():
        front = found.where(f"kind = {_FRONT}").select(F.lit(_FRONT).cast("long").alias("kind"), F.col("row").alias("front"), F.col("at").cast("long").alias("front_at"), F.col("first").alias("x"), F.col("there").cast("long").alias("y"))
        both = front.union(behind.select(F.lit(_BEHIND).cast("long"), "front", F.col("front_at").cast("long"), "row", F.col("at").cast("long")))
        both = both.repartition(n, "front", "front_at").sortWithinPartitions("front", "front_at", "kind")
        spread = both.mapInArrow(_spread, "row long, at long, first long, there long")
        matches = matches.union(spread.select("row", "first", F.col("at").cast("int"), F.col("there").cast("int")))
    matches = matches.repartition(n, "row", "first").sortWithinPartitions("row", "first", "at")
    return written(matches.mapInArrow(_chained(k, most), "row long, first long, a_from long, a_to long, b_from long, b_to long, at array<long>, there array<long>"), "chains")


def _passages(known: DataFrame, k: int, w: int, least: int, alike: float, hot: int = HOT, most: int = MOST) -> DataFrame:
    n = width(known.sparkSession)
    with passing(known.sparkSession):
        found = _chains(known, n, k, w, hot, most)
    # copies of a passage ask for the same slice of its first document: once
    mine = found.select("row", F.col("a_from").alias("from"), F.col("a_to").alias("to"))
    theirs = found.select(F.col("first").alias("row"), F.col("b_from").alias("from"), F.col("b_to").alias("to"))
    # and a text is read once for all its slices, whose number the text's own length bounds
    asked = mine.union(theirs).distinct().groupBy("row").agg(F.collect_list(F.struct("from", "to")).alias("asked"))
    asked = asked.join(known, "row").select("row", "asked", "doc_id", "data")
    slices = written(asked.mapInArrow(_slices, "row long, from long, to long, doc_id long, words binary"), "slices")
    a = slices.select("row", F.col("from").alias("a_from"), F.col("to").alias("a_to"), "doc_id", F.col("words").alias("a"))
    b = slices.select(F.col("row").alias("first"), F.col("from").alias("b_from"), F.col("to").alias("b_to"), F.col("doc_id").alias("source_doc_id"), F.col("words").alias("b"))
    both = found.join(a, ["row", "a_from", "a_to"]).join(b, ["first", "b_from", "b_to"])
    parts = both.mapInArrow(_aligned(k, alike), _PART)
    parts = parts.repartition(n, "row").sortWithinPartitions("row", "start_word", "end_word", "source_doc_id", "source_start")
    return parts.mapInArrow(_whole(k, least, alike), _PART)


def repeated_passages(docs: DataFrame, k: int = SEED, w: int = SPREAD, least: int = WORDS, alike: float = ALIKE, hot: int = HOT) -> DataFrame:
    """`docs` (doc_id, text) to the passages that repeat an earlier document: (doc_id, start_word, end_word, source_doc_id,
    source_start, source_end, alike), words counted from 0; a passage from several documents has a row for each part.

    A passage has `least` words or more, of which a share `alike` is equal in order; any with an equal run of
    k + w - 1 words is found. A part's source is the first document, by doc_id, with its seeds. Null and short texts
    have none; rows with equal doc_id are documents of their own, in an order fixed by their texts; other columns, of any name, are
    ignored; an empty table gives no rows. A long text is read in one task and costs memory in proportion.
    """
    return _passages(documents(docs), k, w, least, alike, hot).drop("row")


def without_passages(docs: DataFrame, k: int = SEED, w: int = SPREAD, least: int = WORDS, alike: float = ALIKE) -> DataFrame:
    """`docs` with `text` cut of passages that repeat an earlier document, all columns kept, of any name; documents that
    consist of such passages go. Null and empty texts stay; an empty table stays empty; of repeated rows the first, in an order
    fixed by their texts, stays whole; others are cut if they are long enough. A long text is read in one task and costs memory in proportion."""
    row, spans = unused(docs, "row"), unused(docs, "spans")
    known = numbered(docs, row)
    found = _passages(known.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), bytes_of(F.col("text")).alias("data")), k, w, least, alike)
    cuts = found.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct(F.col("start_word").alias("start"), F.col("end_word").alias("end"))).alias(spans))
    return without(known.join(cuts, row, "left").drop(row), spans)
