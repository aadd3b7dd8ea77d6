"""Mixture-controlled packing of token streams into full windows by deficit round-robin.

Each source is a queue of its documents' tokens. Windows are filled from the queues in the proportions of
their tokens; what a queue is owed or ahead carries to the next window as its deficit. A partition packs
a fixed number of windows, and the tokens each queue gives to it follow from the totals alone (the first so many
tokens of all queues in order of their relative place in their queue), so partitions pack
independently, deficits carry over their borders, and every window but the very last is full.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomspark.llm.scratch import width, written

MODEL = public_tokenizers.path("byte_bpe_50k.json")
#: The same vocabulary as ranks.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WINDOW = 2048
END = 1
#: Windows that one partition packs.
WINDOWS = 1024
#: Most queues. With more sources each queue has several, whose documents are spread evenly over it.
QUEUES = 256
#: Least tokens that a queue gives at once, but for its last.
SLICE = 256
#: Word pieces that a worker remembers.
WORDS = 300_000
#: White space before a space.
_PAIRS = [c + " " for c in map(chr, range(0x3001)) if c.isspace()]
#: Words of Latin script without angle brackets, in which special strings stand.
_PLAIN = re.compile(r"[^<>\u0250-\U0010ffff]*")


def _blanks(text: str) -> bool:
    """Whether the text starts with a space or has white space before one."""
    # a single rare character is found faster than a pair that ends with a frequent one
    return text.startswith(" ") or "  " in text or any(p[0] in text and p in text for p in (_PAIRS[:10] if text.isascii() else _PAIRS) if p != "  ")


class _Ranks:
    """A faster encoder of plain words by the rank file of the same vocabulary."""

    def __init__(self, by_bytes: dict[bytes, int]):
        import tiktoken

        self._encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=by_bytes, special_tokens={})
        self._led = np.zeros(max(by_bytes.values()) + 1, bool)
        self._led[[i for b, i in by_bytes.items() if b.startswith(b" ")]] = True

    def ids(self, text: str) -> np.ndarray:
        return self._encoding.encode_to_numpy(text)

    def led(self, words: list[str], kind: np.dtype) -> list[bytes]:
        """Ids of words after a space, in one pass over all of them: just the first token of each word starts with a space, as
        no word holds one or ends with white space."""
        ids = self.ids(" " + " ".join(words)) if words else np.zeros(0, np.uint32)
        cuts = np.r_[np.flatnonzero(self._led[ids]), len(ids)] * kind.itemsize
        data = ids.astype(kind).tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _same_ranks(tokenizer, ranks: str | None) -> _Ranks | None:
    """The rank file's encoder; null if the two differ in a token."""
    if ranks is None:
        return None
    with open(ranks, "rb") as lines:
        by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    chars = _byte_chars()
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    if {"".join(chars[x] for x in b): i for b, i in by_bytes.items()}.items() - vocabulary.items():
        return None
    return _Ranks(by_bytes)


def _byte_chars() -> list[str]:
    """The printable character that a byte-level vocabulary writes for each byte: itself where printable, else the next from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Encoder:
    """Ids of texts by the library, with those of words remembered.

    The library's split ends before every space that follows other characters than white space, so a text is
    the sequence of its space-led words, each encoded alone. Plain words take a shorter way with the same ids.
    """

    def __init__(self, model: str, end: int, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(model)
        self.type = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._end = np.array([end], self.type).tobytes()
        self._plain = _same_ranks(self._tokenizer, ranks)
        #: Ids of words after a space (without it), and of strings as they are.
        self._led: dict[str, bytes] = {}
        self._whole: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = [b""] * len(texts)
        rest = []
        for i, x in enumerate(texts):
            if self._plain is not None and _PLAIN.fullmatch(x):
                out[i] = self._plain.ids(x).astype(self.type).tobytes()
            else:
                rest.append(i)
        for i, x in zip(rest, self._tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(x.ids, self.type).tobytes()
        return out

    @staticmethod
    def _joined(words: list[str]) -> list[str]:
        """Words split at spaces to strings that can be encoded alone: white space before a space stays with it."""
        out = words[:1]
        for w in words[1:]:
            if not out[-1] or out[-1][-1].isspace():
                out[-1] += " " + w
            else:
                out.append(" " + w)
        return out

    def _learn_led(self, words: list[str]) -> None:
        if self._plain is not None:
            plain = [w for w in words if w and not w[-1].isspace()]
            if not _PLAIN.fullmatch("".join(plain)):
                plain = [w for w in plain if _PLAIN.fullmatch(w)]
            self._led.update(zip(plain, self._plain.led(plain, self.type)))
            words = [w for w in words if w not in self._led]
        self._led.update(zip(words, self._ids([" " + w for w in words])))

    def _gathered(self, lists: list[list[str]], known: dict[str, bytes], learn) -> list[list[bytes]]:
        """The ids of each word; those of new words are learnt together."""
        if len(known) > WORDS:
            known.clear()
        found = [list(map(known.get, words)) for words in lists]
        lack = [(words, ids, [j for j, x in enumerate(ids) if x is None]) for words, ids in zip(lists, found) if None in ids]
        if lack:
            learn(list({words[j] for words, _, at in lack for j in at}))
        for words, ids, at in lack:
            for j in at:
                ids[j] = known[words[j]]
        return found

    def _apart(self, texts: list[str]) -> list[bytes]:
        """Of texts with white space before a space."""
        whole = self._gathered([self._joined(x.split(" ")) for x in texts], self._whole, lambda new: self._whole.update(zip(new, self._ids(new))))
        return [b"".join([*ids, self._end]) for ids in whole]

    def _together(self, texts: list[str]) -> list[bytes]:
        """Of texts without it: each distinct word of all of them is looked up once, and their ids are laid out by NumPy."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        # no word holds a space, and one string is cut faster than many are taken from Arrow
        words = coded.dictionary
        if words.nbytes < 1 << 30:
            words = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), " ")[0].as_py().split(" ")
        else:
            words = words.to_pylist()
        which, ends = coded.indices.to_numpy(), split.offsets.to_numpy()
        first = self._gathered([[words[i] for i in which[ends[:-1]].tolist()]], self._whole, lambda new: self._whole.update(zip(new, self._ids(new))))[0]
        ids = self._gathered([words], self._led, self._learn_led)[0]
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // self.type.itemsize
        begin, n = np.cumsum(counts) - counts, counts[which]
        n[ends[:-1]] = 0  # the first words, which no space leads
        upto = np.cumsum(n)
        data = np.frombuffer(b"".join(ids), self.type)[np.repeat(begin[which] - (upto - n), n) + np.arange(upto[-1])].tobytes()
        cuts = (np.r_[0, upto[ends[1:] - 1]] * self.type.itemsize).tolist()
        return [x + data[i:j] + self._end for x, i, j in zip(first, cuts, cuts[1:])]

    def __call__(self, texts: list[str]) -> list[bytes]:
        blank = [_blanks(x) for x in texts]
        parts = [iter(encode(own) if own else []) for encode, own in ((self._together, [x for x, b in zip(texts, blank) if not b]), (self._apart, [x for x, b in zip(texts, blank) if b]))]
        return [next(parts[b]) for b in blank]


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(model: str, end: int) -> Encoder:
    if (model, end) not in _encoders:
        _encoders[model, end] = Encoder(model, end, RANKS if model == MODEL else None)
    return _encoders[model, end]


class Shares:
    """How many tokens of each queue come before a number of tokens of all: token j of a queue of n stands
    at (j + 1/2) / n, equal places by queue. Exact in integers, and never falling."""

    def __init__(self, totals: list[int]):
        self.totals, self.total = totals, sum(totals)
        self.before = lru_cache(4096)(self._before)

    def _before(self, tokens: int) -> tuple[int, ...]:
        if tokens >= self.total:
            return tuple(self.totals)
        # tokens with (2j + 1) / 2n <= tokens / total, then the nearest ones more or less
        have = [min(n, (2 * n * tokens // self.total + 1) // 2) for n in self.totals]
        while (off := tokens - sum(have)) > 0:
            _, q = min((((2 * have[q] + 1) * self.total / (2 * n), q) for q, n in enumerate(self.totals) if have[q] < n))
            have[q] += 1
        while off < 0:
            _, q = max((((2 * have[q] - 1) * self.total / (2 * n), q) for q, n in enumerate(self.totals) if have[q]))
            have[q] -= 1
            off += 1
        return tuple(have)

    def parts(self, queue: int, start: int, end: int, size: int):
        """(partition, start, end) of the queue's tokens from start to end; size: tokens of a partition."""
        part = max(0, int(start / self.totals[queue] * self.total) // size - 1)
        while self.before((part + 1) * size)[queue] <= start:
            part += 1
        while part and self.before(part * size)[queue] > start:
            part -= 1
        while start < end:
            upto = min(end, self.before((part + 1) * size)[queue])
            if upto > start:
                yield part, start, upto
            start, part = max(start, upto), part + 1


def schedule(quota: list[int], windows: int, window: int, least: int):
    """Deficit round-robin over one partition: (window, queue, tokens) that fill the windows in order.

    Each window adds a queue's share of it to its deficit. A queue that is owed `least` tokens, or all that it has
    left, is served; what room then remains goes to the queues that are owed the most, who go into debt.
    """
    left, total = np.array(quota, np.int64), sum(quota)
    share = left / max(total, 1) * window
    owed = np.zeros(len(quota))
    for w in range(windows):
        room = min(window, int(left.sum()))
        owed += share
        turn = np.argsort(-owed, kind="stable")
        for bar in (least, None):  # first those owed enough, then any with tokens left
            for q in turn.tolist():
                if not room:
                    break
                if not left[q] or (bar is not None and owed[q] < min(bar, left[q])):
                    continue
                n = int(min(room, left[q], owed[q] if bar is not None else max(least, owed[q])))
                if n <= 0:
                    continue
                yield w, q, n
                left[q] -= n
                owed[q] -= n
                room -= n


def _spread(rows: DataFrame, queues: int) -> DataFrame:
    """Rows (doc_id, source, part, at, n, ids) of any number of sources to the same of `queues` queues (doc_id, queue, part, at, n, ids).

    A document stands in its queue where its middle token stands in its source, from 0 to 1, so any stretch of a queue
    holds each of its sources in proportion, up to a document. Ranges of a queue are the parts of the result.
    """
    sums = rows.groupBy("source", "part").agg(F.sum("n").alias("n"))
    by = W.partitionBy("source")
    before = written(sums.select("source", "part", (F.sum("n").over(by.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(by).alias("all")), "sources")
    place = (F.col("before") + F.col("at") + F.col("n") / 2) / F.col("all")
    queue = F.pmod(F.xxhash64("source"), F.lit(queues)).cast("int")
    order = ["queue", "place", "source", "part", "at"]
    dealt = rows.join(before, ["source", "part"]).withColumn("place", place).withColumn("queue", queue)
    dealt = dealt.repartitionByRange(width(rows.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "queue", "n", "ids")

    def numbered(batches):
        at, part = {}, TaskContext.get().partitionId()
        for batch in batches:
            starts = []
            for q, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                starts.append(at.get(q, 0))
                at[q] = starts[-1] + n
            parts = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], parts, pa.array(starts, pa.int64()), *batch.columns[2:]], ["doc_id", "queue", "part", "at", "n", "ids"])

    return written(dealt.mapInArrow(numbered, _TOKENS), "queues")


_TOKENS = "doc_id long, queue int, part int, at long, n long, ids binary"


def packed(docs: DataFrame, model: str = MODEL, end: int = END, window: int = WINDOW, windows: int = WINDOWS, least: int = SLICE, queues: int = QUEUES, tokens: bool = False) -> DataFrame:
    """`docs` (doc_id, text, source) to pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source_queue),
    with `tokens` also ids, the piece's token ids (array<int>): ordered by offset they are a sequence.

    A document's ids are the library's for `model`, then `end`; null and empty texts have `end` alone. Each id lies
    in just one piece, each sequence holds `window` ids, the last one what is left. A null source is a source.
    A document longer than all windows of a partition goes on in the next partitions. Repeated rows are packed as
    often; other columns, of any name, are ignored; an empty table gives no rows. The target mix is that of the whole
    table, by source exactly up to a window, with more than `queues` sources up to a window and a document.
    """
    spark = docs.sparkSession
    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    names = [r[0] for r in docs.select(source.alias("s")).distinct().limit(queues + 1).collect()]
    many = len(names) > queues
    place = {s: i for i, s in enumerate(sorted(names))}

    def encoded(batches):
        encode, at = encoder(model, end), {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            out = []
            rows = batch.num_rows
            for k in range(0, rows, 512):
                few = batch.slice(k, 512)
                ids = encode([x or "" for x in few.column(1).to_pylist()])
                for doc_id, name, x in zip(few.column(0).to_pylist(), few.column(2).to_pylist(), ids):
                    n = len(x) // encode.type.itemsize
                    out.append((doc_id, name if many else place[name], part, at.get(name, 0), n, x))
                    at[name] = at.get(name, 0) + n
            types = [pa.int64(), pa.string() if many else pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["doc_id", "queue", "part", "at", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), source.alias("source"))
    rows = written(rows.mapInArrow(encoded, _TOKENS.replace("queue int", "queue string") if many else _TOKENS), "tokens")
    if many:
        rows = _spread(rows.withColumnRenamed("queue", "source"), queues)
    sums = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    # written, so that its size is known when the join with the texts' ids is planned
    before = written(sums.select("queue", "part", (F.sum("n").over(W.partitionBy("queue").orderBy("part")) - F.col("n")).alias("before")), "before")
    totals = [0] * (queues if many else max(1, len(names)))
    for r in sums.groupBy("queue").agg(F.sum("n").alias("n")).collect():  # at most `queues` rows
        totals[r["queue"]] = r["n"]
    shares, size = Shares([max(0, n) for n in totals]), window * windows
    total = shares.total

    def deal(batches):
        mine = Shares(totals)
        for batch in batches:
            out = []
            for doc_id, queue, at, n, ids in zip(*(batch.column(i).to_pylist() for i in range(5))):
                wide = len(ids) // n
                for part, s, e in mine.parts(queue, at, at + n, size):
                    out.append((part, queue, s, doc_id, s - at, n, ids[(s - at) * wide : (e - at) * wide]))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["pack", "queue", "at", "doc_id", "start", "doc_tokens", "ids"])

    def fill(pack, held, kind):
        mine = Shares(totals)
        a, b = mine.before(pack * size), mine.before(min(total, (pack + 1) * size))
        quota = [y - x for x, y in zip(a, b)]
        heads, used, offset, last, out, pieces = [0] * len(quota), [0] * len(quota), 0, -1, [], []
        for w, q, n in schedule(quota, windows, window, least):
            if w != last:
                offset, last = 0, w
            while n:
                doc_id, start, doc_tokens, ids = held[q][heads[q]]
                have = len(ids) // kind.itemsize - used[q]
                m = min(n, have)
                piece = np.frombuffer(ids, kind, m, used[q] * kind.itemsize).astype("<u4")
                out.append((doc_id, start + used[q], m, zlib.crc32(piece.tobytes()), doc_tokens, pack * windows + w, offset, q))
                if tokens:
                    pieces.append(piece.view(np.int32))
                n, offset, used[q] = n - m, offset + m, used[q] + m
                if m == have:
                    heads[q], used[q] = heads[q] + 1, 0
        columns = [pa.array([r[i] for r in out], pa.int64()) for i in range(8)]
        if tokens:
            ends = np.cumsum([0, *map(len, pieces)], dtype=np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *pieces]))))
        return pa.RecordBatch.from_arrays(columns, names_out)

    def fills(batches):
        kind, pack, held = encoder(model, end).type, None, {}
        for batch in batches:
            for p, queue, _, *rest in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if p != pack:
                    if held:
                        yield fill(pack, held, kind)
                    pack, held = p, {}
                held.setdefault(queue, []).append(rest)
        if held:
            yield fill(pack, held, kind)

    names_out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source_queue", *["ids"] * tokens]
    placed = rows.join(before, ["queue", "part"]).select("doc_id", "queue", (F.col("at") + F.col("before")).alias("at"), "n", "ids")
    # mapInArrow takes columns in order
    dealt = placed.select("doc_id", "queue", "at", "n", "ids").mapInArrow(deal, "pack long, queue int, at long, doc_id long, start long, doc_tokens long, ids binary")
    dealt = dealt.repartition(width(spark), "pack").sortWithinPartitions("pack", "queue", "at")
    return dealt.mapInArrow(fills, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source_queue long" + ", ids array<int>" * tokens)
