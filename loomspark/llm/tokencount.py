"""Exact token counts by a finite-state compilation of a BPE tokenizer.

`CountTransducer` reads a text character by character. Its state is what the merges can still depend on: the longest end
of the text that a piece can go on from, and for each position in it the last token there and how many tokens lie
between. Histories that agree in that are one state. States and transitions are compiled when first met, and
each transition is annotated with the change of the token count. For the last token at a position only one
piece is possible: the one that ends there and stays apart from the token before it when the two are merged alone.

A chunk of a text is a map from the states it can be entered in to the state it is left in and the tokens
between. The states it can be entered in are those after some more characters before the chunk, read from a few places
on: in most texts all of these lead to the same one. Maps compose associatively, and a document's count is their
scan: first in groups of neighbouring chunks, then over the groups.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.rows import documents
from loomspark.llm.scratch import written

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 4096
#: Characters of a chunk, and chunks of which maps are composed first.
CHUNK, GROUP = 1 << 16, 64
#: Characters before a chunk from which on its states of entry are found, at least.
LEAD = 64
#: Compiled states and remembered words of a worker; beyond, it starts anew.
STATES, WORDS = 300_000, 800_000
_MARK = "▁"


class CountTransducer:
    """Counts the tokens of character sequences. State 0 is the empty text's.

    `_steps[state][character]` is the next state and the change of the count, compiled when first taken. `_keys[state]` is
    (tail, tokens, counts): the longest end of the text that a piece can go on from, and the last token and the count (that
    of the whole text taken off) at each position from its start to its end.
    """

    def __init__(self, rank: dict[str, int]):
        self.rank = rank
        self.longest = max(map(len, rank), default=1)
        self._apart: dict[tuple[str, str], bool] = {}
        #: Pieces that come out of their own characters, and what they begin with.
        self._standing = {x for x in rank if self.merged(x) == [x]}
        self._begun = {x[:i] for x in self._standing for i in range(1, len(x))}
        self._reset()

    def _reset(self) -> None:
        self._steps: list[dict[str, tuple[int, int]]] = []
        self._keys: list[tuple] = []
        self._known: dict[tuple, int] = {}
        self.state(("", ("",), (0,)))

    def state(self, key: tuple) -> int:
        """The number of a state."""
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self._keys)
            self._keys.append(key)
            self._steps.append({})
        return found

    def key(self, state: int) -> str:
        """A state's name, the same in all workers."""
        return json.dumps(self._keys[state])

    def merged(self, text: str) -> list[str]:
        """The pieces by definition: the best-ranked pair merges first, the leftmost of equals."""
        parts, rank = list(text), self.rank.get
        while len(parts) > 1:
            ranks = [rank(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 60:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _stay_apart(self, a: str, b: str) -> bool:
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) > 2 * STATES:
                self._apart.clear()
            known = self._apart[a, b] = not a or self.merged(a + b) == [a, b]
        return known

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        if len(self._keys) > STATES:
            key = self._keys[state]
            self._reset()
            state = self.state(key)
        tail, tokens, counts = self._keys[state]
        text, n, piece = tail + char, 1, char
        # one piece at most stays apart from the token before it, so the order of trial is free
        while not ((n == 1 or piece in self._standing) and self._stay_apart(tokens[-n], piece)):
            n += 1
            piece = text[-n:]
        change = counts[-n] + self._size(piece)
        new = text
        while new and new not in self._begun:
            new = new[1:]
        at = len(text) - len(new)
        tokens, counts = (*tokens, piece)[at:], tuple(c - change for c in (*counts, change)[at:])
        if tokens[0] not in self.rank or (new.startswith(_MARK) and not tokens[0].endswith(_MARK)):
            tokens = ("", *tokens[1:])  # nothing merges with what stands before
        step = self._steps[state][char] = self.state((new, tokens, counts)), change
        return step

    def _size(self, piece: str) -> int:
        """A character without a piece gives a token a byte."""
        return 1 if piece in self.rank else len(piece.encode())

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """The state after a text that is entered in `state`, and its tokens."""
        total, steps = 0, self._steps
        for char in text:
            step = steps[state].get(char)
            if step is None:
                step = self._compile(state, char)
                steps = self._steps
            state, change = step
            total += change
        return state, total


class Counter:
    """Counts the tokens of text. A word from its mark on leads from any state to the same one, so it is one transition, whose
    count is remembered."""

    def __init__(self, rank: dict[str, int]):
        self.machine = CountTransducer(rank)
        self._known: dict[str, int] = {}
        self._words = re.compile(f"{_MARK}+[^{_MARK}]*")
        self._end = re.compile(f"(?<=[^{_MARK}]){_MARK}")

    def _counts(self, words: list[str], lead: str) -> int:
        """Of words that follow `lead`, a mark or none (words with theirs)."""
        found = list(map(self._known.get, words))
        if None in found:
            if len(self._known) >= WORDS:
                self._known.clear()
            for i, n in enumerate(found):
                if n is None:
                    n = found[i] = self.machine.run(lead + words[i])[1]
                    if len(words[i]) <= 40:
                        self._known[words[i]] = n
        return sum(found)

    def marked(self, text: str) -> int:
        """Tokens of a text that starts with a mark."""
        if _MARK * 2 in text or text.endswith(_MARK):
            return sum(self._counts([x[1:]], _MARK) if x[1:2] not in ("", _MARK) else self.machine.run(x)[1] for x in self._words.findall(text))
        return self._counts(text[1:].split(_MARK), _MARK)

    def maps(self, lead: str, text: str, last: bool) -> list[tuple[str, str, int]]:
        """The map of a chunk: (entry, exit, tokens) for each state it can be entered in. lead: what stands before, or empty at the start of
        a document, which begins with a mark; last: nothing follows."""
        machine = self.machine
        if not lead:
            entries, head, rest = [0], "", text
        else:
            first = self._end.search(text)
            head, rest = (text[: first.start()], text[first.start() :]) if first else (text, "")
            starts = range(max(0, len(lead) - LEAD - machine.longest), max(0, len(lead) - LEAD) + 1)
            keys = {machine.key(machine.run(lead[i:])[0]) for i in starts}
            entries = [machine.state(_read(k)) for k in sorted(keys)]
        inner, out = self.marked(rest) if rest else 0, []
        name = ""
        if rest and not last:
            cut = len(rest.rstrip(_MARK))
            while cut and rest[cut - 1] != _MARK:
                cut -= 1
            name = machine.key(machine.run(rest[max(0, cut - 1) :])[0])
        for key in [machine.key(e) for e in entries]:
            state, n = machine.run(head, machine.state(_read(key)))
            out.append((key, "" if last else name or machine.key(state), n + inner))
        return out

    def total(self, text: str) -> int:
        """All of a text that starts with a mark, character by character."""
        return self.machine.run(text)[1]


def _read(key: str) -> tuple:
    tail, tokens, counts = json.loads(key)
    return tail, tuple(tokens), tuple(counts)


_counters: dict[str, Counter] = {}


def counter(model: str = MODEL) -> Counter:
    """One compiled tokenizer a worker and model."""
    if model not in _counters:
        spm = sentencepiece.SentencePieceProcessor(model_file=model)
        rank = {spm.id_to_piece(i): -spm.get_score(i) for i in range(spm.get_piece_size()) if not (spm.is_control(i) or spm.is_unknown(i) or spm.is_byte(i) or spm.is_unused(i))}
        if any(_MARK in x.lstrip(_MARK) for x in rank):
            raise ValueError("a piece goes on over a word's end")
        _counters[model] = Counter(rank)
    return _counters[model]


_MAPS = "array<struct<entry: string, exit: string, n: long>>"


def composed(chunks: Column) -> Column:
    """Maps of neighbouring chunks, ARRAY<STRUCT<at, maps>> in order, to the map of all: for each state of entry of the first, what the
    others make of its exit. An exit that a chunk has no entry for gives a null exit and count."""

    def after(m: Column, chunk: Column) -> Column:
        on = F.get(F.filter(chunk["maps"], lambda x: x["entry"] == m["exit"]), 0)
        return F.struct(m["entry"].alias("entry"), on["exit"].alias("exit"), (m["n"] + on["n"]).alias("n"))

    rest = F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0)))
    return F.transform(F.get(chunks, 0)["maps"], lambda m: F.aggregate(rest, F.struct(m["entry"].alias("entry"), m["exit"].alias("exit"), m["n"].alias("n")), after))


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT, chunk: int = CHUNK, group: int = GROUP) -> DataFrame:
    """`docs` (doc_id, text) to (doc_id, n_bytes, n_tokens, over_limit), one row each.

    Tokens are those of the library for `model`, without begin, end or other added tokens. Null and empty texts
    have 0 bytes and tokens. A text of any length is counted in chunks of `chunk` characters, in different tasks; one whose
    maps don't meet (there, what stands far before a chunk still tells) is read again in one. Repeated rows come back as
    often; other columns, of any name, are ignored; an empty table gives no rows. `model` is a path that all executors have.
    """

    def maps(batches):
        count = counter(model)
        names = ["row", "doc_id", "at", "n_bytes", "maps"]
        kind = pa.list_(pa.struct([("entry", pa.string()), ("exit", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            sizes, out = [], []
            for at, lead, text, last in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
                sizes.append(len(text.encode()))
                text = text.replace(" ", _MARK)
                if at == 0:
                    found = count.maps("", _MARK + text, last) if text else [("", "", 0)]
                else:
                    found = count.maps((_MARK if at * chunk <= len(lead) else "") + lead.replace(" ", _MARK), text, last)
                out.append([{"entry": a, "exit": b, "n": n} for a, b, n in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(out, kind)], names)

    def whole(batches):
        count = counter(model)
        for batch in batches:
            n = [count.total(_MARK + x.replace(" ", _MARK)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["row", "n"])

    texts = documents(docs).select("row", "doc_id", F.coalesce(F.col("data").cast("string"), F.lit("")).alias("text"))
    lead = LEAD + 64
    size = F.length("text")
    pieces = F.greatest(F.lit(0), F.floor((size - 1) / chunk).cast("int"))

    def cut(i: Column) -> Column:
        start = F.greatest(i * chunk - lead, F.lit(0))
        return F.struct(F.substring("text", start + 1, i * chunk - start).alias("lead"), F.substring("text", i * chunk + 1, F.lit(chunk)).alias("chunk"), (i == pieces).alias("last"))

    # a text of one chunk needs no cutting
    one = F.array(F.struct(F.lit("").alias("lead"), F.col("text").alias("chunk"), F.lit(True).alias("last")))
    cuts = F.when(size <= chunk, one).otherwise(F.transform(F.sequence(F.lit(0), pieces), cut))
    chunks = texts.select("row", "doc_id", F.posexplode(cuts).alias("at", "c")).select("row", "doc_id", "at", "c.lead", "c.chunk", "c.last")
    mapped = chunks.mapInArrow(maps, f"row long, doc_id long, at int, n_bytes long, maps {_MAPS}")
    for by in ([F.expr(f"at div {group}").alias("at")], []):  # the scan's two levels
        place = F.struct("at", "maps")
        mapped = mapped.groupBy("row", *by).agg(F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(place)).alias("chunks"))
        mapped = mapped.select("row", *["at" for _ in by], "doc_id", "n_bytes", composed(F.col("chunks")).alias("maps"))
    counts = written(mapped.select("row", "doc_id", "n_bytes", F.get("maps", 0)["n"].alias("n_tokens")), "counts")
    if not (open_ := counts.where("n_tokens is null")).isEmpty():
        again = texts.join(open_.select("row"), "row", "left_semi").select("row", "text").mapInArrow(whole, "row long, n long")
        counts = counts.join(again, "row", "left").withColumn("n_tokens", F.coalesce("n_tokens", "n"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
