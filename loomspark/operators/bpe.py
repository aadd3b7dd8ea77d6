"""Byte-pair tokenizers from a tokenizer file: load and check, ids of texts, texts of ids.

A file's added tokens cut a text first, the earliest one and of those the longest; what stands between is split by the file's
pattern, and each piece, as bytes, is merged by rank. The tokenizer is a small table of bounded size that each task holds; the
texts stay where they are.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from loomspark.operators.batching import sliced

#: Pieces whose ids a task remembers.
MEMORY = 200_000
# Fixed value: how the byte-level split cuts a text if the file names no pattern of its own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it is printable, the next from U+0100 on otherwise."""
    own = {b: chr(b) for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    rest = (b for b in range(256) if b not in own)
    return own | {b: chr(256 + i) for i, b in enumerate(rest)}


@dataclass
class Tokenizer:
    """Ids by the bytes of a piece, ranks of the merges, added tokens by their text, the split's patterns, ids that begin a text."""

    ids: dict[bytes, int]
    ranks: dict[tuple[bytes, bytes], int]
    added: dict[str, int] = field(default_factory=dict)
    special: frozenset[int] = frozenset()
    patterns: tuple[str, ...] = (BYTE_LEVEL,)
    whole_first: bool = False
    prefix_space: bool = False
    begin: tuple[int, ...] = ()
    nfc: bool = False

    def __post_init__(self):
        longest_first = sorted(self.added, key=lambda x: (-len(x), x))
        self._added = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self._splits = [regex.compile(p) for p in self.patterns]
        self._bytes = {i: b for b, i in self.ids.items()} | {i: x.encode() for x, i in self.added.items()}
        self._known: dict[bytes, list[int]] = {}

    def pieces(self, text: str) -> list[str]:
        """Between matches the text stays in pieces of its own."""
        parts = [text]
        for split in self._splits:
            out = []
            for part in parts:
                at = 0
                for m in split.finditer(part):
                    out += [part[at : m.start()], m.group()]
                    at = m.end()
                out.append(part[at:])
            parts = [x for x in out if x]
        return parts

    def merged(self, piece: bytes) -> list[bytes]:
        """The pair of least rank merges first, the leftmost of equals; pairs wait in a heap, so a long piece takes n log n."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, b"", after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(parts) and (r := self.ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left], parts[right]))
        return [x for x in parts if x]

    def _piece_ids(self, piece: str) -> list[int]:
        data = piece.encode()
        found = self._known.get(data)
        if found is None:
            if len(self._known) > MEMORY:
                self._known.clear()
            if self.whole_first and data in self.ids:
                found = [self.ids[data]]
            else:
                found = [self.ids[x] for x in self.merged(data) if x in self.ids]
            self._known[data] = found
        return found

    def encode(self, text: str, begin: bool = False) -> list[int]:
        import unicodedata

        out, at = list(self.begin) if begin else [], 0
        for m in [*(self._added.finditer(text) if self._added else ()), None]:
            part = text[at : m.start() if m else len(text)]
            if part:
                part = unicodedata.normalize("NFC", part) if self.nfc else part
                part = f" {part}" if self.prefix_space and not part[0].isspace() else part
                out += [i for piece in self.pieces(part) for i in self._piece_ids(piece)]
            if m:
                out.append(self.added[m.group()])
                at = m.end()
        return out

    def decode(self, ids: list[int], special: bool = False) -> str:
        """Special tokens are left out unless asked for; bytes that are no text become U+FFFD."""
        return b"".join(self._bytes.get(i, b"") for i in ids if special or i not in self.special).decode("utf-8", "replace")


def parsed(content: str) -> Tokenizer:
    """A tokenizer file (JSON) of the byte-level BPE kind; whatever it has that would change ids and isn't known here is an error."""
    head = json.loads(content)
    model = head.get("model") or {}
    if model.get("type", "BPE") != "BPE" or not model.get("vocab"):
        raise ValueError("not a BPE tokenizer file")
    if model.get("byte_fallback") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        raise ValueError("a BPE variant that isn't supported")
    normalizer = head.get("normalizer")
    if normalizer and normalizer.get("type") != "NFC":
        raise ValueError(f"unsupported normalizer {normalizer.get('type')}")
    back = {c: b for b, c in byte_chars().items()}
    added = {t["content"]: t["id"] for t in head.get("added_tokens") or []}

    def raw(token: str) -> bytes:
        try:
            return bytes(back[c] for c in token)
        except KeyError as e:
            raise ValueError(f"a token with a character that stands for no byte: {token!r}") from e

    ids = {raw(t): i for t, i in model["vocab"].items() if t not in added}
    pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model.get("merges") or []]
    ranks: dict[tuple[bytes, bytes], int] = {}
    for rank, pair in enumerate(pairs):
        if len(pair) != 2:
            raise ValueError(f"merge {rank} isn't a pair")
        a, b = map(raw, pair)
        if a + b not in ids:
            raise ValueError(f"merge {rank} makes a token that isn't in the vocabulary")
        ranks.setdefault((a, b), rank)
    steps = head.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", []) if steps.get("type") == "Sequence" else [steps] if steps else []
    patterns, prefix, level = [], False, False
    for step in steps:
        kind = step.get("type")
        if kind == "ByteLevel":
            level, prefix = True, bool(step.get("add_prefix_space"))
            patterns += [BYTE_LEVEL] if step.get("use_regex", True) else []
        elif kind == "Split" and "Regex" in step.get("pattern", {}) and step.get("behavior") == "Isolated":
            patterns.append(step["pattern"]["Regex"])
        elif kind == "Digits":
            patterns.append(r"\p{N}" if step.get("individual_digits") else r"\p{N}+")
        else:
            raise ValueError(f"unsupported pre-tokenizer {kind}")
    if not level:
        raise ValueError("not a byte-level tokenizer")
    special = frozenset(t["id"] for t in head.get("added_tokens") or [] if t.get("special"))
    return Tokenizer(ids, ranks, added, special, tuple(patterns), bool(model.get("ignore_merges")), prefix, _begins(head), normalizer is not None)


def _begins(head: dict) -> tuple[int, ...]:
    """Ids that the file's template puts before a single text."""
    steps = head.get("post_processor") or {}
    steps = steps.get("processors", []) if steps.get("type") == "Sequence" else [steps]
    for step in steps:
        if step.get("type") == "TemplateProcessing":
            out: list[int] = []
            for x in step.get("single") or []:
                if "Sequence" in x:
                    return tuple(out)
                out += step["special_tokens"][x["SpecialToken"]["id"]]["ids"]
    return ()


def load(path: str) -> Tokenizer:
    """From a local file, as each task or the driver has it."""
    with open(path, encoding="utf-8") as f:
        return parsed(f.read())


def encoded(docs: DataFrame, tokenizer: Tokenizer, begin: bool = False) -> DataFrame:
    """`docs` (doc_id, text) to (doc_id, ids); a null text has none, not even those that begin a text."""
    held = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def each(batches):
        encode = held.value.encode
        for batch in (part for whole in batches for part in sliced(whole)):
            ids = [[] if x is None else encode(x, begin) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, rows.select("doc_id").schema.add("ids", ArrayType(IntegerType())))


def decoded(rows: DataFrame, tokenizer: Tokenizer, special: bool = False) -> DataFrame:
    """`rows` (doc_id, ids) to (doc_id, text)."""
    held = rows.sparkSession.sparkContext.broadcast(tokenizer)

    def each(batches):
        decode = held.value.decode
        for batch in (part for whole in batches for part in sliced(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x or [], special) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    rows = rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids"))
    return rows.mapInArrow(each, rows.select("doc_id").schema.add("text", StringType()))
