"""Token ids of text: pieces are split by expression, and encoded in the same task, each distinct one once."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loomspark.functions.unicode import bert_clean, bert_words, bert_words_of
from loomspark.operators import bpe

#: Pieces that a task remembers.
MEMORY = 200_000


def encoded(docs: DataFrame, pieces, encode: Callable[[], Callable[[list[str]], list[list[int]]]]) -> DataFrame:
    """`docs` (doc_id, text) to (doc_id, ids). `pieces` maps the text column to an array of pieces; `encode()` is called once a task and
    gives the ids of a list of pieces. Texts without pieces have no ids. No row leaves its task."""

    def each(batches):
        run, known = encode(), {}
        for batch in batches:
            lists = batch.column(1).to_pylist()
            new = list({x for pieces_ in lists for x in pieces_ or () if x not in known})
            if len(known) + len(new) > MEMORY:
                known.clear()
                new = list({x for pieces_ in lists for x in pieces_ or ()})
            known.update(zip(new, run(new)))
            ids = [[i for x in pieces_ or () for i in known[x]] for pieces_ in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    rows = docs.select("doc_id", pieces(F.col("text")).alias("pieces"))
    return rows.mapInArrow(each, docs.select("doc_id").schema.add("ids", ArrayType(IntegerType())))


def byte_bpe(docs: DataFrame, path: str) -> DataFrame:
    """`docs` (doc_id, text) to (doc_id, ids) by a byte-level BPE file, without the ids that begin a text."""
    return bpe.encoded(docs, bpe.load(path))


def word_piece_file(content: str) -> tuple[dict[str, int], bool]:
    """A tokenizer file (JSON) of the word-piece kind to its vocabulary and whether it lower-cases; anything else is an error."""
    head = json.loads(content)
    model, normalizer = head.get("model") or {}, head.get("normalizer") or {}
    if model.get("type") != "WordPiece" or model.get("continuing_subword_prefix", "##") != "##":
        raise ValueError("not a WordPiece tokenizer file")
    vocabulary = model.get("vocab") or {}
    if lacking := [x for x in ("[UNK]", "[CLS]", "[SEP]") if x not in vocabulary]:
        raise ValueError(f"the vocabulary lacks {', '.join(lacking)}")
    return vocabulary, bool(normalizer.get("lowercase", True))


def longest_match(word: str, vocabulary: dict[str, int], unknown: int, most: int = 100) -> list[int]:
    """Greedy from the left, pieces inside a word marked ##; the whole word is unknown if it is too long or a part isn't found."""
    out, start = [], 0
    while start < len(word) <= most:
        for end in range(len(word), start, -1):
            piece = vocabulary.get(("##" if start else "") + word[start:end])
            if piece is not None:
                break
        else:
            return [unknown]
        out.append(piece)
        start = end
    return out if start == len(word) else [unknown]


def word_pieces(docs: DataFrame, vocabulary: dict[str, int], most: int = 512, lower: bool = True) -> DataFrame:
    """Ids with [CLS] first and [SEP] last, `most` at most. The vocabulary has [UNK], [CLS] and [SEP]."""
    unknown, cls, sep = (vocabulary[x] for x in ("[UNK]", "[CLS]", "[SEP]"))
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = encoded(docs, lambda text: bert_words(bert_clean(text, lower)), lambda: lambda pieces: [longest_match(w, held.value, unknown) for w in pieces])
    return rows.select("doc_id", F.concat(F.slice(F.concat(F.array(F.lit(cls)), "ids"), 1, max(most - 1, 1)), F.array(F.lit(sep))).alias("ids"))


def word_cost(vocabulary: dict[str, int], lower: bool = True) -> Callable[[str], int]:
    """Word pieces of a word: what it costs in a passage (`chunk.by_cost`)."""
    unknown = vocabulary["[UNK]"]
    return lambda word: sum(len(longest_match(x, vocabulary, unknown)) for x in bert_words_of(word, lower))
