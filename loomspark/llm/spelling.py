"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so anagrams share it, and a word that gains, loses or exchanges one letter
has a key that is off by one letter's value or by the difference of two. Keys a, b are off by an exchange of c for d exactly if
a - value(c) = b - value(d), and by the addition of c if a = b - value(c): each word is dealt to its own key and to its
key without each of its distinct letters, and words whose keys are off by one edit meet there. A meeting place holds at most one key for each
letter of the alphabet, however many words there are.

Places where one key only comes lead nowhere. In the others the order of the letters is verified: the letters that are left must be the
same ones in the same order, which is part of the join's key (as a hash), so anagrams that are far apart never form pairs; the words themselves decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.bytescan import _BASE, _powers, mixed, slices
from loomspark.llm.scratch import written

#: Letters of a word, and how often and how long a word has to be.
LETTERS = "[A-Za-zÀ-ÿ]+"
TIMES, LENGTH = 3, 5
#: One in so many occurrences loses a letter.
NOISE = 97
#: How many times as frequent a word's form is.
RATIO = 2
POWER = 5
_VALUE = np.arange(256, dtype=np.int64) ** POWER
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _without(word: Column, at: Column) -> Column:
    """A word without its letter `at`, counted from 0."""
    return F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))


def words(docs: DataFrame, noise: int = NOISE, times: int = TIMES, length: int = LENGTH) -> DataFrame:
    """`docs` (doc_id, text) to distinct (id, word, n): runs of letters, A-Z lower-cased, of `length` code points and `times` occurrences at
    least. An occurrence whose CRC-32 of `<doc_id>:<run>` is a multiple of `noise` loses the code point at that number modulo its length."""
    low = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    runs = runs.select("run", h.alias("h"))
    word = F.when(F.col("h") % noise == 0, _without(F.col("run"), (F.col("h") % F.length("run")).cast("int"))).otherwise(F.col("run"))
    found = runs.select(word.alias("word")).where(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)
    return written(found.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all words in a row (a byte each), each one's word, and each word's first place."""
    data = [w.encode("latin-1") for w in words]
    size = np.array([len(x) for x in data], np.int64)
    return np.frombuffer(b"".join(data), np.uint8), np.repeat(np.arange(len(data)), size), np.cumsum(size) - size


def _keys(batches):
    """(id, word) to (place, key, letter, id, word): a word at its own key (letter -1) and at its key without each distinct letter."""
    for batch in slices(batches):
        letters, of, first = _flat(batch.column(1).to_pylist())
        if not len(letters):
            continue
        key = np.add.reduceat(_VALUE[letters], first)
        pair = np.unique(of << 8 | letters)
        row, letter = np.r_[np.arange(len(key)), pair >> 8], np.r_[np.full(len(key), -1), pair & 255]
        place = key[row] - np.where(letter < 0, 0, _VALUE[letter])
        picked = batch.take(pa.array(row))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(key[row]), pa.array(letter.astype(np.int16)), *picked.columns], ["place", "key", "letter", "id", "word"])


def _rests(batches):
    """(place, letter, id, word) to (place, slot, rest, role, at, id): the hash of the letters left by each removal.

    Words that differ in the letter at one place meet in that slot. In slot -1 a word as it is (role 0) meets words that have
    one letter more (role 1; of a run of equal letters the first is removed)."""
    for batch in slices(batches):
        letters, of, first = _flat(batch.column(3).to_pylist())
        if not len(letters):
            continue
        at = np.arange(len(letters)) - first[of]
        up, down = _powers(int(at.max()) + 1, _BASE)
        sums = np.r_[np.uint64(0), np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * up[at], dtype=np.uint64)]
        ends = np.r_[first[1:], len(letters)]
        letter, size = batch.column(1).to_numpy(zero_copy_only=False), ends - first
        own = np.flatnonzero(letter < 0)
        cut = np.flatnonzero(letters == letter[of])
        row = of[cut]
        head, tail = sums[cut] - sums[first[row]], sums[ends[row]] - sums[cut + 1]
        rest = mixed(head + tail * down[1] + (size[row] - 1).astype(np.uint64))
        whole = mixed(sums[ends[own]] - sums[first[own]] + size[own].astype(np.uint64))
        new = (at[cut] == 0) | (letters[cut - 1] != letters[cut])
        rows = np.r_[own, row, row[new]]
        slot = np.r_[np.full(len(own), -1), at[cut], np.full(int(new.sum()), -1)]
        role = np.r_[np.zeros(len(own) + len(cut), np.int8), np.ones(int(new.sum()), np.int8)]
        where = np.r_[np.zeros(len(own), np.int64), at[cut], at[cut][new]]
        take = pa.array(rows)
        columns = [batch.column(0).take(take), pa.array(slot.astype(np.int32)), pa.array(np.r_[whole, rest, rest[new]].view(np.int64)), pa.array(role), pa.array(where.astype(np.int32)), batch.column(2).take(take)]
        for i in range(0, len(rows), 1 << 16):
            yield pa.RecordBatch.from_arrays([c.slice(i, 1 << 16) for c in columns], ["place", "slot", "rest", "role", "at", "id"])


def near(words: DataFrame) -> DataFrame:
    """Distinct `words` (id, word, n) to (id, near, near_n), both ways: words that differ by exactly one inserted, deleted or replaced code point."""
    keys = words.select("id", "word").mapInArrow(_keys, "place long, key long, letter short, id long, word string")
    met = keys.groupBy("place").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("place")
    met = keys.join(met, "place", "left_semi").select("place", "letter", "id", "word")
    rests = written(met.mapInArrow(_rests, "place long, slot int, rest long, role byte, at int, id long"), "rests")
    x, y = (rests.select("place", "slot", "rest", F.col("role").alias(f"{k}_role"), F.col("at").alias(f"{k}_at"), F.col("id").alias(k)) for k in "xy")
    pairs = x.join(y, ["place", "slot", "rest"]).where("x <> y and (slot >= 0 or x_role <> y_role)").drop("place", "rest", "y_role")
    a, b = words.select(F.col("id").alias("x"), F.col("word").alias("a")), words.select(F.col("id").alias("y"), F.col("word").alias("b"), F.col("n").alias("near_n"))
    cut_a, cut_b = _without(F.col("a"), F.col("x_at")), _without(F.col("b"), F.col("y_at"))
    same = F.when(F.col("slot") >= 0, cut_a == cut_b).when(F.col("x_role") == 0, F.col("a") == cut_b).otherwise(cut_a == F.col("b"))
    return pairs.join(a, "x").join(b, "y").where(same).select(F.col("x").alias("id"), F.col("b").alias("near"), "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): each round doubles the steps taken. A form is more frequent than its word by `RATIO`, so there is no circle,
    and the rounds grow with the logarithm of the logarithm of the greatest count."""
    known = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = known.select(F.col("word").alias("root"), F.col("root").alias("above"))
        step = written(known.join(up, "root", "left").select("word", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def variants(docs: DataFrame, noise: int = NOISE, times: int = TIMES, length: int = LENGTH, ratio: int = RATIO) -> DataFrame:
    """`docs` (doc_id, text) to one row for each word: word, form, root, n, n_near, form_n.

    A form is the near word of largest n (ties: smallest in code-point order), if it is `ratio` times as frequent as the word at least, else
    null; root is the last word that forms lead to, the word itself without one. Null and empty texts have no words; a null
    doc_id is written as nothing in front of the colon; repeated rows count as often as they stand; whole texts are read, and words of any length;
    other columns, of any name, are ignored; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("forms have to be more frequent than their words")
    known = words(docs, noise, times, length)
    best = near(known).groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), "near")).alias("best"))
    better = -F.col("best.n") >= ratio * F.col("n")
    found = known.join(best, "id", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(better, F.col("best.near")).alias("form"), F.when(better, -F.col("best.n")).alias("form_n"))
    found = written(found, "forms")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
