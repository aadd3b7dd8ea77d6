"""Normal forms and character classes that have no built-in expression."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _normal(form: str):
    @F.pandas_udf("string")
    def normal(text: pd.Series) -> pd.Series:
        return text.map(lambda x: x if x is None else unicodedata.normalize(form, x))

    return normal


def _only_low(text: Column) -> Column:
    """Characters below U+0300: composed text that NFC leaves alone."""
    return text.rlike(r"\A[\x00-\x{2FF}]*\z")


def nfc(text: Column) -> Column:
    """Composed form; Python is asked only about texts that could change."""
    return F.when(text.isNull() | _only_low(text), text).otherwise(_normal("NFC")(text))


def nfd(text: Column) -> Column:
    return F.when(text.isNull() | text.rlike(r"\A[\x00-\x7F]*\z"), text).otherwise(_normal("NFD")(text))


def bert_clean(text: Column, lower: bool = True, accents: bool = False) -> Column:
    """Control characters go, white space becomes spaces, CJK characters stand apart; then, as asked, lower case and no accents."""
    text = F.regexp_replace(text, r"[\x00\x{FFFD}]|(?![\t\n\r])\p{C}", "")
    text = F.regexp_replace(text, r"[\t\n\r\p{Z}]", " ")
    text = F.regexp_replace(text, r"([\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}])", " $1 ")
    if not accents:
        text = F.regexp_replace(nfd(text), r"\p{Mn}", "")
    return F.lower(text) if lower else text


def bert_words(text: Column) -> Column:
    """White space splits, and every punctuation character stands alone."""
    apart = F.regexp_replace(text, r"([!-/:-@\[-`{-~\p{P}])", " $1 ")
    return F.filter(F.split(apart, " +"), lambda w: w != "")


def bert_words_of(text: str, lower: bool = True, accents: bool = False) -> list[str]:
    """`bert_words(bert_clean(text))` inside a task."""
    out = []
    for c in text:
        kind = unicodedata.category(c)
        if c in "\0\ufffd" or (kind[0] == "C" and c not in "\t\n\r"):
            continue
        if c in "\t\n\r" or kind[0] == "Z":
            out.append(" ")
        elif any(low <= ord(c) <= high for low, high in _IDEOGRAPHS):
            out.append(f" {c} ")
        else:
            out.append(c)
    clean = "".join(out)
    if not accents:
        clean = "".join(c for c in unicodedata.normalize("NFD", clean) if unicodedata.category(c) != "Mn")
    clean = clean.lower() if lower else clean
    parts = "".join(f" {c} " if c in _ASCII_MARKS or unicodedata.category(c)[0] == "P" else c for c in clean).split(" ")
    return [x for x in parts if x]


#: Blocks of ideographs, and ASCII characters that count as punctuation.
_IDEOGRAPHS = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
_ASCII_MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
