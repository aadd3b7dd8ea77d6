"""JSON texts as VARIANT values: strict parsing, fields by path, quoting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(text: Column) -> Column:
    """The value of a text that is one JSON value and nothing else but white space; null for all others, such as texts with data behind the value,
    repeated keys or an open end. Escaped surrogate pairs are one character; a lone one is a question mark.

    The parser stops behind the first value, so the text is put into an object in front of another key: it is whole if that key is found, and no
    third one."""
    both = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit(',"end":0}')))
    keys = F.size(both.try_cast("map<string,variant>"))
    whole = (F.try_variant_get(both, "$.end", "int") == 0) & (keys == 2)
    return F.when(whole, F.try_variant_get(both, "$.v", "variant"))


def field(value: Column, path: str, kind: str) -> Column:
    """What stands at a path, as a type; null where it is missing or can't be that."""
    return F.try_variant_get(value, path, kind)


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.cast("string").alias("v")))
    return F.when(text.isNotNull(), F.substr(whole, F.lit(6), F.length(whole) - 6))
