"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is mandatory words with markup: `[[...]]` is a region that may be left out, of one of several wordings where `|`
stands in it, `<<n>>` stands for up to n words of any wording. Compiled, each position of the template is a state; an optional
region adds empty steps into each wording and over it, a replaceable one a state that takes any word up to n times. A text is
accepted where the mandatory words stand exactly, in order.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.bytescan import ALNUM, words_of
from loomspark.llm.scratch import bytes_of

#: Phrases by label.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Wording of license notices, by label: mandatory words, `[[optional regions]]` and `<<replaceable regions of up to n words>>`.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license [[version]] 2 0 [[the license]] [[you may not use <<4>> except in compliance with the license]]",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this
        list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        [[3 neither the name of <<12>> may be used to endorse or promote products derived from this software without specific prior written permission]]""",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-license": "[[this work is]] licensed under [[a|the]] creative commons attribution <<6>> license",
    "copyright-notice": "copyright [[c|copr]] <<6>> all rights reserved",
    "gpl-terms": "under the terms of the gnu [[lesser|affero|library]] general public license",
    "gpl-notice": """is free software you can redistribute it and or modify it under the terms of the gnu [[lesser|affero|library]] general public
        license as published by the free software foundation [[either version <<2>> of the license or at your option any later version]]""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies""",
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
        files [[the software]] to deal in the software without restriction including without limitation the rights to use copy modify
        merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to
        do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]]
        shall be included in all copies or substantial portions of the software""",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy",
    "mpl-2.0": """this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed
        with this file you can obtain one at <<6>>]]""",
    "spdx-tag": "spdx license identifier <<2>>",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


class Automaton:
    """The token automaton of one template. States are numbers; `any_word` states take any word, `ways` leads from a state by a word
    to states. Regions stand inside optional ones; a choice of an optional region may be empty."""

    def __init__(self, template: str):
        self.ways: list[dict[bytes, set[int]]] = [{}]
        self.any_word: dict[int, int] = {}
        self.empty: dict[int, set[int]] = {}
        self.final = self._sequence(0, _parts(template))
        self.start = self._closed({0})
        self._next: dict[tuple[frozenset, bytes], frozenset] = {}
        self._words = {w for way in self.ways for w in way}

    def _sequence(self, at: int, parts: list) -> int:
        """Adds states for parts in order after a state; the last one."""
        for part in parts:
            if isinstance(part, int):
                passed = []
                for _ in range(part):
                    passed.append(at)
                    self.any_word[at] = at = self._state()
                for state in passed:
                    self.empty.setdefault(state, set()).add(at)
            elif isinstance(part, list):
                ends = {at, *(self._sequence(self._fork(at), choice) for choice in part)}
                at = self._state()
                for state in ends:
                    self.empty.setdefault(state, set()).add(at)
            else:
                new = self._state()
                self.ways[at].setdefault(part, set()).add(new)
                at = new
        return at

    def _fork(self, at: int) -> int:
        new = self._state()
        self.empty.setdefault(at, set()).add(new)
        return new

    def _state(self) -> int:
        self.ways.append({})
        return len(self.ways) - 1

    def _closed(self, states: set[int]) -> frozenset:
        todo = list(states)
        while todo:
            for s in self.empty.get(todo.pop(), ()):
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def firsts(self) -> set[bytes] | None:
        """Words a match can start with; null if it can be any."""
        return None if any(s in self.any_word for s in self.start) else {w for s in self.start for w in self.ways[s]}

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest match that starts at a word; -1 if there is none. Subsets are compiled when first met."""
        states, found = self.start, -1
        for i in range(at, len(words)):
            word = words[i] if words[i] in self._words else b""
            key = (states, word)
            if key not in self._next:
                to = {t for s in states for t in self.ways[s].get(word, ())} | {self.any_word[s] for s in states if s in self.any_word}
                self._next[key] = self._closed(to)
            states = self._next[key]
            if not states:
                break
            if self.final in states:
                found = i + 1
        return found


def _parts(template: str) -> list:
    """Words (bytes), replaceable regions (their number of words) and optional ones (lists of choices, each a list of parts)."""
    stack: list[list] = [[[]]]
    for mark in re.findall(r"\[\[|\]\]|\||<<\d+>>|[^\s\[\]|<]+", template):
        if mark == "[[":
            stack.append([[]])
        elif mark == "]]":
            if len(stack) == 1:
                raise ValueError("a region ends that didn't start")
            done = stack.pop()
            stack[-1][-1].append(done)
        elif mark == "|":
            if len(stack) == 1:
                raise ValueError("choices stand inside a region")
            stack[-1].append([])
        elif mark.startswith("<<"):
            stack[-1][-1].append(int(mark[2:-2]))
        else:
            stack[-1][-1].extend(words_of(mark.encode(), ALNUM))
    if len(stack) > 1:
        raise ValueError("a region doesn't end")
    return stack[0][0]


class Scanner:
    """All templates and phrases over one text."""

    def __init__(self, templates: Mapping[str, str], base: Mapping[str, str]):
        self._by_first: dict[bytes, list[tuple[str, bool, Automaton]]] = {}
        for is_base, group in ((True, base), (False, templates)):
            for label, wording in group.items():
                automaton = Automaton(wording)
                firsts = automaton.firsts()
                if not firsts:
                    raise ValueError(f"{label}: a template starts with mandatory or optional words")
                for w in firsts:
                    self._by_first.setdefault(w, []).append((label, is_base, automaton))
        self._firsts = frozenset(self._by_first)

    def __call__(self, data: bytes | None) -> dict:
        words = words_of(data, ALNUM)
        places, labels, base, covered = [], set(), set(), set()
        if not self._firsts.isdisjoint(words):
            for i, w in enumerate(words):
                if w in self._firsts:
                    for label, is_base, automaton in self._by_first[w]:
                        end = automaton.match(words, i)
                        if end > 0:
                            labels.add(label)
                            covered.update(range(i, end))
                            if is_base:
                                places.append(i)
                                base.add(label)
        return {
            "n_words": len(words),
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base)),
            "labels": ",".join(sorted(labels)),
            "score": len(covered) / len(words) if words else 0.0,
        }


def scanned(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, base: Mapping[str, str] = BASE) -> DataFrame:
    """`docs` (doc_id, text) to (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row each.

    n_base counts all places of base phrases, first_word and last_word are the smallest and largest word such a place
    starts with (null without one). labels has the base labels and those of accepted templates; score is the
    share of words inside accepted wording. Null is an empty text: no words, empty labels, score 0. Repeated rows
    come back as often; other columns, of any name, are ignored; an empty table gives no rows. No row leaves its task; a very long
    text takes time in proportion, as no match is longer than its template.
    """
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def each(batches):
        scan = Scanner(templates, base)
        for batch in batches:
            out = [scan(x) for x in batch.column(1).to_pylist()]
            cols = [pa.array([r[k] for r in out], t) for k, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["doc_id", *kinds])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), bytes_of(F.col("text")).alias("data"))
    return rows.mapInArrow(each, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
