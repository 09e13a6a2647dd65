"""License scans: template markup compiled into token automata, run once over the words of a text.

A template is wording with regions: ``<<beginOptional>> ... <<endOptional>>`` may
be left out, ``<<var;name=...;max=N>>`` stands for up to N words of any kind.  Its
mandatory wording must stand word for word.  All templates share one automaton
over tokens; a state is kept with the earliest word it began at, so a text is
read once whatever repeats in it, in pieces that end between words.

Edge cases: null and empty texts have no words and no matches; a long text is
read in pieces, its words are never all in memory; a text of very many places
keeps them in one value; repeated rows are scanned alike; ties do not arise; an
empty table gives an empty result; extra columns pass through, whatever their
names (a column of the result's name is the caller's and stays, the result then
has an underscore more).
"""

from __future__ import annotations

import functools
import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import fresh, named, slices, table, utf8

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bytes of a text that are turned into words at a time.
PIECE = 1 << 20
MARK = re.compile(r"<<(beginOptional|endOptional|var)([^>]*)>>")


@dataclass(frozen=True)
class Template:
    """A label and its wording in markup; a base phrase is plain wording."""

    label: str
    markup: str
    base: bool = False

    def parts(self) -> list:
        """Words, ("var", most) and nested lists for optional regions."""
        stack: list[list] = [[]]
        at = 0
        for m in MARK.finditer(self.markup):
            stack[-1] += words(self.markup[at:m.start()].encode())
            at = m.end()
            if m[1] == "beginOptional":
                stack.append([])
            elif m[1] == "endOptional":
                inner = stack.pop()
                stack[-1].append(inner)
            else:
                stack[-1].append(("var", int(re.search(r"max=(\d+)", m[2])[1])))
        stack[-1] += words(self.markup[at:].encode())
        if len(stack) != 1:
            raise ValueError(f"optional regions of {self.label} do not nest")
        return stack[0]

    def mandatory(self) -> int:
        """How many words the template insists on."""
        return sum(isinstance(p, bytes) for p in self.parts())


def words(data: bytes) -> list[bytes]:
    return WORD.findall(data.translate(_LOWER))


# The phrases and labels of the base scan.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

# Public wording of notices and license texts, with their optional and replaceable regions.
NOTICES = (
    Template("gpl-3", "licensed under the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"),
    Template("gpl-2", "licensed under the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2"),
    Template("gpl", "is free software <<beginOptional>>you can<<endOptional>> redistribute it and or modify it under the terms of the gnu general public license"),
    Template("lgpl", "redistribute it and or modify it under the terms of the gnu <<beginOptional>>library<<endOptional>> <<beginOptional>>lesser<<endOptional>> general public license as published by the free software foundation either version <<var;name=version;max=2>> of the license"),
    Template("apache-2", "licensed under the apache license version 2 0 <<beginOptional>>the license you may not use this file except in compliance with the license<<endOptional>>"),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    Template("cc-by", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution <<var;name=version;max=2>> <<beginOptional>>international<<endOptional>> license"),
    Template("cc-by-sa", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution sharealike <<var;name=version;max=2>> <<beginOptional>>international<<endOptional>> license"),
    Template("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> creative commons attribution noncommercial <<var;name=version;max=2>> <<beginOptional>>international<<endOptional>> license"),
    Template("cc-by-nc", "licensed under cc by nc <<var;name=version;max=2>> <<beginOptional>>international<<endOptional>> license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
    Template("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
documentation files the software to deal in the software without restriction including without limitation the rights to
use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
<<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of
the software <<beginOptional>>the software is provided as is without warranty of any kind express or implied including but
not limited to the warranties of merchantability fitness for a particular purpose and noninfringement<<endOptional>>"""),
    Template("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is
hereby granted provided that the above copyright notice and this permission notice appear in all copies"""),
    Template("bsd", """redistribution and use in source and binary forms with or without modification are permitted provided
that the following conditions are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above
copyright notice this list of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in
binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution"""),
    Template("bsd-3", """neither the name of <<var;name=holder;max=12>> nor the names of <<var;name=contributors;max=4>>
may be used to endorse or promote products derived from this software without specific prior written permission"""),
)


class Automaton:
    """One nondeterministic automaton over words for all templates; it has no empty moves left when it is built."""

    def __init__(self, templates: Iterable[Template]):
        self.templates = tuple(templates)
        self.literal: list[tuple[bytes, int] | None] = []  # word and target of a state
        self.any: list[int | None] = []  # target of a state that takes any word
        self.empty: list[list[int]] = []
        self.final: dict[int, int] = {}
        opens = []
        for i, t in enumerate(self.templates):
            parts = t.parts()
            if not (parts and isinstance(parts[0], bytes) and any(isinstance(p, bytes) for p in parts)):
                raise ValueError(f"the wording of {t.label} must begin with a word that is mandatory")
            start, end = self._state(), self._state()
            self._chain(parts, start, end)
            self.final[end] = i
            opens.append(start)
        self.after = [self._closure(s) for s in range(len(self.empty))]
        #: The states that a word leads to from the beginning of a template.
        self.begins: dict[bytes, tuple[int, ...]] = defaultdict(tuple)
        for s in opens:
            for u in self.after[s]:
                if self.literal[u]:
                    w, to = self.literal[u]
                    self.begins[w] += self.after[to]
        self.begins = dict(self.begins)

    def _state(self) -> int:
        self.literal.append(None)
        self.any.append(None)
        self.empty.append([])
        return len(self.empty) - 1

    def _chain(self, parts: list, at: int, end: int) -> None:
        for p in parts:
            to = self._state()
            if isinstance(p, bytes):
                self.literal[at] = (p, to)
            elif isinstance(p, tuple):
                for _ in range(p[1]):
                    self.empty[at].append(to)
                    step = self._state()
                    self.any[at] = step
                    at = step
                self.empty[at].append(to)
            else:
                self.empty[at].append(to)
                inner = self._state()
                self.empty[at].append(inner)
                self._chain(p, inner, to)
            at = to
        self.empty[at].append(end)

    def _closure(self, state: int) -> tuple[int, ...]:
        seen, todo = {state: None}, [state]
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen[t] = None
                    todo.append(t)
        return tuple(s for s in seen if self.literal[s] or self.any[s] is not None or s in self.final)

    def step(self, active: dict[int, int], word: bytes, at: int, found: list[tuple[int, int, int]]) -> dict[int, int]:
        """The states after a word, each with the earliest beginning that leads there."""
        out: dict[int, int] = {}

        def reach(states: tuple[int, ...], began: int) -> None:
            for s in states:
                if out.get(s, at + 1) > began:
                    out[s] = began

        for s, began in active.items():
            if (move := self.literal[s]) and move[0] == word:
                reach(self.after[move[1]], began)
            if (to := self.any[s]) is not None:
                reach(self.after[to], began)
        reach(self.begins.get(word, ()), at)
        for s in [s for s in out if s in self.final]:
            found.append((out.pop(s), at + 1, self.final[s]))
        return out

    def scan(self, data: bytes) -> tuple[int, list[tuple[int, int, int]]]:
        """Number of words, and (first word, word after the last, template) of each match, in order."""
        found: list[tuple[int, int, int]] = []
        active: dict[int, int] = {}
        base = 0
        for piece in pieces(data):
            tokens = words(piece)
            at, hot = 0, [i for i, w in enumerate(tokens) if w in self.begins]
            hot.append(len(tokens))
            for i in hot:
                while active and at < i:
                    active = self.step(active, tokens[at], base + at, found)
                    at += 1
                at = i
                if i < len(tokens):
                    active = self.step(active, tokens[i], base + i, found)
                    at += 1
            base += len(tokens)
        return base, sorted(found)


def pieces(data: bytes, size: int = PIECE) -> Iterable[bytes]:
    """The text cut before a byte that is in no word."""
    at = 0
    while len(data) - at > size:
        end = at + size
        while end < len(data) and words(data[end:end + 1]):
            end += 1
        yield data[at:end]
        at = end
    yield data[at:] if at else data


@functools.cache
def automaton(templates: tuple[Template, ...]) -> Automaton:
    return Automaton(templates)


MATCHES = "struct<n_words: long, matches: array<struct<first: long, stop: long, template: int>>>"


def matches(text: Column, templates: tuple[Template, ...] = BASE + NOTICES) -> Column:
    """struct of n_words and matches, an array of (first, stop, template), in order."""

    @F.arrow_udf(MATCHES)
    def run(texts: pa.Array) -> pa.Array:
        machine = automaton(templates)
        counts, found = [], []
        for part in slices(texts):
            for data in utf8(part):
                n, spans = machine.scan(data)
                counts.append(n)
                found.append([{"first": a, "stop": b, "template": t} for a, b, t in spans])
        kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("template", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(found, kind)], ["n_words", "matches"])

    return run(text)


def confidence(template: Template) -> float:
    """The more words a matched template insists on, the surer it is."""
    return 1 - 1 / (1 + template.mandatory())


def scan(docs: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """docs with ``licenses``: struct of n_words and matches (first, stop, template)."""
    out = fresh("licenses", docs)
    return docs.withColumn(out, matches(named(text_col), templates))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: licenses of every document."""
    templates = BASE + NOTICES
    found = F.col("licenses.matches")
    base = F.filter(found, lambda m: m["template"] < len(BASE))
    names, trust = F.array(*(F.lit(t.label) for t in templates)), F.array(*(F.lit(confidence(t)) for t in templates))
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: F.get(names, m["template"])))), ",")
    starts = F.transform(base, lambda m: m["first"])
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.col("licenses.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(found).alias("labels"), F.coalesce(F.array_max(F.transform(found, lambda m: F.get(trust, m["template"]))), F.lit(0.0)).alias("score"))


def _regex(parts: list) -> str:
    """The parts as a regular expression over words that each end in a space."""
    out = ""
    for p in parts:
        out += p.decode() + " " if isinstance(p, bytes) else f"(?:[^ ]+ ){{0,{p[1]}}}" if isinstance(p, tuple) else f"(?:{_regex(p)})?"
    return out


def _oracle() -> str:
    templates = BASE + NOTICES
    hit = [f"regexp_matches(t, ' {_regex(x.parts())}')" for x in templates]
    label = lambda some: "array_to_string(list_sort(list_distinct([x FOR x IN [" + ", ".join(f"CASE WHEN {h} THEN '{t.label}' END" for t, h in some) + "] IF x IS NOT NULL])), ',')"
    both = list(zip(templates, hit, strict=True))
    places = " || ".join(f"[i - 1 FOR i IN range(1, n + 1) IF w[i:i + {len(x.parts()) - 1}] = {[p.decode() for p in x.parts()]}]" for x in BASE)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, w, len(w)::BIGINT AS n, ' ' || array_to_string(w, ' ') || ' ' AS t FROM d),
p AS (SELECT *, {places} AS places FROM e)
SELECT doc_id, n AS n_words, len(places)::BIGINT AS n_base, list_min(places) AS first_word, list_max(places) AS last_word,
       {label(both[:len(BASE)])} AS base_labels, {label(both)} AS labels,
       greatest(0.0::DOUBLE, {", ".join(f"CASE WHEN {h} THEN {confidence(t)!r}::DOUBLE ELSE 0 END" for t, h in both)}) AS score
FROM p
"""


ORACLE = _oracle()
