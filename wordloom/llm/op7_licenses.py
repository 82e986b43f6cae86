"""Licence scans by template-markup matching.

A template is wording with two kinds of marked regions, in the manner of public licence lists: [[ ... ]] may be missing,
and {{name}} stands for any words up to a limit. Each template is compiled into an automaton over words; the words outside
the regions are mandatory and must be there exactly. A text is searched at the places of the template's rarest mandatory words, so
that automata start only where they can succeed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD, lower_ascii, map_arrow

_WORD = re.compile(WORD)
#: Phrases whose places are counted, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words that a replaceable region may take.
ANY = 25

TEMPLATES: dict[str, str] = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files {{files}} to deal in {{things}} without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of {{things}} and to permit persons to whom {{things}} is furnished to do so, subject to the following conditions",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-clause": "Neither the name of {{holder}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 [[(the \"License\")]] you may not use this file except in compliance with the License",
    "gpl-3.0": "[[This work is]] licensed under the [[terms of the]] GNU General Public License, version 3",
    "gpl-2.0": "[[This work is]] licensed under the [[terms of the]] GNU General Public License, version 2",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU [[Lesser]] [[Affero]] General Public License as published by the Free Software Foundation, either version {{number}} of the License, or (at your option) any later version",
    "mit-notice": "Released under the [[terms of the]] MIT License",
    "cc-by-nc-4.0": "Licensed under [[a]] [[the]] [[Creative Commons]] CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under [[a]] [[the]] [[Creative Commons]] CC BY-SA 4.0",
    "cc-by-4.0": "Licensed under [[a]] [[the]] [[Creative Commons]] CC BY 4.0",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "rights-reserved": "[[Copyright {{holder}}]] All rights reserved",
}


def words(text: str | None) -> list[str]:
    return _WORD.findall(lower_ascii(text)) if text else []


def parse(template: str) -> list:
    """Mandatory words as strings, a replaceable region as None, an optional region as a list of the same."""
    stack: list[list] = [[]]
    for mark, name, plain in re.findall(r"(\[\[|\]\])|\{\{(\w+)\}\}|((?:(?!\[\[|\]\]|\{\{).)+)", template, re.S):
        if mark == "[[":
            stack.append([])
        elif mark == "]]":
            if len(stack) == 1:
                raise ValueError(f"]] without [[ in {template[:60]!r}")
            done = stack.pop()
            stack[-1].append(done)
        elif name:
            stack[-1].append(None)
        else:
            stack[-1] += words(plain)
    if len(stack) > 1:
        raise ValueError(f"[[ without ]] in {template[:60]!r}")
    return stack[0]


@dataclass
class Automaton:
    """States of a nondeterministic automaton. edges: the word that leads on from a state, if any; free: states that may take
    any word and stay, up to ANY times; skips: states reached without a word."""

    label: str
    edges: list[str | None]
    skips: list[list[int]]
    free: list[bool]
    anchor: str
    reach: int
    size: int

    def closure(self, states: dict[int, int]) -> dict[int, int]:
        """states: the words taken so far by the free state one is in."""
        todo = list(states.items())
        while todo:
            s, _ = todo.pop()
            for t in self.skips[s]:
                if t not in states:
                    states[t] = 0
                    todo.append((t, 0))
        return states

    def match(self, text: list[str], at: int) -> int | None:
        """End of the longest match from a word, or None."""
        last, states, best = len(self.edges), self.closure({0: 0}), None
        for p in range(at, len(text) + 1):
            if last in states:
                best = p
            if p == len(text):
                break
            word, to = text[p], {}
            for s, taken in states.items():
                if s == last:
                    continue
                if self.edges[s] == word:
                    to[s + 1] = 0
                if self.free[s] and taken < ANY:
                    to[s] = min(to.get(s, ANY), taken + 1)
            if not to:
                break
            states = self.closure(to)
        return best


def build(label: str, template: str, common: dict[str, int]) -> Automaton:
    edges: list[str | None] = []
    skips: list[list[int]] = [[]]
    free: list[bool] = []
    firm: list[tuple[str, int]] = []

    def add(parts: list, always: bool) -> None:
        for x in parts:
            here = len(edges)
            if isinstance(x, list):
                add(x, False)
                skips[here].append(len(edges))
                continue
            edges.append(x)
            free.append(x is None)
            skips.append([])
            if x is None:
                skips[here].append(here + 1)
            elif always:
                firm.append((x, here))

    add(parse(template), True)
    if not firm:
        raise ValueError(f"{label} has no mandatory word")
    anchor, place = min(firm, key=lambda f: (common.get(f[0], 0), f[1]))
    return Automaton(label, edges, skips, free, anchor, sum(ANY if f else 1 for f in free[:place]), len(firm))


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        parsed = {k: parse(v) for k, v in templates.items()}
        common: dict[str, int] = {w: 9 for w in ("the", "of", "and", "to", "in", "any", "this", "all", "is", "a", "or", "by", "for", "under")}
        for p in parsed.values():
            for w in {x for x in p if isinstance(x, str)}:
                common[w] = common.get(w, 0) + 1
        self.automata = [build(k, v, common) for k, v in templates.items()]
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        anchors = {a.anchor for a in self.automata} | {p[0] for p, _ in self.phrases}
        # Texts without any of these words can hold nothing; most stop here.
        self.anchors = re.compile("|".join(sorted(map(re.escape, anchors), key=len, reverse=True)))
        self.anchor_words = anchors

    def scan(self, text: str | None) -> tuple[int, list[int], set[str], list[tuple[str, int, int]]]:
        """Words, places of base phrases, base labels, matches (label, first word, end) of templates."""
        if not text:
            return 0, [], set(), []
        low = lower_ascii(text)
        found = _WORD.findall(low)
        if not self.anchors.search(low):
            return len(found), [], set(), []
        where: dict[str, list[int]] = {}
        wanted = self.anchor_words
        for i, w in enumerate(found):
            if w in wanted:
                where.setdefault(w, []).append(i)
        places, labels, hits = [], set(), []
        for phrase, label in self.phrases:
            for i in where.get(phrase[0], ()):
                if found[i : i + len(phrase)] == phrase:
                    places.append(i)
                    labels.add(label)
        for a in self.automata:
            done = 0
            for i in where.get(a.anchor, ()):
                if i < done:
                    continue
                for start in range(max(done, i - a.reach), i + 1):
                    if (end := a.match(found, start)) is not None and end > i:
                        hits.append((a.label, start, end))
                        done = end
                        break
        return len(found), sorted(places), labels, hits


@lru_cache(maxsize=4)
def scanner(templates: tuple, phrases: tuple) -> Scanner:
    return Scanner(dict(templates), dict(phrases))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row, with spans (label, first
    word, end of each template match).

    Base: the places where the words of a phrase in BASE stand one after another, punctuation aside. Method: labels of
    the templates that match. score is 1 where a template matches, 0.5 where only a base phrase is found, else 0.
    Null and empty texts have no words: nulls for first_word and last_word, empty labels, score 0. Repeated rows stay; an
    empty table gives no rows; other columns aren't read. Texts are scanned whole."""
    key = tuple((TEMPLATES if templates is None else templates).items()), tuple(BASE.items())
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = scanner(*key)
        rows = [s.scan(x) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column(0),
                "n_words": pa.array([r[0] for r in rows], pa.int64()),
                "n_base": pa.array([len(r[1]) for r in rows], pa.int64()),
                "first_word": pa.array([r[1][0] if r[1] else None for r in rows], pa.int64()),
                "last_word": pa.array([r[1][-1] if r[1] else None for r in rows], pa.int64()),
                "base_labels": pa.array([",".join(sorted(r[2])) for r in rows], pa.string()),
                "labels": pa.array([",".join(sorted(r[2] | {h[0] for h in r[3]})) for r in rows], pa.string()),
                "score": pa.array([1.0 if r[3] else 0.5 if r[1] else 0.0 for r in rows], pa.float64()),
                "spans": pa.array([[{"label": a, "first": b, "end": c} for a, b, c in r[3]] for r in rows], spans),
            }
        )

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,end:long>>")
