"""Licence scans by a generalised suffix automaton of licence texts.

The words of all templates make one automaton; the words of a file run through
it and give, at each place, the longest run of words that ends there and is in
some template (its matching statistics). Runs that can't be extended and are long
enough are chained along a template, and a chain that covers enough of the
template is a span with its label. Short phrases are templates too; they count
wherever their words stand consecutively.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, map_arrow, table, text_bytes

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Public licence notices, by label and name.
NOTICES = {
    "apache/notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl/notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "lgpl/notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
        option) any later version.""",
    "agpl/notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero
        General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    "mpl/notice": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "mit/grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "isc/grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "cc-by/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nd/notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
}

#: Words of a match that is chained at least, words between two matches of a chain at most, and share of a template that makes a label.
MIN_MATCH, MAX_GAP, MIN_COVER = 6, 12, 0.5

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def whole_texts() -> dict[str, str]:
    """The licence texts that come with the package, by label and version; labels end where the version or number of clauses begins."""
    files = sorted(resources.files(__package__).joinpath("licences").iterdir(), key=lambda f: f.name)
    names = {f: f.name.removesuffix(".txt") for f in files if f.name.endswith(".txt")}
    return {f"{re.sub('-[0-9].*', '', name)}/{name}": f.read_text("utf-8") for f, name in names.items()}


@dataclass
class Scanner:
    """The automaton of some phrases and templates."""

    phrases: list[tuple[str, int]] = field(default_factory=list)  # label, words
    templates: list[tuple[str, int]] = field(default_factory=list)
    ids: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])  # by state: template and index of its last word
    phrase_at: list[tuple[tuple[int, int], ...]] = field(default_factory=list)  # by state: phrases that its strings may end with

    @classmethod
    def build(cls, phrases: dict[str, str], templates: dict[str, str]) -> Scanner:
        s = cls()
        texts = []
        for text, label in phrases.items():
            texts.append(w := words(text.encode()))
            s.phrases.append((label, len(w)))
        for name, text in templates.items():
            texts.append(w := words(text.encode()))
            s.templates.append((name.partition("/")[0], len(w)))
        own: dict[int, list[int]] = defaultdict(list)
        for n, w in enumerate(texts):
            last = 0
            for i, x in enumerate(w):
                last = s._extend(last, s.ids.setdefault(x, len(s.ids)))
                if n >= len(s.phrases):
                    s.ends[last].append((n - len(s.phrases), i))
        for n, w in enumerate(texts[: len(s.phrases)]):
            state = 0
            for x in w:
                state = s.step[state][s.ids[x]]
            own[state].append(n)
        order = sorted(range(len(s.size)), key=s.size.__getitem__)
        for v in reversed(order[1:]):  # what ends with a state's strings ends with those of its link
            if s.size[s.link[v]] >= MIN_MATCH:  # nobody asks for shorter ones
                s.ends[s.link[v]] += s.ends[v]
        s.ends = [sorted(set(e)) for e in s.ends]
        s.phrase_at = [()] * len(s.size)
        for v in order:
            above = s.phrase_at[s.link[v]] if s.link[v] >= 0 else ()
            s.phrase_at[v] = above + tuple((n, s.phrases[n][1]) for n in own[v])
        return s

    def _state(self, size: int, link: int, step: dict[int, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.ends.append([])
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the strings of q that p leads to; others stay in q."""
        if self.size[q] == self.size[p] + 1:
            return q
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            return self._split(last, self.step[last][c], c)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.step[p][c], c)
        return new

    def scan(self, found: list[bytes]):
        """Phrase places (start, phrase) and matches (start, words, state) that can't be extended to the right."""
        step, link, size, phrase_at = self.step, self.link, self.size, self.phrase_at
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        state = n = 0
        get = self.ids.get
        for i, c in enumerate(map(get, found)):
            if c is None:
                if n >= MIN_MATCH:
                    matches.append((i - n, n, state))
                state = n = 0
                continue
            if c in step[state]:
                state = step[state][c]
                n += 1
            else:
                if n >= MIN_MATCH:
                    matches.append((i - n, n, state))
                while state >= 0 and c not in step[state]:
                    state = link[state]
                if state < 0:
                    state = n = 0
                else:
                    n = size[state] + 1
                    state = step[state][c]
            if n > 1:
                for p, k in phrase_at[state]:
                    if n >= k:
                        places.append((i + 1 - k, p))
        if n >= MIN_MATCH:
            matches.append((len(found) - n, n, state))
        return places, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains along a template: template, first word and end in the file, share of the template that is covered."""
        open_: dict[int, list[int]] = {}  # template: first word, end in the file, end in the template, words covered
        closed = []

        def close(t):
            first, end, _, covered = open_.pop(t)
            closed.append((t, first, end, min(1.0, covered / self.templates[t][1])))

        for start, n, state in matches:
            by: dict[int, list[int]] = defaultdict(list)
            for t, last in self.ends[state]:
                by[t].append(last)
            for t, lasts in by.items():
                if t in open_:
                    first, end, at, covered = open_[t]
                    # matches may overlap by what a mismatch left of the one before; then their ends count
                    fits = [x for x in lasts if at <= x <= at + n + MAX_GAP and start <= end + MAX_GAP]
                    if fits:
                        new = min(n, fits[0] + 1 - at, start + n - end)
                        open_[t] = [first, start + n, fits[0] + 1, covered + max(0, new)]
                        continue
                    if lasts[0] + 1 <= at and start + n <= end + MAX_GAP and n < covered:
                        continue  # a repeat of words within the template
                    close(t)
                open_[t] = [start, start + n, lasts[0] + 1, n]
        for t in list(open_):
            close(t)
        return sorted(closed, key=lambda x: (x[1], x[0]))


_scanners: dict[int, Scanner] = {}


def scanner(phrases: dict[str, str], templates: dict[str, str]) -> Scanner:
    """The automaton, made once in a worker."""
    key = hash((*phrases.items(), *templates.items()))
    if key not in _scanners:
        _scanners[key] = Scanner.build(phrases, templates)
    return _scanners[key]


def scan_licenses(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), phrases: dict[str, str] = PHRASES, templates: dict[str, str] | None = None, min_cover: float = MIN_COVER) -> DataFrame:
    """``keep``, n_words, n_base (places of phrases), first_word and last_word (their
    least and greatest start, words from 0; null without), base_labels, labels (with
    those of covered templates; sorted, comma-joined), score (the greatest share of a
    template that is covered, 1 for a phrase, 0 without any match) and spans
    (label, first_word, end_word, cover) of chains, for each row; a map.

    ``templates`` has texts by names that begin with a label and a slash (the notices
    and whole texts of this package by default). A null text is empty and has no
    words. Repeated rows are scanned alike; other columns are ignored. Phrases and
    templates are a fixed set held in memory.
    """
    templates = NOTICES | whole_texts() if templates is None else templates
    source = docs.select(*dict.fromkeys((*keep, "text")))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name in keep]
    fields += ["n_words bigint", "n_base bigint", "first_word bigint", "last_word bigint", "base_labels string", "labels string", "score double", "spans array<struct<label: string, first_word: bigint, end_word: bigint, cover: double>>"]
    span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("cover", pa.float64())]))

    def run(batch: pa.RecordBatch):
        s = scanner(phrases, templates)
        for block in blocks(batch):
            out = defaultdict(list)
            for text in text_bytes(block):
                found = words(text)
                places, matches = s.scan(found)
                spans = s.spans(matches)
                base = {s.phrases[p][0] for _, p in places}
                starts = [i for i, _ in places]
                row = {
                    "n_words": len(found), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                    "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s.templates[t][0] for t, _, _, c in spans if c >= min_cover})),
                    "score": 1.0 if places else max((c for *_, c in spans), default=0.0),
                    "spans": [{"label": s.templates[t][0], "first_word": a, "end_word": b, "cover": c} for t, a, b, c in spans],
                }
                for k, v in row.items():
                    out[k].append(v)
            types = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": span_type}
            yield pa.RecordBatch.from_pydict({k: block.column(k) for k in keep} | {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})

    return map_arrow(source, run, ", ".join(fields))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
