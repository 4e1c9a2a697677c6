r"""Licence scans: fixed phrases, and licence texts found by matching statistics.

The licence templates' words form one generalised suffix automaton.  Each file is streamed through it: after
every word the automaton knows the longest run of words ending there that also stands in some template, and
where in the templates it ends (the matching statistics).  Of each template all maximal runs of MATCH words or
more are collected over the whole file and chained in order, with at most GAP other words between two of them, so
that changed or added words don't end a licence; a template of which a chain covers COVER of the words is reported.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.  Nulls: a null text has no words; a null
doc_id is kept.  Repeated documents are scanned one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellward.llm import textops as t
from cellward.llm.sparkops import table, texts

#: Phrases that give a label wherever their words stand consecutively.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Public licence notices by label.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "gpl-3": "This work is licensed under the GNU General Public License, version 3",
    "mpl-2": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
}

#: Shortest run of template words that counts, or the whole template if that is shorter; share of a template that must be covered.
MATCH, COVER = 5, 0.8
#: Most words of the file between two runs of a chain.
GAP = 32
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def tokens(text: str) -> list[bytes]:
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().lower())


class Automaton:
    """Generalised suffix automaton of token sequences."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._add(last, token)
                self.ends[last].add((number, i + 1))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, token: int) -> int:
        """The state for the string of p and then token, apart from longer ones."""
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token)
        return new

    def statistics(self, sequence):
        """After each token: length of the longest run ending there that some sequence has, and its state."""
        state = length = 0
        for token in sequence:
            while state and token not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if token in self.next[state]:
                state, length = self.next[state][token], length + 1
            yield length, state


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, match: int = MATCH, cover: float = COVER, gap: int = GAP):
        self.labels, bodies = list(templates), [tokens(x) for x in templates.values()]
        self.size, self.cover, self.gap = [len(x) for x in bodies], cover, gap
        self.least = [min(match, n) for n in self.size]
        words = sorted({w for x in bodies for w in x} | {w for p in phrases for w in tokens(p)})
        vocabulary = t.Words([b" ".join(words)])
        order = np.argsort(vocabulary.hash)
        self.hashes, self.ids = vocabulary.hash[order], order
        index = {w: i for i, w in enumerate(words)}
        self.bodies = [[index[w] for w in x] for x in bodies]
        self.automaton = Automaton(self.bodies)
        self.phrases = [([index[w] for w in tokens(p)], label) for p, label in phrases.items()]
        self.names = np.array(words, object)

    def matches(self, ids: list[int], at: int, found: dict[int, list[tuple[int, int, int]]]) -> None:
        """Adds the maximal long matches in a run of known words to each template's: last word in the file, last word in the template (both exclusive), length."""
        shortest = min(self.least)
        for i, (length, state) in enumerate(self.automaton.statistics(ids)):
            if length < shortest:
                continue
            following, seen = ids[i + 1] if i + 1 < len(ids) else -1, set()
            while state > 0 and length >= shortest:
                for number, end in self.automaton.ends[state]:
                    if (number, end) not in seen:
                        seen.add((number, end))
                        goes_on = end < self.size[number] and self.bodies[number][end] == following
                        if not goes_on and length >= self.least[number]:
                            found.setdefault(number, []).append((at + i + 1, end, length))
                state = self.automaton.link[state]
                length = self.automaton.length[state]

    def chain(self, number: int, found: list[tuple[int, int, int]]) -> float:
        """Share of a template that the best chain of its matches covers; they are in order of their last words."""
        longest, best, first = self.size[number], [], 0
        for i, (end, stop, n) in enumerate(found):
            while found[first][0] < end - longest - self.gap:
                first += 1
            value = n
            for j in range(first, i):
                end_j, stop_j, n_j = found[j]
                if end - n - end_j <= self.gap and end_j < end and stop_j < stop and end_j - n_j < end - n and stop_j - n_j < stop - n:
                    value = max(value, best[j] + n - max(0, end_j - end + n, stop_j - stop + n))
            best.append(value)
        return max(best) / longest

    def scan(self, bodies: list[bytes]):
        """For each text: number of words, places of phrases with their labels, share of each template found."""
        words = t.Words(bodies)
        at = t.look_up(self.hashes, words.hash)
        ids = np.where(at >= 0, self.ids[at], -1)
        places: list[list[tuple[int, str]]] = [[] for _ in bodies]
        for phrase, label in self.phrases:
            hit = t.in_one(words.text, len(phrase)).copy()
            for i, w in enumerate(phrase):
                hit &= ids[i : i + len(hit)] == w
            for p in np.flatnonzero(hit).tolist():
                text = int(words.text[p])
                places[text].append((p - int(words.first[text]), label))
        found: list[dict[int, list[tuple[int, int, int]]]] = [{} for _ in bodies]
        known = ids >= 0
        if len(ids):
            new = np.flatnonzero((known[1:] != known[:-1]) | (words.text[1:] != words.text[:-1])) + 1
            start, end = np.append(0, new), np.append(new, len(ids))
            for a, b in zip(start.tolist(), end.tolist()):
                if known[a] and b - a >= min(self.least):
                    self.matches(ids[a:b].tolist(), a, found[int(words.text[a])])
        return words.count, places, [{number: self.chain(number, x) for number, x in own.items()} for own in found]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, match: int = MATCH, cover: float = COVER) -> DataFrame:
    """One row per document (RESULT); score is the largest share of a template that was found, 1 where a phrase was."""

    def run(batches):
        own = Scanner(templates, phrases, match, cover)
        for batch, bodies in t.slices(batches):
            count, places, shares = own.scan(bodies)
            rows = []
            for p, s in zip(places, shares):
                base = sorted({label for _, label in p})
                more = {own.labels[i] for i, share in s.items() if share >= own.cover}
                starts = [x for x, _ in p]
                rows.append((len(p), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *more})), 1.0 if base else round(max(s.values(), default=0.0), 6)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return texts(docs).mapInArrow(run, RESULT)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
