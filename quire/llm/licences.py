"""Licence scans: matching statistics against a generalised suffix automaton of licence words, long matches chained."""

from __future__ import annotations

import re
from collections import deque
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, table

#: Over lower-cased UTF-8 bytes: ASCII letters and digits, and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Phrases whose every place counts, by label. Fixed values.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words that a match needs to be chained, and the most words that a text or a template may hold between two matches of a chain.
LONG_MATCH, GAP = 5, 12
#: Part of a template that a chain has to cover for its label.
COVERED = 0.5

#: (label, text) of licence notices and grants. Words of the public licence texts, short forms as they are cited.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
]


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z lower-cased; places in it are counted in these words."""
    return WORD.findall((text or "").encode("utf-8", "replace").lower())


class Automaton:
    """The generalised suffix automaton of several word sequences.

    State 0 is the empty string. next: transitions by word; link: state of the longest suffix in another class;
    length: of a state's longest string; ends: for each state the (template, end) places of its strings, from
    ``chained`` words of length on; marks: phrases that end wherever a state's strings do, shortest first.
    """

    def __init__(self, templates: list[list[bytes]], phrases: list[list[bytes]], chained: int):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(templates):
            state = 0
            for at, word in enumerate(words):
                state = self._extend(state, word)
                while len(ends) < len(self.next):
                    ends.append([])
                ends[state].append((t, at + 1))
        closed = [self._follow(words) for words in phrases]
        order = sorted(range(len(self.next)), key=self.length.__getitem__)
        for s in reversed(order[1:]):  # longest first: what ends at a state ends at its link too
            if self.length[self.link[s]] >= chained:
                ends[self.link[s]] += ends[s]
        self.ends = [sorted(set(e)) if self.length[s] >= chained else [] for s, e in enumerate(ends)]
        self.marks: list[tuple[int, ...]] = [()] * len(self.next)
        for s in order[1:]:
            self.marks[s] = self.marks[self.link[s]] + tuple(p for p, at in enumerate(closed) if at == s)
        self.phrase_length = [len(p) for p in phrases]

    def _new(self, length: int, link: int, arcs: dict) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The state that word leads to from a state, with its longest string no longer than that asks for."""
        to = self.next[state][word]
        if self.length[to] == self.length[state] + 1:
            return to
        twin = self._new(self.length[state] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = twin
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = twin
            state = self.link[state]
        return twin

    def _extend(self, state: int, word: bytes) -> int:
        """The state of the longest string after one more word of a sequence; other sequences may have made it."""
        if word in self.next[state]:
            return self._split(state, word)
        made = self._new(self.length[state] + 1, 0, {})
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = made
            state = self.link[state]
        if state >= 0:
            self.link[made] = self._split(state, word)
        return made

    def _follow(self, words: list[bytes]) -> int:
        state = 0
        for w in words:
            state = self.next[state][w]
        return state

    def matches(self, words: list[bytes]):
        """(end, state, length): the longest match that ends after each word, where there is one: the matching statistics."""
        arcs, link, size = self.next, self.link, self.length
        first = arcs[0]
        state = length = 0
        for end, word in enumerate(words, 1):
            to = arcs[state].get(word)
            if to is None:
                if not state:
                    continue
                if word not in first:  # no template has the word
                    state = length = 0
                    continue
                while to is None:
                    state = link[state]
                    to = arcs[state].get(word)
                length = size[state]
            state = to
            length += 1
            yield end, state, length


def chain(anchors: list[tuple[int, int, int]], gap: int = GAP) -> list[tuple[int, int, int, int, int]]:
    """Spans (start, end, template start, template end, covered) of chains of matches of one template.

    anchors: (end in the text, end in the template, length). A match goes on from one that ends before it in both,
    by at most ``gap`` words in each; where they overlap, the later one is cut at its head. Every match takes the
    predecessor that gives its chain most covered words (ties: the latest), each match is in one span. A span is what the
    best chain that ends in it covers; chains are taken by covered words, best first.
    """
    rows = sorted(anchors)
    best = [n for _, _, n in rows]
    back = [-1] * len(rows)
    near: deque[int] = deque()
    for k, (end, t_end, n) in enumerate(rows):
        while near and rows[near[0]][0] < end - n - gap:
            near.popleft()
        for j in near:
            e, t, _ = rows[j]
            cut = max(0, e - (end - n), t - (t_end - n))
            if e < end and t < t_end and cut < n and end - n + cut - e <= gap and t_end - n + cut - t <= gap and best[j] + n - cut >= best[k]:
                best[k], back[k] = best[j] + n - cut, j
        near.append(k)
    used, out = [False] * len(rows), []
    for k in sorted(range(len(rows)), key=lambda k: (-best[k], k)):
        if used[k]:
            continue
        j, covered = k, 0
        while j >= 0 and not used[j]:
            used[j] = True
            first, j = j, back[j]
        covered = best[k] - (best[j] if j >= 0 else 0)
        out.append((rows[first][0] - rows[first][2], rows[k][0], rows[first][1] - rows[first][2], rows[k][1], covered))
    return sorted(out)


class Scanner:
    """Finds phrases and covered spans of licence templates in the words of a text."""

    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, long_match: int = LONG_MATCH, gap: int = GAP):
        self.labels = [label for label, _ in templates]
        self.phrase_labels = list(phrases.values())
        texts = [words_of(text) for _, text in templates]
        self.sizes = [len(t) for t in texts]
        spoken = [words_of(p) for p in phrases]
        self.long_match, self.gap = long_match, gap
        self.automaton = Automaton(texts + spoken, spoken, min([long_match, *self.sizes]))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int, int, int]]]:
        """Phrase places (phrase, start), and spans (template, start, end, template start, template end, covered).

        A match is chained where it can't be extended by the next word. A template shorter than a long match counts
        where it is matched whole.
        """
        a = self.automaton
        places, anchors = [], {}
        last = None

        def add(end: int, state: int, length: int) -> None:
            for t, t_end in a.ends[state]:
                if t < len(self.sizes) and length >= min(self.long_match, self.sizes[t]):
                    anchors.setdefault(t, []).append((end, t_end, min(length, t_end)))

        for end, state, length in a.matches(words):
            for p in a.marks[state]:
                n = a.phrase_length[p]
                if n <= length:
                    places.append((p, end - n))
            if last and not (end == last[0] + 1 and length == last[2] + 1):
                add(*last)
            last = end, state, length
        if last:
            add(*last)
        return places, [(t, *span) for t in sorted(anchors) for span in chain(anchors[t], self.gap)]


@lru_cache(maxsize=4)
def _default() -> Scanner:
    return Scanner()


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(id, n_words, places, spans): what each text says of licences.

    places: (label, start, n_words) of every place of a phrase; spans: (label, template, start, end, t_start, t_end, covered,
    share) of each chained stretch, in words of the text and of the template; share: covered words of the template's. One
    row for each row, by its own text: repeated rows and ids give repeated rows; null, empty and wordless texts no words,
    places or spans. No shuffle; the automaton (the templates' words, a few thousand states) is built in each worker. A
    text is streamed in time linear in its words; only long matches are kept, and a match is chained with those at most
    ``gap`` words before it. Equal places of several templates give a span each.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    i64 = pa.int64()
    place_type = pa.list_(pa.struct([("label", pa.string()), ("start", i64), ("n_words", i64)]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("template", i64), ("start", i64), ("end", i64), ("t_start", i64), ("t_end", i64), ("covered", i64), ("share", pa.float64())]))

    def work(batches):
        s = scanner or _default()
        for batch in batches:
            counts, all_places, all_spans = [], [], []
            for text in batch.column(1):
                words = words_of(text.as_py())
                places, spans = s.scan(words)
                counts.append(len(words))
                all_places.append([{"label": s.phrase_labels[p], "start": at, "n_words": s.automaton.phrase_length[p]} for p, at in places])
                all_spans.append([{"label": s.labels[t], "template": t, "start": lo, "end": hi, "t_start": t_lo, "t_end": t_hi, "covered": n, "share": n / s.sizes[t]} for t, lo, hi, t_lo, t_hi, n in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, i64), pa.array(all_places, place_type), pa.array(all_spans, span_type)], ["id", "n_words", "places", "spans"])

    return rows.mapInArrow(
        work,
        f"id {kind.simpleString()}, n_words long, places array<struct<label:string,start:long,n_words:long>>, spans array<struct<label:string,template:long,start:long,end:long,t_start:long,t_end:long,covered:long,share:double>>",
    )


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: the largest share of a template that one span covers, 1 where a phrase stands, 0 without either."""
    found = scan_licences(table(spark, sf_dir, "documents"))
    named = lambda c: F.transform(c, lambda x: x["label"])
    starts = F.transform("places", lambda x: x["start"])
    covered = F.filter("spans", lambda x: x["share"] >= COVERED)
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    share = F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(named("places")).alias("base_labels"), joined(F.concat(named("places"), named(covered))).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(F.least(share, F.lit(1.0))).alias("score"),
    )
