"""License notices in documents, by patience alignment with templates.

Words are runs of letters and digits, A-Z lower-cased. Where a template may lie in a text is found by votes: every word
that is unique in the template votes for the start it implies, and starts are counted in overlapping bands. Around a
start with enough votes text and template are aligned: words unique on both sides are anchors, the longest increasing
subsequence of their places is kept, common ends are matched, and the gaps between anchors are aligned again. Coverage
is the share of the template's words that are aligned. ``license_notices`` gives every notice found in a document;
``license_scan`` derives the best one: that of greatest coverage, of equal ones the longer, then the first in the list; that
all rights are reserved is the notice of a document without another one.

Documents are not shuffled, and templates are a list of fixed size.

Defined results: a null or empty text has no words and no license; repeated rows return each; an empty table gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.llm.words import words_of

# Notices in the wording of their licenses.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
     compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
     Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
     an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
     specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
     associated documentation files (the "Software"), to deal in the Software without restriction, including without
     limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
     Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
     The above copyright notice and this permission notice shall be included in all copies or substantial portions of
     the Software."""),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
     General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
     option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
     without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
     MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
     hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("BSD", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
     that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
     list of conditions and the following disclaimer."""),
    ("All-Rights-Reserved", "All rights reserved."),
)
#: No license but the notice that there is none; license texts say it too, so any license found goes before it.
RESERVED = "All-Rights-Reserved"
#: The least coverage that names a license, and the share of a template's unique words that must vote for a start.
COVERAGE, VOTES = 0.8, 0.4


def longest_increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tops, last, before = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        before[i] = last[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            last.append(i)
        else:
            tops[pile], last[pile] = v, i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in the text, in the template), ascending on both sides."""
    pairs, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            pairs.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if there[w] == 1 and here[w] == 1}
        unique = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place]
        anchors = [unique[k] for k in longest_increasing([j for _, j in unique])]
        if not anchors:
            continue
        pairs += anchors
        edges = [(a - 1, c - 1), *anchors, (b, d)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(pairs)


class Templates:
    """Templates as word hashes, with the places of the words that are unique in each."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES):
        self.names = [name for name, _ in templates]
        found = words_of(pa.array([text for _, text in templates]), letters_only=True)
        self.words = [w.tolist() for w in found.per_text(found.hashes)]
        self.lengths = np.array(list(map(len, self.words)))
        entries, unique = [], []
        for t, words in enumerate(self.words):
            once = [(w, t, j) for j, w in enumerate(words) if words.count(w) == 1]
            entries += once
            unique.append(len(once))
        entries.sort()
        self.hash = np.array([w for w, _, _ in entries], dtype=np.uint64)
        self.template = np.array([t for _, t, _ in entries])
        self.place = np.array([j for _, _, j in entries])
        self.need = np.maximum(2, np.ceil(VOTES * np.array(unique))).astype(np.int64)
        self.slack = np.maximum(2, self.lengths // 8)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[self.hash >> np.uint64(48)] = True

    def scan(self, texts: pa.Array, least: float = COVERAGE) -> list[tuple[int, list[tuple[str, float, int, int]]]]:
        """(words, [(license, coverage, first word, one past the last word)], best first) of every text."""
        found = words_of(texts, letters_only=True)
        ends = np.cumsum(found.counts)
        notices: dict[int, list[tuple[bool, float, int, int, int, int]]] = {}
        at = np.flatnonzero(self.maybe[found.hashes >> np.uint64(48)])
        left = np.searchsorted(self.hash, found.hashes[at], "left")
        times = np.searchsorted(self.hash, found.hashes[at], "right") - left
        hit = np.repeat(left - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        at = np.repeat(at, times)
        for text, template, low, high in self._starts(ends, at, self.template[hit], self.place[hit]):
            first = int(ends[text] - found.counts[text])
            n, slack = int(self.lengths[template]), int(self.slack[template])
            begin, end = max(first, low - slack), min(int(ends[text]), high + n + slack)
            pairs = patience(found.hashes[begin:end].tolist(), self.words[template])
            coverage = len(pairs) / n
            if coverage >= least:
                entry = (self.names[template] != RESERVED, coverage, n, -template, begin - first + pairs[0][0],
                         begin - first + pairs[-1][0] + 1)
                notices.setdefault(text, []).append(entry)
        return [(n, [(self.names[-t], coverage, first, last) for _, coverage, _, t, first, last
                     in self._apart(notices.get(text, []))]) for text, n in enumerate(found.counts.tolist())]

    @staticmethod
    def _apart(entries: list[tuple[bool, float, int, int, int, int]]) -> list[tuple[bool, float, int, int, int, int]]:
        """The entries, best first; of one template's spans that overlap by half, as two bands find them, the best."""
        # a span can only overlap those that begin within the longest span of it; few kept ones share a stretch of that length
        width = max((z - a for *_, a, z in entries), default=1)
        kept: list[tuple[bool, float, int, int, int, int]] = []
        near: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for entry in sorted(entries, key=lambda e: e[:4], reverse=True):
            template, first, last = entry[3:]
            around = (span for k in (-1, 0, 1) for span in near.get((template, first // width + k), ()))
            if not any(2 * (min(last, z) - max(first, a)) > min(last - first, z - a) for a, z in around):
                kept.append(entry)
                near.setdefault((template, first // width), []).append((first, last))
        return kept

    def _starts(self, ends: np.ndarray, at: np.ndarray, template: np.ndarray,
                place: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text, template, least start, greatest start) of bands with enough different words voting for them."""
        if not len(at):
            return
        text = np.searchsorted(ends, at, "right")
        start = at - place
        band = np.floor_divide(start, self.slack[template])
        rows = np.stack((text, template, band, place), axis=1)
        rows = np.concatenate((rows, rows - np.array([0, 0, 1, 0])))
        rows = np.unique(rows, axis=0)
        new = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1))))
        votes = np.diff(np.append(new, len(rows)))
        for t, k, b in rows[new[votes >= self.need[rows[new, 1]]], :3].tolist():
            slack = int(self.slack[k])
            yield t, k, b * slack, (b + 2) * slack - 1


def license_notices(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = COVERAGE) -> DataFrame:
    """(doc_id, n_words, notices), one row per row of ``docs``.

    ``notices`` is an array of (license, coverage, first_word, last_word), one per place where a template is covered to
    ``least``, the best first.
    """
    fields = ("license", "coverage", "first_word", "last_word")
    kind = pa.list_(pa.struct(list(zip(fields, (pa.string(), pa.float64(), pa.int64(), pa.int64())))))

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = batch.slice(at, 200)
                n, notices = zip(*known.scan(rows.column(1), least))
                notices = pa.array([[dict(zip(fields, notice)) for notice in found] for found in notices], kind)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), notices],
                                                 names=["doc_id", "n_words", "notices"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(body, "doc_id bigint, n_words bigint, notices array<struct<license:string,coverage:double,"
                                 "first_word:bigint,last_word:bigint>>")


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = COVERAGE) -> DataFrame:
    """(doc_id, n_words, license, coverage, first_word, last_word) of the best notice, one row per row of ``docs``.

    ``license`` is null and ``coverage`` 0 where no template is covered to ``least``.
    """
    best = F.get("notices", F.lit(0))
    return license_notices(docs, doc_id, text, templates, least).select(
        "doc_id", "n_words", best["license"].alias("license"),
        F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"),
        *[F.coalesce(best[c], F.lit(0).cast("bigint")).alias(c) for c in ("first_word", "last_word")])
