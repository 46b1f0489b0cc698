"""License scan by patience alignment of texts with license templates.

A stretch of a text and a template are aligned on anchors: words that occur once in both. The
longest run of anchors in the template's order (a longest increasing subsequence) is fixed, and
the gaps between them are aligned the same way; at the edges of a gap equal words go first. The
share of the template's words that got a partner is its coverage.

A copy with the wanted coverage lacks a known number of template words at most. So one of the
rarest template words of the text, one more than that number, is in every copy, and only the
stretches around their places are aligned. A text without enough template words is passed over.

Templates of which one shows in a whole copy of the other without standing there word for word
(versions of a license, a license with and without a clause) are rivals. Of overlapping copies of
rivals the one with most words stays. SPDX lines are not aligned but read: the longest known
names in a row, with operators between them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm import notices
from shelfline.llm.common import cut, column, docs_in, hash_words, ship, word_spans, tidy

#: Notices as authors put them into files. ``notices`` has more, and whole texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction"
    ),
    "reserved": "All rights reserved.",
}
#: Words from which a window is first looked through for enough template words.
LONG = 64
#: Least coverage that counts as found.
COVERAGE = 0.9

#: Words are runs of ASCII letters, digits and bytes above 127; A-Z count as a-z.
_GAP = np.ones(256, bool)
_GAP[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = False
_GAP[128:] = False


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence (patience piles with back pointers)."""
    tops, piles, back = [], [], []
    for place, value in enumerate(values):
        pile = bisect_left(tops, value)
        back.append(piles[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(value)
            piles.append(place)
        else:
            tops[pile], piles[pile] = value, place
    out, place = [], piles[-1] if piles else -1
    while place >= 0:
        out.append(place)
        place = back[place]
    return out[::-1]


def align(template: list, text: list) -> list[tuple[int, int]]:
    """Pairs (template place, text place) of the patience alignment, in order."""
    out, work = [], [(0, len(template), 0, len(text))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and template[a] == text[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and template[b - 1] == text[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = {w for w, n in Counter(template[a:b]).items() if n == 1}
        seen = Counter(w for w in text[c:d] if w in once)
        at = {w: a + i for i, w in enumerate(template[a:b]) if seen.get(w) == 1}
        anchors = [(at[w], c + i) for i, w in enumerate(text[c:d]) if w in at]
        fixed = [anchors[i] for i in increasing([x for x, _ in anchors])]
        if not fixed:
            continue
        out += fixed
        for (x, y), (u, v) in zip([(a - 1, c - 1), *fixed], [*fixed, (b, d)], strict=True):
            work.append((x + 1, u, y + 1, v))
    return sorted(out)


class Scanner:
    """Templates as lists of word numbers, and the hashes of those words."""

    def __init__(self, templates: Mapping[str, str], coverage: float):
        coded = {}
        for name, text in sorted(templates.items()):
            data = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = word_spans(data, np.array([0, len(data)]), _GAP)
            if len(starts):
                coded[name] = hash_words(data, starts, ends, lower=True)
        self.known = np.unique(np.concatenate(list(coded.values()))) if coded else np.zeros(0, np.uint64)
        self.templates = {name: np.searchsorted(self.known, codes).tolist() for name, codes in coded.items()}
        self.least = {name: int(np.ceil(coverage * len(t) - 1e-9)) for name, t in self.templates.items()}
        #: Words after "SPDX-License-Identifier" and the template.
        self.spdx = {tuple(t[3:]): name for name, t in self.templates.items() if name.startswith("spdx:")}
        self.prefix = next((t[:3] for name, t in self.templates.items() if name.startswith("spdx:")), [])
        data = np.frombuffer(b"or and with", np.uint8)
        either = self.numbers(data, np.array([0, len(data)]))[0].tolist() if coded else [-1] * 3
        self.joins, self.exception = {x for x in either if x >= 0}, either[2]
        #: Distinct words of each aligned template and how often it has them; all of them in a row.
        self.words = {name: np.unique(t, return_counts=True) for name, t in self.templates.items() if not name.startswith("spdx:")}
        self.all_words = np.concatenate([np.zeros(0, np.int64), *[w for w, _ in self.words.values()]])
        self.all_times = np.concatenate([np.zeros(0, np.int64), *[n for _, n in self.words.values()]])
        sizes = np.array([len(w) for w, _ in self.words.values()], np.int64)
        self.begins, self.leasts = np.cumsum(sizes) - sizes, np.array([self.least[name] for name in self.words], np.int64)
        self.rivals = {(a, b) for a in self.words for b in self.words if a != b and self._shows(a, b)}
        self.rivals |= {(b, a) for a, b in self.rivals}

    def _shows(self, name: str, other: str) -> bool:
        """Whether a whole copy of ``other`` counts as one of ``name``, but not word for word."""
        a, b = self.templates[name], self.templates[other]
        words, times = self.words[name]
        if len(a) > len(b) * 2 or np.minimum(self._counts(np.array(b))[words], times).sum() < self.least[name]:
            return False
        if any(b[i : i + len(a)] == a for i in range(len(b) - len(a) + 1)):
            return False
        return len(align(a, b)) >= self.least[name]

    def _counts(self, words: np.ndarray) -> np.ndarray:
        return np.bincount(words[words >= 0], minlength=len(self.known))

    def numbers(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, -1 for one that no template has; first word of each text and the end)."""
        starts, ends, first = word_spans(data, offsets, _GAP)
        codes = hash_words(data, starts, ends, lower=True)
        at = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
        return np.where(self.known[at] == codes, at, -1), first

    def find(self, words: np.ndarray) -> list[tuple[str, int, int, int]]:
        """(template, matched words, first word, word after the last) of all copies in a text."""
        counts = self._counts(words)
        out = self._spdx_lines(words) if self.spdx and counts[self.prefix].all() else []
        # Words of the templates that copies may have, counted with their repeats.
        held = np.add.reduceat(np.minimum(counts[self.all_words], self.all_times), self.begins) if self.words else np.zeros(0, np.int64)
        names = list(self.words)
        for name in (names[i] for i in np.flatnonzero(held >= self.leasts)):
            template = self.templates[name]
            size, least = len(template), self.least[name]
            own, times = self.words[name]
            order = np.lexsort((own, counts[own]))
            lacking = size - least
            seeds, missing = [], 0
            for w, n in zip(own[order].tolist(), times[order].tolist(), strict=True):
                if missing > lacking:
                    break
                missing += n
                seeds.append(w)
            places = {w: np.flatnonzero(words == w) for w in seeds if counts[w]}
            of_word: dict[int, list[int]] = {}
            for i, w in enumerate(template):
                of_word.setdefault(w, []).append(i)
            slack = size // 4 + 2
            hits, tried = set(), set()
            for w in seeds:
                for i in of_word[w]:
                    for p in places.get(w, ()):
                        # Words around a copy may repeat its anchors, so its own length is tried too.
                        for more in (0, slack):
                            begin, end = max(0, int(p) - i - more), min(len(words), int(p) + size - i + more)
                            if (begin, end) in tried:
                                continue
                            tried.add((begin, end))
                            near = words[begin:end]
                            if size >= LONG and np.minimum(self._counts(near)[own], times).sum() < least:
                                continue
                            pairs = align(template, near.tolist())
                            if len(pairs) >= least:
                                hits.add((len(pairs), begin + pairs[0][1], begin + pairs[-1][1] + 1))
            taken: list[tuple[int, int]] = []
            for matched, begin, end in sorted(hits, key=lambda h: (-h[0], h[2] - h[1], h[1])):
                if all(end <= a or begin >= z for a, z in taken):
                    taken.append((begin, end))
                    out.append((name, matched, begin, end))
        return self._best(out) if len(out) > 1 else out

    def _spdx_lines(self, words: np.ndarray) -> list[tuple[str, int, int, int]]:
        out, longest = [], max(len(x) for x in self.spdx)
        for begin in np.flatnonzero(words == self.prefix[0]).tolist():
            if words[begin : begin + 3].tolist() != self.prefix:
                continue
            place = begin + 3
            while True:
                here = words[place : place + longest].tolist()
                size = next((n for n in range(len(here), 0, -1) if tuple(here[:n]) in self.spdx), 0)
                if size:
                    out.append((self.spdx[tuple(here[:size])], 3 + size, begin, place + size))
                    place += size
                else:
                    place += next((i for i, w in enumerate(here) if w in self.joins), 0)  # an unknown name
                join = int(words[place]) if place < len(words) else -1
                if join not in self.joins:
                    break
                place += 1
                if join == self.exception:  # its name has no template
                    rest = words[place : place + 10].tolist()
                    place += next((i + 1 for i, w in enumerate(rest) if w in self.joins), len(rest))
        return out

    def _best(self, found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
        """``found`` without copies that overlap a better one of a rival."""
        if not any((a, b) in self.rivals for a in {f[0] for f in found} for b in {f[0] for f in found}):
            return found
        kept: list[tuple[str, int, int, int]] = []
        for copy in sorted(found, key=lambda f: (-f[1], len(self.templates[f[0]]), f[3] - f[2], f)):
            name, _, begin, end = copy
            if all((name, other) not in self.rivals or end <= a or begin >= z for other, _, a, z in kept):
                kept.append(copy)
        stay = set(kept)
        return [f for f in found if f in stay]


def _scan(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
        for batch in batches:
            ids = column(batch, "doc_id")
            for start, _, data, offsets in docs_in(column(batch, "text")):
                words, first = scanner.numbers(data, offsets)
                rows = []
                for i, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    for name, matched, begin, end in scanner.find(words[a:z]):
                        rows.append((ids[start + i].as_py(), name, matched / len(scanner.templates[name]), begin, end))
                columns = zip(*rows, strict=True) if rows else ([],) * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
                    names=["doc_id", "license", "coverage", "first_word", "end_word"],
                )

    return run


def known() -> dict[str, str]:
    """All templates of common licenses."""
    return notices.notices() | notices.texts() | TEMPLATES


def scan(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    templates: Mapping[str, str] | None = None,
    coverage: float = COVERAGE,
) -> DataFrame:
    """doc_id, license, coverage, first_word and end_word of every copy of a template.

    Copies have at least ``coverage`` of the template's words in an aligned stretch of at most the
    template's length and half as much again; of copies of one template that overlap the one with
    most words stays, then the shorter, then the earlier. Of overlapping copies of rivals the one
    with most words stays, then that of the shorter template. Without ``templates`` those of
    common licenses are looked for: TEMPLATES, and notices, SPDX lines and whole texts of ``notices``. Places count the text's words from
    0, end_word is the one after the last. A NULL or empty text has no copies; repeated rows give
    their copies each, a NULL id as it is. An empty table or no templates give an empty result;
    other columns are not looked at.
    """
    ship(documents.sparkSession)
    scanner = Scanner(known() if templates is None else templates, coverage)
    docs = cut(documents, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text")
    if not scanner.templates:
        docs = docs.limit(0)
    return docs.mapInArrow(tidy(_scan(scanner)), "doc_id long, license string, coverage double, first_word long, end_word long")
