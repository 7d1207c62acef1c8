"""License scan by an exact set-similarity join of text blocks with license templates.

A block is a run of consecutive words, a quarter longer than the template, at any
place of the text: line ends and comment signs do not matter, so wrapped licenses
are met, and words scattered over a long text are not.  A template is met when at
least ``THRESHOLD`` of its different words stand in one block.  Templates are whole
short licenses and notices, and the sentences by which licenses are granted.
Template words are ordered by how many documents hold them, rarest first, counted
over all documents; only vocabulary words of the templates are counted, so the
table sent back is bounded by the templates.  A block is compared with a template
only if

* prefix: it holds one of the template's ``size - needed + 1`` rarest words,
* length: it has at least ``needed`` words of the template, and
* positional: the words from the first common one on can still reach ``needed``.

All three are exact: no block that meets the threshold is missed.  Blocks around
prefix words that overlap are scanned together in one sliding pass, so a text costs
time linear in its words.  Templates are a fixed list that goes to every task;
texts are scanned in place, whole.

Defined results: a null text counts as empty; an empty text has no words, no
labels and score 0; a text shorter than a block is one block; repeated rows each
keep their row; an empty table gives none.
"""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowtide.llm.common import LOWER, map_rows, pick

THRESHOLD = Fraction(9, 10)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# The base phrases.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
# Wording of common public licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "Licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Licensed under the BSD License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "Licensed under a Creative Commons Attribution International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Licensed under a Creative Commons Attribution NonCommercial International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Licensed under a Creative Commons Attribution ShareAlike International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("cc0", "Released under the CC0 Public Domain Dedication"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    # Whole texts and notices.
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
        DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
        SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
        OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT
        HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
        FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
        SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"""),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
        License."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
]
COLUMNS = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(LOWER))


def window_of(n_words: int) -> int:
    """Words of a block for a template of so many words (repeats counted)."""
    return n_words + -(-n_words // 4)


def template_sets(templates=None) -> list[tuple[str, frozenset[bytes], int]]:
    """(label, different words, words of a block) of each template."""
    listed = [(label, words_of(t)) for label, t in (TEMPLATES if templates is None else templates)]
    return [(label, frozenset(w), window_of(len(w))) for label, w in listed]


class _Frequencies:
    """Documents that hold each template word, summed per task."""

    def __init__(self, vocabulary):
        self.vocabulary = vocabulary

    def __call__(self, rows):
        seen: Counter = Counter()
        for (text,) in rows:
            seen.update(self.vocabulary.intersection(words_of(text)))
        yield from ((w.decode(), n) for w, n in seen.items())


class Index:
    """Ordered templates with their prefixes."""

    def __init__(self, templates, frequency, threshold=THRESHOLD):
        order = {w: i for i, w in enumerate(sorted({w for _, t, _ in templates for w in t}, key=lambda w: (frequency.get(w.decode(), 0), w)))}
        self.entries, self.by_prefix = [], {}
        for k, (label, t, window) in enumerate(templates):
            ranked = sorted(t, key=order.__getitem__)
            needed = -(-threshold.numerator * len(ranked) // threshold.denominator)
            self.entries.append((label, {w: at for at, w in enumerate(ranked)}, needed, window))
            for w in ranked[: len(ranked) - needed + 1]:
                self.by_prefix.setdefault(w, []).append(k)
        self.prefix_words = frozenset(self.by_prefix)

    def matches(self, words: list[bytes]):
        """(label, best containment) of each template that a block of the text meets."""
        near: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.prefix_words:
                for k in self.by_prefix[w]:
                    near.setdefault(k, []).append(i)
        for k, places in near.items():
            label, rank, needed, window = self.entries[k]
            best = max(self._best(words, lo, hi, rank, needed, window) for lo, hi in around(places, window, len(words)))
            if best >= needed:
                yield label, best / len(rank)

    @staticmethod
    def _best(words, lo, hi, rank, needed, window) -> int:
        """Most different template words in a block of words[lo:hi], 0 if the filters rule all blocks out."""
        hits = [(i, words[i]) for i in range(lo, hi) if words[i] in rank]
        held = {w for _, w in hits}
        if len(hits) < needed or min(len(rank) - min(rank[w] for w in held), len(held)) < needed:
            return 0
        count: Counter = Counter()
        best = first = 0
        for i, w in hits:
            while hits[first][0] <= i - window:
                old = hits[first][1]
                count[old] -= 1
                if not count[old]:
                    del count[old]
                first += 1
            count[w] += 1
            best = max(best, len(count))
        return best


def around(places: list[int], window: int, n: int):
    """Ranges that hold every block with one of the ascending places, overlapping ones merged."""
    lo = hi = None
    for p in places:
        a, b = max(p - window + 1, 0), min(p + window, n)
        if lo is None:
            lo, hi = a, b
        elif a <= hi:
            hi = b
        else:
            yield lo, hi
            lo, hi = a, b
    yield lo, hi


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place where a base phrase stands."""
    present, out = set(words), []
    for phrase, label in PHRASES:
        parts = phrase.encode().split()
        if not present.issuperset(parts):
            continue
        at = -1
        for _ in range(words.count(parts[0])):
            at = words.index(parts[0], at + 1)
            if words[at : at + len(parts)] == parts:
                out.append((at, label))
    return out


class _Scan:
    def __init__(self, index):
        self.index = index

    def __call__(self, rows):
        for doc_id, text in rows:
            words = words_of(text)
            base = base_places(words)
            labels = {label for _, label in base}
            base_labels = ",".join(sorted(labels))
            score = 1.0 if base else 0.0
            if not self.index.prefix_words.isdisjoint(words):
                for label, share in self.index.matches(words):
                    labels.add(label)
                    score = max(score, share)
            starts = [at for at, _ in base]
            yield doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), base_labels, ",".join(sorted(labels)), score


def frequencies(docs: DataFrame, templates) -> dict[str, int]:
    """Document counts of the template words; no more rows than template words come back."""
    vocabulary = frozenset(w for _, t, _ in templates for w in t)
    counted = map_rows(pick(docs, "text"), "word string, n long", _Frequencies(vocabulary))
    return {r.word: r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, templates=None) -> DataFrame:
    """One row per document with its base places, labels and best containment."""
    sets = template_sets(templates)
    return map_rows(pick(docs, "doc_id", "text"), COLUMNS, _Scan(Index(sets, frequencies(docs, sets))))
