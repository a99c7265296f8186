"""Licence scans with a generalised suffix automaton over the words of licence templates.

Each text is streamed through the automaton for its matching statistics: the longest part of each template that ends at each
word. Matches of min_match words that can't go on are chained per template, in order and with bounded gaps, into covered
spans; of one template all chains that cover enough of it and don't overlap are told.
Words outside the templates reset the automaton, so only runs of template words leave the vectorised path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import textops
from corpusloom.session import small_batches

#: Fixed phrases whose every place counts, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Fixed licence notices by label; a text may have several templates.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Released under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "reserved": ["All rights reserved"],
}


class Automaton:
    """Suffix automaton of several word sequences; each state knows the templates' places where its words end."""

    def __init__(self, sequences: list[list[int]]):
        self.next, self.link, self.size, self.ends = [{}], [-1], [0], [set()]
        for k, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((k, place + 1))
        for state in sorted(range(1, len(self.size)), key=lambda s: -self.size[s]):
            self.ends[self.link[state]] |= self.ends[state] if self.link[state] > 0 else set()

    def _state(self, size: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.size.append(size)
        self.link.append(link)
        self.ends.append(set())
        return len(self.size) - 1

    def _split(self, state: int, word: int) -> int:
        """The target of state by word that is exactly one word longer, made by cloning where it is not."""
        target = self.next[state][word]
        if self.size[target] == self.size[state] + 1:
            return target
        clone = self._state(self.size[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.size[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def held(self, least: int) -> list[dict[tuple[int, int], int]]:
        """For each state the places (template, place) that its shorter suffixes of at least so many words end at, with these
        suffixes' lengths, where they are longer than its link's own words there."""
        out: list[dict[tuple[int, int], int]] = [{} for _ in self.size]
        for state in sorted(range(1, len(self.size)), key=lambda s: self.size[s]):
            up = self.link[state]
            if self.size[up] >= least:
                out[state] = dict(out[up]) | dict.fromkeys(self.ends[up], self.size[up])
        return out

    def matches(self, words: list[int], least: int, held: list[dict[tuple[int, int], int]]) -> list[tuple[int, int, int, int]]:
        """Matches (end, template, place, length) of at least so many words with a template, of any that end at a place the
        longest, and none that goes on."""
        state = size = 0
        found: list[tuple[int, int, int, int]] = []
        before: dict[tuple[int, int], int] = {}
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if word in self.next[state]:
                state, size = self.next[state][word], size + 1
            else:
                state = size = 0
            now = held[state] | dict.fromkeys(self.ends[state], size) if size >= least else {}
            found += [(i, t, place, n) for (t, place), n in before.items() if (t, place + 1) not in now]
            before = now
        return [*found, *((len(words), t, place, n) for (t, place), n in before.items())]


class Scanner:
    """Templates, their automaton and the phrases, ready for a worker."""

    def __init__(self, templates: dict[str, list[str]], base: dict[str, str], min_match: int, max_gap: int, min_cover: float):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        self.names = [label for label, texts in templates.items() for _ in texts]
        texts = [x for y in templates.values() for x in y]
        hashes, ptr = self._hash([*texts, *base])
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        parts = [ids[ptr[i] : ptr[i + 1]].tolist() for i in range(len(ptr) - 1)]
        self.sizes = [len(x) for x in parts[: len(texts)]]
        self.automaton = Automaton(parts[: len(texts)])
        self.held = self.automaton.held(min_match)
        self.phrases = list(zip(parts[len(texts) :], base.values(), strict=True))

    @staticmethod
    def _hash(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = textops.buffers(pa.array(texts, pa.large_string()))
        return textops.word_hashes(data, offsets)

    def chained(self, hits: list[tuple[int, int, int]], enough: float) -> list[tuple[int, int, int]]:
        """Chains (first word, last word, covered words) of one template's hits (end, place, length), the best first, then those
        that cover enough beside it without overlap."""
        hits = sorted(hits)
        best: list[tuple[int, int]] = []  # covered words of the best chain that ends here, its first word
        for i, (end, place, size) in enumerate(hits):
            covered, first = size, end - size
            for j in range(i - 1, -1, -1):
                b_end, b_place, _ = hits[j]
                if end - size - b_end > self.max_gap:
                    break
                new = size - max(0, b_end - (end - size), b_place - (place - size))
                if new > 0 and b_place < place and b_end < end and best[j][0] + new > covered:
                    covered, first = best[j][0] + new, best[j][1]
            best.append((covered, first))
        out: list[tuple[int, int, int]] = []
        for (end, _, _), (covered, first) in sorted(zip(hits, best, strict=True), key=lambda x: (-x[1][0], x[0])):
            if covered < enough:
                break
            if all(end <= a or first > b for a, b, _ in out):
                out.append((first, end - 1, covered))
        return sorted(out)

    def chains(self, runs: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, int]]:
        """Chains (template, first word, last word, covered words) of a text's runs (start, words)."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for at, words in runs:
            for end, template, place, size in self.automaton.matches(words, self.min_match, self.held):
                by.setdefault(template, []).append((at + end, place, size))
        return [(t, *x) for t, hits in by.items() for x in self.chained(hits, self.min_cover * self.sizes[t])]

    def scan(self, column: pa.Array):
        """For each row: words, base places, first, last, base labels, labels, score, spans."""
        data, offsets = textops.buffers(column)
        for lo, hi in textops.slices(offsets):
            hashes, ptr = textops.word_hashes(data, offsets[lo : hi + 1])
            ids = np.searchsorted(self.vocabulary, hashes)
            ids[ids == len(self.vocabulary)] = 0
            ids[self.vocabulary[ids] != hashes] = -1
            n, rows = np.diff(ptr), hi - lo
            row_of = np.repeat(np.arange(rows), n)
            places, first, last = np.zeros(rows, np.int64), np.full(rows, -1), np.full(rows, -1)
            labels: dict[int, set[str]] = {}
            for phrase, label in self.phrases:
                room = len(ids) - len(phrase) + 1
                if room <= 0:
                    continue
                at = np.flatnonzero(ids[:room] == phrase[0])
                for k, word in enumerate(phrase[1:], 1):
                    at = at[(ids[at + k] == word) & (row_of[at + k] == row_of[at])]
                own = row_of[at]
                places += np.bincount(own, minlength=rows)
                word = at - ptr[own]
                for r, w in zip(own.tolist(), word.tolist(), strict=True):
                    labels.setdefault(r, set()).add(label)
                    first[r], last[r] = (w if first[r] < 0 else min(first[r], w)), max(last[r], w)
            start, end, _ = textops.spans(ids >= 0, ptr)
            long = end - start >= self.min_match
            runs: dict[int, list[tuple[int, list[int]]]] = {}
            for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True):
                r = int(row_of[a])
                runs.setdefault(r, []).append((a - int(ptr[r]), ids[a:b].tolist()))
            chains = {r: found for r, x in runs.items() if (found := self.chains(x))}
            for r in range(rows):
                base, spans = labels.get(r, set()), chains.get(r, [])
                all_labels = base | {self.names[t] for t, *_ in spans}
                score = max([1.0 if base else 0.0, *(c / self.sizes[t] for t, _, _, c in spans)])
                some = first[r] >= 0
                yield int(n[r]), int(places[r]), int(first[r]) if some else None, int(last[r]) if some else None, ",".join(sorted(base)), ",".join(sorted(all_labels)), min(score, 1.0), [{"label": self.names[t], "first_word": a, "last_word": b, "covered": c, "template_words": self.sizes[t]} for t, a, b, c in spans]


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("covered", pa.int64()), ("template_words", pa.int64())]))
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPAN]
_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] = TEMPLATES, base: dict[str, str] = BASE, min_match: int = 3, max_gap: int = 12, min_cover: float = 0.7) -> DataFrame:
    """For each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    score is the largest share of a template that one chain covers, and 1 for any base phrase; spans are all chains
    of each template from min_cover on that do not overlap, the best first. Null and empty texts have no words, no labels and score 0. Repeated rows and null
    ids are kept; other columns are left out.
    """

    def scan(batches):
        scanner = Scanner(templates, base, min_match, max_gap, min_cover)
        for batch in batches:
            found = list(zip(*scanner.scan(batch.column(1)), strict=True)) or [[]] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(found, _TYPES, strict=True))], ["doc_id", *_NAMES])

    small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,covered:bigint,template_words:bigint>>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(textops.lean(scan), fields)
