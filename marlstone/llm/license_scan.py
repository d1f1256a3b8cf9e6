"""License scan by template markup.

A template is wording with optional regions and replaceable ones. It is
compiled into a token automaton: states are places in the template, a word
moves along mandatory wording, an optional region may be skipped, a replaceable
one takes a bounded number of any words. A text holds the license where the
automaton accepts, that is, where its mandatory wording stands exactly.

Markup: <<opt>>...<<end>> is optional, <<var:n>> takes up to n words of any kind.

Defined results: a null or empty text has no words, no labels and score 0;
repeated rows are scanned each; null ids stay; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases and their labels.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

#: Public license wordings, whole where they are short, and notices of the long ones, as templates.
_WARRANTY_BSD = """
THIS SOFTWARE IS PROVIDED BY <<var:12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:12>> BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GRANT_BSD = """
<<opt>>Copyright <<var:16>> <<end>><<opt>>All rights reserved. <<end>>
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met: <<opt>>1 <<end>>Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. <<opt>>2 <<end>>Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. """
_FREE_GNU = """
<<opt>>This file is part of <<var:8>> <<end>><<var:4>> is free software<<opt>>:<<end>> you can redistribute it and/or modify it under the terms of
the GNU {0}General Public License as published by the Free Software Foundation<<opt>>,<<end>> either version {1} of the License, or
<<opt>>(at your option)<<end>> any later version. <<var:4>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."""
TEMPLATES = [
    ("<<opt>>this <<var:2>> is<<end>> licensed under the apache license<<opt>> version 2 0<<end>>", "apache-2.0-notice"),
    ("<<opt>>this <<var:2>> is<<end>> licensed under the gnu general public license version 3", "gpl-3.0-notice"),
    ("<<opt>>this <<var:2>> is<<end>> licensed under the gnu general public license version 2", "gpl-2.0-notice"),
    ("<<opt>>this <<var:2>> is<<end>> licensed under cc by nc 4 0", "cc-by-nc-4.0-notice"),
    ("<<opt>>this <<var:2>> is<<end>> licensed under cc by sa 4 0", "cc-by-sa-4.0-notice"),
    ("<<opt>>this <<var:2>> is<<end>> licensed under cc by 4 0", "cc-by-4.0-notice"),
    ("released under the <<opt>>terms of the <<end>>mit license", "mit-notice"),
    ("spdx license identifier <<var:4>>", "spdx-tag"),
    (
        """<<opt>><<opt>>The <<end>>MIT License <<opt>>(MIT) <<end>><<end>><<opt>>Copyright <<var:16>> <<end>>
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so, subject to the following conditions: The above copyright notice and this permission notice <<opt>>(including the next paragraph)
        <<end>>shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL <<var:8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "mit-text",
    ),
    (
        """<<opt>>Copyright <<var:16>> <<end>>Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted<<opt>>, provided that the above copyright notice and this permission notice appear in all copies<<end>>. THE SOFTWARE IS
        PROVIDED "AS IS" AND <<var:8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "isc-text",
    ),
    (_GRANT_BSD + _WARRANTY_BSD, "bsd-2-clause-text"),
    (
        _GRANT_BSD + """<<opt>>3 <<end>>Neither the name of <<var:12>> nor the names of <<var:4>> contributors may be used to endorse or promote products
        derived from this software without specific prior written permission. """ + _WARRANTY_BSD,
        "bsd-3-clause-text",
    ),
    (
        """<<opt>>Copyright <<var:16>> <<end>>This software is provided 'as-is', without any express or implied warranty. In no event will the authors
        be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
        purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        <<opt>>1 <<end>>The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use
        this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<opt>>2 <<end>>Altered
        source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<opt>>3 <<end>>This notice
        may not be removed or altered from any source distribution.""",
        "zlib-text",
    ),
    (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
        means.""",
        "unlicense-text",
    ),
    (
        """<<opt>>Copyright <<var:16>> <<end>>Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at <<var:8>> Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
        implied. See the License for the specific language governing permissions and limitations under the License.""",
        "apache-2.0-text",
    ),
    (_FREE_GNU.format("", "<<var:1>>"), "gpl-or-later-text"),
    (_FREE_GNU.format("Lesser ", "<<var:2>>"), "lgpl-or-later-text"),
    (_FREE_GNU.format("Affero ", "<<var:1>>"), "agpl-or-later-text"),
    (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at <<var:6>>""",
        "mpl-2.0-text",
    ),
]
_MARK = re.compile(rf"<<(opt|end|var:\d+)>>|({WORD})")


class Automaton:
    """States 0..n; edges by word, empty edges, and edges by any word."""

    def __init__(self, template: str):
        self.words: list[dict[str, int]] = [{}]
        self.skips: list[list[int]] = [[]]
        self.any: list[int | None] = [None]
        opened: list[int] = []
        for mark, word in _MARK.findall(template.lower()):
            at = len(self.words) - 1
            if word:
                self.words[at][word] = self._new()
            elif mark == "opt":
                opened.append(at)
            elif mark == "end":
                self.skips[opened.pop()].append(at)
            else:
                stops = [at]
                for _ in range(int(mark[4:])):
                    here = len(self.words) - 1
                    self.any[here] = self._new()
                    stops.append(len(self.words) - 1)
                for s in stops[:-1]:
                    self.skips[s].append(stops[-1])
        if opened:
            raise ValueError("an optional region is not closed")
        self.last = len(self.words) - 1
        begins = self._closure({0})
        self.first = {w for s in begins for w in self.words[s]}
        self.open_start = self.last in begins or any(self.any[s] is not None for s in begins)

    def _new(self) -> int:
        self.words.append({})
        self.skips.append([])
        self.any.append(None)
        return len(self.words) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[str], at: int) -> int | None:
        """End of the longest accepted run of words from at on."""
        states, end = self._closure({0}), None
        while True:
            if self.last in states:
                end = at
            if at >= len(words) or not states:
                return end
            w = words[at]
            states = self._closure({t for s in states for t in (self.words[s].get(w), self.any[s]) if t is not None})
            at += 1

    def found(self, words: list[str]) -> int:
        """Words of the longest accepted run that begins anywhere; 0 if none does."""
        best = 0
        for at, w in enumerate(words):
            if (self.open_start or w in self.first) and (end := self.accepts(words, at)) is not None:
                best = max(best, end - at)
        return best


class Scanner:
    def __init__(self):
        self.word = re.compile(WORD)
        self.phrases = [(p.split(" "), label, f" {p} ") for p, label in PHRASES]
        self.templates = [(Automaton(t), label, self._needed(t)) for t, label in TEMPLATES]

    @staticmethod
    def _needed(template: str) -> str:
        """The longest mandatory wording: a text without it cannot be accepted."""
        depth, runs = 0, [[]]
        for mark, word in _MARK.findall(template.lower()):
            depth += (mark == "opt") - (mark == "end")
            if mark:
                runs.append([])
            elif not depth:
                runs[-1].append(word)
        return f" {' '.join(max(runs, key=len))} "

    def scan(self, text: str | None) -> tuple:
        """(n_words, n_base, first_word, last_word, base_labels, labels, score)."""
        words = self.word.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text)) if text else []
        flat = f" {' '.join(words)} "
        starts, base = [], set()
        for _, label, key in self.phrases:
            at = flat.find(key)
            while at >= 0:
                starts.append(flat.count(" ", 0, at))
                base.add(label)
                at = flat.find(key, at + 1)
        more, covered = set(), 0
        for automaton, label, needed in self.templates:
            if needed in flat and (n := automaton.found(words)):
                more.add(label)
                covered = max(covered, n)
        score = 0.0 if not (base or more) else 0.5 if not more else 0.5 + 0.5 * min(1.0, covered / len(words))
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score


def license_report(docs: DataFrame) -> DataFrame:
    """Words, base phrases, template labels and a score for each document. The score is 0 without a label, 0.5 with a phrase
    alone, and above it the share of the text that an accepted template covers."""

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner = Scanner()
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = list(zip(*map(scanner.scan, batch.column(1).to_pylist())))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(rows, kinds))], names)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return slim.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
