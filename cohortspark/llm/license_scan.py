"""License scan: templates with optional and replaceable regions.

A template is license wording with markup: ``<<optional>> ... <<end>>`` may be
left out, ``<<var N>>`` stands for up to N words of any kind.  A template is
compiled into a token automaton; a text is accepted where all mandatory words
match exactly.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortspark.llm.text import alnum_words, texts_of, worker_store

# Phrases counted as base places, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache",
           "general public license": "gpl"}

# Wording of public licenses, whole up to the end of what must
# stand in them, and of the notices and statements that refer to one.
TEMPLATES = {
    "mit-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of
        this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice
        <<optional>> (including the next paragraph) <<end>> shall be included in all copies
        or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
        WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
        OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL <<var 20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
        ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """
        Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software
        for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND <<var 20>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        <<var 20>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
        OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION
        WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-text": """
        Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: <<optional>> 1. <<end>>
        Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. <<optional>> 2. <<end>> Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with
        the distribution. <<optional>> <<optional>> 3. <<end>> Neither the name of <<var 20>>
        nor the names of <<optional>> its <<end>> <<var 3>> contributors may be used to endorse
        or promote products derived from this software without specific prior written
        permission. <<end>> THIS SOFTWARE IS PROVIDED BY <<var 20>> "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
        <<var 20>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
        CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
        SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
        ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF
        ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """
        <<optional>> 3. <<end>> Neither the name of <<var 20>> nor the names of
        <<optional>> its <<end>> <<var 3>> contributors may be used to endorse or promote
        products derived from this software without specific prior written permission.""",
    "zlib-text": """
        This software is provided 'as-is', without any express or implied warranty. In no
        event will the authors be held liable for any damages arising from the use of this
        software. Permission is granted to anyone to use this software for any purpose,
        including commercial applications, and to alter it and redistribute it freely, subject
        to the following restrictions: <<optional>> 1. <<end>> The origin of this software must
        not be misrepresented; you must not claim that you wrote the original software. If you
        use this software in a product, an acknowledgment in the product documentation would
        be appreciated but is not required. <<optional>> 2. <<end>> Altered source versions
        must be plainly marked as such, and must not be misrepresented as being the original
        software. <<optional>> 3. <<end>> This notice may not be removed or altered from any
        source distribution.""",
    "unlicense": """
        This is free and unencumbered software released into the public domain. Anyone is free
        to copy, modify, publish, use, compile, sell, or distribute this software, either in
        source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
        author or authors of this software dedicate any and all copyright interest in the
        software to the public domain. We make this dedication for the benefit of the public at
        large and to the detriment of our heirs and successors. We intend this dedication to be
        an overt act of relinquishment in perpetuity of all present and future rights to this
        software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    "apache-statement": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
        <<var 4>> except in compliance with the License. You may obtain a copy of the License at
        <<var 12>> Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
        language governing permissions and limitations under the License.""",
    "gpl-statement": """
        This <<var 4>> is free software: you can redistribute it and/or modify it under the
        terms of the GNU <<optional>> Lesser <<end>> <<optional>> Affero <<end>> General Public
        License as published by the Free Software Foundation, either version <<var 2>> of the
        License, <<optional>> or (at your option) any later version <<end>> This <<var 4>> is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
        the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        <<optional>> Lesser <<end>> <<optional>> Affero <<end>> General Public License for more
        details.""",
    "apache-notice": """
        Licensed under the Apache License, Version 2.0 <<optional>> (the "License"); you may
        not use this <<var 4>> except in compliance with the License <<end>>""",
    "gpl-notice": """
        licensed under the <<optional>> terms of the <<end>> GNU <<optional>> Lesser <<end>>
        <<optional>> Affero <<end>> General Public License <<optional>> version <<var 1>>
        <<end>>""",
    "mit-notice": """
        <<optional>> is <<end>> released under the <<optional>> terms of the <<end>>
        MIT License""",
    "cc-notice": """
        licensed under <<optional>> a <<end>> <<optional>> the <<end>> CC BY
        <<optional>> NC <<end>> <<optional>> SA <<end>> <<optional>> ND <<end>>
        <<optional>> 4.0 <<end>>""",
    "cc-long-notice": """
        licensed under <<optional>> a <<end>> <<optional>> the <<end>> Creative Commons
        Attribution <<var 4>> <<optional>> 4.0 <<end>> International License""",
}

MARK = re.compile(r"<<(optional|end|var (\d+))>>")


class Automaton:
    """Token automaton of one template.

    ``steps[s]`` maps a word to the next state, ``skips[s]`` are states reached
    without a word, ``any_[s]`` is the state reached by any word (or None).
    State 0 is the start, ``final`` the accepting state.
    """

    def __init__(self, template: str):
        self.steps, self.skips, self.any_ = [{}], [[]], [None]
        here, opened, at = 0, [], 0
        literal = []  # mandatory words in a row; the longest run is the anchor
        best: list[bytes] = []
        for m in [*MARK.finditer(template), None]:
            for word in alnum_words(template[at:m.start() if m else None].encode()):
                to = self._new()
                self.steps[here][word] = to
                here = to
                if not opened:
                    literal.append(word)
            if m is None:
                break
            best, literal = max(best, literal, key=len), []
            at = m.end()
            if m[1] == "optional":
                opened.append(here)
            elif m[1] == "end":
                to = self._new()
                self.skips[opened.pop()].append(to)
                self.skips[here].append(to)
                here = to
            else:
                run = [here]
                for _ in range(int(m[2])):
                    to = self._new()
                    self.any_[run[-1]] = to
                    run.append(to)
                to = self._new()
                for state in run:
                    self.skips[state].append(to)
                here = to
        self.anchor = b" " + b" ".join(max(best, literal, key=len)) + b" "
        self.final = here
        self.starts = {w for s in self._closed({0}) for w in self.steps[s]}

    def _new(self) -> int:
        self.steps.append({})
        self.skips.append([])
        self.any_.append(None)
        return len(self.steps) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.skips[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return seen

    def match(self, words: list[bytes], at: int) -> int | None:
        """The longest accepted run of words from ``at`` on: its end, or None."""
        states, end = self._closed({0}), None
        while states:
            if self.final in states:
                end = at
            if at == len(words):
                break
            word, to = words[at], set()
            for s in states:
                if word in self.steps[s]:
                    to.add(self.steps[s][word])
                if self.any_[s] is not None:
                    to.add(self.any_[s])
            states, at = self._closed(to), at + 1
        return end

    def search(self, words: list[bytes]):
        """Accepted runs, leftmost and longest, without overlaps."""
        at = 0
        while at < len(words):
            end = self.match(words, at) if words[at] in self.starts else None
            if end is not None and end > at:
                yield at, end
                at = end
            else:
                at += 1


def _automata() -> dict[str, Automaton]:
    store = worker_store("licenses")
    if "automata" not in store:
        store["automata"] = {label: Automaton(t) for label, t in TEMPLATES.items()}
    return store["automata"]


def find_licenses(text: bytes):
    """(number of words, [(label, first word, end word)]), base places first."""
    words = alnum_words(text)
    line = b" " + b" ".join(words) + b" "
    found = []
    if b"licens" in line or b"permission" in line or b"redistribution" in line:
        for phrase, label in PHRASES.items():
            probe = b" " + phrase.encode() + b" "
            at, first, last = line.find(probe), 0, 0
            while at >= 0:
                first += line.count(b" ", last, at)
                found.append((label, first, first + phrase.count(" ") + 1))
                last, at = at, line.find(probe, at + 1)
    for label, automaton in _automata().items():
        if automaton.anchor in line:
            found += [(label, a, b) for a, b in automaton.search(words)]
    return len(words), found


def _scan(batches):
    span = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        counts, spans = [], []
        for text in texts_of(batch.column("text")):
            n, found = find_licenses(text) if text else (0, [])
            counts.append(n)
            spans.append([{"label": k, "first": a, "end": b} for k, a, b in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()),
             pa.array(spans, pa.list_(span))], names=["doc_id", "n_words", "spans"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, spans): license wording in every whole text.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are not
    read.  Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing
    A-Z.  ``spans`` holds label, first and end (word numbers, end exclusive):
    every place of a base phrase, and the leftmost longest runs that a template
    accepts.  Null and empty texts have no words; a null doc_id and repeated
    rows are each returned as they are; an empty table gives no rows.
    """
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").cast("string").alias("text"))
            .mapInArrow(_scan, "doc_id long, n_words long, "
                               "spans array<struct<label: string, first: long, end: long>>"))


def license_digest(found: DataFrame) -> DataFrame:
    """Counts, first and last base word, labels, and a score: the share of the
    document's words from the first to the last word of its license wording."""
    base_labels = list(PHRASES.values())
    base = F.filter("spans", lambda s: s["label"].isin(base_labels))
    starts = F.transform(base, lambda s: s["first"])

    def names(spans):
        return F.array_join(F.array_sort(F.array_distinct(
            F.transform(spans, lambda s: s["label"]))), ",")

    first = F.array_min(F.transform("spans", lambda s: s["first"]))
    end = F.array_max(F.transform("spans", lambda s: s["end"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
        F.when(F.size("spans") > 0, (end - first) / F.col("n_words")).otherwise(0.0)
        .alias("score"))
