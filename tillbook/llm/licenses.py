"""License scans by template-markup matching.

Templates are license wordings with markup: ``<<beginOptional>>`` and
``<<endOptional>>`` around words that may be absent, and ``<<var;words="a,b">>``
where ``a`` to ``b`` words of any kind may stand. A template compiles into an
automaton over words that accepts a place of a text only if all mandatory
words stand there exactly, in order, with nothing else between them.

Wordings are whole licenses or whole standard headers. Notices are single
sentences that name a license; they score less, and one that is negated just
before it ("not licensed under ...") is no notice.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license wordings with markup.
TEMPLATES = {
    "all-rights-reserved": """all rights reserved""",
    "apache-header": """
        licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
        you may obtain a copy of the license at <<var;words="0,8">> unless required by applicable law or agreed to in writing software
        distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
        see the license for the specific language governing permissions and limitations under the license""",
    "apache-notice": """
        <<beginOptional>> this <<var;words="1,3">> is <<endOptional>> licensed under the apache license <<beginOptional>> version
        <<var;words="1,2">> <<endOptional>>""",
    "bsd-text": """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<var;words="0,1">> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<var;words="0,1">> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
        disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>> <<var;words="0,1">> neither the name of
        <<var;words="1,12">> may be used to endorse or promote products derived from this software without specific prior written permission
        <<endOptional>> this software is provided by <<var;words="1,12">> as is and any express or implied warranties including but not limited to the
        implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;words="1,12">> be liable for
        any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
        services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict
        liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of
        such damage""",
    "cc-notice": """
        <<beginOptional>> this <<var;words="1,3">> is <<endOptional>> licensed under <<beginOptional>> a <<endOptional>>
        <<beginOptional>> the <<endOptional>> <<beginOptional>> creative commons <<endOptional>> cc by <<beginOptional>> nc <<endOptional>>
        <<beginOptional>> sa <<endOptional>> <<beginOptional>> nd <<endOptional>> <<beginOptional>> <<var;words="1,2">> <<endOptional>>""",
    "gpl-header": """
        this <<var;words="1,4">> is free software you can redistribute it and or modify it under the terms of the gnu general public license as published
        by the free software foundation either version <<var;words="1,2">> of the license or at your option any later version
        this <<var;words="1,4">> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu general public license for more details""",
    "gpl-notice": """
        <<beginOptional>> this <<var;words="1,3">> is <<endOptional>> licensed under the <<beginOptional>> terms of the <<endOptional>> gnu general
        public license <<beginOptional>> version <<var;words="1,2">> <<endOptional>>""",
    "isc-text": """
        permission to use copy modify and <<beginOptional>> or <<endOptional>> distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and
        <<var;words="1,12">> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall
        <<var;words="1,12">> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use
        data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
        performance of this software""",
    "lgpl-header": """
        this <<var;words="1,4">> is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as
        published by the free software foundation either version <<var;words="1,2">> of the license or at your option any later version
        this <<var;words="1,4">> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu lesser general public license for more details""",
    "mit-notice": """
        <<beginOptional>> this <<var;words="1,3">> is <<endOptional>> <<beginOptional>> released <<endOptional>> <<beginOptional>> licensed
        <<endOptional>> under the mit license""",
    "mit-text": """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to
        deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or
        sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above
        copyright notice and this permission notice <<beginOptional>> including the next paragraph <<endOptional>> shall be included in all copies or
        substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited
        to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;words="1,12">> be liable for
        any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software
        or the use or other dealings in the software""",
}

#: Labels of templates that hold no license but a sentence that names one, and of the one that grants nothing.
NOTICES = frozenset({"apache-notice", "cc-notice", "gpl-notice", "mit-notice"})
RESERVED = frozenset({"all-rights-reserved"})
#: Words that negate a notice, one or two words before it.
NEGATIONS = frozenset({b"not", b"never", b"no", b"cannot", b"neither", b"nor"})

MARKUP = re.compile(r'<<beginOptional>>|<<endOptional>>|<<var;words="\d+,\d+">>|[^\s<]+')

#: Byte table of the word rule: A-Z lower-cased; digits, a-z and bytes of other characters kept; the rest blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def scan_words(text: bytes) -> list[bytes]:
    """Words of the license rule in UTF-8 ``text``: every byte of a character
    beyond ASCII belongs to a word, so bytes can be cut as characters."""
    return text.translate(WORD_BYTES).split()


@dataclass
class Automaton:
    """Word automaton; state 0 starts, ``steps[s]`` holds the next states by
    word, ``free[s]`` those for any word, ``skips[s]`` those without a word."""

    steps: list[dict[bytes, list[int]]] = field(default_factory=lambda: [{}])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    skips: list[list[int]] = field(default_factory=lambda: [[]])
    final: int = 0

    def _state(self) -> int:
        self.steps.append({})
        self.free.append([])
        self.skips.append([])
        return len(self.steps) - 1

    @classmethod
    def compile(cls, template: str) -> Automaton:
        a, at, opened = cls(), 0, []
        for token in MARKUP.findall(template):
            if token == "<<beginOptional>>":
                opened.append(at)
                after = a._state()  # what follows can't lead back into the words before
                a.skips[at].append(after)
                at = after
            elif token == "<<endOptional>>":
                if not opened:
                    raise ValueError("endOptional without beginOptional")
                after = a._state()
                a.skips[at].append(after)
                a.skips[opened.pop()].append(after)
                at = after
            elif token.startswith("<<"):
                low, high = map(int, re.findall(r"\d+", token))
                states = [at]
                for _ in range(high):
                    states.append(a._state())
                    a.free[states[-2]].append(states[-1])
                end = a._state()
                for s in states[low:]:
                    a.skips[s].append(end)
                at = end
            else:
                after = a._state()
                a.steps[at].setdefault(token.encode(), []).append(after)
                at = after
        if opened:
            raise ValueError("beginOptional without endOptional")
        a.final = at
        return a

    def closure(self, states: Iterable[int]) -> set[int]:
        todo, found = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return found

    def starts(self) -> set[bytes]:
        """Words with which an accepted place can begin."""
        begin = self.closure([0])
        if any(self.free[s] for s in begin) or self.final in begin:
            raise ValueError("a template must begin with a mandatory word, after optional ones that do so too")
        return {w for s in begin for w in self.steps[s]}

    def accepts(self, words: list[bytes], at: int) -> bool:
        """Whether an accepted place begins at word ``at``."""
        states = self.closure([0])
        while at < len(words):
            word, new = words[at], []
            for s in states:
                new += self.steps[s].get(word, ())
                new += self.free[s]
            if not new:
                return False
            states = self.closure(new)
            if self.final in states:
                return True
            at += 1
        return False


class Scanner:
    def __init__(self, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES):
        self.phrases = [([w.encode() for w in p.split()], label) for p, label in phrases.items()]
        self.automata = {label: Automaton.compile(t) for label, t in templates.items()}
        self.by_start: dict[bytes, list[str]] = {}
        for label, a in self.automata.items():
            for w in sorted(a.starts()):
                self.by_start.setdefault(w, []).append(label)
        self.anchors = frozenset(self.by_start) | {p[0] for p, _ in self.phrases}

    def scan(self, text: bytes) -> tuple[int, list[int], set[str], set[str]]:
        """Number of words, starts of the base phrases (one entry for each
        phrase and place), base labels, template labels."""
        words = scan_words(text)
        places, base, found = [], set(), set()
        anchors = self.anchors
        for i in [i for i, w in enumerate(words) if w in anchors]:
            for phrase, label in self.phrases:
                if words[i:i + len(phrase)] == phrase:
                    places.append(i)
                    base.add(label)
            for label in self.by_start.get(words[i], ()):
                negated = label in NOTICES and not NEGATIONS.isdisjoint(words[max(0, i - 2):i])
                if label not in found and not negated and self.automata[label].accepts(words, i):
                    found.add(label)
        return len(words), places, base, found


def score(base: set[str], found: set[str]) -> float:
    """1 where the wording of a license or header is complete, 0.75 for a notice,
    0.5 where only a phrase stands, 0.25 where rights are only reserved, else 0."""
    if found - NOTICES - RESERVED:
        return 1.0
    return 0.75 if found & NOTICES else 0.5 if base else 0.25 if found else 0.0


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score. Null texts are empty; a text
    without words has no places. Each document is judged alone, so repeated
    rows get equal rows and an empty table none; no shuffle is needed."""
    schema = (f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, "
              "base_labels string, labels string, score double")
    names = [c.split()[0] for c in schema.split(", ")]
    templates, phrases = dict(templates), dict(phrases)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for b in batches:
            rows = []
            for t in b.column(1).cast(pa.binary()):
                n, places, base, found = scanner.scan(t.as_py() or b"")
                rows.append((n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                             ",".join(sorted(base | found)), score(base, found)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
