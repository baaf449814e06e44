"""License scans against a brute-force version and the markup's rules."""

import re

import pytest

from tillbook.llm import licenses as lc
from tillbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in lc.PHRASES.items():
        p = phrase.split()
        here = [i for i in range(len(w)) if w[i:i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def template_regex(template):
    out = ""
    for t in lc.MARKUP.findall(template):
        if t == "<<beginOptional>>":
            out += "(?:"
        elif t == "<<endOptional>>":
            out += ")?"
        elif t.startswith("<<"):
            out += "(?:[^ ]+ ){%s}" % ",".join(re.findall(r"\d+", t))
        else:
            out += t + " "
    return re.compile("(?<![^ ])" + out)


def stands(label, regex, line):
    """Whether the template matches at some word; a notice not just after a negation."""
    if not label.endswith("-notice"):
        return regex.search(line) is not None
    return any(regex.match(line, m.start()) and not re.search(r"(?<![^ ])(not|never|no|cannot|neither|nor) ([^ ]+ )?$", line[:m.start()])
               for m in re.finditer(r"[^ ]+", line) if line.startswith(("this ", "licensed ", "released ", "under "), m.start()))


def check(rows, docs):
    regex = {k: template_regex(v) for k, v in lc.TEMPLATES.items()}
    want = []
    for d in docs:
        text = d["text"] or ""
        b = brute(text)
        line = " ".join(w.decode() for w in lc.scan_words(text.encode())) + " "
        found = {k for k, r in regex.items() if stands(k, r, line)}
        base = set(filter(None, b[4].split(",")))
        want.append((d["doc_id"], *b, ",".join(sorted(base | found)), lc.score(base, found)))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)


def test_query_is_brute_force(spark):
    df = QUERIES["op5_license_scans"](spark, SF)
    assert df.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    check(df.collect(), spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())


def test_hard_rows(make_docs):
    mit = re.sub(r"<<\w+>>", "", lc.TEMPLATES["mit-text"]).replace("including the next paragraph", "")
    rows = [(1, None), (2, ""), (3, "CC-BY cc by-nc 4.0; CC  BY"), (4, "Released\nunder THE MIT License."), (4, "Released\nunder THE MIT License."), (None, "apache license"),
            (5, mit.upper()), (6, mit.replace("merge", "marge")), (7, "é" * 10 + " Éa ß"), (8, "x " * 50_000 + "MIT license"), (9, "a\x00b\x7fc{d"),
            (10, "This big work here is licensed under the GNU General Public License, version 3."), (11, "licensed under the Apache License, Version 2.0"), (12, "mit mit license license"),
            (13, "this is not licensed under the MIT license"), (14, "All rights reserved. No license is granted."),
            (15, "It is never licensed under the Apache License. Licensed under the Apache License"), (16, "not released under the mit license")]
    docs = make_docs(rows)
    got = lc.scan_licenses(docs).collect()
    check(got, docs.collect())
    by = {r.doc_id: r for r in got}
    assert "mit-text" in by[5].labels and by[6].labels == "" and by[4].labels == "mit,mit-notice" and by[10].labels == "gpl,gpl-notice"
    assert (by[13].labels, by[13].score) == ("mit", 0.5) and (by[14].labels, by[14].score) == ("all-rights-reserved", 0.25)
    assert (by[15].labels, by[15].score) == ("apache,apache-notice", 0.75) and by[16].labels == "mit" and by[5].score == 1.0 and by[4].score == 0.75
    assert lc.scan_licenses(docs.limit(0)).collect() == []


def test_markup():
    a = lc.Automaton.compile('by <<beginOptional>> the <<beginOptional>> old <<endOptional>> house of <<endOptional>> <<var;words="1,2">> end')
    ok = ["by x end", "by x y end", "by the house of x end", "by the old house of x y end", "by the end", "by end end"]
    no = ["by end", "by x y z end", "by old house of x end", "by the old x y end", "by"]
    assert [a.accepts(s.encode().split(), 0) for s in ok + no] == [True] * len(ok) + [False] * len(no)
    for bad in ("a <<beginOptional>> b", "a <<endOptional>>"):
        with pytest.raises(ValueError):
            lc.Automaton.compile(bad)
    with pytest.raises(ValueError):
        lc.Automaton.compile('<<var;words="0,2">> a').starts()


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.

See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
LGPL = GPL.replace("GNU General", "GNU Lesser General").replace("program", "library")


@pytest.mark.parametrize("label, text", [("apache-header", APACHE), ("gpl-header", GPL), ("lgpl-header", LGPL)])
def test_headers_are_whole(label, text):
    def found(t):
        n, places, base, labels = lc.Scanner().scan(t.encode())
        return labels & {label}, lc.score(base, labels)

    assert found(f"# {text}\nimport x") == ({label}, 1.0)
    first, last = text.rsplit("\n\n", 1)
    assert found(first)[0] == set() and found(f"{first}\n\nCommercial use is forbidden.")[0] == set()
    assert found(f"{first}\n\nCommercial use is forbidden.")[1] < 1.0
    assert found(f"{first}\n\nCommercial use is forbidden. {last}")[0] == set()


@pytest.mark.parametrize("label, text", [("mit-text", MIT), ("isc-text", ISC), ("bsd-text", BSD)])
def test_whole_wording_is_mandatory(label, text):
    found = lambda t: lc.Scanner().scan(t.encode())[3]
    assert found(f"Copyright 2024 x\n\n{text}\nmore") == {label}
    first, last = text.rsplit("\n\n", 1)
    words = last.split()
    assert found(first) == set()  # no disclaimer
    assert found(f"{first}\n\nThe Software shall be used for Good, not Evil.\n\n{last}") == set()
    assert found(" ".join([first, *words[:-1]])) == set()  # the last word is missing
    for k in (len(words) // 3, len(words) - 2):
        assert found(" ".join([first, *words[:k], "changed", *words[k + 1:]])) == set()


def test_two_clause_bsd():
    two = re.sub("3\\. Neither.*?permission\\.", "", BSD, flags=re.S)
    assert lc.Scanner().scan(two.encode())[3] == {"bsd-text"}
