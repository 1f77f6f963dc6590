import re

import pytest

from txloom.llm import licenses

TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.",
    "gnu general-public; LICENSE gnu general public license",
    "Licensed under CC BY-NC 4.0. Released under the MIT License.",
    "Licensed under the Apache License, Version 2.0.",
    "Apache license cc by by cc by mit licenses MIT license",
    "mit licenseé émit license", "", None, "SPDX-License-Identifier: BSD-3-Clause",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force(spark, messy):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").union(messy.select("doc_id", "text"))
    want = sorted(((r.doc_id, *brute(r.text)) for r in frame.collect()), key=str)
    got = licenses.scan(frame).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=str) == want
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert licenses.scan(frame.limit(0)).count() == 0


def test_notices_are_labelled():
    scan = lambda t: licenses.Scanner().scan(t.encode())[5:]
    assert scan(TEXTS[0]) == ("gpl,gpl-notice", 1.0)
    assert scan(TEXTS[2]) == ("cc-by,cc-by-notice,mit,mit-notice", 1.0)
    assert scan(TEXTS[3]) == ("apache,apache-notice", 1.0)
    assert scan(TEXTS[8]) == ("spdx-tag", 1.0)
    assert scan("the mit license") == ("mit", 0.5) and scan("nothing") == ("", 0.0)


MARKUP = "Permission <<beginOptional>>is <<beginOptional>>hereby<<endOptional>><<endOptional>> granted to <<var;name=who;match=[a-z]+;words=1-3>> free of charge"


@pytest.mark.parametrize("text, accepted", [
    ("Permission is hereby granted to any person free of charge", True),
    ("permission granted, to ALL: free of charge!", True),
    ("permission hereby granted to all free of charge", False),  # the inner region needs the outer one
    ("permission granted to free of charge", False),
    ("permission granted to a b c d free of charge", False),
    ("permission granted to any free of charges", False),
    ("permission granted to any free of charge now", False),
])
def test_template_markup(text, accepted):
    assert licenses.compile_template(MARKUP).accepts(licenses.words_of(text.encode())) is accepted


@pytest.mark.parametrize("markup", ["<<beginOptional>>x", "x<<endOptional>>", "<<other>>"])
def test_broken_markup(markup):
    with pytest.raises(ValueError):
        licenses.compile_template(markup)


def test_many_places_of_several_phrases():
    text = "cc by cc by MIT License. cc by\n\n" * 300 + "Apache License" * 2 + " apache license"
    assert licenses.Scanner().scan(text.encode())[:5] == brute(text)


FULL = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

* Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
OWNER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT
LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause-text": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.
3. Neither the name of the University nor the names of its contributors
may be used to endorse or promote products derived from this software
without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.  IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "apache-header": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.""",
    "gpl-header": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see""",
    "lgpl-header": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.""",
}


FULL |= {
    "agpl-header": FULL["gpl-header"].replace("GNU General", "GNU Affero General"),
    "mpl-header": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.""",
}


def pattern(markup):
    """A template as one regular expression over words that are each followed by a space."""
    out = []
    for tag, plain in re.findall(r"<<(.*?)>>|((?:(?!<<).)+)", markup, re.S):
        if plain:
            out += [re.escape(w) + " " for w in re.findall(r"[a-z0-9]+", plain.lower())]
        elif tag == "beginOptional":
            out.append("(?:")
        elif tag == "endOptional":
            out.append(")?")
        else:
            given = dict(x.split("=", 1) for x in tag.split(";")[1:])
            low, high = given.get("words", "1-1").split("-")
            out.append(f"(?:(?:{given.get('match', '[^ ]+')}) ){{{low},{high}}}")
    return re.compile("(?:^| )" + "".join(out))


def test_labels_match_regular_expressions():
    """Whole texts, notices and changed ones: a label stands exactly where its markup's expression matches."""
    import random

    r, scanner = random.Random(4), licenses.Scanner()
    patterns = {k: pattern(v) for k, v in licenses.TEMPLATES.items()}
    seen = set()
    for _ in range(300):
        words = " lorem ".join(r.sample([*FULL.values(), *filter(None, TEXTS)], r.randint(1, 3))).split()
        for _ in range(r.choice((0, 0, 1, 2))):
            at = r.randrange(len(words))
            words[at : at + r.randint(0, 2)] = r.choice([[], ["copyright"], ["2"], ["GNU", "Lesser"]])
        text = " ".join(words)
        flat = "".join(w + " " for w in re.findall(r"[a-z0-9]+|[^\x00-\x7f]+", text.lower().replace("é", "")))
        want = {k for k, p in patterns.items() if p.search(" " + flat)}
        assert set(filter(None, scanner.scan(text.replace("é", "").encode())[5].split(","))) - set(licenses.PHRASES.values()) == want, text
        seen |= want
    assert seen >= set(FULL) | {"gpl-notice", "mit-notice", "apache-notice", "spdx-tag"}


@pytest.mark.parametrize("label", FULL)
def test_whole_texts_and_headers_are_labelled(label):
    scan = lambda t: set(licenses.Scanner().scan(t.encode())[5].split(",")) & set(FULL)
    text = FULL[label]
    for shown in (text, f"A title\n\nCopyright (c) 2019 Somebody\n\n{text}\n\nmore", "".join(f" * {line}\n" for line in text.splitlines()), "".join(f"# {line.upper()}\n" for line in text.splitlines())):
        assert scan(shown) == {label}
        assert licenses.Scanner().scan(shown.encode())[6] == 1.0
    words = text.split()
    assert not scan(" ".join(words[: len(words) // 2])) and not scan(" ".join(["warranties" if w.lower() in ("any", "of") else w for w in words]))


def test_replaceable_regions_of_whole_texts():
    scan = lambda t: licenses.Scanner().scan(t.encode())[5]
    assert scan(FULL["mit-text"].replace("AUTHORS OR COPYRIGHT HOLDERS", "EXAMPLE CONSORTIUM").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")) == "mit-text"
    assert scan(FULL["bsd-3-clause-text"].replace("REGENTS", "OWNERS").replace("3. ", "* ")) == "bsd-3-clause-text"
    assert "gpl-header" in scan(FULL["gpl-header"].replace("either version 3", "version 2").replace("This program is distributed", "Foo Bar is distributed"))
    assert "lgpl-header" in scan(FULL["lgpl-header"].replace("Lesser", "Library").replace("LESSER", "LIBRARY"))
