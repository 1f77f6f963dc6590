"""License scans by template markup compiled to token automata.

A template is plain wording with ``<<beginOptional>> … <<endOptional>>`` regions
(which may nest) and ``<<var;name=…;match=…;words=lo-hi>>`` regions that stand for
``lo`` to ``hi`` words that each match a pattern.  It becomes a non-deterministic
automaton over words; a text is accepted where every mandatory word stands exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txloom.llm.common import document_rows

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices in template markup, by label.
TEMPLATES = {
    "gpl-notice": "<<beginOptional>>This <<var;name=work;match=[a-z]+>> is<<endOptional>> licensed under <<beginOptional>>the terms of<<endOptional>> the GNU <<beginOptional>>Lesser<<endOptional>> General Public License<<beginOptional>>, version <<var;name=version;match=v?[0-9]+;words=1-2>><<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>",
    "apache-notice": "Licensed under the Apache License<<beginOptional>>, Version <<var;name=version;match=[0-9]+;words=1-2>><<endOptional>>",
    "cc-by-notice": "<<beginOptional>>This <<var;name=work;match=[a-z]+>> is<<endOptional>> licensed under <<beginOptional>>a<<endOptional>> CC BY<<var;name=terms;match=nc|sa|nd;words=0-2>> <<var;name=version;match=[0-9]+;words=1-2>> <<beginOptional>>International<<endOptional>> <<beginOptional>>License<<endOptional>>",
    "mit-notice": "<<var;name=verb;match=released|licensed|distributed>> under the <<beginOptional>>terms of the<<endOptional>> MIT License",
    "bsd-notice": "<<var;name=verb;match=released|licensed|distributed>> under the <<beginOptional>><<var;name=clauses;match=[0-9]>> clause<<endOptional>> BSD License",
    "mpl-notice": "subject to the terms of the Mozilla Public License<<beginOptional>>, v. <<var;name=version;match=[0-9]+;words=1-2>><<endOptional>>",
    "spdx-tag": "SPDX License Identifier <<var;name=id;match=[a-z0-9]+;words=1-6>>",
}

_BULLET = "<<var;name=bullet;match=[0-9a-z]|ii|iii;words=0-1>>"
_BSD_CONDITIONS = f"""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{_BULLET} Redistributions of source code must retain the <<beginOptional>>above<<endOptional>> copyright notice, this list of conditions and the following disclaimer.
{_BULLET} Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAME = f"""{_BULLET} <<beginOptional>>Neither<<endOptional>> the <<var;name=names;match=names?>> <<beginOptional>>of<<endOptional>> <<var;name=holder;words=1-30>> may <<beginOptional>>not<<endOptional>> be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_DISCLAIMER = """This software is provided <<var;name=giver;words=0-20>> "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.
In no event shall <<var;name=holder;words=1-20>> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."""


def _gnu_header(kind: str) -> str:
    """The standard header of a GNU license; ``kind`` stands before General."""
    version = "<<beginOptional>>either<<endOptional>> version <<var;name=version;match=v?[0-9]+;words=1-2>> <<beginOptional>>of the License<<endOptional>> <<beginOptional>>only<<endOptional>> <<beginOptional>>or (at your option) any later version<<endOptional>>"
    return f"""<<beginOptional>>This <<var;name=work;match=[a-z]+;words=1-3>><<endOptional>> is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} General Public License <<beginOptional>>{version}<<endOptional>> as published by the Free Software Foundation<<beginOptional>>; {version}<<endOptional>>.
<<var;name=work;words=1-12>> is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU {kind} General Public License for more details."""


#: Whole license texts and standard headers; copyright lines and titles stand before them.
TEMPLATES |= {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, <<var;name=sub;match=sub|license|sublicense;words=1-2>>, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and <<var;name=non;match=non|infringement|noninfringement;words=1-2>>.
In no event shall <<var;name=holder;words=1-20>> be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.""",
    "bsd-2-clause-text": f"{_BSD_CONDITIONS}\n{_BSD_DISCLAIMER}",
    "bsd-3-clause-text": f"{_BSD_CONDITIONS}\n{_BSD_NAME}\n{_BSD_DISCLAIMER}",
    "isc-text": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
The software is provided "as is" and <<var;name=holder;words=1-20>> <<var;name=verb;match=disclaims?>> all warranties with regard to this software including all implied warranties of merchantability and fitness.
In no event shall <<var;name=holder;words=1-20>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.""",
    "apache-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;name=work;match=[a-z]+;words=1-3>> except in compliance with the License.
You may obtain a copy of the License at <<var;name=scheme;match=https?>>://www.apache.org/licenses/LICENSE-2.0<<var;name=suffix;match=txt|html;words=0-1>>
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "gpl-header": _gnu_header(""),
    "lgpl-header": _gnu_header("<<var;name=kind;match=lesser|library>>"),
    "agpl-header": _gnu_header("Affero"),
    "mpl-header": """This source code form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at <<var;name=scheme;match=https?>>://<<beginOptional>>www.<<endOptional>>mozilla.org/MPL/2.0/<<beginOptional>>.<<endOptional>>""",
    "zlib-text": f"""This software is provided 'as-is', without any express or implied warranty. In no event will the <<var;name=holder;match=authors?|copyright|holders?;words=1-2>> be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
{_BULLET} The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
{_BULLET} Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
{_BULLET} This notice may not be removed or altered from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}

#: Word characters: 0-9, a-z, and all that is not ASCII; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_TAG = re.compile(r"<<(.*?)>>", re.S)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Automaton:
    """Word automaton: edges ``(test, target)`` a state, skips, and the accepting last state."""

    edges: list[list[tuple[bytes | re.Pattern, int]]] = field(default_factory=lambda: [[]])
    skips: list[list[int]] = field(default_factory=lambda: [[]])

    def state(self) -> int:
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[bytes], start: int) -> int:
        """Where the longest match from word ``start`` ends, or -1."""
        states, best, at, final = self.closure({0}), -1, start, len(self.edges) - 1
        while states:
            if final in states:
                best = at
            if at == len(words):
                break
            word = words[at]
            states = self.closure({t for s in states for test, t in self.edges[s] if (test == word if isinstance(test, bytes) else test.fullmatch(word))})
            at += 1
        return best

    def accepts(self, words: list[bytes]) -> bool:
        return self.match(words, 0) == len(words)

    def first_tests(self) -> list[bytes | re.Pattern]:
        return [test for s in self.closure({0}) for test, _ in self.edges[s]]


def compile_template(markup: str) -> Automaton:
    """The automaton of a template; raises ValueError on unbalanced or unknown markup."""
    machine, at, opened, end = Automaton(), 0, [], 0

    def plain(part: str) -> None:
        nonlocal at
        for word in words_of(part.encode()):
            nxt = machine.state()
            machine.edges[at].append((word, nxt))
            at = nxt

    for tag in _TAG.finditer(markup):
        plain(markup[end : tag.start()])
        end, (name, *fields) = tag.end(), tag[1].split(";")
        if name == "beginOptional":
            opened.append(at)
        elif name == "endOptional":
            if not opened:
                raise ValueError("endOptional without beginOptional")
            nxt = machine.state()
            machine.skips[at].append(nxt)
            machine.skips[opened.pop()].append(nxt)
            at = nxt
        elif name == "var":
            given = dict(f.split("=", 1) for f in fields)
            test = re.compile(given.get("match", r"[\x00-\xff]+").encode())
            low, _, high = given.get("words", "1-1").partition("-")
            for k in range(int(high)):
                nxt = machine.state()
                machine.edges[at].append((test, nxt))
                if k >= int(low):
                    machine.skips[at].append(nxt)
                at = nxt
        else:
            raise ValueError(f"unknown markup {name}")
    plain(markup[end:])
    if opened:
        raise ValueError("beginOptional without endOptional")
    return machine


class Scanner:
    """Base phrases and templates over one text at a time."""

    def __init__(self, templates: dict[str, str] | None = None):
        self.machines = {label: compile_template(t) for label, t in (TEMPLATES if templates is None else templates).items()}
        self.phrases = [(f" {p} ".encode(), label) for p, label in PHRASES.items()]
        # a template can only match where one of its rarer fixed words stands
        self.needed = {label: self._needed(m) for label, m in self.machines.items()}

    @staticmethod
    def _needed(machine: Automaton) -> list[bytes]:
        """Fixed words that stand in every accepted text."""
        final, out = len(machine.edges) - 1, []
        for word in {t for edges in machine.edges for t, _ in edges if isinstance(t, bytes)}:
            seen, todo = {0}, [0]
            while todo:
                s = todo.pop()
                for n in [*machine.skips[s], *(t for test, t in machine.edges[s] if test != word)]:
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
            if final not in seen:
                out.append(b" " + word + b" ")
        return sorted(out, key=len, reverse=True)  # long words are rarer

    def scan(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = words_of(text)
        joined = b" ".join([b"", *words, b""])
        places, base = [], set()
        for phrase, label in self.phrases:
            at, before, word = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", before, at)
                places.append(word)
                base.add(label)
                before, at = at, joined.find(phrase, at + 1)
        found = set()
        for label, machine in self.machines.items():
            needed = self.needed[label]
            if all(n in joined for n in needed):
                tests = machine.first_tests()
                starts = (i for i, w in enumerate(words) if any(t == w if isinstance(t, bytes) else t.fullmatch(w) for t in tests))
                if any(machine.match(words, i) >= 0 for i in starts):
                    found.add(label)
        score = 1.0 if found else 0.5 if base else 0.0
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), score


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """License findings of every document.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score``: 1 where a template accepts a passage, 0.5 where only base phrases stand,
    else 0.  Null and empty texts have no words; ids, null or repeated, are passed on.
    """
    rows = document_rows(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))
    out = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType)] + [T.StructField(n, t) for n, t in (("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            columns = list(zip(*[scanner.scan(c.as_py()) for c in batch.column(1)], strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], out.names)

    return rows.mapInArrow(run, out)
