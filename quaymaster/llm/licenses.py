"""Licence scans by template-markup matching (operator 4).

A template is wording with marked regions: `[[ ... ]]` may be absent, `{n}` may be replaced by up to n words of any kind (a name, a year,
a version), `((one wording/another wording))` by one of the wordings given, `a|b` by one of several words; `$` is the end of the text. Templates are compiled to token automata; a text is accepted
where an automaton accepts, that is where all mandatory words stand exactly as in the template, in their order, with nothing between
them but what the regions allow. Templates of whole licences go to the end of their conditions and disclaimers.

Besides, four base phrases are counted wherever their words stand consecutively.

Cases: null text is empty: no words, no labels, score 0; texts are matched whole, however long; repeated rows alike; an empty table
gives an empty result; other columns are ignored. Score: 1 where a template accepts, else 0.5 where a base phrase stands, else 0.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import common as C

#: Base phrases and their labels (fixed values).
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wording that several licences share.
_MIT = """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
    [[the]] {1} to deal in the software without restriction including without limitation the rights to use copy modify merge publish
    distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject
    to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be
    included in all copies or substantial portions of the software"""
_MIT_DISCLAIMER = """the software is provided as is without warranty of any kind express or implied including but not limited to the warranties
    of merchantability fitness for a particular purpose and [[non]] noninfringement|infringement in no event shall {12} be liable for any
    claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
    software or the use or other dealings in the software"""
_ISC_DISCLAIMER = """the software is provided as is and {8} disclaims|disclaim all warranties with regard to this software including all
    implied warranties of merchantability and fitness in no event shall {12} be liable for any special direct indirect or consequential
    damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other
    tortious action arising out of or in connection with the use or performance of this software"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following
    conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the
    following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the
    following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_DISCLAIMER = """this software is provided by {12} as is and any express or implied warranties including but not limited to the implied
    warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any direct
    indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or
    services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract
    strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
    possibility of such damage"""

_GNU = """this|the program|file|library|software is free software you can redistribute it and or modify it under the terms of the gnu {} public license
    as published by the free software foundation [[either]]"""
_GNU_END = """this|the program|file|library|software is distributed in the hope that it will be useful but without any warranty without even the implied
    warranty of merchantability or fitness for a particular purpose see the gnu {} public license for more details"""

#: Templates: label and wording (fixed values: the licences' public wording, and the usual short notices).
TEMPLATES = [
    ("mit", f"{_MIT} {_MIT_DISCLAIMER}"),
    ("mit", f"{_MIT} $"),  # as a notice, with nothing after it that could change it
    ("mit", "[[is]] [[are]] released under the [[terms of the]] mit license"),
    ("mit", "licensed under the [[terms of the]] mit license"),
    ("mit", "spdx license identifier mit"),
    ("isc", f"""permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies {_ISC_DISCLAIMER}"""),
    ("0bsd", f"""permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        {_ISC_DISCLAIMER}"""),
    ("bsd-2-clause", f"{_BSD} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"""{_BSD} [[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission {_BSD_DISCLAIMER}"""),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
        damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
        commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this
        software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product
        an acknowledgment|acknowledgement in the product documentation would be appreciated but is not required [[2]] altered source
        versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not
        be removed or altered from any source distribution"""),
    ("unlicense", f"""this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
        compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
        commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any
        and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large
        and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of
        all present and future rights to this software under copyright law {_MIT_DISCLAIMER}"""),
    ("apache-2.0", """licensed under the apache license version 2 0 [[the license]] you may not use this file|software|work except in compliance with the
        license you may obtain a copy of the license at [[https]] [[http]] [[www]] apache org licenses license 2 0 [[html]] [[txt]] unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties
        or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations
        under the license"""),
    ("gpl-2.0", f"""{_GNU.format("general")} version 2 of the license [[or at your option any later version]] {_GNU_END.format("general")}"""),
    ("gpl-3.0", f"""{_GNU.format("general")} version 3 of the license [[or at your option any later version]] {_GNU_END.format("general")}"""),
    ("agpl-3.0", f"""{_GNU.format("affero general")} version 3 of the license [[or at your option any later version]] {_GNU_END.format("affero general")}"""),
    ("lgpl", f"""{_GNU.format("lesser general")} version {{1}} [[1]] of the license [[or at your option any later version]] {_GNU_END.format("lesser general")}"""),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
        file you can obtain one at [[https]] [[http]] [[www]] mozilla org mpl 2 0"""),
    ("bsl-1.0", f"""permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to
        prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the
        following the copyright notices in the software and this entire statement including the above license grant this restriction and the
        following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software
        unless such copies or derivative works are solely in the form of machine executable object code generated by a source language
        processor the software is provided as is without warranty of any kind express or implied including but not limited to the warranties
        of merchantability fitness for a particular purpose title and ((non infringement/noninfringement)) in no event shall the copyright holders or anyone
        distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of
        or in connection with the software or the use or other dealings in the software"""),
    ("wtfpl", """everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as
        the name is changed do what the fuck you want to public license terms and conditions for copying distribution and modification 0 you just
        do what the fuck you want to"""),
    ("apache-2.0", "licensed under the [[terms of the]] apache license [[version]] [[v2]] [[v]] 2 [[0]]"),
    ("apache-2.0", "released under the [[terms of the]] apache license [[version]] 2 [[0]]"),
    ("apache-2.0", "spdx license identifier apache 2 0"),
    ("gpl-2.0", "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("gpl-3.0", "under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("lgpl", "under the [[terms of the]] gnu lesser general public license [[as published by the free software foundation]] [[either]] version {1}"),
    ("agpl-3.0", "under the [[terms of the]] gnu affero general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] cc by 4 0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] cc by sa 4 0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] cc by nc 4 0"),
    ("cc-by-nd-4.0", "licensed under [[a]] [[the]] cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "licensed under [[a]] [[the]] cc by nc sa 4 0"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] creative commons attribution 4 0 international"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] creative commons attribution sharealike 4 0 international"),
    ("cc0-1.0", "creative commons cc0 1 0 universal"),
]

#: Bytes that are no part of a word become spaces, A-Z lose their case; bytes above 127 are parts of words.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def normal(text: str | None) -> bytes:
    """The text's words in lower case, one space around each."""
    w = text.encode().translate(_TABLE).split() if text else []
    return b" " + b" ".join(w) + b" " if w else b""


class Automaton:
    """A template as a non-deterministic automaton over words. States 0, 1, ... `end`; `step` has for each state the word that it
    reads (None: any word; a set: one of these; _LAST: the end of the text) and the next state; `free` has moves that read nothing."""

    _LAST = b" "  # no word has a space

    def __init__(self, wording: str):
        tokens = re.findall(r"\[\[|\]\]|\(\(|\)\)|/|\{\d+\}|[^\s\[\]{}()/]+", wording)
        self.step: dict[int, tuple[bytes | frozenset | None, int]] = {}
        self.free: dict[int, list[int]] = {}
        state, opened, forks = 0, [], []

        def move(a: int, b: int) -> None:
            self.free.setdefault(a, []).append(b)

        for t in tokens:
            if t == "[[":
                opened.append(state)
                move(state, state + 1)
                state += 1
            elif t == "]]":
                move(opened.pop(), state + 1)
                move(state, state + 1)
                state += 1
            elif t == "((":
                forks.append((state, []))
                move(state, state + 1)
                state += 1
            elif t == "/":  # another wording begins where the region does
                forks[-1][1].append(state)
                state += 1
                move(forks[-1][0], state)
            elif t == "))":
                for end in forks.pop()[1]:
                    move(end, state + 1)
                move(state, state + 1)
                state += 1
            elif t[0] == "{":
                n = int(t[1:-1])
                for k in range(n):
                    self.step[state + k] = (None, state + k + 1)
                    move(state + k, state + n)
                state += n
            else:
                self.step[state] = (self._LAST if t == "$" else frozenset(t.encode().split(b"|")) if "|" in t else t.encode(), state + 1)
                state += 1
        if opened or forks:
            raise ValueError("a region is not closed")
        self.end = state
        # where an attempt begins: the run of mandatory words that comes first
        depth, lead = 0, []
        for t in tokens:
            if t in ("[[", "]]", "((", "))"):
                if lead and t in ("[[", "(("):
                    break
                depth += 1 if t in ("[[", "((") else -1
            elif not depth and (t[0] == "{" or t == "$" or "|" in t):
                if lead:
                    break
            elif not depth:
                lead.append(t)
        self.lead = f" {' '.join(lead)} ".encode()
        at = next(s for s in range(state) if self.step.get(s, (None,))[0] == lead[0].encode() and self._plain_from(s, lead))
        #: words of choice before the first mandatory ones; what else stands before them changes nothing
        self.start, self.back = (0, at) if all(isinstance(self.step.get(k, (None,))[0], frozenset) for k in range(at)) else (at, 0)

    def _plain_from(self, s: int, lead: list[str]) -> bool:
        for w in lead:
            if self.step.get(s, (None, 0))[0] != w.encode():
                return False
            s = self.step[s][1]
        return True

    def _closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for s in self.free.get(todo.pop(), ()):
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def accepts(self, words: list[bytes], at: int) -> bool:
        """Whether the template stands at words[at:], where its first mandatory words are. Optional regions before those change nothing."""
        now = self._closure({self.start})
        at -= self.back
        if at < 0:
            return False
        while self.end not in now:
            if at > len(words) or not now:
                return False
            w = words[at] if at < len(words) else self._LAST
            now = self._closure({t for s in now if s in self.step for x, t in [self.step[s]] if x == w or (w != self._LAST if x is None else isinstance(x, frozenset) and w in x)})
            at += 1
        return True


def places(body: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase (one space around it) stands in a normal text."""
    out, at, seen, word = [], body.find(phrase), 0, 0
    while at >= 0:
        word += body.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = body.find(phrase, at + 1)
    return out


def scan(text: str | None, automata: list[tuple[str, Automaton]]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    body = normal(text)
    if not body:
        return 0, 0, None, None, "", "", 0.0
    at, base = [], set()
    for phrase, label in PHRASES.items():
        if found := places(body, f" {phrase} ".encode()):
            at += found
            base.add(label)
    own, words = set(), None
    for label, a in automata:
        if label not in own and (found := places(body, a.lead)):
            words = words or body.split()
            if any(a.accepts(words, k) for k in found):
                own.add(label)
    score = 1.0 if own else 0.5 if base else 0.0
    return body.count(b" ") - 1, len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), score


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    templates = TEMPLATES if templates is None else templates
    more = {"n_words": C.LONG, "n_base": C.LONG, "first_word": C.LONG, "last_word": C.LONG, "base_labels": C.STR, "labels": C.STR, "score": C.DOUBLE}
    schema = C.schema_of(docs, "doc_id", **more)

    def run(batches):
        import pyarrow as pa

        automata = [(label, Automaton(w)) for label, w in templates]
        kinds = [pa.string() if t == C.STR else pa.float64() if t == C.DOUBLE else pa.int64() for t in more.values()]
        for batch in batches:
            for part in C.slices(batch):
                rows = [scan(t, automata) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(schema.fields))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(C.documents(spark, sf_dir))


QUERIES = {"op4_license_scan": op4_licenses}
SQL: dict[str, str] = {}
