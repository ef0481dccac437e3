"""Operator 10: license scans by template-markup matching.

Method.  A template is text with optional regions ``[[ ... ]]`` and replaceable regions ``<<k>>`` (up to k words of any
wording) or ``<<k:a|b>>`` (one of the given wordings, or up to k other words if k > 0).  ``[[a|b]]`` is one of several or none, and regions
may stand in optional ones.  Each template is compiled into an automaton over word hashes.  A text is accepted from a word on if the
automaton's mandatory wording matches exactly; the longest text that is accepted counts, so regions at its end belong to it.  Where a run
can begin is found with NumPy, for all texts of a block at once: at a stretch of mandatory words, the regions before it being matched
backwards from there.

Names after `spdx license identifier` may be a list, joined by and, or, with: all its labels count, up to the first name that is not known.

Base: places where the words of a phrase stand one after the other (``PHRASES``); they are counted whole.

score: the share of the text's words that base phrases and accepted templates cover.  An accepted text that lies within a longer one of another template gives no label
(the name of one license may begin that of another); base labels always stay.

Edge cases.  Null or empty text, or one without words: counts 0, first_word and last_word null, no labels, score 0.  Very long
texts are scanned whole, and a run's states are bounded by its template.  Repeated rows give repeated results; an empty table
an empty one.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treekin.llm.wordhash import ALNUM, text_groups, words_of
from treekin.shared import table

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
_VERSION = "[[[[version|v]] <<0:1|1 0|2|2 0|2 1|3|3 0|v1|v1 0|v2|v2 0|v2 1|v3|v3 0>> [[of the license]] [[only|or later|or any later version|or at your option any later version]]]]"
_GNU_TAIL = (
    "[[this <<1>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
    "see the gnu {name} for more details]] [[you should have received a copy of the gnu {name} along with this <<1>> [[if not see [[http|https]] [[www]] [[gnu org licenses]]]]]]"
)
_GNU = [
    "[[released|licensed|distributed|available]] under the [[terms of the]] [[gnu]] {name} " + _VERSION,
    "<<1>> is free software you can redistribute it and or modify it under the terms [[and conditions]] of [[version <<0:1|2|2 0|2 1|3|3 0>> of]] the gnu {name} " + _VERSION + " as published by the free software foundation [[either]] " + _VERSION + " " + _GNU_TAIL,
]
_NO_WARRANTY = (
    "[[this software is provided by the <<8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
    "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way "
    "out of the use of this software even if advised of the possibility of such damage]]"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "[[1|a]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "[[2|b]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
)
_CC = "[[creative commons]] <<0:{name}>> [[license]] [[version]] [[<<0:1 0|2 0|2 5|3 0|4 0>>]] [[international|unported]] [[license]]"
_NUMBER = "[[[[version|v]] <<0:1 0|1 1|2 0|v1 0|v1 1|v2 0>>]]"
#: Fixed wordings: license texts, their notices and names.
TEMPLATES = {
    "0bsd": ["permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted the software is provided as is"],
    "agpl": [x.format(name="affero general public license") for x in _GNU] + ["gnu affero general public license " + _VERSION],
    "artistic": ["[[released|licensed|distributed]] under the [[terms of the]] artistic license " + _NUMBER],
    "apache": [
        "[[released|licensed]] under the apache license [[[[version]] <<0:1 0|1 1|2 0|v2|v2 0>>]] [[the license]] "
        "[[you may not use this file except in compliance with the license [[you may obtain a copy of the license at <<12>>]] unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind either express or implied [[see the license for the specific language governing permissions and limitations under the license]]]]",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at <<12>> unless required by applicable law or agreed to in writing software distributed under the license "
        "is distributed on an as is basis without warranties or conditions of any kind either express or implied [[see the license for the specific language governing permissions and limitations under the license]]",
    ],
    "boost": [
        "[[distributed]] under the boost software license [[version 1 0]]",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute "
        "execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    ],
    "bsd": [
        _BSD + "[[[[3|c]] all advertising materials mentioning features or use of this software must display the following [[acknowledgement|acknowledgment]] this product includes software developed by <<12>>]] "
        "[[[[3|4|c|d]] neither the name of <<12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]] "
        + _NO_WARRANTY,
        "[[released|licensed]] under the [[<<0:0|2|3|4|two|three|new|simplified|modified|revised>>]] [[clause]] bsd license",
    ],
    "cc-by": ["licensed under [[a|the]] " + _CC.format(name="cc by|attribution")],
    "cc-by-nc": ["licensed under [[a|the]] " + _CC.format(name="cc by nc|cc by nc sa|cc by nc nd|attribution noncommercial|attribution non commercial|attribution noncommercial sharealike|attribution noncommercial noderivatives")],
    "cc-by-sa": ["licensed under [[a|the]] " + _CC.format(name="cc by sa|attribution sharealike|attribution share alike")],
    "cc0": ["cc0 1 0 universal [[public domain dedication]]", "creative commons zero [[v1 0 universal|1 0 universal]] [[public domain dedication]]", "dedicated to the public domain under cc0 [[1 0]]"],
    "epl": [
        "[[released|licensed]] under the [[terms of the]] eclipse public license " + _NUMBER,
        "this program and the accompanying materials are made available under the terms of the eclipse public license " + _NUMBER + " [[which accompanies this distribution [[and is available at <<8>>]]]]",
    ],
    "gpl": [x.format(name="general public license") for x in _GNU],
    "isc": [
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "[[the software is provided as is and <<4>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<4>> be liable for any special direct "
        "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use "
        "or performance of this software]]",
        "[[released|licensed]] under the isc license",
    ],
    "lgpl": [x.format(name=f"{kind} general public license") for kind in ("lesser", "library") for x in _GNU] + ["gnu <<0:lesser|library>> general public license " + _VERSION],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
        "[[the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and <<0:noninfringement|non infringement>> "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software]]",
        "[[released|licensed]] under the [[terms of the]] mit license",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license [[v|version]] [[<<0:1 1|2 0|v2 0>>]] [[if a copy of the mpl was not distributed with this file you can obtain one at <<6>>]]",
        "[[released|licensed]] under the mozilla public license [[v|version]] [[<<0:1 1|2 0|v2 0>>]]",
    ],
    "ofl": ["[[this font software is]] licensed under the sil open font license " + _NUMBER],
    "postgresql": [
        "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this "
        "paragraph and the following two paragraphs appear in all copies",
        "[[released|licensed]] under the postgresql license",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain [[anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means]]",
    ],
    "wtfpl": [
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed "
        "[[do what the fuck you want to public license terms and conditions for copying distribution and modification [[0]] you just do what the fuck you want to]]",
        "[[released|licensed]] under the wtfpl",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[[[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be "
        "appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered "
        "from any source distribution]]",
    ],
}
#: Names in a file's head, by label: `spdx license identifier` and one of these.
SPDX = {
    "0bsd": "0bsd", "agpl": "agpl 3 0", "apache": "apache 2 0", "boost": "bsl 1 0", "artistic": "artistic <<0:1 0|2 0>>", "bsd": "bsd <<0:2|3|4>> clause", "cc-by": "cc by <<0:3 0|4 0>>", "cc-by-nc": "cc by nc <<0:3 0|4 0>>", "cc-by-sa": "cc by sa <<0:3 0|4 0>>",
    "cc0": "cc0 1 0", "epl": "epl <<0:1 0|2 0>>", "gpl": "gpl <<0:2 0|3 0>>", "isc": "isc", "lgpl": "lgpl <<0:2 0|2 1|3 0>>", "mit": "mit", "mpl": "mpl 2 0", "ofl": "ofl 1 1", "postgresql": "postgresql",
    "unlicense": "unlicense", "wtfpl": "wtfpl", "zlib": "zlib",
}
#: Exceptions that may follow `with` in a list of names.
EXCEPTIONS = ("classpath exception 2 0", "linux syscall note", "llvm exception", "gcc exception <<0:2 0|3 1>>", "autoconf exception <<0:2 0|3 0>>", "bison exception 2 2", "font exception 2 0")
_HEAD = "spdx license identifier"
for _label, _name in SPDX.items():
    TEMPLATES[_label] = [*TEMPLATES[_label], f"{_HEAD} {_name} [[only|or later]]"]


def _hashes(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return words_of(raw, np.array([0, len(raw)]), ALNUM, lower=True).hashes.tolist() if len(raw) else []


_MARKUP = re.compile(r"\[\[|\]\]|\||<<[^>]*>>|[^\s\[\]|<>]+")


class Automaton:
    """A nondeterministic automaton over word hashes.

    step[state]: {hash: next states}; any_[state]: next states on any word; eps[state]: states entered without a word.
    """

    def __init__(self, template: str):
        self.step: list[dict[int, set[int]]] = [{}]
        self.any_: list[set[int]] = [set()]
        self.eps: list[set[int]] = [set()]
        #: Stretches of mandatory words: the state before each, its words, and the most words that may stand before it.
        stretches: list[tuple[int, list[int], int]] = []
        self.final, _ = self._sequence(0, _MARKUP.findall(template)[::-1], stretches)
        if not stretches:
            raise ValueError(f"a template needs a mandatory word: {template}")
        long = [x for x in stretches if len(x[1]) >= 3]
        self.anchor_state, words, self.before = long[0] if long else max(stretches, key=lambda x: len(x[1]))
        #: Mandatory words in a row: every accepted text holds them, so runs are looked for there.
        self.anchor = words[:6]

    def _new(self) -> int:
        for x, kind in ((self.step, dict), (self.any_, set), (self.eps, set)):
            x.append(kind())
        return len(self.step) - 1

    def _line(self, at: int, words: list[int]) -> int:
        for h in words:
            to = self._new()
            self.step[at].setdefault(h, set()).add(to)
            at = to
        return at

    def _sequence(self, at: int, todo: list[str], stretches: list | None = None) -> tuple[int, int]:
        """Compiles items, the next one last in todo, up to the end of a region or of one of its choices.  The state there, and the most words
        on the way."""
        most, row = 0, None
        while todo and todo[-1] not in ("]]", "|"):
            item = todo.pop()
            if item == "[[":
                row = None
                end, longest = self._new(), 0
                self.eps[at].add(end)
                while True:
                    last, n = self._sequence(at, todo)
                    self.eps[last].add(end)
                    longest = max(longest, n)
                    if todo.pop() == "]]":
                        break
                at, most = end, most + longest
            elif item.startswith("<<"):
                row = None
                k, _, words = item[2:-2].partition(":")
                options = [_hashes(x) for x in words.split("|")] if words else []
                at = self._choice(at, options, not words, int(k))
                most += max([int(k), *map(len, options)])
            else:
                for h in _hashes(item):
                    if row is None:
                        row = []
                        if stretches is not None:
                            stretches.append((at, row, most))
                    row.append(h)
                    at, most = self._line(at, [h]), most + 1
        return at, most

    def _choice(self, at: int, options: list[list[int]], skip: bool, free: int) -> int:
        end = self._new()
        if skip:
            self.eps[at].add(end)
        for option in options:
            self.eps[self._line(at, option)].add(end)
        here = at
        for _ in range(free):
            to = self._new()
            self.any_[here].add(to)
            self.eps[to].add(end)
            here = to
        return end

    def _close(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for x in self.eps[todo.pop()]:
                if x not in out:
                    out.add(x)
                    todo.append(x)
        return out

    def _read(self, now: set[int], word: int) -> set[int]:
        new: set[int] = set()
        for s in now:
            new |= self.step[s].get(word, set()) | self.any_[s]
        return self._close(new)

    def run(self, words: np.ndarray, at: int, stop: int, start: int = 0) -> int:
        """The end of the longest text from `at` on that is accepted, or -1."""
        now, found = self._close({start}), -1
        while now:
            if self.final in now:
                found = at
            if at >= stop:
                break
            now, at = self._read(now, int(words[at])), at + 1
        return found

    def begin(self, words: np.ndarray, at: int, first: int) -> int:
        """The first word from which on what comes before the anchor at `at` matches, or -1."""
        for k in range(max(first, at - self.before), at + 1):
            now = self._close({0})
            for word in words[k:at].tolist():
                now = self._read(now, word)
            if self.anchor_state in now:
                return k
        return -1


def outermost(found: list[tuple[int, int, str, bool]]) -> list[tuple[int, int, str, bool]]:
    """Without the texts that lie within a longer one: the name of one license may begin the name of another."""
    out, reach, last = [], -1, None
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if x[1] > reach or (x[0], x[1]) == last:
            out.append(x)
            reach, last = x[1], (x[0], x[1])
    return out


@functools.lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, t in templates]


def _all_templates(templates: dict[str, list[str]]) -> tuple[tuple[str, str], ...]:
    return tuple((label, t) for label, ts in sorted(templates.items()) for t in ts)


def _places(hashes: np.ndarray, text_of: np.ndarray, words: list[int]) -> np.ndarray:
    """Where the words stand one after the other within one text."""
    n = len(words)
    if len(hashes) < n:
        return np.zeros(0, np.int64)
    last = len(hashes) - n + 1
    at = np.flatnonzero(hashes[:last] == np.uint64(words[0]))
    for j in range(1, n):
        at = at[hashes[at + j] == np.uint64(words[j])]
    return at[text_of[at] == text_of[at + n - 1]]


class Names:
    """Lists of names after `spdx license identifier`, joined by and, or, with: a list of any length, up to a name that is not known."""

    def __init__(self, names: tuple[tuple[str, str], ...]):
        self.head = _hashes(_HEAD)
        self.names = compiled(tuple((label, f"{name} [[only|or later]]") for label, name in names))
        self.exceptions = compiled(tuple(("", name) for name in EXCEPTIONS))
        self.joint = {_hashes(x)[0]: self.exceptions if x == "with" else self.names for x in ("and", "or", "with")}

    def read(self, words: np.ndarray, at: int, stop: int) -> tuple[int, set[str]]:
        """The end of the list that begins at `at`, and its labels."""
        labels, end, known = set(), at, self.names
        while True:
            to, label = max(((machine.run(words, at, stop), label) for label, machine in known), key=lambda x: x[0])
            if to < 0:
                return end, labels
            end = to
            if label:
                labels.add(label)
            known = self.joint.get(int(words[end])) if end < stop else None
            if known is None:
                return end, labels
            at = end + 1


def _scan(phrases: tuple, templates: tuple, names: tuple):
    def run(batches):
        base = [(_hashes(p), label) for p, label in phrases]
        machines = compiled(templates)
        lists = Names(names) if names else None
        for batch in batches:
            rows: list[tuple] = [()] * batch.num_rows
            for i, j, data, offsets in text_groups(batch.column(1)):
                w = words_of(data, offsets, ALNUM, lower=True)
                text_of = np.repeat(np.arange(j - i), np.diff(w.first))
                hits: dict[int, list] = {}
                for words, label in base:
                    for p in _places(w.hashes, text_of, words).tolist():
                        hits.setdefault(int(text_of[p]), []).append((p, p + len(words), label, True))
                for label, machine in machines:
                    reach: dict[int, int] = {}
                    for p in _places(w.hashes, text_of, machine.anchor).tolist():
                        t = int(text_of[p])
                        if p < reach.get(t, 0):
                            continue
                        begin = machine.begin(w.hashes, p, max(int(w.first[t]), reach.get(t, 0)))
                        end = machine.run(w.hashes, p, int(w.first[t + 1]), machine.anchor_state) if begin >= 0 else -1
                        if end > p:
                            reach[t] = end
                            hits.setdefault(t, []).append((begin, end, label, False))
                for p in _places(w.hashes, text_of, lists.head).tolist() if lists else ():
                    t = int(text_of[p])
                    end, labels = lists.read(w.hashes, p + len(lists.head), int(w.first[t + 1]))
                    hits.setdefault(t, []).extend((p, end, label, False) for label in labels)
                for t in range(j - i):
                    n, found = int(w.first[t + 1] - w.first[t]), hits.get(t, [])
                    found = sorted([x for x in found if x[3]] + outermost([x for x in found if not x[3]]))
                    starts = [a - int(w.first[t]) for a, _, _, is_base in found if is_base]
                    covered, upto = 0, 0
                    for a, b, _, _ in found:
                        covered += max(0, b - max(a, upto))
                        upto = max(upto, b)
                    labels = sorted({x[2] for x in found})
                    rows[i + t] = (n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x[2] for x in found if x[3]})), ",".join(labels), covered / n if n else 0.0)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), *columns], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: tuple = PHRASES, templates: dict[str, list[str]] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    names: names by label, as templates, that stand in lists after `spdx license identifier`; without own templates those of SPDX.
    """
    names = (SPDX if templates is None else {}) if names is None else names
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return rows.mapInArrow(_scan(phrases, _all_templates(TEMPLATES if templates is None else templates), tuple(sorted(names.items()))), schema)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def license_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_license_scan that SQL can express."""
    return op10_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
