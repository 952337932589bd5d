"""License scanning by template automata.

A template is license wording with marked regions: `[[...]]` may be left out, `<<n>>` stands for any 0 to n words. It
is compiled into a nondeterministic automaton over words, whose mandatory words must all match exactly and in
order. A phrase is a template without regions. All automata run together over the words of a text: a text is
only entered where a word occurs that some template can start with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base phrases and their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Public licenses and notices, as templates. Where a notice names its holder any words may stand.
TEMPLATES = {
    "apache-2.0": [
        "licensed under the apache license version 2.0 [[the license [[you may not use this file except in compliance with the license]]]]",
        "apache license [[version]] 2.0",
        "you may not use this file except in compliance with the license"
        " [[you may obtain a copy of the license at <<8>> unless required by applicable law or agreed to in writing software"
        " distributed under the license is distributed on an as is basis without warranties or conditions of any kind"
        " either express or implied see the license for the specific language governing permissions and limitations under the license]]",
    ],
    "mit": [
        "[[released]] under the mit license",
        "mit license [[mit]]",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the [[software]] <<4>> to deal in the software without restriction"
        " [[including without limitation the rights to use copy modify merge publish distribute sublicense and or sell"
        " copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " [[the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all"
        " copies or substantial portions of the software"
        " [[the software is provided as is without warranty of any kind express or implied including but not limited to the"
        " warranties of merchantability fitness for a particular purpose and noninfringement in no event shall"
        " <<12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising"
        " from out of or in connection with the software or the use or other dealings in the software]]]]]]",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted"
        " [[provided that the following conditions are met"
        " [[[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and or other materials provided with the distribution"
        " [[[[3]] neither the name of <<12>> nor the names of [[its]] [[the]] [[copyright holder nor the names of its]] contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission]]"
        " [[this software is provided by <<12>> as is and any express or implied warranties including but not limited to the"
        " implied warranties of merchantability and fitness for a particular purpose are disclaimed]]]]]]",
        "bsd <<2>> license",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
        " [[provided that the above copyright notice and this permission notice appear in all copies"
        " [[the software is provided as is and <<6>> disclaims all warranties with regard to this software including all"
        " implied warranties of merchantability and fitness in no event shall <<6>> be liable for any special direct indirect"
        " or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action"
        " of contract negligence or other tortious action arising out of or in connection with the use or performance of this software]]]]",
    ],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable"
        " for any damages arising from the use of this software"
        " [[permission is granted to anyone to use this software for any purpose including commercial applications and to alter"
        " it and redistribute it freely subject to the following restrictions"
        " [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software"
        " [[if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required]]"
        " [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software"
        " [[3]] this notice may not be removed or altered from any source distribution]]",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain"
        " [[anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as"
        " a compiled binary for any purpose commercial or non commercial and by any means]]",
    ],
    "bsl-1.0": [
        "boost software license version 1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and"
        " accompanying documentation covered by this license [[the software]] to use reproduce display distribute execute and"
        " transmit the software [[and to prepare derivative works of the software and to permit third parties to whom the"
        " software is furnished to do so all subject to the following]]",
    ],
    "mpl-2.0": [
        "mozilla public license [[v]] [[version]] 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0 [[if a copy of the mpl was not"
        " distributed with this file you can obtain one at <<6>> mozilla org mpl 2.0]]",
    ],
    "gpl-notice": [
        "licensed under the gnu general public license [[version [[1]] [[2]] [[3]]]]",
        "under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation"
        " [[either version <<2>> of the license or at your option any later version]]",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied"
        " warranty of merchantability or fitness for a particular purpose see the gnu [[lesser]] [[affero]] general public license for more details",
    ],
    "cc0": ["to the extent possible under law <<12>> has waived all copyright and related or neighboring rights to"],
    "cc-by-nc": ["licensed under cc by nc [[nd]] [[sa]] [[2.0]] [[3.0]] [[4.0]]", "creative commons attribution noncommercial [[noderivatives]] [[sharealike]] [[3.0]] [[4.0]] [[international]]"],
    "cc-by-sa": ["licensed under cc by sa [[2.0]] [[3.0]] [[4.0]]", "creative commons attribution sharealike [[3.0]] [[4.0]] [[international]] [[license]]"],
    "cc-by-notice": ["creative commons attribution [[4.0]] [[3.0]] international [[license]]"],
    "copyright": ["copyright [[c]] <<6>> all rights reserved"],
}

# Titles, identifiers and first provisions of licenses that the notices above are about, and of others.
MORE_TEMPLATES = {
    "apache-2.0": [
        "apache 2.0",
        "spdx license identifier apache 2.0",
        "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
        "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive"
        " no charge royalty free irrevocable [[copyright license to reproduce prepare derivative works of publicly display publicly perform"
        " sublicense and distribute the work and such derivative works in source or object form]]",
    ],
    "mit": ["spdx license identifier mit"],
    "bsd": [
        "spdx license identifier bsd <<1>> clause",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " [[[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the"
        " following disclaimer in the documentation and or other materials provided with the distribution]]",
    ],
    "isc": ["isc license", "spdx license identifier isc"],
    "unlicense": ["in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"],
    "mpl-2.0": [
        "spdx license identifier mpl 2.0",
        "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
    ],
    "epl": ["eclipse public license [[v]] [[version]] [[1.0]] [[2.0]]", "spdx license identifier epl <<2>>"],
    "gpl-2.0": ["gnu general public license [[v]] [[version]] 2 [[june 1991]]", "spdx license identifier gpl 2.0 [[only]] [[or later]]"],
    "gpl-3.0": [
        "gnu general public license [[v]] [[version]] 3 [[0]] [[29 june 2007]]",
        "spdx license identifier gpl 3.0 [[only]] [[or later]]",
        "the gnu general public license is a free copyleft license for software and other kinds of works",
    ],
    "lgpl": ["gnu lesser general public license [[v]] [[version]] [[2.1]] [[3]] [[0]]", "spdx license identifier lgpl <<4>>"],
    "agpl": ["gnu affero general public license [[v]] [[version]] [[3]] [[0]] [[19 november 2007]]", "spdx license identifier agpl <<4>>"],
    "cc0": ["cc0 1.0 [[universal]]", "spdx license identifier cc0 1.0"],
    "cc-by-nc": ["cc by nc [[nd]] [[sa]] [[2.0]] [[3.0]] [[4.0]]"],
    "cc-by-sa": ["cc by sa [[2.0]] [[3.0]] [[4.0]]"],
}
TEMPLATES = {label: TEMPLATES.get(label, []) + MORE_TEMPLATES.get(label, []) for label in [*TEMPLATES, *MORE_TEMPLATES]}

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_REGION = re.compile(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and everything outside ASCII, A-Z lower-cased."""
    return _WORDS.findall(text.encode("utf-8", "replace").lower()) if text else []


@dataclass(frozen=True)
class Template:
    """States 0..n-1 and the accepting state n: `steps[s]` is the word that leads to s + 1, None for any word;
    `skips[s]` the states that s reaches without a word."""

    label: str
    steps: tuple[bytes | None, ...]
    skips: tuple[tuple[int, ...], ...]
    base: bool = False

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def starts(self) -> set[bytes]:
        firsts = {self.steps[s] for s in self.closure({0}) if s < len(self.steps)}
        if None in firsts or len(self.steps) in self.closure({0}):
            raise ValueError(f"a template of {self.label} begins with no mandatory word")
        return firsts

    def match(self, words: list[bytes], at: int) -> int | None:
        """The end of the longest accepted text that begins at `at`."""
        states, final, end = self.closure({0}), len(self.steps), None
        for i in range(at, len(words)):
            states = {s + 1 for s in states if s < final and (self.steps[s] is None or self.steps[s] == words[i])}
            if not states:
                break
            states = self.closure(states)
            if final in states:
                end = i + 1
        return end


def compile_template(label: str, markup: str, base: bool = False) -> Template:
    """The automaton of one template; optional regions may nest."""
    steps: list[bytes | None] = []
    skips: list[list[int]] = [[]]
    opened: list[int] = []
    for token in _REGION.findall(markup):
        if token == "[[":
            opened.append(len(steps))
        elif token == "]]":
            skips[opened.pop()].append(len(steps))
        elif token.startswith("<<"):
            begin, n = len(steps), int(token[2:-2])
            for _ in range(n):
                steps.append(None)
                skips.append([])
            for s in range(begin, begin + n):
                skips[s].append(begin + n)
        else:
            for word in words_of(token):
                steps.append(word)
                skips.append([])
    if opened:
        raise ValueError(f"an optional region of {label} is not closed")
    return Template(label, tuple(steps), tuple(map(tuple, skips)), base)


class Scanner:
    """All templates, found by the words they can start with."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, list[str]]):
        compiled = [compile_template(label, phrase, True) for phrase, label in phrases.items()]
        compiled += [compile_template(label, t) for label, each in templates.items() for t in each]
        self.by_start: dict[bytes, list[Template]] = {}
        for t in compiled:
            for word in t.starts():
                self.by_start.setdefault(word, []).append(t)
        self.start_words = frozenset(self.by_start)

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, Template]]]:
        """(number of words, [(start, end, template)]): every place where a template is accepted."""
        words = words_of(text)
        found = []
        for word in self.start_words.intersection(words):
            at = -1
            for _ in range(words.count(word)):
                at = words.index(word, at + 1)
                for t in self.by_start[word]:
                    end = t.match(words, at)
                    if end is not None:
                        found.append((at, end, t))
        return len(words), sorted(found, key=lambda m: (m[0], m[1], m[2].label))


_RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " matches array<struct<start:long,end:long,label:string>>"
)


def licenses(text: Column | str, phrases: Mapping[str, str] = BASE_PHRASES, templates: Mapping[str, list[str]] = TEMPLATES) -> Column:
    """struct of what the templates accept in a whole text.

    n_words; n_base, first_word and last_word: places of base phrases, the first and last of them (from 0, else
    null); base_labels and labels: distinct, sorted, comma-joined, empty if none; score: how much of a text of
    license wording it is, 0 without a match, 0.5 and up to 1 with the share of words matched; matches: each
    place. Of the texts that a template accepts from one place on the longest counts; overlapping places all count. A
    null text is empty, as is one without words; a text of any length is read whole.
    """
    phrases, templates = dict(phrases), {k: list(v) for k, v in templates.items()}

    @F.pandas_udf(_RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(phrases, templates)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
        for texts in batches:
            rows = []
            for t in texts:
                n, found = scanner.scan(t)
                base = [m for m in found if m[2].base]
                inside = 0
                last = 0
                for start, end, _ in found:
                    inside += max(0, end - max(start, last))
                    last = max(last, end)
                rows.append(
                    (
                        n,
                        len(base),
                        base[0][0] if base else None,
                        base[-1][0] if base else None,
                        ",".join(sorted({m[2].label for m in base})),
                        ",".join(sorted({m[2].label for m in found})),
                        0.5 + 0.5 * inside / n if found else 0.0,
                        [{"start": a, "end": b, "label": m.label} for a, b, m in found],
                    )
                )
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"first_word": "Int64", "last_word": "Int64"})

    return scan.asNondeterministic()(text)


def scan_licenses(docs: DataFrame, *, text: str = "text", key: str = "doc_id", **given) -> DataFrame:
    """One row per row of `docs`, repeated rows included: key and the fields of `licenses`.

    Rows with a null key are scanned like others, an empty table gives no rows, and other columns, whatever their
    names, are left out.
    """
    return docs.select(F.col(key).alias("k"), licenses(F.col(text), **given).alias("found")).select(F.col("k").alias(key), "found.*")
