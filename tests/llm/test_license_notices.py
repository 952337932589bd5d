"""Each license template on the notice it is meant for, and the whole scan against plain expressions."""

import re

import pytest

from lodewell.llm import license, queries

NOTICES = [
    ("apache-2.0", 0, 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache-2.0", 1, "Apache License\nVersion 2.0, January 2004"),
    ("apache-2.0", 1, "Apache License 2.0"),
    ("apache-2.0", 2, "you may not use this file except in compliance with the License."),
    ("mit", 0, "Released under the MIT License."),
    ("mit", 1, "The MIT License (MIT)"),
    ("mit", 2, 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("bsd", 0, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd", 1, "BSD 3-Clause License"),
    ("isc", 0, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", 0, "subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed"),
    ("mpl-2.0", 0, "Mozilla Public License Version 2.0"),
    ("mpl-2.0", 0, "Mozilla Public License 2.0 (MPL-2.0)"),
    ("gpl-notice", 0, "Licensed under the GNU General Public License version 2"),
    ("gpl-notice", 1, "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-notice", 1, "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("gpl-notice", 1, "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", 0, "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", 1, "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("cc-by-notice", 0, "Creative Commons Attribution 4.0 International License"),
    ("cc-by-notice", 0, "Creative Commons Attribution 3.0 International"),
    ("cc-by-notice", 0, "Creative Commons Attribution International"),
    ("apache-2.0", 2, "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software"),
    ("zlib", 0, "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("unlicense", 0, "This is free and unencumbered software released into the public domain."),
    ("bsl-1.0", 0, "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("bsl-1.0", 1, 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software'),
    ("mpl-2.0", 1, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("gpl-notice", 2, "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("cc0", 0, "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa", 0, "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", 1, "Creative Commons Attribution-ShareAlike 3.0"),
    ("copyright", 0, "Copyright (c) 2020 Jane Doe. All rights reserved."),
    ("apache-2.0", 3, "Apache-2.0"),
    ("apache-2.0", 4, "SPDX-License-Identifier: Apache-2.0"),
    ("apache-2.0", 5, '"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'),
    ("apache-2.0", 6, "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("mit", 3, "SPDX-License-Identifier: MIT"),
    ("bsd", 2, "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd", 3, "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", 1, "ISC License"),
    ("isc", 2, "SPDX-License-Identifier: ISC"),
    ("unlicense", 1, "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."),
    ("mpl-2.0", 2, "SPDX-License-Identifier: MPL-2.0"),
    ("mpl-2.0", 3, '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
    ("epl", 0, "Eclipse Public License - v 2.0"),
    ("epl", 1, "SPDX-License-Identifier: EPL-2.0"),
    ("gpl-2.0", 0, "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("gpl-2.0", 1, "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl-3.0", 0, "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl-3.0", 1, "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl-3.0", 2, "The GNU General Public License is a free, copyleft license for software and other kinds of works."),
    ("lgpl", 0, "GNU Lesser General Public License v3.0"),
    ("lgpl", 1, "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("agpl", 0, "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("agpl", 1, "SPDX-License-Identifier: AGPL-3.0-only"),
    ("cc0", 1, "CC0 1.0 Universal"),
    ("cc0", 2, "SPDX-License-Identifier: CC0-1.0"),
    ("cc-by-nc", 2, "under CC BY-NC-SA 4.0"),
    ("cc-by-sa", 2, "under CC BY-SA 3.0"),
]


@pytest.mark.parametrize("label,number,notice", NOTICES)
def test_notices_are_accepted(label, number, notice):
    template = license.compile_template(label, license.TEMPLATES[label][number])
    words = license.words_of(notice)
    assert any(template.match(words, at) for at in range(len(words)))
    _, found = license.Scanner(license.BASE_PHRASES, license.TEMPLATES).scan(notice)
    assert label in {t.label for _, _, t in found}


def test_every_template_has_a_notice():
    assert {(label, n) for label, n, _ in NOTICES} == {(label, n) for label, each in license.TEMPLATES.items() for n in range(len(each))}


def test_other_versions_are_not_labelled():
    for text in ("Mozilla Public License, v. 1.1", "GNU Library Loan General Public License as published by the Free Software Foundation", "Creative Commons Attribution 2.0 International"):
        _, found = license.Scanner({}, license.TEMPLATES).scan(text)
        assert not found


MIT = """MIT License

Copyright (c) 2021 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_a_whole_license_is_matched_to_its_end():
    n, found = license.Scanner(license.BASE_PHRASES, license.TEMPLATES).scan(MIT)
    bodies = [(a, b) for a, b, t in found if t.label == "mit"]
    assert bodies == [(0, 2), (7, n)] and n > 150
    # One mandatory word changed, and the body ends before the region that it is in.
    _, found = license.Scanner({}, {"mit": license.TEMPLATES["mit"][2:]}).scan(MIT.replace("TORT", "FAULT"))
    assert [(a, b) for a, b, _ in found][0][1] < n - 60


def test_the_longest_text_counts():
    for text, end in {"mit license (MIT) here": 3, "mit license": 2}.items():
        assert license.compile_template("mit", "mit license [[mit]]").match(license.words_of(text), 0) == end


def expression(markup):
    """A template as a regular expression over words that each end in a space."""
    out = ""
    for token in re.findall(r"\[\[|\]\]|<<\d+>>|[^\s\[\]<>]+", markup):
        if token in ("[[", "]]"):
            out += "(?:" if token == "[[" else ")?"
        elif token.startswith("<<"):
            out += "(?:\\S+ ){0,%s}" % token[2:-2]
        else:
            out += "".join(re.escape(w) + " " for w in re.findall(r"[a-z0-9]+", token))
    return re.compile(out)


def test_the_scan_equals_plain_expressions(spark):
    """Labels, places and scores of whole tables and of texts made to contain templates."""
    plain = [(label, expression(m)) for label, each in license.TEMPLATES.items() for m in each] + [(label, expression(p)) for p, label in license.BASE_PHRASES.items()]
    made = [(10_000 + i, f"before it {n} and then {m}") for i, (n, m) in enumerate(zip([x for *_, x in NOTICES], [x for *_, x in reversed(NOTICES)], strict=True))]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([*made, (20_000, MIT)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in license.scan_licenses(docs).collect()}
    some = 0
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"]))
        text, starts, at = "".join(w + " " for w in words), [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        found = []
        for label, x in plain:
            for a, begin in enumerate(starts):
                if x.match(text, begin):
                    ends = [b for b in range(len(words), a, -1) if x.fullmatch(text, begin, starts[b] if b < len(words) else len(text))]
                    found.append((a, ends[0], label))
        mine = got[r["doc_id"]]
        assert sorted((m["start"], m["end"], m["label"]) for m in mine["matches"]) == sorted(found)
        assert mine["labels"] == ",".join(sorted({x for *_, x in found}))
        covered = {i for a, b, _ in found for i in range(a, b)}
        assert mine["score"] == (0.5 + 0.5 * len(covered) / len(words) if found else 0.0)
        some += bool(found)
    assert some > 30 and "matches" not in queries.QUERIES["op6_license_scan"](spark, "/root/testdata/sf0.001").columns
