import re
import re._constants as kinds
import re._parser as parser

import pytest
import regex

from nearfield.llm.licenses import BASE, rules, scan

from .fixtures import ALNUM, documents, lower, odd_docs


def brute(text):
    w, places = ALNUM.findall(lower(text)), []
    for phrase, label in BASE:
        p = phrase.split()
        places += [(s, label) for s in range(len(w) - len(p) + 1) if w[s : s + len(p)] == p]
    starts = [s for s, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


@pytest.mark.parametrize("make", [documents, odd_docs])
def test_base_as_brute_force(spark, make):
    docs = make(spark)
    text = {}
    for r in docs.collect():
        text.setdefault(r.doc_id, r.text)
    got = scan(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


def test_rules_and_suppression(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
        (2, "Released under the MIT License. x GNU General Public License, version 3", "gpl,gpl-3.0,mit"),
        (3, "Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        (4, "SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        (5, "see http://www.apache.org/licenses/LICENSE-2.0 there", "apache-2.0"),
        (6, "nothing licensed here", ""),
        (7, "MIT License MIT License cc/by cc by", "cc-by,mit"),
        (8, "GNU Lesser General Public License v2.1", "lgpl-2.1"),
        (9, "occupy cc byte", ""),
    ]
    got = {r.doc_id: r for r in scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, text, labels in rows:
        assert got[i].labels == labels, text
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == brute(text)
    # the longest signature alone stands for its words
    assert [x.label for x in got[1].found] == ["apache-2.0"]


#: Notices as they stand in files, by the labels that they are to have; no others of the table's labels may stand there.
NOTICES = {
    "gpl-3.0": ["GPLv3", "GPL-3.0-only", "GNU GPL v3", "License: GPL-3.0-or-later", "# License: GPL v3+", "GPL 3", "released as GPLv3.", "GNU GPLv3 or later"],
    "gpl-2.0": ["GPLv2", "GPL-2.0+", "GPL version 2", "GNU GPL v2", "MODULE_LICENSE(\"GPL v2\")", "GPL-2.0-or-later", "under the GPL-2"],
    "gpl": ["MODULE_LICENSE(\"GPL\");", "under the GPL.", "it is GPL licensed", "GNU GPL", "This program is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY"],
    "agpl-3.0": ["AGPLv3", "AGPL-3.0", "GNU AGPL v3", "AGPL-3.0-or-later", "GNU Affero General Public License v3.0"],
    "agpl": ["GNU Affero General Public License", "AGPL", "AGPL licensed"],
    "lgpl-2.1": ["LGPL v2.1", "LGPL-2.1+", "LGPLv2.1", "GNU LGPL version 2.1 or later", "LGPL 2.1"],
    "lgpl-3.0": ["LGPLv3", "LGPL-3.0-or-later", "GNU LGPL v3", "GNU Lesser General Public License, version 3"],
    "lgpl": ["GNU Lesser General Public License", "the LGPL", "GNU Library General Public License", "LGPL licensed"],
    "bsd": ["BSD license", "BSD-style license", "BSD licensed", "Berkeley Software Distribution License", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\"\nAND ANY EXPRESS OR IMPLIED WARRANTIES"],
    "bsd-3-clause": ["BSD 3-Clause License", "three-clause BSD license", "New BSD License", "BSD-3-Clause", "License: BSD-3-Clause", "may be used to endorse or promote products derived from\n this software without specific prior written permission"],
    "bsd-2-clause": ["BSD 2-Clause", "Simplified BSD License", "two-clause BSD", "License: BSD-2-Clause"],
    "bsd-4-clause": ["BSD-4-Clause", "Original BSD license", "All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "mit": ["MIT-licensed", "License: MIT", "\"license\": \"MIT\"", "MIT style license", "Expat License", "Licence: MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-0": ["MIT No Attribution", "License: MIT-0"],
    "apache-2.0": ["Apache-2.0", "Apache 2.0", "Apache2", "Apache v2", "License: Apache-2.0", "distributed on an \"AS IS\" BASIS,\n// WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-2.0-llvm": ["Apache-2.0 WITH LLVM-exception"],
    "apache,apache-2.0-llvm": ["Apache License v2.0 with LLVM Exceptions"],
    "mpl": ["Mozilla Public License"],
    "mpl-2.0": ["MPL-2.0", "MPL 2.0", "MPLv2", "License: MPL-2.0", "Incompatible With Secondary Licenses"],
    "mpl-1.1": ["MPL 1.1", "Mozilla Public License Version 1.1"],
    "epl": ["Eclipse Public License"],
    "epl-2.0": ["EPL-2.0", "Eclipse Public License v2.0"],
    "epl-1.0": ["EPL 1.0"],
    "cddl-1.0": ["CDDL-1.0", "CDDL v1.0"],
    "cddl": ["Common Development and Distribution License"],
    "isc": ["ISC License", "License: ISC", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"],
    "zlib": ["zlib License", "This software is provided 'as-is', without any express or implied\n warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "bsl-1.0": ["Boost Software License", "Boost license"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "The Unlicense"],
    "cc0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0"],
    "cc-by-nc-sa": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "artistic-1.0-or-gpl": ["under the same terms as Perl itself"],
    "ms-pl": ["Microsoft Public License"],
    "ncsa": ["University of Illinois/NCSA Open Source License"],
    "postgresql": ["PostgreSQL License"],
    "json": ["The Software shall be used for Good, not Evil."],
    "wtfpl": ["WTFPL", "WTFPL version 2"],
    "apache-2.0,mit": ["SPDX-License-Identifier: MIT OR Apache-2.0", "SPDX-License-Identifier: (Apache-2.0 OR MIT)"],
    "bsd-3-clause,isc,mit": ["SPDX-License-Identifier: (MIT AND ISC) AND BSD-3-Clause"],
    "": ["as is the case here", "the bsd kernel", "an example: simple, template", "any warranty claims", "the express or the local train", "and mit or isc", "in all warranties of the shop", "apaches 2"],
}


def test_notices(spark):
    rows = [(text, labels) for labels, texts in NOTICES.items() for text in texts]
    assert len(rows) > 100
    got = {r.doc_id: r for r in scan(spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    wrong = [(text, labels, got[i].labels) for i, (text, labels) in enumerate(rows) if got[i].labels != labels]
    assert not wrong


def test_hundreds_of_rules():
    own = rules()
    assert len(own) > 400 and all(r.pattern and r.keyword for r in own)


def test_empty_table(spark):
    assert scan(documents(spark).limit(0)).collect() == []


def examples(tree):
    """Texts that a signature matches: every alternative, with and without each optional part."""
    out = [""]
    for kind, arg in tree:
        if kind is kinds.LITERAL:
            more = [chr(arg)]
        elif kind is kinds.IN:
            more = [chr(arg[0][1][0] if arg[0][0] is kinds.RANGE else arg[0][1])]
        elif kind is kinds.BRANCH:
            more = [x for a in arg[1] for x in examples(a)]
        elif kind is kinds.SUBPATTERN:
            more = examples(arg[3])
        else:
            assert kind is kinds.MAX_REPEAT and arg[:2] == (0, 1)
            more = ["", *examples(arg[2])]
        out = [a + b for a in out for b in more]
    return out


def test_every_rule_fires_whatever_stands_between_words(spark):
    rows = [(n, x.strip().replace(" ", sep)) for n, (x, sep) in enumerate(sorted({(x, sep) for r in rules() if r.priority in (58, 60, 70, 100) for x in examples(parser.parse(r.pattern)) for sep in ("\n", "-", " \n ")}))]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for n, text in rows:
        words = len(" ".join(ALNUM.findall(lower(text))))
        assert any(x.s == 1 and x.e == 1 + words for x in got[n].found), text


def brute_rules(text):
    """(spans and labels that stand, all labels, score): every rule on every text, whatever its keyword, then all pairs of detections."""
    norm = " " + " ".join(ALNUM.findall(lower(text))) + " "
    all_ = [(m.start(), m.end(), -r.priority, i, r.label, r.weight) for i, r in enumerate(rules()) for m in regex.finditer(rf"(?<= )(?:{r.pattern})(?= )", norm)]

    def beaten(d, by):
        return by[0] <= d[0] and by[1] >= d[1] and (by[1] - by[0] > d[1] - d[0] or by[2:4] < d[2:4])

    stand = sorted(d for d in all_ if not any(beaten(d, by) for by in all_))
    base = brute(text)[4]
    labels = sorted({d[4] for d in stand} | set(filter(None, base.split(","))))
    return [(d[0], d[1], d[4]) for d in stand], ",".join(labels), max([d[5] for d in stand] + [0.9] * bool(base), default=0)


def hard_docs(spark):
    """Rules' own texts, run together, line-wrapped, in other cases and spellings, overlapping and often repeated in one text."""
    texts = [x for r in rules() if "(?<=" not in r.pattern for x in examples(parser.parse(r.pattern))[:1] + examples(parser.parse(r.pattern))[-1:]]
    rows = [sep.join(texts[k : k + 9]).replace(" ", gap) for k in range(0, len(texts), 5) for sep, gap in ((" ", " "), ("\n", "\n * "))]
    rows += [x.upper() for x in rows[::7]] + [x.replace("license", "licence") for x in rows[::5]]
    rows += ["MIT License, " * 300 + "in the public\ndomain", "MIT No Attribution", "hereby\ngranted", "All rights\n  reserved.", "Licenced under the MIT licence", "the unlicence", "licensed under the terms of the the MIT License", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause WITH Classpath-exception-2.0", "SPDX-Licence-Identifier: GPL-2.0 or MIT-0", "or MIT"]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize("make", [documents, odd_docs, hard_docs])
def test_rules_as_brute_force(spark, make):
    docs = make(spark)
    text = {}
    for r in docs.collect():
        text.setdefault(r.doc_id, r.text)
    for r in scan(docs).collect():
        assert ([(x.s, x.e, x.label) for x in r.found], r.labels, r.score) == brute_rules(text[r.doc_id]), text[r.doc_id]
