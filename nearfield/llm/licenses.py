"""Licence scan by ordered signature rules, with DataFrame functions alone.

Rules are regular expressions over a text's words joined by single spaces. A text that holds none of the trigger strings is not looked at; in the others a rule runs only
where its keyword stands. Detections that lie inside a longer one, or on the same words as one of higher priority, are suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import ALNUM_WORD, let, lower_ascii

#: The phrases that always count, and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_V = r"(?: version| v)? v?"
#: Label, keyword, signature of the name, SPDX identifier in words. Most exact first.
FAMILIES = (
    ("apache-2.0", "apache", rf"apache(?: software)? license{_V}2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", rf"apache(?: software)? license{_V}1 1", "apache 1 1"),
    ("apache-1.0", "apache", rf"apache(?: software)? license{_V}1 0", "apache 1 0"),
    ("agpl-3.0", "affero", rf"(?:gnu )?affero general public license{_V}3(?: 0)?", "agpl 3 0"),
    ("agpl-1.0", "affero", rf"affero general public license{_V}1(?: 0)?", "agpl 1 0"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public license{_V}3(?: 0)?", "lgpl 3 0"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public license{_V}2 1", "lgpl 2 1"),
    ("lgpl-2.0", "library", rf"(?:gnu )?library general public license{_V}2(?: 0)?", "lgpl 2 0"),
    ("gpl-3.0", "general public", rf"(?:gnu )?general public license{_V}3(?: 0)?", "gpl 3 0"),
    ("gpl-2.0", "general public", rf"(?:gnu )?general public license{_V}2(?: 0)?", "gpl 2 0"),
    ("gpl-1.0", "general public", rf"(?:gnu )?general public license{_V}1(?: 0)?", "gpl 1 0"),
    ("gfdl-1.3", "free documentation", rf"(?:gnu )?free documentation license{_V}1 3", "gfdl 1 3"),
    ("gfdl-1.2", "free documentation", rf"(?:gnu )?free documentation license{_V}1 2", "gfdl 1 2"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", "bsd 4 clause"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?", "bsd 3 clause"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: license)?", "bsd 2 clause"),
    ("bsd-0-clause", "bsd", r"(?:zero clause bsd|0 clause bsd)", "0bsd"),
    ("bsd-0-clause", "free public", r"free public license 1 0 0", "0bsd"),
    ("mit-0", "mit", r"mit no attribution(?: license)?", "mit 0"),
    ("mit", "mit", r"mit(?: x11| expat)? license", "mit"),
    ("x11", "x11", r"x11 license", "x11"),
    ("isc", "isc", r"isc license", "isc"),
    ("mpl-2.0", "mozilla", rf"mozilla public license{_V}2(?: 0)?", "mpl 2 0"),
    ("mpl-1.1", "mozilla", rf"mozilla public license{_V}1 1", "mpl 1 1"),
    ("mpl-1.0", "mozilla", rf"mozilla public license{_V}1 0", "mpl 1 0"),
    ("epl-2.0", "eclipse", rf"eclipse public license{_V}2(?: 0)?", "epl 2 0"),
    ("epl-1.0", "eclipse", rf"eclipse public license{_V}1(?: 0)?", "epl 1 0"),
    ("cddl-1.1", "distribution", rf"common development and distribution license{_V}1 1", "cddl 1 1"),
    ("cddl-1.0", "distribution", rf"common development and distribution license{_V}1(?: 0)?", "cddl 1 0"),
    ("cpl-1.0", "common public", rf"common public license{_V}1 0", "cpl 1 0"),
    ("eupl-1.2", "european", rf"european union public license{_V}1 2", "eupl 1 2"),
    ("eupl-1.1", "european", rf"european union public license{_V}1 1", "eupl 1 1"),
    ("artistic-2.0", "artistic", rf"artistic license{_V}2(?: 0)?", "artistic 2 0"),
    ("artistic-1.0", "artistic", rf"artistic license{_V}1(?: 0)?", "artistic 1 0"),
    ("bsl-1.0", "boost", rf"boost software license{_V}1(?: 0)?", "bsl 1 0"),
    ("busl-1.1", "business source", rf"business source license{_V}1 1", "busl 1 1"),
    ("sspl-1.0", "server side", rf"server side public license{_V}1(?: 0)?", "sspl 1 0"),
    ("elastic-2.0", "elastic", rf"elastic license{_V}2(?: 0)?", "elastic 2 0"),
    ("unlicense", "unlicen", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "want to public", r"do what the (?:fuck|f) you want to public license", "wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", "zlib"),
    ("libpng", "libpng", r"libpng license", "libpng"),
    ("openssl", "openssl", r"openssl license", "openssl"),
    ("python-2.0", "python", rf"python(?: software foundation)? license(?:{_V}2(?: 0)?)?", "python 2 0"),
    ("php-3.01", "php", rf"php license{_V}3 01", "php 3 01"),
    ("ruby", "ruby", r"ruby license", "ruby"),
    ("vim", "vim", r"vim license", "vim"),
    ("w3c", "w3c", r"w3c software(?: notice and)? license", "w3c"),
    ("unicode", "unicode", r"unicode(?: data files and software)? license", "unicode dfs 2016"),
    ("ofl-1.1", "open font", rf"(?:sil )?open font license{_V}1 1", "ofl 1 1"),
    ("odbl-1.0", "database", rf"open (?:data commons open )?database license(?:{_V}1 0)?", "odbl 1 0"),
    ("odc-by-1.0", "data commons", r"open data commons attribution license", "odc by 1 0"),
    ("pddl-1.0", "public domain dedication", r"public domain dedication and license", "pddl 1 0"),
    ("cc0-1.0", "cc0", r"(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc-by-nc-nd", "nc nd", r"cc by nc nd(?: [1-4] [0-9])?", "cc by nc nd 4 0"),
    ("cc-by-nc-sa", "nc sa", r"cc by nc sa(?: [1-4] [0-9])?", "cc by nc sa 4 0"),
    ("cc-by-nc", "by nc", r"cc by nc(?: [1-4] [0-9])?", "cc by nc 4 0"),
    ("cc-by-nd", "by nd", r"cc by nd(?: [1-4] [0-9])?", "cc by nd 4 0"),
    ("cc-by-sa", "by sa", r"cc by sa(?: [1-4] [0-9])?", "cc by sa 4 0"),
    ("cc-by-4.0", "cc by", r"cc by 4 0", "cc by 4 0"),
    ("cc-by-3.0", "cc by", r"cc by 3 0", "cc by 3 0"),
    ("openrail", "rail", r"(?:creativeml |bigscience )?open ?rail(?: m)? license", "openrail"),
)

#: Label, keyword, signature of sentences and addresses that stand for a licence without its name; weight.
SENTENCES = (
    ("apache-2.0", "apache org", r"apache org licenses license 2 0", 0.95),
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("isc", "hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("gpl", "redistribute it", r"this program is free software you can redistribute it and or modify it", 0.9),
    ("lgpl", "redistribute it", r"this library is free software you can redistribute it and or modify it", 0.9),
    ("gpl", "gnu org", r"(?:www )?gnu org licenses gpl(?: [1-3] 0)?", 0.9),
    ("lgpl", "gnu org", r"(?:www )?gnu org licenses lgpl(?: [2-3] [01])?", 0.9),
    ("agpl", "gnu org", r"(?:www )?gnu org licenses agpl(?: 3 0)?", 0.9),
    ("mit", "opensource org", r"opensource org licenses mit", 0.95),
    ("bsd-3-clause", "opensource org", r"opensource org licenses bsd 3 clause", 0.95),
    ("bsd-2-clause", "opensource org", r"opensource org licenses bsd 2 clause", 0.95),
    ("mpl-2.0", "mozilla org", r"mozilla org mpl 2 0", 0.95),
    ("cc-by", "creativecommons org", r"creativecommons org licenses by [1-4] [0-9]", 0.95),
    ("cc-by-sa", "creativecommons org", r"creativecommons org licenses by sa [1-4] [0-9]", 0.95),
    ("cc-by-nc", "creativecommons org", r"creativecommons org licenses by nc [1-4] [0-9]", 0.95),
    ("cc-by-nd", "creativecommons org", r"creativecommons org licenses by nd [1-4] [0-9]", 0.95),
    ("cc-by-nc-sa", "creativecommons org", r"creativecommons org licenses by nc sa [1-4] [0-9]", 0.95),
    ("cc-by-nc-nd", "creativecommons org", r"creativecommons org licenses by nc nd [1-4] [0-9]", 0.95),
    ("cc0-1.0", "creativecommons org", r"creativecommons org publicdomain zero 1 0", 0.95),
    ("cc-by", "creative commons", r"creative commons attribution(?: [1-4] [0-9])?(?: international)?(?: license)?", 0.8),
    ("cc-by-sa", "creative commons", r"creative commons attribution share ?alike(?: [1-4] [0-9])?(?: international)?(?: license)?", 0.85),
    ("cc-by-nc", "creative commons", r"creative commons attribution non ?commercial(?: [1-4] [0-9])?(?: international)?(?: license)?", 0.85),
    ("cc-by-nd", "creative commons", r"creative commons attribution no ?deriv(?:atives|s)(?: [1-4] [0-9])?(?: international)?(?: license)?", 0.85),
    ("public-domain", "public domain", r"(?:dedicated to|released into|placed in|in) the public domain", 0.7),
    ("proprietary", "all rights reserved", r"all rights reserved", 0.4),
    ("proprietary", "proprietary", r"proprietary and confidential", 0.6),
)

#: Label, keyword, signature of short names, unversioned families, exceptions and paragraphs; weight. The longest that stands counts, so a version beats none.
SHORT = (
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: license)?(?: version)? ?v?3(?: 0)?(?: only| or later)?", 0.85),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: license)?(?: version)? ?v?2(?: 0)?(?: only| or later)?", 0.85),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl(?: version)? ?v?1(?: 0)?(?: only| or later)?", 0.85),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl(?: license)?(?: version)? ?v?3(?: 0)?(?: only| or later)?", 0.85),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: license)?(?: version)? ?v?2 1(?: only| or later)?", 0.85),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl(?: license)?(?: version)? ?v?2(?: 0)?(?: only| or later)?", 0.85),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: license)?(?: version)? ?v?3(?: 0)?(?: only| or later)?", 0.85),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: licensed| license)?", 0.7),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl(?: licensed| license)?", 0.7),
    ("agpl", "agpl", r"(?:gnu )?agpl(?: licensed| license)?", 0.7),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license", 0.85),
    ("lgpl", "library", r"(?:gnu )?library general public license", 0.85),
    ("agpl", "affero", r"(?:gnu )?affero general public license", 0.85),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation license", 0.85),
    ("gfdl", "gfdl", r"(?:gnu )?gfdl(?: v?1 [1-3])?", 0.8),
    ("bsd", "bsd", r"bsd(?: style| type)? licensed?", 0.8),
    ("bsd", "berkeley", r"berkeley software distribution license", 0.85),
    ("bsd-3-clause", "bsd", r"(?:bsd3|bsd 3|three clause bsd|3 clause bsd)(?: license)?", 0.85),
    ("bsd-2-clause", "bsd", r"(?:bsd2|bsd 2|two clause bsd|2 clause bsd)(?: license)?", 0.85),
    ("bsd-4-clause", "bsd", r"(?:bsd4|four clause bsd|old bsd)(?: license)?", 0.85),
    ("bsd-3-clause", "endorse or promote", r"may be used to endorse or promote products derived from this software without specific prior written permission", 0.9),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment", 0.9),
    ("bsd", "as is and any", r"this software is provided by (?:the|its) (?:copyright holders?|authors?|regents)(?: and contributors)? as is and any express or implied warranties", 0.85),
    ("mit", "warranty of any kind", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 0.85),
    ("isc", "the author disclaims", r"the software is provided as is and the author disclaims all warranties with regard to this software", 0.85),
    ("zlib", "in no event", r"this software is provided as is without any express or implied warranty in no event will the authors? be held liable for any damages arising from the use of this software", 0.9),
    ("apache-2.0", "warranties or conditions", r"distributed on an as is basis without warranties or conditions of any kind either express or implied", 0.85),
    ("gpl", "hope that it", r"this program is distributed in the hope that it will be useful but without any warranty", 0.85),
    ("lgpl", "hope that it", r"this library is distributed in the hope that it will be useful but without any warranty", 0.85),
    ("gpl", "received a copy", r"you should have received a copy of the gnu general public license", 0.9),
    ("mpl-2.0", "source code form", r"this source code form is subject to the terms of the mozilla public license v 2 0", 0.95),
    ("mpl-2.0", "secondary", r"incompatible with secondary licenses", 0.85),
    ("mpl", "mozilla", r"mozilla public license", 0.85),
    ("mpl-2.0", "mpl", r"mpl(?: version)? ?v?2(?: 0)?", 0.85),
    ("mpl-1.1", "mpl", r"mpl(?: version)? ?v?1 1", 0.85),
    ("epl", "eclipse", r"eclipse public license", 0.85),
    ("epl-2.0", "epl", r"epl ?v?2 0", 0.8),
    ("epl-1.0", "epl", r"epl ?v?1 0", 0.8),
    ("edl-1.0", "eclipse", r"eclipse distribution license(?: version| v)?(?: v?1 0)?", 0.85),
    ("cddl", "distribution", r"common development and distribution license", 0.85),
    ("cddl-1.0", "cddl", r"cddl(?: license)?(?: version)? ?v?1 0", 0.85),
    ("cddl-1.1", "cddl", r"cddl(?: license)?(?: version)? ?v?1 1", 0.85),
    ("cpl", "common public", r"common public license", 0.8),
    ("ipl-1.0", "ibm", r"ibm public license(?: version| v)?(?: v?1 0)?", 0.85),
    ("eupl", "european", r"european union public license", 0.85),
    ("eupl-1.2", "eupl", r"eupl ?v?1 2", 0.85),
    ("artistic", "artistic", r"(?:perl )?artistic license", 0.8),
    ("artistic-1.0-or-gpl", "same terms as perl", r"under the same terms as perl(?: itself)?", 0.85),
    ("apache-2.0", "apache", r"apache(?: license)? ?v?2(?: 0)?(?: licensed| license)?", 0.8),
    ("apache", "apache", r"apache(?: software| style)? license(?:d)?", 0.8),
    ("apache-2.0-llvm", "llvm", r"apache(?: license)?(?: v)? ?v?2 0 with llvm exceptions?", 0.95),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source license", 0.9),
    ("ncsa", "ncsa", r"ncsa open source license", 0.85),
    ("gpl-classpath-exception", "classpath", r"(?:gnu )?classpath exception(?: 2 0)?", 0.85),
    ("gcc-exception", "runtime library exception", r"gcc runtime library exception(?: 3 1)?", 0.85),
    ("bsl-1.0", "boost", r"boost(?: software)? license", 0.8),
    ("mit", "mit", r"mit(?: style)? licensed?", 0.8),
    ("mit", "expat", r"expat license", 0.8),
    ("mit", "shall be included in all", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.9),
    ("cc0-1.0", "creative commons zero", r"creative commons zero(?: v?1 0)?(?: universal)?", 0.9),
    ("cc-by-nc-sa", "creative commons", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [0-9])?(?: international)?(?: license)?", 0.85),
    ("cc-by-nc-nd", "creative commons", r"creative commons attribution non ?commercial no ?deriv(?:atives|s)(?: [1-4] [0-9])?(?: international)?(?: license)?", 0.85),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain", 0.95),
    ("wtfpl", "wtfpl", r"wtfpl(?: license)?(?: version 2)?", 0.85),
    ("sspl-1.0", "sspl", r"sspl(?: v?1(?: 0)?)?(?: license)?", 0.8),
    ("busl-1.1", "busl", r"busl(?: 1 1)?(?: license)?", 0.8),
    ("ofl-1.1", "open font", r"(?:sil )?open font license", 0.85),
    ("postgresql", "postgresql", r"postgresql license", 0.85),
    ("curl", "curl", r"curl license", 0.8),
    ("ms-pl", "microsoft", r"microsoft public license", 0.85),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", 0.85),
    ("upl-1.0", "universal permissive", r"universal permissive license(?: v?1 0)?", 0.85),
    ("afl-3.0", "academic free", r"academic free license(?: version| v)?(?: v?3 0)?", 0.85),
    ("osl-3.0", "open software", r"open software license(?: version| v)?(?: v?3 0)?", 0.85),
    ("mulan-2.0", "mulan", r"mulan (?:psl|permissive software license)(?: v2)?", 0.85),
    ("blueoak-1.0.0", "blue oak", r"blue oak model license(?: 1 0 0)?", 0.85),
    ("beerware", "beer ware", r"the beer ware license", 0.9),
    ("llama-community", "llama", r"llama [2-4](?: [0-9])? community license(?: agreement)?", 0.9),
    ("json", "good not evil", r"the software shall be used for good not evil", 0.95),
)

#: What a name stands in, by form; priority and weight.
FORMS = (
    ("spdx license identifier {spdx}", 100, 1.0),
    # further identifiers of an expression; the look-behind keeps the ones before them
    ("(?={spdx} )(?<=spdx license identifier [a-z0-9 ]{{1,160}} (?:and|or|with) ){spdx}", 99, 1.0),
    ("license {spdx}", 75, 0.9),
    ("(?:licensed|released|distributed|available|provided|published|covered|shared) under(?: the)?(?: terms of)?(?: the)? {name}", 90, 1.0),
    ("(?:see|read|copy of|text of|subject to|governed by|pursuant to|terms of)(?: the)? {name}", 80, 0.95),
    ("{name}", 60, 0.85),
)

#: A text is looked at only if, in lower case, it holds one of these, or both of two words in turn, whatever stands between words.
TRIGGERS = ("licen", "spdx", "creativecommons", "publicdomain", "redistribut", "gnu", "proprietary", "wtfpl", "mozilla", "opensource", "cc0", "bsd", "rail", "gpl", "gfdl", "cddl", "eupl", "wtfpl", "sspl", "busl", "mplv", "mpl1", "mpl2", "eplv", "epl1", "epl2", "apache2", "apachev", "classpath", "unencumbered", "mulan")
WORD_TRIGGERS = (("cc", "by"), ("creative", "commons"), ("public", "domain"), ("hereby", "granted"), ("rights", "reserved"), ("no", "attribution"), ("mpl", "2"), ("mpl", "1"), ("mpl", "v"), ("epl", "2"), ("epl", "1"), ("epl", "v"), ("apache", "2"), ("apache", "v"), ("endorse", "or"), ("advertising", "materials"), ("implied", "warrant"), ("express", "or"), ("all", "warranties"), ("any", "warranty"), ("permission", "notice"), ("terms", "as"), ("library", "exception"), ("good", "not"))
#: Fixed value: what stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    weight: float


def rules() -> list[Rule]:
    """All rules, in order: each family in each form, then sentences and addresses, then short names. 'license' is 'licence' as well."""
    out = [Rule(label, "spdx" if "spdx license" in form else "licen" if "{spdx}" in form else keyword, form.format(name=name, spdx=spdx), priority, weight) for form, priority, weight in FORMS for label, keyword, name, spdx in FAMILIES]
    out += [Rule(label, keyword, pattern, 70, weight) for label, keyword, pattern, weight in SENTENCES]
    out += [Rule(label, keyword, pattern, 58, weight) for label, keyword, pattern, weight in SHORT]
    return [replace(r, pattern=r.pattern.replace("license", "licen[cs]e")) for r in out]


DETECTIONS = "array<struct<s:int,e:int,label:string,priority:int,rule:int,weight:double>>"


def _bounded(pattern: str) -> str:
    """A signature that starts and ends at words of a text with a space on each side."""
    return rf"(?<= )(?:{pattern})(?= )"


def spans(norm: Column, pattern: Column) -> Column:
    """array<struct<s, e>> of the places where pattern matches, in characters from 0."""
    found, between = F.regexp_extract_all(norm, pattern, F.lit(0)), F.split(norm, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        s = acc["at"] + F.length(p["between"])
        e = s + F.length(p["found"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    return F.aggregate(F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(m.alias("found"), b.alias("between"))), start, step, lambda acc: acc["out"])


def detections(norm: Column, own: list[Rule] | None = None) -> Column:
    """array<struct<s, e, label, priority, rule, weight>> of all rules on norm, after suppression."""
    own = own if own is not None else rules()
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.keyword).alias("keyword"), F.lit(_bounded(r.pattern)).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(i).alias("rule"), F.lit(r.weight).alias("weight")) for i, r in enumerate(own)])
    gated = F.filter(table, lambda r: F.contains(norm, r["keyword"]))
    each = F.transform(gated, lambda r: F.transform(spans(norm, r["pattern"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), r["label"].alias("label"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["weight"].alias("weight"))))

    # in this order whatever lies on all of a detection's words comes before it, so it stands if it ends behind all before it: one pass, not all pairs
    ordered = F.array_sort(F.transform(F.flatten(each), lambda d: F.struct(d["s"].alias("s"), (-d["e"]).alias("back"), (-d["priority"]).alias("low"), d["rule"].alias("rule"), d.alias("d"))))
    kept = F.struct(F.lit(-1).alias("end"), F.array().cast(DETECTIONS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(-x["back"] <= acc["end"], acc).otherwise(F.struct((-x["back"]).alias("end"), F.concat(acc["out"], F.array(x["d"])).alias("out")))

    return F.aggregate(ordered, kept, step, lambda acc: acc["out"])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, found) for every row of docs (doc_id, text).

    n_base counts the places of the base phrases, first_word and last_word are the first words of the first and last of them (null without any). labels: the base
    phrases' and the rules' that stand after suppression, distinct, sorted and joined by commas. score: the largest weight of a detection, base phrases 0.9, nothing 0.
    found: the detections, in characters of the words joined by single spaces after one space. Null and empty texts have no words and no labels.
    """
    low = F.lower("text")
    triggered = F.lit(False)
    for t in TRIGGERS:
        triggered |= F.contains(low, F.lit(t))
    for a, b in WORD_TRIGGERS:
        triggered |= F.contains(low, F.lit(max(a, b, key=len))) & F.rlike(low, F.lit(a + BETWEEN + b))
    d = docs.select("doc_id", "text")
    d = d.select("doc_id", F.coalesce(F.regexp_count("text", F.lit(ALNUM_WORD)), F.lit(0)).cast("long").alias("n_words"), F.when(triggered, F.col("text")).alias("text"))
    words = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(ALNUM_WORD), F.lit(0))
    found = F.when(
        F.col("text").isNotNull(),
        let(
            F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" ")),
            lambda norm: F.struct(
                detections(norm).alias("found"),
                F.transform(
                    F.flatten(F.transform(F.array(*[F.struct(F.lit(_bounded(p)).alias("pattern"), F.lit(label).alias("label")) for p, label in BASE]), lambda b: F.transform(spans(norm, b["pattern"]), lambda x: F.struct(x["s"].alias("s"), b["label"].alias("label"))))),
                    lambda x: F.struct(x["s"].alias("s"), x["label"].alias("label")),
                ).alias("base"),
                norm.alias("norm"),
            ),
        ),
    )
    d = d.select("doc_id", "n_words", found.alias("r"))
    base = F.coalesce("r.base", F.array().cast("array<struct<s:int,label:string>>"))
    d = d.select("doc_id", "n_words", base.alias("base"), F.coalesce("r.found", F.array().cast(DETECTIONS)).alias("found"), F.col("r.norm").alias("norm"))

    def word_at(s: Column) -> Column:
        before = F.substring(F.col("norm"), F.lit(1), s)
        return (F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit(""))) - 1).cast("long")

    starts = F.transform("base", lambda x: x["s"])
    base_labels = F.array_distinct(F.transform("base", lambda x: x["label"]))
    labels = F.array_distinct(F.concat(base_labels, F.transform("found", lambda x: x["label"])))
    score = F.greatest(F.coalesce(F.array_max(F.transform("found", lambda x: x["weight"])), F.lit(0.0)), F.when(F.size("base") > 0, F.lit(0.9)).otherwise(F.lit(0.0)))
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        word_at(F.array_min(starts)).alias("first_word"),
        word_at(F.array_max(starts)).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        score.alias("score"),
        "found",
    )
