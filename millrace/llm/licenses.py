"""Operator 5, license scan: ordered signature rules behind a keyword prefilter.

Over 140 signatures are written by hand, each with its own keyword; over 230 more rules come from families (names
and versions) and sentence templates. A rule runs only where its keyword occurs, a family's rules only where
one of its names does. Detections are resolved by priority and interval containment: one that lies inside a detection of
equal or higher priority goes. The base phrases are found apart from the rules and always stay.
One pass over the documents, nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed by the contract: phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label -> (pattern of the name, versions, what every name holds one of); words are lower case and joined by one space.
FAMILIES = {
    "mit": ("(?:the )?mit", (), ("mit",)),
    "apache": ("(?:the )?apache(?: software)?", ("1 0", "1 1", "2 0"), ("apache",)),
    "gpl": ("(?:the )?(?:gnu )?(?:general public|gpl)", ("1", "2", "2 0", "3", "3 0"), ("general public", "gpl")),
    "lgpl": ("(?:the )?(?:gnu )?(?:lesser general public|library general public|lgpl)", ("2", "2 0", "2 1", "3", "3 0"), ("lesser general", "library general", "lgpl")),
    "agpl": ("(?:the )?(?:gnu )?(?:affero general public|agpl)", ("1", "3", "3 0"), ("affero", "agpl")),
    "bsd": ("(?:the )?(?:new |modified |simplified |original )?bsd", ("2 clause", "3 clause", "4 clause", "0 clause"), ("bsd",)),
    "mpl": ("(?:the )?(?:mozilla public|mpl)", ("1 0", "1 1", "2 0"), ("mozilla", "mpl")),
    "epl": ("(?:the )?(?:eclipse public|epl)", ("1 0", "2 0"), ("eclipse", "epl")),
    "eupl": ("(?:the )?(?:european union public|eupl)", ("1 0", "1 1", "1 2"), ("european union", "eupl")),
    "cddl": ("(?:the )?(?:common development and distribution|cddl)", ("1 0", "1 1"), ("common development", "cddl")),
    "isc": ("(?:the )?isc", (), ("isc",)),
    "zlib": ("(?:the )?zlib(?: libpng)?", (), ("zlib",)),
    "boost": ("(?:the )?(?:boost software|bsl)", ("1 0",), ("boost", "bsl")),
    "artistic": ("(?:the )?(?:perl )?artistic", ("1 0", "2 0"), ("artistic",)),
    "unlicense": ("(?:the )?unlicense", (), ("unlicense",)),
    "wtfpl": ("(?:the )?wtfpl", ("2",), ("wtfpl",)),
    "postgresql": ("(?:the )?postgresql", (), ("postgresql",)),
    "ofl": ("(?:the )?(?:sil )?(?:open font|ofl)", ("1 0", "1 1"), ("open font", "ofl")),
    "cc0": ("(?:creative commons )?(?:cc0|cc zero)", ("1 0",), ("cc0", "cc zero")),
    "cc-by": ("(?:creative commons attribution|cc by)", ("2 0", "2 5", "3 0", "4 0"), ("creative commons", "cc by")),
    "cc-by-sa": ("(?:creative commons attribution sharealike|cc by sa)", ("2 0", "2 5", "3 0", "4 0"), ("creative commons", "cc by")),
    "cc-by-nc": ("(?:creative commons attribution noncommercial|cc by nc)", ("2 0", "2 5", "3 0", "4 0"), ("creative commons", "cc by")),
    "cc-by-nd": ("(?:creative commons attribution noderivatives|cc by nd)", ("2 0", "2 5", "3 0", "4 0"), ("creative commons", "cc by")),
    "cc-by-nc-sa": ("(?:creative commons attribution noncommercial sharealike|cc by nc sa)", ("2 0", "2 5", "3 0", "4 0"), ("creative commons", "cc by")),
    "cc-by-nc-nd": ("(?:creative commons attribution noncommercial noderivatives|cc by nc nd)", ("2 0", "2 5", "3 0", "4 0"), ("creative commons", "cc by")),
    "python": ("(?:the )?(?:python software foundation|psf)", ("2", "2 0"), ("python software", "psf")),
    "ms-pl": ("(?:the )?(?:microsoft public|ms pl)", (), ("microsoft public", "ms pl")),
    "proprietary": ("(?:a |the )?(?:proprietary|commercial)", (), ("proprietary", "commercial")),
}
_UNDER = "(?:licensed|released|distributed|published|available|provided) under "
#: (priority, score, keyword, template); N is the name, V the version. Every match of a rule holds its keyword, a pattern.
TEMPLATES = (
    (6, 0.98, "spdx", r"spdx licen[sc]e identifier N(?: V)?(?: only| or later)?"),
    (5, 0.95, _UNDER, _UNDER + r"(?:the terms of )?N(?: licen[sc]e)?(?: version)? V"),
    (4, 0.9, _UNDER, _UNDER + r"(?:the terms of )?N(?: licen[sc]e)?"),
    (3, 0.85, "licen", r"N licen[sc]e(?: version)? V"),
    (2, 0.8, "licen", r"N licen[sc]e"),
    (1, 0.6, "licen", r"licen[sc]e (?:is |type )?N"),
)
#: Signatures by hand: (priority, score, keyword that every match holds in one word, label, pattern).
SIGNATURES = (
    # However long the list of holders is, unless something that other rules find comes between.
    (1, 0.5, "reserved", "copyright", r"copyright (?:.{0,60}?|(?:(?!copyright |licen|permission is|redistribution and).)*?)all rights reserved"),
    (1, 0.4, "hereby", "mit-text", r"permission is hereby granted free of charge to any person"),
    (3, 0.8, "hereby", "mit-text", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    (2, 0.6, "sublicense", "mit-text", r"use copy modify merge publish distribute sublicense and or sell copies"),
    (2, 0.6, "permission", "mit-text", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    (2, 0.5, "noninfringement", "mit-text", r"the warranties of merchantability fitness for a particular purpose and noninfringement"),
    (3, 0.8, "hereby", "mit-0", r"permission is hereby granted free of charge to any person obtaining a copy .{0,200}? without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    (1, 0.4, "redistribution", "bsd-text", r"redistribution and use in source and binary forms"),
    (3, 0.8, "redistribution", "bsd-text", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (2, 0.6, "redistributions", "bsd-text", r"redistributions of source code must retain the above copyright notice"),
    (2, 0.6, "redistributions", "bsd-text", r"redistributions in binary form must reproduce the above copyright notice"),
    (3, 0.8, "endorse", "bsd-3-text", r"neither the names? of .{1,80}? nor the names of (?:its|their|the) contributors may be used to endorse or promote"),
    (3, 0.8, "advertising", "bsd-4-text", r"all advertising materials mentioning features or use of this software must display"),
    (2, 0.5, "copyright", "bsd-text", r"this software is provided by the (?:copyright holders|regents|author) (?:and contributors )?as is"),
    (3, 0.8, "fee", "isc-text", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    (2, 0.6, "fee", "isc-text", r"permission to use copy modify (?:and )?distribute this software (?:and its documentation )?for any purpose (?:with or )?without fee"),
    (3, 0.8, "fee", "0bsd-text", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    (2, 0.5, "disclaims", "isc-text", r"the author disclaims all warranties with regard to this software"),
    (3, 0.8, "apache", "apache-text", r"you may not use this file except in compliance with the license you may obtain a copy of the license at .{0,20}?apache org licenses"),
    (2, 0.6, "compliance", "apache-text", r"you may not use this (?:file|work|software) except in compliance with the license"),
    (2, 0.5, "conditions", "apache-text", r"without warranties or conditions of any kind either express or implied"),
    (2, 0.6, "contributor", "apache-text", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable"),
    (2, 0.6, "notice", "apache-text", r"if the work includes a notice text file as part of its distribution"),
    (2, 0.6, "apache", "apache-text", r"apache org licenses license 2 0"),
    (3, 0.8, "asf", "apache-text", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    (3, 0.8, "redistribute", "gpl-text", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    (2, 0.6, "redistribute", "gpl-text", r"is free software you can redistribute it and or modify it under"),
    (2, 0.6, "option", "gpl-text", r"either version [0-9](?: [0-9])? of the license or at your option any later version"),
    (2, 0.6, "hope", "gpl-text", r"distributed in the hope that it will be useful but without any warranty"),
    (2, 0.5, "received", "gpl-text", r"you should have received a copy of the gnu general public license"),
    (3, 0.8, "received", "lgpl-text", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    (3, 0.8, "received", "agpl-text", r"you should have received a copy of the gnu affero general public license"),
    (2, 0.6, "verbatim", "gnu-text", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    (3, 0.8, "remotely", "agpl-text", r"all users interacting with it remotely through a computer network"),
    (2, 0.6, "covered", "gpl-text", r"to convey a covered work"),
    (2, 0.6, "exception", "gpl-exception", r"as a special exception .{0,120}? permission to link"),
    (2, 0.6, "classpath", "gpl-exception", r"(?:gnu )?classpath exception"),
    (2, 0.6, "autoconf", "gpl-exception", r"autoconf (?:configure script )?exception"),
    (2, 0.6, "bison", "gpl-exception", r"bison (?:parser )?exception"),
    (2, 0.6, "gcc", "gpl-exception", r"gcc runtime library exception"),
    (2, 0.6, "openssl", "gpl-exception", r"openssl (?:linking )?exception"),
    (3, 0.8, "invariant", "gfdl", r"with no invariant sections (?:with )?no front cover texts"),
    (3, 0.8, "documentation", "gfdl", r"gnu free documentation license"),
    (3, 0.8, "subject", "mpl-text", r"this source code form is subject to the terms of the mozilla public license"),
    (2, 0.6, "incompatible", "mpl-text", r"incompatible with secondary licenses"),
    (2, 0.6, "mozilla", "mpl-text", r"mozilla org mpl(?: [0-9] [0-9])?"),
    (2, 0.6, "contents", "mpl-text", r"the contents of this file are subject to the mozilla public license"),
    (3, 0.8, "accompanying", "epl-text", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    (2, 0.6, "eclipse", "epl-text", r"eclipse org legal epl v[0-9]+"),
    (2, 0.6, "secondary", "epl-text", r"this source code may also be made available under the following secondary licenses"),
    (3, 0.8, "contents", "cddl-text", r"the contents of this file are subject to the terms of the common development and distribution license"),
    (2, 0.6, "opensolaris", "cddl-text", r"usr src opensolaris license"),
    (3, 0.8, "express", "zlib-text", r"this software is provided as is without any express or implied warranty in no event will the authors? be held liable"),
    (2, 0.6, "misrepresented", "zlib-text", r"the origin of this software must not be misrepresented"),
    (2, 0.6, "altered", "zlib-text", r"altered source versions must be plainly marked as such"),
    (3, 0.8, "accompanying", "boost-text", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    (2, 0.6, "boost", "boost-text", r"accompanied by the boost software license"),
    (2, 0.6, "boost", "boost-text", r"boost org license 1 0"),
    (3, 0.8, "unencumbered", "unlicense-text", r"this is free and unencumbered software released into the public domain"),
    (2, 0.6, "unlicense", "unlicense-text", r"(?:please )?refer to (?:http )?unlicense org"),
    (2, 0.5, "detriment", "unlicense-text", r"for the benefit of the public at large and to the detriment of our heirs and successors"),
    (2, 0.6, "domain", "public-domain", r"(?:released|placed|dedicated|donated) (?:in|into|to) the public domain"),
    (1, 0.4, "domain", "public-domain", r"(?:this (?:file|code|work|software|document) is|is hereby) in the public domain"),
    (3, 0.8, "waived", "cc0-text", r"has waived all copyright and related or neighboring rights"),
    (2, 0.6, "publicdomain", "cc0-text", r"creativecommons org publicdomain zero 1 0"),
    (2, 0.6, "creativecommons", "cc-url", r"creativecommons org licenses by(?: nc)?(?: nd| sa)? [0-9] [0-9]"),
    (2, 0.6, "commons", "cc-text", r"this work is licensed under (?:a|the) creative commons"),
    (2, 0.6, "appropriate", "cc-text", r"you must give appropriate credit provide a link to the license"),
    (2, 0.6, "remix", "cc-text", r"if you remix transform or build upon the material"),
    (2, 0.6, "commercial", "cc-text", r"you may not use the material for commercial purposes"),
    (3, 0.8, "fuck", "wtfpl-text", r"do what the fuck you want to public license"),
    (3, 0.8, "beer", "beerware", r"the beer ware license|buy me a beer in return"),
    (2, 0.6, "artistic", "artistic-text", r"copying (?:policy|terms) of the artistic license"),
    (2, 0.6, "perl", "perl-terms", r"(?:redistribute|modify) it (?:and or modify it )?under the same terms as perl(?: itself)?"),
    (2, 0.6, "ruby", "ruby-terms", r"under the (?:same )?terms (?:as|of) (?:the )?ruby(?: license)?"),
    (3, 0.8, "python", "python-text", r"psf is making python available to licensee on an as is basis"),
    (2, 0.6, "beopen", "python-text", r"beopen python open source license agreement"),
    (2, 0.6, "cnri", "python-text", r"cnri open source license agreement"),
    (3, 0.8, "php", "php", r"(?:the )?php license(?: version)?(?: v?3(?: 0[01])?)?"),
    (3, 0.8, "openssl", "openssl", r"openssl (?:toolkit )?license|this product includes software developed by the openssl project"),
    (3, 0.8, "ssleay", "openssl", r"(?:original )?ssleay license"),
    (3, 0.8, "x11", "x11", r"(?:the )?x11 license|mit x11"),
    (3, 0.8, "xfree86", "xfree86", r"(?:the )?xfree86 (?:project )?licen[sc]e"),
    (3, 0.8, "ncsa", "ncsa", r"(?:university of illinois )?(?:ncsa )?open source license ncsa|(?:illinois )?ncsa (?:open source )?license"),
    (3, 0.8, "curl", "curl", r"(?:the )?curl license"),
    (3, 0.8, "png", "libpng", r"(?:the )?(?:png reference library|libpng) license"),
    (3, 0.8, "jpeg", "ijg", r"this software is based in part on the work of the independent jpeg group"),
    (3, 0.8, "freetype", "ftl", r"(?:the )?freetype (?:project )?license"),
    (3, 0.8, "imagemagick", "imagemagick", r"(?:the )?imagemagick license"),
    (3, 0.8, "sleepycat", "sleepycat", r"(?:the )?sleepycat license"),
    (3, 0.8, "public", "qpl", r"(?:the )?q public license"),
    (3, 0.8, "qpl", "qpl", r"(?:the )?qpl(?: version)? 1 0"),
    (3, 0.8, "open", "osl", r"(?:the )?open software license(?: version)?(?: v?[1-3] [0-9])?"),
    (2, 0.6, "osl", "osl", r"osl [1-3] [0-9]"),
    (3, 0.8, "academic", "afl", r"(?:the )?academic free license(?: version)?(?: v?[1-3] [0-9])?"),
    (3, 0.8, "ecos", "ecos", r"(?:the )?ecos license"),
    (3, 0.8, "intel", "intel", r"intel (?:open source|simplified software) license"),
    (3, 0.8, "nasa", "nasa", r"nasa open source agreement"),
    (3, 0.8, "ibm", "ipl", r"(?:the )?ibm public license"),
    (3, 0.8, "lucent", "lpl", r"(?:the )?lucent public license"),
    (3, 0.8, "netscape", "npl", r"(?:the )?netscape public license"),
    (3, 0.8, "sun", "sun", r"sun (?:industry standards source|public) license"),
    (3, 0.8, "apple", "apsl", r"(?:the )?apple public source license"),
    (3, 0.8, "watcom", "watcom", r"sybase open watcom public license"),
    (3, 0.8, "ruby", "ruby", r"(?:the )?ruby license"),
    (3, 0.8, "vim", "vim", r"(?:the )?vim license|vim is charityware"),
    (3, 0.8, "tcl", "tcl", r"tcl tk license"),
    (3, 0.8, "unicode", "unicode", r"unicode (?:data files and software|inc) license(?: agreement)?"),
    (3, 0.8, "w3c", "w3c", r"w3c (?:software )?(?:notice and )?(?:document )?license"),
    (3, 0.8, "zope", "zpl", r"(?:the )?zope public license"),
    (3, 0.8, "cecill", "cecill", r"(?:the )?cecill(?: [bc])?(?: free software)? (?:license|licence|agreement)|licence cecill(?: [bc])?"),
    (3, 0.8, "licence", "etalab", r"licence ouverte(?: open licence)?"),
    (3, 0.8, "government", "ogl", r"(?:uk )?open government licen[sc]e(?: v[1-3])?"),
    (2, 0.6, "ogl", "ogl", r"ogl uk"),
    (3, 0.8, "odbl", "odbl", r"open (?:data commons open )?database license odbl|odbl(?: 1 0)?"),
    (3, 0.8, "pddl", "pddl", r"public domain dedication and license pddl|pddl 1 0"),
    (3, 0.8, "mulan", "mulan", r"mulan (?:permissive software|psl)"),
    (3, 0.8, "elastic", "elastic", r"(?:the )?elastic license(?: 2 0)?"),
    (3, 0.8, "sspl", "sspl", r"server side public license sspl|sspl(?: v?1)?"),
    (3, 0.8, "busl", "busl", r"business source license busl|busl 1 1"),
    (3, 0.8, "source", "busl", r"(?:the )?business source license(?: 1 [01])?"),
    (3, 0.8, "commons", "commons-clause", r"commons clause license condition"),
    (3, 0.8, "polyform", "polyform", r"polyform (?:noncommercial|small business|shield|strict|perimeter) license"),
    (3, 0.8, "rail", "openrail", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: license)?"),
    (3, 0.8, "responsible", "openrail", r"responsible ai license"),
    (3, 0.8, "community", "llm-community", r"(?:large )?(?:language )?model community license agreement"),
    (2, 0.6, "confidential", "proprietary-text", r"(?:company )?confidential and proprietary|proprietary and confidential"),
    (2, 0.6, "unauthorized", "proprietary-text", r"unauthorized (?:copying|reproduction|use|distribution) (?:or distribution )?of this (?:file|software|document|material)"),
    (2, 0.6, "prohibited", "proprietary-text", r"is strictly prohibited without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)"),
    (2, 0.6, "trade", "proprietary-text", r"contains (?:confidential|proprietary) information and trade secrets"),
    (2, 0.6, "reproduced", "proprietary-text", r"no part of this (?:publication|book|document|work) may be reproduced"),
    (2, 0.6, "personal", "personal-use", r"for (?:your )?personal (?:and )?non ?commercial use only|for personal use only"),
    (2, 0.6, "evaluation", "evaluation", r"for evaluation (?:purposes )?only"),
    (2, 0.6, "eula", "eula", r"end user licen[sc]e agreement eula|(?:this|the) eula"),
    (2, 0.6, "agreement", "eula", r"end user licen[sc]e agreement"),
    (2, 0.5, "freeware", "freeware", r"this (?:software|program) is freeware"),
    (2, 0.5, "shareware", "shareware", r"this (?:software|program) is shareware"),
    (2, 0.5, "warranty", "no-warranty", r"(?:there is|comes with|absolutely) no warranty"),
    (2, 0.5, "copyleft", "copyleft", r"copyleft (?:license|all rights reversed)"),
    (2, 0.5, "dual", "dual", r"dual licensed under"),
    (2, 0.5, "triple", "dual", r"tri(?:ple)? licensed under"),
    (2, 0.5, "disjunction", "dual", r"under a disjunction of"),
    (2, 0.4, "contributing", "contributor-agreement", r"by contributing you agree that your contributions will be licensed"),
    (2, 0.4, "cla", "contributor-agreement", r"contributor license agreement cla"),
    (2, 0.4, "certificate", "contributor-agreement", r"developer(?: s)? certificate of origin"),
    (2, 0.4, "copying", "see-file", r"see (?:the )?(?:file )?copying for (?:the )?(?:license|details|copying conditions)"),
    (2, 0.4, "licence", "see-file", r"see (?:the )?(?:accompanying )?licence(?: txt| md)?(?: file)? for"),
    (2, 0.4, "license", "see-file", r"see (?:the )?(?:accompanying )?license(?: txt| md)?(?: file)? for|(?:found|included|provided) in the license file"),
)

_WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_UPPER = {i: i + 32 for i in range(65, 91)}
#: Whether a byte of lower-cased UTF-8 belongs to a word.
_IN_WORD = np.array([48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128 for i in range(256)])
_UNDER_WORDS = re.compile(_UNDER.rstrip().replace(" ", r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"))


@lru_cache(maxsize=1)
def rules() -> tuple[dict[str, list], re.Pattern]:
    """keyword -> rules (hints, priority, score, label, regex), and a pattern that all texts with a keyword match.

    A rule is tried only where its keyword stands in a word, and, if it has hints, one of them in the line.
    """
    out: dict[str, list] = {}
    for label, (name, versions, hints) in FAMILIES.items():
        for priority, score, keyword, template in TEMPLATES:
            body = template.replace("N", name)
            if "V" in template and not template.endswith(")?"):
                bodies = [body.replace("V", f"v?{v}") for v in versions]
            else:
                bodies = [body.replace("V", "(?:v?(?:" + "|".join(versions or ("[0-9]+",)) + "))")]
            for b in bodies:
                out.setdefault("under" if keyword == _UNDER else keyword, []).append((hints, priority, score, label, re.compile(rf"\b{b}\b")))
    for priority, score, keyword, label, body in SIGNATURES:
        out.setdefault(keyword, []).append(((), priority, score, label, re.compile(rf"\b(?:{body})\b")))
    return out, re.compile("|".join(sorted(map(re.escape, set(out) - {"under"}))))


def _may_match(text: str) -> bool:
    low = text.lower()
    return rules()[1].search(low) is not None or ("under" in low and _UNDER_WORDS.search(low) is not None)


def outermost(found: list[tuple]) -> list[tuple]:
    """The detections (priority, start, end, label, ...) that lie in no other of equal or higher priority.

    One sweep for each priority, from the highest, over what stays of those above; of equal ones the first label stays.
    """
    stay: list[tuple] = []
    for priority in sorted({f[0] for f in found}, reverse=True):
        own = sorted([f for f in found if f[0] == priority], key=lambda f: f[3])
        far, above, new = -1, len(stay), []
        for rank, f in sorted(enumerate(stay + own), key=lambda x: (x[1][1], -x[1][2], x[0])):
            if rank >= above and f[2] > far:
                new.append(f)
            far = max(far, f[2])
        stay += new
    return stay


def count_words(text: str) -> int:
    inside = _IN_WORD[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    return int(np.count_nonzero(inside[1:] & ~inside[:-1]) + inside[0]) if len(inside) else 0


def scan(text: str) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int, int, float]]]:
    """Number of words, base places (label, word), detections (label, first word, end word, priority, score)."""
    if not _may_match(text):
        return count_words(text), [], []
    words = _WORDS.findall(text.translate(_UPPER))
    places = []
    for i, w in enumerate(words):
        if w == "license":
            for phrase, label in PHRASES:
                p = phrase.split()
                if i + 1 >= len(p) and words[i + 1 - len(p) : i + 1] == p:
                    places.append((label, i + 1 - len(p)))
    line, starts, at = " ".join(words), [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    found = []
    for keyword, group in rules()[0].items():
        if keyword in line:
            for hints, priority, score, label, regex in group:
                if not hints or any(h in line for h in hints):
                    found += [(priority, m.start(), m.end(), label, score) for m in regex.finditer(line)]
    stay = outermost(found)
    stay.sort(key=lambda x: (x[1], x[2], x[3]))
    word = lambda i: bisect_right(starts, i) - 1
    return len(words), places, [(label, word(s), word(e - 1) + 1, p, score) for p, s, e, label, score in stay]


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, ``places`` of base phrases and ``detections`` by the rules, for every row.

    Null text counts as empty: no words, no places. A null id is carried through; repeated rows each give
    a row; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, places, found = [], [], []
            for text in pdf["t"]:
                k, p, f = scan(text)
                n.append(k)
                places.append([{"label": a, "word": b} for a, b in p])
                found.append([{"label": a, "first": b, "end": c, "priority": d, "score": e} for a, b, c, d, e in f])
            yield pd.DataFrame({"doc_id": pdf["id"], "n_words": n, "places": places, "detections": found})

    schema = (
        "doc_id long, n_words long, places array<struct<label string, word long>>, "
        "detections array<struct<label string, first long, end long, priority int, score double>>"
    )
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``detect``; the score is that of the best detection, 0.75 for a base phrase alone."""
    base = F.transform("places", lambda x: x["label"])
    own = F.transform("detections", lambda x: x["label"])
    word = F.transform("places", lambda x: x["word"])
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(
            F.when(F.size("places") > 0, F.lit(0.75)).otherwise(F.lit(0.0)),
            F.coalesce(F.array_max(F.transform("detections", lambda x: x["score"])), F.lit(0.0)),
        ).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(detect(table(spark, sf_dir, "documents")))
