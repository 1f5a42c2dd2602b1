"""License scans: ordered signature rules behind a keyword prefilter, with priority and interval containment.

Some rules are built from one row per license (name pattern, identifier, versions, address) and one row per way of citing it;
others are written one by one: the licenses' own wording and the short names in use. Words of a citation may stand any run of
white space and comment marks apart, words of a wording any run of what is no word.
A rule's regexes run only on texts that hold its keywords. Detections are taken in order of priority; one that lies inside
an accepted detection, or repeats its interval, is suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame

from . import common

#: Phrases of the base and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Licenses: label, name pattern (lower case), short identifier, versions, keyword of the name, address or none.
LICENSES = (
    ("mit", r"mit(?:/x11)?", "mit", (), "mit", r"opensource\.org/licenses/mit"),
    ("apache", r"apache(?: software)?", "apache", ("1.0", "1.1", "2.0"), "apache", r"apache\.org/licenses"),
    ("gpl", r"(?:gnu )?general public", "gpl", ("1.0", "2.0", "3.0"), "general public", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public", "lgpl", ("2.0", "2.1", "3.0"), "general public", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("agpl", r"(?:gnu )?affero general public", "agpl", ("1.0", "3.0"), "general public", r"gnu\.org/licenses/agpl"),
    ("gfdl", r"(?:gnu )?free documentation", "gfdl", ("1.1", "1.2", "1.3"), "free documentation", r"gnu\.org/licenses/fdl"),
    ("mpl", r"mozilla public", "mpl", ("1.0", "1.1", "2.0"), "mozilla", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", r"eclipse public", "epl", ("1.0", "2.0"), "eclipse", r"eclipse\.org/legal/epl"),
    ("cddl", r"common development and distribution", "cddl", ("1.0", "1.1"), "common development", None),
    ("cpl", r"common public", "cpl", ("1.0",), "common public", None),
    ("bsd-2-clause", r"(?:simplified|two-clause|2-clause|freebsd) bsd", "bsd-2-clause", (), "bsd", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", r"(?:new|modified|revised|three-clause|3-clause) bsd", "bsd-3-clause", (), "bsd", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", r"(?:original|four-clause|4-clause) bsd", "bsd-4-clause", (), "bsd", None),
    ("0bsd", r"(?:zero-clause|0-clause) bsd", "0bsd", (), "bsd", None),
    ("bsd", r"bsd", "bsd", (), "bsd", r"opensource\.org/licenses/bsd-license"),
    ("isc", r"isc", "isc", (), "isc", r"opensource\.org/licenses/isc"),
    ("zlib", r"zlib(?:/libpng)?", "zlib", (), "zlib", r"zlib\.net/zlib_license"),
    ("bsl", r"boost software", "bsl", ("1.0",), "boost", r"boost\.org/license"),
    ("artistic", r"(?:perl )?artistic", "artistic", ("1.0", "2.0"), "artistic", r"opensource\.org/licenses/artistic"),
    ("eupl", r"european union public", "eupl", ("1.0", "1.1", "1.2"), "european union public", None),
    ("unlicense", r"the unlicense", "unlicense", (), "unlicense", r"unlicense\.org"),
    ("wtfpl", r"do what the fuck you want to public", "wtfpl", ("2.0",), "want to public", r"wtfpl\.net"),
    ("ofl", r"(?:sil )?open font", "ofl", ("1.0", "1.1"), "open font", r"scripts\.sil\.org/ofl"),
    ("odbl", r"open database", "odbl", ("1.0",), "open database", r"opendatacommons\.org/licenses/odbl"),
    ("pddl", r"public domain dedication and", "pddl", ("1.0",), "public domain dedication", None),
    ("odc-by", r"open data commons attribution", "odc-by", ("1.0",), "open data commons", r"opendatacommons\.org/licenses/by"),
    ("ms-pl", r"microsoft public", "ms-pl", (), "microsoft public", None),
    ("ms-rl", r"microsoft reciprocal", "ms-rl", (), "microsoft reciprocal", None),
    ("psf", r"python software foundation", "psf", ("2.0",), "python software", None),
    ("php", r"php", "php", ("3.0", "3.01"), "php", r"php\.net/license"),
    ("postgresql", r"postgresql", "postgresql", (), "postgresql", None),
    ("openssl", r"openssl", "openssl", (), "openssl", None),
    ("ncsa", r"(?:university of illinois/)?ncsa(?: open source)?", "ncsa", (), "ncsa", None),
    ("upl", r"universal permissive", "upl", ("1.0",), "universal permissive", None),
    ("afl", r"academic free", "afl", ("2.1", "3.0"), "academic free", None),
    ("osl", r"open software", "osl", ("2.1", "3.0"), "open software", None),
    ("cc-by", r"creative commons attribution", "cc-by", ("2.0", "3.0", "4.0"), "creative commons", r"creativecommons\.org/licenses/by"),
    ("cc-by-sa", r"creative commons attribution[- ]share[- ]?alike", "cc-by-sa", ("2.0", "3.0", "4.0"), "creative commons", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nc", r"creative commons attribution[- ]non[- ]?commercial", "cc-by-nc", ("2.0", "3.0", "4.0"), "creative commons", r"creativecommons\.org/licenses/by-nc"),
    ("cc-by-nd", r"creative commons attribution[- ]no[- ]?derivatives", "cc-by-nd", ("2.0", "3.0", "4.0"), "creative commons", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc-sa", r"creative commons attribution[- ]non[- ]?commercial[- ]share[- ]?alike", "cc-by-nc-sa", ("2.0", "3.0", "4.0"), "creative commons", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", r"creative commons attribution[- ]non[- ]?commercial[- ]no[- ]?derivatives", "cc-by-nc-nd", ("2.0", "3.0", "4.0"), "creative commons", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc0", r"(?:creative commons )?(?:cc0|cc zero)(?: universal)?", "cc0", ("1.0",), "cc", r"creativecommons\.org/publicdomain/zero"),
)

#: Ways of citing: name, priority, score, pattern over {name}, {id}, {version}, {url}; the literals that a text must hold (else the name's keyword).
CITATIONS = (
    ("tag", 100, 1.0, r"spdx-license-identifier:[ \t]*+{id}{idversion}(?:-only|-or-later|\+)?(?![\w.-])", "spdx-license-identifier"),
    ("url", 90, 0.95, r"https?://(?:www\.)?{url}[-/]{version}", "http"),
    ("notice", 80, 0.95, r"(?:licen[sc]ed|released|distributed|available|published)(?: by(?: [\w.,&]+){{1,20}}?)? under (?:the )?(?:terms of (?:the )?)?{name}(?: international)? (?:public )?licen[sc]e,? \(?(?:version |v)?{version}\)?", ("under", "licen")),
    ("short notice", 75, 0.9, r"(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{spaced}[- ]v?{version}", ("under", "{word}")),
    ("name", 60, 0.85, r"(?<!\w){name} licen[sc]e,? \(?(?:version |v)?{version}\)?", None),
    ("identifier", 50, 0.8, r"(?<![\w.-]){id}-v?{version}(?:-only|-or-later|\+)?(?![\w-])", "{id}-"),
)
#: Citing without a version, at a lower priority than any citing with one.
PLAIN = (
    ("url", 48, 0.8, r"https?://(?:www\.)?{url}", "http"),
    ("notice", 45, 0.85, r"(?:licen[sc]ed|released|distributed|available|published)(?: by(?: [\w.,&]+){{1,20}}?)? under (?:the )?(?:terms of (?:the )?)?{name} licen[sc]e", ("under", "licen")),
    ("short notice", 42, 0.7, r"(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{spaced}(?![\w-])", ("under", "{word}")),
    ("name", 40, 0.75, r"(?<!\w){name} licen[sc]e(?!\w)", None),
)
#: Citing a license that has no versions.
UNVERSIONED = (
    ("tag", 100, 1.0, r"spdx-license-identifier:[ \t]*+{id}(?![\w.-])", "spdx-license-identifier"),
    ("identifier", 50, 0.8, r"(?<![\w.-]){id}(?![\w-])", "{id}"),
)
#: Between words of a citation, and between words of a license's own text. Both give nothing back, so matching is linear.
APART = r"[\s#*/;-]++"
NO_WORDS = r"[^\w]++"

BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
ADVERTISING = "advertising materials mentioning features or use of this software must display"
ENDORSE = "be used to endorse or promote products derived from this software without"
GRANT = "permission to use copy modify and? distribute this software for any purpose with or without fee is hereby granted"
#: Licenses' own wording: label, priority, score, its opening words, words that must follow before the next such opening.
WORDINGS = (
    ("bsd-4-clause", 74, 1.0, BSD, (ADVERTISING, ENDORSE)),
    ("bsd-4-clause", 73, 1.0, BSD, (ADVERTISING,)),
    ("bsd-3-clause", 72, 1.0, BSD, (ENDORSE,)),
    ("bsd-2-clause", 71, 0.95, BSD, ()),
    ("mit", 70, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("the above copyright notice and this permission notice shall be included in all copies",)),
    ("isc", 70, 1.0, GRANT + " provided that the above copyright notice and this permission notice appear in all copies", ()),
    ("0bsd", 69, 1.0, GRANT + " the software is provided as is", ()),
    ("apache-2.0", 85, 1.0, "apache license version 2.0 january 2004", ()),
    ("gpl-1.0", 85, 1.0, "gnu general public license version 1 february 1989", ()),
    ("gpl-2.0", 85, 1.0, "gnu general public license version 2 june 1991", ()),
    ("gpl-3.0", 85, 1.0, "gnu general public license version 3 29 june 2007", ()),
    ("lgpl-2.1", 85, 1.0, "gnu lesser general public license version 2.1 february 1999", ()),
    ("lgpl-3.0", 85, 1.0, "gnu lesser general public license version 3 29 june 2007", ()),
    ("agpl-3.0", 85, 1.0, "gnu affero general public license version 3 19 november 2007", ()),
    ("mpl-2.0", 85, 1.0, "this source code form is subject to the terms of the mozilla public license v 2.0", ()),
    ("mpl-1.1", 85, 1.0, "the contents of this file are subject to the mozilla public license version 1.1", ()),
    ("mpl-1.0", 85, 1.0, "the contents of this file are subject to the mozilla public license version 1.0", ()),
    ("npl-1.1", 85, 1.0, "the contents of this file are subject to the netscape public license version 1.1", ()),
    ("epl-1.0", 85, 1.0, "this program and the accompanying materials are made available under the terms of the eclipse public license v1.0", ()),
    ("epl-2.0", 85, 1.0, "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0", ()),
    ("epl-2.0", 80, 1.0, "the accompanying program is provided under the terms of this eclipse public license", ()),
    ("cpl-1.0", 80, 1.0, "the accompanying program is provided under the terms of this common public license", ()),
    ("cddl", 80, 1.0, "the contents of this file are subject to the terms of the common development and distribution license", ()),
    ("apache-1.1", 76, 1.0, BSD, ("this product includes software developed by the apache software foundation",)),
    ("openssl", 76, 1.0, BSD, ("this product includes software developed by the openssl project",)),
    ("php", 76, 1.0, BSD, ("this product includes php software",)),
    ("sleepycat", 76, 1.0, BSD, ("redistributions in any form must be accompanied by information on how to obtain complete source code",)),
    ("ncsa", 72, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction", ()),
    ("x11", 72, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("shall not be used in advertising or otherwise to promote the sale use or other dealings in this software",)),
    ("json", 72, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("the software shall be used for good not evil",)),
    ("upl-1.0", 70, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of this software associated documentation and or data", ()),
    ("ofl-1.1", 70, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of the font software", ()),
    ("unicode", 70, 1.0, "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", ()),
    ("bsl-1.0", 70, 1.0, "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ()),
    ("zlib", 70, 1.0, "in no event will the authors be held liable for any damages arising from the use of this software", ("altered source versions must be plainly marked as such",)),
    ("unlicense", 70, 1.0, "this is free and unencumbered software released into the public domain", ()),
    ("wtfpl-2.0", 70, 1.0, "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ()),
    ("hpnd", 70, 1.0, "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", ()),
    ("ntp", 71, 1.0, "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", ()),
    ("postgresql", 70, 1.0, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ()),
    ("tcl", 70, 1.0, "the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", ()),
    ("psf-2.0", 70, 1.0, "this license agreement is between the python software foundation", ()),
    ("artistic-2.0", 70, 1.0, "this license establishes the terms under which a given free software package may be copied modified distributed and? redistributed", ()),
    ("artistic-1.0", 70, 1.0, "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control", ()),
    ("ruby", 70, 1.0, "you may make and give away verbatim copies of the source form of the software without restriction", ()),
    ("ms-rl", 71, 1.0, "this license governs use of the accompanying software if you use the software you accept this license", ("reciprocal grants",)),
    ("ms-pl", 70, 1.0, "this license governs use of the accompanying software if you use the software you accept this license", ()),
    ("cc0-1.0", 70, 1.0, "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders", ()),
    ("cc0-1.0", 70, 0.95, "has dedicated the work to the public domain by waiving all of his or her rights to the work", ()),
    ("w3c", 70, 1.0, "by obtaining using and? copying this work you the licensee agree that you have read understood and will comply with the following terms", ()),
    ("libpng", 70, 1.0, "the png reference library is supplied as is", ()),
    ("ijg", 70, 0.9, "this software is based in part on the work of the independent jpeg group", ()),
    ("vim", 70, 1.0, "there are no restrictions on distributing unmodified copies of vim", ()),
    ("beerware", 70, 1.0, "as long as you retain this notice you can do whatever you want with this stuff", ()),
    ("odbl-1.0", 70, 1.0, "this database is made available under the open database license", ()),
    ("odc-by-1.0", 70, 1.0, "this database is made available under the open data commons attribution license", ()),
    ("pddl-1.0", 70, 1.0, "this database is made available under the public domain dedication and license", ()),
    ("eupl", 70, 0.95, "you may not use this work except in compliance with the licence", ()),
    ("apache-2.0", 70, 0.95, "you may not use this file except in compliance with the license", ("distributed on an as is basis without warranties or conditions of any kind",)),
    ("public-domain", 30, 0.8, "this work is hereby released into the public domain", ()),
    ("public-domain", 30, 0.8, "has been placed in the public domain", ()),
    ("public-domain", 30, 0.8, "this software is in the public domain", ()),
    ("public-domain", 30, 0.8, "this file is in the public domain", ()),
    ("public-domain", 30, 0.8, "dedicated to the public domain", ()),
    ("proprietary", 30, 0.8, "unauthorized copying of this file via any medium is strictly prohibited", ()),
    ("proprietary", 30, 0.7, "this software is confidential and proprietary", ()),
    ("proprietary", 30, 0.7, "may not be reproduced or distributed without the prior written permission of", ()),
)
#: Short names as people write them: label, priority, pattern, keyword.
SHORT_NAMES = (
    ("gpl-2.0", 46, r"(?<![\w-])(?:gnu )?gpl[ -]?v?2(?:\.0)?\+?(?![\w.]|-\w)", "gpl"),
    ("gpl-3.0", 46, r"(?<![\w-])(?:gnu )?gpl[ -]?v?3(?:\.0)?\+?(?![\w.]|-\w)", "gpl"),
    ("lgpl-2.0", 46, r"(?<![\w-])(?:gnu )?lgpl[ -]?v?2(?:\.0)?\+?(?![\w.]|-\w)", "lgpl"),
    ("lgpl-2.1", 46, r"(?<![\w-])(?:gnu )?lgpl[ -]?v?2\.1\+?(?![\w.]|-\w)", "lgpl"),
    ("lgpl-3.0", 46, r"(?<![\w-])(?:gnu )?lgpl[ -]?v?3(?:\.0)?\+?(?![\w.]|-\w)", "lgpl"),
    ("agpl-3.0", 46, r"(?<![\w-])(?:gnu )?agpl[ -]?v?3(?:\.0)?\+?(?![\w.]|-\w)", "agpl"),
    ("apache-2.0", 46, r"(?<![\w-])asl[ -]?v?2(?:\.0)?(?![\w.])", "asl"),
    ("apache-2.0", 46, r"(?<![\w-])apache[ -]v?2(?:\.0)?(?![\w.])", "apache"),
    ("mpl-1.1", 46, r"(?<![\w-])mpl[ -]?v?1\.1(?![\w.])", "mpl"),
    ("mpl-2.0", 46, r"(?<![\w-])mpl[ -]?v?2(?:\.0)?(?![\w.])", "mpl"),
    ("epl-1.0", 46, r"(?<![\w-])epl[ -]?v?1(?:\.0)?(?![\w.])", "epl"),
    ("epl-2.0", 46, r"(?<![\w-])epl[ -]?v?2(?:\.0)?(?![\w.])", "epl"),
    ("cc0", 46, r"(?<![\w-])cc0(?:[ -]1\.0)?(?![\w.-])", "cc0"),
    ("cc-by-4.0", 46, r"(?<![\w-])cc[ -]by[ -]4\.0(?![\w.])", "cc"),
    ("cc-by-3.0", 46, r"(?<![\w-])cc[ -]by[ -]3\.0(?![\w.])", "cc"),
    ("cc-by-sa-4.0", 46, r"(?<![\w-])cc[ -]by[ -]sa[ -]4\.0(?![\w.])", "cc"),
    ("cc-by-sa-3.0", 46, r"(?<![\w-])cc[ -]by[ -]sa[ -]3\.0(?![\w.])", "cc"),
    ("cc-by-nc-4.0", 46, r"(?<![\w-])cc[ -]by[ -]nc[ -]4\.0(?![\w.])", "cc"),
    ("cc-by-nc-sa-4.0", 46, r"(?<![\w-])cc[ -]by[ -]nc[ -]sa[ -]4\.0(?![\w.])", "cc"),
    ("cc-by-nd-4.0", 46, r"(?<![\w-])cc[ -]by[ -]nd[ -]4\.0(?![\w.])", "cc"),
)
#: The GNU licenses' notice names the version after the publisher.
GNU_NOTICE = r"{name} licen[sc]e,? as published by the free software foundation[,;:]?(?: either)?(?: version| v) ?{version}"


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    priority: int
    score: float
    pattern: re.Pattern
    keywords: tuple[str, ...]  # all must be in the text
    then: tuple[re.Pattern, ...] = ()  # all must follow before the pattern's next place; the detection ends with the last

    def places(self, text: str) -> Iterator[tuple[int, int]]:
        if not self.then:
            yield from (m.span() for m in self.pattern.finditer(text))
            return
        spans = [m.span() for m in self.pattern.finditer(text)]
        for k, (start, end) in enumerate(spans):
            stop = spans[k + 1][0] if k + 1 < len(spans) else len(text)
            found = [p.search(text, end, stop) for p in self.then]
            if all(found):
                yield start, max(m.end() for m in found)


def version_pattern(version: str) -> str:
    """1.0 is also cited as 1; 2.1 only as 2.1."""
    major, minor = version.split(".")
    return rf"{major}(?:\.0)?(?![\w]|\.\d)" if minor == "0" else rf"{major}\.{minor}(?![\w]|\.\d)"


def apart(pattern: str) -> str:
    """The pattern with any run of white space and comment marks for each blank, and for each blank or hyphen."""
    pattern = pattern.replace("[- ]?", f"(?:{APART})?").replace("[- ]", APART)
    return re.sub(r" (\??)(?![^\[]*\])", lambda m: f"(?:{APART})?" if m[1] else APART, pattern)


def wording(words: str) -> re.Pattern:
    """Words in order, parted by whatever is no word; one with a question mark may also be 'or' with it, as in and/or."""
    parts = [r"and(?:[^\w]++or)?" if w == "and?" else NO_WORDS.join(map(re.escape, w.split("."))) for w in words.split()]
    return re.compile(rf"(?<!\w){NO_WORDS.join(parts)}(?!\w)")


def wording_rules() -> list[Rule]:
    # The two longest words of the opening are the gate.
    gate = lambda words: tuple(sorted(sorted({w for w in words.split() if w.isalpha()}, key=lambda w: (-len(w), w))[:2]))
    return [Rule(label, "wording", priority, score, wording(opening), gate(opening), tuple(map(wording, then))) for label, priority, score, opening, then in WORDINGS]


def signature_rules() -> list[Rule]:
    """All rules, highest priority first; among equals the longer label first, so that the more specific one wins."""
    rules = wording_rules()
    rules += [Rule(label, "short name", priority, 0.7, re.compile(apart(pattern)), (keyword,)) for label, priority, pattern, keyword in SHORT_NAMES]
    for label, name, short, versions, keyword, url in LICENSES:
        own_id = [c for c in UNVERSIONED if not versions and (c[0] == "tag" or "-" in short)]
        for version in (*versions, None):
            for kind, priority, score, text, key in CITATIONS if version else (*PLAIN, *own_id):
                if "{url}" in text and not url:
                    continue
                v = version_pattern(version) if version else ""
                parts = {"name": name, "id": re.escape(short), "spaced": re.escape(short).replace(r"cc\-", "cc[- ]"), "version": v, "idversion": f"-{v}", "url": url}
                pattern = text.format(**parts)
                if kind != "tag":
                    pattern = apart(pattern)
                # The words of a keyword may stand apart as well, so each is looked for.
                keywords = tuple(k.format(id=short, word=short.split("-")[0]) for k in (key if isinstance(key, tuple) else (key,) if key else (*keyword.split(), "licen")))
                rules.append(Rule(f"{label}-{version}" if version else label, kind, priority, score, re.compile(pattern), keywords))
            if version and label in ("gpl", "lgpl", "agpl"):
                pattern = apart(GNU_NOTICE.format(name=name, version=v))
                rules.append(Rule(f"{label}-{version}", "gnu notice", 80, 0.95, re.compile(pattern), ("foundation", "general", "licen", "public")))
    return sorted(rules, key=lambda r: (-r.priority, -len(r.label)))


def uncontained(found: list[tuple]) -> list[tuple]:
    """Of (start, end, ...) in order of priority, those that lie inside none that is accepted before them. A tree over the
    starts holds the largest end accepted so far from each on, so each detection takes logarithmic time."""
    starts = sorted({s for s, *_ in found})
    place = {s: i + 1 for i, s in enumerate(starts)}
    furthest = [-1] * (len(starts) + 1)
    kept = []
    for one in found:
        start, end = one[:2]
        i, most = place[start], -1
        while i:
            most = max(most, furthest[i])
            i &= i - 1
        if most >= end:
            continue
        kept.append(one)
        i = place[start]
        while i < len(furthest):
            furthest[i] = max(furthest[i], end)
            i += i & -i
    return kept


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z in lower case; every byte that is no word byte becomes a space. Words: digits, a-z and all of 0x80 and above.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Scanner:
    def __init__(self):
        self.rules = signature_rules()
        gates: dict[tuple[str, ...], list[tuple[int, Rule]]] = {}
        for i, rule in enumerate(self.rules):
            gates.setdefault(rule.keywords, []).append((i, rule))
        self.gates = sorted(gates.items())
        self.phrases = [(phrase.encode().split(), label) for phrase, label in BASE]

    def base(self, words: list[bytes]) -> tuple[list[int], set[str]]:
        """Start words of all places of the base's phrases, and their labels."""
        places, labels = [], set()
        for phrase, label in self.phrases:
            at = -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at : at + len(phrase)] == phrase:
                    places.append(at)
                    labels.add(label)
        return places, labels

    def signatures(self, text: str) -> list[tuple[int, int, Rule]]:
        """Accepted detections in a lower-case text."""
        present: dict[str, bool] = {}
        open_rules = []
        for keywords, rules in self.gates:
            for k in keywords:
                if k not in present:
                    present[k] = k in text
                if not present[k]:
                    break
            else:
                open_rules += rules
        return uncontained([(start, end, rule) for _, rule in sorted(open_rules, key=lambda x: x[0]) for start, end in rule.places(text)])

    def scan(self, text: str) -> tuple[int, list[int], set[str], set[str], float]:
        """Number of words, base places and labels, all labels, score."""
        data = text.encode()
        flat = data.translate(WORDS)
        words = flat.split()
        places, base = self.base(words) if b"license" in flat else ([], set())
        found = self.signatures(data.translate(LOWER).decode())
        score = max([0.75 if base else 0.0, *(r.score for _, _, r in found)])
        return len(words), places, base, base | {r.label for _, _, r in found}, score


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row's whole text.

    A null or empty text has no words, null places, empty label lists and score 0. Repeated rows give repeated results;
    an empty table gives no rows; other columns are ignored.
    """

    def make():
        scan = scanner().scan

        def handle(ids, values):
            found = [scan(t) for t in values]
            return {
                "doc_id": ids,
                "n_words": [n for n, *_ in found],
                "n_base": [len(p) for _, p, *_ in found],
                "first_word": [min(p, default=None) for _, p, *_ in found],
                "last_word": [max(p, default=None) for _, p, *_ in found],
                "base_labels": [",".join(sorted(b)) for _, _, b, _, _ in found],
                "labels": [",".join(sorted(x)) for _, _, _, x, _ in found],
                "score": [s for *_, s in found],
            }

        return handle

    return common.map_texts(docs, make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", id_col, text_col)
