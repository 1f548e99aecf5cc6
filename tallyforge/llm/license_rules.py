"""Signature rules of the licence scan, written by hand, in order.

A rule is (label, priority, keyword, pattern). Patterns match the text's words
joined by single blanks, lower-case, so punctuation and line breaks are gone:
"Apache License, Version 2.0" is "apache license version 2 0". A rule runs only
where its keyword occurs, so each text that the pattern matches must have it
(tested with texts made from the patterns). Priority 9 is a full notice, 7 a named licence with
its version, 5 a bare name, 3 a hint; within a priority the order decides.
"""

from __future__ import annotations

NOTICE, VERSIONED, NAMED, HINT = 9, 7, 5, 3

#: Families whose names stand in running text: (label, keyword, name, versions).
#: Each gives a notice, a tag, a versioned and a bare rule; versions are (label suffix, pattern).
_FAMILIES = [
    ("apache", "apache", r"apache(?: software)? licen[cs]e", [("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2(?: 0)?")]),
    ("gpl", "general public", r"(?:gnu )?general public licen[cs]e", [("1.0", "1(?: 0)?"), ("2.0", "2(?: 0)?"), ("3.0", "3(?: 0)?")]),
    ("lgpl", "lesser general", r"(?:gnu )?lesser general public licen[cs]e", [("2.1", "2 1"), ("3.0", "3(?: 0)?")]),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[cs]e", [("2.0", "2(?: 0)?")]),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e", [("1.0", "1(?: 0)?"), ("3.0", "3(?: 0)?")]),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e", [("1.1", "1 1"), ("1.2", "1 2"), ("1.3", "1 3")]),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", [("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2(?: 0)?")]),
    ("epl", "eclipse", r"eclipse public licen[cs]e", [("1.0", "1 0"), ("2.0", "2(?: 0)?")]),
    ("edl", "eclipse", r"eclipse distribution licen[cs]e", [("1.0", "1 0")]),
    ("cddl", "common development", r"common development and distribution licen[cs]e", [("1.0", "1 0"), ("1.1", "1 1")]),
    ("cpl", "common public", r"common public licen[cs]e", [("1.0", "1 0")]),
    ("ipl", "ibm", r"ibm public licen[cs]e", [("1.0", "1 0")]),
    ("eupl", "european union", r"european union public licen[cs]e", [("1.1", "1 1"), ("1.2", "1 2")]),
    ("artistic", "artistic", r"artistic licen[cs]e", [("1.0", "1 0"), ("2.0", "2(?: 0)?")]),
    ("boost", "boost", r"boost software licen[cs]e", [("1.0", "1 0")]),
    ("zpl", "zope", r"zope public licen[cs]e", [("2.0", "2 0"), ("2.1", "2 1")]),
    ("php", "php", r"php licen[cs]e", [("3.0", "3 0"), ("3.01", "3 01")]),
    ("python", "python", r"python(?: software foundation)? licen[cs]e", [("2.0", "2(?: 0)?")]),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e", [("1.0", "1 0"), ("1.1", "1 1")]),
    ("odbl", "open database", r"open database licen[cs]e", [("1.0", "1 0")]),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e", [("1.0", "1 0")]),
    ("pddl", "public domain", r"(?:open data commons )?public domain dedication and licen[cs]e", [("1.0", "1 0")]),
    ("ogl", "open government", r"open government licen[cs]e", [("1.0", "1 0"), ("2.0", "2 0"), ("3.0", "3 0")]),
    ("osl", "open software", r"open software licen[cs]e", [("1.0", "1 0"), ("2.1", "2 1"), ("3.0", "3 0")]),
    ("afl", "academic free", r"academic free licen[cs]e", [("2.1", "2 1"), ("3.0", "3 0")]),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", []),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e", []),
    ("mit", "mit", r"mit licen[cs]e", []),
    ("mit-0", "no attribution", r"mit no attribution licen[cs]e", []),
    ("isc", "isc", r"isc licen[cs]e", []),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source licen[cs]e", []),
    ("bsd", "bsd", r"bsd(?: style)? licen[cs]e", []),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd) licen[cs]e", []),
    ("bsd-3-clause", "bsd", r"(?:(?:new|revised|modified) bsd|bsd 3 clause|3 clause bsd) licen[cs]e", []),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd) licen[cs]e", []),
    ("bsd-0-clause", "bsd", r"(?:zero clause bsd|bsd 0 clause|0bsd) licen[cs]e", []),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", []),
    ("libpng", "libpng", r"libpng licen[cs]e", [("2.0", "2 0")]),
    ("openssl", "openssl", r"openssl licen[cs]e", []),
    ("unlicense", "unlicense", r"unlicense", []),
    ("wtfpl", "wtfpl", r"wtfpl", [("2.0", "2(?: 0)?")]),
    ("beerware", "beerware", r"beerware(?: licen[cs]e)?", []),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", []),
    ("ruby", "ruby", r"ruby licen[cs]e", []),
    ("perl", "perl", r"perl(?: 5)? licen[cs]e", []),
    ("tex", "latex", r"latex project public licen[cs]e", [("1.3c", "1 3c")]),
    ("vim", "vim", r"vim licen[cs]e", []),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)? licen[cs]e", []),
    ("x11", "x11", r"x11 licen[cs]e", []),
    ("curl", "curl", r"curl licen[cs]e", []),
    ("icu", "unicode", r"unicode licen[cs]e", []),
    ("icu", "icu", r"icu licen[cs]e", []),
    ("ecl", "educational community", r"educational community licen[cs]e", [("1.0", "1 0"), ("2.0", "2 0")]),
    ("sspl", "server side", r"server side public licen[cs]e", [("1.0", "1(?: 0)?")]),
    ("bsl", "business source", r"business source licen[cs]e", [("1.1", "1 1")]),
    ("elastic", "elastic", r"elastic licen[cs]e", [("2.0", "2(?: 0)?")]),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield) licen[cs]e", [("1.0.0", "1 0 0")]),
    ("openrail", "rail", r"open ?rail(?: m)? licen[cs]e", []),
    ("openrail", "responsible ai", r"responsible ai(?: m)? licen[cs]e", []),
    ("cecill", "cecill", r"cecill(?: b| c)?(?: licen[cs]e)?", [("2.1", "2 1")]),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", [("1.0", "1 0")]),
    ("mulan", "mulan", r"mulan (?:psl|permissive software licen[cs]e)", [("2.0", "2(?: 0)?")]),
]

#: Parts of the Creative Commons names: (label, words).
_COMMONS = [
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:s|atives)"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:s|atives)"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by", "by", "attribution"),
]
_COMMONS_VERSIONS = [("1.0", "1 0"), ("2.0", "2 0"), ("2.5", "2 5"), ("3.0", "3 0"), ("4.0", "4 0")]

#: Sentences of licence texts and notices, word for word.
_SENTENCES = [
    ("mit", NOTICE, "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", NOTICE, "substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("isc", NOTICE, "permission to use copy", r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", NOTICE, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", NOTICE, "endorse or", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", NOTICE, "advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("apache-2.0", NOTICE, "apache", r"you may not use this file except in compliance with the license you may obtain a copy of the license at .{0,40}apache org"),
    ("apache-2.0", NOTICE, "apache", r"apache org licen[cs]es licen[cs]e 2 0"),
    ("gpl", NOTICE, "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("lgpl", NOTICE, "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu lesser general public licen[cs]e"),
    ("agpl", NOTICE, "redistribute it", r"you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e"),
    ("gpl", NOTICE, "gnu", r"gnu org licen[cs]es gpl"),
    ("lgpl", NOTICE, "gnu", r"gnu org licen[cs]es lgpl"),
    ("agpl", NOTICE, "gnu", r"gnu org licen[cs]es agpl"),
    ("gfdl", NOTICE, "gnu", r"gnu org licen[cs]es fdl"),
    ("mpl-2.0", NOTICE, "mozilla", r"subject to the terms of the mozilla public licen[cs]e v(?:ersion)? 2 0"),
    ("mpl", NOTICE, "mozilla org", r"mozilla org mpl"),
    ("boost-1.0", NOTICE, "boost", r"boost org license 1 0"),
    ("zlib", NOTICE, "warranty in no event", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", NOTICE, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", NOTICE, "want to public", r"do what the f\w+ you want to public licen[cs]e"),
    ("beerware", NOTICE, "beer", r"you can buy me a beer in return"),
    ("cc0", NOTICE, "commons", r"creative commons zero"),
    ("cc0", NOTICE, "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("cc0", NAMED, "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-pdm", NOTICE, "creativecommons", r"creativecommons org publicdomain mark"),
    ("creative-commons", NAMED, "commons", r"(?:under (?:a|the) )?creative commons(?: licen[cs]e)?"),
    ("public-domain", NOTICE, "domain", r"(?:released|dedicated|placed|put) (?:in|to|into) the public domain"),
    ("public-domain", NAMED, "domain", r"(?:is |in the )public domain"),
    ("proprietary", NOTICE, "proprietary", r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", NAMED, "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution)(?: or distribution)?(?: of this)?"),
    ("proprietary", NAMED, "permission", r"(?:may not|must not|not to) be (?:copied|reproduced|distributed|published)[a-z ]{0,40} without (?:prior |written |express )*permission"),
    ("proprietary", NAMED, "agreement", r"end user licen[cs]e agreement"),
    ("proprietary", HINT, "terms of use", r"(?:subject to|governed by|see) (?:our |the )?terms of use"),
    ("proprietary", HINT, "property of", r"licensed materials property of"),
    ("reserved", NOTICE, "all rights", r"all rights(?: are)? reserved"),
    ("reserved", NAMED, "rights reserved", r"(?:some|certain|no) rights reserved"),
    ("reserved", NAMED, "derechos", r"(?:todos los|reservados todos los) derechos(?: reservados)?"),
    ("reserved", NAMED, "droits", r"tous droits r\S+serv\S+s"),
    ("reserved", NAMED, "vorbehalten", r"alle rechte vorbehalten"),
    ("copyright", HINT, "copyright", r"copyright(?: c)? (?:19|20)\d\d(?: (?:19|20)\d\d)*(?: by)?"),
    ("copyright", HINT, "copyright", r"copyright(?: c)? by"),
    ("copyright", HINT, "copyright", r"(?:all |the )?copyright (?:belongs?|held|owned|holder)"),
    ("non-commercial", NAMED, "commercial", r"(?:for )?non commercial (?:use|purposes) only"),
    ("non-commercial", NAMED, "noncommercial", r"(?:for )?noncommercial (?:use|purposes) only"),
    ("non-commercial", NAMED, "commercial", r"not for commercial (?:use|purposes)"),
    ("research-only", NAMED, "only", r"(?:for )?(?:academic|research)(?: and (?:academic|research|educational))? (?:use|purposes) only"),
    ("mit", NOTICE, "provided as is", r"the software is provided as is without warranty of any kind express or implied"),
    ("mit", NOTICE, "dealings in the software", r"arising from out of or in connection with the software or the use or other dealings in the software"),
    ("mit", VERSIONED, "without restriction", r"to deal in the software without restriction including without limitation"),
    ("isc", NOTICE, "disclaims all", r"the author disclaims all warranties with regard to this software"),
    ("bsd", NOTICE, "copyright holders and contributors", r"this software is provided by the copyright holders and contributors as is"),
    ("bsd", VERSIONED, "redistributions", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", VERSIONED, "redistributions", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", VERSIONED, "neither the name", r"neither the name of .{0,80} nor the names of its contributors"),
    ("apache-2.0", NOTICE, "as is basis", r"software distributed under the licen[cs]e is distributed on an as is basis"),
    ("apache-2.0", VERSIONED, "applicable law", r"unless required by applicable law or agreed to in writing"),
    ("apache", NOTICE, "apache software foundation", r"licensed to the apache software foundation"),
    ("apache", VERSIONED, "apache software foundation", r"product includes software developed (?:at|by) the apache software foundation"),
    ("gpl", NOTICE, "hope that it will be useful", r"is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", NOTICE, "gnu general public", r"you should have received a copy of the gnu general public licen[cs]e"),
    ("lgpl", NOTICE, "lesser general public", r"you should have received a copy of the gnu lesser general public licen[cs]e"),
    ("agpl", NOTICE, "affero general public", r"you should have received a copy of the gnu affero general public licen[cs]e"),
    ("gpl", VERSIONED, "free software foundation", r"as published by the free software foundation"),
    ("gpl", VERSIONED, "copyleft", r"(?:strong|weak) copyleft licen[cs]e"),
    ("gfdl", NOTICE, "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("mpl", NOTICE, "mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e"),
    ("mpl", VERSIONED, "incompatible with secondary", r"this source code form is incompatible with secondary licen[cs]es"),
    ("epl", NOTICE, "eclipse", r"accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("cddl", NOTICE, "common development", r"contents of this file are subject to the terms of the common development and distribution licen[cs]e"),
    ("ofl", NOTICE, "font software", r"this font software is licensed under the sil open font licen[cs]e"),
    ("ofl", VERSIONED, "reserved font name", r"with reserved font names?"),
    ("artistic", NOTICE, "artistic", r"under the same terms as perl itself or the artistic licen[cs]e"),
    ("perl", NOTICE, "perl itself", r"redistribute it and or modify it under the same terms as perl itself"),
    ("zlib", NOTICE, "plainly marked", r"altered source versions must be plainly marked as such"),
    ("zlib", VERSIONED, "misrepresented", r"the origin of this software must not be misrepresented"),
    ("boost", NOTICE, "organization obtaining", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("php", NOTICE, "php software", r"this product includes php software freely available"),
    ("openssl", NOTICE, "openssl", r"software developed by the openssl project"),
    ("libpng", NOTICE, "png reference library", r"the png reference library is supplied as is"),
    ("icu", NOTICE, "unicode", r"unicode data files and any associated documentation"),
    ("w3c", NOTICE, "w3c", r"this work is being provided by the copyright holders under the (?:following |w3c )licen[cs]e w3c"),
    ("odbl", NOTICE, "open database", r"this .{0,40} is made available under the open database licen[cs]e"),
    ("odbl", VERSIONED, "opendatacommons", r"opendatacommons org licen[cs]es odbl"),
    ("odc-by", VERSIONED, "opendatacommons", r"opendatacommons org licen[cs]es by"),
    ("pddl", VERSIONED, "opendatacommons", r"opendatacommons org licen[cs]es pddl"),
    ("ogl", NOTICE, "public sector", r"contains public sector information licensed under the open government licen[cs]e"),
    ("unlicense", VERSIONED, "unlicense", r"for more information please refer to (?:http |https )?unlicense org"),
    ("cc0", NOTICE, "waived all", r"has waived all copyright and related or neighboring rights"),
    ("creative-commons", NOTICE, "commons", r"this work is licensed under (?:a|the) creative commons"),
    ("creative-commons", NAMED, "commons", r"licencia creative commons"),
    ("creative-commons", NAMED, "commons", r"licence creative commons"),
    ("creative-commons", NAMED, "commons", r"creative commons lizenz"),
    ("public-domain", NAMED, "copyrighted in", r"is not copyrighted in the united states"),
    ("public-domain", NAMED, "dominio", r"(?:es|en) (?:de |el )?dominio p\S+blico"),
    ("public-domain", NAMED, "domaine public", r"(?:dans le|du) domaine public"),
    ("public-domain", NAMED, "gemeinfrei", r"(?:ist|sind) gemeinfrei"),
    ("proprietary", NOTICE, "trade secret", r"contains trade secrets? (?:of|and)"),
    ("proprietary", NAMED, "internal use", r"for internal use only"),
    ("proprietary", NAMED, "distribution", r"not for (?:public )?distribution"),
    ("proprietary", NAMED, "resale", r"not for resale"),
    ("proprietary", NAMED, "personal", r"for personal use only"),
    ("proprietary", NAMED, "with permission", r"(?:used|reprinted|reproduced) (?:here )?with permission"),
    ("proprietary", NAMED, "prior written consent", r"without (?:the |our )?prior written consent"),
    ("proprietary", NAMED, "strictly prohibited", r"(?:copying|reproduction|distribution|use) (?:of this \w+ )?is strictly prohibited"),
    ("reserved", NAMED, "reservados", r"derechos reservados"),
    ("reserved", NAMED, "urheberrechtlich", r"urheberrechtlich gesch\S+tzt"),
    ("unspecified", HINT, "licencia", r"bajo (?:la )?licencia"),
    ("unspecified", HINT, "sous licence", r"(?:est |sous la |diffus\S+ )?sous licence"),
    ("unspecified", HINT, "lizenz", r"unter (?:der )?(?:lizenz|freien lizenz)"),
    ("unspecified", HINT, "lizenziert", r"lizenziert unter"),
    ("non-commercial", NAMED, "commercial", r"(?:no|any) commercial use (?:is )?(?:allowed|permitted|prohibited)"),
    ("permissive", HINT, "freely", r"may be (?:used|copied|distributed)(?: [a-z ]{0,30})? freely"),
    ("unspecified", HINT, "licen", r"(?:see|read) (?:the )?(?:accompanying )?licen[cs]e (?:file|text|agreement)"),
    ("unspecified", HINT, "licen", r"(?:is|are) (?:dual |multi )?licen[cs]ed under"),
]

#: Short tags: (label, pattern of the tag's words).
_TAGS = [
    ("apache-2.0", "apache 2 0"), ("mit", "mit"), ("mit-0", "mit 0"), ("isc", "isc"), ("bsd-2-clause", "bsd 2 clause"),
    ("bsd-3-clause", "bsd 3 clause"), ("bsd-4-clause", "bsd 4 clause"), ("bsd-0-clause", "0bsd"), ("gpl-1.0", "gpl 1 0"),
    ("gpl-2.0", "gpl 2 0"), ("gpl-3.0", "gpl 3 0"), ("lgpl-2.0", "lgpl 2 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3.0", "lgpl 3 0"),
    ("agpl-3.0", "agpl 3 0"), ("gfdl-1.3", "gfdl 1 3"), ("mpl-1.1", "mpl 1 1"), ("mpl-2.0", "mpl 2 0"), ("epl-1.0", "epl 1 0"),
    ("epl-2.0", "epl 2 0"), ("cddl-1.0", "cddl 1 0"), ("cpl-1.0", "cpl 1 0"), ("eupl-1.2", "eupl 1 2"), ("artistic-2.0", "artistic 2 0"),
    ("boost-1.0", "bsl 1 0"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("postgresql", "postgresql"),
    ("ofl-1.1", "ofl 1 1"), ("odbl-1.0", "odbl 1 0"), ("osl-3.0", "osl 3 0"), ("afl-3.0", "afl 3 0"), ("ms-pl", "ms pl"),
    ("ncsa", "ncsa"), ("cc0", "cc0 1 0"), ("sspl-1.0", "sspl 1 0"), ("bsl-1.1", "busl 1 1"), ("upl-1.0", "upl 1 0"),
]

_ABBREVIATED = [
    ("gpl", "gpl", r"(?:gnu )?gpl", [("2.0", "2(?: 0)?"), ("3.0", "3(?: 0)?")]),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", [("2.1", "2 1"), ("3.0", "3(?: 0)?")]),
    ("agpl", "agpl", r"(?:gnu )?agpl", [("3.0", "3(?: 0)?")]),
    ("mpl", "mpl", r"mpl", [("2.0", "2(?: 0)?")]),
]

UNDER = r"(?:licen[cs]ed|released|distributed|available|published|provided|covered|governed|shared|made available|redistributed) (?:\w+ ){0,2}?(?:under|by|with) (?:the )?(?:terms of )?(?:the )?(?:conditions of the )?"


def _family(label: str, keyword: str, name: str, versions: list[tuple[str, str]]) -> list[tuple[str, int, str, str]]:
    out = []
    for suffix, digits in versions:
        mark = rf"(?: v(?:ersion)?)? ?v?{digits}"
        out.append((f"{label}-{suffix}", NOTICE, keyword, rf"{UNDER}{name}{mark}(?: or (?:\(at your option\) )?(?:any )?later(?: version)?)?"))
        out.append((f"{label}-{suffix}", VERSIONED, keyword, rf"{name}{mark}"))
    out.append((label, VERSIONED, keyword, rf"{UNDER}{name}"))
    out.append((label, NAMED, keyword, name))
    return out


def rules() -> list[tuple[str, int, str, str]]:
    """All rules in order."""
    out = []
    for family in [*_FAMILIES, *_ABBREVIATED]:
        out += _family(*family)
    for label, short, long in _COMMONS:
        for suffix, digits in _COMMONS_VERSIONS:
            out.append((f"{label}-{suffix}", NOTICE, "cc", rf"{UNDER}cc {short} {digits}"))
            out.append((f"{label}-{suffix}", VERSIONED, "cc", rf"cc {short} {digits}"))
            out.append((f"{label}-{suffix}", NOTICE, "commons", rf"creative commons {long}(?: \d\d?)? {digits}(?: (?:international|unported|generic))?"))
        out.append((label, NAMED, "cc", rf"cc {short}"))
        out.append((label, NAMED, "commons", rf"creative commons {long}"))
        out.append((label, NOTICE, "creativecommons", rf"creativecommons org licen[cs]es {short}"))
    out += _SENTENCES
    for label, words in _TAGS:
        out.append((label, NOTICE, "spdx", rf"spdx licen[cs]e identifier {words}(?: only| or later)?"))
        out.append((label, VERSIONED, "licen", rf"licen[cs]es? {words}(?: only| or later)?"))
    return out
