"""License signatures over canonical words (lower case, single spaces).

A rule is (priority, label, keyword, pattern, weight). Priority 1 is a declared identifier, 2 a full
grant or notice text, 3 a named license in a licensing phrase, 4 a bare name or a generic mark. The
keyword, whole words (of several divided by | any), must occur in the text before the pattern is
tried. Patterns start and end at a word. Notices and usage are written one by one; the forms of a name (declared, in
a phrase, bare) and the Creative Commons versions are made from their parts."""

from __future__ import annotations

#: License names as canonical words, their label and the word that gates them.
NAMES = [
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version)? 2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version)? 1 1"),
    ("apache-1.0", "apache", r"apache(?: software)? license(?: version)? 1 0"),
    ("mit", "mit license", r"(?:the )?mit license"),
    ("mit", "mit x11", r"mit x11(?: license)?"),
    ("mit-0", "mit no attribution", r"mit no attribution"),
    ("mit", "expat", r"expat license"),
    ("gpl-2.0", "general public", r"gnu general public license(?: version | v ?| )2(?: 0)?"),
    ("gpl-3.0", "general public", r"gnu general public license(?: version | v ?| )3(?: 0)?"),
    ("gpl-2.0", "gpl|gplv2|gpl2|gplv", r"(?:gnu )?gpl ?v? ?2(?: 0)?"),
    ("gpl-3.0", "gpl|gplv3|gpl3|gplv", r"(?:gnu )?gpl ?v? ?3(?: 0)?"),
    ("lgpl-2.0", "library general", r"gnu library general public license(?: version | v ?| )2(?: 0)?"),
    ("lgpl-2.1", "lesser general", r"gnu lesser general public license(?: version | v ?| )2 1"),
    ("lgpl-3.0", "lesser general", r"gnu lesser general public license(?: version | v ?| )3(?: 0)?"),
    ("lgpl-2.1", "lgpl|lgplv2|lgpl2|lgplv", r"(?:gnu )?lgpl ?v? ?2 1"),
    ("lgpl-3.0", "lgpl|lgplv3|lgpl3|lgplv", r"(?:gnu )?lgpl ?v? ?3(?: 0)?"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: version | v ?| )3(?: 0)?"),
    ("agpl-3.0", "agpl|agplv3|agpl3|agplv", r"(?:gnu )?agpl ?v? ?3(?: 0)?"),
    ("gfdl-1.2", "free documentation", r"gnu free documentation license(?: version | v ?| )1 2"),
    ("gfdl-1.3", "free documentation", r"gnu free documentation license(?: version | v ?| )1 3"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: license)?"),
    ("bsd-2-clause", "freebsd license", r"freebsd license"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|revised bsd|modified bsd|bsd 3 clause|3 clause bsd)(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: license)?"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause)(?: license)?"),
    ("0bsd", "0bsd", r"0bsd(?: license)?"),
    ("mpl-1.1", "mozilla public", r"mozilla public license(?: version | v ?| )1 1"),
    ("mpl-2.0", "mozilla public", r"mozilla public license(?: version | v ?| )2(?: 0)?"),
    ("mpl-2.0", "mpl|mplv2|mpl2|mplv", r"mpl ?v? ?2(?: 0)?"),
    ("epl-1.0", "eclipse public", r"eclipse public license(?: version | v ?| )1(?: 0)?"),
    ("epl-2.0", "eclipse public", r"eclipse public license(?: version | v ?| )2(?: 0)?"),
    ("cddl-1.0", "common development", r"common development and distribution license(?: version | )1(?: 0)?"),
    ("cddl-1.1", "common development", r"common development and distribution license(?: version)? 1 1"),
    ("cpl-1.0", "common public", r"common public license(?: version | )1(?: 0)?"),
    ("isc", "isc license", r"isc license"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("bsl-1.0", "boost software", r"boost software license(?: version | )1(?: 0)?"),
    ("artistic-1.0", "artistic license", r"artistic license(?: version | )1(?: 0)?"),
    ("artistic-2.0", "artistic license", r"artistic license(?: version | )2(?: 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python-2.0", "python software", r"python software foundation license(?: version)?(?: 2)?"),
    ("python-2.0", "psf", r"psf license(?: version)?(?: 2)?"),
    ("postgresql", "postgresql license", r"postgresql license"),
    ("openssl", "openssl license", r"openssl license"),
    ("ms-pl", "microsoft public", r"microsoft public license"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal license"),
    ("eupl-1.1", "european union public", r"european union public licen[cs]e(?: version | v ?| )1 1"),
    ("eupl-1.2", "european union public", r"european union public licen[cs]e(?: version | v ?| )1 2"),
    ("ofl-1.1", "open font", r"(?:sil )?open font license(?: version | )1 1"),
    ("odbl-1.0", "open database", r"open (?:data commons open )?database license(?: version | v ?| )1(?: 0)?"),
    ("odc-by-1.0", "open data commons", r"open data commons attribution license(?: version | v ?| )1(?: 0)?"),
    ("pddl-1.0", "open data commons", r"open data commons public domain dedication(?: and license)?"),
    ("busl-1.1", "business source", r"business source license(?: version | )1 1"),
    ("elastic-2.0", "elastic license", r"elastic license(?: version | v ?| )2(?: 0)?"),
    ("sspl-1.0", "server side", r"server side public license(?: version | v ?| )1?"),
    ("upl-1.0", "universal permissive", r"universal permissive license(?: version | v ?| )1(?: 0)?"),
    ("vim", "vim license", r"vim license"),
    ("w3c", "w3c software", r"w3c software (?:notice and )?license"),
    ("x11", "x11 license", r"x11 license"),
]

#: Creative Commons conditions, as words and in full.
CC_KINDS = [
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]

#: Grants and notices as they stand in license files.
NOTICES = [
    ("mit", "free of charge", r"permission is hereby granted free of charge to any person obtaining a copy", 0.98),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies", 0.98),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose with or without fee", 0.98),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 0.98),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software", 0.9),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software", 0.95),
    ("apache-2.0", "apache org", r"www apache org licenses license 2 0", 0.98),
    ("apache-2.0", "compliance with", r"you may not use this file except in compliance with the license", 0.9),
    ("gpl", "free software", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.98),
    ("lgpl", "free software", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", 0.98),
    ("gpl", "you should have received a copy", r"you should have received a copy of the gnu general public license along with", 0.95),
    ("gpl-or-later", "any later version", r"(?:or )?(?:at your option )?any later version", 0.6),
    ("mpl", "source code form", r"this source code form is subject to the terms of the mozilla public license", 0.98),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain", 0.98),
    ("public-domain", "public domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", 0.85),
    ("zlib", "implied warranty", r"this software is provided as is without any express or implied warranty", 0.8),
    ("warranty-disclaimer", "warranty", r"without warranty of any kind(?: express or implied)?", 0.6),
    ("warranty-disclaimer", "merchantability", r"implied warranty of merchantability or fitness for a particular purpose", 0.7),
    ("proprietary", "proprietary", r"(?:confidential and proprietary|proprietary and confidential)", 0.8),
    ("proprietary", "written permission", r"without (?:the )?(?:express |prior )*written permission", 0.6),
    ("proprietary", "trade secret|trade secrets", r"(?:contains|constitutes) trade secrets?", 0.6),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?", 0.95),
    ("cc0-1.0", "creative commons", r"creative commons (?:cc0|zero|public domain dedication)", 0.95),
    ("cc", "creativecommons", r"creativecommons org licenses [a-z]+(?: [a-z]+)*", 0.9),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})*", 0.6),
    ("copyright", "copyright", r"copyright by [^ ]+", 0.4),
    ("mit", "above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies", 0.98),
    ("mit", "in no event shall the authors", r"in no event shall the authors or copyright holders be liable for any claim", 0.9),
    ("bsd", "redistributions of source code", r"redistributions of source code must retain the above copyright notice", 0.97),
    ("bsd", "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice", 0.97),
    ("bsd-3-clause", "neither the name", r"neither the name of (?:the )?[^ ]+(?: [^ ]+){0,6} nor the names of (?:its|any) contributors", 0.95),
    ("bsd-source", "use of this source code is governed", r"use of this source code is governed by a bsd style license", 0.97),
    ("bsd", "bsd style", r"bsd style license", 0.7),
    ("apache-2.0", "unless required by applicable law", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.95),
    ("apache-2.0", "licensed to the apache", r"licensed to the apache software foundation asf under one or more contributor license agreements", 0.98),
    ("apache-1.1", "this product includes software developed by the apache", r"this product includes software developed by the apache (?:software foundation|group)", 0.9),
    ("gpl-2.0-only", "version 2 of the license", r"version 2 of the license only", 0.7),
    ("gpl-2.0-or-later", "either version 2", r"either version 2 of the license or at your option any later version", 0.97),
    ("gpl-3.0-or-later", "either version 3", r"either version 3 of the license or at your option any later version", 0.97),
    ("lgpl-2.1-or-later", "either version 2 1", r"either version 2 1 of the license or at your option any later version", 0.97),
    ("gpl", "51 franklin", r"51 franklin (?:street|st)(?: fifth floor)? boston ma(?: 02110 1301)?(?: usa)?", 0.6),
    ("gpl", "59 temple", r"59 temple place(?: suite 330)? boston ma(?: 02111 1307)?(?: usa)?", 0.6),
    ("gpl", "gnu org licenses gpl", r"www gnu org licenses gpl(?: [0-9]+ [0-9]+)?(?: html| txt)?", 0.9),
    ("lgpl", "gnu org licenses lgpl", r"www gnu org licenses lgpl(?: [0-9]+ [0-9]+)?(?: html| txt)?", 0.9),
    ("agpl-3.0", "gnu org licenses agpl", r"www gnu org licenses agpl(?: 3 0)?(?: html| txt)?", 0.9),
    ("gfdl", "permission is granted to copy", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.98),
    ("gpl-exception", "special exception", r"as a special exception (?:to the gnu general public license )?(?:if|the|you)", 0.5),
    ("mpl-1.1", "contents of this file are subject", r"the contents of this file are subject to the mozilla public license version 1 1", 0.98),
    ("mpl-2.0", "mozilla org mpl", r"(?:http |https )?(?:www )?mozilla org mpl 2 0", 0.9),
    ("epl", "this program and the accompanying materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license", 0.98),
    ("cddl-1.0", "contents of this file are subject", r"the contents of this file are subject to the terms of the common development and distribution license", 0.98),
    ("ms-pl", "this license governs use of the accompanying software", r"this license governs use of the accompanying software", 0.8),
    ("bsl-1.0", "boost org license", r"www boost org license 1 0(?: txt)?", 0.95),
    ("bsl-1.0", "distributed under the boost", r"distributed under the boost software license version 1 0", 0.98),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such", 0.97),
    ("zlib", "the origin of this software", r"the origin of this software must not be misrepresented", 0.97),
    ("wtfpl", "do what the", r"do what the [^ ]+ you want to(?: public license)?", 0.9),
    ("unlicense", "unlicense org", r"(?:please refer to |http |https )*unlicense org", 0.9),
    ("unlicense", "anyone is free to copy", r"anyone is free to copy modify publish use compile sell or distribute this software", 0.98),
    ("cc0-1.0", "to the extent possible under law", r"to the extent possible under law [^ ]+(?: [^ ]+){0,8} waived all copyright", 0.95),
    ("cc0-1.0", "publicdomain zero", r"publicdomain zero 1 0", 0.95),
    ("cc-by-sa", "this work is licensed under a creative commons attribution", r"this work is licensed under a creative commons attribution share ?alike", 0.97),
    ("cc-by", "text is available under", r"text is available under the creative commons attribution", 0.9),
    ("public-domain", "public domain", r"(?:this (?:work|file|document|text|code) is|is) in the public domain", 0.85),
    ("public-domain", "no copyright is claimed", r"no copyright is claimed", 0.7),
    ("public-domain", "not subject to copyright", r"not subject to copyright(?: protection)?", 0.7),
    ("us-government", "work of the united states", r"work of the united states government", 0.8),
    ("ofl-1.1", "this font software is licensed", r"this font software is licensed under the sil open font license", 0.98),
    ("ofl-1.1", "scripts sil org", r"scripts sil org ofl", 0.9),
    ("artistic-2.0", "everyone is permitted to copy and distribute verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document", 0.6),
    ("x11", "except as contained in this notice", r"except as contained in this notice the name of [^ ]+(?: [^ ]+){0,6} shall not be used in advertising", 0.9),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose", 0.95),
    ("ntp", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 0.96),
    ("beerware", "beer ware license", r"beer ware license", 0.95),
    ("beerware", "buy me a beer", r"buy me a beer in return", 0.9),
    ("json", "shall be used for good", r"the software shall be used for good not evil", 0.98),
    ("ijg", "independent jpeg group", r"this software is based in part on the work of the independent jpeg group", 0.95),
    ("icu", "icu license", r"icu license", 0.8),
    ("ncsa", "university of illinois", r"university of illinois ncsa open source license", 0.95),
    ("php-3.01", "php license", r"php license(?: version)?(?: 3 01)?", 0.85),
    ("ruby", "ruby license", r"(?:the )?ruby license", 0.85),
    ("ruby", "same terms as ruby", r"(?:under )?the same terms as ruby", 0.85),
    ("perl", "same terms as perl", r"(?:under )?the same terms as perl(?: itself)?", 0.9),
    ("eula", "end user license agreement", r"end user license agreement", 0.7),
    ("commercial", "commercial license", r"(?:available under|requires|purchase) a commercial license", 0.7),
    ("dual-license", "dual licensed", r"dual licensed(?: under)?", 0.6),
    ("non-commercial", "non commercial use only", r"(?:for )?non commercial use only", 0.8),
    ("non-commercial", "for personal and non commercial", r"for personal and non commercial use", 0.8),
    ("non-commercial", "for research purposes only", r"for research purposes only", 0.7),
    ("no-derivatives", "may not be modified", r"may not be modified (?:or|and) redistributed", 0.6),
    ("proprietary", "no part of this", r"no part of this (?:publication|document|book|work) may be reproduced", 0.9),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|use|distribution)(?: of this (?:file|software|document))?", 0.8),
    ("proprietary", "unpublished proprietary", r"unpublished proprietary source code", 0.9),
    ("proprietary", "not for redistribution", r"not for redistribution", 0.6),
    ("proprietary", "do not distribute", r"do not distribute", 0.5),
    ("reprint-permission", "reprinted with", r"reprinted with(?: the)?(?: kind)? permission", 0.7),
    ("reprint-permission", "used with permission", r"used with permission", 0.5),
    ("fair-use", "fair use", r"fair use", 0.4),
    ("terms-of-use", "terms of use", r"subject to (?:the |our )?terms of use", 0.5),
    ("llama", "llama", r"llama (?:[0-9]+(?: [0-9]+)? )?community license(?: agreement)?", 0.9),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m| s| d)?(?: license)?", 0.9),
    ("odc-by-1.0", "opendatacommons org", r"opendatacommons org licenses by(?: 1 0)?", 0.95),
    ("odbl-1.0", "opendatacommons org", r"opendatacommons org licenses odbl(?: 1 0)?", 0.95),
    ("pddl-1.0", "opendatacommons org", r"opendatacommons org licenses pddl(?: 1 0)?", 0.95),
    ("ogl-uk-3.0", "open government", r"open government licen[cs]e(?: v3 0)?", 0.95),
    ("etalab-2.0", "licence ouverte", r"licence ouverte(?: open licence)?(?: version)?(?: 2 0)?", 0.95),
    ("dl-de-by-2.0", "datenlizenz deutschland", r"datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?", 0.95),
]

#: Usage of licenses whose short names are words of their own, as canonical words.
USAGE = [
    ("mit", "licensed under mit", r"licensed under mit"),
    ("mit", "under the mit", r"under the mit(?: terms| license| licence)?"),
    ("mit", "released under mit", r"released under mit(?: terms| license)?"),
    ("mit", "terms of the mit", r"terms of the mit(?: license| licence)?"),
    ("mit", "mit licensed", r"mit licensed"),
    ("mit", "license mit", r"license mit"),
    ("mit", "mit or apache", r"mit or apache(?: 2 0)?"),
    ("apache-2.0", "license apache", r"license apache(?: version)? 2(?: 0)?"),
    ("apache-2.0", "apache licensed", r"apache licensed"),
    ("apache-2.0", "apache 2 0 licensed", r"apache 2 0 licensed"),
    ("bsd", "bsd licensed", r"bsd licensed"),
    ("bsd", "license bsd", r"license bsd(?: [234] clause)?"),
    ("bsd", "under the bsd", r"under the bsd(?: license| licence)?"),
    ("bsd", "terms of the bsd", r"terms of the bsd(?: license| licence)?"),
    ("bsd", "under a bsd", r"under a bsd(?: style| like)? licen[cs]e"),
    ("isc", "license isc", r"license isc"),
    ("isc", "under the isc", r"under the isc licen[cs]e"),
    ("isc", "terms of the isc", r"terms of the isc licen[cs]e"),
    ("gpl", "gpl licensed", r"gpl licensed"),
    ("gpl-2.0", "gplv2 licensed", r"gplv2 licensed"),
    ("gpl-3.0", "gplv3 licensed", r"gplv3 licensed"),
    ("gpl", "under the gpl", r"under the gpl"),
    ("gpl", "terms of the gpl", r"terms of the gpl"),
    ("gpl", "under the gnu gpl", r"under the gnu gpl"),
    ("lgpl", "under the lgpl", r"under the lgpl"),
    ("agpl-3.0", "under the agpl", r"under the agpl"),
    ("gpl", "license gpl", r"license gpl(?: [23](?: 0)?)?(?: or later| only)?"),
    ("mpl-2.0", "license mpl", r"license mpl(?: 2 0)?"),
    ("cc0-1.0", "under cc0", r"under cc0(?: 1 0)?"),
    ("cc0-1.0", "license cc0", r"license cc0(?: 1 0)?"),
]

#: Phrases that put a name to use, their priority and weight.
PHRASES = [
    (3, r"(?:licen[cs]ed|released|distributed|available|published|made available|provided) (?:under|by) (?:the )?(?:terms of )?(?:the )?", "", 0.97),
    (3, r"(?:subject to|under|pursuant to|governed by|in accordance with) (?:the )?(?:terms of )?(?:the )?", r"(?: license)?", 0.85),
    (4, "", r"(?: license)?", 0.6),
]


def rules() -> list[tuple[int, str, str, str, float]]:
    """All signature rules: identifier, phrase and name forms of every name, Creative Commons by
    condition and version, notices and usage."""
    out: list[tuple[int, str, str, str, float]] = []
    for label, keyword, name in NAMES:
        out += [(p, label, keyword, before + name + after, w) for p, before, after, w in PHRASES]
        out.append((1, label, "spdx", "spdx license identifier " + label.replace(".", " ").replace("-", " ") + r"(?: only| or later)?", 0.99))
    for kind, short, full in CC_KINDS:
        for version in CC_VERSIONS:
            label = f"cc-{kind}-{version.replace(' ', '.')}"
            out.append((2, label, "cc by", f"cc {short} {version}", 0.95))
            out.append((2, label, "creative commons", f"creative commons {full}(?: {version})(?: international| unported| generic)?(?: license)?", 0.95))
            out.append((1, label, "spdx", f"spdx license identifier cc {short} {version}", 0.99))
        out.append((3, f"cc-{kind}", "creative commons", f"creative commons {full}(?: license)?", 0.85))
    out += [(2, label, keyword, pattern, w) for label, keyword, pattern, w in NOTICES]
    out += [(3, label, keyword, pattern, 0.9) for label, keyword, pattern in USAGE]
    return list(dict.fromkeys(out))


def gate_word(keyword: str) -> str:
    """A word of a keyword, the longest: a text without it has not the keyword."""
    return max(keyword.split(" "), key=len)
