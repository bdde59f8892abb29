"""License scans: ordered signature rules over whole texts, in column expressions only.

A text is brought to words (runs of digits, letters and characters beyond ASCII, A-Z lower-cased), joined by single spaces. Each
rule is a regex over that form with a priority (1 is strongest), a label and keywords of which any match must hold one. A text that holds no rule's keyword
is not looked at again; a rule is tried only where a keyword of its own stands. A match inside the span of a match with equal or
stronger priority is suppressed; of equal spans the stronger, then the earlier rule stays.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base phrases with their labels: fixed values.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_V = r"(?: version| v)?"
_LIC = r"(?: (?:public|software|open source|free))? licen[cs]e"
#: label, SPDX identifiers in word form, name, keywords (any of them, parted by a bar).
FAMILIES = (
    ("mit", r"mit(?: 0)?", rf"(?:the )?(?:mit|expat|x11)(?: style)?{_LIC}", "mit|expat|x11"),
    ("apache", r"apache [12] [01]", rf"(?:the )?apache{_LIC}(?:{_V} [12](?: [01])?)?", "apache"),
    ("gpl", r"gpl [123] 0(?: only| or later)?", rf"(?:the )?(?:gnu )?(?:general public licen[cs]e|gpl(?: licen[cs]e)?)(?:{_V} [123](?: 0)?)?(?: or(?: at your option)? any later version)?", "general public|gpl"),
    ("lgpl", r"lgpl [23] [01](?: only| or later)?", rf"(?:the )?(?:gnu )?(?:(?:lesser|library) general public licen[cs]e|lgpl(?: licen[cs]e)?)(?:{_V} [23](?: [01])?)?", "general public|lgpl"),
    ("agpl", r"agpl [13] 0(?: only| or later)?", rf"(?:the )?(?:gnu )?(?:affero general public licen[cs]e|agpl(?: licen[cs]e)?)(?:{_V} [13](?: 0)?)?", "affero|agpl"),
    ("fdl", r"gfdl 1 [123](?: only| or later)?", rf"(?:the )?(?:gnu )?free documentation licen[cs]e(?:{_V} 1(?: [123])?)?", "documentation"),
    ("bsd-0", r"0bsd", r"(?:the )?(?:zero clause bsd|0bsd|bsd 0 clause)(?: licen[cs]e)?", "bsd"),
    ("bsd-1", r"bsd 1 clause", r"(?:the )?(?:bsd 1 clause|1 clause bsd|one clause bsd)(?: licen[cs]e)?", "bsd"),
    ("bsd-2", r"bsd 2 clause", r"(?:the )?(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?", "bsd"),
    ("bsd-3", r"bsd 3 clause", r"(?:the )?(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd)(?: licen[cs]e)?", "bsd"),
    ("bsd-4", r"bsd 4 clause", r"(?:the )?(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[cs]e)?", "bsd"),
    ("bsd", r"bsd", rf"(?:the )?bsd(?: style)?{_LIC}", "bsd"),
    ("isc", r"isc", rf"(?:the )?isc{_LIC}", "isc"),
    ("mpl", r"mpl [12] [01]", rf"(?:the )?mozilla public licen[cs]e(?:{_V} [12](?: [01])?)?", "mozilla"),
    ("epl", r"epl [12] 0", rf"(?:the )?eclipse public licen[cs]e(?:{_V} [12](?: 0)?)?", "eclipse"),
    ("edl", r"edl 1 0", rf"(?:the )?eclipse distribution licen[cs]e(?:{_V} 1(?: 0)?)?", "eclipse"),
    ("eupl", r"eupl 1 [012]", rf"(?:the )?european union public licen[cs]e(?:{_V} 1(?: [012])?)?", "european"),
    ("cddl", r"cddl 1 [01]", rf"(?:the )?common development and distribution licen[cs]e(?:{_V} 1(?: [01])?)?", "development and distribution"),
    ("cpl", r"cpl 1 0", rf"(?:the )?common public licen[cs]e(?:{_V} 1(?: 0)?)?", "common public"),
    ("ipl", r"ipl 1 0", rf"(?:the )?ibm public licen[cs]e(?:{_V} 1(?: 0)?)?", "ibm"),
    ("artistic", r"artistic [12] 0", rf"(?:the )?(?:perl )?artistic licen[cs]e(?:{_V} [12](?: 0)?)?", "artistic"),
    ("zlib", r"zlib", rf"(?:the )?zlib(?: libpng)?{_LIC}", "zlib"),
    ("libpng", r"libpng(?: 2 0)?", rf"(?:the )?libpng{_LIC}", "libpng"),
    ("bsl", r"bsl 1 0", rf"(?:the )?boost software licen[cs]e(?:{_V} 1(?: 0)?)?", "boost"),
    ("busl", r"busl 1 1", rf"(?:the )?business source licen[cs]e(?:{_V} 1(?: 1)?)?", "business source"),
    ("sspl", r"sspl 1 0", rf"(?:the )?server side public licen[cs]e(?:{_V} 1(?: 0)?)?", "server side"),
    ("elastic", r"elastic 2 0", rf"(?:the )?elastic licen[cs]e(?:{_V} 2(?: 0)?)?", "elastic"),
    ("unlicense", r"unlicense", r"(?:the )?unlicense(?: licen[cs]e)?", "unlicense"),
    ("wtfpl", r"wtfpl", r"(?:the )?(?:wtfpl|do what the [^ ]+ you want to public licen[cs]e)", "wtfpl|want to public"),
    ("cc0", r"cc0 1 0", r"(?:the )?(?:creative commons )?(?:cc0|zero)(?: 1 0)?(?: universal)?(?: public domain dedication)? licen[cs]e", "cc0|zero"),
    ("cc-by", r"cc by [1234] [05]", rf"(?:the )?creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?(?:{_V} [1234] [05])?", "attribution"),
    ("cc-by-sa", r"cc by sa [1234] [05]", rf"(?:the )?creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?(?:{_V} [1234] [05])?", "attribution"),
    ("cc-by-nd", r"cc by nd [1234] [05]", r"(?:the )?creative commons attribution no ?deriv(?:ative)?s?(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?", "attribution"),
    ("cc-by-nc", r"cc by nc [1234] [05]", r"(?:the )?creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?", "attribution"),
    ("cc-by-nc-sa", r"cc by nc sa [1234] [05]", r"(?:the )?creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?", "attribution"),
    ("cc-by-nc-nd", r"cc by nc nd [1234] [05]", r"(?:the )?creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1234] [05])?(?: international| unported)?(?: licen[cs]e)?", "attribution"),
    ("odbl", r"odbl 1 0", r"(?:the )?open (?:data commons open )?database licen[cs]e(?: 1 0)?", "database licen"),
    ("pddl", r"pddl 1 0", r"(?:the )?(?:open data commons )?public domain dedication and licen[cs]e", "dedication"),
    ("odc-by", r"odc by 1 0", r"(?:the )?open data commons attribution licen[cs]e", "commons attribution"),
    ("psf", r"(?:psf|python) 2 0", rf"(?:the )?python(?: software foundation)? licen[cs]e(?:{_V} 2(?: [0-9])?)?", "python"),
    ("php", r"php 3 0[01]?", rf"(?:the )?php licen[cs]e(?:{_V} 3(?: 0[01]?)?)?", "php"),
    ("ruby", r"ruby", r"(?:the )?ruby licen[cs]e", "ruby"),
    ("openssl", r"openssl", r"(?:the )?(?:openssl|ssleay)(?: and ssleay)? licen[cs]e", "ssl"),
    ("postgresql", r"postgresql", r"(?:the )?postgresql licen[cs]e", "postgresql"),
    ("ncsa", r"ncsa", r"(?:the )?(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa"),
    ("ms-pl", r"ms pl", r"(?:the )?microsoft public licen[cs]e", "microsoft"),
    ("ms-rl", r"ms rl", r"(?:the )?microsoft reciprocal licen[cs]e", "microsoft"),
    ("ofl", r"ofl 1 [01]", rf"(?:the )?(?:sil )?open font licen[cs]e(?:{_V} 1(?: [01])?)?", "open font"),
    ("afl", r"afl [123] [012]", rf"(?:the )?academic free licen[cs]e(?:{_V} [123](?: [012])?)?", "academic"),
    ("osl", r"osl [123] [01]", rf"(?:the )?open software licen[cs]e(?:{_V} [123](?: [01])?)?", "open software"),
    ("upl", r"upl 1 0", r"(?:the )?universal permissive licen[cs]e", "permissive"),
    ("vim", r"vim", r"(?:the )?vim licen[cs]e", "vim"),
    ("qpl", r"qpl 1 0", r"(?:the )?q public licen[cs]e", "q public"),
    ("lppl", r"lppl 1 [0123]c?", r"(?:the )?latex project public licen[cs]e", "latex"),
    ("openrail", r"(?:bigscience )?openrail m?", r"(?:the )?(?:creativeml |bigscience )?open ?rail(?: m)? licen[cs]e", "rail"),
    ("beerware", r"beerware", r"(?:the )?beer ?ware licen[cs]e", "beer"),
    ("json", r"json", r"(?:the )?json licen[cs]e", "json"),
    ("tcl", r"tcl", r"(?:the )?tcl tk licen[cs]e", "tcl"),
    ("curl", r"curl", r"(?:the )?curl licen[cs]e", "curl"),
    ("w3c", r"w3c", r"(?:the )?w3c software(?: notice)?(?: and)? licen[cs]e", "w3c"),
)

#: priority, wording around a family's name.
WORDINGS = (
    (2, r"(?:licensed|released|distributed|available|published|provided|covered|governed)(?: [^ ]+){0,3}? (?:under|by)(?: [^ ]+){0,4}? NAME"),
    (2, r"(?:terms|conditions|provisions)(?: and conditions)? of(?: [^ ]+){0,2}? NAME"),
    (3, r"(?:see|copy of|text of|accompanying|read)(?: [^ ]+){0,2}? NAME"),
    (4, r"NAME"),
)

#: Passages of the licences' own texts and of the notices they ask for: label, regex, keywords.
PASSAGES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", "permission"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", "copyright"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "copyright"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "copyright"),
    ("bsd-3", r"neither the name of(?: [^ ]+){1,8}? nor the names of its contributors may be used to endorse", "neither"),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display", "advertising"),
    ("apache", r"you may not use this file except in compliance with the license", "license"),
    ("apache", r"unless required by applicable law or agreed to in writing software distributed under the license", "license"),
    ("gpl", r"this program is free software you can redistribute it and or modify", "this program is free"),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", "warranty"),
    ("lgpl", r"this library is free software you can redistribute it and or modify", "this library is free"),
    ("lgpl", r"this library is distributed in the hope that it will be useful but without any warranty", "warranty"),
    ("mpl", r"this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", r"this software is provided as is without any express or implied warranty", "warranty"),
    ("bsl", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software", "organization"),
    ("fdl", r"permission is granted to copy distribute and or modify this document", "permission"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "merchantability"),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense", "sublicense"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability", "copyright holders"),
    ("mit-0", r"mit no attribution", "no attribution"),
    ("bsd", r"this software is provided by the(?: [^ ]+){1,6}? as is and any express or implied warranties", "warranties"),
    ("bsd", r"in no event shall the(?: [^ ]+){1,6}? be liable for any direct indirect incidental special exemplary or consequential damages", "exemplary"),
    ("bsd-3", r"neither the name of the copyright holder nor the names of its contributors", "names of its contributors"),
    ("bsd-3", r"the name of the author may not be used to endorse or promote products derived from this software", "endorse or promote"),
    ("bsd-3-clear", r"no express or implied licenses to any party s patent rights are granted by this license", "patent rights"),
    ("bsd-4", r"this product includes software developed by", "software developed by"),
    ("bsd-0", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", "without fee"),
    ("isc", r"provided that the above copyright notice and this permission notice appear in all copies", "permission notice"),
    ("isc", r"the author disclaims all warranties with regard to this software", "disclaims all warranties"),
    ("apache", r"apache license version 2 0 january 2004", "january 2004"),
    ("apache", r"licensed under the apache license version 2 0 the license", "apache"),
    ("apache", r"licensed to the apache software foundation asf under one or more contributor license agreements", "apache software foundation"),
    ("apache", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "irrevocable copyright license"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "apache software foundation"),
    ("gpl", r"gnu general public license version [123]", "general public"),
    ("gpl", r"under the terms of the gnu general public license as published by the free software foundation", "free software foundation"),
    ("gpl", r"either version [123](?: [01])? of the license or at your option any later version", "any later version"),
    ("gpl", r"you should have received a copy of the gnu general public license along with this program", "along with this program"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "verbatim copies"),
    ("gpl", r"the gnu general public license is a free copyleft license for software and other kinds of works", "copyleft"),
    ("gpl-exception", r"as a special exception(?: [^ ]+){0,8}? (?:link|linking|combine)", "special exception"),
    ("gpl-exception", r"classpath exception|gcc runtime library exception", "classpath exception|runtime library exception"),
    ("lgpl", r"under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation", "free software foundation"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this library", "along with this library"),
    ("lgpl", r"a work that uses the library", "uses the library"),
    ("agpl", r"under the terms of the gnu affero general public license as published by the free software foundation", "affero"),
    ("agpl", r"your modified version must prominently offer all users interacting with it remotely through a computer network", "interacting with it remotely"),
    ("fdl", r"with no invariant sections no front cover texts and no back cover texts", "invariant sections"),
    ("fdl", r"under the terms of the gnu free documentation license", "free documentation"),
    ("mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", "mpl was not distributed"),
    ("mpl", r"the contents of this file are subject to the mozilla public license version 1 [01]", "mozilla"),
    ("mpl", r"this source code form is incompatible with secondary licenses", "secondary licenses"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse"),
    ("epl", r"the accompanying program is provided under the terms of this eclipse public license", "eclipse"),
    ("edl", r"this program and the accompanying materials are made available under the terms of the eclipse distribution license", "eclipse"),
    ("eupl", r"licensed under the eupl(?: version 1 [012])?", "eupl"),
    ("eupl", r"unless required by applicable law or agreed to in writing software distributed under the licence", "under the licence"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "development and distribution"),
    ("cddl", r"when distributing covered code include this cddl header in each file", "cddl header"),
    ("cpl", r"the accompanying program is provided under the terms of this common public license", "common public"),
    ("ipl", r"the accompanying program is provided under the terms of this ibm public license", "ibm public"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", "package may be copied"),
    ("artistic", r"you may (?:redistribute|distribute) (?:it|this package) and or modify it under the same terms as perl itself", "perl itself"),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software", "held liable"),
    ("zlib", r"the origin of this software must not be misrepresented", "misrepresented"),
    ("zlib", r"altered source versions must be plainly marked as such", "plainly marked"),
    ("libpng", r"the png reference library is supplied as is", "png reference library"),
    ("bsl", r"distributed under the boost software license", "boost"),
    ("bsl", r"unless such copies or derivative works are solely in the form of machine executable object code", "machine executable"),
    ("busl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", "non production use"),
    ("sspl", r"if you make the functionality of the program or a modified version available to third parties as a service", "third parties as a service"),
    ("elastic", r"you may not provide the software to third parties as a hosted or managed service", "hosted or managed service"),
    ("commons-clause", r"the license does not grant to you the right to sell the software|commons clause", "right to sell|commons clause"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free"),
    ("unlicense", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest", "copyright interest"),
    ("wtfpl", r"you just do what the [^ ]+ you want to", "you just do what"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", "public domain"),
    ("cc0", r"to the extent possible under law(?: [^ ]+){1,12}? has waived all copyright and related or neighboring rights", "neighboring rights"),
    ("cc0", r"creativecommons org publicdomain zero 1 0", "publicdomain zero"),
    ("cc-by", r"creativecommons org licenses by [1234] [05]", "creativecommons org licenses"),
    ("cc-by-sa", r"creativecommons org licenses by sa [1234] [05]", "creativecommons org licenses"),
    ("cc-by-nd", r"creativecommons org licenses by nd [1234] [05]", "creativecommons org licenses"),
    ("cc-by-nc", r"creativecommons org licenses by nc [1234] [05]", "creativecommons org licenses"),
    ("cc-by-nc-sa", r"creativecommons org licenses by nc sa [1234] [05]", "creativecommons org licenses"),
    ("cc-by-nc-nd", r"creativecommons org licenses by nc nd [1234] [05]", "creativecommons org licenses"),
    ("cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made", "appropriate credit"),
    ("cc-by-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original", "same license as the original"),
    ("cc-by-nc", r"you may not use the material for commercial purposes", "commercial purposes"),
    ("odbl", r"this database is made available under the open database license", "open database"),
    ("odbl", r"opendatacommons org licenses odbl", "odbl"),
    ("pddl", r"opendatacommons org licenses pddl", "pddl"),
    ("odc-by", r"opendatacommons org licenses by", "opendatacommons"),
    ("psf", r"psf is making python available to licensee on an as is basis", "psf"),
    ("psf", r"python software foundation license version 2", "python software foundation"),
    ("php", r"this source file is subject to version [23](?: [0-9]+)? of the php license", "php license"),
    ("php", r"this product includes php software freely available from", "php software"),
    ("openssl", r"this product includes software developed by the openssl project", "openssl project"),
    ("openssl", r"this product includes cryptographic software written by eric young", "eric young"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "written agreement"),
    ("ncsa", r"neither the names of(?: [^ ]+){1,12}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "specific prior written permission"),
    ("ms-pl", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software", "patent claim"),
    ("ofl", r"this font software is licensed under the sil open font license", "font software"),
    ("ofl", r"reserved font name", "reserved font name"),
    ("afl", r"licensed under the academic free license version [123](?: [012])?", "academic free"),
    ("osl", r"licensed under the open software license version [123](?: [01])?", "open software"),
    ("upl", r"the universal permissive license upl", "universal permissive"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim", "copies of vim"),
    ("lppl", r"this work may be distributed and or modified under the conditions of the latex project public license", "latex"),
    ("lppl", r"this work has the lppl maintenance status", "lppl maintenance"),
    ("openrail", r"use based restrictions as referenced in paragraph 5", "use based restrictions"),
    ("beerware", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return", "buy me a beer"),
    ("json", r"the software shall be used for good not evil", "not evil"),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose", "grant permission"),
    ("curl", r"except as contained in this notice the name of a copyright holder shall not be used in advertising", "used in advertising"),
    ("w3c", r"permission to copy modify and distribute this work with or without modification for any purpose and without fee or royalty is hereby granted", "fee or royalty"),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used in advertising", "x consortium"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted", "without fee"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "jpeg group"),
    ("unicode", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files", "unicode data files"),
    ("llama", r"llama [23](?: [0-9])? community license agreement", "community license agreement"),
    ("proprietary", r"unauthorized (?:copying|use|reproduction|distribution) of this (?:file|software|material|document)(?: [^ ]+){0,8}? is strictly prohibited", "strictly prohibited"),
    ("proprietary", r"this software is the (?:confidential and )?proprietary (?:information|property) of", "proprietary"),
    ("proprietary", r"licensed materials property of", "licensed materials"),
    ("proprietary", r"no part of this (?:publication|book|document|work) may be reproduced", "may be reproduced"),
    ("proprietary", r"for internal use only|not for redistribution", "internal use only|not for redistribution"),
    ("dual", r"dual licensed under", "dual licensed"),
    ("public-domain", r"this (?:work|file|code|software) is in the public domain", "public domain"),
    ("public-domain", r"(?:dedicated|released|placed)(?: [^ ]+){0,3}? (?:to|into|in) the public domain", "public domain"),
    ("public-domain", r"no rights reserved|waives? all copyright", "no rights|all copyright"),
    ("proprietary", r"all rights reserved", "reserved"),
    ("proprietary", r"proprietary and confidential", "proprietary"),
    ("copyright", r"copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?", "copyright"),
)


def rules() -> list[tuple[int, int, str, str, str]]:
    """``rule, priority, label, keywords, regex``, in order. Every regex starts and ends at word ends."""
    found = [(1, label, "spdx", rf"spdx license identifier {spdx}") for label, spdx, _, _ in FAMILIES]
    found += [(1 if label not in ("proprietary", "copyright") else 4, label, keyword, regex) for label, regex, keyword in PASSAGES]
    found += [(p, label, keyword, wording.replace("NAME", name)) for p, wording in WORDINGS for label, _, name, keyword in FAMILIES]
    return [(k, p, label, keyword, f"(?<= )(?:{regex})(?= )") for k, (p, label, keyword, regex) in enumerate(found)]


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONFIDENCE = {1: 0.98, 2: 0.9, 3: 0.75, 4: 0.6}


def words_text(text: Column) -> Column:
    """The words of a text, each between single spaces."""
    lowered = F.translate(text, UPPER, UPPER.lower())
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scanned(items: Column, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(state, item)`` gives for each item, in order, as an array of ``kind``; it also gives the next state. Arrays are copied when they grow, so results
    are gathered in pieces of about the square root of their number: long arrays cost far less than their square."""
    empty = F.array().cast(f"array<{kind}>")

    def pieces(found: Column) -> Column:
        each = F.ceil(F.sqrt(F.size(found))).cast("int")
        return _let(each, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / n).cast("int")), lambda k: F.slice(found, k * n + 1, n)))

    def one(acc: Column, item: Column) -> Column:
        state, out = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def piece(acc: Column, part: Column) -> Column:
        begin = F.struct(acc["state"].alias("state"), empty.alias("out"))
        return F.aggregate(part, begin, one, lambda a: F.struct(a["state"].alias("state"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    begin = F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return _let(items, lambda found: F.when(F.size(found) > 0, F.aggregate(pieces(found), begin, piece, lambda acc: F.flatten(acc["out"]))).otherwise(empty))


def places(text: Column, regex: Column) -> Column:
    """Array of ``first, last``: the first word of each match and the one after its last, words counted from 0."""

    def gaps(hits: Column) -> Column:
        before = F.transform(F.slice(F.split(text, regex, -1), F.lit(1), F.size(hits)), _spaces)
        return F.arrays_zip(before.alias("before"), F.transform(hits, _spaces).alias("inside"))

    def step(at: Column, gap: Column) -> tuple[Column, Column]:
        first = at + gap["before"]
        last = first + gap["inside"]
        return last, F.array(F.struct(first.alias("first"), (last + 1).alias("last")))

    return scanned(_let(F.regexp_extract_all(text, regex, F.lit(0)), gaps), F.lit(-1), "struct<first:int,last:int>", step)


def _holds(text: Column, keywords: Column) -> Column:
    return F.exists(keywords, lambda k: F.contains(text, k))


def _matches(text: Column) -> Column:
    rows = (F.struct(F.lit(k).alias("rule"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.array(*map(F.lit, word.split("|"))).alias("keywords"), F.lit(regex).alias("regex")) for k, p, label, word, regex in rules())
    kind = "array<struct<first:int,neg_last:int,priority:int,rule:int,label:string>>"
    tried = F.filter(F.array(*rows), lambda r: _holds(text, r["keywords"]) & F.rlike(text, r["regex"]))
    found = F.transform(tried, lambda r: F.transform(places(text, r["regex"]), lambda m: F.struct(m["first"].alias("first"), (-m["last"]).alias("neg_last"), r["priority"].alias("priority"), r["rule"].alias("rule"), r["label"].alias("label"))))
    return F.array_sort(F.flatten(found)).cast(kind)


DETECTION = "struct<first:int,last:int,priority:int,rule:int,label:string>"


def _unsuppressed(matches: Column) -> Column:
    """Sorted by start, then longest, then strongest: a match is inside an earlier one of the same or a stronger priority just if
    the furthest end seen so far at those priorities is not before its own."""

    def step(ends: Column, m: Column) -> tuple[Column, Column]:
        last, covered = -m["neg_last"], F.lit(False)
        for p in CONFIDENCE:
            covered = covered | ((m["priority"] >= p) & (ends[f"e{p}"] >= last))
        # A match goes on as an array of one or none.
        after = F.struct(*(F.when(m["priority"] == p, F.greatest(ends[f"e{p}"], last)).otherwise(ends[f"e{p}"]).alias(f"e{p}") for p in CONFIDENCE))
        one = F.array(F.struct(m["first"].alias("first"), last.alias("last"), m["priority"].alias("priority"), m["rule"].alias("rule"), m["label"].alias("label")))
        return after, F.when(covered, F.array().cast(f"array<{DETECTION}>")).otherwise(one)

    return scanned(matches, F.struct(*(F.lit(-1).alias(f"e{p}") for p in CONFIDENCE)), DETECTION, step)


def certain_words(regex: str) -> list[set[str]]:
    """For each alternative of a rule the words (of six letters or more, or the beginning ``licen``) that every match holds: those that stand outside all groups."""
    flat, depth = "", 0
    for c in regex:
        depth += (c == "(") - (c == ")")
        flat += c if depth == 0 and c != ")" else " " if depth == 0 else ""
    return [{"licen" if w == "licen[cs]e" else w for w in re.sub(r"[?{][^ ]*", " ", part).split() if w == "licen[cs]e" or (w.isalnum() and len(w) > 5)} for part in flat.split("|")]


def gates() -> list[str]:
    """Strings of which every text that any rule or base phrase can match holds one: few words that cover all rules, the one that covers most first. A rule without certain
    words is covered by its keywords'. In the text itself words may be apart by anything but word characters, so single words are looked for."""
    needs = [{"licen"}]
    for _, _, _, keywords, regex in rules():
        certain = certain_words(regex[len("(?<= )(?:") : -len(")(?= )")])
        needs += certain if all(certain) else [{max(k.split(), key=len)} for k in keywords.split("|")]
    needs = [{"licen" if w.startswith("licen") else w for w in n} for n in needs]
    out = []
    while needs:
        votes = Counter(w for n in needs for w in n)
        best = max(votes, key=lambda w: (votes[w], len(w), w))
        out.append(best)
        needs = [n for n in needs if best not in n]
    return [w for w in out if not any(v != w and v in w for v in out)]


def scan_licenses(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The input's ``doc_id`` with ``n_words``, base phrase places and ``detections`` (array of ``first, last, priority, rule,
    label``; words from 0, ``last`` exclusive). One row per input row; null texts count as empty: no words, no detections. Repeated rows are
    scanned alike, texts of any length whole; an empty table gives no rows, and other columns are ignored."""
    body = F.coalesce(F.col(text), F.lit(""))
    lowered = F.translate(body, UPPER, UPPER.lower())
    gate = F.lit(False)
    for g in gates():
        gate = gate | F.contains(lowered, F.lit(g))
    rows = docs.select("doc_id", n_words(body).alias("n_words"), F.when(gate, words_text(body)).alias("_words"))
    none = F.array().cast(f"array<{DETECTION}>")
    rows = rows.withColumn("detections", F.when(F.col("_words").isNotNull(), _unsuppressed(_matches(F.col("_words")))).otherwise(none))
    # Each word with its own spaces, so that places of one phrase never share a character.
    rows = rows.withColumn("_apart", F.replace(F.col("_words"), F.lit(" "), F.lit("  ")))
    for k, (phrase, _) in enumerate(BASE):
        mark = " " + phrase.replace(" ", "  ") + " "
        n = (F.length("_apart") - F.length(F.replace(F.col("_apart"), F.lit(mark), F.lit("")))) / len(mark)
        before, after = F.substring_index("_apart", mark, 1), F.substring_index("_apart", mark, -1)
        count = F.coalesce(n.cast("long"), F.lit(0).cast("long"))
        # Every word has two spaces of its own but for the ends of the text, which have one more each.
        rows = rows.withColumn(f"_n{k}", count).withColumn(f"_first{k}", F.when(count > 0, F.floor((_spaces(before) - 1) / 2)))
        rows = rows.withColumn(f"_last{k}", F.when(F.col(f"_n{k}") > 0, F.col("n_words") - F.floor((_spaces(after) - 1) / 2) - len(phrase.split())))
    base = range(len(BASE))
    rows = rows.withColumn("n_base", sum((F.col(f"_n{k}") for k in base), F.lit(0).cast("long")))
    rows = rows.withColumn("first_word", F.least(*(F.col(f"_first{k}") for k in base)).cast("long")).withColumn("last_word", F.greatest(*(F.col(f"_last{k}") for k in base)).cast("long"))
    labels = F.array_compact(F.array(*(F.when(F.col(f"_n{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(BASE))))
    rows = rows.withColumn("base", F.array_sort(F.array_distinct(labels)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", "detections")


def license_report(docs: DataFrame) -> DataFrame:
    """Digest of ``scan_licenses``. ``score`` is the confidence of the strongest detection, 0.5 at least with a base phrase, else 0."""
    rows = scan_licenses(docs)
    confidence = F.coalesce(F.array_max(F.transform("detections", lambda m: sum((F.when(m["priority"] == p, F.lit(c)).otherwise(F.lit(0.0)) for p, c in CONFIDENCE.items()), F.lit(0.0)))), F.lit(0.0))
    score = F.greatest(confidence, F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    labels = F.array_sort(F.array_union("base", F.transform("detections", lambda m: m["label"])))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.size("detections").cast("long").alias("n_detections"))
