"""Signature rules for license statements, written one by one.

A rule is (label, keyword, pattern, priority, strength). Patterns (Java) read lower-case words with one blank between
them: 'Apache-2.0' is 'apache 2 0'. A match starts and ends with whole words and holds one of the keywords, which are
parted by bars. Priority 3 is for identifiers and for sentences that only one license has, 2 for statements, 1 for
mentions and for sentences that several licenses share.
"""

from __future__ import annotations

IDENTIFIERS = (
    ("mit", "identifier mit", "spdx license identifier mit", 3, 0.98),
    ("mit-0", "identifier mit 0", "spdx license identifier mit 0", 3, 0.98),
    ("apache-2", "identifier apache 2", "spdx license identifier apache 2 0", 3, 0.98),
    ("apache-1.1", "identifier apache 1", "spdx license identifier apache 1 1", 3, 0.98),
    ("bsd-2", "identifier bsd 2", "spdx license identifier bsd 2 clause(?: patent| views)?", 3, 0.98),
    ("bsd-3", "identifier bsd 3", "spdx license identifier bsd 3 clause(?: clear| lbnl| attribution)?", 3, 0.98),
    ("bsd-4", "identifier bsd 4", "spdx license identifier bsd 4 clause(?: uc)?", 3, 0.98),
    ("0bsd", "identifier 0bsd", "spdx license identifier 0bsd", 3, 0.98),
    ("gpl-2", "identifier gpl 2", "spdx license identifier gpl 2 0(?: only| or later)?", 3, 0.98),
    ("gpl-3", "identifier gpl 3", "spdx license identifier gpl 3 0(?: only| or later)?", 3, 0.98),
    ("lgpl-2.1", "identifier lgpl 2", "spdx license identifier lgpl 2 [01](?: only| or later)?", 3, 0.98),
    ("lgpl-3", "identifier lgpl 3", "spdx license identifier lgpl 3 0(?: only| or later)?", 3, 0.98),
    ("agpl-3", "identifier agpl 3", "spdx license identifier agpl 3 0(?: only| or later)?", 3, 0.98),
    ("gfdl", "identifier gfdl", "spdx license identifier gfdl 1 [123](?: only| or later)?", 3, 0.98),
    ("mpl-2", "identifier mpl 2", "spdx license identifier mpl 2 0(?: no copyleft exception)?", 3, 0.98),
    ("mpl-1.1", "identifier mpl 1", "spdx license identifier mpl 1 [01]", 3, 0.98),
    ("epl-1", "identifier epl 1", "spdx license identifier epl 1 0", 3, 0.98),
    ("epl-2", "identifier epl 2", "spdx license identifier epl 2 0", 3, 0.98),
    ("cddl", "identifier cddl", "spdx license identifier cddl 1 [01]", 3, 0.98),
    ("eupl", "identifier eupl", "spdx license identifier eupl 1 [012]", 3, 0.98),
    ("isc", "identifier isc", "spdx license identifier isc", 3, 0.98),
    ("zlib", "identifier zlib", "spdx license identifier zlib", 3, 0.98),
    ("boost", "identifier bsl 1", "spdx license identifier bsl 1 0", 3, 0.98),
    ("bsl", "identifier busl", "spdx license identifier busl 1 1", 3, 0.98),
    ("artistic-1", "identifier artistic 1", "spdx license identifier artistic 1 0(?: perl| cl8)?", 3, 0.98),
    ("artistic-2", "identifier artistic 2", "spdx license identifier artistic 2 0", 3, 0.98),
    ("wtfpl", "identifier wtfpl", "spdx license identifier wtfpl", 3, 0.98),
    ("unlicense", "identifier unlicense", "spdx license identifier unlicense", 3, 0.98),
    ("postgresql", "identifier postgresql", "spdx license identifier postgresql", 3, 0.98),
    ("python", "identifier psf|identifier python", "spdx license identifier (?:psf|python) 2 0", 3, 0.98),
    ("php", "identifier php", "spdx license identifier php 3 0(?:1)?", 3, 0.98),
    ("openssl", "identifier openssl", "spdx license identifier openssl", 3, 0.98),
    ("w3c", "identifier w3c", "spdx license identifier w3c(?: 19980720| 20150513)?", 3, 0.98),
    ("x11", "identifier x11", "spdx license identifier x11", 3, 0.98),
    ("ofl", "identifier ofl", "spdx license identifier ofl 1 [01](?: rfn| no rfn)?", 3, 0.98),
    ("odbl", "identifier odbl", "spdx license identifier odbl 1 0", 3, 0.98),
    ("pddl", "identifier pddl", "spdx license identifier pddl 1 0", 3, 0.98),
    ("odc-by", "identifier odc", "spdx license identifier odc by 1 0", 3, 0.98),
    ("upl", "identifier upl", "spdx license identifier upl 1 0", 3, 0.98),
    ("ms-pl", "identifier ms pl", "spdx license identifier ms pl", 3, 0.98),
    ("ms-rl", "identifier ms rl", "spdx license identifier ms rl", 3, 0.98),
    ("elastic-2", "identifier elastic", "spdx license identifier elastic 2 0", 3, 0.98),
    ("sspl", "identifier sspl", "spdx license identifier sspl 1 0", 3, 0.98),
    ("cc0", "identifier cc0", "spdx license identifier cc0 1 0", 3, 0.98),
    ("cc-by", "identifier cc by", "spdx license identifier cc by [1-4] [05]", 3, 0.98),
    ("cc-by-sa", "identifier cc by sa", "spdx license identifier cc by sa [1-4] [05]", 3, 0.98),
    ("cc-by-nd", "identifier cc by nd", "spdx license identifier cc by nd [1-4] [05]", 3, 0.98),
    ("cc-by-nc", "identifier cc by nc", "spdx license identifier cc by nc [1-4] [05]", 3, 0.98),
    ("cc-by-nc-sa", "identifier cc by nc sa", "spdx license identifier cc by nc sa [1-4] [05]", 3, 0.98),
    ("cc-by-nc-nd", "identifier cc by nc nd", "spdx license identifier cc by nc nd [1-4] [05]", 3, 0.98),
    ("curl", "identifier curl", "spdx license identifier curl", 3, 0.98),
    ("ncsa", "identifier ncsa", "spdx license identifier ncsa", 3, 0.98),
    ("unicode", "identifier unicode", "spdx license identifier unicode (?:3 0|dfs 201[56])", 3, 0.98),
    ("blueoak", "identifier blueoak", "spdx license identifier blueoak 1 0 0", 3, 0.98),
)

STATEMENTS = (
    ("mit", "under mit|under the mit", "(?:licen[cs]ed|released|distributed|published|available|shared|provided|offered|issued) under (?:the )?mit(?: x11)?(?: licen[cs]e)?", 2, 0.95),
    ("mit", "terms of mit|terms of the mit", "(?:under |subject to |according to )?(?:the )?terms of (?:the )?mit(?: licen[cs]e)?", 2, 0.9),
    ("mit", "by mit|by the mit", "(?:covered|governed) by (?:the )?mit(?: licen[cs]e)?", 2, 0.9),
    ("mit", "to mit|to the mit|with mit|with the mit", "(?:subject to|in accordance with) (?:the )?mit(?: licen[cs]e)?", 2, 0.8),
    ("mit", "mit licen", "mit licen[cs](?:e|ed)", 1, 0.6),
    ("mit", "licence mit|license mit|lizenz mit|licencia mit|licenza mit", "(?:licen[cs]e|licencia|licenza|lizenz) mit", 1, 0.6),
    ("mit", "expat licen", "expat licen[cs]e", 2, 0.8),
    ("mit-0", "mit no attribution", "mit no attribution(?: licen[cs]e)?", 2, 0.9),
    ("apache-2", "apache", "(?:licen[cs]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of the )?apache(?: software)?(?: licen[cs]e)?(?: version| v)? 2(?: 0)?", 2, 0.95),
    ("apache-2", "apache", "apache(?: software)? licen[cs]e(?: version| v)? 2(?: 0)?", 1, 0.8),
    ("apache-2", "apache", "apache 2(?: 0)?(?: licen[cs](?:e|ed))?", 1, 0.6),
    ("apache-2", "apache org licenses", "(?:www )?apache org licenses license 2 0", 3, 0.95),
    ("apache-1.1", "apache", "apache(?: software)? licen[cs]e(?: version| v)? 1 [01]", 2, 0.85),
    ("apache", "apache", "(?:under|subject to|terms of) (?:the )?apache(?: software)? licen[cs]e", 1, 0.5),
    ("bsd-2", "bsd", "(?:under|terms of) (?:the |a )?(?:simplified|2 clause|two clause) bsd(?: style)?(?: licen[cs]e)?", 2, 0.95),
    ("bsd-2", "bsd", "(?:simplified|2 clause|two clause) bsd(?: licen[cs]e)?", 1, 0.75),
    ("bsd-2", "bsd 2", "bsd 2 clause(?: licen[cs](?:e|ed))?", 1, 0.75),
    ("bsd-2", "freebsd", "freebsd licen[cs]e", 1, 0.7),
    ("bsd-3", "bsd", "(?:under|terms of) (?:the |a )?(?:new|modified|revised|3 clause|three clause) bsd(?: style)?(?: licen[cs]e)?", 2, 0.95),
    ("bsd-3", "bsd", "(?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)?", 1, 0.75),
    ("bsd-3", "bsd 3", "(?:(?:under|terms of) (?:the )?)?bsd 3(?: clause)?(?: licen[cs](?:e|ed))?", 1, 0.75),
    ("bsd-4", "bsd", "(?:original|old|4 clause|four clause) bsd licen[cs]e", 2, 0.85),
    ("bsd-4", "bsd 4", "bsd 4 clause(?: licen[cs]e)?", 1, 0.75),
    ("0bsd", "zero clause bsd|0bsd", "(?:bsd )?(?:zero clause bsd|0bsd)(?: licen[cs]e)?", 2, 0.9),
    ("bsd", "bsd licen|bsd style", "bsd (?:style )?licen[cs]e", 1, 0.5),
    ("gpl-2", "gpl", "(?:under|terms of) (?:the )?(?:gnu )?gpl(?: version| v)? ?v?2(?: 0)?(?: or (?:any |at your option any )?later(?: version)?| only)?", 2, 0.95),
    ("gpl-2", "gpl", "(?:gnu )?gpl(?: version| v)? ?v?2(?: 0)?(?: only| or later)?", 1, 0.75),
    ("gpl-2", "general public", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?(?: of the licen[cs]e)?(?: or (?:at your option )?any later version)?", 2, 0.9),
    ("gpl-3", "gpl", "(?:under|terms of) (?:the )?(?:gnu )?gpl(?: version| v)? ?v?3(?: 0)?(?: or (?:any |at your option any )?later(?: version)?| only)?", 2, 0.95),
    ("gpl-3", "gpl", "(?:gnu )?gpl(?: version| v)? ?v?3(?: 0)?(?: only| or later)?", 1, 0.75),
    ("gpl-3", "general public", "(?:gnu )?general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?(?: of the licen[cs]e)?(?: or (?:at your option )?any later version)?", 2, 0.9),
    ("gpl", "gnu general public", "gnu general public licen[cs]e", 1, 0.5),
    ("gpl", "gpl", "(?:under|terms of|covered by|governed by) (?:the )?(?:gnu )?gpl", 1, 0.5),
    ("gpl", "gnu org licenses", "(?:www )?gnu org licenses(?: old licenses)? gpl(?: 2 0| 3 0)?(?: html| txt)?", 2, 0.7),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl(?: version| v)? ?v?2(?: [01])?(?: only| or later)?", 2, 0.8),
    ("lgpl-2.1", "lesser general public|library general public", "(?:gnu )?(?:lesser|library) general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: [01])?(?: of the licen[cs]e)?", 2, 0.9),
    ("lgpl-3", "lgpl", "(?:gnu )?lgpl(?: version| v)? ?v?3(?: 0)?(?: only| or later)?", 2, 0.8),
    ("lgpl-3", "lesser general public", "(?:gnu )?lesser general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?(?: of the licen[cs]e)?", 2, 0.9),
    ("lgpl", "lesser general public", "(?:gnu )?lesser general public licen[cs]e", 1, 0.5),
    ("agpl-3", "agpl", "(?:gnu )?agpl(?: version| v)? ?v?3(?: 0)?(?: only| or later)?", 2, 0.8),
    ("agpl-3", "affero general public", "(?:gnu )?affero general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?(?: of the licen[cs]e)?", 2, 0.9),
    ("agpl", "affero general public", "(?:gnu )?affero general public licen[cs]e", 1, 0.5),
    ("gfdl", "free documentation", "(?:under (?:the )?)?(?:terms of the )?(?:gnu )?free documentation licen[cs]e(?:(?: version| v)? 1 [123])?", 2, 0.85),
    ("mpl-2", "mozilla public", "(?:under (?:the )?)?(?:terms of the )?mozilla public licen[cs]e(?: version| v)? 2(?: 0)?", 2, 0.9),
    ("mpl-2", "mpl 2", "mpl 2 0", 1, 0.7),
    ("mpl-1.1", "mozilla public", "mozilla public licen[cs]e(?: version| v)? 1 [01]", 2, 0.9),
    ("mpl", "mozilla public", "mozilla public licen[cs]e", 1, 0.5),
    ("epl-1", "eclipse public", "eclipse public licen[cs]e(?: version| v)? 1(?: 0)?", 2, 0.9),
    ("epl-2", "eclipse public", "eclipse public licen[cs]e(?: version| v)? 2(?: 0)?", 2, 0.9),
    ("epl", "eclipse public", "eclipse public licen[cs]e", 1, 0.5),
    ("epl", "eclipse org legal epl", "(?:www )?eclipse org legal epl (?:v10|2 0|v20)(?: html)?", 2, 0.7),
    ("cddl", "common development and distribution", "common development and distribution licen[cs]e(?:(?: version| v)? 1 [01])?", 2, 0.9),
    ("cddl", "cddl", "(?:under (?:the )?)?cddl(?:(?: version| v)? 1 [01])?", 1, 0.6),
    ("eupl", "european union public", "european union public licen[cs]e(?:(?: version| v)? 1 [012])?", 2, 0.9),
    ("eupl", "eupl", "eupl(?:(?: version| v)? ?1 [012])?", 1, 0.6),
    ("isc", "under isc|under the isc", "(?:licen[cs]ed|released|distributed|available|provided) under (?:the )?isc(?: licen[cs]e)?", 2, 0.95),
    ("isc", "isc licen", "isc licen[cs](?:e|ed)", 1, 0.6),
    ("isc", "license isc|licence isc", "licen[cs]e isc", 1, 0.6),
    ("isc", "to isc|to the isc|with isc|with the isc", "(?:subject to|in accordance with) (?:the )?isc(?: licen[cs]e)?", 2, 0.8),
    ("isc", "by isc|by the isc|of isc|of the isc", "(?:covered by|governed by|terms of) (?:the )?isc(?: licen[cs]e)?", 2, 0.9),
    ("zlib", "zlib", "(?:under (?:the )?)?zlib(?: libpng)? licen[cs]e", 2, 0.8),
    ("boost", "boost software", "(?:under (?:the )?)?boost software licen[cs]e(?:(?: version| v)? 1 0)?", 2, 0.9),
    ("artistic-1", "artistic", "artistic licen[cs]e(?: version)? 1(?: 0)?", 2, 0.85),
    ("artistic-2", "artistic", "artistic licen[cs]e(?: version)? 2(?: 0)?", 2, 0.85),
    ("artistic", "artistic", "(?:under|terms of) (?:the )?artistic licen[cs]e", 1, 0.5),
    ("perl", "same terms as perl", "(?:under the )?same terms as perl(?: itself)?", 2, 0.85),
    ("wtfpl", "wtfpl", "wtfpl(?: version 2)?", 1, 0.7),
    ("wtfpl", "you want to public", "do what the f[a-z]* you want to public licen[cs]e", 2, 0.9),
    ("unlicense", "unlicense", "(?:under )?the unlicense", 2, 0.85),
    ("unlicense", "unlicense org", "(?:www )?unlicense org", 1, 0.6),
    ("postgresql", "postgresql licen", "postgresql licen[cs]e", 2, 0.8),
    ("python", "python software foundation", "python software foundation licen[cs]e(?: version 2)?", 2, 0.85),
    ("php", "php licen", "php licen[cs]e(?: version)?(?: 3(?: 0?1)?)?", 2, 0.8),
    ("openssl", "openssl", "openssl(?: and ssleay)? licen[cs]e", 2, 0.8),
    ("w3c", "w3c", "w3c software(?: notice and| and document)? licen[cs]e", 2, 0.85),
    ("x11", "x11 licen", "x11 licen[cs]e", 2, 0.75),
    ("ofl", "open font", "(?:sil )?open font licen[cs]e(?:(?: version| v)? 1 [01])?", 2, 0.9),
    ("odbl", "open database", "(?:odc )?open database licen[cs]e(?: odbl)?(?:(?: version| v)? 1 0)?", 2, 0.9),
    ("odbl", "odbl", "odbl(?: 1 0)?", 1, 0.6),
    ("pddl", "domain dedication and licen", "public domain dedication and licen[cs]e(?: pddl)?", 2, 0.9),
    ("odc-by", "open data commons attribution", "open data commons attribution licen[cs]e", 2, 0.9),
    ("odc-by", "odc by", "odc by(?: 1 0)?", 1, 0.6),
    ("upl", "universal permissive", "universal permissive licen[cs]e", 2, 0.9),
    ("ms-pl", "microsoft public", "microsoft public licen[cs]e(?: ms pl)?", 2, 0.9),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal licen[cs]e(?: ms rl)?", 2, 0.9),
    ("bsl", "business source", "business source licen[cs]e(?: 1 1)?", 2, 0.9),
    ("elastic-2", "elastic", "elastic licen[cs]e(?: 2 0| v2)", 2, 0.85),
    ("sspl", "server side public", "server side public licen[cs]e(?:(?: version| v)? 1)?", 2, 0.9),
    ("ncsa", "illinois", "university of illinois(?: ncsa)? open source licen[cs]e", 2, 0.9),
    ("cecill", "cecill", "(?:under (?:the )?)?(?:licence )?cecill(?: b| c)?(?:(?: version| v)? ?[12](?: [01])?)?", 2, 0.8),
    ("blueoak", "blue oak", "blue oak model licen[cs]e(?: 1 0 0)?", 2, 0.9),
    ("osl-3", "open software licen", "open software licen[cs]e(?:(?: version| v)? 3(?: 0)?)?", 2, 0.8),
    ("afl-3", "academic free", "academic free licen[cs]e(?:(?: version| v)? 3(?: 0)?)?", 2, 0.8),
    ("json", "good not evil", "the software shall be used for good not evil", 3, 0.95),
    ("beerware", "beer ware|beerware", "the (?:beer ware|beerware) licen[cs]e", 2, 0.85),
    ("openrail", "openrail", "(?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?", 2, 0.8),
    ("llama", "llama", "llama (?:2|3|3 1|3 2) community licen[cs]e(?: agreement)?", 2, 0.9),
    ("ogl-uk", "open government", "open government licen[cs]e(?: v3 0| version 3| 3 0)?", 2, 0.85),
    ("etalab", "licence ouverte", "licence ouverte(?: open licence)?(?: etalab)?(?: 2 0)?", 2, 0.85),
    ("dl-de-by", "datenlizenz deutschland", "datenlizenz deutschland (?:namensnennung|zero)(?: version)?(?: 2 0)?", 2, 0.85),
)

CREATIVE_COMMONS = (
    ("cc-by", "cc by", "(?:under (?:a |the )?)?cc by(?: [1-4] [05])?(?: international| unported)?(?: licen[cs](?:e|ed))?(?! (?:nc|nd|sa)(?: |$))", 2, 0.9),
    ("cc-by-sa", "cc by sa", "(?:under (?:a |the )?)?cc by sa(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", 2, 0.9),
    ("cc-by-nd", "cc by nd", "(?:under (?:a |the )?)?cc by nd(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", 2, 0.9),
    ("cc-by-nc", "cc by nc", "(?:under (?:a |the )?)?cc by nc(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?(?! (?:nd|sa)(?: |$))", 2, 0.9),
    ("cc-by-nc-sa", "cc by nc sa", "(?:under (?:a |the )?)?cc by nc sa(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", 2, 0.9),
    ("cc-by-nc-nd", "cc by nc nd", "(?:under (?:a |the )?)?cc by nc nd(?: [1-4] [05])?(?: international| unported)?(?: licen[cs]e)?", 2, 0.9),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?(?: public domain dedication)?", 2, 0.9),
    ("cc0", "creative commons zero", "creative commons zero(?:(?: v)? ?1 0)?(?: universal)?(?: licen[cs]e)?", 2, 0.9),
    ("cc-by", "commons attribution", "creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?(?! (?:non|no|share))", 2, 0.9),
    ("cc-by-sa", "commons attribution share", "creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", 2, 0.9),
    ("cc-by-nd", "commons attribution no", "creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", 2, 0.9),
    ("cc-by-nc", "commons attribution non", "creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?(?! (?:no|share))", 2, 0.9),
    ("cc-by-nc-sa", "commons attribution non", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", 2, 0.9),
    ("cc-by-nc-nd", "commons attribution non", "creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?(?: international| unported| generic)?(?: licen[cs]e)?", 2, 0.9),
    ("cc-by", "creativecommons org licenses by", "creativecommons org licenses by [1-4] [05]", 3, 0.97),
    ("cc-by-sa", "creativecommons org licenses by sa", "creativecommons org licenses by sa [1-4] [05]", 3, 0.97),
    ("cc-by-nd", "creativecommons org licenses by nd", "creativecommons org licenses by nd [1-4] [05]", 3, 0.97),
    ("cc-by-nc", "creativecommons org licenses by nc", "creativecommons org licenses by nc [1-4] [05]", 3, 0.97),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa [1-4] [05]", 3, 0.97),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd [1-4] [05]", 3, 0.97),
    ("cc0", "creativecommons org publicdomain", "creativecommons org publicdomain zero 1 0", 3, 0.97),
    ("cc-pdm", "creativecommons org publicdomain", "creativecommons org publicdomain mark 1 0", 3, 0.95),
    ("cc", "creative commons licen", "creative commons licen[cs]e", 1, 0.5),
    ("cc-by", "commons namensnennung", "creative commons namensnennung(?: [1-4] [05])?(?! (?:nicht|keine|weitergabe))", 2, 0.85),
    ("cc-by-sa", "commons namensnennung weitergabe", "creative commons namensnennung weitergabe unter gleichen bedingungen(?: [1-4] [05])?", 2, 0.85),
)

SENTENCES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 3, 0.97),
    ("mit", "above copyright notice and this permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 2, 0.8),
    ("mit", "provided as is without warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", 1, 0.6),
    ("boost", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 3, 0.97),
    ("isc", "permission to use copy modify", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted", 3, 0.97),
    ("0bsd", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 3, 0.97),
    ("postgresql", "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", 3, 0.97),
    ("bsd-2", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 2, 0.8),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 1, 0.6),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice", 1, 0.6),
    ("bsd-3", "used to endorse", "neither the name of .{1,80}? nor the names of (?:its|any) contributors may be used to endorse or promote products", 3, 0.95),
    ("bsd-3", "used to endorse", "the name of the author may not be used to endorse or promote products derived from this software", 3, 0.9),
    ("bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 3, 0.95),
    ("apache-2", "except in compliance with", "you may not use this file except in compliance with the license", 3, 0.9),
    ("apache-2", "licensed under the apache", "licensed under the apache license version 2 0 the license", 3, 0.97),
    ("apache-2", "copyright license to reproduce", "a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce", 2, 0.85),
    ("apache-1.1", "developed by the apache", "this product includes software developed by the apache software foundation", 1, 0.5),
    ("gpl", "redistribute it and or modify", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 2, 0.85),
    ("lgpl", "redistribute it and or modify", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", 2, 0.85),
    ("gpl", "merchantability or fitness", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 2, 0.8),
    ("gpl-2", "either version 2 of the license", "gnu general public license .{0,60}?either version 2 of the license", 3, 0.97),
    ("gpl-3", "either version 3 of the license", "gnu general public license .{0,60}?either version 3 of the license", 3, 0.97),
    ("lgpl-2.1", "either version 2 1 of the license", "gnu lesser general public license .{0,60}?either version 2 1 of the license", 3, 0.97),
    ("agpl-3", "either version 3 of the license", "gnu affero general public license .{0,60}?either version 3 of the license", 3, 0.97),
    ("gfdl", "invariant sections", "with no invariant sections no front cover texts and no back cover texts", 3, 0.95),
    ("mpl-2", "this source code form", "this source code form is subject to the terms of the mozilla public license v 2 0", 3, 0.97),
    ("mpl-1.1", "contents of this file are subject", "the contents of this file are subject to the mozilla public license version 1 1", 3, 0.97),
    ("cddl", "contents of this file are subject", "the contents of this file are subject to the terms of the common development and distribution license", 3, 0.97),
    ("epl-1", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 3, 0.97),
    ("epl-2", "accompanying materials", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", 3, 0.97),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software", 3, 0.95),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented", 2, 0.85),
    ("unlicense", "unencumbered software", "this is free and unencumbered software released into the public domain", 3, 0.97),
    ("wtfpl", "you just do what", "you just do what the f[a-z]* you want to", 3, 0.95),
    ("python", "psf is making python", "psf is making python available to licensee on an as is basis", 3, 0.95),
    ("openssl", "use in the openssl toolkit", "developed by the openssl project for use in the openssl toolkit", 3, 0.9),
    ("ofl", "reserved font name", "with reserved font name", 2, 0.85),
    ("ofl", "font software", "the font software is provided as is", 2, 0.85),
    ("sspl", "functionality of the program", "if you make the functionality of the program or a modified version available to third parties as a service", 3, 0.9),
    ("beerware", "buy me a beer", "if we meet some day and you think this stuff is worth it you can buy me a beer", 3, 0.95),
    ("cc", "work is licensed under a creative", "(?:this )?work is licensed under a creative commons", 2, 0.6),
    ("cc0", "waived all copyright", "has waived all copyright and related or neighboring rights", 3, 0.9),
    ("odbl", "made available under the open database", "is made available under the open database license", 3, 0.95),
    ("ogl-uk", "public sector information", "contains public sector information licensed under the open government licence", 3, 0.95),
)

NOTICES = (
    ("public-domain", "public domain", "(?:released|placed|dedicated|donated) (?:in|into|to) the public domain", 2, 0.8),
    ("public-domain", "public domain", "(?:is|are) in the public domain", 2, 0.7),
    ("public-domain", "public domain", "no rights reserved public domain", 2, 0.7),
    ("public-domain", "gemeinfrei", "(?:ist|sind|als) gemeinfrei", 2, 0.7),
    ("public-domain", "domaine public", "(?:dans|est du) (?:le )?domaine public", 2, 0.7),
    ("public-domain", "dominio público", "(?:de|en el) dominio público", 2, 0.7),
    ("proprietary", "rights reserved|rights are reserved", "all rights (?:are )?reserved(?: worldwide)?", 1, 0.4),
    ("proprietary", "rechte vorbehalten", "alle rechte vorbehalten", 1, 0.4),
    ("proprietary", "droits réservés", "tous droits réservés", 1, 0.4),
    ("proprietary", "derechos reservados", "todos los derechos reservados", 1, 0.4),
    ("proprietary", "diritti riservati", "tutti i diritti riservati", 1, 0.4),
    ("proprietary", "proprietary and confidential", "proprietary and confidential", 2, 0.7),
    ("proprietary", "confidential and proprietary", "confidential and proprietary", 2, 0.7),
    ("proprietary", "written permission of", "without (?:the )?(?:prior )?(?:express )?written permission of", 1, 0.5),
    ("proprietary", "may not be reproduced", "may not be reproduced(?: stored| copied| distributed)?(?: or transmitted)? in any form", 1, 0.5),
    ("proprietary", "copying of this", "unauthori[sz]ed copying of this (?:file|document|work|software)", 1, 0.5),
    ("proprietary", "end user licen", "end user licen[cs]e agreement", 1, 0.5),
    ("non-commercial", "commercial use only", "(?:for )?non ?commercial use only", 1, 0.5),
    ("non-commercial", "personal use only", "for (?:private and )?personal use only", 1, 0.4),
    ("research-only", "research purposes only", "for (?:academic |non ?commercial )?research purposes only", 1, 0.5),
    ("dual", "dual licensed", "dual licensed under (?:the )?[a-z0-9 ]{1,30}? (?:and|or)", 1, 0.4),
)
