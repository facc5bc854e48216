"""Licence detection by ordered signature rules, in DataFrame expressions only.

A text becomes its lower-case words between single spaces.  Rules are sentences of licences and of their usual notices,
and for each family of licences an SPDX tag, a licence address, a grant ("released under ..."), a declaration
("license: ...", "licence: ...") and the bare title.
A rule runs only on texts that hold its anchor word and its own keyword.  Detections are intervals of characters;
one that lies inside a detection of equal or higher priority is suppressed, so that "gnu lesser general public
license" is not also a plain "gnu general public license".  All of it happens inside the row: nothing is shuffled.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's phrases and labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, keyword (a word of every name), names, SPDX identifier; all as lower-case words.
FAMILIES = (
    ("mit", "mit", r"mit licen[cs]e", r"mit"),
    ("mit", "expat", r"expat licen[cs]e", r"mit"),
    ("mit-0", "attribution", r"mit no attribution(?: licen[cs]e)?", r"mit 0"),
    ("mit-0", "0", r"mit 0", r"mit 0"),
    ("apache-2.0", "apache", r"apache(?: software)? licen[cs]e(?: version)? 2(?: 0)?|apache 2(?: 0)?", r"apache 2 0"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[cs]e(?: version)? 1 1", r"apache 1 1"),
    ("apache-1.0", "apache", r"apache(?: software)? licen[cs]e(?: version)? 1 0", r"apache 1 0"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", r"apache"),
    ("gpl-2.0", "gnu", r"gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "gnu", r"gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)? v(?:ersion )?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl", "gnu", r"gnu general public licen[cs]e", r"gpl"),
    ("gpl-2.0", "gpl", r"gpl v?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-2.0", "gpl2", r"gpl2(?: 0)?", r"gpl2"),
    ("gpl-2.0", "gplv2", r"gplv2(?: 0)?", r"gplv2"),
    ("gpl-3.0", "gpl", r"gpl v?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl-3.0", "gpl3", r"gpl3(?: 0)?", r"gpl3"),
    ("gpl-3.0", "gplv3", r"gplv3(?: 0)?", r"gplv3"),
    ("gpl", "gpl", r"gpl(?: licen[cs]e)?", r"gpl"),
    ("lgpl-2.1", "lesser", r"gnu lesser general public licen[cs]e v(?:ersion )?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser", r"gnu lesser general public licen[cs]e v(?:ersion )?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser", r"gnu lesser general public licen[cs]e", r"lgpl"),
    ("lgpl-2.0", "library", r"gnu library general public licen[cs]e(?: v(?:ersion )?2(?: 0)?)?", r"lgpl 2 0(?: only| or later)?"),
    ("lgpl", "lgpl", r"lgpl(?: v?[23](?: [01])?)?(?: licen[cs]e)?", r"lgpl"),
    ("agpl-3.0", "affero", r"gnu affero general public licen[cs]e(?: v(?:ersion )?3(?: 0)?)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl", "agpl", r"agpl(?: v?3(?: 0)?)?(?: licen[cs]e)?", r"agpl"),
    ("gfdl", "documentation", r"gnu free documentation licen[cs]e(?: v(?:ersion )?1 [123])?", r"gfdl 1 [123](?: only| or later)?"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)?", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)?", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: licen[cs]e)?", r"bsd 4 clause"),
    ("0bsd", "0bsd", r"0bsd", r"0bsd"),
    ("bsd", "bsd", r"bsd licen[cs]e", r"bsd"),
    ("isc", "isc", r"isc licen[cs]e", r"isc"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: version)? 1 [01]", r"mpl 1 [01]"),
    ("mpl-2.0", "mozilla", r"mozilla public licen[cs]e(?: version)? 2(?: 0)?", r"mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r"mpl"),
    ("mpl-2.0", "mpl", r"mpl 2(?: 0)?", r"mpl 2 0"),
    ("epl-1.0", "eclipse", r"eclipse public licen[cs]e(?: v(?:ersion )?)? ?1(?: 0)?", r"epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public licen[cs]e(?: v(?:ersion )?)? ?2(?: 0)?", r"epl 2 0"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", r"epl"),
    ("cddl-1.0", "cddl", r"cddl(?: 1 0)?(?: licen[cs]e)?", r"cddl 1 [01]"),
    ("cddl-1.0", "distribution", r"common development and distribution licen[cs]e(?: 1 0)?", r"cddl 1 [01]"),
    ("cpl-1.0", "common", r"common public licen[cs]e(?: version)?(?: 1 0)?", r"cpl 1 0"),
    ("eupl", "union", r"european union public licen[cs]e(?: v?1 [12])?", r"eupl 1 [12]"),
    ("eupl", "eupl", r"eupl(?: v?1 [12])?", r"eupl 1 [12]"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e", r"ms pl"),
    ("ms-rl", "reciprocal", r"microsoft reciprocal licen[cs]e", r"ms rl"),
    ("artistic-2.0", "artistic", r"artistic licen[cs]e 2(?: 0)?", r"artistic 2 0"),
    ("artistic", "artistic", r"artistic licen[cs]e", r"artistic 1 0"),
    ("bsl-1.0", "boost", r"boost software licen[cs]e(?: version)?(?: 1 0)?", r"bsl 1 0"),
    ("busl-1.1", "business", r"business source licen[cs]e(?: 1 1)?", r"busl 1 1"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: v?2(?: 0)?)?", r"elastic 2 0"),
    ("sspl-1.0", "server", r"server side public licen[cs]e(?: v?1)?", r"sspl 1 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? licen[cs]e", r"zlib"),
    ("libpng", "libpng", r"libpng licen[cs]e(?: version 2)?", r"libpng 2 0"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl"),
    ("python-2.0", "python", r"python software foundation licen[cs]e(?: version 2)?", r"python 2 0"),
    ("python-2.0", "psf", r"psf licen[cs]e", r"psf 2 0"),
    ("php-3.01", "php", r"php licen[cs]e(?: v(?:ersion )?3(?: 01)?)?", r"php 3 01"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby"),
    ("w3c", "w3c", r"w3c software(?: notice and)? licen[cs]e", r"w3c"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1234] [05])?", r"cc by nc nd [1234] [05]"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1234] [05])?", r"cc by nc sa [1234] [05]"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1234] [05])?", r"cc by nc [1234] [05]"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1234] [05])?", r"cc by nd [1234] [05]"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1234] [05])?", r"cc by sa [1234] [05]"),
    ("cc-by", "cc", r"cc by(?: [1234] [05])?", r"cc by [1234] [05]"),
    ("cc-by-nc", "commons", r"creative commons attribution non ?commercial(?: [1234] [05])?", r"cc by nc [1234] [05]"),
    ("cc-by-sa", "commons", r"creative commons attribution share ?alike(?: [1234] [05])?", r"cc by sa [1234] [05]"),
    ("cc-by-nd", "commons", r"creative commons attribution no ?deriv(?:ative)?s(?: [1234] [05])?", r"cc by nd [1234] [05]"),
    ("cc-by", "commons", r"creative commons attribution(?: [1234] [05])?", r"cc by [1234] [05]"),
    ("odbl-1.0", "database", r"open database licen[cs]e(?: v?1 0)?", r"odbl 1 0"),
    ("odc-by-1.0", "data", r"open data commons attribution licen[cs]e", r"odc by 1 0"),
    ("pddl-1.0", "dedication", r"public domain dedication and licen[cs]e", r"pddl 1 0"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?: v(?:ersion )?)?(?: ?1 [01])?", r"ofl 1 [01]"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("upl-1.0", "permissive", r"universal permissive licen[cs]e(?: v?1 0)?", r"upl 1 0"),
    ("ncsa", "illinois", r"university of illinois(?: ncsa)? open source licen[cs]e", r"ncsa"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?", r"openrail"),
    ("proprietary", "proprietary", r"proprietary licen[cs]e", r"licenseref proprietary"),
    ("public-domain", "domain", r"public domain", r"licenseref public domain"),
)

#: What stands for a holder's or work's name in a notice.
_NAME = r"(?:[^ ]+ ){1,8}?"
_MIT = r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
_CC = r"(?:this|the) (?:work|document|text|article|page|content|book|site|website) is (?:made available |published |released )?(?:licen[cs]ed )?under (?:a|the) creative commons"
_KIND = r"(?: [1234] [05])?(?: international| unported| generic)? licen[cs]e"
_HERE = r"(?:creativecommons org licenses)"
_ANYONE = r"permission to use copy modify"

#: label, anchor, keyword (both words of every match), sentence of the licence or of its usual notice.
NOTICES = (
    ("mit", "charge", "hereby", _MIT),
    ("mit", "sublicense", "merge", r"without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "permission", "substantial", r"(?:the above|this) copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "warranty", "noninfringement", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit", "liable", "holders", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-0", "sublicense", "merge", _MIT + r" the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("ncsa", "charge", "hereby", _MIT + r" the software to deal with the software without restriction"),
    ("x11", "advertising", "promote", r"except as contained in this notice the name of " + _NAME + r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software"),
    ("json", "evil", "good", r"the software shall be used for good not evil"),
    ("isc", "purpose", "hereby", _ANYONE + r" and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", "purpose", "hereby", _ANYONE + r" and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("isc", "author", "disclaims", r"the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("hpnd", "purpose", "hereby", _ANYONE + r" distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("postgresql", "agreement", "hereby", _ANYONE + r" and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd", "forms", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "retain", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "reproduce", "redistributions", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", "endorse", "promote", r"neither the name of " + _NAME + r"nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", "endorse", "promote", r"the name of " + _NAME + r"may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", "mentioning", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", "contributors", "holders", r"this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    ("bsd", "regents", "contributors", r"this software is provided by the regents and contributors as is and any express or implied warranties"),
    ("apache-2.0", "compliance", "apache", r"licen[cs]ed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "copy", "apache", r"you may obtain a copy of the license at (?:https? )?(?:www )?apache org licenses license 2 0"),
    ("apache-2.0", "basis", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "contributor", "perpetual", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", "foundation", "apache", r"this product includes software developed by the apache software foundation"),
    ("gpl", "redistribute", "gnu", r"(?:this program|this file|this software|it) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-2.0", "redistribute", "gnu", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("gpl-3.0", "redistribute", "gnu", r"is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2.0", "published", "gnu", r"under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl", "received", "gnu", r"you should have received a copy of the gnu general public license"),
    ("gpl", "hope", "useful", r"this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("lgpl", "redistribute", "gnu", r"(?:this library|this program|this file|this software|it) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", "redistribute", "gnu", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3.0", "redistribute", "gnu", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("lgpl", "received", "gnu", r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl-3.0", "redistribute", "affero", r"you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("agpl", "received", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl", "document", "gnu", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2.0", "source", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", "distributed", "mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", "contents", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "accompanying", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl-2.0", "accompanying", "eclipse", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v(?:ersion )?)?2 0"),
    ("cddl-1.0", "contents", "distribution", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "accompanying", "common", r"this program and the accompanying materials are made available under the terms of the common public license"),
    ("eupl", "compliance", "licence", r"you may not use this work except in compliance with the licence"),
    ("ms-pl", "governs", "accompanying", r"this license governs use of the accompanying software if you use the software you accept this license"),
    ("artistic", "package", "artistic", r"you may distribute this package under the (?:same )?terms of (?:either the gnu general public license or )?the artistic license"),
    ("artistic", "intent", "package", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("perl", "perl", "redistribute", r"you (?:can|may) redistribute it and or modify it under the same terms as perl(?: itself)?"),
    ("bsl-1.0", "organization", "hereby", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("busl-1.1", "business", "source", r"the business source license (?:this document or the license )?is not an open source license"),
    ("elastic-2.0", "hosted", "managed", r"you may not provide the software to third parties as a hosted or managed service"),
    ("sspl-1.0", "functionality", "service", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("commons-clause", "grant", "sell", r"the (?:grant of rights under the )?license (?:will not include and the license )?does not (?:include and does not )?grant to you the right to sell the software"),
    ("zlib", "arising", "liable", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("zlib", "origin", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered", "plainly", r"altered source versions must be plainly marked as such"),
    ("openssl", "toolkit", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php-3.01", "freely", "php", r"this product includes php software freely available from"),
    ("python-2.0", "licensee", "psf", r"psf is making python(?: [0-9 ]{1,5})? available to licensee on an as is basis"),
    ("python-2.0", "psf", "royalty", r"psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("ruby", "verbatim", "copies", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("w3c", "holders", "provided", r"this work is being provided by the copyright holders under the following license"),
    ("unlicense", "unencumbered", "public", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", "compile", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "verbatim", "changing", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("gpl", "verbatim", "changing", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("beerware", "stuff", "beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer"),
    ("cc0-1.0", "waived", "neighboring", r"(?:has|have) waived all copyright and related or neighboring rights to this work"),
    ("cc-by", "attribution", "commons", _CC + r" attribution" + _KIND),
    ("cc-by-sa", "attribution", "commons", _CC + r" attribution share ?alike" + _KIND),
    ("cc-by-nd", "attribution", "commons", _CC + r" attribution no ?deriv(?:ative)?s" + _KIND),
    ("cc-by-nc", "attribution", "commons", _CC + r" attribution non ?commercial" + _KIND),
    ("cc-by-nc-sa", "attribution", "commons", _CC + r" attribution non ?commercial share ?alike" + _KIND),
    ("cc-by-nc-nd", "attribution", "commons", _CC + r" attribution non ?commercial no ?deriv(?:ative)?s" + _KIND),
    ("cc-by", "licenses", "creativecommons", _HERE + r" by [1234] [05]"),
    ("cc-by-sa", "licenses", "creativecommons", _HERE + r" by sa [1234] [05]"),
    ("cc-by-nd", "licenses", "creativecommons", _HERE + r" by nd [1234] [05]"),
    ("cc-by-nc", "licenses", "creativecommons", _HERE + r" by nc [1234] [05]"),
    ("cc-by-nc-sa", "licenses", "creativecommons", _HERE + r" by nc sa [1234] [05]"),
    ("cc-by-nc-nd", "licenses", "creativecommons", _HERE + r" by nc nd [1234] [05]"),
    ("cc0-1.0", "publicdomain", "creativecommons", r"creativecommons org publicdomain zero 1 0"),
    ("odbl-1.0", "database", "available", r"(?:database|data|dataset) is made available under the open database license"),
    ("ofl-1.1", "font", "sil", r"this font software is licensed under the sil open font license"),
    ("upl-1.0", "condition", "hereby", r"subject to the condition set forth below permission is hereby granted to any person obtaining a copy of this software associated documentation and or data"),
    ("openrail", "restrictions", "derivatives", r"use based restrictions (?:as )?(?:referenced |set forth )?in (?:paragraph 5|attachment a) must be included as an enforceable provision by you in any type of legal agreement for derivatives"),
    ("public-domain", "domain", "public", r"(?:this (?:file|work|code|software|program|text) )?(?:has been|is hereby|is) (?:put|placed|released|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", "unauthorized", "prohibited", r"unauthorized (?:copying|use|distribution|reproduction) of this (?:file|document|software|work|material)(?: via any medium)? is strictly prohibited"),
    ("proprietary", "confidential", "proprietary", r"proprietary and confidential|confidential and proprietary"),
)

#: Words of which a rule's match always holds one; texts without any are not looked at further.
_TAG, _NOTICE = "identifier", "under"
#: Priorities: titles, grants and declarations, tags and addresses, sentences.
LEVELS = (2, 3, 4, 5)


@dataclass(frozen=True)
class Rule:
    rank: int
    label: str
    anchor: str
    keyword: str
    regex: str
    priority: int
    weight: float


def rules() -> list[Rule]:
    """The notices and six signatures a family, in the order of their ranks; every match holds its rule's anchor and
    keyword as words."""
    out: list[Rule] = []
    for label, anchor, keyword, regex in NOTICES:
        out.append(Rule(len(out), label, anchor, keyword, rf"(?<= )(?:{regex})(?= )", 5, 0.97))
    for label, word, name, spdx in FAMILIES:
        first = spdx.split(" ")[0].split("(")[0]
        shapes = (
            (_TAG, first, rf"spdx license identifier (?:{spdx})", 4, 1.0),
            ("licenses", first, rf"(?:opensource org|spdx org|choosealicense com|creativecommons org) licenses (?:{spdx})", 4, 0.95),
            (_NOTICE, word, rf"(?:licen[cs]ed|released|distributed|available|published|provided|redistributed|offered) under (?:the )?(?:terms of )?(?:the )?(?:{name})", 3, 0.9),
            ("license", word, rf"license (?:is )?(?:the )?(?:{name})", 3, 0.8),
            ("licence", word, rf"licence (?:is )?(?:the )?(?:{name})", 3, 0.8),
            ("", word, rf"(?:{name})", 2, 0.7),
        )
        for anchor, keyword, regex, priority, weight in shapes:
            out.append(Rule(len(out), label, anchor, keyword, rf"(?<= ){regex}(?= )", priority, weight))
    return out


def normalised(text: Column) -> Column:
    """Lower-case words between single spaces, with one before the first and after the last; '' without words."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.trim(F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(words == "", F.lit("")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(s: Column) -> Column:
    return (F.octet_length(s) - F.octet_length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


_RULE_TYPE = "array<struct<rank:int,label:string,anchor:string,keyword:string,regex:string,priority:int,weight:double>>"


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections are what remains after suppression, as (start, stop, label, priority, weight) over the characters of
    the normalised text, in order.  score is the greatest weight among them, at least 0.6 where a base phrase
    stands, else 0.  Null and empty texts have no words, labels '' and score 0.  Each row is judged by itself, so
    repeated rows and null ids have a row each; an empty table gives an empty result; other columns are left out.
    """
    any_base = "|".join(p for p, _ in BASE)
    known = rules()
    own_words = sorted({r.keyword for r in known})
    table = F.from_json(F.lit(json.dumps([r.__dict__ for r in known])), _RULE_TYPE)
    rows = docs.select(F.col(id_col).alias("id"), normalised(F.col(text_col)).alias("norm"))
    has = F.col("norm").contains(" license ")
    rows = rows.select(
        "id",
        "norm",
        F.greatest(_spaces(F.col("norm")) - 1, F.lit(0).cast("long")).alias("n_words"),
        F.when(has, F.regexp_count("norm", F.lit(rf"(?<= )(?:{any_base})(?= )"))).otherwise(F.lit(0)).cast("long").alias("n_base"),
        # the keyword prefilter: one pass that finds which keywords a text holds
        F.array_distinct(F.regexp_extract_all("norm", F.lit(rf"(?<= )({'|'.join(own_words)})(?= )"), F.lit(1))).alias("words"),
    )
    first = F.regexp_instr("norm", F.lit(rf"(?<= )(?:{any_base})(?= )"))
    head = F.regexp_extract("norm", rf"(?s)^(.*) (?:{any_base}) ", 1)
    padded = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    gate = F.filter(table, lambda r: F.array_contains(F.col("words"), r["keyword"]) & ((r["anchor"] == "") | F.col("norm").contains(padded(r["anchor"]))))
    hits = F.filter(F.transform(gate, lambda r: F.struct(r.alias("r"), F.regexp_extract_all(F.col("norm"), r["regex"], F.lit(0)).alias("m"))), lambda h: F.size(h["m"]) > 0)

    def intervals(h: Column) -> Column:
        """Each match's place: what stands between matches has the lengths of the pieces of a split."""
        gaps = F.zip_with(h["m"], F.slice(F.split(F.col("norm"), h["r"]["regex"], -1), 1, F.size(h["m"])), lambda m, p: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"))
        step = lambda s, g: F.struct((s["at"] + g["p"] + g["m"]).alias("at"), F.concat(s["out"], F.array(F.struct((s["at"] + g["p"]).alias("start"), (s["at"] + g["p"] + g["m"]).alias("stop")))).alias("out"))
        spans = F.aggregate(gaps, empty, step)["out"]
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("less"), (-h["r"]["priority"]).alias("low"), h["r"]["rank"].alias("rank"), h["r"]["label"].alias("label"), h["r"]["weight"].alias("weight")))

    found = F.array_sort(F.flatten(F.transform(hits, intervals)))
    # in this order a detection comes after all that contain it; e holds the furthest stop by least priority
    kind = "array<struct<start:int,stop:int,label:string,priority:int,weight:double>>"
    nothing = F.struct(*[F.lit(-1).alias(f"e{p}") for p in LEVELS], F.array().cast(kind).alias("out"))

    def sweep(s: Column, d: Column) -> Column:
        stop, priority = -d["less"], -d["low"]
        reach = F.coalesce(*[F.when(priority == p, s[f"e{p}"]) for p in LEVELS])
        one = F.array(F.struct(d["start"].alias("start"), stop.alias("stop"), d["label"].alias("label"), priority.alias("priority"), d["weight"].alias("weight")))
        ends = [F.when(priority >= p, F.greatest(s[f"e{p}"], stop)).otherwise(s[f"e{p}"]).alias(f"e{p}") for p in LEVELS]
        return F.struct(*ends, F.when(reach >= stop, s["out"]).otherwise(F.concat(s["out"], one)).alias("out"))

    kept = F.aggregate(found, nothing, sweep)["out"]
    rows = rows.select(
        "id",
        "n_words",
        "n_base",
        F.when(F.col("n_base") > 0, _spaces(F.substring(F.col("norm"), F.lit(1), first - 1)) - 1).alias("first_word"),
        F.when(F.col("n_base") > 0, _spaces(head)).alias("last_word"),
        F.when(F.col("n_base") > 0, F.filter(F.array(*[F.when(F.col("norm").contains(f" {p} "), F.lit(x)) for p, x in BASE]), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>")).alias("base"),
        F.when(F.size("words") > 0, kept).otherwise(F.array().cast(kind)).alias("detections"),
    )
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    best = F.aggregate("detections", F.when(F.col("n_base") > 0, F.lit(0.6)).otherwise(F.lit(0.0)), lambda s, d: F.greatest(s, d["weight"]))
    return rows.select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", joined(F.col("base")).alias("base_labels"), joined(F.concat("base", F.transform("detections", lambda d: d["label"]))).alias("labels"), best.alias("score"), "detections"
    )
