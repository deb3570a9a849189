"""Signature rules of license scans: label, pattern over words, priority, confidence.

A pattern is read against lower-case words parted by single spaces; marks between words don't count, so ``2.0`` is
``2 0``. ``<L>`` stands for the words for a license, ``<V>`` for an optional word before a version.
"""

from __future__ import annotations

SHORT = {
    "<L>": "(?:license|licence|licensed|licenced|licenses|licences|licensing|lizenz|lizenziert|licencia|licencié)",
    "<V>": "(?: version| versions| v| ver)?",
}

#: Sentences of license texts and of the notices that point to them.
NOTICES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", 60, 0.99),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies", 58, 0.95),
    ("mit-0", r"mit no attribution", 61, 0.97),
    ("x11", r"except as contained in this notice the name of (?:[^ ]+ ){1,12}shall not be used in advertising", 61, 0.95),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 60, 0.99),
    ("0bsd", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 61, 0.97),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:with or )?without fee is hereby granted", 60, 0.97),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", 55, 0.95),
    ("bsd", r"redistributions of source code must retain the above copyright notice", 54, 0.93),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", 54, 0.93),
    ("bsd-3-clause", r"neither the names? of (?:[^ ]+ ){1,30}nor the names? of (?:its|their|any) contributors may be used to endorse", 60, 0.97),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display", 60, 0.97),
    ("bsd-source-code", r"redistributions of source code must retain the above copyright notice without modification", 56, 0.9),
    ("apache-2.0", r"you may not use this file except in compliance with the license", 60, 0.95),
    ("apache-2.0", r"licensed under the apache license version 2 0 the license", 64, 0.99),
    ("apache-2.0", r"www apache org licenses license 2 0", 63, 0.98),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", 57, 0.85),
    ("apache", r"licensed to the apache software foundation asf under one or more contributor license agreements", 57, 0.93),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of", 55, 0.95),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", 54, 0.9),
    ("gpl", r"you should have received a copy of the gnu general public license", 56, 0.95),
    ("gpl-2.0", r"free software foundation either version 2 of the license", 61, 0.95),
    ("gpl-3.0", r"free software foundation either version 3 of the license", 61, 0.95),
    ("gpl-2.0-only", r"terms of the gnu general public license version 2 as published by", 62, 0.96),
    ("gpl-3.0-only", r"terms of the gnu general public license version 3 as published by", 62, 0.96),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license", 58, 0.96),
    ("lgpl-2.1", r"gnu lesser general public license as published by the free software foundation either version 2 1", 63, 0.98),
    ("lgpl-3.0", r"gnu lesser general public license as published by the free software foundation either version 3", 63, 0.98),
    ("agpl", r"you should have received a copy of the gnu affero general public license", 58, 0.97),
    ("agpl-3.0", r"gnu affero general public license as published by the free software foundation either version 3", 63, 0.98),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 61, 0.99),
    ("gpl-exception", r"as a special exception (?:[^ ]+ ){1,20}permission to link", 50, 0.8),
    ("classpath-exception", r"classpath exception", 62, 0.95),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license v 2 0", 65, 0.99),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", 65, 0.99),
    ("mpl", r"mozilla org mpl", 50, 0.85),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", 65, 0.99),
    ("epl-2.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", 65, 0.99),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", 61, 0.98),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", 62, 0.99),
    ("bsl-1.0", r"www boost org license 1 0 txt", 63, 0.98),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 60, 0.97),
    ("zlib", r"altered source versions must be plainly marked as such", 60, 0.95),
    ("libpng", r"this code is released under the libpng license", 61, 0.97),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 65, 0.99),
    ("unlicense", r"unlicense org", 55, 0.9),
    ("wtfpl", r"do what the f(?:uck)? you want(?: to)?(?: public license)?", 60, 0.95),
    ("beerware", r"beer ?ware|buy me a beer in return", 55, 0.9),
    ("public-domain", r"(?:released|dedicated|placed|is|are) (?:in|into|to) the public domain", 40, 0.8),
    ("public-domain", r"(?:waive|waives|disclaims) (?:all )?copyright", 42, 0.75),
    ("public-domain", r"no rights reserved", 41, 0.8),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?", 60, 0.95),
    ("cc0-1.0", r"creativecommons org publicdomain zero 1 0", 66, 0.99),
    ("cc-pdm-1.0", r"creativecommons org publicdomain mark 1 0", 66, 0.99),
    ("cc", r"creative commons", 20, 0.6),
    ("cc", r"some rights reserved", 18, 0.5),
    ("openssl", r"this product includes software developed by the openssl project", 60, 0.96),
    ("ssleay", r"this product includes cryptographic software written by eric young", 60, 0.96),
    ("icu", r"unicode inc license agreement data files and software", 61, 0.96),
    ("curl", r"curl and libcurl are licensed", 58, 0.9),
    ("ofl-1.1", r"this font software is licensed under the sil open font license version 1 1", 65, 0.99),
    ("vim", r"vim is charityware", 60, 0.95),
    ("php-3.01", r"php 3 01", 56, 0.85),
    ("warranty-disclaimer", r"the software is provided as is without warranty of any kind", 30, 0.6),
    ("warranty-disclaimer", r"without warranties or conditions of any kind", 30, 0.6),
    ("warranty-disclaimer", r"this software is provided by (?:[^ ]+ ){1,12}as is and any express or implied warranties", 31, 0.65),
    ("warranty-disclaimer", r"merchantability(?: and| or)? fitness for a particular purpose", 29, 0.6),
    ("liability-disclaimer", r"in no event shall (?:[^ ]+ ){1,12}be liable for any", 29, 0.6),
    ("copyright", r"copyright (?:c )?(?:19|20)[0-9]{2}", 10, 0.4),
    ("copyright", r"(?:19|20)[0-9]{2} copyright", 10, 0.4),
    ("copyright", r"© (?:19|20)[0-9]{2}", 10, 0.4),
    ("copyright", r"all copyrights? (?:is|are) owned by", 12, 0.5),
    ("reserved", r"all rights reserved", 15, 0.7),
    ("reserved", r"alle rechte vorbehalten", 15, 0.7),
    ("reserved", r"tous droits réservés", 15, 0.7),
    ("reserved", r"todos los derechos reservados", 15, 0.7),
    ("reserved", r"tutti i diritti riservati", 15, 0.7),
    ("proprietary", r"proprietary and confidential|confidential and proprietary", 50, 0.9),
    ("proprietary", r"unauthorized (?:copying|reproduction|distribution|use)(?: of this)?", 45, 0.85),
    ("proprietary", r"trade secrets? of", 44, 0.7),
    ("proprietary", r"subject to (?:a|the) non disclosure agreement", 46, 0.85),
    ("proprietary", r"internal use only", 43, 0.7),
    ("proprietary", r"for evaluation purposes only", 43, 0.7),
    ("proprietary", r"end user license agreement|eula", 44, 0.8),
    ("no-redistribution", r"(?:may not|must not|cannot|not) be (?:copied|reproduced|redistributed)", 35, 0.7),
    ("no-redistribution", r"redistribution (?:is )?(?:prohibited|forbidden|not permitted)", 36, 0.75),
    ("no-redistribution", r"without (?:the )?(?:prior |express )?(?:prior )?written (?:permission|consent)", 34, 0.6),
    ("noncommercial", r"non ?commercial (?:use|purposes) only", 37, 0.75),
    ("noncommercial", r"not for commercial use", 37, 0.75),
    ("noncommercial", r"for personal use only", 37, 0.65),
    ("research-only", r"for (?:research|academic|educational) (?:use|purposes) only", 38, 0.75),
    ("no-training", r"(?:may not|must not|not) be used (?:to train|for training)", 48, 0.85),
    ("no-training", r"text and data mining (?:is )?(?:reserved|prohibited|forbidden)", 48, 0.85),
    ("attribution-required", r"attribution is required|please give credit", 25, 0.5),
    ("royalty-free", r"royalty free(?: <L>)?", 24, 0.5),
    ("dual-license", r"dual(?:ly)? licensed|available under (?:two|either) licenses", 27, 0.6),
    ("see-license", r"see (?:the )?<L>(?: file)? for (?:more )?(?:details|information)", 22, 0.5),
    ("see-license", r"see (?:the )?file (?:copying|license|licence)", 22, 0.5),
    ("open-government", r"contains (?:public sector )?information licensed under the open government licence", 60, 0.97),
    ("us-government-work", r"work of the (?:united states|u s) government", 50, 0.8),
)

#: Names that need a word for a license beside them.
NAMES = (
    ("mit", r"(?:the )?(?:mit|expat|x11) (?:style |type )?<L>", 50, 0.9),
    ("mit", r"<L> under (?:the )?(?:terms of the )?(?:mit|expat)", 51, 0.9),
    ("mit", r"<L> mit", 48, 0.85),
    ("isc", r"(?:isc|internet systems consortium) <L>", 50, 0.9),
    ("isc", r"<L> (?:under (?:the )?)?isc", 49, 0.85),
    ("apache", r"apache(?: software)?(?: foundation)? <L>", 50, 0.88),
    ("apache", r"<L> under (?:the )?(?:terms of the )?apache", 49, 0.85),
    ("gpl", r"(?:gnu )?general public <L>", 50, 0.9),
    ("gpl", r"(?:gnu )?gpl(?:ed)?(?: <L>)?", 47, 0.8),
    ("gpl", r"<L> under (?:the )?(?:terms of the )?(?:gnu )?(?:gpl|general public)", 51, 0.9),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public <L>", 53, 0.93),
    ("lgpl", r"(?:gnu )?lgpl(?: <L>)?", 52, 0.88),
    ("agpl", r"(?:gnu )?affero general public <L>", 53, 0.95),
    ("agpl", r"(?:gnu )?agpl(?: <L>)?", 52, 0.9),
    ("gfdl", r"(?:gnu )?free documentation <L>|gfdl", 52, 0.93),
    ("mpl", r"mozilla public <L>", 52, 0.95),
    ("epl", r"eclipse public <L>", 52, 0.95),
    ("edl", r"eclipse distribution <L>", 52, 0.95),
    ("cddl", r"common development and distribution <L>|cddl", 52, 0.95),
    ("cpl", r"common public <L>", 52, 0.9),
    ("cpal", r"common public attribution <L>", 53, 0.94),
    ("ipl", r"ibm public <L>", 52, 0.93),
    ("eupl", r"european union public <L>|eupl", 52, 0.95),
    ("cecill", r"cecill(?: [abc])?(?: <L>)?", 52, 0.9),
    ("osl", r"open software <L>", 52, 0.92),
    ("afl", r"academic free <L>", 52, 0.93),
    ("rpl", r"reciprocal public <L>", 52, 0.93),
    ("qpl", r"q public <L>", 52, 0.9),
    ("apsl", r"apple public source <L>", 52, 0.94),
    ("spl", r"sun public <L>", 52, 0.92),
    ("npl", r"netscape public <L>", 52, 0.93),
    ("nosl", r"netizen open source <L>", 52, 0.93),
    ("artistic", r"(?:perl )?artistic <L>", 52, 0.93),
    ("perl", r"same terms as perl(?: itself)?", 52, 0.9),
    ("bsl", r"boost software <L>|boost <L>", 52, 0.93),
    ("busl", r"business source <L>", 52, 0.93),
    ("sspl", r"server side public <L>|sspl", 52, 0.95),
    ("elastic", r"elastic <L>", 52, 0.9),
    ("confluent", r"confluent community <L>", 52, 0.94),
    ("redis", r"redis source available <L>", 52, 0.94),
    ("commons-clause", r"commons clause", 53, 0.92),
    ("fair-source", r"fair source <L>|functional source <L>", 52, 0.9),
    ("polyform", r"polyform(?: project)? (?:noncommercial|small business|shield|perimeter|strict|internal use)", 53, 0.94),
    ("hippocratic", r"hippocratic <L>", 52, 0.94),
    ("odbl", r"open database <L>|odbl", 52, 0.94),
    ("odc-by", r"open data commons attribution <L>", 53, 0.95),
    ("pddl", r"public domain dedication and <L>|pddl", 53, 0.94),
    ("cdla", r"community data <L> agreement", 52, 0.94),
    ("ogl", r"open government <L>", 52, 0.92),
    ("ogl-rpg", r"open game <L>", 52, 0.9),
    ("orc", r"open rpg creative <L>", 52, 0.9),
    ("ofl", r"(?:sil )?open font <L>", 52, 0.94),
    ("ufl", r"ubuntu font <L>", 52, 0.94),
    ("bitstream-vera", r"bitstream vera <L>", 52, 0.93),
    ("dejavu", r"dejavu fonts? <L>", 52, 0.9),
    ("lppl", r"latex project public <L>|lppl", 52, 0.94),
    ("php", r"php <L>", 52, 0.9),
    ("python", r"python(?: software foundation)? <L>|psf <L>", 52, 0.9),
    ("ruby", r"ruby <L>|same terms as ruby(?: itself)?", 51, 0.88),
    ("tcl", r"tcl(?: tk)? <L>", 51, 0.85),
    ("lua", r"lua <L>", 51, 0.8),
    ("zpl", r"zope public <L>|zpl", 52, 0.93),
    ("w3c", r"w3c software(?: notice)?(?: and)?(?: document)? <L>", 52, 0.94),
    ("ms-pl", r"microsoft public <L>|ms pl", 52, 0.92),
    ("ms-rl", r"microsoft reciprocal <L>|ms rl", 52, 0.92),
    ("ms-lpl", r"microsoft limited public <L>", 52, 0.92),
    ("zlib", r"zlib(?: libpng)? <L>", 52, 0.92),
    ("libpng", r"libpng <L>", 51, 0.9),
    ("libtiff", r"libtiff <L>", 51, 0.9),
    ("ijg", r"independent jpeg group(?: s)? <L>", 51, 0.9),
    ("ncsa", r"university of illinois(?: ncsa)?(?: open source)? <L>|ncsa <L>", 52, 0.93),
    ("upl", r"universal permissive <L>", 52, 0.94),
    ("uncopyright", r"the unlicense|unlicensed? into the public domain", 52, 0.9),
    ("postgresql", r"postgresql <L>", 52, 0.93),
    ("mysql-foss", r"mysql foss <L> exception", 53, 0.93),
    ("openssl", r"openssl(?: ssleay)? <L>", 52, 0.93),
    ("openldap", r"openldap public <L>", 52, 0.94),
    ("sleepycat", r"sleepycat(?: public)? <L>", 52, 0.94),
    ("json", r"json <L>|shall be used for good not evil", 52, 0.92),
    ("wxwindows", r"wxwindows(?: library)? <L>", 52, 0.94),
    ("sgi-b", r"sgi free software <L>", 52, 0.93),
    ("intel", r"intel simplified software <L>", 52, 0.92),
    ("nvidia", r"nvidia(?: source code)? <L>", 51, 0.88),
    ("oracle", r"oracle technology network <L>", 52, 0.92),
    ("vim", r"vim <L>", 51, 0.88),
    ("nasa", r"nasa open source agreement", 52, 0.94),
    ("eiffel", r"eiffel forum <L>", 52, 0.94),
    ("naumen", r"naumen public <L>", 52, 0.94),
    ("nethack", r"nethack general public <L>", 53, 0.94),
    ("fair", r"fair <L>", 46, 0.6),
    ("mulan", r"mulan(?: permissive software| psl| public)(?: <L>)?", 52, 0.93),
    ("artistic-clarified", r"clarified artistic <L>", 53, 0.95),
    ("openrail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m| s)?(?: <L>)?|rail <L>", 52, 0.92),
    ("llama", r"llama (?:2 |3 )?community <L>", 52, 0.94),
    ("gemma", r"gemma terms of use", 52, 0.93),
    ("cern-ohl", r"cern open hardware <L>|cern ohl", 52, 0.94),
    ("solderpad", r"solderpad(?: hardware)? <L>", 52, 0.94),
    ("tapr", r"tapr open hardware <L>", 52, 0.94),
    ("bsd-0-clause", r"(?:0|zero) clause bsd(?: <L>)?|bsd zero clause(?: <L>)?", 54, 0.95),
    ("bsd-1-clause", r"(?:1|one) clause bsd(?: <L>)?|bsd (?:1|one) clause(?: <L>)?", 54, 0.93),
    ("bsd-2-clause", r"(?:2|two) clause bsd(?: <L>)?|bsd (?:2|two) clause(?: <L>)?", 54, 0.95),
    ("bsd-2-clause", r"(?:simplified bsd|freebsd) <L>", 54, 0.93),
    ("bsd-3-clause", r"(?:3|three) clause bsd(?: <L>)?|bsd (?:3|three) clause(?: <L>)?", 54, 0.95),
    ("bsd-3-clause", r"(?:new|modified|revised) bsd(?: <L>)?", 54, 0.93),
    ("bsd-4-clause", r"(?:4|four) clause bsd(?: <L>)?|bsd (?:4|four) clause(?: <L>)?", 54, 0.95),
    ("bsd-4-clause", r"original bsd <L>", 54, 0.93),
    ("bsd", r"bsd (?:style |type )?<L>", 50, 0.88),
    ("bsd", r"<L> (?:under (?:the )?)?bsd", 49, 0.85),
    ("public-domain", r"public domain <L>", 43, 0.75),
    ("open-source", r"open source <L>", 21, 0.5),
    ("free-software", r"free software <L>", 21, 0.5),
    ("copyleft", r"copyleft", 20, 0.5),
    ("cc", r"creative commons <L>|creativecommons org licenses", 40, 0.8),
    ("cc-by", r"cc by|(?:creative commons|cc) attribution", 45, 0.85),
    ("cc-by-sa", r"cc by sa|(?:creative commons|cc) attribution share ?alike", 46, 0.9),
    ("cc-by-nd", r"cc by nd|(?:creative commons|cc) attribution no ?deriv(?:ative)?s?", 46, 0.9),
    ("cc-by-nc", r"cc by nc|(?:creative commons|cc) attribution non ?commercial", 46, 0.9),
    ("cc-by-nc-sa", r"cc by nc sa|(?:creative commons|cc) attribution non ?commercial share ?alike", 47, 0.92),
    ("cc-by-nc-nd", r"cc by nc nd|(?:creative commons|cc) attribution non ?commercial no ?deriv(?:ative)?s?", 47, 0.92),
    ("proprietary", r"(?:commercial|proprietary) <L>", 39, 0.7),
    ("site-license", r"(?:site|volume|seat|floating) <L>", 30, 0.5),
    ("trial", r"(?:trial|evaluation|shareware) <L>", 30, 0.6),
    ("spdx", r"spdx license identifier", 19, 0.6),
)

#: Families whose versions are told apart: label, what stands before the version, versions.
VERSIONS = (
    ("apache", r"apache(?: software)?(?: <L>)?", ("1.0", "1.1", "2.0")),
    ("gpl", r"(?:gnu )?(?:gpl|general public <L>)", ("1.0", "2.0", "3.0")),
    ("lgpl", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public <L>)", ("2.0", "2.1", "3.0")),
    ("agpl", r"(?:gnu )?(?:agpl|affero general public <L>)", ("1.0", "3.0")),
    ("gfdl", r"(?:gnu )?(?:gfdl|free documentation <L>)", ("1.1", "1.2", "1.3")),
    ("mpl", r"mpl|mozilla public <L>", ("1.0", "1.1", "2.0")),
    ("epl", r"epl|eclipse public <L>", ("1.0", "2.0")),
    ("cddl", r"cddl|common development and distribution <L>", ("1.0", "1.1")),
    ("cpl", r"cpl|common public <L>", ("1.0",)),
    ("eupl", r"eupl|european union public <L>", ("1.0", "1.1", "1.2")),
    ("osl", r"osl|open software <L>", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", r"afl|academic free <L>", ("1.2", "2.0", "2.1", "3.0")),
    ("artistic", r"(?:perl )?artistic(?: <L>)?", ("1.0", "2.0")),
    ("bsl", r"bsl|boost software(?: <L>)?", ("1.0",)),
    ("busl", r"busl|business source <L>", ("1.1",)),
    ("odbl", r"odbl|open database <L>", ("1.0",)),
    ("ofl", r"ofl|(?:sil )?open font <L>", ("1.0", "1.1")),
    ("php", r"php <L>", ("3.0", "3.01")),
    ("psf", r"psf|python software foundation <L>", ("2.0",)),
    ("zpl", r"zpl|zope public <L>", ("1.1", "2.0", "2.1")),
    ("cecill", r"cecill(?: <L>)?", ("1.0", "2.0", "2.1")),
    ("elastic", r"elastic <L>", ("2.0",)),
    ("cc-by", r"cc by|(?:creative commons|cc) attribution(?: <L>)?", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-sa", r"cc by sa|(?:creative commons|cc) attribution share ?alike(?: <L>)?", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nd", r"cc by nd|(?:creative commons|cc) attribution no ?deriv(?:ative)?s?(?: <L>)?", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc", r"cc by nc|(?:creative commons|cc) attribution non ?commercial(?: <L>)?", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-sa", r"cc by nc sa|(?:creative commons|cc) attribution non ?commercial share ?alike(?: <L>)?", ("1.0", "2.0", "2.5", "3.0", "4.0")),
    ("cc-by-nc-nd", r"cc by nc nd|(?:creative commons|cc) attribution non ?commercial no ?deriv(?:ative)?s?(?: <L>)?", ("1.0", "2.0", "2.5", "3.0", "4.0")),
)


def version_rules() -> list[tuple[str, str, int, float]]:
    """Per version of a family: its full number; its major number behind ``version``, ``v`` or a word for a license; its URL."""
    out = []
    for name, said, versions in VERSIONS:
        for v in versions:
            major, minor = v.split(".")
            full, sure = rf"{major} {minor}", said.replace("(?: <L>)?", " <L>")
            label = f"{name}-{v}"
            out.append((label, rf"(?:{said})<V> {full}(?: <L>)?(?: only| or later| or newer| international| unported)?", 58, 0.96))
            out.append((label, rf"<L> under (?:the )?(?:terms of (?:the )?)?(?:{said})<V> {full}(?: <L>)?", 62, 0.98))
            out.append((label, rf"(?:{said}) ?v?{full}", 57, 0.95))  # `apache2 0`, `gplv2 1`
            if minor == "0":
                out.append((label, rf"<L> under (?:the )?(?:terms of (?:the )?)?(?:{sure})(?: version| v)? {major}", 61, 0.95))
                out.append((label, rf"(?:{sure})(?: version| v) {major}(?: only| or later| or newer)?", 57, 0.93))
                out.append((label, rf"(?:{sure}) ?v{major}(?: only| or later)?", 57, 0.93))
                if "<L>" in sure:
                    out.append((label, rf"(?:{sure}) {major}(?: only| or later)?", 56, 0.9))
            if name.startswith("cc-"):
                out.append((label, rf"creativecommons org licenses {name[3:].replace('-', ' ')} {full}", 66, 0.99))
    return out
