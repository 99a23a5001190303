r"""Signatures of license texts, notices, names and addresses, written out one by one.

A signature runs only on texts that hold its keyword, a single word that each of its matches
contains. Patterns are for text with A-Z lower-cased and keep to what Java, RE2 and Python read
alike; a space in a pattern stands for any run of spaces, tabs and line breaks, in [- ] for one of
them. Priority 0 is the
strongest. The order of the table settles what is equal otherwise.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    keyword: str
    pattern: str
    priority: int  # 0 is strongest
    label: str
    score: float


# label, keyword, pattern, priority, score
SIGNATURES: tuple[tuple[str, str, str, int, float], ...] = (
    # identifiers
    ("apache-2.0", "spdx", r"spdx-license-identifier:[\x20\t]*apache-2\.0", 0, 1.0),
    ("apache-1.1", "spdx", r"spdx-license-identifier:[\x20\t]*apache-1\.1", 0, 1.0),
    ("mit", "spdx", r"spdx-license-identifier:[\x20\t]*\(?mit\b", 0, 1.0),
    ("mit-0", "spdx", r"spdx-license-identifier:[\x20\t]*mit-0\b", 0, 1.0),
    ("bsd-2-clause", "spdx", r"spdx-license-identifier:[\x20\t]*bsd-2-clause", 0, 1.0),
    ("bsd-3-clause", "spdx", r"spdx-license-identifier:[\x20\t]*bsd-3-clause", 0, 1.0),
    ("isc", "spdx", r"spdx-license-identifier:[\x20\t]*isc\b", 0, 1.0),
    ("gpl-2.0-or-later", "spdx", r"spdx-license-identifier:[\x20\t]*gpl-2\.0(?:-or-later|\+)", 0, 1.0),
    ("gpl-2.0", "spdx", r"spdx-license-identifier:[\x20\t]*gpl-2\.0(?:-only)?", 0, 0.99),
    ("gpl-3.0-or-later", "spdx", r"spdx-license-identifier:[\x20\t]*gpl-3\.0(?:-or-later|\+)", 0, 1.0),
    ("gpl-3.0", "spdx", r"spdx-license-identifier:[\x20\t]*gpl-3\.0(?:-only)?", 0, 0.99),
    ("lgpl-2.1", "spdx", r"spdx-license-identifier:[\x20\t]*lgpl-2\.1(?:-only|-or-later|\+)?", 0, 1.0),
    ("lgpl-3.0", "spdx", r"spdx-license-identifier:[\x20\t]*lgpl-3\.0(?:-only|-or-later|\+)?", 0, 1.0),
    ("agpl-3.0", "spdx", r"spdx-license-identifier:[\x20\t]*agpl-3\.0(?:-only|-or-later|\+)?", 0, 1.0),
    ("mpl-2.0", "spdx", r"spdx-license-identifier:[\x20\t]*mpl-2\.0(?:-only)?", 0, 1.0),
    ("epl-1.0", "spdx", r"spdx-license-identifier:[\x20\t]*epl-1\.0", 0, 1.0),
    ("epl-2.0", "spdx", r"spdx-license-identifier:[\x20\t]*epl-2\.0", 0, 1.0),
    ("cc0-1.0", "spdx", r"spdx-license-identifier:[\x20\t]*cc0-1\.0", 0, 1.0),
    ("cc-by-4.0", "spdx", r"spdx-license-identifier:[\x20\t]*cc-by-4\.0", 0, 1.0),
    ("cc-by-sa-4.0", "spdx", r"spdx-license-identifier:[\x20\t]*cc-by-sa-4\.0", 0, 1.0),
    ("cc-by-nc-4.0", "spdx", r"spdx-license-identifier:[\x20\t]*cc-by-nc-4\.0", 0, 1.0),
    ("bsl-1.0", "spdx", r"spdx-license-identifier:[\x20\t]*bsl-1\.0", 0, 1.0),
    ("unlicense", "spdx", r"spdx-license-identifier:[\x20\t]*unlicense\b", 0, 1.0),
    ("zlib", "spdx", r"spdx-license-identifier:[\x20\t]*zlib\b", 0, 1.0),
    # addresses
    ("apache-2.0", "apache", r"apache\.org/licen[sc]es/license-2\.0", 0, 0.98),
    ("apache-1.1", "apache", r"apache\.org/licen[sc]es/license-1\.1", 0, 0.98),
    ("mit", "opensource", r"opensource\.org/licenses?/mit\b", 0, 0.98),
    ("bsd-2-clause", "opensource", r"opensource\.org/licenses?/bsd-2-clause", 0, 0.98),
    ("bsd-3-clause", "opensource", r"opensource\.org/licenses?/bsd-3-clause", 0, 0.98),
    ("isc", "opensource", r"opensource\.org/licenses?/isc\b", 0, 0.98),
    ("osl-3.0", "opensource", r"opensource\.org/licenses?/osl-3\.0", 0, 0.98),
    ("afl-3.0", "opensource", r"opensource\.org/licenses?/afl-3\.0", 0, 0.98),
    ("gpl-2.0", "opensource", r"opensource\.org/licenses?/gpl-2\.0", 0, 0.98),
    ("gpl-3.0", "opensource", r"opensource\.org/licenses?/gpl-3\.0", 0, 0.98),
    ("gpl-2.0", "gnu", r"gnu\.org/licen[sc]es/(?:old-licenses/)?gpl-2\.0", 0, 0.98),
    ("gpl-3.0", "gnu", r"gnu\.org/licen[sc]es/gpl-3\.0", 0, 0.98),
    ("lgpl-2.1", "gnu", r"gnu\.org/licen[sc]es/(?:old-licenses/)?lgpl-2\.1", 0, 0.98),
    ("lgpl-3.0", "gnu", r"gnu\.org/licen[sc]es/lgpl-3\.0", 0, 0.98),
    ("agpl-3.0", "gnu", r"gnu\.org/licen[sc]es/agpl-3\.0", 0, 0.98),
    ("gfdl", "gnu", r"gnu\.org/(?:licen[sc]es|copyleft)/fdl", 0, 0.95),
    ("gpl", "gnu", r"gnu\.org/(?:licen[sc]es|copyleft)/gpl\.", 1, 0.9),
    ("mpl-2.0", "mozilla", r"mozilla\.org/(?:en-us/)?mpl/2\.0", 0, 0.98),
    ("mpl-1.1", "mozilla", r"mozilla\.org/mpl/mpl-1\.1", 0, 0.98),
    ("epl-1.0", "eclipse", r"eclipse\.org/(?:org/documents|legal)/epl-v10", 0, 0.98),
    ("epl-2.0", "eclipse", r"eclipse\.org/legal/epl-(?:2\.0|v20)", 0, 0.98),
    ("bsl-1.0", "boost", r"boost\.org/license_1_0\.txt", 0, 0.98),
    ("unlicense", "unlicense", r"\bunlicense\.org\b", 0, 0.98),
    ("wtfpl", "wtfpl", r"\bwtfpl\.net\b", 0, 0.98),
    ("ofl-1.1", "sil", r"scripts\.sil\.org/ofl", 0, 0.95),
    ("odbl", "opendatacommons", r"opendatacommons\.org/licenses/odbl", 0, 0.98),
    ("odc-by", "opendatacommons", r"opendatacommons\.org/licenses/by\b", 0, 0.98),
    ("pddl", "opendatacommons", r"opendatacommons\.org/licenses/pddl", 0, 0.98),
    ("cc-by-4.0", "creativecommons", r"creativecommons\.org/licenses/by/4\.0", 0, 0.98),
    ("cc-by-3.0", "creativecommons", r"creativecommons\.org/licenses/by/3\.0", 0, 0.98),
    ("cc-by-2.0", "creativecommons", r"creativecommons\.org/licenses/by/2\.[05]", 0, 0.98),
    ("cc-by-sa-4.0", "creativecommons", r"creativecommons\.org/licenses/by-sa/4\.0", 0, 0.98),
    ("cc-by-sa-3.0", "creativecommons", r"creativecommons\.org/licenses/by-sa/3\.0", 0, 0.98),
    ("cc-by-sa-2.0", "creativecommons", r"creativecommons\.org/licenses/by-sa/2\.[05]", 0, 0.98),
    ("cc-by-nc", "creativecommons", r"creativecommons\.org/licenses/by-nc/[0-9.]+", 0, 0.98),
    ("cc-by-nd", "creativecommons", r"creativecommons\.org/licenses/by-nd/[0-9.]+", 0, 0.98),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons\.org/licenses/by-nc-sa/[0-9.]+", 0, 0.98),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons\.org/licenses/by-nc-nd/[0-9.]+", 0, 0.98),
    ("cc0-1.0", "creativecommons", r"creativecommons\.org/publicdomain/zero/1\.0", 0, 0.98),
    ("public-domain", "creativecommons", r"creativecommons\.org/publicdomain/mark/1\.0", 0, 0.98),
    # apache
    ("apache-2.0", "apache", r"licen[sc]ed under the apache licen[sc]e,? version 2(?:\.0)?\b", 0, 0.97),
    ("apache-2.0", "apache", r"\bapache(?: software)? licen[sc]e,? \(?(?:version |v\.?[\x20]?)?2(?:\.0)?\b", 1, 0.95),
    ("apache-2.0", "apache", r"\bapache[- ]2(?:\.0)?\b", 1, 0.85),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the licen[sc]e", 1, 0.85),
    ("apache-2.0", "governing", r"specific language governing permissions and limitations under the licen[sc]e", 1, 0.8),
    ("apache-1.1", "apache", r"\bapache(?: software)? licen[sc]e,? \(?(?:version |v\.?[\x20]?)?1\.1\b", 1, 0.95),
    ("apache-1.0", "apache", r"\bapache(?: software)? licen[sc]e,? \(?(?:version |v\.?[\x20]?)?1\.0\b", 1, 0.95),
    ("apache", "apache", r"\bapache(?: software)? licen[sc]e\b", 2, 0.7),
    # mit and its kin
    ("mit", "permission", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", 0, 0.98),
    ("mit", "permission", r"permission is hereby granted,? free of charge", 1, 0.9),
    ("mit", "substantial", r"shall be included in all copies or substantial portions of the software", 1, 0.9),
    ("mit", "licen", r"\bmit licen[sc]e\b", 1, 0.9),
    ("mit", "licen", r"\bexpat licen[sc]e\b", 1, 0.9),
    ("mit", "licen", r"licen[sc]ed under (?:the )?(?:terms of (?:the )?)?mit\b", 1, 0.95),
    ("mit", "released", r"released under (?:the )?(?:terms of (?:the )?)?mit\b", 1, 0.9),
    ("x11", "licen", r"\bx11 licen[sc]e\b", 1, 0.9),
    ("mit-0", "attribution", r"\bmit no attribution\b", 1, 0.95),
    ("isc", "permission", r"permission to use,? copy,? modify,? and/or distribute this software", 0, 0.97),
    ("isc", "licen", r"\bisc licen[sc]e\b", 1, 0.9),
    ("ncsa", "licen", r"\b(?:university of illinois/)?ncsa open source licen[sc]e\b", 1, 0.9),
    ("curl", "licen", r"\bcurl licen[sc]e\b", 1, 0.85),
    ("icu", "licen", r"\bicu licen[sc]e\b", 1, 0.85),
    ("hpnd", "historical", r"\bhistorical permission notice and disclaimer\b", 1, 0.9),
    # bsd
    ("bsd", "redistribution", r"redistribution and use in source and binary forms", 1, 0.95),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice", 1, 0.9),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 1, 0.9),
    ("bsd-2-clause", "clause", r"\b(?:2|two)[- ]clause bsd\b", 1, 0.9),
    ("bsd-2-clause", "clause", r"\bbsd[- ](?:2|two)[- ]clause\b", 1, 0.9),
    ("bsd-2-clause", "simplified", r"\bsimplified bsd\b", 1, 0.9),
    ("bsd-2-clause", "freebsd", r"\bfreebsd licen[sc]e\b", 1, 0.9),
    ("bsd-3-clause", "clause", r"\b(?:3|three)[- ]clause bsd\b", 1, 0.9),
    ("bsd-3-clause", "clause", r"\bbsd[- ](?:3|three)[- ]clause\b", 1, 0.9),
    ("bsd-3-clause", "bsd", r"\b(?:new|modified|revised) bsd\b", 1, 0.85),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived", 1, 0.9),
    ("bsd-4-clause", "clause", r"\b(?:4|four)[- ]clause bsd\b", 1, 0.9),
    ("bsd-4-clause", "clause", r"\bbsd[- ](?:4|four)[- ]clause\b", 1, 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features", 1, 0.9),
    ("0bsd", "bsd", r"\b(?:0bsd|zero[- ]clause bsd)\b", 1, 0.9),
    ("bsd", "bsd", r"\bbsd(?:[- ]style)? licen[sc]e\b", 2, 0.75),
    # gpl
    ("gpl-2.0-or-later", "later", r"general public licen[sc]e as published by the free software foundation[;,] either version 2 of the licen[sc]e,? or \(?at your option\)? any later version", 0, 0.98),
    ("gpl-3.0-or-later", "later", r"general public licen[sc]e as published by the free software foundation[;,] either version 3 of the licen[sc]e,? or \(?at your option\)? any later version", 0, 0.98),
    ("gpl-or-later", "later", r"either version [123](?:\.[0-9])? of the licen[sc]e,? or \(?at your option\)? any later version", 1, 0.9),
    ("gpl-1.0", "public", r"\b(?:gnu )?general public licen[sc]e,? \(?(?:gpl\)? )?(?:version |v\.?[\x20]?)1(?:\.0)?\b", 1, 0.93),
    ("gpl-2.0", "public", r"\b(?:gnu )?general public licen[sc]e,? \(?(?:gpl\)? )?(?:version |v\.?[\x20]?)2(?:\.0)?\b", 1, 0.95),
    ("gpl-3.0", "public", r"\b(?:gnu )?general public licen[sc]e,? \(?(?:gpl\)? )?(?:version |v\.?[\x20]?)3(?:\.0)?\b", 1, 0.95),
    ("gpl-2.0", "gpl", r"\bgpl[- ]?v?2(?:\.0)?\b\+?", 1, 0.85),
    ("gpl-3.0", "gpl", r"\bgpl[- ]?v?3(?:\.0)?\b\+?", 1, 0.85),
    ("gpl", "program", r"this program is free software[;:] you can redistribute it and/or modify", 1, 0.9),
    ("gpl", "gnu", r"\bgnu gpl\b", 2, 0.8),
    ("gpl", "public", r"\bgnu general public licen[sc]e\b", 2, 0.8),
    ("gpl-classpath", "classpath", r"\bclasspath exception\b", 1, 0.9),
    ("gpl-warranty", "merchantability", r"without even the implied warranty of merchantability or fitness for a particular purpose", 2, 0.6),
    # lgpl, agpl, gfdl
    ("lgpl-2.0", "library", r"\b(?:gnu )?library general public licen[sc]e\b", 1, 0.9),
    ("lgpl-2.1", "lesser", r"\b(?:gnu )?lesser general public licen[sc]e,? \(?(?:version |v\.?[\x20]?)2\.1\b", 1, 0.95),
    ("lgpl-3.0", "lesser", r"\b(?:gnu )?lesser general public licen[sc]e,? \(?(?:version |v\.?[\x20]?)3(?:\.0)?\b", 1, 0.95),
    ("lgpl", "lesser", r"\b(?:gnu )?lesser general public licen[sc]e\b", 1, 0.85),
    ("lgpl-2.1", "lgpl", r"\blgpl[- ]?v?2\.1\b\+?", 1, 0.9),
    ("lgpl-3.0", "lgpl", r"\blgpl[- ]?v?3(?:\.0)?\b\+?", 1, 0.9),
    ("lgpl", "lgpl", r"\blgpl\b", 2, 0.75),
    ("lgpl", "library", r"this library is free software[;:] you can redistribute it and/or modify", 1, 0.9),
    ("agpl-3.0", "affero", r"\b(?:gnu )?affero general public licen[sc]e,? \(?(?:version |v\.?[\x20]?)3(?:\.0)?\b", 1, 0.95),
    ("agpl", "affero", r"\b(?:gnu )?affero general public licen[sc]e\b", 1, 0.85),
    ("agpl-3.0", "agpl", r"\bagpl[- ]?v?3(?:\.0)?\b\+?", 1, 0.9),
    ("agpl", "agpl", r"\bagpl\b", 2, 0.75),
    ("gfdl-1.2", "documentation", r"\bgnu free documentation licen[sc]e,? \(?(?:version |v\.?[\x20]?)1\.2\b", 1, 0.95),
    ("gfdl-1.3", "documentation", r"\bgnu free documentation licen[sc]e,? \(?(?:version |v\.?[\x20]?)1\.3\b", 1, 0.95),
    ("gfdl", "documentation", r"\bgnu free documentation licen[sc]e\b", 2, 0.8),
    ("gfdl", "invariant", r"with no invariant sections,? no front-cover texts", 1, 0.9),
    # mozilla, eclipse, sun, ibm, apple, microsoft
    ("mpl-2.0", "mozilla", r"subject to the terms of the mozilla public licen[sc]e,? v\. 2\.0", 0, 0.98),
    ("mpl-2.0", "mozilla", r"\bmozilla public licen[sc]e,? \(?(?:version |v\.?[\x20]?)?2\.0\b", 1, 0.95),
    ("mpl-1.1", "mozilla", r"\bmozilla public licen[sc]e,? \(?(?:version |v\.?[\x20]?)?1\.1\b", 1, 0.95),
    ("mpl-1.0", "mozilla", r"\bmozilla public licen[sc]e,? \(?(?:version |v\.?[\x20]?)?1\.0\b", 1, 0.95),
    ("mpl", "mozilla", r"\bmozilla public licen[sc]e\b", 2, 0.75),
    ("npl", "netscape", r"\bnetscape public licen[sc]e\b", 1, 0.9),
    ("epl-1.0", "eclipse", r"\beclipse public licen[sc]e,? \(?(?:-? ?version |-? ?v\.?[\x20]?)?1\.0\b", 1, 0.95),
    ("epl-2.0", "eclipse", r"\beclipse public licen[sc]e,? \(?(?:-? ?version |-? ?v\.?[\x20]?)?2\.0\b", 1, 0.95),
    ("epl", "eclipse", r"\beclipse public licen[sc]e\b", 2, 0.75),
    ("epl", "accompanying", r"this program and the accompanying materials are made available under", 1, 0.85),
    ("edl-1.0", "eclipse", r"\beclipse distribution licen[sc]e\b", 1, 0.9),
    ("cddl-1.1", "cddl", r"\bcddl[- ]?(?:version |v)?1\.1\b", 1, 0.9),
    ("cddl-1.0", "cddl", r"\bcddl[- ]?(?:version |v)?1\.0\b", 1, 0.9),
    ("cddl", "distribution", r"\bcommon development and distribution licen[sc]e\b", 2, 0.85),
    ("cpl-1.0", "common", r"\bcommon public licen[sc]e\b", 1, 0.85),
    ("cpal-1.0", "common", r"\bcommon public attribution licen[sc]e\b", 1, 0.9),
    ("ipl-1.0", "ibm", r"\bibm public licen[sc]e\b", 1, 0.9),
    ("apsl-2.0", "apple", r"\bapple public source licen[sc]e,? \(?(?:version |v\.?[\x20]?)?2\.0\b", 1, 0.95),
    ("apsl", "apple", r"\bapple public source licen[sc]e\b", 2, 0.85),
    ("ms-pl", "microsoft", r"\bmicrosoft public licen[sc]e\b", 1, 0.9),
    ("ms-rl", "microsoft", r"\bmicrosoft reciprocal licen[sc]e\b", 1, 0.9),
    # european and national
    ("eupl-1.1", "european", r"\beuropean union public licen[sc]e,? \(?(?:version |v\.?[\x20]?)?1\.1\b", 1, 0.95),
    ("eupl-1.2", "european", r"\beuropean union public licen[sc]e,? \(?(?:version |v\.?[\x20]?)?1\.2\b", 1, 0.95),
    ("eupl", "european", r"\beuropean union public licen[sc]e\b", 2, 0.8),
    ("eupl", "eupl", r"\beupl\b", 2, 0.75),
    ("cecill-2.1", "cecill", r"\bcecill[- ]?(?:version |v)?2\.1\b", 1, 0.9),
    ("cecill-b", "cecill", r"\bcecill-b\b", 1, 0.9),
    ("cecill-c", "cecill", r"\bcecill-c\b", 1, 0.9),
    ("cecill", "cecill", r"\bcecill\b", 2, 0.75),
    ("ogl-uk", "government", r"\bopen government licen[sc]e\b", 1, 0.9),
    ("etalab", "etalab", r"\blicence ouverte(?: /)? ?(?:open licence )?etalab\b", 1, 0.9),
    ("dl-de-by", "datenlizenz", r"\bdatenlizenz deutschland\b", 1, 0.9),
    ("mulan-2.0", "mulan", r"\bmulan permissive software licen[sc]e\b", 1, 0.9),
    # single licenses
    ("artistic-2.0", "artistic", r"\bartistic licen[sc]e,? \(?(?:version |v\.?[\x20]?)?2(?:\.0)?\b", 1, 0.95),
    ("artistic", "artistic", r"\bartistic licen[sc]e\b", 2, 0.75),
    ("perl", "perl", r"under the same terms as perl itself", 1, 0.9),
    ("bsl-1.0", "boost", r"\bboost software licen[sc]e\b", 1, 0.9),
    ("busl-1.1", "business", r"\bbusiness source licen[sc]e\b", 1, 0.9),
    ("sspl-1.0", "server", r"\bserver side public licen[sc]e\b", 1, 0.9),
    ("elastic-2.0", "elastic", r"\belastic licen[sc]e\b", 1, 0.9),
    ("commons-clause", "commons", r"\bcommons clause\b", 1, 0.9),
    ("afl-3.0", "academic", r"\bacademic free licen[sc]e\b", 1, 0.85),
    ("osl-3.0", "open", r"\bopen software licen[sc]e\b", 1, 0.85),
    ("ofl-1.1", "font", r"\b(?:sil )?open font licen[sc]e\b", 1, 0.9),
    ("zpl", "zope", r"\bzope public licen[sc]e\b", 1, 0.9),
    ("php-3.01", "php", r"\bphp licen[sc]e\b", 1, 0.85),
    ("psf-2.0", "python", r"\bpython software foundation licen[sc]e\b", 1, 0.9),
    ("ruby", "ruby", r"\bruby licen[sc]e\b", 1, 0.8),
    ("lppl", "latex", r"\blatex project public licen[sc]e\b", 1, 0.9),
    ("openssl", "openssl", r"\bopenssl licen[sc]e\b", 1, 0.9),
    ("rpl", "reciprocal", r"\breciprocal public licen[sc]e\b", 1, 0.9),
    ("qpl", "public", r"\bq public licen[sc]e\b", 1, 0.9),
    ("zlib", "zlib", r"\bzlib(?:/libpng)? licen[sc]e\b", 1, 0.9),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 1, 0.95),
    ("zlib", "as-is", r"this software is provided 'as-is'", 1, 0.85),
    ("libpng", "libpng", r"\blibpng licen[sc]e\b", 1, 0.85),
    ("beerware", "beer", r"\bbeer-?ware licen[sc]e\b", 1, 0.9),
    ("wtfpl", "want", r"\bdo what the f\S+ you want to public licen[sc]e\b", 1, 0.95),
    ("wtfpl", "wtfpl", r"\bwtfpl\b", 1, 0.85),
    ("json", "evil", r"shall be used for good,? not evil", 1, 0.95),
    ("llvm-exception", "llvm", r"\bllvm[- ]exceptions?\b", 1, 0.9),
    ("odbl", "database", r"\bopen database licen[sc]e\b", 1, 0.9),
    ("odc-by", "commons", r"\bopen data commons attribution licen[sc]e\b", 1, 0.9),
    # creative commons
    ("cc0-1.0", "cc0", r"\bcc0[- ]?1\.0\b", 1, 0.95),
    ("cc0", "cc0", r"\bcc0\b", 2, 0.85),
    ("cc0", "dedication", r"\bpublic domain dedication\b", 1, 0.85),
    ("cc-by-nc-nd", "cc", r"\bcc[- ]by[- ]nc[- ]nd(?:[- ][1-4]\.[05])?\b", 1, 0.95),
    ("cc-by-nc-sa", "cc", r"\bcc[- ]by[- ]nc[- ]sa(?:[- ][1-4]\.[05])?\b", 1, 0.95),
    ("cc-by-nc", "cc", r"\bcc[- ]by[- ]nc(?:[- ][1-4]\.[05])?\b", 1, 0.9),
    ("cc-by-nd", "cc", r"\bcc[- ]by[- ]nd(?:[- ][1-4]\.[05])?\b", 1, 0.9),
    ("cc-by-sa", "cc", r"\bcc[- ]by[- ]sa(?:[- ][1-4]\.[05])?\b", 1, 0.9),
    ("cc-by-4.0", "cc", r"\bcc[- ]by[- ]4\.0\b", 1, 0.9),
    ("cc-by-3.0", "cc", r"\bcc[- ]by[- ]3\.0\b", 1, 0.9),
    ("cc-by", "cc", r"\bcc[- ]by\b", 2, 0.8),
    ("cc-by-nc-sa", "attribution", r"\battribution[- ]+non-?commercial[- ]+share-?alike\b", 1, 0.95),
    ("cc-by-nc-nd", "attribution", r"\battribution[- ]+non-?commercial[- ]+no-?derivative(?:s|[- ]works)?\b", 1, 0.95),
    ("cc-by-nc", "attribution", r"\battribution[- ]+non-?commercial\b", 1, 0.9),
    ("cc-by-sa", "attribution", r"\battribution[- ]+share-?alike\b", 1, 0.9),
    ("cc-by-nd", "attribution", r"\battribution[- ]+no-?derivative(?:s|[- ]works)?\b", 1, 0.9),
    ("cc-by-4.0", "attribution", r"\bcreative commons attribution 4\.0\b", 1, 0.95),
    ("cc-by-3.0", "attribution", r"\bcreative commons attribution 3\.0\b", 1, 0.95),
    ("cc-by", "attribution", r"\bcreative commons attribution\b", 2, 0.85),
    ("cc", "creative", r"\bcreative commons\b", 2, 0.6),
    # public domain
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain", 0, 0.98),
    ("unlicense", "unlicense", r"\bthe unlicense\b", 1, 0.9),
    ("public-domain", "holder", r"the copyright holder of this work,? (?:hereby )?releases? (?:it|this work) into the public domain", 1, 0.95),
    ("public-domain", "domain", r"\b(?:in|into|to) the public domain\b", 1, 0.85),
    ("public-domain", "domain", r"\bpublic domain\b", 2, 0.6),
    ("public-domain", "gemeinfrei", r"\bgemeinfrei\b", 2, 0.6),
    ("public-domain", "domaine", r"\bdomaine public\b", 2, 0.6),
    ("public-domain", "dominio", r"\bdominio p[uú]blico\b", 2, 0.6),
    # restrictions
    ("proprietary", "confidential", r"\bproprietary and confidential\b", 1, 0.9),
    ("proprietary", "proprietary", r"\bproprietary licen[sc]e\b", 1, 0.85),
    ("proprietary", "unauthorized", r"unauthorized copying of (?:this|these) (?:files?|software|documents?)", 1, 0.9),
    ("proprietary", "reverse", r"may not (?:copy, )?(?:modify, )?(?:decompile, )?(?:disassemble,? or )?reverse[- ]engineer", 1, 0.8),
    ("proprietary", "agreement", r"\bend[- ]user licen[sc]e agreement\b", 1, 0.85),
    ("non-commercial", "commercial", r"for non-?commercial (?:use|purposes) only", 1, 0.8),
    ("evaluation", "evaluation", r"for evaluation purposes only", 1, 0.8),
    ("reserved", "reserved", r"\bcopyright (?:\(c\) |© )?[^\n]{0,60}all rights reserved\b", 1, 0.9),
    ("reserved", "reserved", r"\ball rights reserved\b", 2, 0.6),
    ("reserved", "vorbehalten", r"\balle rechte vorbehalten\b", 2, 0.6),
    ("reserved", "droits", r"\btous droits r[eé]serv[eé]s\b", 2, 0.6),
    ("reserved", "derechos", r"\btodos los derechos reservados\b", 2, 0.6),
    ("reserved", "reproduced", r"may not be reproduced [^\n]{0,60}without (?:prior )?(?:written )?permission", 1, 0.85),
    ("copyright", "copyright", r"\bcopyright (?:\(c\) |© )?(?:19|20)[0-9][0-9]\b", 2, 0.5),
    ("no-warranty", "warrant", r"without warrant(?:y|ies)(?: or conditions)? of any kind", 2, 0.5),
)


def rules() -> tuple[Rule, ...]:
    """All rules, in the order in which equal detections give way to each other."""
    spaced = lambda p: p.replace("[- ]", r"[-\x20\t\r\n]").replace(" ", r"[\x20\t\r\n]+")
    return tuple(Rule(keyword, spaced(pattern), priority, label, score) for label, keyword, pattern, priority, score in SIGNATURES)
