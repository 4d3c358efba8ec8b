"""License scans by sentence rules: sentences become identifiers, identifier sequences match ordered rules.

A text is cut into sentences (at line ends, and at ``.``, ``;`` or ``:`` before white space), each is normalised (lower case,
other than letters and digits to one space) and looked up among known licence sentences. The identifiers of a text, in order,
are held against the rules in the order of ``RULES``: a rule is a sequence of identifiers that must follow each other,
with no other known sentence between, but where it has a gap (``...``). The first rule that matches at a place takes its sentences. The sentences and titles of published licences and
the notices that name one (``LONG``) are found before the cut, within lines and over them, whatever line ends and comment signs stand between their words. Expressions after
``SPDX-License-Identifier:`` are told as they are.

All of it is DataFrame operations. The two dictionaries are fixed lists of this module, so their size is known; sentences of a
text are filtered against them where they are read, so only hits are ever exploded, grouped or shuffled.

Defined cases: null and empty texts have no sentences and no licence; a sentence given twice counts twice; repeated rows are scanned
each; null ids are carried; other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised licence sentences and their identifiers, in order of identifier.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied": "mit-warranty",
    "licensed under the apache license version 2 0": "apache-2.0-notice",
    "licensed under the apache license version 2 0 the license": "apache-2.0-notice",
    "you may not use this file except in compliance with the license": "apache-2.0-compliance",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache-2.0-warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed": "bsd-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0-notice",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-redistribute",
    "either version 3 of the license or at your option any later version": "3.0-or-later",
    "either version 2 of the license or at your option any later version": "2.0-or-later",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2.0-notice",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0-notice",
    "licensed under cc by 4 0": "cc-by-4.0-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0-notice",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0-notice",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4.0-notice",
    "all rights reserved": "all-rights-reserved",
    "isc license": "isc-title",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this library is free software": "lgpl-free",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-redistribute",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-redistribute",
    "either version 2 1 of the license or at your option any later version": "2.1-or-later",
    "licensed under the gnu lesser general public license version 3": "lgpl-3.0-notice",
    "licensed under the gnu affero general public license version 3": "agpl-3.0-notice",
    "licensed under the gnu general public license version 2": "gpl-2.0-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at": "epl-2.0-notice",
    "licensed under the eclipse public license 2 0": "epl-2.0-notice",
    "creative commons legal code": "cc-title",
    "cc0 1 0 universal": "cc0-1.0-title",
    "licensed under cc0 1 0": "cc0-1.0-notice",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4.0-notice",
    "this work is licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-4.0-notice",
    "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa-4.0-notice",
    "licensed under cc by nd 4 0": "cc-by-nd-4.0-notice",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-4.0-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-title",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-grant",
}
#: Kinds of the GNU licences, the identifier of what each allows, and versions.
KINDS = [("", "gpl-redistribute", ("3", "2", "1")), ("lesser ", "lgpl-redistribute", ("3", "2 1")), ("library ", "lgpl-redistribute", ("2",)), ("affero ", "agpl-redistribute", ("3",))]
CC_KINDS = [("", ""), (" noncommercial", "-nc"), (" sharealike", "-sa"), (" noderivatives", "-nd"), (" noncommercial sharealike", "-nc-sa"), (" noncommercial noderivatives", "-nc-nd")]
#: How titles of full texts and their ends read.
TITLES = {
    "gpl-1.0-title": "gnu general public license version 1 february 1989",
    "gpl-2.0-title": "gnu general public license version 2 june 1991",
    "gpl-3.0-title": "gnu general public license version 3 29 june 2007",
    "lgpl-2.0-title": "gnu library general public license version 2 june 1991",
    "lgpl-2.1-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl-3.0-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl-3.0-title": "gnu affero general public license version 3 19 november 2007",
    "gfdl-1.1-title": "gnu free documentation license version 1 1 march 2000",
    "gfdl-1.2-title": "gnu free documentation license version 1 2 november 2002",
    "gfdl-1.3-title": "gnu free documentation license version 1 3 3 november 2008",
    "apache-2.0-title": "apache license version 2 0 january 2004",
    "artistic-1.0-title": "the artistic license preamble the intent of this document is to state the conditions under which a package may be copied",
    "artistic-2.0-title": "the artistic license 2 0",
    "bsl-1.0-title": "boost software license version 1 0 august 17th 2003",
    "wtfpl-title": "do what the fuck you want to public license",
    "mpl-1.1-title": "mozilla public license version 1 1",
    "mpl-2.0-title": "mozilla public license version 2 0",
    "ofl-1.1-title": "sil open font license version 1 1 26 february 2007",
    "cddl-1.0-title": "common development and distribution license cddl version 1 0",
    "epl-1.0-title": "eclipse public license v 1 0",
    "epl-2.0-title": "eclipse public license v 2 0",
    "ms-pl-title": "microsoft public license ms pl",
    "eupl-1.2-title": "european union public licence v 1 2",
    "python-2.0-title": "python software foundation license version 2",
    "cc0-1.0-title": "creative commons legal code cc0 1 0 universal",
    "terms-end": "end of terms and conditions",
}
#: The names under which notices say that something is licensed.
NOTICES = {
    "mit": ("mit license", "mit licence"),
    "apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license"),
    "isc": ("isc license",),
    "bsd-2-clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license"),
    "bsd-3-clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license"),
    "zlib": ("zlib license",),
    "bsl-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "mpl-2.0": ("mozilla public license~ version~ 2 0", "mozilla public license v 2 0"),
    "mpl-1.1": ("mozilla public license~ version~ 1 1",),
    "epl-2.0": ("eclipse public license~ version~ 2 0", "eclipse public license v 2 0"),
    "epl-1.0": ("eclipse public license~ version~ 1 0", "eclipse public license v 1 0"),
    "agpl-3.0": ("gnu affero general public license~ version~ 3", "gnu agpl~ version~ 3", "gnu affero general public license v3"),
    "lgpl-3.0": ("gnu lesser general public license~ version~ 3", "gnu lgpl~ version~ 3"),
    "lgpl-2.1": ("gnu lesser general public license~ version~ 2 1", "gnu lgpl~ version~ 2 1"),
    "lgpl-2.0": ("gnu library general public license~ version~ 2",),
    "gpl-3.0": ("gnu general public license~ version~ 3", "gnu gpl~ version~ 3", "gnu general public license v3", "gpl version 3", "gplv3"),
    "gpl-2.0": ("gnu general public license~ version~ 2", "gnu gpl~ version~ 2", "gnu general public license v2", "gpl version 2", "gplv2"),
    "gpl-1.0": ("gnu general public license version 1",),
    "gfdl-1.3": ("gnu free documentation license version 1 3",),
    "gfdl-1.2": ("gnu free documentation license version 1 2",),
    "gfdl-1.1": ("gnu free documentation license version 1 1",),
    "artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"),
    "ofl-1.1": ("sil open font license~ version~ 1 1",),
    "cddl-1.0": ("common development and distribution license",),
    "eupl-1.2": ("european union public licence~ v~ 1 2", "eupl"),
    "postgresql": ("postgresql license",),
    "unlicense": ("unlicense",),
    "wtfpl": ("wtfpl",),
    "ms-pl": ("microsoft public license",),
    "python-2.0": ("python software foundation license",),
    "0bsd": ("0bsd license", "zero clause bsd license"),
}
#: Fixed value: what stands before a licence's name in a notice.
VERB = "(?:licensed|licenced|released|available|distributed|published|modify|document)"
#: Names in capitals as SPDX has them, where they are not the identifier with its first letters raised.
NAMED = {
    "mit": "MIT", "apache-2.0": "Apache-2.0", "isc": "ISC", "bsd-2-clause": "BSD-2-Clause", "bsd-3-clause": "BSD-3-Clause", "zlib": "Zlib", "artistic-1.0": "Artistic-1.0-Perl", "artistic-2.0": "Artistic-2.0",
    "postgresql": "PostgreSQL", "unlicense": "Unlicense", "python-2.0": "Python-2.0", "0bsd": "0BSD",
}
#: The licences of the BSD family.
BSD = [
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse", "bsd-warranty")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
]
#: Fixed values: (licence, identifiers in order, ``...`` for any between), tried in this order, longer ones before their beginnings.
RULES = [
    *((f"{k}-{v}", (f"{k.lower()}-{v}-title", "...", "terms-end", free, f"{k.lower()}-redistribute", f"{v}-or-later")) for k, v, free in (("GPL", "3.0", "gpl-free"), ("GPL", "2.0", "gpl-free"), ("GPL", "1.0", "gpl-free"), ("LGPL", "2.1", "lgpl-free"), ("LGPL", "2.0", "lgpl-free"), ("AGPL", "3.0", "gpl-free"))),
    *((f"{k}-{v}", (f"{k.lower()}-{v}-title", "...", "terms-end")) for k, v in (("GPL", "3.0"), ("GPL", "2.0"), ("GPL", "1.0"), ("LGPL", "2.1"), ("LGPL", "2.0"), ("AGPL", "3.0"))),
    ("Apache-2.0", ("apache-2.0-title", "...", "terms-end", "apache-2.0-notice", "...", "apache-2.0-warranty")),
    ("Apache-2.0", ("apache-2.0-title", "...", "terms-end")),
    ("MPL-2.0", ("mpl-2.0-title", "...", "mpl-2.0-notice")),
    ("MPL-1.1", ("mpl-1.1-title", "...", "mpl-1.1-title", "apache-2.0-compliance", "apache-2.0-copy", "all-rights-reserved")),
    ("MPL-1.1", ("mpl-1.1-title", "...", "mpl-1.1-title")),
    *((f"GFDL-{v}", (f"gfdl-{v}-title", "...", f"gfdl-{v}-or-later")) for v in ("1.3", "1.2", "1.1")),
    *((name, ("all-rights-reserved", *ids)) for name, ids in BSD),
    *BSD,
    *((f"{k.upper()}-{v}-or-later", (free, f"{k}-redistribute", f"{v}-or-later")) for k, v in (("gpl", "3.0"), ("gpl", "2.0"), ("gpl", "1.0"), ("lgpl", "3.0"), ("lgpl", "2.1"), ("lgpl", "2.0"), ("agpl", "3.0")) for free in ("gpl-free", "lgpl-free")),
    *((f"{k.upper()}-{v}-only", (free, f"{k}-redistribute", f"{v}-only")) for k, v in (("gpl", "3.0"), ("gpl", "2.0"), ("gpl", "1.0"), ("lgpl", "3.0"), ("lgpl", "2.1"), ("lgpl", "2.0"), ("agpl", "3.0")) for free in ("gpl-free", "lgpl-free")),
    ("Zlib", ("zlib-warranty", "zlib-grant")),
    ("0BSD", ("0bsd-grant", "isc-warranty")),
    ("MIT", ("mit-title", "mit-grant", "mit-condition", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-condition", "mit-warranty")),
    ("Apache-2.0", ("apache-2.0-notice", "apache-2.0-compliance", "apache-2.0-copy", "apache-2.0-warranty")),
    ("ISC", ("isc-title", "isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("Unlicense", ("unlicense-title", "unlicense-grant")),
    ("CC0-1.0", ("cc-title", "cc0-1.0-title")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-title",)),
    ("Apache-2.0", ("apache-2.0-notice",)),
    ("GPL-3.0", ("gpl-3.0-notice",)),
    ("GPL-2.0", ("gpl-2.0-notice",)),
    ("MPL-2.0", ("mpl-2.0-notice",)),
    ("ISC", ("isc-title",)),
    ("LGPL-3.0", ("lgpl-3.0-notice",)),
    ("AGPL-3.0", ("agpl-3.0-notice",)),
    ("EPL-2.0", ("epl-2.0-notice",)),
    ("CC0-1.0", ("cc0-1.0-title",)),
    ("CC0-1.0", ("cc0-1.0-notice",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4.0-notice",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4.0-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.0-notice",)),
    ("CC-BY-4.0", ("cc-by-4.0-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.0-notice",)),
    *((f"{i.upper()}-or-later", (f"{i}-or-later",)) for i in NOTICES if i.startswith(("gpl", "lgpl", "agpl", "gfdl"))),
    *((NAMED.get(i, i.upper()), (f"{i}-notice",)) for i in NOTICES),
    *((NAMED.get(i.removesuffix("-title"), i.removesuffix("-title").upper()), (i,)) for i in TITLES if i.endswith("-title")),
    *((f"CC-BY{short.upper()}-4.0", (f"cc-by{short}-4.0-{kind}",)) for _, short in CC_KINDS for kind in ("notice", "title")),
    ("PostgreSQL", ("postgresql-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("LicenseRef-all-rights-reserved", ("all-rights-reserved",)),
]
RULES = list({ids: (name, ids) for name, ids in reversed(RULES)}.values())[::-1]  # of equal ones the first
#: Long sentences as licences have them, over lines and behind comment signs; (words, sentences of SENTENCES they are).
#: What stands between tildes may be missing; ``...`` is any name.
LONG = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction~ including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so~ subject to the following conditions~", ("mit-grant",)),
    ("the above copyright notice and this permission notice~ including the next paragraph~ shall be included in all copies or substantial portions of the software", ("mit-condition",)),
    ("the software is provided as is without warranty of any kind express or implied~ including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement~", ("mit-warranty",)),
    ("licensed under the apache license version 2 0 the license", ("apache-2.0-notice",)),
    ("you may not use this file except in compliance with the license", ("apache-2.0-compliance",)),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis~ without warranties or conditions of any kind either express or implied~", ("apache-2.0-warranty",)),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("bsd-grant",)),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("bsd-source",)),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("bsd-binary",)),
    ("neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("bsd-endorse",)),
    ("this software is provided by ... as is and any express or implied warranties~ including but not limited to the implied warranties of merchantability and fitness for a particular purpose~ are disclaimed", ("bsd-warranty",)),
    *(
        (f"you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by the free software foundation either version {version}~ of the license~ or at your option any later version", (name, f"{version.replace(' ', '.') if ' ' in version else version + '.0'}-or-later"))
        for kind, name, versions in KINDS for version in versions
    ),
    *(
        (f"you can redistribute it and or modify it under the terms of the gnu {kind}general public license~ as published by the free software foundation~ version {version}~ of the license~", (name, f"{version.replace(' ', '.') if ' ' in version else version + '.0'}-only"))
        for kind, name, versions in KINDS for version in versions
    ),
    ("this program is free software", ("gpl-free",)),
    ("this library is free software", ("lgpl-free",)),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mpl-2.0-notice",)),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("isc-grant",)),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("0bsd-grant",)),
    ("the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ("isc-warranty",)),
    ("all advertising materials mentioning features or use of this software must display the following acknowledgement", ("bsd-advertising",)),
    ("this software is provided as is without any express or implied warranty", ("zlib-warranty",)),
    ("permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("zlib-grant",)),
    ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ("postgresql-grant",)),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license~ v~ 2 0~ which is available at~", ("epl-2.0-notice",)),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license v 1 0", ("epl-1.0-notice",)),
    ("this is free and unencumbered software released into the public domain", ("unlicense-title",)),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("unlicense-grant",)),
    *((f"this work is licensed under a creative commons attribution{kind} 4 0 international license", (f"cc-by{short}-4.0-notice",)) for kind, short in CC_KINDS),
    *((f"creative commons attribution{kind} 4 0 international public license", (f"cc-by{short}-4.0-title",)) for kind, short in CC_KINDS),
    *((words, (i,)) for i, words in TITLES.items()),
    *((f"{VERB} under the~ terms of the~ {name} or~ at your option~ any later version", (f"{i}-or-later",)) for i, names in NOTICES.items() for name in names if i.startswith(("gpl", "lgpl", "agpl", "gfdl"))),
    *((f"{VERB} under the~ terms of the~ {name} or later", (f"{i}-or-later",)) for i, names in NOTICES.items() for name in names if i.startswith(("gpl", "lgpl", "agpl", "gfdl"))),
    *((f"{VERB} under the~ terms of the~ {name}", (f"{i}-notice",)) for i, names in NOTICES.items() for name in names),
]
#: Ends a sentence besides a line feed.
END = r"[.;:]([ \t\n\r\f]|$)"
#: A sentence that any dictionary entry could be holds one of these words; other texts are not cut at all.
HINT = r"(?i)licen|permission|warrant|copyright|redistribut|software|rights reserved|creative commons|cc0|gplv|eupl|wtfpl|terms and conditions"
#: Stands before the number of an identifier where a long sentence was; no text keeps it.
MARK = "lcnsntnc"
#: Fixed value: an expression of licence identifiers.
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+()-]+)*)"


def long_pattern(words: str) -> str:
    """The words with anything but letters and digits between them, so line ends and comment signs too; the groups are what stands before and after."""
    gap = "[^a-z0-9]+"
    parts = []
    for k, part in enumerate(words.split("~")):
        part = gap.join(part.split()).replace("...", ".{1,120}?")
        parts.append(part if k == 0 else f"(?:{gap}{part})?" if k % 2 else gap + part if part else "")
    return rf"(?s)(^|[^a-z0-9]){''.join(parts)}([^a-z0-9]|\z)"


def marks(known: dict[str, str]) -> dict[str, str]:
    """Each identifier's stand-in among sentences."""
    ids = sorted({i for _, found in LONG for i in found} | set(known.values()))
    return {i: f"{MARK}{n}" for n, i in enumerate(ids)}


def unwrapped(low: Column, known: dict[str, str]) -> Column:
    """The lower-cased text with each of ``LONG`` on lines of its own, as marks; other text stays as it is."""
    named = marks(known)
    low = F.replace(low, F.lit(MARK), F.lit(MARK[:-1]))
    for words, ids in LONG:
        low = F.regexp_replace(low, long_pattern(words), "$1\n" + "\n".join(named[i] for i in ids) + "\n$2")
    return low


def sentences(text: Column, known: dict[str, str] = SENTENCES) -> Column:
    """The normalised sentences of a text, in order, without those of no letter or digit."""
    cut = F.transform(F.split(F.regexp_replace(unwrapped(F.lower(text), known), END, "\n"), "\n"), lambda s: F.trim(F.regexp_replace(s, r"[^a-z0-9]+", " ")))
    return F.filter(cut, lambda s: s != "")


def identifiers(text: Column, known: dict[str, str]) -> Column:
    """The identifiers of a text's known sentences, in order: array<struct<at, id>>."""
    table = F.create_map(*[F.lit(x) for pair in (known | {m: i for i, m in marks(known).items()}).items() for x in pair])
    placed = F.transform(sentences(text, known), lambda s, i: F.struct(i.alias("at"), F.try_element_at(table, s).alias("id")))
    return F.filter(placed, lambda x: x["id"].isNotNull())


def rule_pattern(ids: tuple[str, ...]) -> str:
    return "".join("(?:<[^>]*>)*?" if i == "..." else f"<{i.replace('.', '[.]')}>" for i in ids)


def scan(docs: DataFrame, known: dict[str, str] = SENTENCES, rules: list[tuple[str, tuple[str, ...]]] = RULES) -> DataFrame:
    """(doc_id, licenses, rules, first_sentence (-1: none), n_known, spdx) per row of ``docs``; arrays are in order of place.

    Identifiers are joined to one string, each between bars, and the rules are one alternation over it: an ordered choice at
    each place, leftmost first, which is what applying the rules in order means.
    """
    choice = "|".join(f"(?:{rule_pattern(ids)})" for _, ids in rules)
    plain = [(name, ids) for name, ids in rules if "..." not in ids]
    licence = F.create_map(*[F.lit(x) for name, ids in plain for x in ("".join(f"<{i}>" for i in ids), name)])

    def named(r: Column) -> Column:
        out = licence[r]
        for name, ids in reversed([x for x in rules if "..." in x[1]]):
            out = F.when(r.rlike(rf"^(?:{rule_pattern(ids)})$"), F.lit(name)).otherwise(out)
        return out

    found = docs.select(
        "doc_id", F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)).alias("spdx"),
        F.when(F.col("text").rlike(HINT), identifiers(F.col("text"), known)).alias("ids"),
    )
    joined = F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x["id"], F.lit(">"))), "")
    none = F.array().cast("array<string>")
    return found.select(
        "doc_id", F.coalesce(F.regexp_extract_all(joined, F.lit(f"({choice})"), F.lit(1)), none).alias("rules"), F.coalesce(F.size("ids"), F.lit(0)).alias("n"),
        F.coalesce(F.get("ids", F.lit(0))["at"], F.lit(-1)).alias("first_sentence"), F.coalesce("spdx", none).alias("spdx"),
    ).select(
        "doc_id", F.transform("rules", named).alias("licenses"), "rules", F.col("first_sentence").cast("long").alias("first_sentence"),
        F.greatest("n", F.lit(0)).cast("long").alias("n_known"), "spdx",
    )


def _oracle() -> str:
    quoted = lambda x: x.replace("'", "''")
    named = marks(SENTENCES)
    known = ", ".join(f"('{quoted(s)}', '{i}')" for s, i in (SENTENCES | {m: i for i, m in named.items()}).items())
    choice = "|".join(f"(?:{rule_pattern(ids)})" for _, ids in RULES)
    names = ", ".join(f"('{''.join(f'<{i}>' for i in ids)}', '{name}')" for name, ids in RULES if "..." not in ids)
    gaps = " ".join(f"WHEN regexp_full_match(rule, '{rule_pattern(ids)}') THEN '{name}'" for name, ids in RULES if "..." in ids)
    steps, low = [], "low0"
    for n, (words, ids) in enumerate(LONG):  # a common table a step: nested calls go too deep for a parser
        to = f"'\\1' || chr(10) || {' || chr(10) || '.join(repr(named[i]) for i in ids)} || chr(10) || '\\2'"
        steps.append(f"low{n + 1} AS (SELECT row, regexp_replace(t, '{quoted(long_pattern(words))}', {to}, 'g') AS t FROM {low})")
        low = f"low{n + 1}"
    return f"""
WITH rows AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents),
low0 AS MATERIALIZED (SELECT row, replace(lower(text), '{MARK}', '{MARK[:-1]}') AS t FROM rows WHERE regexp_matches(text, '{HINT}')),
{", ".join(steps)},
cut AS (SELECT row, string_split(regexp_replace(t, '[.;:]([ \\t\\n\\r\\f]|$)', chr(10), 'g'), chr(10)) AS parts FROM {low}),
normal AS (SELECT row, list_filter(list_transform(parts, lambda s: trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS parts FROM cut),
placed AS (SELECT row, unnest(parts) AS sentence, generate_subscripts(parts, 1) - 1 AS place FROM normal),
known(sentence, id) AS (VALUES {known}),
hits AS (SELECT row, string_agg('<' || id || '>', '' ORDER BY place) AS ids, min(place) AS first_sentence, count(*) AS n_known FROM placed JOIN known USING (sentence) GROUP BY row),
names(rule, licence) AS (VALUES {names}),
matched AS (SELECT row, unnest(regexp_extract_all(ids, '{choice}')) AS rule, generate_subscripts(regexp_extract_all(ids, '{choice}'), 1) AS n FROM hits),
named AS (SELECT row, string_agg(CASE {gaps} ELSE licence END, ';' ORDER BY n) AS licenses, string_agg(rule, ';' ORDER BY n) AS rules FROM matched LEFT JOIN names USING (rule) GROUP BY row)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(rules, '') AS rules, coalesce(first_sentence, -1)::BIGINT AS first_sentence, coalesce(n_known, 0)::BIGINT AS n_known,
  coalesce(array_to_string(regexp_extract_all(text, '{SPDX}', 1), ';'), '') AS spdx
FROM rows LEFT JOIN hits USING (row) LEFT JOIN named USING (row)
"""


ORACLE = _oracle()
