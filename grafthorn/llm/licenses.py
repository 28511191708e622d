"""Licence scan by sentence rules.

A text is cut into sentences at line ends and after . ! ? before white space; wrapped lines are also read as
one sentence up to the next blank line. Sentences are normalised (lower case, words and digits only) and mapped to
the identifiers of known licence sentences; other sentences have none. The sequence of a text's identifiers is
then matched against the licence rules in their order: a rule takes the earliest run of identifiers, in its order and with nothing
between but identifiers that are its own options, removes them, and tries again; what no rule takes is reported as unmatched.

Null and empty texts have no sentences. The whole text is read; repeated rows give repeated
results. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_CUT = re.compile(r"(?<=[.!?])\s+|\n+")
_WRAP = re.compile(r"(?<![.!?:;\n])\n(?!\n)")
_OTHER = re.compile(r"[\W_]+")

#: How a grant sentence begins, up to the licence's name.
_GRANT = re.compile(
    r"(?:(?:this|the) (?:work|software|file|program|project|code|document|page|text|material|library|content|package|module|article|dataset|data)(?: is| are)? )?(?:is |are )?(?:(?:and|all) )?"
    r"(?:dual |jointly )?(?:licen[cs]ed|released|distributed|published|available|provided|made available|redistributable|offered|shared)(?: to you)? under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?"
)
_LICENCE = r"(?: licen[cs]e)?"
_VERSION = r"(?: version| ?v)? ?"
_LATER = r"(?: only)?"
#: Identifier of a grant sentence -> expression over the whole name that follows its beginning.
GRANTS = {
    "apache-2.grant": rf"apache(?: software)? licen[cs]e{_VERSION}2(?: 0)?(?: the licen[cs]e)?|apache{_VERSION}2(?: 0)?{_LICENCE}",
    "mit.grant": rf"(?:expat |x11 )?mit(?: style)?{_LICENCE}",
    "isc.grant": rf"isc{_LICENCE}",
    "bsd-3.grant": rf"(?:3 clause|three clause|new|modified|revised) bsd{_LICENCE}|bsd 3 clause{_LICENCE}",
    "bsd-2.grant": rf"(?:2 clause|two clause|simplified|freebsd) bsd{_LICENCE}|bsd 2 clause{_LICENCE}",
    "gpl-3.grant": rf"(?:gnu )?(?:general public licen[cs]e|gpl){_VERSION}3(?: 0)?{_LATER}",
    "gpl-2.grant": rf"(?:gnu )?(?:general public licen[cs]e|gpl){_VERSION}2(?: 0)?{_LATER}",
    "lgpl-3.grant": rf"(?:gnu )?(?:lesser general public licen[cs]e|lgpl){_VERSION}3(?: 0)?{_LATER}",
    "lgpl-2.1.grant": rf"(?:gnu )?(?:lesser general public licen[cs]e|lgpl){_VERSION}2 1{_LATER}",
    "agpl-3.grant": rf"(?:gnu )?(?:affero general public licen[cs]e|agpl){_VERSION}3(?: 0)?{_LATER}",
    "mpl-2.grant-by-name": rf"(?:mozilla public licen[cs]e|mpl){_VERSION}2(?: 0)?",
    "epl-1.grant": rf"(?:eclipse public licen[cs]e|epl){_VERSION}1(?: 0)?",
    "epl-2.grant": rf"(?:eclipse public licen[cs]e|epl){_VERSION}2(?: 0)?",
    "artistic-1.grant": rf"artistic licen[cs]e{_VERSION}1(?: 0)?",
    "artistic-2.grant": rf"artistic licen[cs]e{_VERSION}2(?: 0)?",
    "boost-1.grant": rf"boost software licen[cs]e{_VERSION}1(?: 0)?",
    "zlib.grant": rf"zlib{_LICENCE}",
    "unlicense.grant": r"unlicen[cs]e",
    "cc-by-4.grant": rf"(?:a )?(?:cc by|creative commons attribution){_LICENCE} 4 0(?: international)?{_LICENCE}",
    "cc-by-sa-4.grant": rf"(?:a )?(?:cc by sa|creative commons attribution share ?alike){_LICENCE} 4 0(?: international)?{_LICENCE}",
    "cc-by-nc-4.grant": rf"(?:a )?(?:cc by nc|creative commons attribution non ?commercial){_LICENCE} 4 0(?: international)?{_LICENCE}",
    "cc-by-nd-4.grant": rf"(?:a )?(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s) 4 0(?: international)?{_LICENCE}",
    "cc-by-nc-sa-4.grant": rf"(?:a )?(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0(?: international)?{_LICENCE}",
    "cc-by-nc-nd-4.grant": rf"(?:a )?(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s) 4 0(?: international)?{_LICENCE}",
    "cc-by-3.grant": rf"(?:a )?(?:cc by|creative commons attribution){_LICENCE} 3 0(?: unported)?{_LICENCE}",
    "cc-by-sa-3.grant": rf"(?:a )?(?:cc by sa|creative commons attribution share ?alike){_LICENCE} 3 0(?: unported)?{_LICENCE}",
    "cc0.grant": rf"(?:a )?(?:creative commons )?(?:cc0|cc zero)(?: 1 0)?(?: universal)?{_LICENCE}",
    "other.licence": r"(?:.* )?licen[cs]e(?: .*)?",
}
_GNU_FREE = r"(?:program|library|software|file) is free software you can redistribute it and or modify it under the terms of the gnu"
_GNU_AS = r"as published by the free software foundation"
_OR_LATER = r"(?:of the licen[cs]e )?or at your option any later version"
#: Identifier of any other licence sentence -> expressions over the normalised sentence. The first two words of each are literal.
SENTENCES = {
    "apache-2.compliance": (r"you may not use this file except in compliance with the licen[cs]e$",),
    "apache-2.copy": (r"you may obtain a copy of the licen[cs]e at\b",),
    "apache-2.asis": (r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e is distributed on an as is basis",),
    "apache-2.see": (r"see the licen[cs]e for the specific language governing permissions and limitations under the licen[cs]e$",),
    "apache-2.title": (r"apache licen[cs]e version 2 0(?: january 2004)?$",),
    "mit.title": (r"the mit licen[cs]e(?: mit)?$", r"mit licen[cs]e(?: mit)?$"),
    "mit.permission": (r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",),
    "mit.notice": (r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software$",),
    "mit.asis": (r"the software is provided as is(?: and the author disclaims all warranties|,? without warranty of any kind express or implied)",),
    "mit.liability": (r"in no event shall the authors? (?:or copyright holders )?be liable for any",),
    "isc.permission": (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "boost-1.title": (r"boost software licen[cs]e version 1 0",),
    "boost-1.permission": (r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e",),
    "zlib.asis": (r"this software is provided as is without any express or implied warranty$",),
    "zlib.liability": (r"in no event will the authors? be held liable for any damages arising from the use of this software$",),
    "zlib.permission": (r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",),
    "bsd.redistribution": (r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met$",),
    "bsd.source": (r"redistributions of source code must retain the above copyright notice", *(rf"{n} redistributions of source code must retain the above copyright notice" for n in (1, 2, 3))),
    "bsd.binary": (r"redistributions in binary form must reproduce the above copyright notice", *(rf"{n} redistributions in binary form must reproduce the above copyright notice" for n in (1, 2, 3))),
    "bsd.endorse": (r"neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission$", *(rf"{n} neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission$" for n in (3, 4))),
    "bsd.asis": (r"this software is provided by the (?:copyright holders?|authors?|regents)(?: and contributors)? as is",),
    "bsd.liability": (r"in no event shall the (?:copyright (?:holder|owner)s?|authors?|regents) or contributors be liable",),
    "gpl-3.free": (rf"this {_GNU_FREE} general public licen[cs]e {_GNU_AS} either version 3 {_OR_LATER}$",),
    "gpl-2.free": (rf"this {_GNU_FREE} general public licen[cs]e {_GNU_AS} either version 2 {_OR_LATER}$",),
    "gpl-3.free-only": (rf"this {_GNU_FREE} general public licen[cs]e {_GNU_AS} version 3(?: of the licen[cs]e)?$",),
    "gpl-2.free-only": (rf"this {_GNU_FREE} general public licen[cs]e {_GNU_AS} version 2(?: of the licen[cs]e)?$",),
    "lgpl-3.free": (rf"this {_GNU_FREE} lesser general public licen[cs]e {_GNU_AS} either version 3 {_OR_LATER}$",),
    "lgpl-2.1.free": (rf"this {_GNU_FREE} lesser general public licen[cs]e {_GNU_AS} either version 2 1 {_OR_LATER}$",),
    "agpl-3.free": (rf"this {_GNU_FREE} affero general public licen[cs]e {_GNU_AS} either version 3 {_OR_LATER}$",),
    "gpl.hope": (r"this (?:program|library|software|file) is distributed in the hope that it will be useful but without any warranty",),
    "gpl.see": (r"see the gnu (?:lesser |affero )?general public licen[cs]e for more details$",),
    "gpl.received": (r"you should have received a copy of the gnu (?:lesser |affero )?general public licen[cs]e along with this (?:program|library|software)",),
    "mpl-2.grant": (r"this source code form is subject to the terms of the mozilla public licen[cs]e v ?2 0$",),
    "mpl-2.copy": (r"if a copy of the mpl was not distributed with this file you can obtain one at\b",),
    "epl-1.materials": (r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e v ?1 0\b",),
    "epl-2.materials": (r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e(?: v)? ?2 0\b",),
    "unlicense.free": (r"this is free and unencumbered software released into the public domain$",),
    "unlicense.anyone": (r"anyone is free to copy modify publish use compile sell or distribute this software",),
    "cc0.waiver": (r"to the extent possible under law .* waived all copyright and related or neighboring rights to",),
    "public-domain": tuple(rf"{which} (?:work|software|file|text|code) is in the public domain$" for which in ("this", "the")),
    "copyright.line": (r"copyright c (?:\d{4}|by)\b", r"copyright by\b"),
    "rights.reserved": (r"all rights reserved$",),
}
#: Names in an SPDX identifier line, as normalised, that stand for a licence.
SPDX = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "Apache-2.0", "MIT", "ISC", "BSD-3-Clause", "BSD-2-Clause", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-2.0-only", "GPL-2.0-or-later", "LGPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Artistic-2.0", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0")
#: Licence, identifiers in order; a trailing ? marks one that may be missing. Earlier rules win.
RULES = (
    ("BSD-3-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.asis?", "bsd.liability?")),
    ("BSD-2-Clause", ("bsd.redistribution", "bsd.source", "bsd.binary", "bsd.asis?", "bsd.liability?")),
    ("BSD-3-Clause", ("bsd-3.grant",)),
    ("BSD-2-Clause", ("bsd-2.grant",)),
    ("Apache-2.0", ("apache-2.title?", "apache-2.grant", "apache-2.compliance?", "apache-2.copy?", "apache-2.asis?", "apache-2.see?")),
    ("Apache-2.0", ("apache-2.title",)),
    ("MIT", ("mit.title?", "mit.permission", "mit.notice?", "mit.asis?", "mit.liability?")),
    ("BSL-1.0", ("boost-1.title?", "boost-1.permission", "mit.asis?")),
    ("BSL-1.0", ("boost-1.title",)),
    ("BSL-1.0", ("boost-1.grant",)),
    ("Zlib", ("zlib.asis?", "zlib.liability?", "zlib.permission")),
    ("Zlib", ("zlib.grant",)),
    ("MIT", ("mit.grant",)),
    ("MIT", ("mit.title",)),
    ("ISC", ("isc.permission", "mit.asis?", "mit.liability?")),
    ("ISC", ("isc.grant",)),
    ("AGPL-3.0-or-later", ("agpl-3.free", "gpl.hope?", "gpl.see?", "gpl.received?")),
    ("AGPL-3.0", ("agpl-3.grant",)),
    ("LGPL-3.0-or-later", ("lgpl-3.free", "gpl.hope?", "gpl.see?", "gpl.received?")),
    ("LGPL-2.1-or-later", ("lgpl-2.1.free", "gpl.hope?", "gpl.see?", "gpl.received?")),
    ("LGPL-3.0", ("lgpl-3.grant",)),
    ("LGPL-2.1", ("lgpl-2.1.grant",)),
    ("GPL-3.0-or-later", ("gpl-3.free", "gpl.hope?", "gpl.see?", "gpl.received?")),
    ("GPL-2.0-or-later", ("gpl-2.free", "gpl.hope?", "gpl.see?", "gpl.received?")),
    ("GPL-3.0", ("gpl-3.free-only", "gpl.hope?", "gpl.see?", "gpl.received?")),
    ("GPL-2.0", ("gpl-2.free-only", "gpl.hope?", "gpl.see?", "gpl.received?")),
    ("GPL-3.0", ("gpl-3.grant",)),
    ("GPL-2.0", ("gpl-2.grant",)),
    ("MPL-2.0", ("mpl-2.grant", "mpl-2.copy?")),
    ("MPL-2.0", ("mpl-2.grant-by-name", "mpl-2.copy?")),
    ("EPL-1.0", ("epl-1.materials",)),
    ("EPL-2.0", ("epl-2.materials",)),
    ("EPL-1.0", ("epl-1.grant",)),
    ("EPL-2.0", ("epl-2.grant",)),
    ("Artistic-1.0", ("artistic-1.grant",)),
    ("Artistic-2.0", ("artistic-2.grant",)),
    ("CC-BY-4.0", ("cc-by-4.grant",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4.grant",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4.grant",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-4.grant",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-4.grant",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-4.grant",)),
    ("CC-BY-3.0", ("cc-by-3.grant",)),
    ("CC-BY-SA-3.0", ("cc-by-sa-3.grant",)),
    ("CC0-1.0", ("cc0.grant",)),
    ("CC0-1.0", ("cc0.waiver",)),
    ("Unlicense", ("unlicense.free", "unlicense.anyone?")),
    ("Unlicense", ("unlicense.grant",)),
    ("Public domain", ("public-domain",)),
    *((name, (f"spdx.{name}",)) for name in SPDX),
)
_OF_GRANT = [(name, re.compile(rf"(?:{expression})(?= |$)")) for name, expression in GRANTS.items() if name != "other.licence"]
_OTHER_NAME = re.compile(GRANTS["other.licence"])
#: What may follow a licence's name in a grant, how a second one is joined, grants of any subject, and three more ways to name one.
_TAIL = re.compile(r" (?:which|that|see|as|or (?:later|newer|any later|at your option|greater)|and (?:later|above)|unless|except|with|a copy|copy|you may|the licen[cs]e|for (?:details|more|full)|found|in the|included|available|at|http|https|www|by|licen[cs]es?|terms|additional|dual|c|copyright|all rights|version)\b")
_OR_ANOTHER = re.compile(r" (?:licen[cs]e )?(?:or|and)(?: at your option)?(?: under)?(?: the)? ")
_UNDER = re.compile(r"\b(?:under|governed by) (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:either (?:of )?(?:the )?)?(?:an? )?")
_GRANTS_BY = re.compile(r"\b(?:licen[cs]|releas|distribut|redistribut|publish|avail|provid|offer|shar|dedicat|cover|govern)")
_TITLE_END = re.compile(r"(?: \d{1,2} [a-z]+ \d{4})?$")
_TITLE_CHARS = 90
_LICENCE_LINE = re.compile(r"licen[cs]ed? (?:is )?(?:the )?(.+)$")
_LICENSED_AS = re.compile(r"(?:(?:this|the) (?:work|software|file|program|project|code|document|page|text|material|library|content|package|module|article|dataset|data) is )?(.+?) licen[cs]ed$")
_COPYRIGHT_YEAR = re.compile(r"copyright \d{4}\b")
_SPDX_LINE = re.compile(r"spdx licen[cs]e identifier (.+)")


def _by_first_words() -> dict[tuple[str, str], list[tuple[str, re.Pattern]]]:
    found: dict[tuple[str, str], list[tuple[str, re.Pattern]]] = {}
    for name, expressions in SENTENCES.items():
        for x in expressions:
            first, second = x.replace(r"\b", "").split(" ", 2)[:2]
            bare = second[3:].partition(")")[0] if second.startswith("(?:") else second.rstrip("$").partition("(")[0]
            # A group stands for each of its words, a word with a spelling class for both its spellings.
            for word in sorted({w.replace("[cs]", c) for w in bare.split("|") for c in "cs"}):
                found.setdefault((first, word), []).append((name, re.compile(x)))
    return found


_FIRST_WORDS = _by_first_words()


def normalised(sentence: str) -> str:
    """Lower case, runs of anything but letters and digits as one blank."""
    return _OTHER.sub(" ", sentence).strip().lower()


def sentence_id(sentence: str) -> str | None:
    """The known identifier of a sentence: by the two words it begins with, as an identifier line, or as a grant.

    No sentence is left out before that; what two words begin and what a grant names decides which expressions can match at all.
    """
    plain = normalised(sentence)
    first, _, more = plain.partition(" ")
    for name, expression in _FIRST_WORDS.get((first, more.partition(" ")[0]), ()):
        if expression.match(plain):
            # A grant of a licence that is known by name says more.
            return next(iter(granted(plain)), name) if name == "other.licence" else name
    if first == "copyright" and _COPYRIGHT_YEAR.match(plain):
        return "copyright.line"
    if first == "spdx" and (m := _SPDX_LINE.fullmatch(plain)):
        return _spdx(m[1])[0]
    return next(iter(granted(plain)), None)


def _named(text: str) -> tuple[str, int] | None:
    """The longest licence name that a text begins with, and its length."""
    found = [(m.end(), name) for name, expression in _OF_GRANT if (m := expression.match(text))]
    return max(((name, end) for end, name in found), key=lambda x: x[1]) if found else None


def _names(rest: str) -> list[str]:
    """Identifiers of the licences that a text begins with, "A or B"; none if what follows the last belongs to no grant."""
    found = []
    while n := _named(rest):
        more = rest[n[1] :]
        other = _OR_ANOTHER.match(more)
        if other and _named(more[other.end() :]):
            found.append(n[0])
            rest = more[other.end() :]
            continue
        return [*found, n[0]] if not more or _TAIL.match(more) else found
    return found


def granted(plain: str) -> list[str]:
    """Identifiers of all licences that a sentence grants.

    "licensed under A or B" of what it begins with, or of any subject where A is known by name, with what may follow a name;
    "governed by A", "is A licensed", "licence: A", and a sentence that is a licence's name and no more.
    """
    m = _GRANT.match(plain)
    if m and (found := _names(plain[m.end() :])):
        return found
    for under in _UNDER.finditer(plain) if "under " in plain or "governed by " in plain else ():
        if _GRANTS_BY.search(plain, 0, under.end()) and (found := _names(plain[under.end() :])):
            return found
    if m:
        return ["other.licence"] if _OTHER_NAME.fullmatch(plain[m.end() :]) else []
    # All that follows needs these letters.
    if "licen" not in plain:
        return []
    line = _LICENCE_LINE.match(plain) or _LICENSED_AS.match(plain)
    if line and (n := _named(line[1])) and n[1] == len(line[1]):
        return [n[0]]
    if len(plain) <= _TITLE_CHARS:
        title = plain.removeprefix("the ")
        n = _named(title)
        if n and "licen" in title[: n[1]] and _TITLE_END.fullmatch(title, n[1]):
            return [n[0]]
    return []


def _spdx(names: str) -> list[str]:
    """Identifiers of an SPDX line: one for each name that "or", "and" or "with" joins; an exception after "with" is unknown."""
    known = {normalised(x): x for x in SPDX}
    return [f"spdx.{known[n]}" if n in known else "other.licence" for n in re.split(r" (?:or(?! later)|and|with) ", names)]


def _all_of(sentence: str) -> list[str]:
    """The identifiers of a sentence: one, or one for each licence of a grant or an SPDX line."""
    first = sentence_id(sentence)
    if first is None:
        return []
    plain = normalised(sentence)
    if m := _SPDX_LINE.fullmatch(plain):
        return _spdx(m[1])
    return [first, *(granted(plain)[1:] if first in GRANTS else ())]


def sentence_ids(text: str | None) -> list[str]:
    """Identifiers of a text's licence sentences, in text order."""
    if not text:
        return []
    found = []
    for paragraph in re.split(r"\n\s*\n", text):
        lines = [i for s in _CUT.split(paragraph) for i in _all_of(s)]
        joined = [i for s in _CUT.split(_WRAP.sub(" ", paragraph)) for i in _all_of(s)] if "\n" in paragraph else []
        found += joined if len(joined) > len(lines) else lines
    return found


def match_rules(ids: list[str]) -> tuple[list[str], list[str]]:
    """(licences in text order, identifiers that no rule took)."""
    left: list[str | None] = list(ids)
    taken: list[tuple[int, str]] = []
    for licence, wanted in RULES:
        at = 0
        while at < len(left):
            here, used = at, []
            for w in wanted:
                if here < len(left) and left[here] == w.rstrip("?"):
                    used.append(here)
                    here += 1
                elif not w.endswith("?"):
                    used = []
                    break
            for u in used:
                left[u] = None
            if used:
                taken.append((used[0], licence))
            at = max(here if used else at + 1, at + 1)
    return [licence for _, licence in sorted(taken)], [i for i in left if i]


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, licenses, sentence_ids and unmatched identifiers of each document; one narrow pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        for batch in batches:
            ids = [sentence_ids(t) for t in batch.column(1).to_pylist()]
            found = [match_rules(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], strings), pa.array(ids, strings), pa.array([f[1] for f in found], strings)], names=["doc_id", "licenses", "sentence_ids", "unmatched"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, licenses array<string>, sentence_ids array<string>, unmatched array<string>")
