"""Licence recognition by sentences and rules.

A text is cut into sentences, each is normalised (lower case, letters, digits and dots only; a plus
after a version is "or later") and looked up among known licence sentences, which gives it identifiers:
grants, conditions and disclaimers of the licences' own texts, references by name, SPDX tags, and a mere mention of
a licence where nothing else is known. The sequence of identifiers of a document is then matched against
ordered rules; a rule that matches consumes its identifiers, with what belongs to the licence around them. What no
rule consumes is reported as unmatched, a mention of an unknown licence too. An SPDX tag takes
one licence expression, up to its line's end at most, and gives each identifier in it.

Only documents with a word that every known sentence has part of go to the sentence stage;
that test runs over the whole texts in the JVM.

Defined results: a null or empty text has no licence; a text is scanned whole, however long; a sentence that
occurs again counts again, but each licence is listed once; repeated rows are scanned alike; of two names that
overlap the one that stands first in the table counts; further columns, whatever their names, are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

#: Every known sentence holds one of these at the start of a word, in lower case; what normalise() makes a blank may part their words.
HINT = (
    r"(?<![a-z0-9])(?:(?:un|sub|re)?licen[sc]|permission|redistribut|warrant|copyright|spdx|public[\W_]+domain|liable|cc0|a?l?gpl|rights[\W_]+reserved|cc[\W_]+by|creative[\W_]+commons|provided[\W_]+as[\W_]+is|endorse|later[\W_]+version|misrepresented"
    r"|plainly[\W_]+marked|source[\W_]+(?:distribution|code[\W_]+form)|free[\W_]+(?:software|to[\W_]+copy)|hope[\W_]+that[\W_]+it|advertising[\W_]+materials|mpl|odbl|wtfpl|(?:released|distributed|available|published|provided|covered)[\W_]+(?:\w+[\W_]+)?under"
    r"|fuck[\W_]+you[\W_]+want|gfdl|apache|bsd|\d[\W_]+or[\W_]+(?:any[\W_]+)?(?:later|newer)|\d[\W_]+clause)"
)

#: An SPDX tag with its licence expression. Operators in lower case count only before what looks like an identifier.
_ID = r"\(*(?:DocumentRef-[A-Za-z0-9.-]+:)?[A-Za-z0-9][A-Za-z0-9.+-]*\)*"
SPDX = re.compile(rf"(?i:\bSPDX[\W_]+License[\W_]+Identifier)[\W_]+({_ID}(?:[ \t]+(?:OR|AND|WITH|(?:or|and|with)(?=[ \t]+\(*[\w.+-]*(?:\d|[A-Z][\w.+-]*[A-Z])))[ \t]+{_ID})*)")

# Names that say by themselves that a licence is meant, in normalised sentences; {v} is the version, a group of the pattern.
NAMES: list[tuple[str, str]] = [
    ("CC-BY-NC-SA-{v}", r"\b(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: v| version)? ?(\d(?:\.\d)?)"),
    ("CC-BY-NC-ND-{v}", r"\b(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\w*)(?: v| version)? ?(\d(?:\.\d)?)"),
    ("CC-BY-NC-{v}", r"\b(?:cc by nc|creative commons attribution non ?commercial)(?: v| version)? ?(\d(?:\.\d)?)"),
    ("CC-BY-SA-{v}", r"\b(?:cc by sa|creative commons attribution share ?alike)(?: v| version)? ?(\d(?:\.\d)?)"),
    ("CC-BY-ND-{v}", r"\b(?:cc by nd|creative commons attribution no ?deriv\w*)(?: v| version)? ?(\d(?:\.\d)?)"),
    ("CC-BY-{v}", r"\b(?:cc by|creative commons attribution)(?: v| version)? ?(\d(?:\.\d)?)"),
    ("CC0-1.0", r"\bcc0\b(?: 1\.0)?|\bcreative commons zero\b"),
    ("AGPL-{v}", r"\b(?:gnu )?affero general public license(?: as published by the free software foundation)?(?: either)?(?: v| version)? ?(\d(?:\.\d)?)|\b(?:gnu )?agpl(?: v| version)? ?v?(\d(?:\.\d)?)"),
    ("LGPL-{v}", r"\b(?:gnu )?(?:lesser|library) general public license(?: as published by the free software foundation)?(?: either)?(?: v| version)? ?(\d(?:\.\d)?)|\b(?:gnu )?lgpl(?: v| version)? ?v?(\d(?:\.\d)?)"),
    ("GFDL-{v}", r"\bgnu free documentation license(?: v| version)? ?(\d\.\d)|\bgfdl(?: v| version)? ?v?(\d\.\d)"),
    ("GPL-{v}", r"\b(?:gnu )?general public license(?: as published by the free software foundation)?(?: either)?(?: v| version)? ?(\d(?:\.\d)?)|\b(?:gnu )?gpl(?: v| version)? ?v?(\d(?:\.\d)?)"),
    ("Apache-{v}", r"\bapache(?: software)? license(?: v| version)? ?v?(\d\.\d)|(?:under|license|and|or)(?: the)? (?:terms of the )?apache ?v?(\d\.\d)"),
    ("MPL-{v}", r"\bmozilla public license(?: v| version)? ?(\d\.\d)|\bmpl(?: v| version)? ?v?(\d\.\d)"),
    ("EPL-{v}", r"\beclipse public license(?: v| version)? ?(\d\.\d)"),
    ("EUPL-{v}", r"\beuropean union public licen[sc]e(?: v| version)? ?(\d\.\d)"),
    ("CDDL-{v}", r"\bcommon development and distribution license(?: cddl)?(?: v| version)? ?(\d\.\d)"),
    ("CPL-{v}", r"\bcommon public license(?: v| version)? ?(\d\.\d)"),
    ("OSL-{v}", r"\bopen software license(?: v| version)? ?(\d\.\d)"),
    ("AFL-{v}", r"\bacademic free license(?: v| version)? ?(\d\.\d)"),
    ("Artistic-{v}", r"\bartistic license(?: v| version)? ?(\d\.\d)"),
    ("OFL-{v}", r"\bsil open font license(?: v| version)? ?(\d\.\d)"),
    ("BSL-{v}", r"\bboost software license(?: v| version)? ?(\d\.\d)"),
    ("BUSL-{v}", r"\bbusiness source license(?: v| version)? ?(\d\.\d)"),
    ("SSPL-{v}", r"\bserver side public license(?: v| version)? ?(\d(?:\.\d)?)"),
    ("Elastic-{v}", r"\belastic license(?: v| version)? ?(\d\.\d)"),
    ("ODbL-{v}", r"\bopen (?:data commons open )?database license(?: odbl)?(?: v| version)? ?(\d\.\d)|\bodbl(?: v| version)? ?(\d\.\d)"),
    ("MS-PL", r"\bmicrosoft public license\b|\bms pl\b(?= license)|license(?: type)? ms pl\b"),
    ("MS-RL", r"\bmicrosoft reciprocal license\b|\bms rl\b(?= license)|license(?: type)? ms rl\b"),
    ("Unlicense", r"\bthe unlicense\b|\bunlicense license\b|license unlicense\b"),
    ("WTFPL", r"\bwtfpl\b|\bdo what the fuck you want to public license\b"),
    ("BSD-{v}-Clause", r"\b(\d) clause bsd\b|\bbsd (\d) clause\b"),
    ("BSD-3-Clause", r"\b(?:new|modified|revised) bsd license\b"),
    ("BSD-2-Clause", r"\b(?:simplified|freebsd) (?:bsd )?license\b"),
]

# Names that are words of other meanings too; they count only beside "license" or after "under".
SHORT_NAMES: dict[str, str] = {
    "MIT": r"mit(?: x11)?", "MIT-0": r"mit 0", "X11": r"x11", "ISC": r"isc", "Zlib": r"zlib(?: libpng)?", "BSL-1.0": r"boost(?: software)?|bsl 1\.0", "0BSD": r"0bsd|zero clause bsd",
    "BSD": r"bsd(?: style)?", "Apache-2.0": r"apache ?2|asl 2\.0", "MPL-2.0": r"mpl ?2", "Python-2.0": r"psf|python(?: software foundation)?", "PostgreSQL": r"postgresql", "OpenSSL": r"openssl", "PHP-3.01": r"php",
    "Ruby": r"ruby", "NCSA": r"ncsa|university of illinois ncsa open source", "W3C": r"w3c", "curl": r"curl", "HPND": r"hpnd", "Vim": r"vim", "Libpng": r"libpng", "ICU": r"icu", "Beerware": r"beer ?ware",
    "CC0-1.0": r"cc0", "AGPL": r"(?:gnu )?agpl|(?:gnu )?affero general public", "LGPL": r"(?:gnu )?lgpl|(?:gnu )?(?:lesser|library) general public", "GPL": r"(?:gnu )?gpl|(?:gnu )?general public", "Apache": r"apache(?: software)?", "Artistic": r"artistic", "MPL": r"mozilla public",
}
_UNDER = r"(?:licen[sc]ed|released|distributed|available|published|provided|covered)(?: \w+)? under(?: the)?(?: terms of)?(?: the| a)?"

# Sentences of the licences' own texts and notices, normalised.
SENTENCES: list[tuple[str, str]] = [
    ("mit-grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("boost-grant", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("mit-notice", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("boost-notice", r"the copyright notices in the software and this entire statement"),
    ("isc-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd-grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib-grant", r"permission is granted to anyone to use this software for any purpose"),
    ("zlib-origin", r"the origin of this software must not be misrepresented"),
    ("zlib-altered", r"altered source versions must be plainly marked as such"),
    ("zlib-notice", r"this notice may not be removed or altered from any source distribution"),
    ("ms-pl-grant", r"this license governs use of the accompanying software"),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-adverts", r"all advertising materials mentioning features or use of this software"),
    ("bsd-endorse", r"may be used to endorse or promote products derived from this software"),
    ("apache-may-not", r"you may not use this file except in compliance with the license"),
    ("apache-copy", r"you may obtain a copy of the license at"),
    ("apache-as-is", r"distributed under the license is distributed on an as is basis"),
    ("apache-see", r"see the license for the specific language governing permissions and limitations"),
    ("gnu-free", r"this (?:program|library|file|software) is free software you can redistribute it and or modify it"),
    ("gnu-hope", r"is distributed in the hope that it will be useful"),
    ("gnu-received", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public license"),
    ("mpl-subject", r"this source code form is subject to the terms of"),
    ("mpl-copy", r"if a copy of the mpl was not distributed with this file"),
    ("unlicense-grant", r"this is free and unencumbered software released into the public domain"),
    ("unlicense-free", r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl-grant", r"you just do what the fuck you want to"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("or-later", r"(?:at your option )?any later version|(?<=\d) or (?:any )?(?:later|newer)\b"),
    ("as-is", r"software is provided as is(?: without)?|provided by the copyright holders and contributors as is|without warranty of any kind|without any express or implied warranty"),
    ("liability", r"in no event (?:shall|will) .{0,80}be (?:held )?liable"),
    ("copyright", r"^(?:c )?copyright (?:c )?(?:\d{4}|the\b)"),
    ("rights-reserved", r"all rights reserved"),
    ("licence-mention", r"\blicen[sc]e[ds]?\b"),
]

#: What belongs to a licence whose sentences it follows.
_TAIL = r"(?: (?:as-is|liability|copyright|rights-reserved))*"

# Ordered rules over the sequence of identifiers, written as " id id ". The first
# that matches consumes what it matched. {1} is the first group.
RULES: list[tuple[str, str]] = [
    ("{1}", r" spdx:(\S+)"),
    ("{1}-or-later", r"(?: gnu-free)? ref:((?:A|L)?GPL-[\d.]+|GFDL-[\d.]+) or-later(?: (?:gnu-hope|gnu-received|as-is|licence-mention))*"),
    ("{1}-only", r"(?: gnu-free)? ref:((?:A|L)?GPL-[\d.]+|GFDL-[\d.]+)(?: (?:gnu-hope|gnu-received|as-is))*"),
    ("{1}", r" ref:(Apache-[\d.]+)(?:(?: licence-mention)? (?:apache-may-not|apache-copy|apache-as-is|apache-see))*"),
    ("Apache-2.0", r" (?:apache-may-not|apache-copy)(?:(?: licence-mention)? (?:apache-copy|apache-as-is|apache-see))+"),
    ("{1}", r"(?: mpl-subject)? ref:(MPL-[\d.]+)(?: mpl-copy)?"),
    ("MIT", rf"(?: ref:MIT)?(?: copyright| rights-reserved)* mit-grant(?: mit-notice)?{_TAIL}"),
    ("BSL-1.0", rf"(?: ref:BSL-1\.0)?(?: copyright)* boost-grant(?: boost-notice)?{_TAIL}"),
    ("ISC", rf"(?: ref:ISC)?(?: copyright)* isc-grant{_TAIL}"),
    ("0BSD", rf"(?: ref:0BSD)?(?: copyright)* 0bsd-grant{_TAIL}"),
    ("Zlib", rf"(?: ref:Zlib)?(?: copyright| as-is| liability)* zlib-grant(?: zlib-origin)?(?: zlib-altered)?(?: zlib-notice)?"),
    ("MS-PL", r"(?: ref:MS-PL)? ms-pl-grant"),
    ("BSD-4-Clause", rf"(?: ref:BSD(?:-4-Clause)?)? bsd-grant bsd-source bsd-binary bsd-adverts(?: bsd-endorse)?{_TAIL}"),
    ("BSD-3-Clause", rf"(?: ref:BSD(?:-3-Clause)?)? bsd-grant bsd-source bsd-binary bsd-endorse{_TAIL}"),
    ("BSD-2-Clause", rf"(?: ref:BSD(?:-2-Clause)?)? bsd-grant bsd-source bsd-binary{_TAIL}"),
    ("LicenseRef-BSD", rf" bsd-grant{_TAIL}| ref:BSD"),
    ("Unlicense", rf"(?: ref:Unlicense)? unlicense-grant(?: unlicense-free)?{_TAIL}"),
    ("WTFPL", r"(?: ref:WTFPL)? wtfpl-grant"),
    ("LicenseRef-{1}", r"(?: gnu-free)? ref:(A?L?GPL|Apache|Artistic|MPL)(?: or-later)?(?: (?:gnu-hope|gnu-received))*"),
    ("{1}", rf" ref:(\S+){_TAIL}"),
    ("LicenseRef-Public-Domain", r" public-domain"),
]
#: Identifiers that say nothing of a licence by themselves.
SILENT = frozenset(("copyright", "rights-reserved", "as-is", "liability", "or-later", "gnu-hope"))

SCHEMA = "id {kind}, licenses array<string>, sentence_ids array<string>, unmatched array<string>, n_sentences int"


def patterns() -> list[tuple[str, str]]:
    """(identifier, pattern) of all known sentences, in the order in which they are looked for."""
    short = [(f"ref:{i}", rf"(?:\b{_UNDER}|\blicen[sc]e(?: is| type| name)?(?: the)?) (?:{p})\b(?! [\d.]+\b)(?: licen[sc]e)?|\b(?:{p}) licen[sc]e\b(?! (?:v|version)? ?\d)") for i, p in SHORT_NAMES.items()]
    return [*SENTENCES[:-1], *((f"ref:{i}", p) for i, p in NAMES), *short, SENTENCES[-1]]


@functools.lru_cache(maxsize=1)
def _known() -> list[tuple[str, re.Pattern]]:
    return [(i, re.compile(p)) for i, p in patterns()]


@functools.lru_cache(maxsize=1)
def _rules() -> list[tuple[str, re.Pattern]]:
    return [(i, re.compile(f"(?:{p})(?= )")) for i, p in RULES]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(from, to) of sentences: they end at . ! ? : before white space, and at an empty line."""
    start = 0
    for m in re.finditer(r"(?<!\bv)[.!?:](?=\s|\Z)|\n(?=[ \t\r\f\v*#/]*\n)|\Z", text):
        if m.end() > start:
            yield start, m.end()
        start = m.end()


def normalise(sentence: str) -> str:
    """Lower case; letters, digits and inner dots stay, a plus after a digit is "or later", anything else is one blank."""
    s = re.sub(r"[^\w.]+|_", " ", re.sub(r"(?<=\d)\+", " or later ", sentence.lower()))
    return re.sub(r"\.(?!\d)|(?<!\d)\.", " ", s).strip()


def identify_sentence(sentence: str) -> list[str]:
    """Identifiers of a sentence, in the order in which they occur in it; a mention counts only without any other."""
    out, at = [], 0
    for tag in SPDX.finditer(sentence):
        out += _identify(sentence[at : tag.start()])
        names = (x.strip("()").rstrip(".-") for x in tag[1].split() if x.upper() not in ("OR", "AND", "WITH"))
        out += [f"spdx:{x}" for x in names if x]
        at = tag.end()
    out += _identify(sentence[at:])
    return [i for i in out if i != "licence-mention"] or out


def _identify(sentence: str) -> list[str]:
    """Identifiers of a sentence, or of a part of one, without SPDX tags."""
    return list(_lookup(re.sub(r"\s+", " ", normalise(sentence))))


@functools.lru_cache(maxsize=4096)
def _lookup(s: str) -> tuple[str, ...]:
    """Identifiers of a normalised sentence; those met last are remembered."""
    found: list[tuple[int, str]] = []
    covered = bytearray(len(s))  # characters of what has been found
    for ident, pattern in _known():
        for m in pattern.finditer(s):
            a, b = m.span()
            if covered.find(1, a, b) >= 0 or (ident == "licence-mention" and found):
                continue
            version = next((g for g in m.groups() if g), "") if m.groups() else ""
            if version and "." not in version and "BSD" not in ident:
                version += ".0"
            found.append((a, ident.replace("{v}", version)))
            covered[a:b] = b"\1" * (b - a)
    return tuple(i for _, i in sorted(found))


def match_rules(ids: list[str]) -> tuple[list[str], list[str]]:
    """(licences in order of first match, identifiers that no rule consumed)."""
    sequence, found = "".join(f" {i}" for i in ids) + " ", []
    for name, rule in _rules():
        parts, at, place = [], 0, 0
        for m in rule.finditer(sequence):
            place += sequence.count(" ", at, m.start())
            group = next((g for g in m.groups() if g), "") if m.groups() else ""
            found.append((place, name.replace("{1}", group)))
            n = m[0].count(" ")
            parts += [sequence[at : m.start()], " -" * n]
            at, place = m.end(), place + n
        sequence = "".join(parts) + sequence[at:]
    order = list(dict.fromkeys(n for _, n in sorted(found)))
    return order, [i for i in sequence.split() if i != "-" and i not in SILENT]


def scan_text(text: str | None) -> tuple[list[str], list[str], list[str], int]:
    """(licences, identifiers, unmatched identifiers, number of known sentences) of one text."""
    text, ids, n = text or "", [], 0
    hint = re.compile(HINT)
    # the colon of "SPDX-License-Identifier: MIT" or "License: MIT" ends no sentence
    joined = re.sub(r"(?i)(identifier|licen[sc]e(?:d under)?)[ \t]*:[ \t]*", r"\1 ", text)
    for a, b in sentences(joined):
        part = joined[a:b]
        if hint.search(part.lower()):
            got = identify_sentence(part)
            ids += got
            n += bool(got)
    licenses, unmatched = match_rules(ids)
    return licenses, ids, unmatched, n


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licenses, sentence_ids, unmatched, n_sentences) for every row of docs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows = [scan_text(x.as_py()) for x in b.column(1)]
                lists = [pa.array([r[i] for r in rows], pa.list_(pa.string())) for i in range(3)]
                yield pa.record_batch([b.column(0), *lists, pa.array([r[3] for r in rows], pa.int32())], names=["id", "licenses", "sentence_ids", "unmatched", "n_sentences"])

    kind = dict(docs.dtypes)[id_col]
    # a document without a hint goes on without its text, so that only the others' texts reach Python
    hinted = F.when(F.lower(text_col).rlike(HINT), F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), hinted.alias("text")).transform(in_batches, work, SCHEMA.format(kind=kind)).withColumnRenamed("id", id_col)
