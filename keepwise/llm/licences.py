"""Licence scans by sentence rules (operator 10).

A text is cut into sentences; each is normalised and looked up among known
licence sentences (some with slots for the holder or the project), which gives the text's sequence of sentence identifiers.
Ordered rules, the longer before the shorter, are matched against runs of that
sequence; a run that no rule begins leaves its identifier unexplained.
"""
from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from keepwise.llm.common import map_documents

# The sentences of well-known public licence texts and notices,
# normalised (lower case, runs of other characters than letters and digits as
# one space).
SENTENCES = {
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy-at",
    "http www apache org licenses license 2 0": "apache-url",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-copy-at",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "mit license": "mit-title",
    "the mit license": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-no-endorsement",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-or-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-or-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-no-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy-at",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-4",
    "this work is dedicated to the public domain": "cc0-notice",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "all rights reserved": "all-rights-reserved",
}

# Rules in order of precedence, as (licence, identifiers in sequence).
RULES = (
    ("Apache-2.0", ("apache-notice", "apache-compliance", "apache-copy-at", "apache-url", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-notice", "apache-compliance", "apache-copy-at", "apache-as-is", "apache-see")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-no-endorsement")),
    ("MIT", ("mit-title", "mit-grant", "mit-keep-notice", "mit-as-is")),
    ("GPL-3.0-or-later", ("gpl3-or-later", "gnu-no-warranty", "gpl-see", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-or-later", "gnu-no-warranty", "gpl-see", "gpl-copy")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-keep-notice", "mit-as-is")),
    ("MPL-2.0", ("mpl2-notice", "mpl2-copy-at")),
    ("CC0-1.0", ("cc0-notice", "cc0-waiver")),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-title",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("GPL-3.0-or-later", ("gpl3-or-later",)),
    ("GPL-2.0-or-later", ("gpl2-or-later",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("CC-BY-4.0", ("cc-by-4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("proprietary", ("all-rights-reserved",)),
)

# Further texts, and the pieces a sentence falls into at a mark inside it.
SENTENCES |= {
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-no-endorsement",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-as-is",
    "this is free and unencumbered software released into the public domain": "unlicense-notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
}
RULES += (
    ("ISC", ("isc-grant", "isc-as-is")), ("ISC", ("isc-grant",)), ("Unlicense", ("unlicense-notice",)), ("BSL-1.0", ("boost-grant",)),
)

_OTHER = re.compile(r"[^a-z0-9]+")


def normalised(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


#: normalised licence name -> identifier of a notice that names it
NAMES: dict[str, str] = {}
#: normalised SPDX identifier -> identifier of a tag that names it
SPDX: dict[str, str] = {}


def _named(licence: str, identifier: str, *names: str):
    """A licence by its names in notices; its identifier alone is a rule unless it is one already."""
    global RULES
    SPDX[normalised(licence)] = identifier
    for name in names:
        NAMES[name] = identifier
        SENTENCES.setdefault(f"licensed under the {name}", identifier)
    if (identifier,) not in [ids for _, ids in RULES]:
        RULES += ((licence, (identifier,)),)


_named("Apache-2.0", "apache-notice", "apache 2 0", "apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache license v2 0")
_named("MIT", "mit-notice", "mit license", "mit licence", "mit")
_named("BSD-3-Clause", "bsd3-notice", "bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license")
_named("BSD-2-Clause", "bsd2-notice", "bsd 2 clause license", "2 clause bsd license", "simplified bsd license")
_named("ISC", "isc-notice", "isc license")
_named("Unlicense", "unlicense-name", "unlicense")
_named("BSL-1.0", "boost-notice", "boost software license version 1 0", "boost software license 1 0")
_named("MPL-2.0", "mpl2-name", "mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0")
for _v in ("1 0", "2 0"):
    _named(f"EPL-{_v.replace(' ', '.')}", f"epl{_v[0]}-notice", *(f"eclipse public license {x}{_v}" for x in ("", "v", "v ", "version ")))
for _short, _long, _versions in (
    ("gpl", "gnu general public license", ("1", "2", "3")), ("lgpl", "gnu library general public license", ("2",)),
    ("lgpl", "gnu lesser general public license", ("2 1", "3")), ("agpl", "gnu affero general public license", ("3",))):
    _terms = f"you can redistribute it and or modify it under the terms of the {_long} as published by the free software foundation"
    for _lead in ("", "this program is free software "):
        SENTENCES[_lead + _terms] = f"{_short}-terms"
    for _v in _versions:
        _spdx, _id = f"{_short.upper()}-{_v.replace(' ', '.') if ' ' in _v else _v + '.0'}", f"{_short}{_v.replace(' ', '.')}"
        _full = [x for v in (_v, _v if " " in _v else f"{_v} 0") for x in (
            f"{_long} version {v}", f"{_long} v{v}", f"{_short} version {v}", f"{_short} v{v}", f"{_short}v{v}", f"{_short} {v}", f"gnu {_short} version {v}", f"gnu {_short} v{v}")]
        _named(f"{_spdx}-or-later", f"{_id}-or-later", *(f"{x} or {y}" for x in _full for y in ("later", "any later version", "at your option any later version")))
        _named(f"{_spdx}-only", f"{_id}-notice", *_full, *(f"{x} only" for x in _full))
        SENTENCES[f"either version {_v} of the license or at your option any later version"] = f"either-{_v.replace(' ', '.')}"
        for _lead in ("", "this program is free software "):
            SENTENCES[f"{_lead}{_terms} either version {_v} of the license or at your option any later version"] = f"{_id}-or-later"
        RULES += ((f"{_spdx}-or-later", (f"{_short}-terms", f"either-{_v.replace(' ', '.')}")),)
_CC = {"by": "", "sa": " sharealike", "nc": " noncommercial", "nd": " noderivatives"}
for _kind in ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"):
    _long = "creative commons attribution" + "".join(_CC[x] for x in _kind.split("-"))
    for _v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
        _id = f"cc-{_kind}-{_v.replace(' ', '.').removesuffix('.0')}"
        _names = [f"{_long} {_v}{x}" for x in ("", " license", " international license", " unported license", " generic license")]
        _names += [f"cc {_kind.replace('-', ' ')} {_v}{x}" for x in ("", " license")]
        _named(f"CC-{_kind.upper()}-{_v.replace(' ', '.')}", _id, *_names)

#: sentences with a slot: what a notice is about, the holder, the program
_NOTICE = re.compile(
    r"(?:[a-z0-9 ]{1,120}? (?:is|are) )?(?:free software )?(?:dual )?(?:released|licensed|distributed|published|provided|covered|made available|available)"
    r" under (?:the )?(?:terms of )?(?:the )?(?:a )?(.+?)(?: (?:see|which) .*)?")
_ENDORSE = re.compile(
    r"(?:neither )?the names? of [a-z0-9 ]{1,200}? may (?:not )?be used to endorse or promote products derived from this software without specific prior written permission")
_FREE = re.compile(r"[a-z0-9 ]{1,120}? is free software (you can redistribute it and or modify it under the terms of the gnu .+)")
_SLOT = 320  # letters that slots may add

#: a sentence ends at a mark before white space or at an empty line (and may end with any line)
_CUT = re.compile(r"[.!?:;]+(?=\s|$)|\n\s*\n")
_TAG = re.compile(r"(spdx-license-identifier)\s*:", re.I)


#: kinds of words in the look ahead
PLAIN, NAMED, UNDER = 1, 2, 4


class Recogniser:
    """Sentences and rules, ready to match; other tables may be given."""

    def __init__(self, sentences: dict[str, str] = SENTENCES, rules=RULES):
        self.sentences = sentences
        self.known = set(sentences.values())
        self.longest = max(map(len, sentences), default=0) + _SLOT
        self.rules: dict[str, list] = {}
        for name, ids in rules:
            self.rules.setdefault(ids[0], []).append((name, ids))
        # what each sentence that identifier() accepts must hold: its longest word, a word of a slot's pattern, or
        # of a notice that names a licence both "under" and a word of the name
        self.words = ahocorasick.Automaton()
        need = {max(sentence.split(), key=len): PLAIN for sentence in sentences}
        if sentences:
            need |= {"endorse": PLAIN, "redistribute": PLAIN, "spdx": PLAIN}
            for name in NAMES:
                word = max(name.split(), key=len)
                need[word] = need.get(word, NAMED)
            need.setdefault("under", UNDER)
        for word, kind in need.items():
            self.words.add_word(word, kind)
        if need:
            self.words.make_automaton()

    def may_hold(self, raw: bytes) -> bool:
        """Whether a text can have a known sentence (no: it has none)."""
        seen = 0
        if self.sentences:
            for _, kind in self.words.iter(raw.lower().decode("latin-1")):
                seen |= kind
                if seen & PLAIN or seen == NAMED | UNDER:
                    return True
        return False

    def identifier(self, sentence: str) -> str | None:
        """The identifier of a normalised sentence, as it stands or by its slots."""
        if sentence in self.sentences:
            return self.sentences[sentence]
        found = None
        if sentence.startswith("spdx license identifier "):
            found = SPDX.get(sentence.removeprefix("spdx license identifier "))
        if not found and " under " in sentence and (m := _NOTICE.fullmatch(sentence)):
            found = NAMES.get(m[1])
        if not found and " endorse " in sentence and _ENDORSE.fullmatch(sentence):
            found = "bsd-no-endorsement"
        if not found and " is free software " in sentence and (m := _FREE.fullmatch(sentence)):
            found = self.sentences.get(f"this program is free software {m[1]}")
        return found if found in self.known else None

    def ids(self, raw: bytes) -> list[str]:
        """The identifiers of the known sentences, in order.

        A sentence ends at a mark or with a line; it may run on over lines.
        """
        return self.read(raw) if self.may_hold(raw) else []

    def read(self, raw: bytes) -> list[str]:
        """``ids`` without the look ahead."""
        out = []
        for block in _CUT.split(_TAG.sub(r"\1", raw.decode("utf-8", "replace"))):
            lines = [n for line in block.split("\n") if (n := normalised(line))]
            at = 0
            while at < len(lines):
                joined, found, size = "", None, 1
                for end in range(at, len(lines)):
                    joined = f"{joined} {lines[end]}" if joined else lines[end]
                    if len(joined) > self.longest:
                        break
                    if identifier := self.identifier(joined):
                        found, size = identifier, end + 1 - at
                if found:
                    out.append(found)
                at += size
        return out

    def match(self, ids: list[str]) -> tuple[list[str], list[str]]:
        """(licences, unexplained identifiers), each in order of the text."""
        names, rest, at = [], [], 0
        while at < len(ids):
            for name, wanted in self.rules.get(ids[at], ()):
                if tuple(ids[at:at + len(wanted)]) == wanted:
                    names.append(name)
                    at += len(wanted)
                    break
            else:
                rest.append(ids[at])
                at += 1
        return names, rest


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """``keep`` columns with the licences of each whole text.

    licences: the distinct names in order of the text, comma-joined; n_rules:
    rules met, repeats counted; sentence_ids, unexplained: identifiers in
    order. Null, empty and licence-free texts have none (empty strings).
    """
    def make():
        r = Recogniser(sentences, rules)

        def one(raw: bytes) -> tuple:
            ids = r.ids(raw)
            names, rest = r.match(ids)
            return ",".join(dict.fromkeys(names)), len(names), ",".join(ids), ",".join(rest)

        return one

    return map_documents(docs, make, "licences string, n_rules long, sentence_ids string, unexplained string", text, keep)
