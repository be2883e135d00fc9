"""License scan by ordered signature rules.

A rule is a regular expression over the word string of a text (its words, lower-cased, joined by single spaces), with a
label, a priority and a keyword that every match contains. The rules are made from hand-written names and families of
wordings, several hundred in all. A rule's expression runs only where its keyword, and one of the other words that its
own expression demands, occur; there is no test of the text besides. Overlapping detections are resolved by priority: a
detection is suppressed when its interval lies inside that of one with a higher priority, or inside a longer one of the
same priority. Base phrases are reported besides and are never suppressed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame

from tallyward.llm.common import map_texts, texts

# Words of the scan (before A-Z is lower-cased), and the base phrases with their labels.
SCAN_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"\w+")
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label -> (names of the license, versions it is cited with). Hand-written, as expressions over words.
FAMILIES: dict[str, tuple[list[str], list[str]]] = {
    "mit": (["mit", "expat", "mit x11", "x11"], []),
    "mit-0": (["mit no attribution", "mit 0"], []),
    "apache": (["apache", "apache software", "asl", "apache software foundation"], ["1 0", "1 1", "2", "2 0"]),
    "gpl": (["gnu general public", "general public", "gpl", "gnu gpl"], ["1", "2", "3", "2 0", "3 0"]),
    "lgpl": (["gnu lesser general public", "lesser general public", "library general public", "lgpl", "gnu lgpl"],
             ["2", "2 0", "2 1", "3", "3 0"]),
    "agpl": (["gnu affero general public", "affero general public", "agpl", "gnu agpl"], ["1", "3", "3 0"]),
    "fdl": (["gnu free documentation", "free documentation", "gfdl"], ["1 1", "1 2", "1 3"]),
    "bsd": (["bsd", "berkeley software distribution", "new bsd", "modified bsd", "simplified bsd", "freebsd"], []),
    "bsd-2-clause": (["bsd 2 clause", "2 clause bsd", "two clause bsd"], []),
    "bsd-3-clause": (["bsd 3 clause", "3 clause bsd", "three clause bsd", "revised bsd"], []),
    "bsd-4-clause": (["bsd 4 clause", "4 clause bsd", "original bsd"], []),
    "0bsd": (["0bsd", "zero clause bsd"], []),
    "isc": (["isc", "internet systems consortium"], []),
    "mpl": (["mozilla public", "mpl"], ["1 0", "1 1", "2", "2 0"]),
    "epl": (["eclipse public", "epl"], ["1 0", "2", "2 0"]),
    "edl": (["eclipse distribution", "edl"], ["1 0"]),
    "cddl": (["common development and distribution", "cddl"], ["1 0", "1 1"]),
    "cpl": (["common public", "ibm public"], ["1 0"]),
    "eupl": (["european union public", "eupl"], ["1 0", "1 1", "1 2"]),
    "artistic": (["artistic", "perl artistic", "clarified artistic"], ["1 0", "2 0"]),
    "afl": (["academic free"], ["2 1", "3 0"]),
    "osl": (["open software"], ["2 1", "3 0"]),
    "apsl": (["apple public source"], ["1 2", "2 0"]),
    "ms-pl": (["microsoft public", "ms pl"], []),
    "ms-rl": (["microsoft reciprocal", "ms rl"], []),
    "psf": (["python software foundation", "psf"], ["2", "2 0"]),
    "php": (["php"], ["3 0", "3 01"]),
    "ruby": (["ruby"], []),
    "zlib": (["zlib", "zlib libpng"], []),
    "libpng": (["libpng", "png reference library"], []),
    "boost": (["boost software", "bsl"], ["1 0"]),
    "wtfpl": (["do what the fuck you want to public", "wtfpl"], ["1", "2"]),
    "unlicense": (["unlicense"], []),
    "cc0": (["cc0", "creative commons zero", "cc zero"], ["1 0"]),
    "cc-by": (["cc by", "creative commons attribution"], ["2 0", "2 5", "3 0", "4 0"]),
    "cc-by-sa": (["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"],
                 ["2 0", "2 5", "3 0", "4 0"]),
    "cc-by-nd": (["cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"],
                 ["2 0", "2 5", "3 0", "4 0"]),
    "cc-by-nc": (["cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"],
                 ["2 0", "2 5", "3 0", "4 0"]),
    "cc-by-nc-sa": (["cc by nc sa", "creative commons attribution noncommercial sharealike",
                     "creative commons attribution non commercial share alike"], ["2 0", "2 5", "3 0", "4 0"]),
    "cc-by-nc-nd": (["cc by nc nd", "creative commons attribution noncommercial noderivatives",
                     "creative commons attribution non commercial no derivatives"], ["2 0", "2 5", "3 0", "4 0"]),
    "odbl": (["open database", "odbl"], ["1 0"]),
    "odc-by": (["open data commons attribution", "odc by"], ["1 0"]),
    "pddl": (["public domain dedication and license", "pddl"], ["1 0"]),
    "ofl": (["sil open font", "open font", "ofl"], ["1 0", "1 1"]),
    "openssl": (["openssl", "ssleay"], []),
    "postgresql": (["postgresql"], []),
    "qpl": (["q public"], ["1 0"]),
    "sleepycat": (["sleepycat", "berkeley database"], []),
    "sspl": (["server side public", "sspl"], ["1", "1 0"]),
    "busl": (["business source", "busl"], ["1 1"]),
    "elastic": (["elastic"], ["1 0", "2", "2 0"]),
    "upl": (["universal permissive", "upl"], ["1 0"]),
    "ncsa": (["university of illinois ncsa open source", "ncsa"], []),
    "unicode": (["unicode"], []),
    "vim": (["vim"], []),
    "w3c": (["w3c software notice and", "w3c"], []),
    "watcom": (["sybase open watcom public"], ["1 0"]),
    "xfree86": (["xfree86"], ["1 0", "1 1"]),
    "zpl": (["zope public", "zpl"], ["1 1", "2 0", "2 1"]),
}

#: Characteristic sentences of license texts: label, keyword, expression.
SENTENCES = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "warranty", r"the software is provided as is without warranty of any kind"),
    ("apache", "compliance", r"you may not use this file except in compliance with the license"),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general"
                             r" public license"),
    ("agpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu affero general public"
                             r" license"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification"),
    ("bsd-3-clause", "endorse", r"neither the name of .{1,80}? may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software"),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("proprietary", "reserved", r"all rights reserved"),
    ("proprietary", "confidential", r"proprietary and confidential"),
]


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    priority: int
    also: frozenset[str] = frozenset()  # whole words of which every match holds one; none: no such word is known


class Detection(NamedTuple):
    start: int
    end: int
    label: str
    priority: int


def rules() -> list[Rule]:
    """All rules, highest priority first: full citations (40), titles with their version (30), tags and links (20),
    bare titles (10), sentences (35)."""
    out = []
    license = frozenset(["license", "licence"])
    verbs = frozenset(["licensed", "licenced", "released", "distributed", "published", "available", "covered"])
    for label, (names, versions) in FAMILIES.items():
        version = rf"(?: (?:version |v)?(?:{'|'.join(sorted(versions, key=len, reverse=True))})\b)" if versions else ""
        for name in names:
            word = max(name.split(), key=len)
            short = " " not in name or label.startswith("cc")
            title = rf"{name}(?: public)?(?: licen[cs]e)?" if short else rf"{name} licen[cs]e"
            verb = r"(?:licen[cs]ed|released|distributed|published|available|covered)"
            out.append(Rule(label, word, rf"\b{verb} (?:\w+ ){{0,3}}?(?:under|by) (?:the )?(?:terms of (?:the )?)?"
                                         rf"{title}{version}{'?' if version else ''}", 40, verbs))
            if versions:
                out.append(Rule(label, word, rf"\b{title}{version}", 30, frozenset() if short else license))
            out.append(Rule(label, word, rf"\bspdx license identifier {name}\b(?: [0-9]+)*(?: only| or later)?", 20,
                            frozenset(["spdx"])))
            if not short or label in ("mit", "bsd", "isc", "zlib", "apache", "artistic", "unlicense", "php", "ruby"):
                out.append(Rule(label, word, rf"\b{name} licen[cs]e\b", 10, license))
        link = re.sub(r"[^a-z0-9]+", " ", label)
        out.append(Rule(label, link.split()[0], rf"\b(?:opensource org licenses|spdx org licenses) {link}\b", 20,
                        frozenset(["opensource", "spdx"])))
        if label.startswith("cc-by"):
            out.append(Rule(label, "creativecommons", rf"\bcreativecommons org licenses {label[3:].replace('-', ' ')}\b"
                                                      r"(?! (?:sa|nc|nd)\b)", 20))
    out += [Rule(label, keyword, rf"\b{pattern}\b", 35) for label, keyword, pattern in SENTENCES]
    return sorted(out, key=lambda r: (-r.priority, r.label, r.pattern))


def resolve(found: list[Detection]) -> list[Detection]:
    """Detections that no other one suppresses; equal intervals of one priority are kept for every label."""
    kept: list[Detection] = []
    for d in sorted(set(found), key=lambda d: (-d.priority, d.start - d.end, d.start, d.label)):
        if not any(k.start <= d.start and d.end <= k.end
                   and (k.priority > d.priority or (k.start, k.end) != (d.start, d.end)) for k in kept):
            kept.append(d)
    return sorted(kept)


class Scanner:
    def __init__(self):
        self.rules = [(r, re.compile(r.pattern)) for r in rules()]

    def detect(self, line: str) -> list[Detection]:
        """Detections in a word string, by character positions."""
        out, held = [], set(WORD.findall(line))
        for rule, pattern in self.rules:
            # a full citation may end within a word; all other rules hold their keyword as a whole word
            if (rule.keyword in held or rule.priority == 40 and rule.keyword in line) and \
                    not (rule.also and rule.also.isdisjoint(held)):
                out += [Detection(*m.span(), rule.label, rule.priority) for m in pattern.finditer(line)]
        return resolve(out)


def lower_ascii(text: str) -> str:
    return text.translate(LOWER)


LOWER = {c: c + 32 for c in range(65, 91)}


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """(start word, label) of every base phrase."""
    out = []
    for phrase, label in BASE.items():
        want = phrase.split()
        at = -1
        try:
            while True:
                at = words.index(want[-1], at + 1)
                first = at - len(want) + 1
                if first >= 0 and words[first:at + 1] == want:
                    out.append((first, label))
        except ValueError:
            pass
    return sorted(out)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, base (array of word position and label), detections (array of first word,
    end word (exclusive), label, priority), score (share of certainty: 1 for a full citation or a base phrase, less for
    weaker rules, 0 without a detection).

    Words and positions are those of the whole text with A-Z lower-cased. Null texts count as empty; null ids stay
    null; repeated rows get a row each; other columns are ignored; an empty table gives an empty result.
    """
    source = texts(docs, id_col, text_col)

    def scan(blocks) -> Iterator[dict]:
        scanner = Scanner()
        for ids, block in blocks:
            out: dict[str, list] = {"doc_id": ids, "n_words": [], "base": [], "detections": [], "score": []}
            for t in block:
                words = SCAN_WORD.findall(t)
                out["n_words"].append(len(words))
                line, found = lower_ascii(" ".join(words)), []
                base = base_places(line.split(" "))
                for d in scanner.detect(line):
                    first = line.count(" ", 0, d.start)
                    found.append((first, first + line.count(" ", d.start, d.end) + 1, d.label, d.priority))
                out["base"].append([{"word": w, "label": b} for w, b in base])
                out["detections"].append([dict(zip(("word", "end", "label", "priority"), d)) for d in found])
                out["score"].append(max([d[3] / 40 for d in found] + [1.0 for _ in base[:1]] + [0.0]))
            yield out

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_texts(source, scan, f"doc_id {kind}, n_words long, base array<struct<word:long,label:string>>, "
                     "detections array<struct<word:long,end:long,label:string,priority:int>>, score double")
