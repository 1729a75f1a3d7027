"""License scans: ordered signature rules, a keyword gate and suppression of contained detections.

A rule is a regular expression over the normalised words of a text (lower
case, one space between words, see `common.words_of`).  It is tried only where
all its keywords are words of the text, so most texts meet no rule at all.  A
detection is suppressed if its words lie within those of a detection by a rule
of higher priority, or of a longer one, or of an earlier rule of the same
priority.  Base phrases are rules whose places are all reported, suppressed or not.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import each_text, map_batches, words_of
from corpusloom.llm.decontamination import _WORD

# Probability that a kept detection by a rule of this priority is a true one.
CONFIDENCE = {1: 0.95, 2: 0.85, 3: 0.6, 4: 0.4}


@dataclass(frozen=True)
class Rule:
    """``pattern`` over normalised words; lower ``priority`` wins; ``base`` places are always reported.

    Every match holds the ``keywords`` and, if ``named``, a word for license.
    """

    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int
    base: bool = False
    named: bool = False


# Phrases that must be reported wherever they stand, and their labels.
BASE = (
    Rule("cc-by", "cc by", ("cc", "by"), 4, True),
    Rule("gpl", "general public license", ("general", "public", "license"), 4, True),
    Rule("reserved", "all rights reserved", ("all", "rights", "reserved"), 4, True),
)

# Families: label, name as a pattern, versions (spaces for dots), whether the name alone tells the license.
FAMILIES = (
    ("apache", "apache(?: software)?", ("2 0", "1 1", "1 0"), False),
    ("mit", "mit", (), False),
    ("mit-0", "mit no attribution|mit 0", (), False),
    ("expat", "expat", (), False),
    ("x11", "x11", (), False),
    ("isc", "isc|internet systems consortium", (), False),
    ("bsd", "bsd|berkeley software distribution", (), False),
    ("bsd-2-clause", "bsd 2 clause|2 clause bsd|simplified bsd|freebsd", (), True),
    ("bsd-3-clause", "bsd 3 clause|3 clause bsd|new bsd|modified bsd", (), True),
    ("bsd-4-clause", "bsd 4 clause|4 clause bsd|original bsd", (), True),
    ("gpl", "gnu general public|gnu gpl|gpl", ("1", "2", "3", "2 0", "3 0"), False),
    ("lgpl", "gnu (?:lesser|library) general public|gnu lgpl|lgpl", ("2", "2 1", "3", "3 0"), False),
    ("agpl", "gnu affero general public|affero general public|gnu agpl|agpl", ("1", "3", "3 0"), False),
    ("gfdl", "gnu free documentation|gfdl", ("1 1", "1 2", "1 3"), True),
    ("mpl", "mozilla public|mpl", ("1 0", "1 1", "2 0"), False),
    ("epl", "eclipse public|epl", ("1 0", "2 0"), False),
    ("eupl", "european union public|eupl", ("1 1", "1 2"), True),
    ("cddl", "common development and distribution|cddl", ("1 0", "1 1"), True),
    ("cpl", "common public", ("1 0",), False),
    ("artistic", "artistic", ("1 0", "2 0"), False),
    ("perl", "perl 5|perl", (), False),
    ("zlib", "zlib(?: libpng)?", (), False),
    ("boost", "boost software|bsl", ("1 0",), False),
    ("python", "python software foundation|psf", ("2", "2 0"), False),
    ("ruby", "ruby", (), False),
    ("php", "php", ("3 0", "3 01"), False),
    ("openssl", "openssl", (), False),
    ("postgresql", "postgresql", (), False),
    ("ofl", "sil open font|open font|ofl", ("1 0", "1 1"), False),
    ("wtfpl", "do what the fuck you want to public|wtfpl", ("2", "2 0"), True),
    ("unlicense", "unlicense", (), True),
    ("ms-pl", "microsoft public|ms pl", (), False),
    ("ms-rl", "microsoft reciprocal|ms rl", (), False),
    ("osl", "open software", ("1 0", "2 1", "3 0"), False),
    ("afl", "academic free|afl", ("2 1", "3 0"), False),
    ("odbl", "open database|odbl", ("1 0",), False),
    ("odc-by", "open data commons attribution|odc by", ("1 0",), True),
    ("pddl", "public domain dedication and|pddl", ("1 0",), True),
    ("cc-by", "cc by|creative commons attribution", ("1 0", "2 0", "2 5", "3 0", "4 0"), True),
    ("cc-by-sa", "cc by sa|creative commons attribution share ?alike", ("1 0", "2 0", "2 5", "3 0", "4 0"), True),
    ("cc-by-nc", "cc by nc|creative commons attribution non ?commercial", ("2 0", "2 5", "3 0", "4 0"), True),
    ("cc-by-nd", "cc by nd|creative commons attribution no ?deriv(?:ative)?s", ("2 0", "3 0", "4 0"), True),
    ("cc-by-nc-sa", "cc by nc sa|creative commons attribution non ?commercial share ?alike", ("3 0", "4 0"), True),
    ("cc-by-nc-nd", "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s", ("4 0",), True),
    ("cc0", "cc0|creative commons zero|cc zero", ("1 0",), True),
    ("bsl-business", "business source|busl", ("1 1",), False),
    ("sspl", "server side public|sspl", ("1", "1 0"), False),
    ("elastic", "elastic", ("2 0",), False),
    ("llama", "llama (?:2|3) community|llama community", (), False),
    ("openrail", "openrail(?: m)?|open rail(?: m)?|bigscience (?:open )?rail", ("1 0",), False),
    ("apple-psl", "apple public source|apsl", ("1 0", "2 0"), False),
    ("w3c", "w3c(?: software)?", (), False),
    ("vim", "vim", (), False),
    ("qpl", "q public|qpl", ("1 0",), False),
    ("latex-ppl", "latex project public|lppl", ("1 3", "1 3c"), False),
)

# How a family is named: prefix and suffix patterns around the name, priority, keywords; {v} is a version.
_NAMED = "license|licence|licenses|licences"
FORMS = (
    ("(?:licensed|released|distributed|available|published|provided|covered) under (?:the )?(?:terms of (?:the )?)?",
     "(?: (?:LICENSE))?(?:(?: version| v)? {v})?(?: or (?:any )?later)?", 1, ("under",)),
    ("spdx license identifier ", "(?: {v})?(?: only| or later)?", 1, ("spdx",)),
    ("(?:the )?", " (?:LICENSE)(?:(?: version| v)? {v})?", 2, ()),
    ("(?:LICENSE) ", "(?: {v})?", 3, ()),
    ("under (?:the )?(?:terms of (?:the )?)?", "(?: {v})?", 3, ("under",)),
    ("dual licensed under (?:the )?", "(?: {v})?", 1, ("dual",)),
)

# Notices that are no family's name.
NOTICES = (
    ("copyright", "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?(?: by)?", ("copyright",), 3),
    ("copyright", "copyright c", ("copyright",), 4),
    ("copyright", "(?:this work is )?protected by copyright(?: law)?", ("copyright", "protected"), 3),
    ("reserved", "(?:all|some|no) rights reserved", ("rights", "reserved"), 2),
    ("reserved", "alle rechte vorbehalten", ("rechte", "vorbehalten"), 2),
    ("reserved", "tous droits réservés", ("droits",), 2),
    ("reserved", "todos los derechos reservados", ("derechos", "reservados"), 2),
    ("proprietary", "proprietary and confidential|confidential and proprietary", ("proprietary", "confidential"), 2),
    ("proprietary", "unauthorized (?:copying|use|distribution)(?: of this [a-z]+)? is (?:strictly )?prohibited",
     ("unauthorized", "prohibited"), 1),
    ("proprietary", "may not be (?:copied|reproduced|redistributed)(?: without (?:prior )?(?:written )?permission)?",
     ("may", "not", "be"), 3),
    ("public-domain", "(?:released|dedicated|placed) (?:in)?to the public domain", ("public", "domain"), 1),
    ("public-domain", "in the public domain", ("public", "domain"), 3),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ("permission", "hereby", "granted"), 1),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee",
     ("permission", "distribute", "fee"), 1),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ("redistribution", "binary"), 1),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors may be used",
     ("neither", "contributors"), 1),
    ("gpl", "this program is free software you can redistribute it and or modify it", ("free", "redistribute"), 1),
    ("gpl", "either version (?:2|3)(?: 0)? of the license or at your option any later version", ("option", "later"), 1),
    ("apache", "you may not use this file except in compliance with the license", ("compliance", "license"), 1),
    ("apache", "www apache org licenses license 2 0", ("apache", "licenses"), 1),
    ("gpl", "www gnu org (?:copyleft|licenses)(?: gpl)?", ("gnu", "org"), 2),
    ("mit", "opensource org licenses mit", ("opensource", "mit"), 1),
    ("bsd-3-clause", "opensource org licenses bsd 3 clause", ("opensource", "bsd"), 1),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla", "subject"), 1),
    ("cc-by", "creativecommons org licenses by(?: [0-9] [0-9])?", ("creativecommons",), 1),
    ("cc-by-sa", "creativecommons org licenses by sa(?: [0-9] [0-9])?", ("creativecommons", "sa"), 1),
    ("cc-by-nc", "creativecommons org licenses by nc(?: [0-9] [0-9])?", ("creativecommons", "nc"), 1),
    ("cc0", "creativecommons org publicdomain zero(?: 1 0)?", ("creativecommons", "zero"), 1),
    ("no-warranty", "(?:provided )?as is without warranty of any kind", ("without", "warranty"), 3),
    ("no-warranty", "without any warranty", ("without", "warranty"), 4),
    ("unknown", "see (?:the )?(?:file )?(?:license|copying|notice)(?: txt| md)?(?: file)? for", ("see", "for"), 4),
)


def _keywords(name: str) -> list[tuple[str, ...]]:
    """For each alternative of a name its plain words."""
    plain = [re.sub(r"\(\?:[^()]*\)\??", " ", a) for a in re.split(r"\|(?![^(]*\))", name)]
    return [tuple(w for w in re.sub(r"\S+ \?\S+", " ", p).split() if len(w) > 1) for p in plain]


def rules() -> tuple[Rule, ...]:
    """Base phrases, notices, and every form of every family, in order.

    An alternative of a family's name is a rule of its own, so that its words
    can be the gate.
    """
    out = list(BASE)
    out += [Rule(label, pattern, keywords, priority) for label, pattern, keywords, priority in NOTICES]
    for label, name, versions, telling in FAMILIES:
        version = "(?:" + "|".join(sorted(versions, key=len, reverse=True)) + ")" if versions else "(?:[0-9] [0-9]|[0-9])"
        for alternative, own in zip(re.split(r"\|(?![^(]*\))", name), _keywords(name)):
            for before, after, priority, keywords in FORMS:
                named = before == "(?:LICENSE) " or after.startswith(" (?:LICENSE)(")
                pattern = f"{before}(?:{alternative}){after}".replace("LICENSE", _NAMED).replace("{v}", version)
                out.append(Rule(label, pattern, own + keywords, priority, named=named))
            if telling:
                out.append(Rule(label, f"(?:{alternative})(?: {version})?", own, 2 if " " in alternative else 4))
    return tuple(out)


class Scanner:
    """The rules, compiled and found by their rarest keyword."""

    # words that ordinary text holds too often to be the gate of a rule
    COMMON = {"under", "the", "by", "all", "in", "may", "not", "be", "mit", "see", "for", "without", "public",
              "general", "or", "open", "free", "new", "common", "version", "any", "and", "of", "to", "data"}

    def __init__(self, ordered: tuple[Rule, ...]):
        self.rules = ordered
        self.find = [re.compile(f"(?<= )(?:{r.pattern})(?= )".encode()) for r in ordered]
        self.needs = [frozenset(k.encode() for k in r.keywords) for r in ordered]
        self.gate: dict[bytes, list[int]] = {}
        licenses = _NAMED.encode().split(b"|")
        for i, need in enumerate(self.needs):
            rare = sorted(need - {k.encode() for k in self.COMMON}, key=lambda k: (-len(k), k))
            if rare:
                keys = rare[:1]
            elif ordered[i].named:
                keys = licenses
            else:
                keys = sorted(need, key=lambda k: (-len(k), k))[:1]
            for key in keys:
                self.gate.setdefault(key, []).append(i)
        self.keys = frozenset(self.gate)
        self.words = self.keys.union(*self.needs)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, int, bool]]:
        """Detections (rule, first word, word after the last, kept) in order of place."""
        if self.keys.isdisjoint(words):
            return []
        present = self.words.intersection(words)
        tried = sorted({i for k in present & self.keys for i in self.gate[k] if self.needs[i] <= present})
        if not tried:
            return []
        text = b" " + b" ".join(words) + b" "
        spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 0x20)
        found = []
        for i in tried:
            for m in self.find[i].finditer(text):
                first, after = np.searchsorted(spaces, [m.start() - 1, m.end()])
                found.append((i, int(first), int(after)))
        if not found:
            return []
        kept = self.suppress(found)
        return sorted(
            ((*d, k) for d, k in zip(found, kept)), key=lambda d: (d[1], -d[2], d[0])
        )

    def suppress(self, found: list[tuple[int, int, int]]) -> list[bool]:
        """Whether a detection is kept: no better one holds all its words."""
        priority = np.array([self.rules[i].priority for i, _, _ in found])
        order = sorted(range(len(found)), key=lambda d: (found[d][1], -found[d][2], priority[d], found[d][0]))
        kept = [True] * len(found)
        # a detection that holds another one comes before it in this order; for each priority, the furthest
        # end so far decides, as what is suppressed lies itself within something better
        furthest: dict[int, int] = {}
        for d in order:
            _, first, after = found[d]
            own = int(priority[d])
            if any(end >= after for p, end in furthest.items() if p <= own):
                kept[d] = False
            furthest[own] = max(furthest.get(own, -1), after)
        return kept


DETECTIONS = (
    "doc_id long, n_words long, detections array<struct<rule:int,label:string,priority:int,base:boolean,"
    "kept:boolean,first_word:long,n_words:long,start:long,end:long,text:string>>"
)
_DETECTION = pa.struct([
    ("rule", pa.int32()), ("label", pa.string()), ("priority", pa.int32()), ("base", pa.bool_()),
    ("kept", pa.bool_()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("start", pa.int64()),
    ("end", pa.int64()), ("text", pa.string()),
])

_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scan_licenses(docs: DataFrame, ordered: tuple[Rule, ...] | None = None) -> DataFrame:
    """License detections of every document: ``doc_id, n_words, detections`` (in order of place).

    A detection has its rule's number, label and priority, its words and
    characters in the text, its text, and whether it is ``kept``.

    Null and empty texts have no words and no detections.  Rows that repeat a
    doc_id, or have none, are scanned each on its own.  Other columns are
    ignored; an empty table gives no rows.
    """
    ordered = rules() if ordered is None else ordered

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if ordered not in _SCANNERS:
            _SCANNERS[ordered] = Scanner(ordered)
        scanner = _SCANNERS[ordered]
        counts, detections = [], []
        for raw in each_text(batch.column("text")):
            words = words_of(raw)
            found = scanner.scan(words)
            rows = []
            if found:
                text = raw.decode()
                spans = [m.span() for m in _WORD.finditer(text)]
                for i, first, after, kept in found:
                    rule, start, end = ordered[i], spans[first][0], spans[after - 1][1]
                    rows.append({
                        "rule": i, "label": rule.label, "priority": rule.priority, "base": rule.base, "kept": kept,
                        "first_word": first, "n_words": after - first, "start": start, "end": end,
                        "text": text[start:end],
                    })
            counts.append(len(words))
            detections.append(rows)
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(detections, pa.list_(_DETECTION))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "detections"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, run, DETECTIONS)
