"""License detection by ordered signature rules.

Texts are reduced to lower-cased words. Hundreds of regular expressions over the
words, generated from the hand-written families below, are gated by a keyword
prefilter: a rule is tried only on texts that contain its keyword. Overlapping
detections are resolved by priority, then length: one that lies inside a
detection of at least its priority is suppressed. Base phrases are never
suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose words, in a row, always give these labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Hand-written families: label, short names, long names, versions. Names are word patterns.
FAMILIES = (
    ("gpl", ("gpl", "gnu gpl"), ("gnu general public licen[cs]e", "general public licen[cs]e"), ("1", "2", "3")),
    ("lgpl", ("lgpl", "gnu lgpl"), ("gnu (?:lesser|library) general public licen[cs]e", "(?:lesser|library) general public licen[cs]e"), ("2", "2 1", "3")),
    ("agpl", ("agpl", "gnu agpl"), ("gnu affero general public licen[cs]e", "affero general public licen[cs]e"), ("1", "3")),
    ("gfdl", ("gfdl", "gnu fdl"), ("gnu free documentation licen[cs]e",), ("1 1", "1 2", "1 3")),
    ("apache", ("asl", "apache"), ("apache software licen[cs]e", "apache licen[cs]e"), ("1 0", "1 1", "2 0")),
    ("mpl", ("mpl",), ("mozilla public licen[cs]e",), ("1 0", "1 1", "2 0")),
    ("epl", ("epl",), ("eclipse public licen[cs]e",), ("1 0", "2 0")),
    ("cpl", ("cpl",), ("common public licen[cs]e",), ("1 0",)),
    ("cddl", ("cddl",), ("common development and distribution licen[cs]e",), ("1 0", "1 1")),
    ("eupl", ("eupl",), ("european union public licen[cs]e",), ("1 0", "1 1", "1 2")),
    ("osl", ("osl",), ("open software licen[cs]e",), ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("afl", ("afl",), ("academic free licen[cs]e",), ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", (), ("artistic licen[cs]e",), ("1 0", "2 0")),
    ("ofl", ("sil ofl", "ofl"), ("sil open font licen[cs]e", "open font licen[cs]e"), ("1 0", "1 1")),
    ("zpl", ("zpl",), ("zope public licen[cs]e",), ("1 1", "2 0", "2 1")),
    ("cecill", ("cecill",), ("cecill free software licen[cs]e",), ("1 0", "1 1", "2 0", "2 1")),
    ("lppl", ("lppl",), ("latex project public licen[cs]e",), ("1 0", "1 1", "1 2", "1 3")),
    ("bsl", ("bsl",), ("boost software licen[cs]e",), ("1 0",)),
    ("odbl", ("odbl",), ("open database licen[cs]e", "open data commons open database licen[cs]e"), ("1 0",)),
    ("pddl", ("pddl",), ("public domain dedication and licen[cs]e",), ("1 0",)),
    ("sspl", ("sspl",), ("server side public licen[cs]e",), ("1",)),
    ("busl", ("busl",), ("business source licen[cs]e",), ("1 0", "1 1")),
    ("elastic", (), ("elastic licen[cs]e",), ("1", "2 0")),
    ("apsl", ("apsl",), ("apple public source licen[cs]e",), ("1 0", "1 1", "1 2", "2 0")),
    ("ms-pl", ("ms pl",), ("microsoft public licen[cs]e",), ()),
    ("ms-rl", ("ms rl",), ("microsoft reciprocal licen[cs]e",), ()),
    ("php", (), ("php licen[cs]e",), ("3 0", "3 01")),
    ("psf", ("psf licen[cs]e",), ("python software foundation licen[cs]e",), ("2",)),
    ("qpl", ("qpl",), ("q public licen[cs]e",), ("1 0",)),
    ("upl", ("upl",), ("universal permissive licen[cs]e",), ("1 0",)),
    ("ncsa", (), ("university of illinois ncsa open source licen[cs]e", "ncsa open source licen[cs]e"), ()),
    ("w3c", (), ("w3c software (?:notice and )?licen[cs]e",), ()),
    ("mit", (), ("mit licen[cs]e", "x11 licen[cs]e", "expat licen[cs]e"), ()),
    ("isc", (), ("isc licen[cs]e", "internet systems consortium licen[cs]e"), ()),
    ("zlib", (), ("zlib licen[cs]e", "zlib libpng licen[cs]e"), ()),
    ("unlicense", (), ("the unlicense", "the unlicence"), ()),
    ("wtfpl", ("wtfpl",), ("do what the fuck you want to public licen[cs]e",), ("1", "2")),
    ("beerware", (), ("beerware licen[cs]e",), ("42",)),
    ("bsd-2-clause", (), ("bsd 2 clause(?: licen[cs]e)?", "2 clause bsd(?: licen[cs]e)?", "simplified bsd licen[cs]e"), ()),
    ("bsd-3-clause", (), ("bsd 3 clause(?: licen[cs]e)?", "3 clause bsd(?: licen[cs]e)?", "(?:new|modified|revised) bsd licen[cs]e"), ()),
    ("bsd-4-clause", (), ("bsd 4 clause(?: licen[cs]e)?", "4 clause bsd(?: licen[cs]e)?", "original bsd licen[cs]e"), ()),
    ("bsd", (), ("bsd licen[cs]e", "bsd style licen[cs]e"), ()),
    ("cc0", ("cc0", "cc zero"), ("creative commons zero",), ("1 0",)),
)
CC_PARTS = (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))
CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Hand-written signatures of whole texts and notices: label, priority, keyword, pattern.
SIGNATURES = (
    ("mit", 60, "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", 60, "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 55, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", 60, "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", 60, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("gpl", 50, "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e"),
    ("bsl-1.0", 60, "hereby", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("public-domain", 30, "domain", "(?:released into|placed in|dedicated to|in) the public domain"),
    ("proprietary", 20, "reserved", "all rights reserved"),
    ("proprietary", 25, "confidential", "(?:proprietary and )?confidential(?: information)? do not distribute"),
    ("licensed", 10, "licensed", "licensed under the"),
)
#: A detection of this priority or more is certain.
CERTAIN = 60
NONWORD = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256))


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: str
    pattern: str


def _keyword(name: str) -> str:
    """A plain word that every match of ``name`` contains: the longest outside brackets and alternatives."""
    flat = re.sub(r"\((?:[^()]|\([^()]*\))*\)\??|\[[^\]]*\]\S*|\S+\?\S*", " | ", name)
    return max((w for w in flat.split() if w != "|" and not w.endswith("licen")), key=len)


SPDX = "spdx licen[cs]e identifier"
PUBLISHED = "(?:as )?(?:published by the free software foundation )?"
LATER = "or (?:at your option )?(?:any )?later"


def _spoken(label: str) -> str:
    """The words of an identifier."""
    return label.replace("-", " ").replace(".", " ")


def _dotted(version: str) -> str:
    return version.replace(" ", ".")


def rules() -> list[Rule]:
    """All rules in order: highest priority first, then as written."""
    found = [Rule(label, p, key, pattern) for label, p, key, pattern in SIGNATURES]
    for label, short, long, versions in FAMILIES:
        for name in long:
            found.append(Rule(label, 30, _keyword(name), name))
            found.append(Rule(label, 35, _keyword(name), f"licensed under (?:the )?(?:terms of the )?{name}"))
        for name in short:
            found.append(Rule(label, 30, _keyword(name), f"(?:licensed under|under|licen[cs]e) (?:the )?{name}"))
        found.append(Rule(label, 55, "spdx", f"{SPDX} {_spoken(label)}"))
        for v in versions:
            exact = f"{label}-{_dotted(v)}"
            later = f"{exact}-or-later"
            for name in long:
                found.append(Rule(exact, 45, _keyword(name), f"{name} (?:v|version )?{v}"))
                found.append(Rule(later, 50, _keyword(name), f"{name} {PUBLISHED}(?:either )?(?:v|version )?{v}(?: of the licen[cs]e)? {LATER}"))
            for name in short:
                found.append(Rule(exact, 45, _keyword(name), f"{name} (?:v ?|version )?{v}"))
                found.append(Rule(later, 50, _keyword(name), f"{name} (?:v ?|version )?{v} {LATER}"))
                for glue in ("v", "") if name.split()[-1].isalnum() else ():  # GPLv3, GPL3
                    key = f"{name.split()[-1]}{glue}{v.split()[0]}"
                    found.append(Rule(exact, 45, key, f"{name}{glue}{v}"))
                    found.append(Rule(later, 50, key, f"{name}{glue}{v} {LATER}"))
            found.append(Rule(exact, 56, "spdx", f"{SPDX} {_spoken(label)} {v}(?: 0)?(?: only)?"))
            found.append(Rule(later, 57, "spdx", f"{SPDX} {_spoken(label)} {v}(?: 0)? or later"))
    for parts in CC_PARTS:
        label, abbreviated, named = "cc-" + "-".join(parts), "cc " + " ".join(parts), " ".join(CC_NAMES[p] for p in parts)
        found.append(Rule(label, 40, "cc", abbreviated))
        found.append(Rule(label, 40, "commons", f"creative commons {named}"))
        for v in CC_VERSIONS:
            found.append(Rule(f"{label}-{_dotted(v)}", 45, "cc", f"{abbreviated} {v}"))
            found.append(Rule(f"{label}-{_dotted(v)}", 55, "spdx", f"{SPDX} {abbreviated} {v}"))
            found.append(Rule(f"{label}-{_dotted(v)}", 45, "commons", f"creative commons {named} {v}"))
            found.append(Rule(f"{label}-{_dotted(v)}", 45, "commons", f"creative commons {named} (?:international|unported|generic|version) (?:licen[cs]e )?{v}"))
    return sorted(found, key=lambda r: -r.priority)


@cache
def compiled() -> tuple[dict[str, list[tuple[Rule, re.Pattern]]], list[tuple[str, re.Pattern]]]:
    by_keyword: dict[str, list[tuple[Rule, re.Pattern]]] = {}
    for rule in rules():
        by_keyword.setdefault(rule.keyword, []).append((rule, re.compile(f"(?<= )(?:{rule.pattern})(?= )")))
    return by_keyword, [(label, re.compile(f"(?= {phrase} )")) for phrase, label in BASE.items()]


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and characters beyond ASCII."""
    return text.translate(NONWORD).split() if text else []


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drop detections inside another of at least their priority; the first of equal spans stays.

    Of the kept ones those that no other one holds are swept in order: their starts and
    their ends both rise, so one look-up tells whether a detection lies inside any.
    """
    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    ends: list[int] = []
    for start, end, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, rule))
        first = bisect_left(starts, start)
        last = bisect_right(ends, end)
        starts[first:last], ends[first:last] = [start], [end]
    return sorted(kept, key=lambda d: d[:2])


def detect(text: bytes | None) -> dict:
    """All detections of one text: words, base places, and resolved (first word, last word, rule)."""
    words = words_of(text)
    by_keyword, base = compiled()
    have = _keywords().intersection(words)
    result = {"n_words": len(words), "base": [], "detections": []}
    if not have:
        return result
    line = " " + b" ".join(words).decode() + " "
    at = {0: 0}
    for i, m in enumerate(re.finditer(" ", line)):
        at[m.start()] = i
    result["base"] = sorted((at[m.start()], label) for label, pattern in base for m in pattern.finditer(line))
    found = [
        (at[m.start() - 1], at[m.end()], rule)
        for key in sorted(have)
        for rule, pattern in by_keyword.get(key.decode(), ())
        for m in pattern.finditer(line)
    ]
    result["detections"] = resolve(found)
    return result


@cache
def _keywords() -> frozenset[bytes]:
    """The prefilter: each rule's keyword, and the rarest word of each base phrase."""
    return frozenset(k.encode() for k in (*compiled()[0], "mit", "apache", "cc"))


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Detections in each row's whole text.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (smallest and largest start of these, from 0; null without any),
    base_labels, labels (those of surviving rules too; both distinct, sorted,
    comma-joined, empty if none), score (1 for a base phrase or a rule of
    priority 60 or more, in proportion below), detections (spans: first word,
    end, label, priority). A null text counts as empty. Null and repeated ids
    keep a row each; other columns are ignored; an empty table gives an empty
    result.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32())]))
        for batch in batches:
            n, k, first, last, base, labels, score, found = ([] for _ in range(8))
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                d = detect(text)
                starts = [s for s, _ in d["base"]]
                own = {label for _, label in d["base"]}
                n.append(d["n_words"])
                k.append(len(starts))
                first.append(min(starts, default=None))
                last.append(max(starts, default=None))
                base.append(",".join(sorted(own)))
                labels.append(",".join(sorted(own | {r.label for _, _, r in d["detections"]})))
                score.append(max([1.0 if own else 0.0, *(min(1.0, r.priority / CERTAIN) for _, _, r in d["detections"])]))
                found.append([{"start": s, "end": e, "label": r.label, "priority": r.priority} for s, e, r in d["detections"]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in (n, k, first, last)), *(pa.array(c, pa.string()) for c in (base, labels)), pa.array(score, pa.float64()), pa.array(found, spans)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(scanned, f"doc_id {kind}, {SCHEMA}, detections array<struct<start:long,end:long,label:string,priority:int>>")
