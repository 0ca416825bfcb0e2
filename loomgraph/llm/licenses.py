"""License scans: ordered signature rules over the words of a text.

A text is lower-cased (A-Z) and cut into words, runs of ASCII letters and digits and of any
characters beyond ASCII; punctuation, comment marks and line ends between words don't matter. A
rule is a regular expression over words, written with single blanks between them, together with
the words that any of its matches must hold. Only rules whose words all occur in a text are
tried on it. The rules are ordered: first by kind (``KINDS``), then as listed.

Detections of one text are gone through by kind, then longer ones first, then by place and rule.
A detection is dropped if a kept one contains it, or if it overlaps a kept one of an earlier
kind; the others are kept. So "Licensed under the Apache License, Version 2.0" is one grant of
apache-2.0, and the title and the name inside it are not told again.

The rules are the cross of hand-written license titles, names, versions and contexts, with some
sentences of license texts. Places of the base phrases are found by rules too, which nothing
suppresses.

Defined cases: a null or empty text has no words and no detection; repeated rows are scanned
each; a null doc_id stays; extra columns are ignored; an empty table gives an empty result. A
very long text is split into words a slice at a time, and only if it holds the words of a rule is
it put together again, twice its size at most.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of rules, the strongest first, with the confidence of a detection.
KINDS = {"text": 1.0, "tag": 1.0, "grant": 0.95, "address": 0.9, "title": 0.9, "name": 0.7, "bare": 0.6}

# Phrases whose places are counted, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Licenses: label, pattern of the title, words that each title holds ("|" between alternatives), pattern of the short
#: name, words of that, versions.
LICENSES = [
    ("gpl", "gnu general public licen[cs]e", "gnu general", "(?:gnu )?gpl", "gpl", "1 2 3"),
    ("lgpl", "gnu (?:lesser|library) general public licen[cs]e", "gnu general", "(?:gnu )?lgpl", "lgpl", "2 2.1 3"),
    ("agpl", "(?:gnu )?affero general public licen[cs]e", "affero general", "(?:gnu )?agpl", "agpl", "1 3"),
    ("gfdl", "gnu free documentation licen[cs]e", "gnu documentation", "(?:gnu )?g?fdl", "gfdl|fdl", "1.1 1.2 1.3"),
    ("apache", "apache (?:software )?licen[cs]e", "apache", "(?:apache|asl)", "apache|asl", "1.0 1.1 2.0"),
    ("mpl", "mozilla public licen[cs]e", "mozilla", "mpl", "mpl", "1.0 1.1 2.0"),
    ("epl", "eclipse public licen[cs]e", "eclipse", "epl", "epl", "1.0 2.0"),
    ("edl", "eclipse distribution licen[cs]e", "eclipse", "edl", "edl", "1.0"),
    ("cddl", "common development and distribution licen[cs]e", "common development distribution", "cddl", "cddl", "1.0 1.1"),
    ("cpl", "common public licen[cs]e", "common public", "cpl", "cpl", "1.0"),
    ("ipl", "ibm public licen[cs]e", "ibm public", "ipl", "ipl", "1.0"),
    ("eupl", "european union public licen[cs]e", "european union", "eupl", "eupl", "1.0 1.1 1.2"),
    ("cecill", "cecill(?: free software)? licen[cs]e(?: agreement)?", "cecill", "cecill", "cecill", "1.0 2.0 2.1"),
    ("artistic", "(?:perl )?artistic licen[cs]e", "artistic", "artistic", "artistic", "1.0 2.0"),
    ("osl", "open software licen[cs]e", "open software", "osl", "osl", "1.0 2.0 2.1 3.0"),
    ("afl", "academic free licen[cs]e", "academic free", "afl", "afl", "1.1 1.2 2.0 2.1 3.0"),
    ("bsl", "boost software licen[cs]e", "boost software", "bsl", "bsl", "1.0"),
    ("ofl", "(?:sil )?open font licen[cs]e", "open font", "ofl", "ofl", "1.0 1.1"),
    ("zpl", "zope public licen[cs]e", "zope", "zpl", "zpl", "1.1 2.0 2.1"),
    ("lppl", "latex project public licen[cs]e", "latex project", "lppl", "lppl", "1.0 1.1 1.2 1.3"),
    ("odbl", "open (?:data commons open )?database licen[cs]e", "open database", "odbl", "odbl", "1.0"),
    ("pddl", "public domain dedication and licen[cs]e", "domain dedication", "pddl", "pddl", "1.0"),
    ("psf", "python software foundation licen[cs]e", "python foundation", "psfl?", "psf|psfl", "2.0"),
    ("php", "php licen[cs]e", "php", "php licen[cs]e", "php", "3.0 3.01"),
    ("upl", "universal permissive licen[cs]e", "universal permissive", "upl", "upl", "1.0"),
    ("sspl", "server side public licen[cs]e", "server side", "sspl", "sspl", "1"),
    ("busl", "business source licen[cs]e", "business source", "busl", "busl", "1.1"),
    ("elastic", "elastic licen[cs]e", "elastic", "elastic licen[cs]e", "elastic", "1.0 2.0"),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", "fuck public", "wtfpl", "wtfpl", "1 2"),
    ("mulanpsl", "mulan permissive software licen[cs]e", "mulan", "mulan ?psl", "mulan|mulanpsl", "1.0 2.0"),
    ("cern-ohl", "cern open hardware licen[cs]e", "cern hardware", "cern ohl", "cern ohl", "1.1 1.2 2.0"),
    ("apsl", "apple public source licen[cs]e", "apple source", "apsl", "apsl", "1.0 1.1 1.2 2.0"),
    ("ms-pl", "microsoft public licen[cs]e", "microsoft public", "ms pl", "ms pl", ""),
    ("ms-rl", "microsoft reciprocal licen[cs]e", "microsoft reciprocal", "ms rl", "ms rl", ""),
    ("mit", "(?:mit|expat|x11) licen[cs]e", "mit|expat|x11", "mit", "mit", ""),
    ("bsd-2-clause", "(?:simplified|freebsd|2 clause|two clause) bsd licen[cs]e", "bsd", "bsd (?:2|two) clause", "bsd clause", ""),
    ("bsd-3-clause", "(?:new|modified|revised|3 clause|three clause) bsd licen[cs]e", "bsd", "bsd (?:3|three) clause", "bsd clause", ""),
    ("bsd-4-clause", "(?:original|4 clause|four clause) bsd licen[cs]e", "bsd", "bsd (?:4|four) clause", "bsd clause", ""),
    ("bsd", "bsd licen[cs]e", "bsd", "bsd(?: style)?", "bsd", ""),
    ("0bsd", "zero clause bsd licen[cs]e", "zero bsd", "0bsd", "0bsd", ""),
    ("isc", "(?:isc|internet systems consortium) licen[cs]e", "isc|systems consortium", "isc", "isc", ""),
    ("zlib", "zlib(?: libpng)? licen[cs]e", "zlib", "zlib", "zlib", ""),
    ("unlicense", "the unlicense", "unlicense", "unlicense", "unlicense", ""),
    ("ncsa", "(?:university of illinois )?ncsa open source licen[cs]e", "ncsa", "ncsa", "ncsa", ""),
    ("openssl", "openssl licen[cs]e", "openssl", "openssl", "openssl", ""),
    ("postgresql", "postgresql licen[cs]e", "postgresql", "postgresql", "postgresql", ""),
    ("ruby", "ruby licen[cs]e", "ruby", "ruby", "ruby", ""),
    ("vim", "vim licen[cs]e", "vim", "vim", "vim", ""),
    ("w3c", "w3c (?:software (?:notice and )?)?licen[cs]e", "w3c", "w3c", "w3c", ""),
    ("unicode", "unicode (?:terms of use|licen[cs]e(?: agreement)?)", "unicode", "unicode licen[cs]e", "unicode", ""),
    ("beerware", "beer ?ware licen[cs]e", "beerware|beer ware", "beer ?ware", "beerware|beer ware", ""),
]

#: Parts of the Creative Commons licenses after "by", and the versions of each.
COMMONS = {"": "", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial", "nc-sa": "non ?commercial share ?alike", "nc-nd": "non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

#: Sentences of license texts: label, pattern, words that each match holds.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "hereby granted documentation"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "copyright substantial"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that", "hereby granted fee"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "redistributions retain"),
    ("bsd-3-clause", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products", "neither endorse"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising display"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless applicable writing"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "except compliance"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "redistribute gnu"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "redistribute gnu library"),
    ("agpl", "redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", "redistribute affero"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[cs]e", "mozilla subject"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "express implied liable"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("cc0-1.0", "to the extent possible under law (?:[^ ]+ ){1,12}waived all copyright and related or neighbou?ring rights", "extent waived"),
    ("public-domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain"),
    ("wtfpl", "you just do what the fuck you want to", "fuck"),
    ("beerware", "if we meet some day and you think this stuff is worth it you can buy me a beer in return", "beer stuff"),
    ("openssl", "this product includes software developed by the openssl project", "openssl"),
    ("proprietary", "all rights reserved (?:[^ ]+ ){0,8}confidential", "reserved confidential"),
]

#: Places of license texts: label, pattern, words that each match holds.
ADDRESSES = [
    ("apache-2.0", "apache org licen[cs]es licen[cs]e 2 0", "apache org"),
    ("mpl-2.0", "mozilla org (?:en us )?mpl 2 0", "mozilla org"),
    ("mpl-1.1", "mozilla org (?:en us )?mpl 1 1", "mozilla org"),
    ("epl-1.0", "eclipse org legal epl v10", "eclipse legal"),
    ("epl-2.0", "eclipse org legal epl (?:2 0|v20)", "eclipse legal"),
    ("bsl-1.0", "boost org licen[cs]e 1 0", "boost org"),
    ("ofl-1.1", "scripts sil org ofl", "sil ofl"),
    ("unlicense", "unlicense org", "unlicense org"),
    ("wtfpl-2.0", "(?:www )?wtfpl net", "wtfpl net"),
    ("cc0-1.0", "creativecommons org publicdomain zero 1 0", "creativecommons publicdomain"),
    ("public-domain", "creativecommons org publicdomain mark 1 0", "creativecommons publicdomain"),
]

#: What stands before a license that is granted, and what may stand between its name and a version.
GRANT = "(?:licen[cs]ed|released|distributed|redistributed|available|published|provided|covered) under(?: the)?(?: terms of(?: the)?| terms and conditions of(?: the)?)?"
BETWEEN = "(?: version| ver| v| release)?"


class Rule(NamedTuple):
    name: str
    label: str
    kind: str
    pattern: str  #: over words with a blank on each side of each
    needs: list[frozenset[bytes]]  #: a match holds all words of one of these


def _numbers(version: str) -> str:
    """Pattern of a version's words; of a whole one with or without its zero."""
    major, _, minor = version.partition(".")
    return major + (f" {minor}" if minor.strip("0") else "(?: 0)?")


def _rule(name: str, label: str, kind: str, pattern: str, needs: str) -> Rule:
    """A rule of a pattern with single blanks: " ?" is a blank that may lack."""
    spaced = f" {pattern} ".replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")[1:-1]
    return Rule(f"{name}/{kind}", label, kind, spaced, [frozenset(x.encode().split()) for x in needs.split("|")])


def _with(needs: str, more: str) -> str:
    return "|".join(f"{x} {more}" for x in needs.split("|"))


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """All rules in their order."""
    found = [_rule(f"{label}:{i}", label, "text", pattern, needs) for i, (label, pattern, needs) in enumerate(SENTENCES)]
    found += [_rule(f"{label}:{i}", label, "address", pattern, needs) for i, (label, pattern, needs) in enumerate(ADDRESSES)]
    for label, title, held, short, needs, versions in LICENSES:
        words = label.replace("-", " ")
        for version in versions.split():
            major, numbers = version[0], _numbers(version)
            own = f"{label}-{version if '.' in version else version + '.0'}"
            found += [
                _rule(own, own, "tag", f"spdx licen[cs]e identifier {words} {numbers}(?: only| or later)?", f"spdx identifier {words}"),
                _rule(own, own, "grant", f"{GRANT} {title}{BETWEEN} v?{numbers}", _with(held, "under")),
                _rule(own + ":short", own, "grant", f"{GRANT} {short}{BETWEEN} v?{numbers}", _with(needs, "under")),
                _rule(own, own, "address", f"(?:opensource|spdx|gnu) org licen[cs]es?(?: old licen[cs]es)? {words} {numbers}", f"org {words}"),
                _rule(own, own, "title", f"{title}{BETWEEN} v?{numbers}", held),
                _rule(own, own, "name", f"{short}{BETWEEN} v?{numbers}", needs),
                _rule(own + ":glued", own, "name", f"{words}v?{numbers}", f"{words}v{major}|{words}{major}"),
            ]
        found += [
            _rule(label, label, "tag", f"spdx licen[cs]e identifier {words}", f"spdx identifier {words}"),
            _rule(label, label, "grant", f"{GRANT} {title}", _with(held, "under")),
            _rule(label + ":short", label, "grant", f"{GRANT} {short}", _with(needs, "under")),
            _rule(label, label, "address", f"(?:opensource|spdx) org licen[cs]es? {words}", f"org {words}"),
            _rule(label, label, "bare", title, held),
        ]
    for part, named in COMMONS.items():
        label = "cc-by" + ("-" + part if part else "")
        title, short = "creative commons attribution" + (f" {named}" if named else ""), label.replace("-", " ")
        for version in [*COMMONS_VERSIONS.split(), ""]:
            own, tail = (f"{label}-{version}", " " + version.replace(".", " ")) if version else (label, "")
            between = "(?: (?:international|generic|unported|public|licen[cs]e|version|v))*" if version else ""
            found += [
                _rule(own, own, "tag", f"spdx licen[cs]e identifier {short}{tail}", "spdx identifier cc"),
                _rule(own, own, "grant", f"{GRANT}(?: a)? {title}{between}{tail}", "creative commons attribution under"),
                _rule(own + ":short", own, "grant", f"{GRANT}(?: a)? {short}{tail}", "cc by under"),
                _rule(own, own, "address", f"creativecommons org licen[cs]es {short[3:]}{tail}", "creativecommons by"),
                _rule(own, own, "title" if version else "bare", f"{title}{between}{tail}", "creative commons attribution"),
                _rule(own + ":short", own, "name" if version else "bare", f"{short}{tail}", "cc by"),
            ]
    found += [_rule("cc0-1.0", "cc0-1.0", "tag", "spdx licen[cs]e identifier cc0 1 0", "spdx identifier cc0"), _rule("cc0-1.0", "cc0-1.0", "title", "cc0(?: 1 0)?(?: universal)?", "cc0")]
    order = {kind: i for i, kind in enumerate(KINDS)}
    return sorted(found, key=lambda r: order[r.kind])


#: Upper-case letters lowered, every other ASCII character that belongs to no word a blank.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def word_slices(plain: bytes, slice_bytes: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words, about ``slice_bytes`` at a time."""
    at = 0
    while 0 <= at < len(plain):
        end = plain.find(b" ", at + slice_bytes)
        yield plain[at : end if end >= 0 else len(plain)].split()
        at = end


def _places(found: list[tuple[int, int]], spaced: bytes) -> dict[int, int]:
    """Number of words before each end of the matches: half of the blanks there."""
    at = blanks = 0
    places = {}
    for place in sorted({x for span in found for x in span}):
        blanks += spaced.count(b" ", at, place)
        at, places[place] = place, blanks // 2
    return places


class Scanner:
    """The rules compiled, with the words that lead to them."""

    def __init__(self, ordered: list[Rule], base: dict[str, str]) -> None:
        phrases = [_rule(phrase, label, "base", phrase, phrase) for phrase, label in base.items()]
        self.rules = [*ordered, *phrases]
        self.compiled: list[re.Pattern | None] = [None] * len(self.rules)
        self.rank = {kind: i for i, kind in enumerate(KINDS)}
        self.by_word: dict[bytes, list[tuple[int, frozenset[bytes]]]] = defaultdict(list)
        often = defaultdict(int)
        for r in self.rules:
            for words in r.needs:
                for w in words:
                    often[w] += 1
        for i, r in enumerate(self.rules):
            for words in r.needs:
                self.by_word[min(words, key=lambda w: (often[w], w))].append((i, words))
        self.words = frozenset(w for r in self.rules for words in r.needs for w in words)

    def _matches(self, i: int, spaced: bytes) -> list[tuple[int, int]]:
        pattern = self.compiled[i]
        if pattern is None:
            pattern = self.compiled[i] = re.compile(self.rules[i].pattern.encode())
        return [m.span() for m in pattern.finditer(spaced)]

    def scan(self, text: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[Rule, int, int]], bytes]:
        """(number of words, (label, place) of each base phrase, (rule, start, end) of what is kept, the plain text)."""
        plain = text.translate(_PLAIN)
        n, held = 0, set()
        for words in word_slices(plain):
            n += len(words)
            held |= self.words.intersection(words)
        tried = sorted({i for w in held for i, words in self.by_word.get(w, ()) if words <= held})
        if not tried:
            return n, [], [], plain
        spaced = b"".join(b" " + b"  ".join(words) + b" " for words in word_slices(plain) if words)
        found = [(i, a, b) for i in tried for a, b in self._matches(i, spaced)]
        places = _places([(a, b) for _, a, b in found], spaced)
        spans = [(self.rules[i], places[a], places[b], i) for i, a, b in found]
        base = [(r.label, a) for r, a, _, _ in spans if r.kind == "base"]
        return n, base, self.suppressed([x for x in spans if x[0].kind != "base"]), plain

    def suppressed(self, spans: list[tuple[Rule, int, int, int]]) -> list[tuple[Rule, int, int]]:
        """What is kept of the detections, by place."""
        kept: list[tuple[Rule, int, int]] = []
        starts: list[int] = []
        longest = max((b - a for _, a, b, _ in spans), default=0)
        for r, a, b, _ in sorted(spans, key=lambda x: (self.rank[x[0].kind], x[1] - x[2], x[1], x[3])):
            near = kept[bisect_left(starts, a - longest) : bisect_left(starts, b)]
            if not any((s <= a and b <= e) or (a < e and k.kind != r.kind) for k, s, e in near):
                at = bisect_right(starts, a)
                starts.insert(at, a)
                kept.insert(at, (r, a, b))
        return kept


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner(rules(), BASE)


def _code_points(text: bytes, plain: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and end code point of runs of words, given as first and end word, by place."""
    solid = np.frombuffer(plain, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]])))
    ends = [(int(edges[2 * a]), int(edges[2 * b - 1])) for a, b in spans]
    at = points = 0
    of = {}
    for place in sorted({x for span in ends for x in span}):
        points += len(text[at:place].decode())
        at, of[place] = place, points
    return [(of[a], of[b]) for a, b in ends]


_BASE = pa.list_(pa.struct([("label", pa.string()), ("place", pa.int64())]))
_FOUND = pa.list_(pa.struct([("rule", pa.string()), ("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("char_start", pa.int64()), ("char_stop", pa.int64()), ("confidence", pa.float64())]))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base (label and first word of each base phrase), found (the kept detections) of each row.

    A detection: rule, label, kind, first word and the word after the last, first code point and
    the one after the last, confidence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                counts, bases, kept = [], [], []
                for text in batch.column("text"):
                    data = text.as_buffer().to_pybytes() if text.is_valid else b""
                    n, base, spans, plain = scanner.scan(data)
                    points = _code_points(data, plain, [x[1:] for x in spans]) if spans else []
                    counts.append(n)
                    bases.append([{"label": label, "place": place} for label, place in base])
                    kept.append([{"rule": r.name, "label": r.label, "kind": r.kind, "start": a, "stop": b, "char_start": p, "char_stop": q, "confidence": KINDS[r.kind]} for (r, a, b), (p, q) in zip(spans, points)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(bases, _BASE), pa.array(kept, _FOUND)], names=["doc_id", "n_words", "base", "found"])

    schema = "doc_id long, n_words long, base array<struct<label: string, place: long>>, found array<struct<rule: string, label: string, kind: string, start: long, stop: long, char_start: long, char_stop: long, confidence: double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op11_ordered_license_rules(spark, sf_dir: str) -> DataFrame:
    """Words, base places and labels, and the labels and confidence of the ordered rules, of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = lambda *columns: F.concat_ws(",", F.sort_array(F.array_distinct(F.concat(*[F.col(f"{c}.label") for c in columns]))))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.place").alias("first_word"), F.array_max("base.place").alias("last_word"),
        labels("base").alias("base_labels"), labels("base", "found").alias("labels"), F.coalesce(F.array_max("found.confidence"), F.lit(0.0)).alias("score"),
    )


def op11_sql() -> str:
    """The same rules and their suppression in SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rank = {kind: i for i, kind in enumerate(KINDS)} | {"base": -1}
    every = [*rules(), *(_rule(phrase, label, "base", phrase, phrase) for phrase, label in BASE.items())]
    scanner = Scanner(rules(), BASE)
    values = ",\n".join(
        f"({i}, {quoted(r.label)}, {rank[r.kind]}, {KINDS.get(r.kind, 0.0)}, {quoted(r.pattern)}, {quoted(word.decode())}, [{', '.join(quoted(w.decode()) for w in sorted(words))}])"
        for word, led in scanner.by_word.items()
        for i, words in led
        for r in [every[i]]
    )
    blanks = lambda x: f"(length({x}) - length(replace({x}, ' ', ''))) // 2"
    return rf"""
WITH rules(ord, label, rank, conf, pattern, word, needs) AS (VALUES
{values}),
w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
t AS (SELECT k, list_distinct(words) AS held, ' ' || array_to_string(words, '  ') || ' ' AS spaced FROM w),
led AS (SELECT DISTINCT k, ord FROM (SELECT k, held, unnest(held) AS word FROM t) JOIN rules USING (word) WHERE list_has_all(held, needs)),
tried AS (SELECT k, ord, label, rank, conf, pattern, spaced FROM led JOIN (SELECT DISTINCT ord, label, rank, conf, pattern FROM rules) USING (ord) JOIN t USING (k)),
cut AS (SELECT *, string_split_regex(spaced, pattern) AS gaps, regexp_extract_all(spaced, pattern) AS whole FROM tried),
sized AS (SELECT k, ord, label, rank, conf, list_transform(gaps, lambda x: {blanks('x')}) AS g, list_transform(whole, lambda x: {blanks('x')}) AS m, unnest(range(1, len(whole) + 1)) AS i FROM cut WHERE len(whole) > 0),
spans AS (SELECT k, ord, label, rank, conf, CAST(list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0) AS BIGINT) AS a, CAST(list_sum(g[1:i]) + list_sum(m[1:i]) AS BIGINT) AS b FROM sized),
ranked AS (SELECT k, list([{{'label': label, 'rank': rank, 'conf': conf, 'a': a, 'b': b}}] ORDER BY rank, a - b, a, ord) AS all_of FROM spans WHERE rank >= 0 GROUP BY k),
kept AS (SELECT k, list_reduce(all_of, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: (y.a <= x[1].a AND x[1].b <= y.b) OR (y.a < x[1].b AND x[1].a < y.b AND y.rank <> x[1].rank))) > 0 THEN acc ELSE list_concat(acc, x) END) AS found FROM ranked),
base AS (SELECT k, count(*) AS n, min(a) AS first_word, max(a) AS last_word, list(label) AS labels FROM spans WHERE rank < 0 GROUP BY k)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(list_distinct(labels)), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), list_transform(coalesce(found, []), lambda y: y.label)))), ',') AS labels,
  coalesce(list_max(list_transform(found, lambda y: y.conf)), 0.0)::DOUBLE AS score
FROM w LEFT JOIN base USING (k) LEFT JOIN kept USING (k)
"""
