"""License scans against plain loops, and the order and suppression of the rules."""

from __future__ import annotations

import re

import duckdb
import pytest

from loomgraph.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string"
TEXTS = [
    None, "", " \t\n", "--- ***", "MIT License", "mit\nlicense, MIT-LICENSE; mit  license", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.",
    "the apache license and the gnu general\n * public license", "emit licenses commit license permit licenseX", "日本語 mit license été İstanbul MIT LİCENSE", "cc by cc by cc by",
    "mit " * 3000 + "license " + "x" * 3_000_000 + " cc by", "GPLv3 LGPL-2.1 http://www.apache.org/licenses/LICENSE-2.0", "word " * 400_000 + "SPDX-License-Identifier: BSD-3-Clause",
]


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base_places(words):
    phrases = [(p.split(), label) for p, label in L.BASE.items()]
    return [(label, i) for p, label in phrases for i in range(len(words)) if words[i : i + len(p)] == p]


def every_detection(words):
    """Each rule on the whole text, without the words that lead to it."""
    spaced = "".join(f" {w} " for w in words)
    for i, r in enumerate(L.rules()):
        for m in re.finditer(r.pattern, spaced):
            a = spaced[: m.start()].count(" ") // 2
            yield r, a, a + m[0].count(" ") // 2, i


def kept_of(found):
    order, kept = list(L.KINDS), []
    for r, a, b, _ in sorted(found, key=lambda x: (order.index(x[0].kind), x[1] - x[2], x[1], x[3])):
        contained = any(s <= a and b <= e for _, s, e in kept)
        beaten = any(max(a, s) < min(b, e) and k.kind != r.kind for k, s, e in kept)
        if not contained and not beaten:
            kept.append((r, a, b))
    return sorted((r.name, a, b) for r, a, b in kept)


def test_rows_equal_plain_loops(spark):
    df = spark.createDataFrame([(None if i == 4 else i, t, "x") for i, t in enumerate(TEXTS)] + [(6, TEXTS[6], "x")], SCHEMA + ", found string")
    rows = L.scan(df).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[4 if r["doc_id"] is None else r["doc_id"]]
        words = plain_words(text)
        assert r["n_words"] == len(words)
        assert sorted((x["label"], x["place"]) for x in r["base"]) == sorted(base_places(words))
        for x in r["found"]:
            assert plain_words(text[x["char_start"] : x["char_stop"]]) == words[x["start"] : x["stop"]]
            assert text[x["char_start"] - 1 : x["char_start"]] == "" or not WORD.match(text[x["char_start"] - 1 : x["char_start"]].lower())
        if len(words) < 1000:
            assert sorted((x["rule"], x["start"], x["stop"]) for x in r["found"]) == kept_of(every_detection(words))


@pytest.mark.parametrize(
    "text,labels",
    [
        ("Licensed under the Apache License, Version 2.0 (the License)", {"apache-2.0"}),
        ("GNU Lesser General Public License v2.1", {"lgpl-2.1"}),
        ("available under the terms of the GNU General Public License version 2", {"gpl-2.0"}),
        ("# SPDX-License-Identifier: GPL-3.0-or-later", {"gpl-3.0"}),
        ("https://creativecommons.org/licenses/by-nc-sa/4.0/", {"cc-by-nc-sa-4.0"}),
        ("Creative Commons Attribution-ShareAlike 3.0 Unported", {"cc-by-sa-3.0"}),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software)", {"mit"}),
        ("Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met", {"bsd"}),
        ("under the 3-clause BSD license", {"bsd-3-clause"}),
        ("Released under MIT or licensed under the Mozilla Public License 2.0", {"mit", "mpl-2.0"}),
        ("GPLv2 and LGPL-3.0", {"gpl-2.0", "lgpl-3.0"}),
        ("the committee met with the general public about open software", set()),
        ("er kam mit Lizenz und ging by bus", set()),
    ],
)
def test_labels(text, labels):
    assert {r.label for r, _, _ in L._scanner().scan(text.encode())[2]} == labels


def test_rules_are_ordered_and_gated():
    rules = L.rules()
    assert len(rules) > 300 and len({r.name for r in rules}) == len(rules)
    kinds = [list(L.KINDS).index(r.kind) for r in rules]
    assert kinds == sorted(kinds)
    assert all(words for r in rules for words in r.needs)


def test_many_detections_stay_linear():
    n, base, found, _ = L._scanner().scan(b"MIT License; " * 20_000)
    assert n == 40_000 and len(base) == len(found) == 20_000


def test_empty_table(spark):
    assert L.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = con.sql(L.op11_sql())
    got = L.op11_ordered_license_rules(spark, small)
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(want.fetchall())
