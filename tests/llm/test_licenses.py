"""License rules against a plain reading of their definition."""

import re

import pytest

from eventlens.llm.license_rules import BASE, PHRASES, WEIGHTS, rules
from eventlens.llm.license_scan import AS_WORDS, Signatures, scanned, signatures, summary

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KNOWN = {
    "Licensed under CC BY-NC 4.0.": {"cc-by", "cc-by-nc-4.0"},
    "This work is licensed under the GNU General Public License, version 3.": {"gpl", "gpl-3.0"},
    "Released under the MIT License.": {"mit"},
    "Licensed under the Apache License, Version 2.0 (the License)": {"apache-2.0"},
    "SPDX-License-Identifier: GPL-2.0-or-later": {"gpl-2.0-or-later"},
    "SPDX-License-Identifier: BSD-3-Clause": {"bsd-3-clause"},
    "GNU Lesser General Public License v2.1 or later": {"gpl", "lgpl-2.1-or-later"},
    "the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version": {"gpl", "gpl-2.0-or-later"},
    "GPLv3": {"gpl-3.0"},
    "https://creativecommons.org/licenses/by-sa/3.0/": {"cc-by-sa-3.0"},
    "Creative Commons Attribution-ShareAlike 4.0 International License": {"cc-by-sa-4.0"},
    "http://www.apache.org/licenses/LICENSE-2.0": {"apache-2.0"},
    "Mozilla Public License 2.0": {"mpl-2.0"},
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software": {"mit"},
    "Redistribution and use in source and binary forms, with or without modification, are permitted": {"bsd"},
    "© 2020 X. ALL RIGHTS\nreserved!": {"reserved"},
    "We walked to the apache village with mit and creative people": set(),
}


def slow_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def slow_finds(text):
    """Every rule at every word, then the definition of what stays, find by find."""
    words = slow_words(text)
    line = " " + "".join(w + " " for w in words)
    found = []
    for i, r in enumerate(rules()):
        for m in re.finditer(f" (?:{r.pattern})(?= )", line):
            found.append((i, line[: m.start()].count(" "), line[: m.end()].count(" ")))
    return words, found


def slow_stay(found):
    tier = [r.tier for r in rules()]
    stay = []
    for f in sorted((f for f in found if tier[f[0]] != BASE), key=lambda f: (-tier[f[0]], f[1], -f[2], f[0])):
        i, a, b = f
        over = any(tier[j] > tier[i] and c < b and a < d for j, c, d in stay)
        inside = any(tier[j] == tier[i] and c <= a and b <= d for j, c, d in stay)
        if not over and not inside:
            stay.append(f)
    return sorted(stay, key=lambda f: (f[1], f[2], f[0]))


@pytest.mark.parametrize("text", KNOWN)
def test_known_notices(text):
    known = signatures()
    found = known.found(text.encode().translate(AS_WORDS).split())
    labels = {known.rules[i].label for i, _, _ in found if known.rules[i].tier == BASE} | {known.rules[i].label for i, _, _ in known.resolved(found)}
    assert labels == KNOWN[text]


def test_gates_hide_no_match_and_stay_is_as_defined():
    known = Signatures(rules())
    text = " filler ".join([*KNOWN, *list(KNOWN)[::-1]]) + " cc by cc by sa 3 0 all rights reserved all rights reserved gpl 2 1 public domain released into the public domain"
    for t in [text, text[::-1], *KNOWN, "".join(KNOWN)]:
        words, found = slow_finds(t)
        assert [w.encode() for w in words] == t.encode().translate(AS_WORDS).split()
        got = known.found([w.encode() for w in words])
        assert sorted(got) == sorted(found) == sorted(known.found([w.encode() for w in words], gated=False))
        assert known.resolved(got) == slow_stay(found)


def test_hundreds_of_rules():
    made = rules()
    assert len(made) > 500 and len({r.label for r in made}) > 150


def test_scan_of_a_table(spark, docs, documents, empty):
    extra = [(100 + k, t, "en", None, 1, *["x"] * 6) for k, t in enumerate([*KNOWN, " ".join(KNOWN), "é cc\x7fby É CC-BY", "all rights reserved " * 5000])]
    frame = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    want = []
    for doc_id, text in [r[:2] for r in documents + extra]:
        words = slow_words(text)
        base = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        _, found = slow_finds(text) if len(words) < 4000 else ([], [])
        stay = slow_stay(found)
        labels = {x for _, x in base}
        score = max([WEIGHTS[BASE]] * bool(base) + [WEIGHTS[rules()[i].tier] for i, _, _ in stay], default=0.0)
        want.append((doc_id, len(words), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {rules()[i].label for i, _, _ in stay})), score))
    assert sorted(map(tuple, summary(scanned(frame)).collect()), key=repr) == sorted(want, key=repr)
    assert summary(scanned(empty)).count() == 0


def test_spans_are_those_of_the_text(spark):
    text = "Ünï: Released  under\tthe MIT-License, and CC BY."
    row = scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    data = text.encode()
    assert [data[f["first_byte"] : f["last_byte"]].decode() for f in row["found"]] == ["Released  under\tthe MIT-License"]
    assert [data[f["first_byte"] : f["last_byte"]].decode() for f in row["base"]] == ["CC BY"]
