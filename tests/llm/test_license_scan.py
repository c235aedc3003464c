"""Licence scans against a search for each phrase at each place."""

import random
import re

import pytest

from gleaner.llm import license_scan as scan
from gleaner.llm import queries

from .shared import ODD, documents, frame, lower

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def places(text, phrases):
    words = WORD.findall(lower(text or ""))
    out = []
    for phrase, label in phrases.items():
        p = phrase.split()
        out += [(k, label) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    return len(words), sorted(out)


def joined(labels):
    return ",".join(sorted(set(labels)))


def base_row(i, text):
    n, found = places(text, scan.BASE)
    starts = [k for k, _ in found]
    return (i, n, len(found), min(starts, default=None), max(starts, default=None), joined(x for _, x in found))


def test_query(spark, sf_dir):
    docs = dict(documents(sf_dir))
    rows = queries.op13_license_scan(spark, sf_dir).collect()
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows]
    assert sorted(got) == sorted(base_row(i, t) for i, t in docs.items()) and sum(r.n_base for r in rows) > 10
    for r in rows:
        added = [x for _, x in places(docs[r.doc_id], scan.ADDED)[1]]
        assert not re.search("(?i)spdx|license.expression", docs[r.doc_id] or "")  # else labels hold more
        labels = joined([*filter(None, r.base_labels.split(",")), *added])
        assert r.labels == labels and r.score == max((scan.STRENGTH[x] for x in labels.split(",") if x), default=0.0)


def test_automaton_against_every_place():
    rng = random.Random(1)
    phrases = [" ".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(40)]
    automaton = scan.Automaton(phrases)
    for _ in range(50):
        words = [rng.choice("abcd") for _ in range(rng.randrange(60))]
        need = sorted((k, len(p.split()), j) for j, p in enumerate(phrases) for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
        assert automaton.find([w.encode() for w in words]) == need


def test_odd_rows(spark):
    rows = [*ODD, (20, "MIT\nLicense mit.license"), (21, "K. GNU General Public License the mıt license"), (22, "spdx-license-identifier:"), (23, "x " * 100_000 + "CC-BY-SA 4.0")]
    got = scan.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    base = lambda r: [p for p in r.places if p.base]
    shown = [(r.doc_id, r.n_words, len(base(r)), min((p.start for p in base(r)), default=None), max((p.start for p in base(r)), default=None), joined(p.label for p in base(r))) for r in got]
    assert sorted(map(str, shown)) == sorted(str(base_row(i, t)) for i, t in rows)
    assert {r.doc_id: r.labels for r in got if r.labels} == {20: ["mit"], 21: ["gpl"], 23: ["cc-by", "cc-by-sa"]}
    assert scan.scan(frame(spark, []).limit(0)).collect() == []


@pytest.mark.parametrize(
    "text, labels, strength, read",
    [
        ("MIT", "mit", 0.1, "MIT"),
        (' = "apache-2.0" */', "apache", 0.2, "apache-2.0"),
        (": MIT OR GPL-2.0-only", "gpl mit", 0.1, "MIT OR GPL-2.0-only"),
        ("MIT and GPL-3.0+ more", "gpl mit", 0.8, "MIT and GPL-3.0+"),
        ("MIT OR Apache-2.0 AND GPL-2.0", "apache gpl mit", 0.1, "MIT OR Apache-2.0 AND GPL-2.0"),
        ("(MIT OR Apache-2.0) AND GPL-2.0", "apache gpl mit", 0.8, "(MIT OR Apache-2.0) AND GPL-2.0"),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR AGPL-3.0", "agpl gpl", 0.6, "GPL-2.0-only WITH Classpath-exception-2.0 OR AGPL-3.0"),
        ("LicenseRef-own", "licenseref", 0.9, "LicenseRef-own"),
        ("MIT AND this file", "mit", 0.1, "MIT"),
        ("MIT) OR GPL-2.0", "mit", 0.1, "MIT"),
        ("((MIT OR GPL-2.0", "gpl mit", 0.1, "((MIT OR GPL-2.0"),
        ("MIT OR (", "mit", 0.1, "MIT"),
        ("MIT WITH OR GPL-2.0", "mit", 0.1, "MIT"),
        ("MIT\nOR GPL-2.0", "mit", 0.1, "MIT"),
    ],
)
def test_expressions(text, labels, strength, read):
    (found, s), begin, end = scan.evaluate(text)
    assert (sorted(found), text[begin:end]) == (labels.split(), read) and s == pytest.approx(strength)


@pytest.mark.parametrize("text", ["", "none", "(", "AND MIT", ")", "((", " \t"])
def test_no_expression(text):
    assert scan.evaluate(text) is None


def test_tags(spark):
    text = "// SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH x)\nÉ License-Expression: Apache-2.0\nspdx license identifier SPDX-License-Identifier: ISC"
    r = scan.scan(frame(spark, [(1, text)])).first()
    assert [(e.start, e.text, e.labels) for e in r.expressions] == [(0, "MIT OR (GPL-2.0-only WITH x)", ["gpl", "mit"]), (12, "Apache-2.0", ["apache"]), (20, "ISC", ["isc"])]
    assert r.labels == ["apache", "gpl", "isc", "mit"] and r.score == 0.2 and r.places == []


def test_own_phrases_and_bad_ones(spark):
    r = scan.scan(frame(spark, [(1, "My Own Licence, my own.")]), base={"my own": "reserved"}, added={"my own licence": "mit"}, tags=()).first()
    assert [(p.start, p.label, p.base) for p in r.places] == [(0, "reserved", True), (0, "mit", False), (3, "reserved", True)]
    for bad in ({"...": "mit"}, {"a": "no such label"}):
        with pytest.raises(ValueError):
            scan.scan(frame(spark), base=bad)
