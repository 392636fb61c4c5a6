import random
import re

import pytest

from skein.llm import licences as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, at, labels = WORD.findall(low), [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_places_on_whole_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in L.query(spark, sf).collect()}
    for r in docs.collect():
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == brute(r["text"])
        assert 0 <= g["score"] <= 1 and set(filter(None, g["base_labels"].split(","))) <= set(filter(None, g["labels"].split(",")))


@pytest.mark.parametrize("text", ["The MIT\n-- License. mit license", "admit license", "apache  license,APACHE LICENSE", "É general public license é", "mit license" * 2, "mit license mit license"])
def test_tricky_texts(text):
    g = L.scan(text.encode())
    assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == brute(text)


def test_expressions():
    assert L.to_postfix("a or b and c with d") == ["a", "b", "c", "d", "with", "and", "or"]
    assert L.evaluate("(mit or gpl-3.0+) and apache-2.0") == (1.0, {"mit", "gpl-3.0", "apache-2.0"})
    assert L.evaluate("gpl-2.0 and mit")[0] == 0.4 and L.evaluate("gpl-2.0 or mit")[0] == 1.0 and L.evaluate("gpl-2.0 with classpath")[0] == 0.7
    for bad in ("", "mit and", "(mit", "mit)", "and mit", "mit apache-2.0", "mit ? x", "()", "with"):
        assert L.evaluate(bad) == (0.0, {L.MALFORMED})
    g = L.scan(b"/* SPDX-License-Identifier: MIT OR GPL-2.0-only */\nint x;")
    assert g["labels"] == "gpl-2.0-only,mit" and g["score"] == 1.0 and g["n_base"] == 0
    assert L.scan(b"SPDX-License-Identifier: (MIT")["labels"] == "malformed"


@pytest.mark.parametrize(
    ("said", "labels", "score"),
    [
        ("MIT This program is free", "mit", 1.0),
        ("(MIT OR GPL-3.0) AND ISC see the notice", "gpl-3.0,isc,mit", 1.0),
        ("GPL-2.0-only WITH Classpath-exception-2.0 (c) someone", "gpl-2.0-only", 0.7),
        ("GPL-2.0 AND MIT; and more, later", "gpl-2.0,mit", 0.4),
        ("MIT, or so they say", "mit", 1.0),
        ("MIT AND", "malformed", 0.0),
        ("AND MIT", "malformed", 0.0),
        ("MIT) is what it says", "mit", 1.0),
        ("?", "malformed", 0.0),
    ],
)
def test_prose_after_an_expression(said, labels, score):
    found = L.scan(f"x\nSPDX-License-Identifier: {said}\ny".encode())
    assert (found["labels"], found["score"]) == (labels, score)


def test_all_columns_against_brute_force(spark, make):
    """Every phrase by plain search over words, labels and worth by the policy."""
    draw = random.Random(5)
    phrases = {**L.NOTICES, **L.BASE}
    rows = []
    for i in range(60):
        words = [draw.choice(["mit", "license", "general", "public", "cc", "by", "sa", "code", "x9"]) for _ in range(draw.randrange(60))]
        for phrase in draw.sample(sorted(phrases), draw.randrange(3)):
            at = draw.randrange(len(words) + 1)
            words[at:at] = phrase.upper().split()
        rows.append((i, draw.choice([" ", "\n", "-"]).join(words)))
    for r in L.scan_licences(make(rows)).collect():
        text = dict(rows)[r["doc_id"]]
        words = WORD.findall(text.lower())
        labels = {label for phrase, label in phrases.items() if any(words[k : k + len(phrase.split())] == phrase.split() for k in range(len(words)))}
        assert tuple(r)[1:6] == brute(text)
        assert r["labels"] == ",".join(sorted(labels)) and r["score"] == min((L.worth(x) for x in labels), default=0.0)


def test_odd_rows(odd, none):
    got = L.scan_licences(odd).collect()
    assert len(got) == odd.count() and all(r["score"] == 0.0 and r["labels"] == "" for r in got)
    assert {r["n_words"] for r in got if r["doc_id"] == 3} == {60_000}
    assert L.scan_licences(none).collect() == []
