import random
import re

from helpers import documents

from millrace.llm import licenses as L


def test_base_places_by_brute_force():
    rng = random.Random(2)
    pieces = ["MIT", "license", "License,", "apache", "general", "public", "é", "x", "-", "under", "released", "2.0"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) + rng.choice([" ", "\n", ""]) for _ in range(rng.randint(0, 14)))
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x7f" else c for c in text))
        places = [
            (label, i) for i in range(len(words)) for phrase, label in L.PHRASES
            if words[i : i + len(phrase.split())] == phrase.split()
        ]
        n, got, _ = L.scan(text)
        assert n == len(words) == L.count_words(text) and sorted(got) == sorted(places), text


def test_rules_and_containment():
    assert sum(map(len, L.rules()[0].values())) > 350 and len(L.SIGNATURES) > 140
    _, places, found = L.scan("Released under the Apache License, Version 2.0. And CC BY-NC 4.0 too: licensed under CC BY-NC 4.0.")
    assert places == [("apache", 3)]
    assert [(x[0], x[3]) for x in found] == [("apache", 5), ("cc-by-nc", 5)]  # the weaker rules inside are suppressed


def test_each_rule_alone_in_a_document():
    plain = lambda x: re.sub(r"\(\?:([^()|]*)\|[^()]*\)", r"\1", re.sub(r"\(\?:[^()]*\)\?", "", x))
    forms = ["SPDX-License-Identifier: {}", "Released under {}", "distributed\nunder the terms of {}", "{} licence", "licence type {}"]
    for label, (name, versions, _) in L.FAMILIES.items():
        for form in forms:
            text = form.format(plain(name))
            assert label in {x[0] for x in L.scan(text)[2]}, text
        for v in versions:
            for form in ("Available, under {} version {}", "{} licence v{}"):
                text = form.format(plain(name), v)
                assert label in {x[0] for x in L.scan(text)[2]}, text
    for text, label in [
        ("Distributed under the GNU GPL version 3", "gpl"), ("Released under Apache 2.0", "apache"),
        ("distributed under the terms of the MIT licence", "mit"), ("Copyright A. All\nrights, reserved", "copyright"),
        ("Copyright 2001 " + "Some Holder, " * 20 + "All rights reserved.", "copyright"),
        ("Permission is\nhereby granted, free of charge, to any person", "mit-text"),
        ("Redistribution and\tuse in source and binary forms", "bsd-text"),
    ]:
        assert label in {x[0] for x in L.scan(text)[2]}, text


def test_each_signature_alone_in_a_document():
    for _, _, keyword, label, body in L.SIGNATURES:
        for text in re.split(r"\|(?![^(]*\))", body) if label != "copyright" else ["copyright 2001 some all rights reserved"]:
            while "(" in text:  # the first choice of each group, also of optional ones
                text = re.sub(r"\((?:\?:)?([^()|]*)(?:\|[^()]*)?\)\??", r"\1", text)
            text = re.sub(r"\.\{\d+,\d+\}\??", "some", text)
            text = re.sub(r"\[(?:0-9|1-3)\]\+?", "2", text).replace("[01]", "1").replace("[sc]", "s").replace("[bc]", "b").replace("?", "")
            assert re.search(rf"\b(?:{body})\b", text) and keyword in text, (label, keyword, text)
            found = L.scan(text.replace(" ", ",\n").upper())[2]
            assert label in {x[0] for x in found} or any(x[3] >= 2 for x in found), (label, text, found)


def test_containment_by_brute_force_and_in_bounded_time():
    import time

    rng = random.Random(7)
    for _ in range(300):
        found = [(rng.randint(1, 3), s := rng.randint(0, 20), s + rng.randint(1, 9), rng.choice("abc"), 0.5) for _ in range(rng.randint(0, 25))]
        want = [
            f for i, f in enumerate(found)
            if not any(
                g[1] <= f[1] and f[2] <= g[2] and (g[0] > f[0] or (g[0] == f[0] and ((g[1], g[2]) != (f[1], f[2]) or (g[3], j) < (f[3], i))))
                for j, g in enumerate(found) if j != i
            )
        ]
        assert sorted(L.outermost(found)) == sorted(want)
    text = "Released under the MIT license, " * 35_000  # over 1 MB
    began = time.time()
    assert len(L.scan(text)[2]) == 35_000
    assert time.time() - began < 20


def test_odd_rows(spark):
    docs = documents(spark, ["the mit license", "the mit license", "the mit license", None], [3, 3, None, None]).selectExpr("*", "1 as id", "2 as t", "3 as n")
    rows = L.digest(L.detect(docs)).collect()
    assert sorted((r.doc_id or 0, r.n_base) for r in rows) == [(0, 0), (0, 1), (3, 1), (3, 1)]


def test_query_columns(spark):
    docs = documents(spark, ["Under the MIT license.", None, "", "no such thing"])
    rows = {r.doc_id: r for r in L.digest(L.detect(docs)).collect()}
    assert rows[0].n_base == 1 and rows[0].first_word == 2 == rows[0].last_word and rows[0].base_labels == "mit"
    assert rows[1].n_words == 0 and rows[1].first_word is None and rows[1].labels == "" and rows[1].score == 0
    assert rows[3].n_words == 3
    assert L.detect(documents(spark, [])).count() == 0
