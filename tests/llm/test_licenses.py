"""Licence scan against a plain search for the words."""

import re

import pytest

from tidelog.llm import licenses

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = [(i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def results(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "'x' AS words", "2 AS pos")
    return licenses.digest(licenses.scan(df, **more)).collect()


def test_base_phrases_on_the_table_and_odd_texts(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(3000, None), (3001, ""), (3002, "..."), (3003, "CC BY"), (3003, "CC BY"), (None, "cc-by cc  by; CC\nBY all rights RESERVED"),
             (3004, "all rights all rights reserved reserved"), (3005, "ÀLL rights reserved É cc byé cc by"), (3006, "the cc by of " * 4000),
             (3007, "Kcc by general public  license general public license version"), (3008, "cc"), (3009, "by cc by cc by")]
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in results(spark, rows)), key=repr)
    assert got == sorted(((d, *plain(t)) for d, t in rows), key=repr)


@pytest.mark.parametrize("text, labels, base", [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0", ""),
    ("x y Released under the MIT License. z", "mit", ""),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0", "cc-by"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0", "gpl"),
    ("Permission is hereby granted, free of charge, to any lucky person obtaining a copy of this software", "mit", ""),
    ("Permission is hereby granted", "", ""),
    ("a free text about a license and the public", "", "")])
def test_labels(spark, text, labels, base):
    row = results(spark, [(1, text)])[0]
    assert (row.labels, row.base_labels) == (labels, base)
    assert 0 <= row.score <= 1 and (row.score >= 0.8) == bool(labels)


def test_spans_of_a_changed_notice(spark):
    text = "w " * 7 + "redistribution and use in source and also binary forms with or without modification are permitted " + "z " * 5
    spans = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), coverage=0.7).first().spans
    assert [(s.label, s.start, s.end) for s in spans] == [("bsd", 7, 22)]


def test_empty_table_and_plan(spark):
    empty = licenses.scan(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    plan = empty._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def changed(words):
    """Every way to put a word between, leave an inner one out, or replace an inner one."""
    for i in range(1, len(words) - 1):
        yield words[:i] + words[i + 1:]
        yield words[:i] + ["zzz"] + words[i + 1:]
    for i in range(1, len(words)):
        yield words[:i] + ["zzz"] + words[i:]


def test_notices_with_one_word_changed_keep_their_label(spark):
    """From five words on; shorter ones would fall below 0.8. Some changes make another notice: those are its own."""
    rows, wanted, whole = [], {}, {text for text, _ in licenses.NOTICES}
    for text, label in licenses.NOTICES:
        words = text.split()
        for variant in [words, *(v for v in (changed(words) if len(words) >= 5 else []) if " ".join(v) not in whole)]:
            wanted[len(rows)] = label
            rows.append((len(rows), "some words before " + " ".join(variant) + " and some after"))
    missing = [(rows[r.doc_id][1], r.labels) for r in results(spark, rows) if wanted[r.doc_id] not in r.labels.split(",")]
    assert missing == []


def test_the_better_of_two_notices_stays(spark):
    rows = [(0, "licensed under cc by nc 4 0"), (1, "gnu lesser general public license"), (2, "public license and the terms of a domain under the software")]
    assert [r.labels for r in sorted(results(spark, rows), key=lambda r: r.doc_id)] == ["cc-by,cc-by-nc-4.0", "gpl,lgpl", ""]
