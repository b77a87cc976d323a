"""Quality classifier: accuracy on rows it did not learn from, and odd rows."""

import zlib

import numpy as np
import pytest

from tidelog.llm import quality
from tidelog.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return {r.doc_id: r for r in QUERIES["op8_quality"](spark, SMALL).collect()}


def test_held_out_accuracy(spark, scored):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    unseen = [d for d in labels if scored[d].held_out]
    assert unseen == [d for d in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    right = np.mean([scored[d].predicted == labels[d] for d in unseen])
    assert len(unseen) > 50 and right > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored.values())


def test_context_vectors_follow_a_plain_sum(spark):
    texts = ["a b c", "c a", "", "b"]
    got = quality.context_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2))
    index, marks, sums = quality.index_vectors(), quality.Marks(), np.zeros((quality.BUCKETS, quality.DIMS))
    for text in texts:
        found = marks.of([text.split()], len(text.split()))
        for i in range(len(found)):
            for j in (i - 1, i + 1):
                if 0 <= j < len(found):
                    for mark in found[i]:
                        sums[mark] += index[found[j][0]] + index[found[j][1]]
    norm = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    assert np.allclose(got, sums / np.maximum(norm, 1e-9), atol=1e-6)


def test_odd_rows_and_no_labels(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "x " * 30_000), (4, "x " * 30_000), (5, "é\u0000 ☃ !!")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS score", "'q' AS quality", "1 AS __id")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(docs, none)
    assert {(r.doc_id, r.score, r.predicted) for r in quality.score(docs, model).collect()} == {(d, 0.5, 1) for d in (1, 2, 3, 4, 5, None)}
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (5, 1, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, quality.train(docs, labels), keep=("quality",)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.quality == "q" for r in got)
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), none)).count() == 0


def test_size_of_the_vectors_and_of_what_the_network_sees():
    index = quality.index_vectors()
    assert index.shape[1] == 32 and ((index != 0).sum(axis=1) == 6).all()
    assert quality.features(["a b"], np.hstack([index, index]), quality.Marks()).shape == (1, 130)


def test_words_that_are_seen_once_share_their_shapes():
    """Marks are those of core and shape spelled out, for signs, cases and digits of any script; a shape is hashed once."""
    def spelled(word):
        core = word
        while core and not core[-1].isalnum():
            core = core[:-1]
        while core and not core[0].isalnum():
            core = core[1:]
        at = word.find(core) if core else 0
        case = ("digits" if core.isdigit() else "upper" if len(core) > 1 and core.isupper() else "title" if core[:1].isupper()
                else "lower" if core.islower() else "mixed" if core else "none")
        shape = f"{case} {min(len(core), 24) // 4} {word[:at][-4:]} {word[at + len(core):][:4]}"
        return [zlib.crc32(x.encode("utf-8", "replace")) % quality.BUCKETS for x in (core.lower(), shape)]

    words = ["ǅabc", "\xdf", "İx", "٣٤", "a\ud800b", "...", "(A)", "'Tis,", "X1", "x1!!!!!!", "....abc....", "Ⅷ", "x" * 40, "A", "AB.", "()", "-1", "1a", "1A"]
    marks = quality.Marks()
    assert marks.of([words], len(words)).tolist() == [spelled(w) for w in words]
    before = len(marks.shapes)
    assert marks.of([[f"abc{i:04}," for i in range(500)]], 500)[:, 1].tolist() == [spelled("abc0000,")[1]] * 500
    assert len(marks.shapes) == before + 1
