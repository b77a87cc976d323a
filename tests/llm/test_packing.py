"""Packing: every id once, sequences without gaps, no padding; the plan against plain checks."""

import zlib

import numpy as np
import pytest

import public_tokenizers
from tidelog.llm import packing
from tidelog.llm.tokens import Encoder

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("histogram, window", [
    ({}, 16), ({5: 1}, 16), ({8: 5}, 16), ({15: 1000}, 16), ({1: 3, 15: 3, 6: 9, 5: 8}, 16),
    ({int(r): int(n) for r, n in zip(range(1, 64), np.random.default_rng(1).integers(0, 50, 63))}, 64),
    ({int(r): int(n) for r, n in zip(range(1, 1024), np.random.default_rng(2).poisson(3, 1023))}, 1024)])
def test_every_rest_has_its_own_place(histogram, window):
    counts = np.zeros(window, np.int64)
    for length, rows in histogram.items():
        counts[length] = rows
    plan = packing.plan(counts, window)
    cuts, places = plan.tail_cuts(), {}
    for length, rows in histogram.items():
        for rank in range(rows):
            pieces = packing.place_rest(plan, cuts, length, rank)
            assert sum(p[1] for p in pieces) == length and [p[0] for p in pieces] == np.cumsum([0] + [p[1] for p in pieces])[:-1].tolist()
            for _, some, sequence, offset in pieces:
                places.setdefault(sequence, []).append((offset, some))
    assert sorted(places) == list(range(plan.sequences()))
    for pieces in places.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]]
        assert ends[-1] == window or ends[-1].bit_count() == 1
    if histogram and window == 1024:
        assert plan.laid < 0.4 * (counts * np.arange(window)).sum()  # combinations take most


def check(spark, rows, window):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "'x' AS ids").repartition(3)
    got = packing.pack(df, FILE, window=window).collect()
    encode = Encoder(FILE).encode
    expected = sorted(((d, np.append(encode(t), 0).astype("<u4").tobytes()) for d, t in rows), key=repr)
    if len({d for d, _ in rows}) == len(rows):
        texts = {}
        for r in sorted(got, key=lambda r: r.start):
            assert r.start == len(texts.get(r.doc_id, b"")) // 4 and r.length == len(r.ids) // 4
            texts[r.doc_id] = texts.get(r.doc_id, b"") + bytes(r.ids)
        assert sorted(texts.items(), key=repr) == expected
        assert {r.doc_id: r.doc_tokens for r in got} == {d: len(x) // 4 for d, x in expected}
    assert sum(r.length for r in got) == sum(len(x) // 4 for _, x in expected)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]]
        assert ends[-1] == window or ends[-1].bit_count() == 1
    return got


@pytest.mark.parametrize("window", [32, 1024])
def test_documents(spark, sf_dir, window):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(5000, None), (5001, ""), (5002, "one two " * 5000), (None, "no id")] + [(6000 + i, "the same text") for i in range(300)]
    check(spark, rows, window)


def test_repeated_rows_and_empty_table(spark):
    check(spark, [(1, "a b c")] * 50 + [(None, None)] * 20, 16)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def test_query_digest(spark, sf_dir):
    from tidelog.llm.queries import QUERIES

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    encode = Encoder(FILE).encode
    for r in QUERIES["op9_packing"](spark, sf_dir).collect():
        ids = np.append(encode(docs[r.doc_id]), 0).astype("<u4")[r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(ids.tobytes())
