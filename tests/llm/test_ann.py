"""Tree search against comparing with every row."""

import numpy as np

from tidelog.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, wanted, k):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None}
    out = {}
    for q in wanted:
        scored = sorted((-float((good[q] * v).sum()), i) for i, v in good.items() if i != q)[:k]
        out[q] = [(i, -s) for s, i in scored]
    return out


def found(df, **more):
    got = {}
    for r in sorted(ann.search(df, lambda c: c % 20 == 0, **more).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


def recall(got, want):
    assert set(got) == set(want)
    assert all(len(got[q]) == len(want[q]) for q in want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    return hits / sum(map(len, want.values()))


def test_recall_on_the_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 20)
    got = found(df, leaf_rows=8, block=16)
    assert recall(got, want) >= 0.9
    for q, best in got.items():
        assert [s for _, s in best] == sorted((s for _, s in best), reverse=True)
    assert found(df, leaf_rows=8, recall=1.0).keys() == want.keys()


def test_vectors_of_any_length_and_one_hot_vector(spark):
    random = np.random.default_rng(3)
    rows = [(i, (random.normal(size=6) * random.uniform(0.1, 9)).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]  # ties go to the smaller id
    want = brute(rows, [i for i, _ in rows if i % 20 == 0], 5)
    got = found(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), k=5, leaf_rows=8, block=16, recall=1.0, calibration_rows=420)
    assert recall(got, want) >= 0.99
    assert [i for i, _ in got[1000]][:5] == [i for i, _ in want[1000]]
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]) if a[0] == b[0])


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (20, [0.25, 0.0]), (20, [0.25, 0.0]), (40, None)]
    got = found(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA))
    assert got == {0: [(1, 0.5), (20, 0.25)], 20: [(0, 0.25), (1, 0.125)]}


def test_empty_table(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == {}


def test_the_share_found_without_being_asked_for_another(spark):
    """All rows are calibration queries, so the share that the search aims at is what it finds."""
    random = np.random.default_rng(8)
    rows = [(i, random.normal(size=12).tolist()) for i in range(500)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {}
    for r in ann.search(df, lambda c: c >= 0, k=10, leaf_rows=4, calibration_rows=500).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    share = recall(got, brute(rows, range(500), 10))
    assert 0.97 <= share < 1
