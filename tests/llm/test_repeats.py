"""Repeated strings: the merged transforms against a plain search of every string."""

import hashlib
import random

import numpy as np
import pytest

from tidelog.llm import repeats


def plain(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha) per row; rows with equal id and text are one document."""
    seen, gone = set(), {}
    for doc_id, text in sorted({(d, (t or "").encode()) for d, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        covered = np.zeros(len(text), bool)
        for at in range(len(text) - length + 1):
            string = text[at:at + length]
            if string in seen:
                covered[at:at + length] = True
            seen.add(string)
        gone[doc_id, text] = covered
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        covered = gone[doc_id, data]
        kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
        out.append((doc_id, len(data), int(covered.sum()), int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def prose(rng, n):
    return " ".join(rng.choice(["the", "and", "water", "stone", "élan", "river", "of", "quickly", "mountain"]) for _ in range(n))


def corpus(seed):
    """Copies, near copies, shared passages, texts that repeat themselves, one sign over and over, and short texts."""
    rng = random.Random(seed)
    passages = [prose(rng, rng.randint(15, 60)) for _ in range(4)]
    rows = [(i, prose(rng, rng.randint(1, 150))) for i in range(40)]
    rows += [(100 + i, rows[i % 5][1]) for i in range(15)]
    rows += [(200 + i, rows[i][1].replace("water", "wine", 1)) for i in range(20)]
    rows += [(300 + i, f"{prose(rng, rng.randint(0, 25))} {rng.choice(passages)} {prose(rng, rng.randint(0, 25))}") for i in range(60)]
    rows += [(400, "a" * 350), (401, "b" + "a" * 180), (402, "ab" * 200), (403, passages[0] * 3), (404, "é" * 90), (405, "x" * 100), (406, "x" * 99)]
    rows += [(None, rows[0][1]), (None, rows[60][1]), (407, None), (408, ""), (3, "short"), (3, rows[3][1]), (410, "same " * 40), (410, "same " * 40)]
    rng.shuffle(rows)
    return rows


def result(spark, rows, **more):
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, mark int, first int, data int").repartition(4)
    return sorted((tuple(r) for r in repeats.digest(df, **more).collect()), key=repr)


@pytest.mark.parametrize("seed, more", [
    (1, {}),
    (2, {"hot_runs": 1}),  # every open anchor goes by single strings
    (3, {"bucket_bytes": 4_000, "shard_bytes": 600}),  # many buckets of many shards
    (4, {"anchor": 8, "hot_runs": 6, "shard_bytes": 1_000}),
])
def test_equals_plain_search(spark, seed, more):
    # Texts with one doc_id go by checksum: here one of the two is too short to matter.
    rows = corpus(seed)
    rows = [r for r in rows if r[0] is not None] + [(None, r[1]) for r in rows if r[0] is None][:1]
    assert result(spark, rows, **more) == plain(rows)


def test_null_ids_come_last_and_rows_with_one_id_go_by_checksum(spark):
    text = prose(random.Random(5), 40)
    got = result(spark, [(None, text), (7, text), (9, text + "!"), (9, text + "!")])
    assert [(d, removed) for d, _, removed, _, _ in got] == [(7, 0), (9, len(text.encode())), (9, len(text.encode())), (None, len(text.encode()))]


def test_empty_table_and_tables_without_repeats(spark):
    assert result(spark, []) == []
    rows = [(1, "a short text"), (2, prose(random.Random(1), 60)), (3, "")]
    assert result(spark, rows) == plain(rows) and all(r[2] == 0 for r in plain(rows))


def test_long_text_in_pieces(spark, monkeypatch):
    rng = random.Random(9)
    texts = [prose(rng, 3000), prose(rng, 500)]
    texts.append(texts[0][5000:9000] + texts[1])
    whole = {(x[0], x[3] + i) for x in zip(*repeats.anchored([t.encode() for t in texts], 100, 32)) for i in range(x[4] - x[3] + 1)}
    monkeypatch.setattr(repeats, "PIECE", 700)
    cut = list(zip(*repeats.anchored([t.encode() for t in texts], 100, 32)))
    starts = [(x[0], x[3] + i) for x in cut for i in range(x[4] - x[3] + 1)]
    assert len(starts) == len(set(starts)) and set(starts) == whole == {(i, a) for i, t in enumerate(texts) for a in range(len(t.encode()) - 99)}


@pytest.mark.parametrize("seed", range(5))
def test_transform_is_the_sorted_rotations(seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))).encode() for _ in range(8)]
    symbols = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8) + np.uint8(1)
    stops = np.flatnonzero(symbols == 0)
    order, bwt, back = repeats.transform(symbols, stops)
    end = {p: int(stops[np.searchsorted(stops, p)]) for p in range(len(symbols))}
    assert order.tolist() == sorted(range(len(symbols)), key=lambda p: (symbols[p:end[p]].tolist() + [0, end[p]]))
    assert bwt.tolist() == [int(symbols[p - 1]) if p else 0 for p in order]
    assert all(order[back[r]] == order[r] - 1 for r in range(len(order)) if bwt[r])


def test_repeated_intervals_over_shards_come_in_order_of_the_suffixes():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc") for _ in range(60)).encode() for _ in range(12)]
    shards = list(repeats._shards(texts, 150))
    assert len(shards) > 3
    parts, symbols = [], []
    for group in shards:
        s = np.frombuffer(b"\xff".join(group) + b"\xff", np.uint8) + np.uint8(1)
        parts.append(repeats.transform(s, np.flatnonzero(s == 0)))
        symbols.append(s)
    rows, interval = repeats.repeated_intervals(parts, 5)
    flat = [bytes(s[p:p + 5]) for s, (order, _, _) in zip(symbols, parts) for p in order]
    strings = [flat[r] for r in rows]
    assert strings == sorted(strings) and all((a == b) == (i == j) for a, b, i, j in zip(strings, strings[1:], interval, interval[1:]))
    counts = {}
    for t in texts:
        for a in range(56):
            counts[t[a:a + 5]] = counts.get(t[a:a + 5], 0) + 1
    assert len(rows) == sum(n for n in counts.values() if n > 1)
