"""SimHash near-dedup against a plain form: every pair of fingerprints is compared."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import common, simhash
from tidelog.llm.graph import components


def plain_fingerprint(text, size=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(run.encode(), 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, radius=4):
    prints = [plain_fingerprint(text) for _, text in rows]
    group = list(range(len(rows)))
    values = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius).tolist():
            if group[i] != group[j]:
                old, new = group[j], group[i]
                group = [new if g == old else g for g in group]
    smallest = {}
    for g, (doc_id, _) in zip(group, rows):
        if doc_id is not None:
            smallest[g] = min(doc_id, smallest.get(g, doc_id))
    return sorted(((d, f"{p:016x}", smallest.get(g)) for (d, _), p, g in zip(rows, prints, group)), key=repr)


def found(df, **more):
    return sorted((tuple(r) for r in simhash.simhash_components(df, **more).collect()), key=repr)


def test_equals_comparing_every_pair(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 150")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    base = rows[3][1].split()
    words = random.Random(1)
    for i in range(60):  # near copies, each with a word changed
        copy = list(base)
        copy[words.randrange(len(copy))] = f"x{i % 7}"
        rows.append((1000 + i, " ".join(copy)))
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one"), (2004, "ONE"), (2004, "ONE"), (None, "one"),
             (None, "É é"), (2005, "a b c d e" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("f", F.lit(1)).withColumn("key", F.lit("x"))
    assert found(df) == plain_components(rows)
    assert found(df, bucket_rows=8) == plain_components(rows)


def broadcast_parts(df):
    """What stands below each broadcast in the plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    for i, line in enumerate(lines):
        if (depth := line.find("BroadcastExchange")) >= 0:
            below = next((j for j in range(i + 1, len(lines)) if re.search(r"\w", lines[j]).start() <= depth), len(lines))
            yield "\n".join(lines[i:below])


def test_exploded_keys_are_never_broadcast(spark, monkeypatch):
    """Spark takes them to be as many as their nodes."""
    rows = [(i, f"{'same words in all of them ' * 4} {'x' * (i % 5)}") for i in range(60)] + [(100, "another text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = spark.range(50).select(F.explode(simhash.block_keys(F.col("id"), 5, 1)).alias("key"), F.col("id").alias("node"), F.array("id").alias("f"))
    for most in (500_000, 0):
        monkeypatch.setattr(common, "BROADCAST_ROWS", most)
        links = simhash.bucket_links(keyed, simhash.within(4), 8)
        parts = list(broadcast_parts(links))
        assert bool(parts) == bool(most) and not any(re.search("Generate explode", x) for x in parts)
        assert {r.root for r in components(links).collect()} == {0}
        assert found(df, bucket_rows=2) == plain_components(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id long, text string")) == []


@pytest.mark.parametrize("count", [2, 10_000, 10**7, 10**9])
def test_pigeonhole_keys_meet(spark, count):
    blocks, agreeing = simhash.block_scheme(count, 4)
    numbers = random.Random(count)
    pairs = []
    for _ in range(200):
        a = numbers.getrandbits(64)
        b = a
        for bit in numbers.sample(range(64), 4):
            b ^= 1 << bit
        pairs.append((a - 2**64 if a >= 2**63 else a, b - 2**64 if b >= 2**63 else b))
    df = spark.createDataFrame(pairs, "a long, b long")
    keys = [simhash.block_keys(F.col(c), blocks, agreeing) for c in "ab"]
    assert df.where(~F.arrays_overlap(*keys)).count() == 0


def test_components_of_a_chain_a_star_and_noise(spark):
    links = [(i, i + 1) for i in range(0, 100)] + [(500, i) for i in range(400, 600)] + [(700, 700), (None, 3), (3, None)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components(df.union(df)).collect()}
    assert got == {**{i: 0 for i in range(101)}, **{i: 400 for i in range(400, 600)}}
