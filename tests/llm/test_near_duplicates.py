"""Near duplicates by shingle sets against comparing every pair."""

import random
import re

import numpy as np
import pytest

from tidelog.llm import simhash


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain(rows, similarity=0.8):
    """Row numbers by group: sets as similar as that are linked; texts without words are equal."""
    sets, group = [sets_of(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= similarity * len(sets[i] | sets[j]) - 1e-9:
                if group[i] != group[j]:
                    group = [group[j] if g == group[i] else g for g in group]
    return group


def rows_of(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if len(r.text) < 5000]
    words, numbers = " ".join(t for _, t in rows[:30]).split(), random.Random(5)
    base = [numbers.choice(words) + str(numbers.randrange(9)) for _ in range(140)]
    for i in range(120):  # copies with up to six changed words: some are similar to the base, some only to each other
        copy = list(base)
        for _ in range(numbers.randrange(1, 7)):
            copy[numbers.randrange(len(copy))] = f"changed{numbers.randrange(20)}"
        rows.append((10_000 + i, " ".join(copy)))
    return rows + [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "a b"), (20_004, "A  b"), (20_005, "a b c"), (None, "a b"),
                   (20_006, rows[0][1]), (20_006, rows[0][1]), (20_007, "w " * 9000)]


def test_components_equal_comparing_every_pair(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS n", "'r' AS raw", "4 AS f").repartition(3)
    group = plain(rows)
    for more in ({}, {"part_shingles": 2000}, {"part_shingles": 2000, "part_words": 40}):
        found = simhash.near_components(df, **more).collect()
        assert len(found) == len(rows)
        by_row = {}
        for r in found:
            by_row.setdefault(r.doc_id, set()).add(r.component)
        ours, theirs = {}, {}
        for g, (d, _) in zip(group, rows):
            theirs.setdefault(g, set()).add(d)
        for d, components in by_row.items():
            for c in components:
                ours.setdefault(c, set()).add(d)
        assert sorted(map(sorted, [[str(d) for d in x] for x in ours.values()])) == sorted(map(sorted, [[str(d) for d in x] for x in theirs.values()]))
    kept = simhash.without_near_duplicates(df)
    assert kept.columns == df.columns
    least = {}
    for g, (d, _) in zip(group, rows):
        least[g] = min(least.get(g, 10**9), 10**9 if d is None else d)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_components(empty).count() == 0 and simhash.without_near_duplicates(empty).count() == 0


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_similar_within_is_a_forest_of_the_pairs(similarity):
    random_numbers = np.random.default_rng(2)
    sets = [np.unique(random_numbers.integers(0, 40, random_numbers.integers(0, 30))) for _ in range(60)]
    sets += [np.union1d(s, [99]) for s in sets[:20]]
    offsets = np.cumsum([0] + [len(s) for s in sets])
    a, b = simhash.similar_within(np.concatenate(sets), offsets, similarity)
    group, want = list(range(len(sets))), list(range(len(sets)))
    for i, j in zip(a.tolist(), b.tolist()):
        group = [group[j] if g == group[i] else g for g in group]
    for i in range(len(sets)):
        for j in range(i):
            union = len(np.union1d(sets[i], sets[j]))
            if union and len(sets[i]) and len(sets[j]) and len(np.intersect1d(sets[i], sets[j])) >= similarity * union - 1e-9:
                want = [want[j] if g == want[i] else g for g in want]
    assert len(set(zip(group, want))) == len(set(group)) == len(set(want))


@pytest.mark.parametrize("words, more", [(8, 1), (16, 3), (28, 6)])
def test_pairs_at_the_limit_are_all_found(spark, words, more):
    """Two texts each, one goes on a little longer: 4 of 5, 12 of 15 and 24 of 30 shingles are shared."""
    pairs = []
    for i in range(600):
        text = [f"w{i}x{j}" for j in range(words + more)]
        pairs += [(2 * i, " ".join(text[:words])), (2 * i + 1, " ".join(text))]
    found = simhash.without_near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3))
    assert sorted(r.doc_id for r in found.collect()) == list(range(0, 1200, 2))


def test_the_prefix_of_similar_sets_has_a_common_member_in_any_order():
    numbers = np.random.default_rng(4)
    common = np.sort(numbers.choice(2**40, 60, replace=False).astype(np.uint64))
    often = numbers.integers(3, 9, 60)
    for _ in range(500):
        both = numbers.integers(4, 60)
        base = np.unique(np.concatenate([numbers.choice(common, both // 2, replace=False) if both < 60 else common,
                                         numbers.integers(0, 2**40, both).astype(np.uint64)]))
        own = [np.union1d(base, numbers.integers(2**41, 2**42, n).astype(np.uint64)) for n in numbers.multinomial(len(base) // 4, [0.5, 0.5])]
        a, b = (simhash.prefix(x, 0.8, common, often) for x in own)
        assert len(np.intersect1d(a, b))
        rows = [np.concatenate([[np.uint64(len(x))], simhash.parity(x)]) for x in own]
        assert simhash.may_be_similar(0.8)(rows[0], rows[1])


@pytest.mark.parametrize("similarity", [0.3, 0.8, 0.95])
def test_similar_sets_have_sized_parities_of_one_length_that_pass(similarity):
    numbers = np.random.default_rng(6)
    for size in (1, 3, 16, 17, 127, 128, 129, 500, 1024, 1300, 6000):
        for _ in range(6):
            whole = np.unique(numbers.integers(0, 2**62, size).astype(np.uint64))
            least = int(np.ceil(similarity * len(whole) - 1e-9))
            pair = whole, numbers.choice(whole, numbers.integers(least, len(whole) + 1), replace=False)
            own = [{len(f): np.concatenate([[np.uint64(len(x))], f]) for f in simhash.sized_parities(x, similarity)} for x in pair]
            shortest = max(own[1])  # the length of the smaller set
            assert shortest in own[0] and simhash.may_be_similar(similarity)(own[0][shortest], own[1][shortest])


def test_sized_parities_tell_large_sets_apart():
    numbers = np.random.default_rng(7)
    a, b, c = (numbers.integers(0, 2**62, 6000).astype(np.uint64) for _ in range(3))
    half = np.concatenate([a[:3000], b[3000:]])  # a third of all members in common
    rows = [np.concatenate([[np.uint64(len(x))], simhash.sized_parities(x, 0.8)[0]]) for x in (a, c, half)]
    near = simhash.may_be_similar(0.8)
    assert not near(rows[0], rows[1]) and not near(rows[0], rows[2])


def test_simhash_finds_near_copies_and_the_prefix_search_is_for_the_rest(spark, monkeypatch):
    """Pairs within the radius that are similar are linked by their fingerprints alone; pairs beyond it only without them."""
    numbers, rows = random.Random(8), []
    for i in range(40):
        words = [f"w{i}x{numbers.randrange(10**6)}" for _ in range(400)]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words + ["more"])), (3 * i + 2, " ".join(words[:340]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = {d: simhash.fingerprint(np.unique(simhash.shingle_hashes(t.encode(), 5))) for d, t in rows}
    near = {i for i in range(40) if (prints[3 * i] ^ prints[3 * i + 1]).bit_count() <= 4}
    far = {i for i in range(40) if min((prints[3 * i + 2] ^ prints[3 * i + j]).bit_count() for j in (0, 1)) > 4}
    assert len(near) > 30 and len(far) > 10
    assert sorted(r.doc_id for r in simhash.without_near_duplicates(df).collect()) == list(range(0, 120, 3))
    links = []
    monkeypatch.setattr(simhash, "_may_meet", lambda found, nodes, classes, similarity: links.append(classes.count()) or nodes.selectExpr("node AS a", "node AS b"))
    kept = {r.doc_id for r in simhash.without_near_duplicates(df).collect()}
    assert links[0] >= 2 * len(near) and not kept & {3 * i + 1 for i in near}
    assert {3 * i + 2 for i in far} <= kept
