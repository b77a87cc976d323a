"""The manifest against a plain tree over lists."""

import hashlib
import random
import zlib

import pytest

from tidelog.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, number int, node string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang, source, n_chars):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """Root, and per leaf its list of (left, right)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 8 * 8:a // 8 * 8 + 8]
            paths[i].append(("".join(run[:a % 8]), "".join(run[a % 8 + 1:])))
            at[i] = a // 8
        level = [H(*level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def plain(rows):
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        trees[lang] = sorted(langs[lang], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(*r)))
    made = {lang: plain_tree([plain_leaf(*r) for r in trees[lang]]) for lang in order}
    root, tops = plain_tree([made[lang][0] for lang in order]) if order else (None, [])
    out = []
    for lang, top in zip(order, tops):
        for r, path in zip(trees[lang], made[lang][1]):
            path = path + top
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            text = r[1] if r[1] is None or not hit else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
            node = plain_leaf(r[0], text, *r[2:])
            for left, right in path:
                node = H(left, node, right)
            out.append((r[0], plain_leaf(*r), made[lang][0], root, H(*(a + b for a, b in path)), node, node == root))
    return sorted(out, key=repr)


def result(spark, rows, block_levels):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in merkle.checked(merkle.proofs(merkle.build(docs, merkle.tampered(docs), block_levels))).collect()), key=repr)


def some_rows(n, langs, seed=0):
    rng = random.Random(seed)
    rows = [(i * 3, rng.choice(["Upper and lower", "lower", "É", "", None, "x" * 3000]), rng.choice(langs), rng.choice(["a", None]), rng.choice([1, None])) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, langs, block_levels", [
    (1, ["en"], 4), (8, ["en"], 4), (9, ["en"], 4), (700, ["en", "de", None, "é", ""], 4),
    (600, ["en"], 1), (650, ["en"] * 30 + ["de", "fr", None], 2), (600, [f"l{i}" for i in range(80)], 1),  # several tiers
])
def test_equals_plain_tree(spark, n, langs, block_levels):
    rows = some_rows(n, langs)
    assert result(spark, rows, block_levels) == plain(rows)


def test_nulls_repeated_rows_and_one_id(spark):
    rows = [(None, None, None, None, None)] * 3 + [(5, "Same", "en", "s", 4)] * 9 + [(5, "other", "en", "s", 4), (None, "A", "en", "s", 1), (6, "a", "en", None, -1)]
    assert result(spark, rows, 1) == plain(rows)


def test_empty_table(spark):
    assert result(spark, [], 4) == []


@pytest.mark.parametrize("levels", range(1, 6))
def test_addresses_fill_the_block_and_subtrees_lie_together(levels):
    seen = [merkle.address(d, i, levels) for d in range(levels) for i in range(8 ** d)]
    assert sorted(seen) == list(range(merkle.nodes_in(levels)))
    upper = levels // 2
    if upper:
        low = levels - upper
        for s in range(8 ** upper):
            own = sorted(merkle.address(upper + d, s * 8 ** d + i, levels) for d in range(low) for i in range(8 ** d))
            assert own == list(range(own[0], own[0] + merkle.nodes_in(low)))


def test_a_changed_leaf_is_found(spark):
    rows = some_rows(100, ["en", "de"])
    made = {r[0]: r for r in result(spark, rows, 1)}
    for doc_id, text, *_ in rows:
        lowered = text is not None and any("A" <= c <= "Z" for c in text) and zlib.crc32(str(doc_id).encode()) % 3 == 0
        assert made[doc_id][6] == (not lowered)
