"""The audit against plain counting, and the transducer against a sorted list."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidelog.llm import divergence, transducer

SCHEMA = "doc_id long, text string, lang string, source string, number int, n int, term string, rank int"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, ranks=200, least=3):
    docs, counts = {}, {}
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text or "")]
        docs.setdefault(lang, Counter()).update(set(words))
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(words)
    out = []
    for lang, sources in counts.items():
        kept = sorted((t for t, n in docs[lang].items() if n >= least), key=str.encode)

        def shares(counter):
            total = sum(counter[t] for t in kept)
            return {t: 1 + 10 ** 9 * (counter[t] + 1) // (total + len(kept)) for t in kept}

        own = {s: shares(c) for s, c in sources.items()}
        whole = shares(sum(sources.values(), Counter()))
        for s, p in own.items():
            pairs = [(o, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)) for o, q in own.items() if o != s]
            terms = [(t, (p[t] - whole[t]) ** 2 // whole[t]) for t in kept if sources[s][t] and p[t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


def some_rows(seed, n=400):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcéßüЖ中A") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    rows = [(" ".join(rng.choice(words[rng.randint(0, 100):]) + rng.choice(["", ".", "1", "\0", "_"]) for _ in range(rng.randint(0, 30))),
             rng.choice(["en", "en", "de", None, ""]), rng.choice(["a", "b", "B", "é", None])) for _ in range(n)]
    return rows + [(None, "en", "z"), ("", "fr", "only"), ("alone once", "xx", "a"), ("other", "xx", "b"), ("word " * 5000, "en", "long")] + [rows[0]] * 5


def result(spark, rows, **more):
    docs = spark.createDataFrame([(i, *r, 1, 2, "x", 3) for i, r in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in divergence.audit(docs, **more).collect())


@pytest.mark.parametrize("more", [{}, {"shard_terms": 7}, {"shard_terms": 7, "max_bytes": 0}, {"max_bytes": 0}, {"term_ranks": 5}])
def test_equals_plain_counting(spark, more):
    rows = some_rows(1)
    assert result(spark, rows, **more) == plain(rows, more.get("term_ranks", 200))


def test_blocks_of_terms(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CHUNK_TERMS", 8)
    rows = some_rows(2)
    assert result(spark, rows) == plain(rows)


def test_no_rows_and_no_kept_terms(spark):
    assert result(spark, []) == []
    assert result(spark, [("a b", "en", "s"), ("c", "en", "t"), (None, None, None)]) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def look_up(machine, words):
    ends = np.cumsum([len(w) for w in words])
    return transducer.ordinals(machine, np.frombuffer(b"".join(words), np.uint8), np.r_[0, ends[:-1]], ends).tolist()


@pytest.mark.parametrize("seed", range(4))
def test_transducer_gives_ordinals_and_is_minimal(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(0, 6))).encode() for _ in range(300)})
    machine = transducer.Transducer.from_bytes(transducer.built(words).to_bytes())
    assert look_up(machine, words) == list(range(len(words)))
    others = [w for w in ("".join(rng.choice("abcéd") for _ in range(5)).encode() for _ in range(300)) if w not in set(words)]
    assert look_up(machine, others) == [-1] * len(others)
    # As many states as there are distinct sets of endings.
    endings = {p: frozenset(w[len(p):] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(machine.final) == len(set(endings.values()))


def test_empty_transducer():
    assert look_up(transducer.built([]), [b"a", b""]) == [-1, -1]
