"""How far the sources of a language differ in their words: an exact audit over a transducer vocabulary.

1. Documents per (lang, term) are counted where texts are read and summed up; terms in `least_docs` documents or more are kept,
   and numbered in ascending order of their bytes within their language.
2. Minimal acyclic transducers are built from runs of SHARD_TERMS numbered terms each, one per task.
3. Texts are streamed through the transducers of their language once more, which gives counts per (source, ordinal). If all
   transducers together are larger than MAX_BYTES, tasks don't load them: distinct words with their counts go
   to the shard that their place among the shards' first terms names, and pass its transducer there.
4. What follows works on ordinals; terms come back at the very end.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tidelog.llm import transducer
from tidelog.llm.common import numbered, same, written

LEAST_DOCS = 3
SHARD_TERMS = 1 << 16
MAX_BYTES = 32 << 20  # of transducers that every task loads
TERM_RANKS = 200
SCALE = 1_000_000_000
CHUNK_TERMS = 1024  # of a language that are compared across sources at once
BATCH_BYTES = 4 << 20
HELD_TERMS, HELD_NUMBERS = 500_000, 4_000_000  # what a task gathers before it passes counts on

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_TERM = np.zeros(256, bool)
_IN_TERM[np.r_[65:91, 97:123, 128:256]] = True


def _given(docs: DataFrame) -> DataFrame:
    """(lang, source, data), '' for null."""
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")),
                       F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))


def _stretches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, stops, text) of all terms of the texts: lower-case bytes, where terms lie in them and whose they are."""
    data = _LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    edge = np.flatnonzero(np.diff(_IN_TERM[np.r_[np.uint8(0), data]])).astype(np.int64)
    starts, stops = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return data, starts, stops, np.searchsorted(ends, starts, "right")


def _groups(batch: pa.RecordBatch, size: int = BATCH_BYTES) -> Iterator[tuple[tuple[str, str], list[bytes]]]:
    """Texts by (lang, source), about `size` bytes at once."""
    held: dict[tuple[str, str], list[bytes]] = {}
    for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
        held.setdefault((lang, source), []).append(text)
    for key, texts in held.items():
        part, length = [], 0
        for text in texts:
            if part and length + len(text) > size:
                yield key, part
                part, length = [], 0
            part.append(text)
            length += len(text)
        yield key, part


def document_counts(given: DataFrame) -> DataFrame:
    """(lang, term, docs): in how many documents each term stands."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for (lang, _), texts in _groups(batch):
                counter = seen.setdefault(lang, Counter())
                data, starts, stops, text = _stretches(texts)
                raw = data.tobytes()
                cut = np.searchsorted(text, np.arange(len(texts) + 1))
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    counter.update({raw[x:y] for x, y in zip(starts[a:b].tolist(), stops[a:b].tolist())})
            if sum(map(len, seen.values())) > HELD_TERMS:
                yield from told(seen)
                seen = {}
        yield from told(seen)

    def told(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in seen.items():
            terms, counts = pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())
            for at in range(0, len(counter), 1 << 16):
                part = terms.slice(at, 1 << 16)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), part, counts.slice(at, 1 << 16)], ["lang", "term", "docs"])

    return given.select("lang", "source", "data").mapInArrow(count, "lang string, term binary, docs long").groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(given: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, number): the kept terms of each language in ascending order of their bytes."""
    return numbered(document_counts(given).where(F.col("docs") >= least_docs).select("lang", "term"), "lang", "term")


def machines(kept: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, shard, first, machine): the transducer of each run of `shard_terms` terms, and its first term. Written."""
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        terms = table.column("term").to_pylist()
        return pa.table([table.column("lang").slice(0, 1), table.column("shard").slice(0, 1), pa.array([terms[0]], pa.binary()),
                         pa.array([transducer.built(terms).to_bytes()], pa.binary())], ["lang", "shard", "first", "machine"])

    return written(kept.withColumn("shard", F.floor(F.col("number") / shard_terms).cast("long")).groupBy("lang", "shard")
                   .applyInArrow(build, "lang string, shard long, first binary, machine binary"), "machines")


def term_counts(given: DataFrame, kept: DataFrame, shard_terms: int = SHARD_TERMS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(lang, source, number, n): how often each kept term stands in each source, where it does."""
    made = machines(kept, shard_terms)
    if (made.agg(F.sum(F.octet_length("machine"))).first()[0] or 0) <= max_bytes:
        counted = _streamed(given, made, shard_terms)
    else:
        counted = _dealt(given, made, shard_terms)
    return counted.groupBy("lang", "source", "number").agg(F.sum("n").alias("n"))


def _streamed(given: DataFrame, made: DataFrame, shard_terms: int) -> DataFrame:
    """Every task loads all transducers, whose size the caller has checked."""
    loaded: dict[str, list] = {}
    for row in made.select("lang", "shard", "machine").toLocalIterator():
        loaded.setdefault(row.lang, []).append((row.shard * shard_terms, bytes(row.machine)))
    sent = given.sparkSession.sparkContext.broadcast(loaded)

    def recount(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {lang: [(base, transducer.Transducer.from_bytes(data)) for base, data in own] for lang, own in sent.value.items()}
        total: dict[tuple[str, str], list] = {}
        held = 0
        for batch in batches:
            for key, texts in _groups(batch):
                data, starts, stops, _ = _stretches(texts)
                for base, machine in ready.get(key[0], ()):
                    number = transducer.ordinals(machine, data, starts, stops)
                    total.setdefault(key, []).append(number[number >= 0] + base)
                    held += len(total[key][-1])
            if held > HELD_NUMBERS:
                yield from told(total)
                total, held = {}, 0
        yield from told(total)

    def told(total: dict[tuple[str, str], list]) -> Iterator[pa.RecordBatch]:
        for (lang, source), numbers in total.items():
            number, n = np.unique(np.concatenate(numbers), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(number), pa.string()), pa.array([source] * len(number), pa.string()),
                                              pa.array(number), pa.array(n)], ["lang", "source", "number", "n"])

    return given.mapInArrow(recount, "lang string, source string, number long, n long")


def _dealt(given: DataFrame, made: DataFrame, shard_terms: int) -> DataFrame:
    """Distinct words with their counts go to their shard: the last one whose first term isn't larger. Only those first terms are
    sent to all tasks, one in `shard_terms` of the vocabulary. A shard's words pass its transducer in batches."""
    firsts: dict[str, list[bytes]] = {}
    for row in made.select("lang", "shard", "first").orderBy("lang", "shard").toLocalIterator():
        firsts.setdefault(row.lang, []).append(bytes(row.first))
    sent = given.sparkSession.sparkContext.broadcast(firsts)

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (lang, source), texts in _groups(batch):
                data, starts, stops, _ = _stretches(texts)
                raw, marks = data.tobytes(), sent.value.get(lang, [])
                seen = Counter(raw[a:b] for a, b in zip(starts.tolist(), stops.tolist()))
                shard = [bisect_right(marks, term) - 1 for term in seen]
                out = pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array([source] * len(seen), pa.string()), pa.array(shard, pa.int64()),
                                                  pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                                 ["lang", "source", "shard", "term", "n"])
                yield out.filter(pc.greater_equal(out.column("shard"), 0))

    counted = (given.mapInArrow(words, "lang string, source string, shard long, term binary, n long")
               .groupBy("lang", "source", "shard", "term").agg(F.sum("n").alias("n")))
    both = (made.select("lang", F.lit("").alias("source"), "shard", F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("n"), "machine")
            .union(counted.select("*", F.lit(None).cast("binary"))).repartition("lang", "shard").sortWithinPartitions("lang", "shard", F.col("machine").isNull()))

    def look_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None
        for batch in batches:
            at = [*np.flatnonzero(batch.column(5).is_valid()).tolist(), batch.num_rows]
            for start, stop in zip([-1, *at[:-1]], at):
                if start >= 0:  # the row of a transducer: the words after it are of its shard
                    machine = transducer.Transducer.from_bytes(batch.column(5)[start].as_py())
                part = batch.slice(start + 1, stop - start - 1)
                if part.num_rows:
                    terms = part.column(3).to_pylist()
                    ends = np.cumsum([len(t) for t in terms])
                    number = transducer.ordinals(machine, np.frombuffer(b"".join(terms), np.uint8), np.r_[0, ends[:-1]], ends)
                    base = np.asarray(part.column(2)) * shard_terms
                    out = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(number + base), part.column(4)], ["lang", "source", "number", "n"])
                    yield out.filter(pa.array(number >= 0))

    return both.mapInArrow(look_up, "lang string, source string, number long, n long")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS, shard_terms: int = SHARD_TERMS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank) of `docs(text, lang, source)`; further columns have no say.

    Terms are runs of letters A-Z, a-z and of signs beyond ASCII, with A-Z lower-cased. A term's share in a group or language is
    p = 1 + floor(10^9 (n + 1) / (N + V)), n its count there, N that of all V kept terms. Part `pair`: per other source of the
    language the sum over all kept terms of floor((p - q)^2 / q). Part `term`: per kept term of the group with p above
    the language's q that very value, the first `term_ranks` of them. Ties go by the item's bytes, of terms by their ordinals.

    A null text, lang or source counts as empty, the empty text has no terms, repeated rows count each time, and a language
    without kept terms has pairs of value 0. An empty table gives no rows. All numbers are whole numbers.
    """
    given = _given(docs)
    kept = vocabulary(given, least_docs)
    counts = written(term_counts(given, kept, shard_terms, max_bytes), "counts")
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = written(given.select("lang", "source").distinct().alias("g")
                     .join(totals.alias("t"), same("g", "t", "lang", "source"), "left").join(terms.alias("v"), same("g", "v", "lang"), "left")
                     .select("g.lang", "g.source", F.coalesce("t.total", zero).alias("total"), F.coalesce("v.terms", zero).alias("terms")), "groups")
    found = written(_compared(counts, groups, term_ranks), "compared")
    return _pairs(found, groups).unionByName(_terms(found, kept, term_ranks))


def _compared(counts: DataFrame, groups: DataFrame, term_ranks: int) -> DataFrame:
    """(lang, source, item, number, value) of each block of CHUNK_TERMS terms, a table of terms by sources: per pair of sources
    the sum over the block's terms, and per source those of its terms that may be among the first `term_ranks` (without item)."""
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("source")
        sources, totals = right.column("source").to_pylist(), [int(x) for x in right.column("total").to_pylist()]
        number, terms = np.asarray(left.column("number").combine_chunks()), right.column("terms")[0].as_py()
        first = int(number[0]) // CHUNK_TERMS * CHUNK_TERMS
        size = min(CHUNK_TERMS, terms - first)  # numbers leave no gap, so the last block has what is left of them
        n = np.zeros((len(sources), size), object if sum(totals) * SCALE >= 1 << 62 else np.int64)
        where = {source: i for i, source in enumerate(sources)}
        n[[where[s] for s in left.column("source").to_pylist()], number - first] = left.column("n").to_pylist()
        share = np.array([1 + SCALE * (row + 1) // (total + terms) for row, total in zip(n, totals)]).astype(np.int64)
        whole = (1 + SCALE * (n.sum(axis=0) + 1) // (sum(totals) + terms)).astype(np.int64)
        sums = [((p - share) ** 2 // share).sum(axis=1) for p in share]
        i, j = np.nonzero(~np.eye(len(sources), dtype=bool))
        rows = [(i, j, np.full(len(i), -1), np.array(sums, np.int64).reshape(len(sources), -1)[i, j])]
        for k, p in enumerate(share):
            more = np.flatnonzero((n[k] > 0) & (p > whole))
            value = (p[more] - whole[more]) ** 2 // whole[more]
            top = np.lexsort((more, -value))[:term_ranks]
            rows.append((np.full(len(top), k), np.full(len(top), -1), first + more[top], value[top]))
        i, j, number, value = (np.concatenate(column).astype(np.int64) for column in zip(*rows))
        name = pa.array(sources, pa.string())
        return pa.table([pa.array([right.column("lang")[0].as_py()] * len(i), pa.string()), name.take(pa.array(i)),
                         name.take(pa.array(j, mask=j < 0)), pa.array(number, mask=number < 0), pa.array(value)], ["lang", "source", "item", "number", "value"])

    blocks = counts.withColumn("chunk", F.floor(F.col("number") / CHUNK_TERMS).cast("long"))
    chunks = (blocks.select("lang", "chunk").distinct().alias("c").join(groups.alias("g"), same("c", "g", "lang"))
              .select("g.*", F.col("c.chunk").alias("block")))
    return (blocks.groupBy("lang", "chunk").cogroup(chunks.groupBy("lang", "block"))
            .applyInArrow(compare, "lang string, source string, item string, number long, value long"))


def _pairs(found: DataFrame, groups: DataFrame) -> DataFrame:
    summed = found.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    all_pairs = (groups.alias("a").join(groups.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
                 .select("a.lang", "a.source", F.col("b.source").alias("item")))
    return (all_pairs.alias("p").join(summed.alias("s"), same("p", "s", "lang", "source", "item"), "left")
            .select("p.lang", "p.source", F.lit("pair").alias("part"), "p.item", F.coalesce("s.value", F.lit(0).cast("long")).alias("value"))
            .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))))


def _terms(found: DataFrame, kept: DataFrame, term_ranks: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "number"))
    first = found.where("number is not null").withColumn("rank", rank).where(F.col("rank") <= term_ranks)
    return (first.alias("f").join(kept.alias("k"), same("f", "k", "lang", "number"))
            .select("f.lang", "f.source", F.lit("term").alias("part"), F.col("k.term").cast("string").alias("item"), "f.value", "f.rank"))
