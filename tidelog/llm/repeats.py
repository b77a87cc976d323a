"""Removal of long byte strings that stand earlier in the corpus, by merged Burrows-Wheeler transforms.

How the suffixes are brought together without sorting those of the whole corpus in one place:

1. Every 100-byte string is anchored at the k bytes in it whose hash is smallest, so equal strings have equal anchors.
   Neighbouring strings with one anchor are a run. Runs meet by anchor in one shuffle; of equal runs the first one stays
   and the others are wholly repeated.
2. Runs of one anchor that differ may still share strings. Only their bytes are fetched, dealt by anchor into buckets of
   bounded size, and a bucket's bytes are cut into shards.
3. Each shard's suffixes are sorted and give its transform. The transforms of a bucket are merged by refining their
   interleave: the rows are dealt by the symbol before them, over and over, and are in order by one symbol more each
   time. Where neighbours part tells their common prefix; rows that have parted from all others are let go. What is left
   after 100 steps are the repeated intervals.
4. An anchor with more than HOT_RUNS different runs doesn't fit a bucket: its strings meet one by one, by a 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidelog.llm.common import slices, written

LENGTH, ANCHOR = 100, 32
PIECE = 1 << 20  # bytes of text that are hashed at once
BUCKET_BYTES, SHARD_BYTES = 1 << 20, 1 << 17
HOT_RUNS = 4096
PLACE_BITS = np.uint64(24)  # of a packed anchor: its place within a piece
BASE, MIX = 0xD6E8FEB86659FD93, np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def _over_windows(cells: np.ndarray, width: int, joined) -> np.ndarray:
    """joined(left, right, right's width) over every `width` neighbouring cells, put together from windows of powers of two."""
    done, covered, size = None, 0, 1
    while True:
        if width & size:
            done = cells if done is None else joined(done[:len(cells) - covered], cells[covered:], size)
            covered += size
        if covered == width:
            return done
        cells = joined(cells[:-size], cells[size:], size)
        size *= 2


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every `width` neighbouring bytes."""
    rolled = _over_windows(data.astype(np.uint64) + np.uint64(1), width, lambda a, b, size: a * _powers(size) + b)
    rolled = (rolled ^ (rolled >> np.uint64(32))) * MIX
    return rolled ^ (rolled >> np.uint64(29))


def runs(data: np.ndarray, stops: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last) of the runs of strings of `length` bytes in texts that lie end to end and stop at `stops`.

    The anchor is the leftmost of the smallest hashes, so it depends on the string alone.
    """
    if len(data) < length:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = window_hashes(data, anchor)
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    places = (_over_windows(packed, length - anchor + 1, lambda a, b, size: np.minimum(a, b)) & low).astype(np.int64)
    inside = np.ones(len(places), bool)
    for stop in stops[:-1]:
        inside[max(0, stop - length + 1):stop] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return np.empty(0, np.uint64), starts, starts
    at = places[starts]
    cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1)) + 1
    first, last = starts[np.r_[0, cut]], starts[np.r_[cut - 1, len(starts) - 1]]
    return hashes[places[first]], first, last


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """Texts end to end, about PIECE bytes at once, with (text, its offset, where it lies). Long texts come in pieces that
    overlap so that every string lies in exactly one."""
    held, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - length + 1, PIECE):
            part = text[at:at + PIECE + length - 1]
            if size and size + len(part) > PIECE:
                yield b"".join(held), parts
                held, parts, size = [], [], 0
            parts.append((i, at, size))
            held.append(part)
            size += len(part)
    if size:
        yield b"".join(held), parts


def anchored(texts: list[bytes], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, key, content, first, last) of all runs: the number of the text, hashes of anchor and bytes, and where the
    run's strings start. In ascending order of text and start."""
    found = []
    for data, parts in _pieces(texts, length):
        starts = np.array([x[2] for x in parts], np.int64)
        key, first, last = runs(np.frombuffer(data, np.uint8), np.append(starts[1:], len(data)), length, anchor)
        content = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())], np.uint64)
        part = np.searchsorted(starts, first, "right") - 1
        move = np.array([x[1] for x in parts], np.int64)[part] - starts[part]
        found.append((np.array([x[0] for x in parts], np.int64)[part], key, content, first + move, last + move))
    if not found:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(column) for column in zip(*found))


def suffix_order(symbols: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where the suffixes of the texts in `symbols` start, in order. Each text ends with the symbol 0 at `stops`; ends are
    ordered as the texts are. By doubled ranks, starting from seven symbols."""
    n = len(symbols)
    stop = stops[np.searchsorted(stops, np.arange(n))]
    left = stop - np.arange(n)
    wide = np.concatenate([symbols, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(n, np.uint64)
    for i in range(7):
        word = (word << np.uint64(8)) | np.where(left >= i, wide[i:n + i], np.uint64(0))
    order = np.argsort(word, kind="stable")
    new = np.r_[True, word[order][1:] != word[order][:-1], True]  # where a group of equal ones starts
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new[:-1], np.arange(n), 0))
    width = 7
    while True:
        # Ends of equal texts are equal for good and stay in the order of the texts.
        places = np.flatnonzero(~(new[:-1] & new[1:]))
        places = places[left[order[places]] >= width]
        if not len(places):
            return order
        own = order[places]
        both = (rank[own] << 32) | rank[own + width]
        sort = np.argsort(both, kind="stable")
        own, both = own[sort], both[sort]
        order[places] = own
        new[places[1:]] |= both[1:] != both[:-1]
        rank[own] = np.maximum.accumulate(np.where(new[places], places, 0))
        width *= 2


def transform(symbols: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bwt, back) of a shard: its suffixes in order, the symbol before each, and the row of the suffix that is one
    symbol longer (of no use where the symbol is 0: there a text starts)."""
    order = suffix_order(symbols, stops)
    before = np.r_[np.uint8(0), symbols[:-1]]
    row = np.empty(len(order), np.int32)
    row[order] = np.arange(len(order), dtype=np.int32)
    return order, before[order], np.r_[np.int32(0), row[:-1]][order]


def repeated_intervals(shards: list[tuple[np.ndarray, np.ndarray, np.ndarray]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, interval) of the rows of the shards' transforms, laid end to end, whose first `depth` symbols are those of
    another row; rows of one interval have them in common. In the order of the suffixes.

    The interleave starts with one shard behind the other. A step deals its rows by their symbols, stably, and goes over
    to the longer suffixes: then it is in order by one symbol more. Two neighbours part at the step at which the
    symbol differs or what follows it has parted: that step is their common prefix. Rows that no longer share an interval
    are in place and need no further step, and longer suffixes of such rows share none either.
    """
    offsets = np.cumsum([0] + [len(s[0]) for s in shards])
    bwt = np.concatenate([s[1] for s in shards])
    back = np.concatenate([s[2] + np.int32(o) for s, o in zip(shards, offsets)])
    rows, interval = np.arange(len(bwt), dtype=np.int32), np.zeros(len(bwt), np.int32)
    for _ in range(depth):
        symbols = bwt[rows]
        dealt = np.argsort(symbols, kind="stable")
        symbols, rows, interval = symbols[dealt], back[rows[dealt]], interval[dealt]
        part = np.empty(len(rows) + 1, bool)
        part[0] = part[-1] = True
        np.not_equal(interval[1:], interval[:-1], out=part[1:-1])
        part[1:-1] |= symbols[1:] != symbols[:-1]
        shared = ~(part[:-1] & part[1:]) & (symbols != 0)
        interval = np.cumsum(part[:-1], dtype=np.int32)[shared]
        rows = rows[shared]
        if not len(rows):
            break
    return rows, interval


def later_strings(texts: list[bytes], length: int, shard_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of every string of `length` bytes that stands in an earlier text too, or earlier in its own."""
    shards, bases, sizes, base = [], [], [], 0
    for group in _shards(texts, shard_bytes):
        # Valid UTF-8 has no byte 0xFF, so symbols 1 to 255 are bytes and 0 is an end.
        symbols = np.frombuffer(b"\xff".join(group) + b"\xff", np.uint8) + np.uint8(1)
        shards.append(transform(symbols, np.flatnonzero(symbols == 0)))
        bases.append(base)
        base += len(symbols)
    rows, interval = repeated_intervals(shards, length)
    place = np.concatenate([s[0] + b for s, b in zip(shards, bases)])[rows]
    earliest = np.full(int(interval.max(initial=0)) + 1, base, np.int64)
    np.minimum.at(earliest, interval, place)
    later = np.sort(place[place != earliest[interval]])
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    text = np.searchsorted(starts, later, "right") - 1
    return text, later - starts[text]


def _shards(texts: list[bytes], shard_bytes: int) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        if size and size + len(text) > shard_bytes:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield held


NO_ID = 1 << 32  # of a mark: the row has no doc_id


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, data) without nulls. mark is a checksum of the text, which tells rows with one doc_id apart, plus NO_ID
    for those without a doc_id, which have 0 in its place."""
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    none = F.lit(0).cast(docs.schema[id_col].dataType)
    return docs.select(F.coalesce(id_col, none).alias("doc_id"), (F.crc32(data) + F.when(F.col(id_col).isNull(), NO_ID).otherwise(0)).alias("mark"),
                       data.alias("data"))


def _spans(text: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring stretches of starts as one; they must come in order."""
    if not len(text):
        return text, first, last
    cut = np.flatnonzero((text[1:] != text[:-1]) | (first[1:] != last[:-1] + 1)) + 1
    return text[np.r_[0, cut]], first[np.r_[0, cut]], last[np.r_[cut - 1, len(text) - 1]]


ORDER = [("late", "ascending"), ("doc_id", "ascending"), ("mark", "ascending")]


def _in_order(table: pa.Table, *more: str) -> pa.Table:
    """Rows in the order of their documents: those without a doc_id last. Repeated rows go."""
    table = table.append_column("late", pc.greater_equal(table.column("mark"), NO_ID))
    table = table.take(pc.sort_indices(table, sort_keys=[*ORDER, *((name, "ascending") for name in more)]))
    fresh = np.zeros(max(0, table.num_rows - 1), bool)
    for name in ("doc_id", "mark", *more):
        column = table.column(name).combine_chunks()
        fresh |= np.asarray(pc.not_equal(column[1:], column[:-1]))
    return table.filter(pa.array(np.r_[True, fresh][:table.num_rows]))


def _runs_of(given: DataFrame, length: int, anchor: int) -> DataFrame:
    """(key, content, doc_id, mark, first, last): runs, equal ones of a batch once. Without content: wholly repeated in its batch."""
    kind = given.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = _in_order(pa.table(batch))
            text, key, content, first, last = anchored(table.column("data").to_pylist(), length, anchor)
            order = np.argsort(key ^ (content * MIX), kind="stable")
            fresh = np.ones(len(order), bool)
            fresh[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
            one = np.sort(order[fresh])
            again = _spans(*(x[np.sort(order[~fresh])] for x in (text, first, last)))
            rows = np.r_[text[one], again[0]]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[key[one], (again[1].astype(np.uint64) + again[0].astype(np.uint64) * MIX) * MIX].view(np.int64)),
                pa.array(np.r_[content[one], np.zeros(len(again[0]), np.uint64)].view(np.int64), mask=np.arange(len(rows)) >= len(one)),
                table.column("doc_id").combine_chunks().take(pa.array(rows)), table.column("mark").combine_chunks().take(pa.array(rows)),
                pa.array(np.r_[first[one], again[1]].astype(np.int32)), pa.array(np.r_[last[one], again[2]].astype(np.int32))],
                ["key", "content", "doc_id", "mark", "first", "last"])

    return given.mapInArrow(scan, f"key long, content long, doc_id {kind}, mark long, first int, last int")


def _with_texts(given: DataFrame, wanted: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, mark, data, spans): texts with the list of what is wanted in them. Each text is shuffled once; repeated rows
    have met by then."""
    spans = wanted.groupBy("doc_id", "mark").agg(F.collect_set(F.struct(*columns)).alias("spans"))
    return given.hint("merge").join(spans, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"])


def repeated(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot_runs: int = HOT_RUNS, bucket_bytes: int = BUCKET_BYTES,
             shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, first, last), keys as in `_given`: stretches of starts of strings of `length` bytes that also start earlier in the corpus.

    Earlier is a smaller doc_id, or the same text further left. A null doc_id comes after all others; texts with one
    doc_id go by checksum (`mark`); rows with equal doc_id and text are one document. Strings do not cross documents. Null and
    short texts have none. Stretches may overlap and repeat. An empty table gives no rows.
    """
    given = _given(docs, id_col, text_col)
    kind = given.schema["doc_id"].dataType.simpleString()
    by_key = Window.partitionBy("key")
    place = Window.partitionBy("key", "content").orderBy(F.col("mark") >= NO_ID, "doc_id", "mark", "first")
    met = written(_runs_of(given, length, anchor)
                  .withColumn("place", F.rank().over(place))
                  .withColumn("kinds", F.max(F.dense_rank().over(by_key.orderBy("content"))).over(by_key))
                  .withColumn("later", F.col("content").isNull() | (F.col("place") > 1))
                  .where("later or kinds > 1").select("key", "doc_id", "mark", "first", "last", "kinds", "later"), "runs")
    open_runs = met.where("not later")
    size = open_runs.where(F.col("kinds") <= hot_runs).agg(F.sum(F.col("last") - F.col("first") + length + 1)).first()[0] or 0
    buckets = -(-size // bucket_bytes)
    found = [met.where("later").select("doc_id", "mark", "first", "last")]
    if buckets:
        found.append(written(_by_merging(given, open_runs.where(F.col("kinds") <= hot_runs), buckets, length, shard_bytes, kind), "merged"))
    if not open_runs.where(F.col("kinds") > hot_runs).isEmpty():
        found.append(written(_one_by_one(given, open_runs.where(F.col("kinds") > hot_runs), length, kind), "strings"))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _by_merging(given: DataFrame, wanted: DataFrame, buckets: int, length: int, shard_bytes: int, kind: str) -> DataFrame:
    with_texts = _with_texts(given, wanted.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))), "bucket", "first", "last")

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows, bucket, first, data = [], [], [], []
            for i, (text, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                rows += [i] * len(spans)
                bucket += [s["bucket"] for s in spans]
                first += [s["first"] for s in spans]
                data += [text[s["first"]:s["last"] + length] for s in spans]
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), batch.column(0).take(at), batch.column(1).take(at),
                                              pa.array(first, pa.int32()), pa.array(data, pa.binary())], ["bucket", "doc_id", "mark", "first", "data"])

    def merge(table: pa.Table) -> pa.Table:
        table = _in_order(table, "first")
        text, start = later_strings(table.column("data").to_pylist(), length, shard_bytes)
        text, first, last = _spans(text, start, start)
        base = np.asarray(table.column("first").combine_chunks()).astype(np.int64)[text]
        at = pa.array(text)
        return pa.table([table.column("doc_id").combine_chunks().take(at), table.column("mark").combine_chunks().take(at),
                         pa.array((first + base).astype(np.int32)), pa.array((last + base).astype(np.int32))], ["doc_id", "mark", "first", "last"])

    windows = with_texts.mapInArrow(fetch, f"bucket long, doc_id {kind}, mark long, first int, data binary")
    return windows.groupBy("bucket").applyInArrow(merge, f"doc_id {kind}, mark long, first int, last int")


def _one_by_one(given: DataFrame, wanted: DataFrame, length: int, kind: str) -> DataFrame:
    with_texts = _with_texts(given, wanted, "first", "last")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            for i, (text, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                starts = [at for s in spans for at in range(s["first"], s["last"] + 1)]
                row = pa.array([i] * len(starts), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(text[at:at + length]) for at in starts], pa.binary()),
                                                  batch.column(0).take(row), batch.column(1).take(row), pa.array(starts, pa.int32())],
                                                 ["string", "doc_id", "mark", "first"])

    strings = written(with_texts.mapInArrow(hashed, f"string binary, doc_id {kind}, mark long, first int"), "hashes")
    earliest = (strings.groupBy("string").agg(F.min(F.struct((F.col("mark") >= NO_ID).alias("late"), "doc_id", "mark", "first")).alias("e"))
                .select("e.doc_id", "e.mark", "e.first"))
    return (strings.select("doc_id", "mark", "first").join(earliest, ["doc_id", "mark", "first"], "left_anti")
            .select("doc_id", "mark", "first", F.col("first").alias("last")))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(doc_id, mark, spans, kept) of the documents that lose something: the maximal stretches of bytes that go, each (start,
    stop), and the bytes that stay, end to end. Keys as in `_given`. See `repeated` for what goes and for the other parameters."""
    given = _given(docs, id_col, text_col)
    kind = given.schema["doc_id"].dataType.simpleString()
    with_texts = _with_texts(given, repeated(docs, length, id_col=id_col, text_col=text_col, **more), "first", "last")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            spans, kept = [], []
            for text, stretches in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                gone = []
                for first, stop in sorted((s["first"], s["last"] + length) for s in stretches):
                    if gone and first <= gone[-1][1]:
                        gone[-1][1] = max(stop, gone[-1][1])
                    else:
                        gone.append([first, stop])
                edges = [0, *(x for span in gone for x in span), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                spans.append([{"start": a, "stop": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                                              pa.array(kept, pa.binary())], ["doc_id", "mark", "spans", "kept"])

    return with_texts.mapInArrow(cut, f"doc_id {kind}, mark long, spans array<struct<start: int, stop: int>>, kept binary")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row of docs. What loses nothing is hashed where it is read."""
    whole = _given(docs, id_col, text_col).select("doc_id", "mark", F.octet_length("data").cast("long").alias("n_bytes"), F.sha2("data", 256).alias("sha"))
    changed = without_repeats(docs, id_col=id_col, text_col=text_col, **more).select(
        "doc_id", "mark", F.octet_length("kept").cast("long").alias("left"), F.size("spans").cast("long").alias("n"), F.sha2("kept", 256).alias("new"))
    return (whole.join(changed, ["doc_id", "mark"], "left")
            .select(F.when(F.col("mark") < NO_ID, F.col("doc_id")).alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.coalesce("left", "n_bytes")).alias("n_removed"),
                    F.coalesce("n", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("new", "sha").alias("kept_sha256")))
