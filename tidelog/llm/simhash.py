"""Near duplicates by SimHash: pigeonhole blocks, a join on blocks, Hamming verification; by Jaccard similarity with an exact check after it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidelog.llm.common import counted_side, drop_written, free_names, let_shuffles_go, slices, written
from tidelog.llm.graph import components
from tidelog.llm.tokens import let_go

SEED = 42
BUCKET_ROWS = 2048  # a bucket with more fingerprints is split into pairs of parts of about this size
_LANES = np.uint64(0x0101010101010101)

Near = Callable[[np.ndarray, np.ndarray], np.ndarray]  # of two arrays of rows of 64-bit words: which rows are linked


def shingle_hashes(data: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every run of `size` words (one space between them), in order and with repeats.

    Words are what white space of ASCII separates, A-Z lower-cased. A text with fewer words gives the hash of
    its whole sequence; null, empty or blank text gives none.
    """
    words = (data or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:max(1, len(words) - size + 1)]
    ends = ends[min(size, len(words)) - 1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits: a bit is set where it is set in over half of the hashes; 0 without any.

    Bits are counted eight at a time, one in each byte of a word, over runs that cannot overflow a byte.
    """
    n = len(hashes)
    if not n:
        return 0
    runs = np.zeros((-(-n // 255), 255), np.uint64)
    runs.ravel()[:n] = hashes
    votes = np.empty((8, 8), np.int64)  # [byte, bit]
    for bit in range(8):
        lanes = ((runs >> np.uint64(bit)) & _LANES).sum(axis=1, dtype=np.uint64)
        votes[:, bit] = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * votes > n).astype(np.uint8), axis=1, bitorder="little").ravel().view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f): the 64-bit fingerprint of every document, as a signed long. Null text counts as empty."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            found = np.array([fingerprint(shingle_hashes(x, shingle)) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "f"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("data"))
    return given.mapInArrow(run, T.StructType([T.StructField("doc_id", given.schema[0].dataType),
                                               T.StructField("f", T.LongType())]))


def block_scheme(count: int, radius: int, bits: int = 64) -> tuple[int, int]:
    """(blocks, agreeing): with `blocks` blocks, two fingerprints within `radius` agree in `agreeing` of them.

    One more block that must agree makes keys longer and more of them. The first scheme is taken whose keys
    have at least as many values as there are fingerprints; all of them find every pair.
    """
    for agreeing in range(1, 6):
        if bits * agreeing // (radius + agreeing) >= math.log2(max(2, count)) + 2:
            break
    return radius + agreeing, agreeing


def block_keys(f: Column, blocks: int, agreeing: int, bits: int = 64) -> Column:
    """Array of one key for each way to choose `agreeing` blocks: the number of the way and the bits in it."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), agreeing)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - 2**64 if mask >= 2**63 else mask
        keys.append(F.xxhash64(F.lit(number), f.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


def within(radius: int) -> Near:
    """At most `radius` bits differ."""
    return lambda x, y: np.bitwise_count(x ^ y).sum(axis=-1) <= radius


def bucket_links(keyed: DataFrame, near: Near, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that join what is linked within each bucket of `keyed(key, node, f array<long>)`.

    Two rows of a bucket are linked if `near` says so of their f. The links given are a forest of the
    bucket's linked groups, never all pairs. A bucket of over `bucket_rows` rows is cut into parts, and every
    pair of parts is a bucket of its own: no task holds more than two parts, and no pair is missed.
    """
    large = counted_side(written(keyed.groupBy("key").count().where(F.col("count") > bucket_rows)
                                 .select("key", F.ceil(F.col("count") / bucket_rows).cast("int").alias("parts")), "large-buckets"))
    member = F.struct("node", "f")
    small = keyed.join(large, "key", "left_anti").groupBy("key").agg(F.collect_list(member).alias("rows"))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    paired = (keyed.join(large, "key").withColumn("part", part)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .groupBy("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
              .agg(F.collect_list(member).alias("rows")))
    return _compared(small.select("rows").union(paired.select("rows")), keyed.schema["node"].dataType, near)


def counted_links(keyed: DataFrame, near: Near, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`bucket_links` where keyed(key, node, f, count) knows each bucket's size already, at most: rows are dealt once."""
    parts = F.ceil(F.col("count") / bucket_rows).cast("int")
    part = F.pmod(F.xxhash64("node", F.lit(1)), parts).cast("int")
    groups = (keyed.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
              .groupBy("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
              .agg(F.collect_list(F.struct("node", "f")).alias("rows")).select("rows"))
    return _compared(groups, keyed.schema["node"].dataType, near)


def _compared(groups: DataFrame, node: T.DataType, near: Near, at_once: int = 4096) -> DataFrame:
    """Links (a, b) within each list of `groups(rows)`. Groups that are looked at at once have f of one length."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at_once):
            rows = batch.column(0)
            flat = rows.flatten()
            starts = np.asarray(rows.offsets, np.int64)
            starts = starts - starts[0]
            nodes = flat.field(0)
            words = np.asarray(flat.field(1).flatten()).view(np.uint64).reshape(len(flat), -1)
            a, b = links_within(words, starts, near)
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], ["a", "b"])

    schema = T.StructType([T.StructField("a", node), T.StructField("b", node)])
    return groups.where(F.size("rows") > 1).mapInArrow(run, schema)


def links_within(words: np.ndarray, starts: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the links of each group words[starts[i]:starts[i + 1]]."""
    sizes = np.diff(starts)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for size in np.unique(sizes[sizes <= 16]).tolist():  # many small groups of one size at once
        first = starts[:-1][sizes == size]
        for i, j in combinations(range(size), 2):
            linked = near(words[first + i], words[first + j])
            left.append(first[linked] + i)
            right.append(first[linked] + j)
    for group in np.flatnonzero(sizes > 16).tolist():
        rows = words[starts[group]:starts[group + 1]]
        a, b = _forest(rows, near) if len(rows) > 256 else _near_pairs(rows, near)
        left.append(a + starts[group])
        right.append(b + starts[group])
    return np.concatenate(left), np.concatenate(right)


def _near_pairs(words: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """The links of a group that is small enough for a square of it; a forest where there are many."""
    linked = np.array([near(words, row) for row in words]).reshape(len(words), len(words))
    a, b = np.nonzero(np.triu(linked, 1))
    return (a, b) if len(a) <= 4 * len(words) else _forest(words, near)


def _forest(words: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """Links from the first row of each linked group to its other rows. A row is compared with rows not reached yet."""
    rest, left, right = np.arange(len(words)), [], []
    while len(rest):
        root, rest, reached = rest[0], rest[1:], rest[:1]
        while len(reached) and len(rest):
            some, reached = reached[:64], reached[64:]
            linked = np.zeros(len(rest), bool)
            for row in some.tolist():
                linked |= near(words[rest], words[row])
            new, rest = rest[linked], rest[~linked]
            left.append(np.full(len(new), root))
            right.append(new)
            reached = np.concatenate([reached, new])
    none = [np.empty(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def simhash_components(docs: DataFrame, shingle: int = 4, radius: int = 4, id_col: str = "doc_id",
                       text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of docs: what is linked by fingerprints at most `radius` bits apart.

    component_id is the smallest doc_id that can be reached over links, the document itself included. Equal
    fingerprints are one node, so exact copies are never paired. Fingerprints within the radius agree in some
    blocks (pigeonhole), meet in the bucket of those blocks and are then compared bit by bit.

    Null, empty and blank texts have fingerprint zero and are linked as any other. A null doc_id stays null and
    is never a component_id (which is null only if all that is reached have none). Repeated rows are each
    returned. Other columns are ignored. An empty table gives no rows.
    """
    found = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = found.groupBy("f").agg(F.min("doc_id").alias("first"))
    blocks, agreeing = block_scheme(nodes.count(), radius)
    keyed = nodes.select(F.explode(block_keys(F.col("f"), blocks, agreeing)).alias("key"),
                         F.col("f").alias("node"), F.array("f").alias("f"))
    roots = components(bucket_links(keyed, within(radius), bucket_rows))
    rooted = nodes.join(roots, nodes.f == roots.node, "left").select("f", "first", "root")
    # Few fingerprints have a link: only they are grouped by their root.
    smallest = (rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("smallest"))
                .select(F.col("root").alias("r"), "smallest"))
    ids = (rooted.join(smallest, F.col("root") == F.col("r"), "left")
           .select(F.col("f").alias("g"), F.when(F.col("root").isNull(), F.col("first"))
                   .otherwise(F.col("smallest")).alias("component_id")))
    return (found.hint("merge").join(ids, F.col("f") == F.col("g"))  # a row a document: its file tells little of that
            .select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id"))


PARITY_WORDS = 32  # 64-bit words of a parity sketch
SHORT_WORDS, SHORT_SHINGLES = 8, 1_000  # those of sets that are not larger: it rules out enough of them
COMMON_TEXTS, COMMON_SHINGLES, COMMON_BYTES = 16_000, 200_000, 100_000


def parity(hashes: np.ndarray, words: int = PARITY_WORDS) -> np.ndarray:
    """So many words: a bit is set where an odd number of hashes fall on its place. Two sets differ in at least as
    many members as their parities do in bits."""
    bits = np.bincount((hashes % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def sized_parities(hashes: np.ndarray, similarity: float) -> list[np.ndarray]:
    """Parities of a set of distinct hashes, of at least four bits a member, in powers of two: sharp for sets of any size.

    Smaller sets that are as similar may have shorter ones, so those are given too (a parity folded in half is the one of half
    the length): any two sets at that similarity have a length in common, that of the smaller one.
    """
    words, least = 1, math.ceil(similarity * len(hashes) - 1e-9)
    while 64 * words < 4 * len(hashes):
        words *= 2
    found = [parity(hashes, words)]
    while words > 1 and 4 * least <= 32 * words:
        words //= 2
        found.append(found[-1][:words] ^ found[-1][words:])
    return found


def may_be_similar(similarity: float) -> Near:
    """False only for sets that are less similar. Rows are the size of a set and its parity.

    Sets of a and b members with that similarity differ in at most (a + b)(1 - s) / (1 + s) members, and neither has
    under s times the members of the other.
    """
    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a, b = x[..., 0].astype(float), y[..., 0].astype(float)
        differ = np.bitwise_count(x[..., 1:] ^ y[..., 1:]).sum(axis=-1, dtype=np.int64)
        return (differ <= (a + b) * (1 - similarity) / (1 + similarity) + 1e-6) & (np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-6)

    return near


def of_two_classes(near: Near) -> Near:
    """Rows begin with their class: those of one class are joined already and need no link."""
    return lambda x, y: (x[..., 0] != y[..., 0]) & near(x[..., 1:], y[..., 1:])


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Of a set's distinct hashes, in ascending order, as many as any set of at least that similarity must share one of.

    A similar set holds ceil(similarity * n) of the n hashes at least. So if the same order is used for all sets, the first
    n - ceil(similarity * n) + 1 of two similar sets have one in common. Which order is free: those of `common` come last,
    by how `often` they were seen.
    """
    kept = len(hashes) - math.ceil(similarity * len(hashes) - 1e-9) + 1
    if len(common) and len(hashes):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        hashes = hashes[np.argsort(np.where(common[at] == hashes, often[at], 0), kind="stable")]
    return hashes[:kept]


def common_shingles(docs: DataFrame, shingle: int, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in 2 or more of about COMMON_TEXTS texts taken by hash, ascending, and in how many: at most
    COMMON_SHINGLES reach the driver. They only set an order, so a sample does."""
    share = min(1.0, COMMON_TEXTS / max(1, docs.count()))
    key = F.pmod(F.xxhash64(text_col), F.lit(1 << 30))
    given = (docs.where((key < int(share * (1 << 30))) & (F.octet_length(F.col(text_col)) <= COMMON_BYTES))
             .select(F.col(text_col).cast("binary").alias("data")).distinct())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found = [np.unique(shingle_hashes(x, shingle)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["h"])

    seen = (given.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n >= 2")
            .orderBy(F.col("n").desc(), "h").limit(COMMON_SHINGLES).toArrow())
    common, often = np.asarray(seen.column(0)).view(np.uint64), np.asarray(seen.column(1))
    order = np.argsort(common)
    return common[order], often[order]


def sketches(docs: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, raw, words_key, n, print, f, keys): hashes of text and word sequence, the number of distinct shingles, their
    SimHash `fingerprint`, their number and parity, and the hashes of their `prefix`."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("raw"), F.col(text_col).cast("binary").alias("data"))
    common, often = common_shingles(docs, shingle, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in slices(batches, 256):
            names, counts, prints, f, keys = [], [], [], [], []
            for data in batch.column(2).to_pylist():
                hashes = np.unique(shingle_hashes(data, shingle))
                names.append(xxhash.xxh3_128_hexdigest(b" ".join((data or b"").lower().split())))
                counts.append(len(hashes))
                prints.append(fingerprint(hashes))
                f.append(np.concatenate([[np.uint64(len(hashes))], parity(hashes)]).view(np.int64))
                keys.append(prefix(hashes, similarity, common, often).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(counts, pa.int64()),
                                              pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(f, longs), pa.array(keys, longs)],
                                             ["doc_id", "raw", "words_key", "n", "print", "f", "keys"])

    return given.mapInArrow(run, f"doc_id {given.schema[0].dataType.simpleString()}, raw long, words_key string, n long, print long, f array<long>, keys array<long>")


def near_components(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, radius: int = 4, part_shingles: int = 1_000_000,
                    part_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, raw, component) per row of docs: texts whose sets of word shingles have a Jaccard similarity of at least `similarity`
    are linked; component is the same for all that links join.

    SimHash comes first: texts whose fingerprints are within `radius` bits meet in blocks, and an exact comparison of shingles
    decides. What that joins is a class. Fingerprints cannot promise every pair, so those between classes are then searched
    exactly: two sets at 0.8 share one of the shingles of their prefixes, about a fifth of each set, rare ones first. What meets
    there and cannot be ruled out by size and parity is joined; components of over `part_shingles` shingles are looked
    at again by parities as long as their sets need. What is left is compared shingle by shingle as well, so no pair is missed and
    no two texts are linked which are less similar. Texts with equal words are one node. Null, empty and blank texts have
    equal words (none). raw is a hash of the text.
    """
    def similar(links: DataFrame, purpose: str) -> DataFrame:
        """Of nodes that these links join, the links between those that are as similar as that."""
        rough = written(components(links), "rough")
        members = written(_refined(docs, rows, nodes.join(rough, "node").select("node", "n", "root"), similarity, shingle,
                                   part_shingles, part_words, id_col, text_col), "members")
        pairs = written(_verified(docs, rows, members, similarity, shingle, part_shingles, id_col, text_col), purpose)
        drop_written(rough)
        drop_written(members)
        let_shuffles_go(docs.sparkSession)
        return pairs

    found = written(sketches(docs, similarity, shingle, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    rows = written(found.select("row", "doc_id", "raw", "words_key"), "rows")
    nodes = written(found.groupBy("words_key").agg(F.min("row").alias("node"), F.min("n").alias("n"), F.min("print").alias("print")), "nodes")
    by_print = similar(_near_prints(nodes, radius), "by-print")
    classes = written(components(by_print).select(F.col("node").alias("row"), F.col("root").alias("class")), "classes")
    by_prefix = similar(_may_meet(found, nodes, classes, similarity), "by-prefix")
    drop_written(found)
    joined = written(components(by_print.union(by_prefix)).select(F.col("node").alias("member"), F.col("root").alias("r")), "joined")
    for done in (classes, by_print, by_prefix):
        drop_written(done)
    let_shuffles_go(docs.sparkSession)
    ids = (nodes.join(joined, F.col("node") == F.col("member"), "left")
           .select(F.col("words_key").alias("w"), F.coalesce("r", "node").alias("component")))
    return rows.join(ids, F.col("words_key") == F.col("w")).select("doc_id", "raw", "component")


def _near_prints(nodes: DataFrame, radius: int) -> DataFrame:
    """Links between nodes(node, n, print) whose fingerprints are at most `radius` bits apart, as in `simhash_components`.

    Nodes of one fingerprint hang on the smallest of them, which alone goes into the blocks.
    """
    own = nodes.where("n > 0").select("node", "print")
    first = own.groupBy("print").agg(F.min("node").alias("first"))
    equal = own.join(first, "print").where(F.col("node") != F.col("first")).select(F.col("node").alias("a"), F.col("first").alias("b"))
    blocks, agreeing = block_scheme(first.count(), radius)
    keyed = first.select(F.explode(block_keys(F.col("print"), blocks, agreeing)).alias("key"), F.col("first").alias("node"), F.array("print").alias("f"))
    return equal.union(bucket_links(keyed, within(radius)))


def _may_meet(found: DataFrame, nodes: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Links between nodes of different classes(row, class) that share a key of their prefixes and may be similar by size and parity.

    A node without a class is one of its own. Keys travel with two numbers alone until it is known which stand in several classes
    (most stand in one). Then sketches are joined: short ones for sets of up to SHORT_SHINGLES, whole ones for larger sets. The
    two kinds overlap, so that sets whose sizes are within the similarity of each other meet in one of them.
    """
    own = (found.where("n > 0").join(nodes.select(F.col("node").alias("row")), "row", "left_semi").join(classes, "row", "left")
           .withColumn("class", F.coalesce("class", "row")))
    keyed = own.select(F.col("row").alias("node"), "class", F.explode("keys").alias("key"))
    same = Window.partitionBy("key")
    met = (keyed.withColumns({"count": F.count("*").over(same), "low": F.min("class").over(same), "high": F.max("class").over(same)})
           .where("low < high").select("node", "key", "count"))
    folds = [reduce(lambda a, b: a.bitwiseXOR(b), (F.col("f")[1 + i] for i in range(w, PARITY_WORDS, SHORT_WORDS))) for w in range(SHORT_WORDS)]
    sketch = own.select(F.col("row").alias("node"), "class", "n", "f")
    short = sketch.where(F.col("n") <= SHORT_SHINGLES).select("node", F.array(F.col("class"), F.col("f")[0], *folds).alias("f"))
    long = sketch.where(F.col("n") >= int(similarity * SHORT_SHINGLES)).select("node", F.concat(F.array("class"), "f").alias("f"))
    links = [counted_links(met.join(kind, "node"), of_two_classes(may_be_similar(similarity))) for kind in (short, long)]
    return links[0].union(links[1])


def _texts(docs: DataFrame, found: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, data): one text per node of `members`, that of the row it is named after; repeated rows repeat it."""
    chosen = (found.join(members.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), "raw", F.col("doc_id").alias("id")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).cast("binary").alias("data"))
    return texts.join(chosen, (F.col("hash") == F.col("raw")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("node", "data")


def _refined(docs: DataFrame, found: DataFrame, members: DataFrame, similarity: float, shingle: int, part_shingles: int,
             part_words: int, id_col: str, text_col: str) -> DataFrame:
    """members(node, n, root) with finer roots where a component has over `part_shingles` shingles.

    There sets meet by component and length of their `sized_parities`, a sixteenth of what the sets take or less, and are joined
    anew where size and parity cannot rule them out: no similar pair parts. Groups of over `part_words` words are cut into
    parts, each pair of parts being a group.
    """
    large = written(members.groupBy("root").agg(F.sum("n").alias("shingles")).where(F.col("shingles") > part_shingles).select("root"), "large")
    wide = members.join(large, "root", "left_semi")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            names, words, f = [], [], []
            for node, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = np.unique(shingle_hashes(data, shingle))
                for bits in sized_parities(hashes, similarity):
                    names.append(node)
                    words.append(len(bits))
                    f.append(np.concatenate([[np.uint64(len(hashes))], bits]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(words, pa.int64()), pa.array(f, pa.list_(pa.int64()))],
                                             ["node", "words", "f"])

    sets = (_texts(docs, found, wide, id_col, text_col).mapInArrow(run, "node long, words long, f array<long>")
            .dropDuplicates(["node", "words"]))
    keyed = written(sets.join(wide.select("node", "root"), "node"), "parities")
    parts = keyed.groupBy("root", "words").agg(F.ceil(F.sum("words") / part_words).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    groups = (keyed.join(parts, ["root", "words"]).withColumn("part", part)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .groupBy("root", "words", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
              .agg(F.collect_list(F.struct("node", "f")).alias("rows")).select("rows"))
    finer = components(_compared(groups, T.LongType(), may_be_similar(similarity), at_once=1))
    drop_written(keyed)
    return (members.join(large, "root", "left_anti").select("node", "n", "root")
            .union(members.select("node", "n").join(finer, "node").select("node", "n", "root")))


def _verified(docs: DataFrame, found: DataFrame, members: DataFrame, similarity: float, shingle: int, part_shingles: int,
              id_col: str, text_col: str) -> DataFrame:
    """Links (a, b) between nodes that are as similar as that, found within the rough components of members(node, n, root).

    A component with many shingles is cut into parts, and each pair of parts is a group: no task holds a component.
    """
    parts = members.groupBy("root").agg(F.ceil(F.sum("n") / part_shingles).cast("int").alias("parts"))
    own = _texts(docs, found, members, id_col, text_col)

    def hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            sets = [np.unique(shingle_hashes(x, shingle)).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "h"])

    sets = own.mapInArrow(hashes, "node long, h array<long>").dropDuplicates(["node"])
    part = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")
    groups = (sets.join(members.select("node", "root").join(parts, "root"), "node").withColumn("part", part)
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .groupBy("root", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
              .agg(F.collect_list(F.struct("node", "h")).alias("rows")).where(F.size("rows") > 1).select("rows"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            flat = batch.column(0).flatten()
            nodes, lists = np.asarray(flat.field(0)), flat.field(1)
            offsets = np.asarray(lists.offsets, np.int64)
            a, b = similar_within(np.asarray(lists.flatten()), offsets - offsets[0], similarity)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[a], pa.int64()), pa.array(nodes[b], pa.int64())], ["a", "b"])

    return groups.mapInArrow(compare, "a long, b long")


def similar_within(hashes: np.ndarray, offsets: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the rows whose sets hashes[offsets[i]:offsets[i + 1]] have at least that Jaccard similarity.

    A row is compared with the rows not reached yet, by marking its hashes and counting marks in theirs.
    """
    _, numbers = np.unique(hashes, return_inverse=True)
    sizes = np.diff(offsets)
    marks = np.zeros(int(numbers.max(initial=-1)) + 1, np.int64)
    rest, left, right = np.flatnonzero(sizes > 0), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    inside = np.concatenate([numbers[offsets[i]:offsets[i + 1]] for i in rest]) if len(rest) else numbers[:0]
    while len(rest):
        root, reached = rest[0], [int(rest[0])]
        inside, rest = inside[sizes[root]:], rest[1:]
        while reached and len(rest):
            row = reached.pop()
            own = numbers[offsets[row]:offsets[row + 1]]
            marks[own] = 1
            both = np.add.reduceat(marks[inside], np.cumsum(sizes[rest]) - sizes[rest])
            marks[own] = 0
            near = both >= similarity * (sizes[rest] + sizes[row] - both) - 1e-9
            if near.any():
                left.append(np.full(int(near.sum()), root))
                right.append(rest[near])
                reached += rest[near].tolist()
                inside = inside[np.repeat(~near, sizes[rest])]
                rest = rest[~near]
    return np.concatenate(left), np.concatenate(right)


def without_near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id",
                            text_col: str = "text", **more) -> DataFrame:
    """The rows of docs that stay: of each component of `near_components` the one with the smallest doc_id.

    A null doc_id counts as larger than any; rows with one id go by the hash of their texts; of repeated rows one stays. All
    columns are kept. An empty table stays empty.
    """
    found = near_components(docs, similarity, shingle, id_col=id_col, text_col=text_col, **more)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "raw")).alias("first")
    given_id, given_raw, digest = free_names(docs, "id", "raw", "digest")
    stay = found.groupBy("component").agg(first).select(F.col("first.doc_id").alias(given_id), F.col("first.raw").alias(given_raw))
    keyed = docs.withColumn(digest, F.xxhash64(text_col))
    kept = keyed.join(stay, (F.col(digest) == F.col(given_raw)) & F.col(id_col).eqNullSafe(F.col(given_id)), "left_semi")
    return kept.dropDuplicates([id_col, digest]).select(*docs.columns)
