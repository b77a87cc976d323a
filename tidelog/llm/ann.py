"""Nearest vectors by inner product: a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every row is put into the leaf it falls in. A query opens the leaves in
the order of their bins' distance, from a priority queue over the tree. How many leaves must be opened is measured:
for a set of rows taken as calibration queries, the true nearest rows of the whole table are found by comparing
with every row, and the number of leaves is the smallest that reaches the wanted recall on them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.llm.common import sampled, slices, written

FOUND = "query_id long, vec_id long, score double"
SLACK = 1e-9  # nearer than this, products of the matrix form are compared again in a fixed order


@dataclass
class Tree:
    """Nodes in breadth-first order: children of node i are first[i] .. first[i] + count[i] - 1; a leaf has none."""

    centers: np.ndarray
    first: np.ndarray
    count: np.ndarray
    longest: float  # norm to which the sample's vectors are lifted, see `lifted`

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf that each lifted point falls in, a level at a time for all points."""
        at = np.zeros(len(points), np.int64)
        while True:
            inner = np.flatnonzero(self.count[at])
            if not len(inner):
                return at
            for node in np.unique(at[inner]).tolist():
                rows = inner[at[inner] == node]
                children = self.centers[self.first[node]:self.first[node] + self.count[node]]
                at[rows] = self.first[node] + _distances(points[rows], children).argmin(axis=1)

    def best_bins(self, point: np.ndarray, most: int, rows: np.ndarray, least: int) -> list[int]:
        """Leaves in the order that a priority queue on the bins' distances gives: `most` of them, and more while
        they hold fewer than `least` of the `rows` per leaf. Empty leaves are passed over."""
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < most or held < least):
            _, node = heapq.heappop(queue)
            if not self.count[node]:
                if rows[node]:
                    found.append(node)
                    held += rows[node]
                continue
            low, high = int(self.first[node]), int(self.first[node] + self.count[node])
            for child, far in zip(range(low, high), _distances(point[None], self.centers[low:high])[0].tolist()):
                heapq.heappush(queue, (far, child))
        return found


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (centers * centers).sum(axis=1) - 2 * (points @ centers.T) + (points * points).sum(axis=1)[:, None]


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more component that gives all vectors the norm `longest`: the nearest by distance is then the largest
    inner product. Queries get zero there. A vector that is longer than the sample's longest gets zero too."""
    rest = np.sqrt(np.maximum(0.0, longest * longest - (vectors * vectors).sum(axis=1)))
    return np.hstack([vectors, rest[:, None]])


def fit_tree(sample: np.ndarray, branches: int = 8, leaf_rows: int = 32, rounds: int = 10, seed: int = 7) -> Tree:
    """K-means in each node until a node has at most `leaf_rows` rows of the sample. Size is bounded by the sample."""
    longest = float(np.sqrt((sample * sample).sum(axis=1).max())) if len(sample) else 0.0
    points, random = lifted(sample, longest), np.random.default_rng(seed)
    centers, first, count, members = [np.zeros(points.shape[1])], [0], [0], [np.arange(len(points))]
    node = 0
    while node < len(members):
        rows, members[node] = members[node], None
        if len(rows) > leaf_rows:
            means, group = _means(points[rows], branches, rounds, random)
            if len(means) > 1:
                first[node], count[node] = len(members), len(means)
                for i, mean in enumerate(means):
                    centers.append(mean)
                    first.append(0)
                    count.append(0)
                    members.append(rows[group == i])
        node += 1
    return Tree(np.array(centers), np.array(first), np.array(count), longest)


def _means(points: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    distinct = np.unique(points, axis=0)
    means = distinct[random.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        group = _distances(points, means).argmin(axis=1)
        kept = np.unique(group)
        means = np.array([points[group == i].mean(axis=0) for i in kept])
    return means, _distances(points, means).argmin(axis=1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part.

    Left out: null ids, null or empty vectors, those with a null, NaN or infinite component, zero vectors, and
    those whose length is not the most frequent one (the longer one where two are equally frequent).
    """
    v = F.col(vector_col).cast("array<double>")
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
        " and exists(v, x -> x <> 0)")
    sizes = given.groupBy(F.size("v").alias("n")).count()
    usual = sizes.agg(F.max(F.struct("count", "n")).alias("s")).first().s
    return given.where(F.size("v") == (usual.n if usual else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def _top(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, vec_ids: np.ndarray, k: int) -> list[tuple]:
    """(query_id, vec_id, score) of each query's k nearest of these vectors, itself left out.

    The matrix product picks what can be among them; those scores are computed again row by row, so that equal
    vectors get equal scores wherever they stand, and ties go to the smaller vec_id.
    """
    out, products = [], queries @ vectors.T
    for i, query_id in enumerate(ids.tolist()):
        row = np.where(vec_ids == query_id, -np.inf, products[i])
        near = np.flatnonzero(row > -np.inf)
        if len(near) > k:
            near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k] - SLACK * max(1.0, np.abs(row[near]).max()))
            near = near[row[near] > -np.inf]
        scores = (vectors[near] * queries[i]).sum(axis=1)
        for j in np.lexsort((vec_ids[near], -scores))[:k].tolist():
            out.append((query_id, int(vec_ids[near[j]]), float(scores[j])))
    return out


def _blocks(rows: DataFrame, by: list[str], block: int, names: tuple[str, str]) -> DataFrame:
    """(by.., ids, vectors): rows of one group packed together, at most about `block` in a row."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / block).cast("int").alias("__parts"))
    cut = (rows.join(sizes, by).withColumn("__part", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("__parts")))
           .groupBy(*by, "__part").agg(F.collect_list(F.struct("vec_id", "v")).alias("__rows")))
    return cut.select(*by, F.col("__rows.vec_id").alias(names[0]), F.flatten("__rows.v").alias(names[1]))


def search(vectors: DataFrame, is_query, k: int = 20, recall: float = 0.97, sample_rows: int = 20_000,
           calibration_rows: int = 200, branches: int = 8, leaf_rows: int = 512, block: int = 2048,
           id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row for which is_query(id column) holds.

    Candidates are all rows but the query's own id; scores are exact inner products in double precision, ties go
    to the smaller vec_id; with fewer than k candidates in the table all are returned. Which rows take part:
    `usable`. Rows that repeat an id with the same vector count once; with different vectors, each is a candidate and a
    query's results are those of all its vectors. Other columns are ignored. Empty in, empty out.

    Small leaves pay where vectors form many tight clusters; where they do not, most leaves must be opened anyway, and large
    leaves (`leaf_rows` rows of the sample) make fewer and larger matrix products of the same comparisons.

    Bounds: the tree's sample (`sample_rows` rows, by hash) and the calibration queries (`calibration_rows`, by
    another hash) are on the driver; the tree has fewer nodes than the sample has rows. All rows are indexed.
    A leaf or its queries of more than `block` rows are several blocks, so a leaf may hold any share of the rows.
    """
    known = written(usable(vectors, id_col, vector_col).dropDuplicates(), "vectors")
    spark = known.sparkSession
    sample = sampled(known, sample_rows, "vec_id", "v").select("v").toArrow().column(0).combine_chunks()
    tree = fit_tree(_matrix(sample) if len(sample) else np.zeros((0, 1)), branches, leaf_rows)

    def to_leaf(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            leaf = tree.leaf_of(lifted(_matrix(batch.column(1)), tree.longest))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], ["vec_id", "v", "leaf"])

    indexed = written(known.mapInArrow(to_leaf, "vec_id long, v array<double>, leaf long"), "leaves")
    rows = np.zeros(len(tree.centers), np.int64)
    for found in indexed.groupBy("leaf").count().collect():  # at most a row per leaf of the tree
        rows[found.leaf] = found["count"]
    repeats = indexed.groupBy("vec_id").count().agg(F.max("count").alias("n")).first().n or 1
    probes = _probes(tree, indexed, rows, k, recall, calibration_rows)

    def to_bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            owners, leaves = [], []
            for i, v in enumerate(_matrix(batch.column(1))):
                bins = tree.best_bins(np.append(v, 0.0), probes, rows, k + repeats)
                owners += [i] * len(bins)
                leaves += bins
            take = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(leaves, pa.int64())],
                                             ["vec_id", "v", "leaf"])

    visits = known.where(is_query(F.col("vec_id"))).mapInArrow(to_bins, "vec_id long, v array<double>, leaf long")
    pairs = (_blocks(visits, ["leaf"], block, ("query_ids", "queries"))
             .join(_blocks(indexed, ["leaf"], block, ("vec_ids", "vectors")), "leaf"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            ids, queries, vec_ids, vectors = (np.asarray(batch.column(i).flatten()) for i in range(4))
            dim = len(queries) // len(ids)
            found = _top(queries.reshape(-1, dim), ids, vectors.reshape(-1, dim), vec_ids, k)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))]
                                             if found else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())],
                                             ["query_id", "vec_id", "score"])

    found = pairs.select("query_ids", "queries", "vec_ids", "vectors").mapInArrow(compare, FOUND)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact(queries: np.ndarray, ids: np.ndarray, indexed: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, leaf): the k nearest of a few queries among all rows of `indexed`, by comparing with each."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in slices(batches, 2048):
            vec_ids, leaf = np.asarray(batch.column(0)), np.asarray(batch.column(2))
            leaf_of = dict(zip(vec_ids.tolist(), leaf.tolist()))
            best += [(*row, leaf_of[row[1]]) for row in _top(queries, ids, _matrix(batch.column(1)), vec_ids, k)]
            best.sort(key=lambda r: (r[0], -r[2], r[1]))
            best = [row for i, row in enumerate(best) if i < k or best[i - k][0] != row[0]]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([row[c] for row in best], kind) for c, kind in enumerate(kinds)],
                                         ["query_id", "vec_id", "score", "leaf"])

    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return (indexed.select("vec_id", "v", "leaf").mapInArrow(run, FOUND + ", leaf long")
            .withColumn("rank", rank).where(F.col("rank") <= k))


def _probes(tree: Tree, indexed: DataFrame, rows: np.ndarray, k: int, recall: float, calibration_rows: int) -> int:
    """The smallest number of leaves with which the calibration queries find `recall` of their true k nearest.

    Opening is widened a leaf at a time; what counts is the place of each true neighbour's leaf in its query's order.
    """
    asked = sampled(indexed, calibration_rows, "vec_id").select("vec_id", "v").toArrow()
    if not len(asked):
        return 1
    ids, queries = np.asarray(asked.column(0)), _matrix(asked.column(1).combine_chunks())
    order = {i: {leaf: place for place, leaf in enumerate(tree.best_bins(np.append(v, 0.0), len(rows), rows, 0))}
             for i, v in zip(ids.tolist(), queries)}
    places = sorted(order[r.query_id][r.leaf] for r in exact(queries, ids, indexed, k).collect())
    return places[max(0, int(np.ceil(recall * len(places))) - 1)] + 1 if places else 1
