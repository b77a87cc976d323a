"""Text quality: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

A word has two marks, each hashed into a table of fixed size: its lower-case core, and its shape (case, length and
the signs around the core). Every mark has a fixed sparse ternary index vector. Its context vector is the sum of the
index vectors of its neighbours over the whole corpus, which Spark adds up from the sums of each task. All sums
are whole numbers, so the vectors do not depend on the order of rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm.common import sampled, slices
from tidelog.llm.tokens import let_go, utf8

BUCKETS, DIMS, NONZERO = 8192, 32, 6
_KEPT = 150_000


def index_vectors(seed: int = 11) -> np.ndarray:
    """The fixed ternary vector of each mark: `NONZERO` of its components are 1 or -1."""
    random = np.random.default_rng(seed)
    places = random.random((BUCKETS, DIMS)).argsort(axis=1)[:, :NONZERO]
    out = np.zeros((BUCKETS, DIMS), np.float32)
    np.put_along_axis(out, places, random.choice([-1.0, 1.0], (BUCKETS, NONZERO)).astype(np.float32), axis=1)
    return out


class Marks(dict):
    """Both marks of a word in one number, remembered for the frequent ones: a full table is begun anew."""

    def __init__(self):
        self.shapes = Shapes()

    def of(self, texts: list[list[str]], count: int) -> np.ndarray:
        """[core, shape] of each word of all texts."""
        both = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int32, count)
        return np.stack([both // BUCKETS, both % BUCKETS], axis=1)

    def __missing__(self, word: str) -> int:
        core, before, after = word, "", ""
        if not word.isalnum():  # signs around the core
            while core and not core[-1].isalnum():
                core = core[:-1]
            while core and not core[0].isalnum():
                core = core[1:]
            at = word.find(core) if core else 0
            before, after = word[:at][-4:], word[at + len(core):][:4]
        case = ("lower" if core.islower() else "digits" if core.isdigit() else "upper" if len(core) > 1 and core.isupper()
                else "title" if core[:1].isupper() else "mixed" if core else "none")
        mark = zlib.crc32(core.lower().encode("utf-8", "replace")) % BUCKETS * BUCKETS + self.shapes[case, min(len(core), 24) // 4, before, after]
        if len(self) >= _KEPT:
            self.clear()
        self[word] = mark
        return mark


class Shapes(dict):
    """The mark of (case, length, signs before, signs after): there are few, and most words that are seen once share them."""

    def __missing__(self, shape: tuple[str, int, str, str]) -> int:
        if len(self) >= _KEPT:
            self.clear()
        self[shape] = mark = zlib.crc32(" ".join(map(str, shape)).encode("utf-8", "replace")) % BUCKETS
        return mark


def _documents(texts: list[str], marks: Marks) -> tuple[np.ndarray, np.ndarray]:
    """Marks of all words of the texts, and where each text begins."""
    words = [text.split() for text in texts]
    starts = np.cumsum([0] + [len(w) for w in words])
    return marks.of(words, int(starts[-1])), starts


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The unit context vector of each mark, from all documents: BUCKETS x DIMS numbers reach the driver, no more."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        index, marks, sums = index_vectors(), Marks(), np.zeros((DIMS, BUCKETS))
        for batch in slices(batches, 128):
            found, starts = _documents(batch.column(0).to_pylist(), marks)
            if not len(found):
                continue
            around = _around(index[found[:, 0]] + index[found[:, 1]], starts)
            for dim in range(DIMS):
                for mark in (0, 1):
                    sums[dim] += np.bincount(found[:, mark], around[:, dim], BUCKETS)
        used = np.flatnonzero(np.abs(sums).sum(axis=0))
        values = pa.FixedSizeListArray.from_arrays(pa.array(sums.T[used].astype(np.int64).ravel()), DIMS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), values], ["mark", "v"])

    parts = docs.select(utf8(text_col)).mapInArrow(run, "mark int, v array<long>")
    total = parts.groupBy("mark").agg(F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(DIMS))).alias("v")).toArrow()
    out = np.zeros((BUCKETS, DIMS), np.float32)
    if len(total):
        values = np.asarray(total.column(1).combine_chunks().flatten(), float).reshape(-1, DIMS)
        out[np.asarray(total.column(0))] = values / np.maximum(1e-9, np.sqrt((values * values).sum(axis=1)))[:, None]
    return out


def _around(vectors: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of the vectors just before and just after each word of the same text."""
    out = np.zeros_like(vectors)
    out[1:] += vectors[:-1]
    out[:-1] += vectors[1:]
    for inner in starts[(starts > 0) & (starts < len(vectors))]:  # what came over the border of two texts
        out[inner] -= vectors[inner - 1]
        out[inner - 1] -= vectors[inner]
    return out


def features(texts: list[str], tables: np.ndarray, marks: Marks) -> np.ndarray:
    """A row per text: pooled word vectors, pooled products of neighbours, and the logarithm of the number of words.

    tables: the context vector and the index vector of each mark side by side. An empty or blank text has zeros. Sums
    run over the whole text.
    """
    found, starts = _documents(texts, marks)
    n = np.diff(starts)
    out = np.zeros((len(texts), 4 * DIMS + 2), np.float32)
    if not len(found):
        return out
    some = np.flatnonzero(n > 0)
    core, shape = tables[found[:, 0]], tables[found[:, 1]]  # context vector, then index vector
    beside = np.zeros((len(found), DIMS), np.float32)
    np.multiply(core[:-1, DIMS:], core[1:, DIMS:], out=beside[:-1])
    beside[starts[1:][some] - 1] = 0.0
    pooled = [np.add.reduceat(part, starts[some], axis=0) / n[some, None] for part in (core, shape, beside)]
    out[some, :DIMS] = pooled[0][:, :DIMS]
    out[some, DIMS:3 * DIMS] = pooled[1]
    out[some, 3 * DIMS:4 * DIMS] = pooled[2]
    out[some, -2] = np.sqrt((pooled[0][:, DIMS:] ** 2).sum(axis=1))
    out[:, -1] = np.log1p(n)
    return out


@dataclass
class Model:
    contexts: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]  # w1, b1, w2, b2; empty: `constant` is every score
    temperature: float = 1.0
    constant: float = 0.5

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(rows), self.constant)
        return _sigmoid(_logits((rows - self.mean) / self.scale, self.layers) / self.temperature)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logits(rows: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    w1, b1, w2, b2 = layers
    return np.tanh(rows @ w1 + b1) @ w2 + b2


def fit(rows: np.ndarray, labels: np.ndarray, contexts: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 128,
        rate: float = 3e-3, decay: float = 1e-3, seed: int = 5) -> Model:
    """Trains on four fifths of the rows by Adam; the temperature is what makes the rest likeliest."""
    rows, labels = rows.astype(float), labels.astype(float)
    if len(np.unique(labels)) < 2:
        return Model(contexts, np.zeros(1), np.ones(1), [], constant=float(labels.mean()) if len(labels) else 0.5)
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    check, train = order[:len(rows) // 5], order[len(rows) // 5:]
    mean, scale = rows[train].mean(axis=0), np.maximum(rows[train].std(axis=0), 1e-6)
    x = (rows - mean) / scale
    layers = [random.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, hidden ** -0.5, hidden), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(epochs):
        for some in np.array_split(random.permutation(train), max(1, len(train) // batch)):
            step += 1
            h = np.tanh(x[some] @ layers[0] + layers[1])
            error = (_sigmoid(h @ layers[2] + layers[3]) - labels[some]) / len(some)
            back = np.outer(error, layers[2]) * (1 - h * h)
            slopes = [x[some].T @ back + decay * layers[0], back.sum(axis=0), h.T @ error + decay * layers[2], np.array([error.sum()])]
            for p, g, m, v in zip(layers, slopes, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    model = Model(contexts, mean, scale, layers)
    if len(check):
        logits, y = _logits(x[check], layers), labels[check]
        tried = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        losses = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in tried]
        model.temperature = float(tried[int(np.argmin(losses))])
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, remainder 0 by 5. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model:
    """Word vectors from all documents, the network from at most `train_rows` labelled ones that are not held out (by hash).

    Null labels and ids are left out; a doc_id with several labels counts with the largest. With one label value
    alone, or without labels, every score is that value, or 0.5.
    """
    contexts = context_vectors(docs, text_col)
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("__y")))
    known = sampled(known, train_rows, "__id")
    given = docs.select(F.col(id_col).alias("__id"), utf8(text_col).alias("__text"))
    rows = given.join(F.broadcast(known), "__id").select("__id", "__y", "__text")  # at most train_rows labels

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        tables, marks = np.hstack([contexts, index_vectors()]), Marks()
        for batch in slices(batches, 128):
            found = features(batch.column(2).to_pylist(), tables, marks)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in found], pa.binary())], ["id", "y", "x"])

    got = rows.mapInArrow(run, "id long, y double, x binary").toArrow()
    order = np.argsort(np.asarray(got.column("id")), kind="stable")  # the same network whatever the order of the rows
    x = np.array([np.frombuffer(v, np.float32) for v in got.column("x").to_pylist()]).reshape(-1, 4 * DIMS + 2)
    return fit(x[order], np.asarray(got.column("y"))[order], contexts)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep.., score, predicted) of every row of docs: the chance of label 1, and whether it reaches the threshold.

    The text alone is scored, whole; null counts as empty, and an empty text has a score as any other. Repeated
    rows are each scored, a null doc_id stays null. An empty table gives no rows.
    """
    kept = [F.col(c).alias(f"__{i}") for i, c in enumerate(keep)]
    given = docs.select(F.col(id_col).alias("doc_id"), *kept, utf8(text_col).alias("__text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        tables, marks = np.hstack([model.contexts, index_vectors()]), Marks()
        for batch in slices(batches, 128):
            found = model.scores(features(batch.column(batch.num_columns - 1).to_pylist(), tables, marks))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.float64())], [*batch.schema.names[:-1], "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:-1]), "score double"])
    return given.mapInArrow(run, schema).select("doc_id", *(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), "score",
                                                (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        tables, marks = np.hstack([model.contexts, index_vectors()]), Marks()
        for batch in slices(batches, 128):
            texts = [text or "" for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(model.scores(features(texts, tables, marks)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
