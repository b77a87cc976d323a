"""Packing of documents into sequences of a fixed window, planned on the histogram of their lengths.

Every document first fills whole windows by itself; what is left of it is shorter than a window. For those rests
the plan is made on their histogram, which has fewer rows than the window has places: combinations of two or three
lengths that fill a window exactly, how often to repeat each by non-negative least squares against the histogram,
rounded and topped up greedily. The few rests that no combination takes are laid end to end and cut at the window.
Nothing but the histogram and the plan ever reaches the driver, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F

from tidelog.llm.common import slices, written
from tidelog.llm.tokens import encoder, utf8


def combinations_filling(window: int, present: np.ndarray) -> np.ndarray:
    """Rows of three lengths (0: none) in descending order that add up to the window, of those `present`."""
    have = np.zeros(window + 1, bool)
    have[present] = True
    have[0] = False
    small, middle = np.meshgrid(np.arange(window // 3 + 1), np.arange(window // 2 + 1), indexing="ij")
    large = window - small - middle
    good = (small <= middle) & (middle <= large) & (have[small] | (small == 0)) & have[middle] & (large < window)
    good[good] = have[large[good]]
    return np.stack([large[good], middle[good], small[good]], axis=1)


def non_negative_least_squares(columns: np.ndarray, histogram: np.ndarray, steps: int) -> np.ndarray:
    """x >= 0 that makes sum(x * column) close to the histogram: the column that gains most is solved at each step.

    A column counts its lengths, so the squares of its entries are known. Few columns become positive, which is
    what rounding needs.
    """
    x = np.zeros(len(columns))
    rest = histogram.astype(float)
    rest[0] = 0.0
    same = (columns[:, 0] == columns[:, 1]).astype(int) + ((columns[:, 1] == columns[:, 2]) & (columns[:, 2] > 0))
    squares = np.where(columns[:, 2] > 0, np.array([3, 5, 9])[same], np.where(same > 0, 4, 2)).astype(float)
    for _ in range(steps if len(columns) else 0):
        move = np.maximum(rest[columns].sum(axis=1) / squares, -x)
        best = int(np.argmax(move * move * squares))
        if abs(move[best]) < 0.25:
            break
        x[best] += move[best]
        np.subtract.at(rest, columns[best], move[best])
        rest[0] = 0.0
    return x


@dataclass
class Plan:
    """What a rest of length r and rank k (among the rests of that length) becomes.

    Ranks below used[r] fall in an interval of `first` (ascending within r, from row[r] to row[r + 1]): sequence
    shift + k at offset `offset`. Other ranks lie end to end from position base[r] on.
    """

    window: int
    used: np.ndarray
    row: np.ndarray
    first: np.ndarray
    shift: np.ndarray
    offset: np.ndarray
    base: np.ndarray
    combined: int  # sequences made of combinations
    laid: int  # ids laid end to end

    def tail_cuts(self) -> np.ndarray:
        """Positions where sequences of the laid ids begin; what is left at the end is cut into powers of two."""
        whole = self.laid // self.window * self.window
        bits = [1 << b for b in reversed(range(self.window.bit_length())) if (self.laid - whole) >> b & 1]
        return whole + np.concatenate([[0], np.cumsum(bits)]).astype(np.int64)

    def sequences(self) -> int:
        """How many sequences the rests take."""
        return self.combined + self.laid // self.window + len(self.tail_cuts()) - 1


def plan(histogram: np.ndarray, window: int, steps: int = 4000) -> Plan:
    """histogram[r]: rests of length r, for 0 < r < window."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    columns = combinations_filling(window, np.flatnonzero(left))
    x = non_negative_least_squares(columns, left, steps)
    repeats = np.zeros(len(columns), np.int64)

    def take(column: int, times: int) -> None:
        lengths, counts = np.unique(columns[column][columns[column] > 0], return_counts=True)
        times = min(times, int((left[lengths] // counts).min()))
        repeats[column] += times
        left[lengths] -= times * counts

    for column in np.argsort(-x, kind="stable")[:np.count_nonzero(x >= 0.5)].tolist():
        take(column, int(x[column] + 0.5))
    need = (columns[:, :, None] == columns[:, None, :]).sum(axis=2)  # how often a combination has each of its lengths
    for _ in range(steps if len(columns) else 0):  # top up what rounding left
        known = np.concatenate([[np.iinfo(np.int64).max], left[1:]])  # length 0 is never short
        times = (known[columns] // need).min(axis=1)
        best = int(np.argmax(times))
        if times[best] < 1:
            break
        take(best, int(times[best]))

    intervals, used, combined = [], np.zeros(window + 1, np.int64), 0
    for lengths, times in zip(columns[repeats > 0].tolist(), repeats[repeats > 0].tolist()):
        at = 0
        for length in filter(None, lengths):
            intervals.append((length, used[length], combined - used[length], at))
            used[length] += times
            at += length
        combined += times
    table = np.array(sorted(intervals), np.int64).reshape(-1, 4)
    amounts = left * np.arange(len(left))
    return Plan(window, used, np.searchsorted(table[:, 0], np.arange(window + 2)), table[:, 1], table[:, 2], table[:, 3],
                np.cumsum(amounts) - amounts, combined, int(amounts.sum()))


def place_rest(plan: Plan, cuts: np.ndarray, length: int, rank: int) -> list[tuple[int, int, int, int]]:
    """(start within the rest, length, sequence, offset) of each piece of a rest."""
    if rank < plan.used[length]:
        low, high = plan.row[length], plan.row[length + 1]
        i = low + int(np.searchsorted(plan.first[low:high], rank, side="right")) - 1
        return [(0, length, int(plan.shift[i]) + rank, int(plan.offset[i]))]
    window, at = plan.window, int(plan.base[length]) + (rank - int(plan.used[length])) * length
    pieces, begin, whole = [], 0, int(cuts[0])
    while begin < length:
        if at < whole:
            sequence, offset, room = at // window, at % window, window - at % window
        else:
            i = int(np.searchsorted(cuts, at, side="right")) - 1
            sequence, offset, room = whole // window + i, at - int(cuts[i]), int(cuts[i + 1]) - at
        some = min(room, length - begin)
        pieces.append((begin, some, plan.combined + sequence, offset))
        begin, at = begin + some, at + some
    return pieces


def _before(amount: str, order: WindowSpec) -> Column:
    """The sum over all earlier rows."""
    return F.coalesce(F.sum(amount).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, steps: int = 4000,
         id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """(doc_id, start, ids, length, doc_tokens, sequence_id, offset): every id of every document in exactly one piece.

    ids are unsigned 32-bit little-endian. Sequences are full, but for the last ids of all rests: those lie in
    sequences whose lengths are powers of two, which need no padding. Null text is empty (the end id alone);
    repeated rows are packed each; a null doc_id stays null. Other columns are ignored. `added`: see `Encoder`. An empty table gives no
    rows. Ids are written once, with each row's number among its part and length; ranks over all parts follow
    from counts per part and length.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, part = encoder(tokenizer, added), TaskContext.get().partitionId()
        end, counts, windows = np.array([end_id], encoded.kind), np.zeros(window, np.int64), 0
        for batch in slices(batches, 256):
            ids, rows = [], []
            for text in batch.column(1).to_pylist():
                ids.append(np.concatenate([encoded.encode(text), end]))
                rest = len(ids[-1]) % window
                rows.append((part, rest, counts[rest], windows))
                counts[rest] += 1
                windows += len(ids[-1]) // window
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
            data = pa.array([x.tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array([len(x) for x in ids], pa.int64()), data,
                 pa.array([encoded.kind.itemsize] * len(ids), pa.int32())],
                ["doc_id", "part", "rest", "nth", "windows", "n", "ids", "width"])

    encoded = written(given.mapInArrow(encode, "doc_id long, part int, rest int, nth long, windows long, n long, "
                                               "ids binary, width int"), "encoded")
    here = encoded.groupBy("part", "rest").agg(F.count("*").alias("rows"), F.sum(F.floor(F.col("n") / window)).alias("filled"))
    here = written(here, "lengths")
    histogram = np.zeros(window, np.int64)
    for row in here.where("rest > 0").groupBy("rest").agg(F.sum("rows").alias("rows")).collect():  # fewer than `window`
        histogram[row.rest] = row.rows
    made = plan(histogram, window, steps)
    cuts = made.tail_cuts()
    first_filled = made.sequences()
    parts = here.groupBy("part").agg(F.sum("filled").alias("f"))  # a row per part
    filled = parts.select(F.col("part").alias("p"), _before("f", W.orderBy("part")).alias("filled_before"))
    ranks = here.select("part", "rest", _before("rows", W.partitionBy("rest").orderBy("part")).alias("before"))
    known = ranks.join(filled, F.col("part") == F.col("p")).select("part", "rest", "before", "filled_before")
    numbered = encoded.join(known, ["part", "rest"]).select("doc_id", "rest", (F.col("nth") + F.col("before")).alias("rank"),
                                                            (F.col("windows") + F.col("filled_before")).alias("filled"), "n", "ids", "width")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            out = []
            for doc_id, rest, rank, filled, n, ids, width in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, f"<u{width}").astype("<u4")
                for i in range(n // window):
                    out.append((doc_id, i * window, ids[i * window:(i + 1) * window].tobytes(), window, n, first_filled + filled + i, 0))
                for begin, length, sequence, offset in place_rest(made, cuts, rest, rank) if rest else ():
                    begin += n - rest
                    out.append((doc_id, begin, ids[begin:begin + length].tobytes(), length, n, sequence, offset))
            kinds = [pa.binary() if c == 2 else pa.int64() for c in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)],
                                             ["doc_id", "start", "ids", "length", "doc_tokens", "sequence_id", "offset"])

    return numbered.mapInArrow(cut, "doc_id long, start long, ids binary, length long, doc_tokens long, sequence_id long, offset long")
