"""Cooldown: per key, an event passes only some seconds after the last one that passed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidelog.functions.values import micros
from tidelog.session import cut_lineage

FAN = 16  # block maps that are composed at once
NEVER = -(1 << 62)  # a key that let nothing pass yet is free since then
MAP = "_key string, _node bigint, _entries array<bigint>, _lasts array<bigint>"


def _collapsed(entries: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of neighbouring entries with one outcome the last says it all."""
    keep = np.append(lasts[1:] != lasts[:-1], True)
    return entries[keep], lasts[keep]


def composed(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], pause: int,
             reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The map of two neighbouring stretches of time from their maps.

    A map (entries, lasts) is a step function: a key that is free from some time on has, at the end, lasts[i] as its last passing
    event, entries[i] being the smallest entry that isn't before that time; beyond all entries nothing passes. `reach`
    is the latest time from which the key can be free: entries after the first one beyond it are never looked up.
    """
    (entries, lasts), (entries_2, lasts_2) = first, second
    at = np.searchsorted(entries_2, lasts + pause, side="left")
    through = np.where(at < len(entries_2), lasts_2[np.minimum(at, len(entries_2) - 1)], lasts)
    late = np.searchsorted(entries_2, entries[-1], side="right")  # who is free only then meets the second stretch alone
    entries, lasts = np.append(entries, entries_2[late:]), np.append(through, lasts_2[late:])
    end = int(np.searchsorted(entries, reach, side="left")) + 1
    return _collapsed(entries[:end], lasts[:end])


def _chain_ends(times: np.ndarray, pause: int) -> np.ndarray:
    """For each time, the index of the last passing event if that time passes."""
    n = len(times)
    if times[-1] - times[0] < pause:  # nothing passes after the first one
        return np.arange(n)
    following = np.searchsorted(times, times + pause, side="left")
    jump = np.where(following < n, following, np.arange(n))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


def _blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, np.ndarray]]:
    """Times per (key, block) out of batches sorted by key, block and time."""
    current, pieces = None, []
    for pdf in batches:
        keys, blocks, us = pdf["_key"].to_numpy(), pdf["_block"].to_numpy(), pdf["_us"].to_numpy()
        edges = np.flatnonzero((keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for first, last in zip(np.append(0, edges), np.append(edges, len(us))):
            if first == last:
                continue
            group = (keys[first], blocks[first])
            if group != current:
                if current is not None:
                    yield (*current, np.concatenate(pieces))
                current, pieces = group, []
            pieces.append(us[first:last])
    if current is not None:
        yield (*current, np.concatenate(pieces))


def _gather(rows: Iterator[tuple], size: int = 4000) -> Iterator[pd.DataFrame]:
    """Maps (key, node, entries, lasts) as frames."""
    while held := list(islice(rows, size)):
        yield _plain(pd.DataFrame(held, columns=["_key", "_node", "_entries", "_lasts"]))


def _plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Keys as Python text: chunked string columns cannot be sent back."""
    return pdf.astype({"_key": object})


def throttle(df: DataFrame, keys: Sequence[str], ts: str, seconds: float, order: Sequence[str],
             block_seconds: float | None = None) -> DataFrame:
    """Rows of `df` that pass the cooldown, in time order per key.

    Of events of a key at one time, the first by `order` passes, and one alone also where `order` ties.
    Which event passes depends on the one before, so the chain is cut into blocks of time:
    1. per (key, block): a map from the time since which the key is free to the last event that passes then;
    2. maps of FAN neighbouring blocks are composed to one, these again, and so on up to one map per key; then the times
       at which stretches are entered are handed down the same way. No task sees more of a key than FAN maps,
       and a map has no more steps than there are distinct times in one pause;
    3. per (key, block): the chain from its entry.
    Only distinct times are moved; a block holds at most one per microsecond of its length. A key within one block is free from
    the start and needs no second step.
    """
    if not order:
        raise ValueError("order is needed: of events at one time only one passes")
    keys, order = list(keys), list(order)
    pause = int(seconds * 1_000_000)
    block = int((block_seconds or max(3600.0, 10 * seconds)) * 1_000_000)
    packed = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    # Three steps read the events; they are computed once, into the checkpoint folder.
    rows = cut_lineage(df.withColumn("_key", packed).withColumn("_us", micros(ts)))
    timeless = rows.filter(F.col("_us").isNull()).drop("_key", "_us")  # no pause to measure: they pass
    rows = rows.filter(F.col("_us").isNotNull())
    passing = passing_times(rows.select("_key", "_us"), pause, block)
    # Of several events at the passing time, the first in `order`; rows that tie there go by a hash of all columns.
    comparable = [c for c, kind in df.dtypes if not kind.startswith(("map", "variant"))]
    found = (rows.withColumn("_tie", F.struct(*order, F.xxhash64(*comparable).alias("_row")))
             .join(passing, ["_key", "_us"], "left_semi"))
    first = found.groupBy("_key", "_us").agg(F.min("_tie").alias("_tie"))
    same = [found[c].eqNullSafe(first[c]) for c in ("_key", "_us", "_tie")]
    return (found.join(first, same, "left_semi").dropDuplicates(["_key", "_us"]).drop("_key", "_us", "_tie")
            .unionByName(timeless))


def passing_times(times: DataFrame, pause: int, block: int) -> DataFrame:
    """The distinct (_key, _us) of `times` that pass: steps 1 to 3 of `throttle`. No null times; lengths in microseconds.

    `times` is read three times and may repeat rows.
    """
    numbered = times.withColumn("_block", F.floor(F.col("_us") / block).cast("bigint"))
    span = numbered.agg(F.min("_block"), F.max("_block")).first()
    if span[0] is None:
        return times.select("_key", "_us")
    lowest, blocks = span[0], numbered.distinct()

    def outcomes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def steps() -> Iterator[tuple]:
            for key, number, us in _blocks_of(batches):
                if len(us) == 1:
                    yield key, number - lowest, us, us
                    continue
                ends = us[_chain_ends(us, pause)]
                # What passed before lies ahead of the block, so an entry lies at most one pause
                # inside it, or is the first event after that.
                reach = min(len(us), int(np.searchsorted(us, number * block + pause, side="left")) + 1)
                entry, last = us[:reach], ends[:reach]
                entry, last = _collapsed(entry, last)
                yield key, number - lowest, entry, last
        return _gather(steps())

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = None
        for pdf in batches:
            keys_, us, entered = pdf["_key"].to_numpy(), pdf["_us"].to_numpy(), pdf["_entered"].to_numpy()
            starts, since = np.flatnonzero(entered), pdf["_from"].to_numpy()
            picked = []
            for first, last in zip(np.append(0, starts), np.append(starts, len(us))):
                if first < last and entered[first]:
                    free = int(since[first])
                    first += 1
                while first < last:
                    first += int(np.searchsorted(us[first:last], free, side="left"))
                    if first < last:
                        picked.append(first)
                        free = int(us[first]) + pause
                        first += 1
            yield _plain(pd.DataFrame({"_key": keys_[picked], "_us": us[picked]}))

    maps = cut_lineage(blocks.repartition("_key", "_block").sortWithinPartitions("_key", "_block", "_us").mapInPandas(outcomes, MAP))
    entries = (_entered(maps, pause, block, lowest, span[1] - lowest + 1)
               .select("_key", (F.col("_node") + lowest).alias("_block"), "_from"))
    # A block's entry precedes its events, so one sorted pass sees both.
    marked = (blocks.withColumn("_from", F.lit(0).cast("bigint")).withColumn("_entered", F.lit(False))
              .unionByName(entries.withColumn("_us", F.lit(0).cast("bigint")).withColumn("_entered", F.lit(True))))
    return (marked.repartition("_key", "_block").sortWithinPartitions("_key", "_block", F.desc("_entered"), "_us")
            .mapInPandas(chain, "_key string, _us bigint"))


def _entered(maps: DataFrame, pause: int, block: int, lowest: int, nodes: int) -> DataFrame:
    """(_key, _node, _from): since when the key is free as each of its blocks begins."""
    several = maps.groupBy("_key").count().filter(F.col("count") > 1).select("_key")
    free = F.lit(NEVER).cast("bigint").alias("_from")
    alone = maps.join(several, "_key", "left_anti").select("_key", "_node", free)
    levels, width = [maps.join(several, "_key", "left_semi")], FAN
    while width < nodes:
        levels.append(cut_lineage(_composed_level(levels[-1], pause, block * width, lowest * block)))
        width *= FAN
    entered = levels[-1].select("_key", F.floor(F.col("_node") / FAN).cast("bigint").alias("_node"), free).distinct()
    for level in reversed(levels):
        entered = _descended(level, entered, pause)
    return entered.unionByName(alone)


def _composed_level(level: DataFrame, pause: int, length: int, origin: int) -> DataFrame:
    """Maps of FAN neighbouring nodes as one. `length` is that of the new nodes in time, `origin` the start of the first."""
    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def steps() -> Iterator[tuple]:
            group = now = None
            for pdf in batches:
                for key, node, entries, lasts in zip(pdf["_key"], pdf["_node"].tolist(), pdf["_entries"], pdf["_lasts"]):
                    own = (np.asarray(entries, np.int64), np.asarray(lasts, np.int64))
                    if (key, node // FAN) == group:
                        now = composed(now, own, pause, origin + group[1] * length + pause)
                        continue
                    if group is not None:
                        yield *group, *now
                    group, now = (key, node // FAN), own
            if group is not None:
                yield *group, *now
        return _gather(steps())

    parent = F.floor(F.col("_node") / FAN).cast("bigint")
    return (level.repartition("_key", parent).sortWithinPartitions("_key", "_node").mapInPandas(compose, MAP))


def _descended(level: DataFrame, entered: DataFrame, pause: int) -> DataFrame:
    """Since when the key is free at each node of a level, from the same for the nodes above, whose times come first."""
    none = F.array().cast("array<bigint>")
    both = (level.select("_key", F.floor(F.col("_node") / FAN).cast("bigint").alias("_parent"), "_node", "_entries", "_lasts", F.lit(0).cast("bigint").alias("_from"))
            .unionByName(entered.select("_key", F.col("_node").alias("_parent"), F.lit(-1).cast("bigint").alias("_node"), none.alias("_entries"),
                                        none.alias("_lasts"), "_from")))

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        free = NEVER
        for pdf in batches:
            out = []
            for key, node, entries, lasts, start in zip(pdf["_key"], pdf["_node"].tolist(), pdf["_entries"], pdf["_lasts"], pdf["_from"].tolist()):
                if node < 0:
                    free = start
                    continue
                out.append((key, node, free))
                at = int(np.searchsorted(entries, free, side="left"))
                if at < len(entries):
                    free = int(lasts[at]) + pause
            yield _plain(pd.DataFrame(out, columns=["_key", "_node", "_from"]))

    return (both.repartition("_key", "_parent").sortWithinPartitions("_key", "_parent", "_node")
            .mapInPandas(descend, "_key string, _node bigint, _from bigint"))
