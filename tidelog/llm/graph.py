"""Connected components of a link table, as Spark joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidelog.llm.common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links(a, b)`; root is the smallest node that can be reached.

    Nodes are of any type with an order. Links may repeat and point either way; a link with a null end or to
    itself says nothing and is left out. An empty table gives no rows.

    Large-star and small-star steps by turns: the first hangs every larger neighbour of a node on the
    smallest one, the second does so with the smaller ones, until every node hangs on its root. The number of
    rounds is logarithmic in practice, also for long chains. Each round writes its links, so that no plan
    grows; nothing is gathered by the driver but a count and a checksum.
    """
    start = (links.where(F.col("a") != F.col("b"))
             .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    now, mark = _kept(start)
    while True:
        after, new_mark = _kept(_small_star(_large_star(now)))
        drop_written(now)
        now = after
        if new_mark == mark:
            break
        mark = new_mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())


def _kept(links: DataFrame) -> tuple[DataFrame, tuple]:
    kept = written(links, "links")
    return kept, tuple(kept.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                                F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    smallest = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(smallest, "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    smallest = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(smallest, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(smallest).distinct()
