"""Exact histogram of encoded lengths, and what its suffix sums answer."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.llm.common import slices, written
from tidelog.llm.tokens import encoder, utf8

BLOCK = 1024  # lengths of one block are summed by one window


def token_lengths(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: tuple[str, ...] = (),
                  added: bool = False) -> DataFrame:
    """(keep.., n_tokens) of every row: the ids of its whole text, none put around it. `added`: see `Encoder`. Null text has none."""
    given = docs.select(utf8(text_col).alias("__text"), *keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, added).encode
        for batch in slices(batches, 512):
            lengths = pa.array([len(encode(text)) for text in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], lengths], [*keep, "n_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[1:]), "n_tokens long"])
    return given.mapInArrow(run, schema)


def length_histogram(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by.., n_tokens, documents), written once: what follows reads it several times, and texts are encoded once.

    Rows are counted before they are shuffled, so no length or group is hot.
    """
    return written(lengths.groupBy(*by, "n_tokens").agg(F.count("*").alias("documents")), "histogram")


def suffix_sums(histogram: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per length that occurs, with what a context limit of that length means.

    documents: of this length. documents_at_least, tokens_at_least: of this length or longer. truncated_tokens:
    what remains if every document is cut there. all_documents, all_tokens: totals of the group. Sums run within
    blocks of lengths and over one row per block, so no task sees all lengths. Empty in, empty out.
    """
    of = [F.col(c) for c in by]
    h = histogram.withColumn("__block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = h.groupBy(*by, "__block").agg(F.sum("documents").alias("__d"), F.sum(F.col("documents") * F.col("n_tokens")).alias("__t"))
    longer = W.partitionBy(*of).orderBy(F.col("__block").desc()).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*of)
    blocks = blocks.select(*by, "__block", F.coalesce(F.sum("__d").over(longer), F.lit(0)).alias("__later_d"),
                           F.coalesce(F.sum("__t").over(longer), F.lit(0)).alias("__later_t"),
                           F.sum("__d").over(whole).alias("all_documents"), F.sum("__t").over(whole).alias("all_tokens"))
    same = F.col("h.__block") == F.col("b.__block")
    for c in by:
        same &= F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}"))
    here = W.partitionBy(*of, "__block").orderBy(F.col("n_tokens").desc())
    joined = h.alias("h").join(blocks.alias("b"), same).select("h.*", *(f"b.{c}" for c in ("__later_d", "__later_t", "all_documents", "all_tokens")))
    sums = joined.withColumns({
        "documents_at_least": F.col("__later_d") + F.sum("documents").over(here),
        "tokens_at_least": F.col("__later_t") + F.sum(F.col("documents") * F.col("n_tokens")).over(here)})
    return sums.select(*by, "n_tokens", "documents", "documents_at_least", "tokens_at_least",
                       (F.col("all_tokens") - F.col("tokens_at_least")
                        + F.col("n_tokens") * F.col("documents_at_least")).alias("truncated_tokens"),
                       "all_documents", "all_tokens")


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, documents_longer, truncated_tokens) for any limits, whether a document has that length or not.

    The shortest length over a limit has, in its suffix sums, all that is over it. One pass over the lengths.
    """
    suffix = F.struct("documents_at_least", "tokens_at_least")
    found = [F.min_by(suffix, F.when(F.col("n_tokens") > n, F.col("n_tokens"))) for n in limits]
    rows = [F.struct(F.lit(n).cast("long").alias("context_limit"), found[i].alias("s")) for i, n in enumerate(limits)]
    longer, tokens = F.coalesce("r.s.documents_at_least", F.lit(0)), F.coalesce("r.s.tokens_at_least", F.lit(0))
    return (sums.agg(F.max("all_tokens").alias("t"), F.array(*rows).alias("rows"))
            .select("t", F.explode("rows").alias("r"))
            .select("r.context_limit", longer.alias("documents_longer"),
                    (F.coalesce("t", F.lit(0)) - tokens + longer * F.col("r.context_limit")).alias("truncated_tokens")))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the shortest length that at least this share of the documents does not exceed; null if none."""
    up_to = F.col("all_documents") - F.col("documents_at_least") + F.col("documents")
    rows = [F.struct(F.lit(float(x)).alias("share"), F.min(F.when(up_to >= x * F.col("all_documents"), F.col("n_tokens"))).alias("n_tokens"))
            for x in shares]
    return sums.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
