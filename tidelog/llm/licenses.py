"""Licence scan by diagonal voting, in built-in expressions alone.

Every run of k words of a document is hashed and joined with the runs of known notices. A hit at word p of the
document and run t of the notice votes for the diagonal p - t: a notice that stands word by word in a text has all its votes
on one diagonal, one with words added or dropped has them on neighbouring ones, which are merged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tidelog.llm.common import ascii_lower

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wordings of well-known public notices, and labels of this module for them.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("unless required by applicable law or agreed to in writing software distributed under the license", "apache-2.0"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("the software is provided as is without warranty of any kind", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it", "gpl-notice"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under a creative commons attribution", "creative-commons"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("dedicated to the public domain", "public-domain"),
]

BASE_RUN, RUN = 3, 2  # words of a run, of base phrases (at most) and of notices
WORD_BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    words: tuple[str, ...]
    label: str
    base: bool

    @property
    def run(self) -> int:
        return min(BASE_RUN if self.base else RUN, len(self.words))

    @property
    def runs(self) -> int:
        return len(self.words) - self.run + 1


def templates(notices=NOTICES, base=BASE) -> list[Template]:
    return ([Template(tuple(phrase.split()), label, True) for phrase, label in base.items()]
            + [Template(tuple(text.split()), label, False) for text, label in notices])


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, cut at every other sign of ASCII but digits. Null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), WORD_BREAKS), "")


def _run_hash(words: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(words)), *words)


def _positions(spark: SparkSession, known: list[Template]) -> DataFrame:
    """(hash, run, template, t) of every run of every notice: as many rows as the notices have words."""
    rows = [F.struct(_run_hash([F.lit(w) for w in x.words[t:t + x.run]]).alias("hash"),
                     F.lit(" ".join(x.words[t:t + x.run])).alias("run"), F.lit(i).alias("template"), F.lit(t).alias("t"),
                     F.lit(0 if x.base else len(x.words)).alias("notice_words"))
            for i, x in enumerate(known) for t in range(x.runs)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _least_runs(notice: Template, coverage: float) -> int:
    """Runs that are left when as many words are changed as `coverage` allows: each change breaks `run` of them at most."""
    words = len(notice.words)
    return max(1, notice.runs - notice.run * (words - math.ceil(coverage * words - 1e-9)))


def _common(notice: str, words: Column) -> Column:
    """Length of the longest common subsequence of two short lists of words: one row of the table after the other."""
    def next_row(row: Column, word: Column) -> Column:
        cells = F.aggregate(F.sequence(F.lit(1), F.size(words)), F.array(F.lit(0)), lambda done, j: F.concat(done, F.array(F.greatest(
            F.get(row, j), F.element_at(done, -1), F.get(row, j - 1) + (F.get(words, j - 1) == word).cast("int")))))
        return cells

    return F.element_at(F.aggregate(notice, F.transform(F.sequence(F.lit(0), F.size(words)), lambda j: F.lit(0)), next_row), -1)


def scan(docs: DataFrame, notices=NOTICES, base=BASE, coverage: float = 0.8, gap: int = 3, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per row of docs: (doc_id, n_words, spans), spans an array of the verified places.

    A span has label, base, start, end (words, end not included) and coverage: the share of the notice's words that
    stand there in its order, by the longest common subsequence of the notice and the words around its merged diagonals. A base
    phrase counts only whole and word by word, every place of it; a notice from `coverage` on, so one word of a notice of five
    or more may be missing, replaced or put between. Where so few runs are left that this can't be reached, words aren't
    compared, and coverage is the share of runs. Words put between count as words of the notice that are missing. Of notices that
    overlap those with the largest coverage stay. Neighbouring diagonals are merged while the next is at most `gap` further on and no run is found
    twice. Null, empty and wordless texts have no words and no spans. Repeated rows are each scanned; a null doc_id
    stays null. Other columns are ignored. An empty table gives no rows.

    Only positions whose word begins some run of a notice are hashed; hits and one row per document are shuffled,
    never texts.
    """
    known = templates(notices, base)
    firsts = sorted({x.words[t] for x in known for t in range(x.runs)})
    at = lambda i: F.get("words", F.col("pos") + i)
    given = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), words_of(F.col(text_col)).alias("words"))
    placed = given.select("doc_id", "row", "words", F.posexplode_outer("words").alias("pos", "word"))
    # The first position of each document is kept in any case: it stands for the document.
    begun = placed.where(F.col("word").isin(firsts) | (F.coalesce("pos", F.lit(0)) == 0))
    runs = [n for n in sorted({x.run for x in known})]
    reach = max(len(x.words) for x in known) + gap  # what a hit must see on either side of it to verify its notice
    around = F.slice("words", F.greatest(F.lit(1), F.coalesce("pos", F.lit(0)) + 1 - reach), 2 * reach)
    tried = begun.select("doc_id", "row", F.size("words").alias("n_words"), F.coalesce("pos", F.lit(0)).alias("pos"), around.alias("around"),
                         F.explode(F.array(*(F.struct(_run_hash([at(i) for i in range(n)]).alias("hash"),
                                                      F.concat_ws(" ", *(at(i) for i in range(n))).alias("run")) for n in runs))).alias("r"))
    # Of a hit only the words near its notice go on.
    placed_at = F.greatest(F.lit(0), F.col("pos") - F.col("t") - gap) - F.greatest(F.lit(0), F.col("pos") - reach)
    found = (tried.select("doc_id", "row", "n_words", "pos", "around", F.col("r.hash").alias("h"), F.col("r.run").alias("words"))
             .join(F.broadcast(_positions(docs.sparkSession, known)), (F.col("h") == F.col("hash")) & (F.col("words") == F.col("run")), "left")
             .where("template is not null or pos = 0")
             .withColumn("around", F.when(F.col("notice_words") > 0, F.slice("around", placed_at + 1, F.col("notice_words") + 4 * gap))))
    votes = (found.groupBy("row", "template", (F.col("pos") - F.col("t")).alias("diagonal"))
             .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.count("t").alias("votes"),
                  F.min("pos").alias("low"), F.max("pos").alias("high"),
                  F.min(F.when(F.col("notice_words") > 0, F.struct("pos", "around"))).alias("seen")))
    facts = F.inline(F.array(*(F.struct(F.lit(i).alias("number"), F.lit(x.label).alias("label"), F.lit(x.base).alias("base"),
                                        F.lit(len(x.words)).alias("length"), F.lit(x.runs).alias("runs"), F.lit(x.run).alias("of"),
                                        F.array(*map(F.lit, x.words)).alias("notice"), F.lit(_least_runs(x, coverage)).alias("least"))
                               for i, x in enumerate(known))))
    voted = votes.join(F.broadcast(docs.sparkSession.range(1).select(facts)), F.col("template") == F.col("number"), "left")
    order = W.partitionBy("row", "template").orderBy("diagonal")
    # A base phrase has a place per diagonal. A notice's diagonal begins a place unless it carries on the one before it.
    carried = (~F.col("base") & (F.col("diagonal") - F.lag("diagonal").over(order) <= gap)
               & (F.col("votes") + F.lag("votes").over(order) <= F.col("runs")))
    merged = (voted.withColumn("begins", F.when(carried, 0).otherwise(1))
              .withColumn("place", F.sum("begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
              .groupBy("row", "template", "place")
              .agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.first("label").alias("label"),
                   F.first("base").alias("base"), F.min("low").alias("start"), (F.max("high") + F.first("of")).alias("end"),
                   F.least(F.first("runs"), F.sum("votes")).alias("hit"), F.first("runs").alias("runs"), F.first("length").alias("length"),
                   F.first("notice").alias("notice"), F.first("least").alias("least"), F.min("seen").alias("seen"))
              .withColumn("coverage", F.when(F.col("base") | (F.col("hit") == F.col("runs")) | (F.col("hit") < F.col("least")), F.col("hit") / F.col("runs"))
                          .otherwise(_common("notice", F.col("seen.around")) / F.greatest("length", F.col("end") - F.col("start")))))
    verified = F.col("template").isNotNull() & F.when(F.col("base"), F.col("coverage") == 1.0).otherwise(F.col("coverage") >= coverage)
    span = F.struct("label", "base", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "coverage")
    return (merged.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").cast("long").alias("n_words"),
                                      F.collect_list(F.when(verified, span)).alias("spans"),
                                      F.max(F.when(F.col("base"), F.when(F.col("coverage") == 1.0, 1.0)).otherwise(F.col("coverage"))).alias("score"))
            .select("doc_id", "n_words", _best("spans").alias("spans"), F.coalesce("score", F.lit(0.0)).alias("score")))


def _best(spans: str) -> Column:
    """Base phrases, and notices that no other notice overlaps with more of its words."""
    notices = F.filter(spans, lambda s: ~s.base)
    beaten = lambda s: F.exists(notices, lambda o: (o.start < s.end) & (s.start < o.end) & (o.coverage > s.coverage))
    return F.concat(F.filter(spans, lambda s: s.base), F.filter(notices, lambda s: ~beaten(s)))


def digest(found: DataFrame) -> DataFrame:
    """Counts and labels per document, from the spans of `scan`."""
    base = F.filter("spans", lambda s: s.base)
    starts = F.transform(base, lambda s: s.start)
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), "score")
