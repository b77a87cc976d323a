"""The pipeline stage by stage against plain forms, each on what the stage before it kept."""

import re

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from test_decontam import plain as plain_leaks
from test_near_duplicates import plain as plain_groups
from tidelog.llm import quality, secrets
from tidelog.llm.common import written
from tidelog.llm.tokens import Encoder


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """docs before the first stage and after each."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 6000")
    clean = docs.where("doc_id = 1").first().text
    planted = [(9000, clean + " " + item, "en", "src0", 1), (9001, " ".join(reversed(clean.split())) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "src0", 1),
               (9002, None, None, None, None), (9003, "", "en", "src0", 0), (9004, "", "en", "src0", 0), (None, "no id but some words of a text", "en", "src0", 1)]
    found = [written(docs.union(spark.createDataFrame(planted, docs.schema)), "docs")]
    for _, stage in corpus_pipeline.STAGES:
        found.append(written(stage(spark, found[-1], sf_dir), "stage"))
    return found


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns_stay(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_quality(spark, sf_dir, stages):
    model = quality.train(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = [r.doc_id for r in quality.score(stages[0], model).collect() if r.score >= 0.3]
    assert sorted(map(str, want)) == sorted(str(d) for d, _ in pairs(stages[1])) and len(want) < stages[0].count()


def test_near_duplicates(stages):
    rows = pairs(stages[1])
    least = {}
    for g, (d, _) in zip(plain_groups(rows), rows):
        least[g] = min(least.get(g, 10**9), 10**9 if d is None else d)
    assert sorted(10**9 if d is None else d for d, _ in pairs(stages[2])) == sorted(least.values())


def test_decontamination(spark, sf_dir, stages):
    rows = pairs(stages[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    leaked = {d for d, *_ in plain_leaks(rows, items)}
    assert leaked
    assert sorted(map(str, (d for d, _ in rows if d not in leaked))) == sorted(str(d) for d, _ in pairs(stages[3]))


def test_documents_are_not_dealt_out_for_the_keys_of_leaks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = corpus_pipeline.drop_benchmark_leaks(spark, docs, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search("SortMergeJoin|ShuffledHashJoin|hashpartitioning", plan)


def test_secrets(stages):
    before, after = dict(pairs(stages[3])), dict(pairs(stages[4]))
    assert set(before) == set(after)
    found = {}
    for r in secrets.scan(stages[3], path_col="source").where("is_secret").collect():
        found.setdefault(r.doc_id, set()).add(r.candidate)
    assert found
    for d, text in before.items():
        for secret in sorted(found.get(d, ()), key=len, reverse=True):
            text = text.replace(secret, "[SECRET]")
        assert after[d] == text


def test_packing(stages):
    encode, tokens, sequences = Encoder(public_tokenizers.path("byte_bpe_50k.json")).encode, {}, {}
    for r in stages[5].collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert tokens == {d: len(encode(t)) + 1 for d, t in pairs(stages[4])}
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and (ends[-1] == 1024 or ends[-1].bit_count() == 1)


def test_empty_documents(spark, tmp_path, sf_dir):
    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_with_names_that_stages_use(spark, sf_dir):
    names = ["__hash", "__doc", "__raw", "__id", "__key", "__secrets", "own_id", "own_raw", "own_digest", "own_key", "own_given_id", "own_given_key", "own__secrets", "node", "f", "raw"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    docs = docs.selectExpr("*", *(f"{i} AS {name}" for i, name in enumerate(names)))
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_benchmark_leaks, corpus_pipeline.redact_secrets, corpus_pipeline.keep_quality):
        kept = stage(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        assert all([r[n] for n in names] == list(range(len(names))) for r in kept.collect())
