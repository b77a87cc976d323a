"""Secret scan: accuracy on findings it did not learn from, planted secrets and look-alikes, redaction."""

import re

import pytest
from pyspark.sql import functions as F

from tidelog.llm import secrets
from tidelog.llm.queries import QUERIES

KEY = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
DOCS = [
    (1, f'some words token = "{KEY}" and more words'), (2, "password: Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5 end"), (3, f"api_key={KEY}"),
    (4, "the thanentishreationer of aneatherentionble is here"), (5, "commit sha1 24be64439e3e49cf46b2d7c90f3602a3d0b907fe was merged"),
    (6, None), (7, ""), (8, "--------------------------------- title"), (None, f'secret = "{KEY}"'), (9, "some/long/path/to/things.txt is read"),
    (9, "some/long/path/to/things.txt is read"), (10, "plain " * 4000 + f' token = "{KEY}"'), (11, f"identifier_of_the_token={KEY}"),
    (12, "secret=xxxxxxxxxxxxxxxxxxxx")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").selectExpr("*", "'a' AS word", "0 AS pos", "1 AS score").repartition(2)


@pytest.fixture(scope="module")
def found(docs):
    return secrets.scan(docs).cache()


def test_planted_secrets_are_found_and_look_alikes_are_not(found):
    hit = {(r.doc_id, r.candidate) for r in found.where("is_secret").collect()}
    assert hit >= {(1, KEY), (2, "Zm9vYmFyQmF6UXV4MTIzNDU2Nzg5"), (3, KEY), (None, KEY), (10, KEY), (11, KEY)}
    assert not {d for d, _ in hit} & {4, 5, 6, 7, 8, 9, 12}


def test_every_candidate_is_returned(found):
    got = sorted(((r.doc_id, r.pos, r.candidate) for r in found.collect()), key=repr)
    want = [(d, i, c) for d, text in DOCS for i, w in enumerate(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
            for c in re.findall(r"[A-Za-z0-9+/_\-]{16,}={0,2}", w)]
    assert got == sorted(want, key=repr)


def test_redaction_keeps_rows_and_columns(docs, found):
    out = secrets.redacted(docs, found)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    hit = {(r.doc_id, r.candidate) for r in found.where("is_secret").collect()}
    want = []
    for d, text in DOCS:
        for c in sorted((c for i, c in hit if i == d), key=len, reverse=True):
            text = text.replace(c, "[SECRET]")
        want.append((d, text))
    assert got == sorted(want, key=repr)


def test_accuracy_on_findings_not_learnt(spark):
    rows = secrets.generated_findings(spark, 4000).withColumn("coverage", F.lit(0.0))
    learnt, unseen = rows.where("doc_key % 4 <> 0 AND doc_key % 4 <> 1"), rows.where("doc_key % 4 < 2")
    from pyspark.ml.feature import VectorAssembler

    seen = VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(secrets.featured(unseen))
    right = secrets.train(learnt).transform(seen).select(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert unseen.count() > 1000 and right > 0.95


def test_dictionary_counts_whole_words(spark):
    docs = spark.createDataFrame([("Alpha beta alpha",), ("ALPHA, beta gamma",), (None,)], "text string")
    wanted = spark.createDataFrame([("alpha",), ("beta",), ("gam",)], "part string")
    assert [r.part for r in secrets.dictionary(docs, wanted, least=3).collect()] == ["alpha"]


def test_empty_table_and_plan(spark, sf_dir):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    plan = QUERIES["op6_secret_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|ArrowEval|Pandas|Cartesian|NestedLoop", plan)


def test_held_out_keys_without_a_keyword_and_look_alikes_with_one(spark):
    from pyspark.ml.feature import VectorAssembler

    rows = secrets.generated_findings(spark, 4000).withColumn("coverage", F.lit(0.0))
    learnt, unseen = rows.where("doc_key % 4 <> 0 AND doc_key % 4 <> 1"), rows.where("doc_key % 4 < 2")
    forest = secrets.train(learnt)
    assert (forest.getNumTrees, forest.getMaxDepth(), forest.getMaxBins()) == (30, 8, 32)
    seen = forest.transform(VectorAssembler(inputCols=secrets.FEATURES, outputCol="features").transform(secrets.featured(unseen)))
    got = {(r.label, r.keyword): (r.n, r.right) for r in seen.groupBy("label", "keyword").agg(
        F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("int")).alias("right")).collect()}
    print(got)
    assert len(got) == 4 and all(n > 100 and right > 0.9 for n, right in got.values())
