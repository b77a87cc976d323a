"""Token ids against the tokenizers library itself; token files by an exact round trip; histogram by brute force."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tidelog.llm import token_counts, token_store
from tidelog.llm.queries import QUERIES
from tidelog.llm.tokens import Encoder

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "\n", "  a", "a  b", "a \n b", "a\n\nb c", " a", "a ", "é ü\tß", "don't we're I'LL", "<|endoftext|> x",
       "x y  z", "a" * 3000, "1 22 333 4,5 !?.. ?", "日本 語 テキスト", "\u0085 a", "\x1c b", "🙂 🙂", "word " * 2000]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def fast():
    return Encoder(FILE)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text, plain, fast):
    assert fast.encode(text).tolist() == plain(text)


@settings(max_examples=400, deadline=None)
@given(parts=st.lists(st.sampled_from(list(" \n\t  'stab1É.,|") + ["\r\n", "  "]), max_size=30))
def test_words_give_the_ids_of_the_text(parts, plain, fast):
    text = "".join(parts)
    assert fast.encode(text).tolist() == plain(text)


def rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = [(10_000 + i, text) for i, text in enumerate(ODD)] + [(10_000, "again"), (None, "no id")]
    return docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("*", "1 AS start", "text AS file")


def test_store_round_trip(spark, sf_dir, plain):
    docs = rows(spark, sf_dir)
    manifest = token_store.write_store(docs, FILE, end_id=2)
    got = token_store.read_store(manifest).orderBy("start").collect()
    assert [r.start for r in got] == np.cumsum([0] + [len(r.ids) // 4 for r in got])[:-1].tolist()
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in got], key=lambda d: (d is not None, d))
    ids = sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got), key=repr)
    assert ids == sorted(((r.doc_id, plain(r.text) + [2]) for r in docs.collect()), key=repr)
    digests = {(r.start, r.doc_id): (r.n_tokens, r.ids_crc32) for r in token_store.read_digests(manifest).collect()}
    assert digests == {(r.start, r.doc_id): (len(r.ids) // 4, zlib.crc32(r.ids)) for r in got}
    part = manifest.orderBy("number").first()
    one = token_store.TokenFile(part.folder, part.file)  # a single short document by its place
    assert one.ids(1).astype("<u4").tobytes() == bytes(got[1].ids)
    files, at = pafs.FileSystem.from_uri(part.folder)
    assert [f for f in files.get_file_info(pafs.FileSelector(at)) if f.base_name.endswith(".zdict")]


def test_store_of_an_empty_table(spark):
    manifest = token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), FILE, end_id=2)
    assert token_store.read_digests(manifest).count() == 0


def test_histogram_answers(spark, sf_dir, plain):
    docs = rows(spark, sf_dir)
    lengths = sorted(len(plain(r.text)) for r in docs.collect())
    sums = token_counts.suffix_sums(token_counts.length_histogram(token_counts.token_lengths(docs, FILE)))
    got = {r.n_tokens: r for r in sums.collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        at_least = [x for x in lengths if x >= n]
        assert (r.documents, r.documents_at_least, r.tokens_at_least) == (lengths.count(n), len(at_least), sum(at_least))
        assert (r.truncated_tokens, r.all_documents, r.all_tokens) == (sum(min(x, n) for x in lengths), len(lengths), sum(lengths))
    limits = {r.context_limit: (r.documents_longer, r.truncated_tokens) for r in token_counts.at_limits(sums, [0, 7, 100, 10**9]).collect()}
    assert limits == {n: (sum(x > n for x in lengths), sum(min(x, n) for x in lengths)) for n in (0, 7, 100, 10**9)}
    shares = {r.share: r.n_tokens for r in token_counts.quantiles(sums, [0.0, 0.5, 0.9, 1.0]).collect()}
    assert shares == {s: min(x for x in lengths if sum(y <= x for y in lengths) >= s * len(lengths)) for s in (0.0, 0.5, 0.9, 1.0)}


def test_histogram_by_groups_and_empty(spark):
    docs = spark.createDataFrame([("a", "x y"), (None, "x y"), (None, None)], "source string, text string")
    lengths = token_counts.token_lengths(docs, FILE, keep=("source",))
    got = token_counts.suffix_sums(token_counts.length_histogram(lengths, ("source",)), ("source",)).collect()
    assert sorted((str(r.source), r.n_tokens, r.documents_at_least, r.all_tokens) for r in got) == [("None", 0, 2, 2), ("None", 2, 1, 2), ("a", 2, 1, 2)]
    none = token_counts.suffix_sums(token_counts.length_histogram(token_counts.token_lengths(docs.limit(0), FILE)))
    assert none.count() == 0
    assert [tuple(r) for r in token_counts.at_limits(none, [5]).collect()] == [(5, 0, 0)]


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "a  b <|endoftext|><|endoftext|>\n c", "<|endoftext| > no token"]


@pytest.mark.parametrize("text", [*ADDED, *ODD])
def test_added_tokens_as_the_library_has_them(text):
    want = Tokenizer.from_file(FILE).encode(text or "", add_special_tokens=False).ids
    assert Encoder(FILE, added=True).encode(text).tolist() == want
    assert (50256 in want) == ("<|endoftext|>" in (text or ""))


def test_queries_take_added_tokens(spark, tmp_path):
    plain = Tokenizer.from_file(FILE)
    spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = [plain.encode(text, add_special_tokens=False).ids for text in ADDED]
    crc = lambda end: {i: zlib.crc32(np.array([*x, end], "<u4").tobytes()) for i, x in enumerate(ids)}
    assert {r.doc_id: r.ids_crc32 for r in QUERIES["op2_token_store"](spark, str(tmp_path)).collect()} == crc(2)
    assert {r.doc_id: r.doc_tokens for r in QUERIES["op9_packing"](spark, str(tmp_path)).collect()} == {i: len(x) + 1 for i, x in enumerate(ids)}
    assert {r.n_tokens: r.documents for r in QUERIES["op5_token_counts"](spark, str(tmp_path)).collect()} == Counter(map(len, ids))
