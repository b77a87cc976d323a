"""WARC: an exact round trip, and a plain form of who revisits whom."""

import base64
import gzip
import hashlib

import pyarrow.fs as pafs
import pytest

from tidelog.llm import warc


def plain(rows, least=0):
    out, best = [], {}
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= least:
            best[data] = max(best.get(data, -1), -1 if page_id is None else page_id)
    used = set()
    for page_id, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        keeper = best.get(data)
        if keeper is None or (keeper == page_id and data not in used):
            used.add(data)
            out.append((page_id, len(data), digest, "response", None))
        else:
            out.append((page_id, len(data), digest, "revisit", keeper))
    return sorted(out, key=repr)


def rows_of(spark, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    big = "0123456789é" * 50_000
    return rows + [(1000 + i, f"http://x/{i}", rows[0][2]) for i in range(30)] + [
        (2000, "http://e", None), (2001, "http://e\r\nX: y", ""), (2002, None, "é\r\n\r\nWARC/1.1\r\n"), (2003, "u", big), (2004, "v", big), (2005, "ü ü", "a")]


def digest(manifest):
    return sorted((tuple(r) for r in warc.read_records(manifest).collect()), key=repr)


@pytest.mark.parametrize("least, chunk", [(0, warc.CHUNK), (200, 1000)])
def test_round_trip(spark, sf_dir, least, chunk):
    rows = rows_of(spark, sf_dir)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS chunk").repartition(3)
    manifest = warc.write_archives(df, least_bytes=least, chunk_bytes=chunk)
    got = digest(manifest)
    assert got == plain(rows, least)
    pieces = {}
    for r in warc.read_chunks(manifest, 1000).collect():
        if r.record_type == "response":
            pieces.setdefault(r.page_id, []).append((r.chunk, bytes(r.data), r.bytes_so_far, r.digest_so_far))
    texts = {p: (h or "").encode() for p, _, h in rows}
    assert set(pieces) == {p for p, _, _, kind, _ in got if kind == "response"}
    for page_id, chunks in pieces.items():
        chunks.sort()
        so_far = b""
        for i, (number, data, size, sha) in enumerate(chunks):
            so_far += data
            assert number == i and len(data) <= 1000 and size == len(so_far)
            assert sha == base64.b32encode(hashlib.sha1(so_far).digest()).decode()
        assert so_far == texts[page_id]


def test_archives_are_plain_gzip_members(spark):
    manifest = warc.write_archives(spark.createDataFrame([(1, "http://a", "text")], "page_id long, url string, html string"))
    row = manifest.where("records > 0").first()
    files, at = pafs.FileSystem.from_uri(row.folder)
    with files.open_input_stream(f"{at}/{row.file}") as source:
        text = gzip.decompress(source.read()).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith("\r\n\r\ntext\r\n\r\n")


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(5, "u", "same")] * 3 + [(4, "u", "same"), (None, "n", "other"), (None, "n", "other"), (6, "a", "x"), (6, "a", "y")]
    got = digest(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)))
    types = sorted(((p, n, t, r) for p, n, _, t, r in got), key=repr)
    assert types == sorted([(5, 4, "response", None), (5, 4, "revisit", 5), (5, 4, "revisit", 5), (4, 4, "revisit", 5), (None, 5, "response", None),
                            (None, 5, "revisit", None), (6, 1, "response", None), (6, 1, "response", None)], key=repr)
    assert digest(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))) == []
