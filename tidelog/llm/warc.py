"""WARC archives from pages, and back, through a table of record chunks.

A payload is cut into chunks by Spark before Python sees it, and travels as rows (record, chunk number, data) that
stand together in order. Whoever reads them keeps the running length and SHA-1 of one record, never the record.
Archives are gzip files with a member per record, written and read as streams. Only files that finished tasks
report are in the manifest that Spark writes.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from tidelog.llm.common import slices, written
from tidelog.session import shared_dir

CHUNK = 1 << 20
PIECE = 1 << 18  # bytes read at once
ID = "urn:x-page:"
MANIFEST = "folder string, file string, records long"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _key(id_col: str, url_col: str, payload: Column) -> Column:
    """Tells rows with one id apart; rows that agree in id, address and payload are repeats."""
    return F.xxhash64(F.col(url_col).cast("string"), payload)


def chunked(rows: DataFrame, payload: str = "payload", size: int = CHUNK) -> DataFrame:
    """The other columns, chunk, last (whether it is the last one) and data: chunks of a row stand together in order.

    An empty payload, and a null one (which stays null), is one chunk.
    """
    others = [c for c in rows.columns if c != payload]
    most = F.greatest(F.lit(0), F.ceil(F.octet_length(payload) / size).cast("int") - 1)
    cut = rows.withColumn("most", F.coalesce(most, F.lit(0))).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("most"))))
    return cut.select(*others, "chunk", (F.col("chunk") == F.col("most")).alias("last"),
                      F.expr(f"substring(`{payload}`, chunk * {size} + 1, {size})").alias("data"))


def payload_digests(chunks: DataFrame, key: list[str]) -> DataFrame:
    """(key.., payload_bytes, payload_digest) of each record of a chunk table: base32 SHA-1, carried from chunk to chunk."""
    given = chunks.select(*key, "last", "data")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, size = hashlib.sha1(), 0
        for batch in slices(batches, 64):
            rows, sizes, digests = [], [], []
            last, data = batch.column(len(key)).to_pylist(), batch.column(len(key) + 1)
            for i, ends in enumerate(last):
                piece = data[i].as_buffer()
                digest.update(piece)
                size += piece.size
                if ends:
                    rows.append(i)
                    sizes.append(size)
                    digests.append(base64.b32encode(digest.digest()).decode())
                    digest, size = hashlib.sha1(), 0
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[:len(key)]), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())],
                                             [*key, "payload_bytes", "payload_digest"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema[:len(key)])
    return given.mapInArrow(run, kinds + ", payload_bytes long, payload_digest string")


def decided(digests: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, key, payload_bytes, payload_digest, copies, keeper): keeper is the page that holds the payload, null where
    each page holds its own. Of equal payloads of at least `least_bytes` bytes it is the one with the largest page_id.

    Equal payloads are counted before they are shuffled; a page is compared with its payload's keeper only.
    """
    rows = digests.groupBy("page_id", "key", "payload_bytes", "payload_digest").agg(F.count("*").alias("copies"))
    keepers = (rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
               .agg(F.max(F.struct("page_id", "key")).alias("keeper")).withColumnRenamed("payload_digest", "of"))
    large = (F.col("payload_digest") == F.col("of")) & (F.col("payload_bytes") >= least_bytes)
    return rows.join(keepers, large, "left").drop("of")


def write_archives(pages: DataFrame, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", folder: str | None = None,
                   chunk_bytes: int = CHUNK, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes a WARC record per row of pages; returns the manifest, a row per archive.

    The payload is the column's UTF-8 bytes, null counting as empty. Of records with equal payloads of at least
    `least_bytes` bytes the one with the largest page_id is a response, the others are revisits of it; of repeated
    rows (same id, address and payload) with that id the first is the response. A null page_id is the smallest; a null url
    is the record's own name. Other columns are ignored. An empty table gives no records.
    """
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), _key(id_col, url_col, payload).alias("key"),
                         F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    digests = written(payload_digests(chunked(given.drop("url"), size=chunk_bytes), ["page_id", "key"]), "digests")
    plan = written(decided(digests, least_bytes), "records")
    plan = plan.withColumnsRenamed({"page_id": "id", "key": "k"})
    if not plan.where("copies > 1").isEmpty():  # repeats become one row with a count, so that each gets its own number
        given = given.dropDuplicates(["page_id", "key"])
    mine = F.col("keeper").isNull() | (F.col("keeper.page_id").eqNullSafe(F.col("page_id")) & (F.col("keeper.key") == F.col("key")))
    records = (given.join(plan, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")))
               .withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
               .withColumn("responds", mine & (F.col("keeper").isNull() | (F.col("copy") == 0))))
    rows = chunked(records.select("page_id", "key", "copy", "url", "payload_bytes", "payload_digest", "keeper", "responds",
                                  F.when(F.col("responds"), F.col("payload")).alias("payload")), size=chunk_bytes)
    files, at = pafs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, records = f"pages-{uuid.uuid4().hex}.warc.gz", 0
        files, at = pafs.FileSystem.from_uri(folder)
        with files.open_output_stream(f"{at}/{name}") as out:
            for batch in slices(batches, 64):
                data = batch.column(batch.num_columns - 1)
                for i, row in enumerate(batch.select(batch.schema.names[:-1]).to_pylist()):
                    if row["chunk"] == 0:
                        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                        out.write(packer.compress(_head(row, date)))
                    if data[i].is_valid:
                        out.write(packer.compress(data[i].as_buffer()))
                    if row["last"]:
                        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                        records += 1
        yield pa.RecordBatch.from_arrays([pa.array([folder]), pa.array([name]), pa.array([records], pa.int64())], ["folder", "file", "records"])

    return written(rows.mapInArrow(run, MANIFEST), "manifest")


def record_name(page_id: int | None, key: int, copy: int) -> str:
    return f"{ID}{'null' if page_id is None else page_id}:{key % 2**64:016x}:{copy}"


def _head(row: dict, date: str) -> bytes:
    """The head of a record, and the head of the response inside it."""
    inner = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    name = record_name(row["page_id"], row["key"], row["copy"])
    lines = ["WARC/1.1", f"WARC-Type: {'response' if row['responds'] else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
             f"WARC-Target-URI: {quote(row['url'], safe=_URL_SIGNS) if row['url'] is not None else name}",
             f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(inner) + (row['payload_bytes'] if row['responds'] else 0)}"]
    if not row["responds"]:
        keeper = row["keeper"]
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_name(keeper['page_id'], keeper['key'], 0)}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + inner


_URL_SIGNS = "".join(chr(c) for c in range(33, 127))


class Archive:
    """A stream over the records of one archive: at most a piece of the file is in memory."""

    def __init__(self, source):
        self.source, self.unzip, self.raw, self.plain = source, None, b"", b""

    def _more(self) -> bool:
        """Unpacks some more bytes; False at the end of the file."""
        while True:
            if not self.raw:
                self.raw = self.source.read(PIECE)
                if not self.raw:
                    return False
            if self.unzip is None or self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
            got = self.unzip.decompress(self.raw, PIECE)
            self.raw = self.unzip.unconsumed_tail or self.unzip.unused_data
            if got:
                self.plain += got
                return True

    def _until_blank(self) -> bytes | None:
        while (end := self.plain.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.plain.strip():
                    raise ValueError("the archive ends inside a head")
                return None
        head, self.plain = self.plain[:end], self.plain[end + 4:]
        return head

    def _bytes(self, count: int) -> Iterator[bytes]:
        while count:
            if not self.plain and not self._more():
                raise ValueError("the archive ends inside a record")
            piece, self.plain = self.plain[:count], self.plain[count:]
            count -= len(piece)
            yield piece

    def records(self) -> Iterator[tuple[dict, dict, Iterator[bytes]]]:
        """(fields of the record, fields of the response in it, pieces of the payload). Pieces must be used up."""
        while (head := self._until_blank()) is not None:
            fields = _fields(head)
            inner = self._until_blank()
            yield fields, _fields(inner), self._bytes(int(fields["content-length"]) - len(inner) - 4)
            if b"".join(self._bytes(4)) != b"\r\n\r\n":
                raise ValueError("a record does not end where it says")


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, v in (line.split(": ", 1) for line in head.decode().split("\r\n")[1:])}


def _pages_of(name: str) -> int | None:
    page = name.strip("<>").removeprefix(ID).split(":")[0]
    return None if page == "null" else int(page)


def _open(row: dict) -> Archive:
    files, at = pafs.FileSystem.from_uri(row["folder"])
    return Archive(files.open_input_stream(f"{at}/{row['file']}"))


def _by_file(manifest: DataFrame) -> DataFrame:
    return manifest.where("records > 0").repartition(max(1, manifest.count()))


def read_records(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record of the archives.

    Length and digest of a response are those of the payload as it was read, and must be what its head says; a revisit
    has them in its head.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = []
                for fields, inner, pieces in _open(row).records():
                    digest, size = hashlib.sha1(), 0
                    for piece in pieces:
                        digest.update(piece)
                        size += len(piece)
                    said = (int(inner["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"))
                    if fields["warc-type"] == "response" and said != (size, base64.b32encode(digest.digest()).decode()):
                        raise ValueError(f"{fields['warc-record-id']}: payload and head differ")
                    refers = fields.get("warc-refers-to")
                    out.append((_pages_of(fields["warc-record-id"]), *said, fields["warc-type"], refers and _pages_of(refers)))
                    if len(out) == 1000:
                        yield _records(out)
                        out = []
                yield _records(out)

    return _by_file(manifest).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_chunks(manifest: DataFrame, chunk_bytes: int = CHUNK) -> DataFrame:
    """(record_id, page_id, url, record_type, chunk, data, bytes_so_far, digest_so_far) of every record: the payload in pieces of
    at most `chunk_bytes` bytes, each with the length and base32 SHA-1 of all up to it. A revisit, or an empty payload, is one
    row with empty data."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "page_id", "url", "record_type", "chunk", "data", "bytes_so_far", "digest_so_far"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            for row in batch.to_pylist():
                for fields, _, pieces in _open(row).records():
                    digest, size, number = hashlib.sha1(), 0, 0
                    for data in _in_chunks(pieces, chunk_bytes):
                        digest.update(data)
                        size += len(data)
                        values = (fields["warc-record-id"].strip("<>"), _pages_of(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"],
                                  number, data, size, base64.b32encode(digest.digest()).decode())
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)
                        number += 1

    return _by_file(manifest).mapInArrow(run, "record_id string, page_id long, url string, record_type string, chunk long, data binary, bytes_so_far long, digest_so_far string")


def _in_chunks(pieces: Iterable[bytes], size: int) -> Iterator[bytes]:
    held, given = b"", False
    for piece in pieces:
        held += piece
        while len(held) >= size:
            yield held[:size]
            held, given = held[size:], True
    if held or not given:
        yield held
