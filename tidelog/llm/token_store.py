"""Token ids as files: every document a zstandard frame of its own, with one trained dictionary for all of them.

A store is a folder of the shared file system:

    dictionary-<sha256>.zdict     the dictionary (absent if there was nothing to train it on)
    part-<number>-<token>.tok     documents in ascending doc_id order, over all parts in the order of their numbers

A .tok file holds a header (magic, bytes per id, sha256 of the dictionary), the frames, the index (frame offsets,
ids per document, doc_ids and whether they are set) and a footer (offset of the index, documents, magic). A short
document costs its own frame only, as the dictionary holds what short id arrays have in common.

Files are named by part and attempt. Only those that a finished task reports are in the manifest that Spark
writes, so repeated or lost tasks leave no trace in what is read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from tidelog.llm.common import sampled, slices, written
from tidelog.llm.tokens import encoder, utf8
from tidelog.session import shared_dir

MAGIC = b"TOKSTOR1"
HEAD, FOOT = "<8sB3x32s", "<QQ8s"
HEAD_SIZE, FOOT_SIZE = struct.calcsize(HEAD), struct.calcsize(FOOT)
MANIFEST = "folder string, file string, number int, documents long, tokens long"


def train_dictionary(docs: DataFrame, tokenizer: str, rows: int, max_bytes: int, size: int, added: bool = False) -> bytes:
    """A dictionary from the id arrays of at most `rows` short texts (64 to `max_bytes` bytes), taken by hash.

    At most rows * max_bytes bytes reach the driver. Without such texts there is none.
    """
    length = F.octet_length("text")
    sample = sampled(docs.where(length.between(64, max_bytes)).select("doc_id", "text"), rows, "doc_id", "text").collect()
    arrays = [encoder(tokenizer, added).encode(row.text).tobytes() for row in sample]
    if not arrays:
        return b""
    try:
        return zstandard.train_dictionary(size, arrays, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the arrays themselves
        return b"".join(arrays)[-size:]


def write_store(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, level: int = 3,
                sample_rows: int = 1000, sample_bytes: int = 8192, dictionary_bytes: int = 65536,
                id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Writes every document's ids and `end_id`, in ascending doc_id order. Returns the manifest, a row per file.

    Null text is empty (the end id alone). Null doc_ids come first; ties stand together, in the order of the
    hash of their texts. Other columns are ignored. `added`: see `Encoder`. An empty table gives no files, or one without documents.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    dictionary = train_dictionary(given, tokenizer, sample_rows, sample_bytes, dictionary_bytes, added)
    mark = hashlib.sha256(dictionary).digest()
    files, at = pafs.FileSystem.from_uri(folder)
    files.create_dir(at, recursive=True)
    if dictionary:
        with files.open_output_stream(f"{at}/dictionary-{mark.hex()}.zdict") as out:
            out.write(dictionary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}.tok"
        encode = encoder(tokenizer, added)
        frame = zstandard.ZstdCompressor(level=level, dict_data=_known(folder, mark.hex())).compress
        files, at = pafs.FileSystem.from_uri(folder)
        end = np.array([end_id], encode.kind)
        ids, counts, offsets, place = [], [], [0], HEAD_SIZE
        with files.open_output_stream(f"{at}/{name}") as out:
            out.write(struct.pack(HEAD, MAGIC, encode.kind.itemsize, mark))
            for batch in slices(batches, 256):
                ids.append(batch.column(0))
                for text in batch.column(1).to_pylist():
                    tokens = np.concatenate([encode.encode(text), end])
                    data = frame(tokens.tobytes())
                    out.write(data)
                    counts.append(len(tokens))
                    offsets.append(offsets[-1] + len(data))
            place += offsets[-1]
            doc_ids = pa.chunked_array(ids, pa.int64()).combine_chunks()
            out.write(np.array(offsets, "<u8").tobytes() + np.array(counts, "<u8").tobytes()
                      + np.asarray(doc_ids.fill_null(0)).astype("<i8").tobytes()
                      + np.asarray(doc_ids.is_valid()).astype("<u1").tobytes())
            out.write(struct.pack(FOOT, place, len(counts), MAGIC))
        yield pa.RecordBatch.from_pylist([{"folder": folder, "file": name, "number": number,
                                           "documents": len(counts), "tokens": sum(counts)}],
                                         schema=pa.schema([("folder", pa.string()), ("file", pa.string()), ("number", pa.int32()),
                                                           ("documents", pa.int64()), ("tokens", pa.int64())]))

    order = ["doc_id", F.xxhash64("text")]
    parts = given.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(parts.mapInArrow(run, MANIFEST), "manifest")


def _known(folder: str, mark: str) -> zstandard.ZstdCompressionDict | None:
    """The dictionary with this hash, checked against it."""
    if mark == hashlib.sha256(b"").hexdigest():
        return None
    files, at = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{at}/dictionary-{mark}.zdict") as source:
        data = source.read()
    if hashlib.sha256(data).hexdigest() != mark:
        raise ValueError(f"the dictionary in {folder} has changed")
    return zstandard.ZstdCompressionDict(data)


class TokenFile:
    """One .tok file: its index at once, any document by its place in the file."""

    def __init__(self, folder: str, name: str):
        files, at = pafs.FileSystem.from_uri(folder)
        self.source = files.open_input_file(f"{at}/{name}")
        size = self.source.size()
        magic, width, mark = struct.unpack(HEAD, self.source.read_at(HEAD_SIZE, 0))
        place, n, end = struct.unpack(FOOT, self.source.read_at(FOOT_SIZE, size - FOOT_SIZE))
        if magic != MAGIC or end != MAGIC:
            raise ValueError(f"{name} is no whole token file")
        index = self.source.read_at(size - FOOT_SIZE - place, place)
        self.kind = np.dtype(f"<u{width}")
        self.offsets = np.frombuffer(index, "<u8", n + 1).astype(np.int64) + HEAD_SIZE
        self.counts = np.frombuffer(index, "<u8", n, 8 * (n + 1)).astype(np.int64)
        doc_ids = np.frombuffer(index, "<i8", n, 8 * (2 * n + 1))
        valid = np.frombuffer(index, "<u1", n, 8 * (3 * n + 1)).astype(bool)
        self.doc_ids = pa.array(doc_ids, pa.int64(), mask=~valid)
        self.decompress = zstandard.ZstdDecompressor(dict_data=_known(folder, mark.hex())).decompress

    def ids(self, place: int) -> np.ndarray:
        """The ids of one document: one short read."""
        frame = self.source.read_at(int(self.offsets[place + 1] - self.offsets[place]), int(self.offsets[place]))
        found = np.frombuffer(self.decompress(frame), self.kind)
        if len(found) != self.counts[place]:
            raise ValueError(f"document {place}: {len(found)} ids, the index says {self.counts[place]}")
        return found


def read_store(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids binary as unsigned 32-bit little-endian) of every document of the files in the manifest.

    start counts the ids of all documents before it. The manifest has a row per file, so the running total over
    it is small.
    """
    return _read(manifest, "doc_id long, start long, ids binary", lambda ids: ids.tobytes(), pa.binary())


def read_digests(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    found = _read(manifest, "doc_id long, start long, ids_crc32 long, n_tokens long",
                  lambda ids: zlib.crc32(ids.tobytes()), pa.int64(), counts=True)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def _read(manifest: DataFrame, schema: str, value, kind: pa.DataType, counts: bool = False) -> DataFrame:
    before = F.coalesce(F.sum("tokens").over(W.orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                file = TokenFile(row["folder"], row["file"])
                starts = row["start"] + np.cumsum(file.counts) - file.counts
                for low in range(0, len(file.counts), 256):
                    places = range(low, min(low + 256, len(file.counts)))
                    columns = [file.doc_ids[low:low + 256], pa.array(starts[low:low + 256]),
                               pa.array([value(file.ids(i).astype("<u4")) for i in places], kind)]
                    if counts:
                        columns.append(pa.array(file.counts[low:low + 256]))
                    yield pa.RecordBatch.from_arrays(columns, names)

    files = manifest.select("folder", "file", "number", before.alias("start")).where("file is not null")
    return files.repartition(max(1, manifest.count())).select("folder", "file", "start").mapInArrow(run, schema)
