"""Following files that grow, as a streaming source.

The offset of the stream is a byte position per file. A batch reads, from each file, the whole lines between two positions, so a
line that is appended between two triggers arrives once, also over a restart, and a line that is half written waits for
its end. Files are told apart by their device and number, so a file that was renamed goes on where it was, and one that takes
its place is read from the start; a file that became shorter is read from the start too. What this can't tell: a file that was cut off and
has grown beyond its old position between two triggers, or a new file that was given the number of a deleted one.
"""

from __future__ import annotations

import glob
import os
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "tailed_lines"
PART_BYTES = 32 << 20  # of a file that one task reads


class Span(InputPartition):
    """Lines that begin in [start, stop) of a file."""

    def __init__(self, path: str, identity: str, start: int, stop: int):
        self.path, self.identity, self.start, self.stop = path, identity, start, stop


def _identity(path: str) -> tuple[str, int, float] | None:
    try:
        at = os.stat(path)
    except FileNotFoundError:
        return None
    return f"{at.st_dev}:{at.st_ino}", at.st_size, at.st_mtime


def _last_line_end(path: str, size: int, least: int) -> int:
    """The end of the last whole line of the first `size` bytes, `least` if there is none after it."""
    with open(path, "rb") as file:
        stop = size
        while stop > least:
            start = max(least, stop - (1 << 16))
            file.seek(start)
            found = file.read(stop - start).rfind(b"\n")
            if found >= 0:
                return start + found + 1
            stop = start
    return least


def _renamed(path: str, identity: str) -> str | None:
    """The file of that identity in the folder of `path`."""
    return next((p for p in sorted(glob.glob(os.path.join(os.path.dirname(path), "*"))) if (_identity(p) or ("",))[0] == identity), None)


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.pattern = options["path"].removeprefix("file://")
        self.at_end = options.get("startat", "beginning").lower() == "end"
        self.max_age = float(options.get("maxageseconds", 0) or 0)
        self.known: dict[str, dict] = {}  # identity -> {path, at}: the latest offset this reader has given

    def _files(self) -> dict[str, tuple[str, int]]:
        """(path, size) by identity, of files that are young enough."""
        found = {}
        for path in sorted(glob.glob(self.pattern)):
            at = _identity(path)
            if at and os.path.isfile(path) and (not self.max_age or time.time() - at[2] <= self.max_age):
                found.setdefault(at[0], (path, at[1]))
        return found

    def initialOffset(self) -> dict:
        """What is there when the stream is first started: with `startAt=end`, its lines are passed over."""
        if not self.at_end:
            return {"files": {}}
        return {"files": {name: {"path": path, "at": _last_line_end(path, size, 0)} for name, (path, size) in self._files().items()}}

    def latestOffset(self) -> dict:
        """Where whole lines end now. Files that are gone stay known, so that a file never starts over while it exists."""
        now = dict(self.known)
        files = self._files()
        for name in set(now) - set(files):  # renamed since, perhaps to a name outside the pattern: its last lines count
            path = _renamed(now[name]["path"], name)
            at = path and _identity(path)
            if at:
                files[name] = (path, at[1])
        for name, (path, size) in files.items():
            before = now.get(name, {}).get("at", 0)
            if size < before:
                before = 0  # cut off and written anew
            now[name] = {"path": path, "at": _last_line_end(path, size, before)}
        self.known = now
        return {"files": now}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, at in sorted(end["files"].items()):
            begin = start["files"].get(name, {}).get("at", 0)
            if at["at"] < begin:
                begin = 0
            out += [Span(at["path"], name, first, min(at["at"], first + PART_BYTES)) for first in range(begin, at["at"], PART_BYTES)]
        return out

    def read(self, partition: Span) -> Iterator[tuple]:
        """Lines that begin in the span; the last one may end beyond it. A file that was renamed is looked for by its identity."""
        path = partition.path
        if (_identity(path) or ("",))[0] != partition.identity:
            path = _renamed(path, partition.identity)
            if path is None:
                raise FileNotFoundError(f"{partition.path} is gone, and with it lines that were announced")
        with open(path, "rb") as file:
            at = partition.start
            if at:
                file.seek(at - 1)
                at += len(file.readline()) - 1  # the rest of a line that began before the span, if any
            while at < partition.stop:
                line = file.readline()
                if not line:
                    return
                yield partition.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailedLines(DataSource):
    """Options: path (a pattern), startAt (beginning or end), maxAgeSeconds (of files)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, position bigint, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


def tail_lines(spark: SparkSession, path: str, start_at_end: bool = False, max_age_seconds: float | None = None) -> DataFrame:
    """A stream of (path, position, value) of the lines of all files that match `path`, as they are appended.

    `position` is the line's first byte. With `start_at_end`, lines that are there when the stream first starts are passed over;
    files that appear later are read from their start. Files must be on a path that driver and executors share.
    """
    spark.dataSource.register(TailedLines)
    reader = spark.readStream.format(FORMAT).option("startAt", "end" if start_at_end else "beginning")
    if max_age_seconds:
        reader = reader.option("maxAgeSeconds", str(max_age_seconds))
    return reader.load(path)
