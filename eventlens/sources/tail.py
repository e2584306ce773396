"""Follow growing text files: a streaming source whose offsets are bytes within files.

A micro-batch takes what whole lines were added to each file since the batch before; a line without its end waits. A file is known
by its path and its first bytes, so a rotated file is read on under its new name, and one that starts anew under an old name
is read from its beginning. Offsets hold all of this, so a restart goes on from the checkpoint.
"""

from __future__ import annotations

import posixpath
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# executors may lack this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD = 96
BLOCK = 1 << 16
SCHEMA = "file string, position bigint, value string"


@dataclass
class Piece(InputPartition):
    """Lines that begin in [start, stop) of the file whose first bytes are `head`."""

    path: str
    head: str
    start: int
    stop: int


def same_file(a: str, b: str) -> bool:
    """Whether two heads can be of one file that has grown; an empty file has no identity."""
    return bool(a and b) and (a.startswith(b) or b.startswith(a))


def changes(start: dict, end: dict) -> dict[str, tuple[int, int]]:
    """Bytes (from, to) of each file at `end` that `start` has not seen.

    Files are {path: [position, head]}. A path with another head is a new file; a new path whose head
    belonged to a file that its own path no longer holds is that file, renamed.
    """
    kept = {p for p in end if p in start and same_file(start[p][1], end[p][1]) and end[p][0] >= start[p][0]}
    moved = {p: f for p, f in start.items() if p not in kept and f[0] > 0}
    out = {}
    for path, (stop, head) in sorted(end.items()):
        begin = 0
        if path in kept:
            begin = start[path][0]
        else:
            old = next((p for p, f in sorted(moved.items()) if same_file(f[1], head) and f[0] <= stop), None)
            if old is not None:
                begin = moved.pop(old)[0]
        if stop > begin:
            out[path] = (begin, stop)
    return out


class Files:
    """The followed files: those of a folder, one file, or those that a pattern in the last part of the path matches.

    A rotated file is read to its end only if its new name is among them.
    """

    def __init__(self, path: str):
        if path.startswith("file:") and not path.startswith("file://"):
            path = path[len("file:") :]
        folder, name = posixpath.split(path)
        if not any(c in name for c in "*?["):
            fs, place = pafs.FileSystem.from_uri(path)
            if not fs.get_file_info(place).is_file:
                folder, name = path, "*"
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.pattern = name

    def listed(self) -> list[pafs.FileInfo]:
        found = self.fs.get_file_info(pafs.FileSelector(self.folder, allow_not_found=True))
        return sorted((f for f in found if f.is_file and fnmatch(f.base_name, self.pattern) and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)

    def head(self, path: str) -> str:
        with self.fs.open_input_file(path) as f:
            return f.read(HEAD).hex()

    def state(self) -> dict:
        """Path, end of the last whole line and head of every file."""
        out = {}
        for info in self.listed():
            try:
                with self.fs.open_input_file(info.path) as f:
                    head = f.read(min(HEAD, info.size)).hex()
                    out[info.path] = [last_line_end(f, info.size), head]
            except FileNotFoundError:  # rotated away since it was listed
                continue
        return out

    def located(self, path: str, head: str) -> str:
        """The path at which the file with this head now is."""
        for candidate in [path, *(f.path for f in self.listed() if f.path != path)]:
            try:
                if self.head(candidate).startswith(head):
                    return candidate
            except FileNotFoundError:
                continue
        raise FileNotFoundError(f"{path} was removed before it was read to its end")


def last_line_end(f, size: int) -> int:
    """Position behind the last line feed before `size`; 0 if there is none."""
    stop = size
    while stop > 0:
        start = max(0, stop - BLOCK)
        f.seek(start)
        found = f.read(stop - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        stop = start
    return 0


def next_line_start(f, at: int, stop: int) -> int:
    """The first position from `at` on where a line begins; `stop` if none does before it."""
    if at == 0:
        return 0
    at -= 1
    while at < stop:
        f.seek(at)
        block = f.read(min(BLOCK, stop - at))
        found = block.find(b"\n")
        if found >= 0:
            return at + found + 1
        if not block:
            break
        at += len(block)
    return stop


class LogTailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.latest = options.get("startingposition", options.get("startingPosition", "earliest")) == "latest"
        self.piece = int(options.get("piecebytes", options.get("pieceBytes", 64 << 20)))

    def initialOffset(self) -> dict:
        return {"files": Files(self.path).state() if self.latest else {}}

    def latestOffset(self) -> dict:
        return {"files": Files(self.path).state()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        out = []
        for path, (begin, stop) in changes(start["files"], end["files"]).items():
            head = end["files"][path][1]
            out += [Piece(path, head, at, min(at + self.piece, stop)) for at in range(begin, stop, self.piece)]
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        files = Files(self.path)
        path = files.located(partition.path, partition.head)
        with files.fs.open_input_file(path) as f:
            size = f.size()
            at = next_line_start(f, partition.start, partition.stop)
            f.seek(at)
            rest, first = b"", at
            # a line that begins in this piece is read to its end, which may lie in the next one
            while at < size and (at < partition.stop or rest):
                block = f.read(min(1 << 20, size - at))
                if not block:
                    break
                at += len(block)
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                values, places = [], []
                for line in lines:
                    if first >= partition.stop:
                        rest, at = b"", size
                        break
                    places.append(first)
                    values.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                    first += len(line) + 1
                if values:
                    yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(values)), pa.array(places, pa.int64()), pa.array(values)], ["file", "position", "value"])
                if first >= partition.stop:
                    break


class LogTail(DataSource):
    """`file`, `position` (of the line's first byte) and `value` of each whole line.

    Options: `path` (a folder, or a pattern for the files in one), `startingPosition` (`earliest` or `latest`, for a query without a checkpoint), `pieceBytes` (the most that one
    task reads of a file). Files must be reachable from the driver and all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogTailReader:
        return LogTailReader(dict(self.options))


def tail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Stream of the lines added to the files at `path`."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("path", path).options(**options).load()
