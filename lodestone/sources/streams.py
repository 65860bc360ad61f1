"""Files of server-sent events or of JSON lines as a source: a stream with replayable offsets, or a batch.

An offset says, for each file, up to which byte its finished blocks go.  What a file has after its last
blank line (or line end) is unfinished and waits: it is read, from the same byte, once it is
finished.  So nothing is kept between batches, and a stream that was killed reads on where its
checkpoint says, each block once.  Files may grow and come, but not change.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, at long, event string, data string"
#: A line's end; a carriage return only with what follows it, as a line feed may.
_EOL = rb"(?:\r\n|\n|\r(?=[^\n]))"
_ENDS = {"sse": re.compile(_EOL + rb"(?:\r\n|\n|\r(?=[^\n]))"), "lines": re.compile(rb"\n")}
_LINE = re.compile(r"\r\n|\n|\r")
_WINDOW = 1 << 16


class Range(InputPartition):
    """Whole blocks of a file: from the byte where one begins to that where one ends."""

    def __init__(self, file: str, begin: int, end: int):
        self.file, self.begin, self.end = file, begin, end


class Files:
    """Files below a path, in the byte terms of the source."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "sse")
        self.part = int(options.get("partBytes", 64 << 20))
        self.store, self.folder = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        self.ends = _ENDS[self.kind]

    def sizes(self) -> dict[str, int]:
        found = self.store.get_file_info(pafs.FileSelector(self.folder, recursive=True, allow_not_found=True))
        return {i.path: i.size for i in found if i.type == pafs.FileType.File and not i.base_name.startswith((".", "_"))}

    def finished(self, file: str, begin: int, size: int) -> int:
        """Where the last finished block before ``size`` ends, not before ``begin``; looked for from the end."""
        with self.store.open_input_file(file) as f:
            high = size
            while high > begin:
                low = max(begin, high - _WINDOW)
                found = [m.end() for m in self.ends.finditer(f.read_at(min(size, high + 4) - low, low))]
                if found:
                    return low + found[-1]
                high = low
        return begin

    def next_end(self, f, at: int, end: int) -> int:
        """The first end of a block at or after a byte, ``end`` if there is none before."""
        low = at
        while low < end:
            m = self.ends.search(f.read_at(min(_WINDOW, end - low) + 4, low))
            if m and low + m.end() <= end:
                return low + m.end()
            low += _WINDOW
        return end

    def ranges(self, begins: dict[str, int], ends: dict[str, int]) -> list[Range]:
        out = []
        for file, end in sorted(ends.items()):
            begin = begins.get(file, 0)
            if end - begin > self.part:
                with self.store.open_input_file(file) as f:
                    while end - begin > self.part:
                        cut = self.next_end(f, begin + max(self.part - 4, 0), end)
                        out.append(Range(file, begin, cut))
                        begin = cut
            if begin < end:
                out.append(Range(file, begin, end))
        return out

    def read(self, part: Range | None) -> Iterator[tuple]:
        if part is None:  # so Spark asks if there is no part
            return
        with self.store.open_input_file(part.file) as f:
            raw = f.read_at(part.end - part.begin, part.begin)
        at = 0
        for m in self.ends.finditer(raw + b" "):  # the end of a range is the end of a block
            block, begin = raw[at : m.start()].decode("utf-8", "replace"), at
            at = m.end()
            if (found := _line(block) if self.kind == "lines" else _event(block)) is not None:
                yield (part.file, part.begin + begin, *found)


def _line(block: str) -> tuple[str, str] | None:
    return ("message", block.rstrip("\r")) if block.strip() else None


def _event(block: str) -> tuple[str, str] | None:
    """Name and data of a block; comments do not count, a block without data is none."""
    name, data = "message", []
    for line in _LINE.split(block.removeprefix("\ufeff")):
        field, _, value = line.partition(":")
        if field == "data":
            data.append(value.removeprefix(" "))
        elif field == "event":
            name = value.removeprefix(" ")
    return (name, "\n".join(data)) if data else None


class _Batch(DataSourceReader):
    def __init__(self, files: Files):
        self.files = files

    def partitions(self) -> list[Range]:
        sizes = self.files.sizes()
        return self.files.ranges({}, {f: self.files.finished(f, 0, n) for f, n in sizes.items()})

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.files.read(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, files: Files):
        self.files, self.known = files, {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Finished bytes by file; a file is looked at only beyond what is known of it."""
        sizes = self.files.sizes()
        self.known = {f: self.files.finished(f, min(self.known.get(f, 0), n), n) for f, n in sizes.items()}
        return {f: n for f, n in self.known.items() if n}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.known = {f: max(n, self.known.get(f, 0)) for f, n in end.items()}
        return self.files.ranges(start, end)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.files.read(partition)


class MessageFiles(DataSource):
    """``spark.read`` or ``spark.readStream`` ``.format("message_files")``; options path, kind (sse or lines) and partBytes."""

    @classmethod
    def name(cls) -> str:
        return "message_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(Files(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(Files(dict(self.options)))


def message_files(spark: SparkSession, path: str, kind: str = "sse", part_bytes: int = 64 << 20, stream: bool = False) -> DataFrame:
    """Events (file, at, event, data) of all files below a path; ``at`` is the byte where an event begins, so file and ``at``
    name it.  Kinds are 'sse' (any line end; comments are left out, data lines joined; a block without data is none) and
    'lines' (a line is an event's data).  The path must be one that pyarrow opens on driver and executors."""
    spark.dataSource.register(MessageFiles)
    source = (spark.readStream if stream else spark.read).format("message_files")
    return source.option("path", path).option("kind", kind).option("partBytes", str(part_bytes)).load()


def token_of(data: Column) -> tuple[Column, Column]:
    """Token and done mark of a line of a model's stream; both null if it is no such JSON object."""
    j = F.from_json(data, "struct<message:struct<content:string>,done:boolean>")
    known = j["message"]["content"].isNotNull() | j["done"].isNotNull()
    return F.when(known, F.coalesce(j["message"]["content"], F.lit(""))), F.when(known, F.coalesce(j["done"], F.lit(False)))
