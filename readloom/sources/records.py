"""FASTQ as a data source of its own: byte ranges that each reader aligns to the next record, so that nothing is shuffled.

``spark.dataSource.register(FastqRecords)``, then ``spark.read.format("fastq_records").load(path)`` or
``spark.readStream``.  Files are opened by Arrow's file systems (a path, or a URI such as hdfs:// or
s3://) in the tasks; for stores that only Spark reaches there is ``files.read_fastq``.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from readloom.sources.files import MalformedFastq

SCHEMA = "file string, at long, name string, seq string, plus string, qual string"
SPLIT_BYTES = 64 << 20
ROWS = 8192


@dataclass
class ByteRange(InputPartition):
    """Records that begin at or after ``low`` and before ``high`` of a file; a packed file is one range."""

    path: str
    low: int
    high: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path and not path.startswith("file:") else (fs.LocalFileSystem(), "/" + path[5:].lstrip("/") if path.startswith("file:") else path)


def listed(path: str) -> list[fs.FileInfo]:
    """The file, or the files of the folder, by name; hidden ones are left out."""
    system, inner = _opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inner)) if info.type == fs.FileType.Directory else [info]
    return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)


def ranges(files: list[fs.FileInfo], split_bytes: int, prefix: str = "") -> list[ByteRange]:
    out = []
    for f in files:
        step = max(1, f.size if f.path.endswith(".gz") else split_bytes)
        out += [ByteRange(prefix + f.path, low, min(low + step, f.size)) for low in range(0, f.size, step)]
    return out


def records(part: ByteRange, strict: bool) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """(at, name, seq, plus, qual): four lines from each record that begins in the range.

    A line that begins with @ is a header if the line after the next begins with +: after a quality
    line that begins with @ comes a header and then bases.  A record that isn't one raises if
    ``strict``; else it is left out, and reading goes on at the next header.
    """
    system, inner = _opened(part.path)
    with system.open_input_file(inner) as raw:
        packed = part.path.endswith(".gz")
        if packed:
            at, file = 0, gzip.open(raw)
        else:
            at = max(0, part.low - 1)
            raw.seek(at)
            file = raw
        lines = _lines(file, at)
        if part.low and not packed:
            next(lines, None)  # the end of a line that began before
        high = float("inf") if packed else part.high
        window: list[tuple[int, bytes]] = []
        aligned = part.low == 0 or packed
        while True:
            window += islice(lines, 4 - len(window))
            if not window or window[0][0] >= high:
                return
            texts = [x for _, x in window]
            header = texts[0].startswith(b"@") and len(texts) > 2 and texts[2].startswith(b"+")
            if not aligned and not header:
                window = window[1:]
                continue
            aligned = True
            if len(texts) == 4 and header and len(texts[1]) == len(texts[3]):
                yield (window[0][0], *texts)
                window = []
            elif texts == [b""]:
                return
            elif strict:
                raise MalformedFastq(f"malformed FASTQ record at byte {window[0][0]} of {part.path}")
            else:
                window, aligned = window[1:], False


def _lines(file, at: int) -> Iterator[tuple[int, bytes]]:
    """(place, line without its end), read in large blocks."""
    rest = b""
    while block := file.read(1 << 20):
        whole = (rest + block).split(b"\n")
        rest = whole.pop()
        for line in whole:
            yield at, line.removesuffix(b"\r")
            at += len(line) + 1
    if rest:
        yield at, rest.removesuffix(b"\r")


def batches(part: ByteRange, strict: bool) -> Iterator[pa.RecordBatch]:
    source = records(part, strict)
    while rows := list(islice(source, ROWS)):
        at, *texts = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([part.path] * len(rows)), pa.array(at, pa.int64()), *[pa.array(x, pa.binary()).cast(pa.string()) for x in texts]], ["file", "at", "name", "seq", "plus", "qual"])


class FastqRecords(DataSource):
    """Options: path; split_bytes, the size of a range; strict, false to leave malformed records out."""

    @classmethod
    def name(cls) -> str:
        return "fastq_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return FastqReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FastqStream(self.options)


class _Options:
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.strict = options.get("strict", "true").lower() == "true"
        self.prefix = self.path.split("://")[0] + "://" if "://" in self.path and not self.path.startswith("file:") else ""

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        yield from batches(partition, self.strict)


class FastqReader(_Options, DataSourceReader):
    def partitions(self) -> list[ByteRange]:
        return ranges(listed(self.path), self.split_bytes, self.prefix) or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.path else iter(())


class FastqStream(_Options, DataSourceStreamReader):
    """New files of a folder; an offset is the time and name of the last file read, of fixed size."""

    def _mark(self, f: fs.FileInfo) -> list:
        return [f.mtime_ns or 0, f.path]

    def initialOffset(self) -> dict:
        return {"mark": [0, ""]}

    def latestOffset(self) -> dict:
        return {"mark": max((self._mark(f) for f in listed(self.path)), default=[0, ""])}

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        return ranges([f for f in listed(self.path) if start["mark"] < self._mark(f) <= end["mark"]], self.split_bytes, self.prefix)

    def commit(self, end: dict) -> None:
        """Nothing is kept."""
