"""A Spark data source for FASTQ files, plain or gzip.

Plain files are read in byte ranges, each from its first whole record, so a
large file is many tasks; a gzip file is one task.
"""

from __future__ import annotations

import gzip
import io

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, idx long, header string, seq string, qual string"
SPLIT = 64 << 20


class Part(InputPartition):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def files_of(path: str) -> list[tuple[str, int]]:
    fs, at = opened(path)
    info = fs.get_file_info(at)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if info.type == pafs.FileType.Directory:
        found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
        return sorted((prefix + f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    return [(path, info.size)]


def _resync(f, at: int) -> int:
    """The place of the first record at or after at: a line with @ whose next but one starts with +."""
    f.seek(max(0, at - 1))
    if at:
        f.readline()
    lines: list[tuple[int, bytes]] = []
    while True:
        here, line = f.tell(), f.readline()
        lines.append((here, line))
        if not line:
            return here
        for k in range(max(0, len(lines) - 4), len(lines) - 2):
            if lines[k][1].startswith(b"@") and lines[k + 2][1].startswith(b"+") and not lines[k + 1][1].startswith((b"@", b"+")):
                return lines[k][0]


def records(f, start: int = 0, end: int | None = None):
    """(offset, header, seq, qual) of records that start before end; lines before an @ are passed over, a cut last record is dropped."""
    f.seek(start)
    at = start
    while end is None or at < end:
        line = f.readline()
        if not line:
            return
        if not line.startswith(b"@"):
            at += len(line)
            continue
        seq, plus, qual = f.readline(), f.readline(), f.readline()
        if not qual:
            return
        yield at, *(x.rstrip(b"\r\n").decode() for x in (line[1:], seq, qual))
        at += len(line) + len(seq) + len(plus) + len(qual)


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.split = int(options.get("split", SPLIT))

    def partitions(self):
        out = []
        for path in self.paths:
            for name, size in files_of(path):
                if name.endswith(".gz"):
                    out.append(Part(name, 0, None))
                else:
                    out += [Part(name, s, min(size, s + self.split)) for s in range(0, max(size, 1), self.split)]
        return out

    def read(self, part: Part):
        fs, at = opened(part.path)
        if part.end is None:
            f = gzip.GzipFile(fileobj=fs.open_input_stream(at, compression=None))
            stream = _Forward(io.BufferedReader(f))
            start = 0
        else:
            stream = fs.open_input_file(at)
            stream = io.BufferedReader(stream, 1 << 20) if not hasattr(stream, "peek") else stream
            start = _resync(stream, part.start)
        rows = []
        for offset, header, seq, qual in records(stream, start, part.end):
            rows.append((part.path, offset, header, seq, qual))
            if len(rows) >= 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


class _Forward:
    """A stream read once from its start, for which seek(0) does nothing."""

    def __init__(self, f):
        self.f, self.readline = f, f.readline

    def seek(self, at: int):
        assert at == 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "idx", "header", "seq", "qual"])


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """(file, idx, header, seq, qual); idx is the record's byte offset, so it ascends in a file."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("path", ",".join(paths)).option("split", split).load()
