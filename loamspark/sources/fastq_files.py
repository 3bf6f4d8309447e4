"""FASTQ files, wrapped records too, as a Python data source: plain files are split by bytes, compressed ones are read whole."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a plain file's split, bytes before it from which the first record is looked for, and records that must follow a line that is taken for one's head.
SPLIT_BYTES = 32 << 20
CONTEXT_BYTES = 64 << 10
CHAIN = 8
_BATCH = 4096
_SCHEMA = pa.schema([("read_id", pa.string()), ("sequence", pa.string()), ("quality", pa.string()), ("file", pa.string()), ("at", pa.int64())])
_BASES = re.compile(rb"[A-Za-z*.\-]*$")

Line = tuple[int, bytes]
Record = tuple[int, bytes, bytes, bytes]


def records(lines: Iterator[Line], strict: bool = False) -> Iterator[Record]:
    """Start, name, sequence and quality of every record of lines ``(start, line)`` in order.

    A record is as long as its sequence says; one that the file cuts short is left out, and so are lines between records. With ``strict`` such lines, and
    lines that no sequence or no quality of that length can have, end it: what began there was no record's head.
    """
    for at, line in lines:
        if not line.startswith(b"@"):
            if strict and line:
                return
            continue
        bases, quality, have, whole = [], [], -1, 0
        for _, part in lines:
            if have < 0:
                if part.startswith(b"+"):
                    have, whole = 0, sum(map(len, bases))
                elif strict and not _BASES.match(part):
                    return
                else:
                    bases.append(part)
                continue
            quality.append(part)
            have += len(part)
            if have >= whole:
                break
        else:
            return
        if strict and have > whole:
            return
        head = line[1:].split(None, 1)
        yield at, head[0] if head else b"", b"".join(bases), b"".join(quality)


def lines_from(file: pa.NativeFile, start: int) -> Iterator[Line]:
    """The lines that begin at ``start`` or later, without their ends, and where they begin. ``start`` itself may lie within a line, which is then left out."""
    at = max(0, start - 1)
    file.seek(at)
    rest, first = b"", start > 0
    while block := file.read(1 << 20):
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for part in parts:
            if not first:
                yield at, part[:-1] if part.endswith(b"\r") else part
            first = False
            at += len(part) + 1
    if rest and not first:
        yield at, rest[:-1] if rest.endswith(b"\r") else rest


def first_record(file: pa.NativeFile, start: int, context: int = CONTEXT_BYTES) -> int | None:
    """Where the first record begins at or after ``start``; None without one.

    A quality may begin with '@', so lines from ``context`` bytes before on are tried until one is followed by CHAIN whole records, or by whole records to the file's end; the records from there on tell.
    """
    if start == 0 or start <= context:
        return next((r[0] for r in records(lines_from(file, 0)) if r[0] >= start), None)
    tried = start - context
    while True:
        head = next((at for at, line in lines_from(file, tried) if line.startswith(b"@")), None)
        if head is None:
            return None
        chain = list(islice(records(lines_from(file, head), strict=True), CHAIN))
        if len(chain) == CHAIN or (chain and _ends(file, chain[-1][0])):
            return next((r[0] for r in records(lines_from(file, head)) if r[0] >= start), None)
        tried = head + 1


def _ends(file: pa.NativeFile, at: int) -> bool:
    """Whether the record that begins there is the file's last, but for one that is cut short."""
    following = records(lines_from(file, at))
    next(following, None)
    return next(following, None) is None


@dataclass
class Split(InputPartition):
    file: str
    start: int
    end: int


class FastqReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files = json.loads(options["files"])
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.context = int(options.get("contextbytes", CONTEXT_BYTES))

    def partitions(self) -> list[Split]:
        out = []
        for file, size in self.files:
            step = max(size, 1) if file.endswith((".gz", ".bz2")) else self.split
            out += [Split(file, at, min(size, at + step)) for at in range(0, size, step)]
        return out or [Split("", 0, 0)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.file:
            return
        system, path = pafs.FileSystem.from_uri(split.file)
        if split.file.endswith((".gz", ".bz2")):
            with system.open_input_stream(path, compression="detect") as stream:
                yield from self._batches(records(_stream_lines(stream)), split.file, None)
            return
        with system.open_input_file(path) as file:
            start = first_record(file, split.start, self.context)
            if start is not None and start < split.end:
                yield from self._batches(records(lines_from(file, start)), split.file, split.end)

    def _batches(self, found: Iterator[Record], file: str, end: int | None) -> Iterator[pa.RecordBatch]:
        def text(column: int, rows: list[Record]) -> pa.Array:
            return pa.array([r[column].decode("utf-8", "replace") for r in rows], pa.string())

        while True:
            rows = list(islice(found, _BATCH))
            keep = rows if end is None else [r for r in rows if r[0] < end]
            if keep:
                yield pa.RecordBatch.from_arrays([text(1, keep), text(2, keep), text(3, keep), pa.array([file] * len(keep)), pa.array([r[0] for r in keep], pa.int64())], schema=_SCHEMA)
            if not rows or len(keep) < len(rows):
                return


def _stream_lines(stream: pa.NativeFile) -> Iterator[Line]:
    rest, at = b"", 0
    while block := stream.read(1 << 20):
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for part in parts:
            yield at, part[:-1] if part.endswith(b"\r") else part
            at += len(part) + 1
    if rest:
        yield at, rest


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loam_fastq"

    def schema(self) -> str:
        return "read_id string, sequence string, quality string, file string, at long"

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def _listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files that a path, folder or pattern names, and their bytes, by the session's own file systems; names that begin with '_' or '.' are left out."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(at) or []:
        for own in system.listStatus(status.getPath()):
            if own.isFile() and own.getPath().getName()[0] not in "_.":
                found.append((re.sub(r"^file:/+", "file:///", own.getPath().toString()), own.getLen()))
    if not found:
        raise FileNotFoundError(path)
    return sorted(found)


def read_fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, context_bytes: int = CONTEXT_BYTES) -> DataFrame:
    """``read_id, sequence, quality, file, at`` of every record below ``path``, at its first byte in the (uncompressed) file.

    Records may be wrapped, lines end with CRLF, reads be empty. A plain file is split by bytes: a split holds the records that begin in it, and its reader finds the first one from ``context_bytes`` before. What a quality would have to
    imitate to be taken for a record there is CHAIN whole records. Compressed files are read whole. Executors open files through Arrow's file systems (local, S3, GCS, HDFS).
    """
    spark.dataSource.register(FastqSource)
    return spark.read.format("loam_fastq").option("files", json.dumps(_listed(spark, path))).option("splitBytes", split_bytes).option("contextBytes", context_bytes).load()
