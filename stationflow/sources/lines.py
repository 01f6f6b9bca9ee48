"""A data source of gzipped text files, whatever their names, that streams each file.

Spark's own readers unzip by the file's ending. This source has a partition for every file;
its task opens the file as a stream (``pyarrow.fs``: local, HDFS, S3 and Google storage), unzips
as it reads and hands lines on in Arrow batches. What it holds does not depend on the file's
size. An empty list of files, and empty files, give no lines.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stationflow.session import importable

READ_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
SCHEMA = pa.schema([("path", pa.string()), ("value", pa.string())])


def unzipped(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of a gzip file, of one or several members, piece by piece."""
    member, begun = zlib.decompressobj(wbits=31), False
    for piece in pieces:
        full = False
        while piece or full:
            begun = True
            # A limit on what one step gives keeps very well packed files small, too.
            content = member.decompress(piece, BATCH_BYTES)
            yield content
            if member.eof:
                piece, member, begun, full = member.unused_data.lstrip(b"\0"), zlib.decompressobj(wbits=31), False, False
            else:
                piece, full = member.unconsumed_tail, len(content) == BATCH_BYTES
    if begun:
        raise EOFError("the file ends inside its packed content")


def lines(content: Iterator[bytes]) -> Iterator[list[str]]:
    """Lists of lines of about ``BATCH_BYTES``, without blank ones."""
    rest, out, size = b"", [], 0
    for piece in content:
        *whole, rest = (rest + piece).split(b"\n")
        for line in whole:
            if line.strip():
                out.append(line.rstrip(b"\r").decode("utf-8"))
                size += len(line)
        if size >= BATCH_BYTES:
            yield out
            out, size = [], 0
    if rest.strip():
        out.append(rest.rstrip(b"\r").decode("utf-8"))
    if out:
        yield out


class PathPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class GzipLinesReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[PathPartition]:
        return [PathPartition(p) for p in self.paths]

    def read(self, partition: PathPartition) -> Iterator[pa.RecordBatch]:
        if (local := re.fullmatch(r"(?:file:(?://)?)?(/.*)", partition.path)):
            system, inner = pafs.LocalFileSystem(), local[1]
        else:
            system, inner = pafs.FileSystem.from_uri(partition.path.replace("s3a://", "s3://", 1))
        with system.open_input_stream(inner, buffer_size=READ_BYTES) as file:
            for part in lines(unzipped(iter(lambda: file.read(READ_BYTES), b""))):
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(part)), pa.array(part)], schema=SCHEMA)


class GzipLines(DataSource):
    """Option ``paths``: the files, one a line."""

    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema) -> GzipLinesReader:
        return GzipLinesReader([p for p in self.options.get("paths", "").split("\n") if p])


def files_below(spark: SparkSession, path: str, without: str) -> list[str]:
    """Files under a path that are not empty and whose names do not end in ``without``; hidden ones
    are left out, as Spark leaves them out."""
    jvm = spark._jvm.org.apache.hadoop.fs
    root = jvm.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], [s.getPath() for s in system.globStatus(root) or []]
    while todo:
        for status in system.listStatus(todo.pop()):
            at, name = status.getPath(), status.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if status.isDirectory():
                todo.append(at)
            elif status.getLen() and not name.endswith(without):
                found.append(at.toString())
    return sorted(found)


def scan_gzip_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, value: the lines of gzipped files."""
    importable(spark)
    spark.dataSource.register(GzipLines)
    return spark.read.format("gzip_lines").option("paths", "\n".join(paths)).load()
