"""A Spark source for snapshot archives: spark.read.format("gazetteer_archive").option("table", "street").load(path).

Planning reads the archive's directory and the first line of each member and refuses an archive that does not keep the contract. Executors unpack: a compressed member is one partition,
as it can only be read from its start; a stored one is cut into byte ranges of `rangeBytes`, each of which takes the lines that begin in it. Nothing is laid out on disk and
the driver reads no rows. Paths are those of a file system that pyarrow knows (a mounted folder, file://, hdfs://, s3://), seen by driver and executors alike.

Fields come as text: an unquoted empty field is null, a quoted one an empty text; blank lines are skipped; a line that does not fit is an error. Lines end at a line feed, also within quotes.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "gazetteer_archive"
#: Bytes of a stored member that one partition reads, and of a batch of lines.
RANGE_BYTES = 64 << 20
BATCH_BYTES = 1 << 20


def opened(path: str) -> IO[bytes]:
    """A file of any file system, for random access."""
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


@dataclass
class Member(InputPartition):
    """A whole compressed member, or the bytes first to past of a file where a part of a stored one lies."""

    name: str
    first: int | None = None
    past: int | None = None
    end: int | None = None


def _data_offset(f: IO[bytes], info: zipfile.ZipInfo) -> int:
    """Where a member's bytes begin: after its local header, whose name and extra field have their own lengths."""
    f.seek(info.header_offset + 26)
    lengths = f.read(4)
    return info.header_offset + 30 + int.from_bytes(lengths[:2], "little") + int.from_bytes(lengths[2:], "little")


class _Lines(io.RawIOBase):
    """The lines of a file that begin at first or after it and before past; past the end of the member nothing is read."""

    def __init__(self, f: IO[bytes], first: int, past: int, end: int, whole_first: bool):
        self._f, self._at, self._past, self._end = f, first, past, end
        if not whole_first:  # the line that holds the byte before begins in an earlier range
            self._at = self._next(first - 1)

    def _next(self, at: int) -> int:
        """Where the line after the one that holds the byte `at` begins."""
        while at < self._end:
            self._f.seek(at)
            part = self._f.read(min(1 << 16, self._end - at))
            found = part.find(b"\n")
            if found >= 0:
                return at + found + 1
            at += len(part)
        return self._end

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        if self._at >= self._past:
            return 0
        stop = self._past if self._past < self._end else self._end
        self._f.seek(self._at)
        part = self._f.read(min(len(target), stop - self._at))
        target[: len(part)] = part
        self._at += len(part)
        if self._at >= stop and stop < self._end and not part.endswith(b"\n"):  # the last line goes on in the next range
            self._past = self._end = self._next(stop)
        return len(part)


class _Reader(DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, table: str, range_bytes: int):
        self._names, self._path, self._table, self._range = schema.names, path, table, range_bytes

    def partitions(self) -> list[Member]:
        from .snapshot import SPECS, members

        with opened(self._path) as f, zipfile.ZipFile(f) as archive:
            found = members(archive)
            info = archive.getinfo(found[next(s.prefix for s in SPECS if s.table == self._table)])
            if info.compress_type != zipfile.ZIP_STORED:
                return [Member(info.filename)]
            at = _data_offset(f, info)
            end = at + info.file_size
            return [Member(info.filename, first, min(first + self._range, end), end) for first in range(at, end, self._range)]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        with opened(self._path) as f, zipfile.ZipFile(f) as archive:
            if partition.first is None:
                head, lines = True, archive.open(partition.name)
            else:
                head = partition.first == _data_offset(f, archive.getinfo(partition.name))
                lines = io.BufferedReader(_Lines(f, partition.first, partition.past, partition.end, head), 1 << 16)
            if head:
                lines.readline()  # the header, which planning has checked
            rest = lines.peek(1) if hasattr(lines, "peek") else b"x"
            if not rest:
                return
            options = csv.ConvertOptions(column_types={n: pa.string() for n in self._names}, null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=False)
            try:
                read = csv.open_csv(pa.PythonFile(lines, "r"), csv.ReadOptions(column_names=self._names, block_size=BATCH_BYTES), csv.ParseOptions(delimiter=";"), options)
            except pa.ArrowInvalid as e:
                if "Empty CSV file" in str(e):  # blank lines only
                    return
                raise
            yield from read


class ArchiveSource(DataSource):
    """Options: path, table (a name of the contract), rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        from .snapshot import SPECS

        spec = next((s for s in SPECS if s.table == self.options.get("table")), None)
        if spec is None:
            raise ValueError(f"the option table has to be one of {', '.join(s.table for s in SPECS)}")
        return T.StructType([T.StructField(n, T.StringType()) for n in spec.names])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(schema, self.options["path"], self.options["table"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)
