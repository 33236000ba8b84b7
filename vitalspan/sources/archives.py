"""Members of zip archives of any size: a data source over the archive's directory.

The driver reads the directory at the archive's end and deals the members to partitions by their size; a task opens the
archive where it is, goes to each of its members and inflates it as a stream. Nothing is unpacked into files, and no archive is
a row."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vitalspan.sources.streams import located

#: Bytes of members to a partition; bytes of a batch.
PART_BYTES, BATCH_BYTES = 32 << 20, 4 << 20
ARROW = pa.schema([("archive", pa.string()), ("member", pa.string()), ("content", pa.binary()), ("error", pa.string())])


@dataclass
class _Members(InputPartition):
    names: list[str]


class MembersReader(DataSourceReader):
    def __init__(self, path: str, pattern: str, most: int):
        self.path, self.pattern, self.most = path, pattern, most

    def partitions(self) -> list[InputPartition]:
        store, name = located(self.path)
        with store.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
            found = sorted((i.filename, i.file_size) for i in archive.infolist() if not i.is_dir() and fnmatchcase(i.filename, self.pattern))
        parts: list[list[str]] = [[]]
        size = 0
        for member, length in found:
            if parts[-1] and size + length > self.most:
                parts.append([])
                size = 0
            parts[-1].append(member)
            size += length
        return [_Members(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, name = located(self.path)
        with store.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
            rows: list[tuple] = []
            size = 0
            for member in partition.names:
                try:
                    content, error = archive.read(member), None
                except (zipfile.BadZipFile, OSError, EOFError, NotImplementedError, RuntimeError) as e:  # a damaged member is its own loss
                    content, error = None, type(e).__name__
                rows.append((self.path, member, content, error))
                size += len(content or b"")
                if size > BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


class MembersSource(DataSource):
    """Format `archive_members`. Options: path; pattern of the members' whole names (default all); partbytes."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "archive string, member string, content binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return MembersReader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("partbytes", PART_BYTES)))


def members(spark: SparkSession, path: str, pattern: str = "*", part_bytes: int = PART_BYTES) -> DataFrame:
    """archive, member (its whole name), content, error of the members whose names match. A member is held whole, an archive never."""
    spark.dataSource.register(MembersSource)
    return spark.read.format("archive_members").option("pattern", pattern).option("partbytes", str(part_bytes)).load(path)
