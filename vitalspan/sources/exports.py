"""The elements of a wearable export in one pass: a data source that splits the XML by ranges of bytes.

A partition has the elements that begin in its range, and reads on to the end of the last of them. No character `<` stands
within a tag's attributes, so the first one from the range's beginning on is where markup goes on. What a range can't see is
whether it begins within a correlation, whose records repeat what stands beside them: elements before the first tag of a
correlation leave that open, the tags themselves are rows as well, and a row a partition tells what the partitions
before had left open. An export within an archive is one stream, inflated and split by one task.
"""

from __future__ import annotations

import html
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vitalspan.sources.streams import located, staged

ROOT = "HealthData"
#: Elements that are rows. A correlation is two rows: where it begins (`Correlation`) and where it ends (`/Correlation`). The end
#: of the root is one as well: without it the file is cut short.
OWNERS = {b"Record", b"Workout", b"ActivitySummary", b"Me", b"Correlation"}
#: Bytes of a partition, and of a piece that a task holds at once.
RANGE_BYTES, PIECE_BYTES = 64 << 20, 4 << 20
MAPS = "map<string,string>"
SCHEMA = f"part int, seq long, tag string, nested boolean, attributes {MAPS}, metadata array<struct<key:string,value:string>>, statistics array<{MAPS}>"
_MAP = pa.map_(pa.string(), pa.string())
ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("tag", pa.string()), ("nested", pa.bool_()), ("attributes", _MAP), ("metadata", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))), ("statistics", pa.list_(_MAP))])
TAG = re.compile(rb"""<!--.*?(?:-->|(?P<cut>\Z))|<(/?)([A-Za-z_][\w:.-]*+)((?:[^<>"'/]++|"[^"]*+"|'[^']*+'|/(?!>))*+)(/?)>""", re.DOTALL)
ATTRIBUTE = re.compile(rb"""([A-Za-z_][\w:.-]*)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def attributes(text: bytes) -> dict[str, str]:
    """Names and values of a tag's attributes; references are characters, line ends and tabs are spaces."""
    out = {}
    for m in ATTRIBUTE.finditer(text):
        value = (m[2] if m[2] is not None else m[3]).decode("utf-8", "replace")
        out[m[1].decode()] = html.unescape(re.sub(r"[\t\r\n]", " ", value)) if "&" in value else re.sub(r"[\t\r\n]", " ", value)
    return out


def elements(pieces: Iterator[bytes], start: int, end: float, first: bool) -> Iterator[tuple]:
    """(seq, tag, nested, attributes, metadata, statistics) of the elements that begin from byte `start` on and before `end`.

    pieces: the bytes from `start` on, as many as are asked for. seq: the offset of the first byte. nested: whether it stands within
    a correlation; None if the range doesn't say. first: nothing is before, so it isn't. An element without an end is none."""
    buffer, at, nested, owner, depth = b"", start, False if first else None, None, 0
    for piece in pieces:
        buffer += piece
        done = 0
        if at == start and start and not first:
            done = max(buffer.find(b"<"), 0)
        for m in TAG.finditer(buffer, done):
            if m["cut"] is not None:  # a comment goes on in the next piece
                done = m.start()
                break
            done = m.end()
            if m[3] is None:
                continue
            closing, name, own, empty = bool(m[2]), m[3], m[4], bool(m[5])
            if owner is not None:
                if closing:
                    depth -= 1
                    if depth == 0:
                        yield owner
                        owner = None
                    continue
                if depth == 1 and name == b"MetadataEntry":
                    owner[4].append(attributes(own))
                elif depth == 1 and name == b"WorkoutStatistics":
                    owner[5].append(attributes(own))
                depth += not empty
                continue
            seq = at + m.start()
            if seq >= end:
                return
            if name == b"Correlation":
                if not empty:
                    nested = not closing
                    yield seq, "/Correlation" if closing else "Correlation", nested, {}, [], []
            elif closing and name == ROOT.encode():
                yield seq, f"/{ROOT}", False, {}, [], []
            elif name in OWNERS and not closing:
                found = seq, name.decode(), nested, attributes(own), [], []
                if empty:
                    yield found
                else:
                    owner, depth = found, 1
        # What follows the last tag is text, but for a tag or comment that isn't whole yet.
        kept = done if buffer.startswith(b"<!--", done) else buffer.rfind(b"<", done)
        kept = kept if kept >= 0 else len(buffer)
        buffer, at = buffer[kept:], at + kept
        if owner is None and at >= end:
            return


@dataclass
class _Range(InputPartition):
    part: int
    start: int
    end: float


class MalformedExport(ValueError):
    """Not an export at all."""


class ExportReader(DataSourceReader):
    def __init__(self, path: str, member: str | None, range_bytes: int):
        self.path, self.member, self.range_bytes = path, member, range_bytes

    def partitions(self) -> list[InputPartition]:
        if self.member:
            return [_Range(0, 0, float("inf"))]
        store, name = located(self.path)
        size = store.get_file_info(name).size
        return [_Range(i, at, min(at + self.range_bytes, size)) for i, at in enumerate(range(0, max(size, 1), self.range_bytes))]

    def _pieces(self, start: int) -> Iterator[bytes]:
        store, name = located(self.path)
        with store.open_input_file(name) as file:
            if self.member:
                with zipfile.ZipFile(file) as archive, archive.open(self.member) as stream:
                    while piece := stream.read(PIECE_BYTES):
                        yield piece
                return
            file.seek(start)
            while piece := file.read(PIECE_BYTES):
                yield piece

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in elements(self._pieces(partition.start), partition.start, partition.end, partition.part == 0):
            rows.append(row)
            if len(rows) == 5000:
                yield self._batch(partition.part, rows)
                rows = []
        yield self._batch(partition.part, rows)

    @staticmethod
    def _batch(part: int, rows: list[tuple]) -> pa.RecordBatch:
        seq, tag, nested, own, metadata, statistics = zip(*rows, strict=True) if rows else ((),) * 6
        pairs = [[{"key": e.get("key"), "value": e.get("value")} for e in m] for m in metadata]
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(seq), pa.int32()), pa.array(seq, pa.int64()), pa.array(tag, pa.string()), pa.array(nested, pa.bool_()), pa.array([list(a.items()) for a in own], _MAP), pa.array(pairs, ARROW.field("metadata").type), pa.array([[list(s.items()) for s in x] for x in statistics], pa.list_(_MAP))],
            schema=ARROW,
        )


class ExportSource(DataSource):
    """Format `wearable_export`. Options: path, member (of a zip archive), rangebytes."""

    @classmethod
    def name(cls) -> str:
        return "wearable_export"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ExportReader(self.options["path"], self.options.get("member"), int(self.options.get("rangebytes", RANGE_BYTES)))


def export_member(names: list[str]) -> str | None:
    """The export within an archive: export.xml, in its usual folder if there are several; never the document form of it."""
    found = [n for n in names if PurePosixPath(n).name == "export.xml"]
    return min(found, key=lambda n: (PurePosixPath(n).parent.name != "apple_health_export", len(n), n), default=None)


def member_of(path: str) -> str | None:
    """The export's name within an archive, from the archive's directory alone; None of a file that is no archive."""
    if not path.lower().endswith(".zip"):
        return None
    store, name = located(path)
    with store.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
        found = export_member(archive.namelist())
    if found is None:
        raise MalformedExport(f"{path}: no export.xml in it")
    return found


def member_head(path: str, size: int) -> bytes:
    """The first bytes of the export within an archive."""
    member, (store, name) = member_of(path), located(path)
    with store.open_input_file(name) as file, zipfile.ZipFile(file) as archive, archive.open(member) as stream:
        return stream.read(size)


def settled(rows: DataFrame) -> DataFrame:
    """Rows (staged ones) with nested known: the last tag of a correlation in the partitions before tells where a range begins.

    The driver gets a row a partition."""
    mark = F.col("tag").endswith("Correlation")
    last = rows.groupBy("part").agg(F.max_by(F.when(mark, F.col("tag")), F.when(mark, F.col("seq"))).alias("tag"))
    inside, begun = False, []
    for part, tag in sorted((r["part"], r["tag"]) for r in last.collect()):
        begun.append((part, inside))
        inside = inside if tag is None else tag == "Correlation"
    known = F.broadcast(rows.sparkSession.createDataFrame(begun, "part int, inside boolean"))
    return rows.join(known, "part").withColumn("nested", F.coalesce("nested", "inside")).select(*rows.columns)


def scan(spark: SparkSession, path: str, folder: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The elements of an export or of the one in an archive, read once: part, seq, tag, nested, attributes, metadata, statistics."""
    spark.dataSource.register(ExportSource)
    member = member_of(path)
    reader = spark.read.format("wearable_export").option("rangebytes", str(range_bytes))
    return settled(staged((reader.option("member", member) if member else reader).load(path), folder))
