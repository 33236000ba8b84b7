"""Bytes of files of any size: their ends, and a hash of the whole, in pieces of bounded size."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

PIECE = 8 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as tasks open it, and the name there."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def staged(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """Rows written once and read again: as often as they are used, their source is read no more, and a lost executor
    costs no second reading. The folder is a new one below `folder`, else below spark.checkpoint.dir, which all executors
    share; where that is unset and all runs on one machine, a temporary one."""
    spark = rows.sparkSession
    base = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vitalspan-")
    path = f"{base.rstrip('/')}/staged-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def end_of(spark: SparkSession, path: str, size: int, tail: bool = False) -> bytes:
    """The first (or last) `size` bytes of a file, through Spark's file systems; the driver reads no more of it."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    length = fs.getFileStatus(where).getLen()
    size = min(size, length)
    stream = fs.open(where)
    try:
        stream.seek(length - size if tail else 0)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, length of a file or of all files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def hashed(files: DataFrame) -> DataFrame:
    """path, sha256 (hexadecimal), length: each file is streamed through one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, length in zip(batch["path"], batch["length"], strict=True):
                store, name = located(path)
                digest = hashlib.sha256()
                with store.open_input_stream(name) as stream:
                    while block := stream.read(PIECE):
                        digest.update(block)
                out.append((path, digest.hexdigest(), length))
            yield pd.DataFrame(out, columns=["path", "sha256", "length"])

    return files.mapInPandas(run, "path string, sha256 string, length long")
