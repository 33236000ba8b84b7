"""What the operators of this subpackage share: the shared folder, sizes and column helpers."""

from __future__ import annotations

import contextlib
import ctypes
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[\x20\x09-\x0D]`: the white space of every contract here.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only where that setting is unset and all runs on one machine, as in tests, a temporary folder becomes it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="vitalspan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends there, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key that holds this part of the rows or more is hot: there are at most as many hot keys, whatever the size.
HOT_KEYS = 1000


def numbered(df: DataFrame, tag: str, name: str) -> DataFrame:
    """The rows, stored, with dense numbers from 0 in the order in which they stand (partition by partition).

    The driver gets a row a partition, and that is what is broadcast; no row moves."""
    spark, at, part, start = df.sparkSession, *unused(df, "_at", "_part", "_start")
    held = stored(df.withColumn(at, F.monotonically_increasing_id()), tag)
    counts = sorted((r[0], r[1]) for r in held.groupBy(F.shiftright(at, 33).cast("int")).count().collect())
    starts, n = [], 0
    for p, rows in counts:
        starts.append((p, n))
        n += rows
    small = F.broadcast(spark.createDataFrame(starts, f"`{part}` int, `{start}` long"))
    placed = held.withColumn(part, F.shiftright(at, 33).cast("int")).join(small, part)
    return placed.withColumn(name, F.col(start) + F.col(at).bitwiseAND((1 << 33) - 1)).drop(at, part, start)


def looked_up(rows: DataFrame, table: DataFrame, on: list[str], held: str, total: int) -> DataFrame:
    """rows joined with the one row of table (a stored one) for their key; rows without one go. `held`: how many of the
    `total` rows have that key. Hot keys meet their row by a broadcast of at most HOT_KEYS rows, the others by a shuffle."""
    kept = [c for c in table.columns if c != held]
    hot = table.filter(F.col(held) * HOT_KEYS >= max(total, 1)).select(*kept)
    cold = table.filter(F.col(held) * HOT_KEYS < max(total, 1)).select(*kept)
    (mark,) = unused(rows, "_hot")
    few = F.broadcast(hot.select(*on).withColumn(mark, F.lit(True)))
    rest = rows.join(few, on, "left").filter(F.col(mark).isNull()).drop(mark)
    return rows.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the cuts (sorted longs) are at most the key, compared as longs: found in two steps of about a root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    heads, all_blocks = (F.from_json(F.lit(json.dumps(x)), kind) for x, kind in (([b[0] for b in blocks], "array<bigint>"), (blocks, "array<array<bigint>>")))
    below = lambda listed: F.size(F.filter(listed, lambda c: c <= key))
    found = below(heads)
    return F.when(found == 0, 0).otherwise((found - 1) * step + below(F.try_element_at(all_blocks, found)))


#: The normaliser and pre-tokenizer that a tokenizer file must state for our own rules to hold for it.
WORD_LEVEL = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}],
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


def is_word_level(spec: dict) -> bool:
    """Whether a tokenizer file composes, lower-cases and splits texts as WORD_LEVEL says, and joins bytes by merges alone."""
    own = {"normalizer": (spec.get("normalizer") or {}).get("normalizers"), "pre_tokenizer": (spec.get("pre_tokenizer") or {}).get("pretokenizers"), "model": {k: spec["model"].get(k) for k in WORD_LEVEL["model"]}}
    added = all(not (t.get("normalized") or t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and t["content"].startswith("<") and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    return own == WORD_LEVEL and added and not spec.get("post_processor")


def give_back() -> None:
    """What this process has used and freed goes back to the system, from Arrow's pool and, where it knows how, the C library."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], made: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """made(part) of the batches, by parts of so many rows. A worker waits for its next task, and while later stages run, without
    what this one took."""
    try:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                yield made(batch.slice(lo, rows))
            del batch
    finally:
        give_back()


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, lengthened where df has a column of that name already (Spark doesn't tell upper from lower case)."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_bytes(df: DataFrame) -> int:
    """The size of the files that these rows are read from, as their file system tells it: no data are read. 0 without files."""
    spark, total = df.sparkSession, 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else kept; plain `lower` gives the same for texts of ASCII only, and faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and offset by Newton's method, with a weak pull of the slopes to zero in units of the spread of x."""
    middle, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.column_stack(((x - middle) / spread, np.ones(len(x))))
    w, pull = np.zeros(a.shape[1]), np.array([0.5] * x.shape[1] + [1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9), a.T @ (weight * (y - p)) - pull * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    slopes = w[:-1] / spread
    return tuple(float(v) for v in slopes), float(w[-1] - slopes @ middle)
