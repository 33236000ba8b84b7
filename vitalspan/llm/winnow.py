"""Document fingerprints by winnowing.

Every run of K code points has a rolling hash; of every WINDOW consecutive hashes the smallest is kept, the rightmost
on ties, with its position. Two texts that share a run of K + WINDOW - 1 code points share a kept hash: that guarantee
needs the positions, and holds whatever surrounds the run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import partitions, range_of

K, WINDOW = 16, 8
#: Rows of the sample that ranges of ids are cut by, for each range.
SAMPLE = 40
BASE, MIX = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def gram_hashes(codes: np.ndarray, k: int = K) -> np.ndarray:
    """32-bit hashes of all runs of k code points (k a power of two): polynomial, by doubling the length."""
    h, size, power = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(MIX), 1, BASE
    while size < k:
        h = h[:-size] * np.uint64(power) + h[size:]
        size, power = 2 * size, power * power % (1 << 64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(MIX)
    return h >> np.uint64(32)


def winnow(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes and their positions, in order. A text shorter than k is one run; an empty one keeps nothing."""
    n = len(codes)
    if n == 0:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    if n < k:
        weights = np.cumprod(np.full(n, BASE, np.uint64))
        whole = int(((codes.astype(np.uint64) + np.uint64(1)) * weights).sum()) * MIX % (1 << 64)
        return np.array([whole >> 32], np.uint32), np.zeros(1, np.int64)
    # Smallest hash first, then largest position: the minimum of these numbers is the hash to keep.
    keys = gram_hashes(codes, k) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(n - k + 1, dtype=np.uint64))
    size, window = 1, min(window, len(keys))
    while 2 * size <= window:
        keys = np.minimum(keys[:-size], keys[size:])
        size *= 2
    if size < window:
        keys = np.minimum(keys[: len(keys) - (window - size)], keys[window - size :])
    keys = keys[np.flatnonzero(np.diff(keys, prepend=~keys[:1]))]
    return (keys >> np.uint64(32)).astype(np.uint32), (np.uint64(0xFFFFFFFF) - (keys & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared part of two sets of hashes (given sorted and distinct); two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def written(numbers: np.ndarray) -> str:
    """Hashes, or positions, in order of position, eight hexadecimal digits each."""
    return numbers.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """doc and prints (array of hash, position) of every row: no shuffle. Null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("hash", pa.int64()), ("position", pa.int64())]))
        for batch in batches:
            found = []
            for t in batch.column(1):
                h, p = winnow(points(t.as_py() or ""), k, window)
                found.append([{"hash": int(x), "position": int(y)} for x, y in zip(h, p, strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[doc, "prints"])

    return docs.select(doc, text).mapInArrow(run, f"`{doc}` {dict(docs.dtypes)[doc]}, prints array<struct<hash:long,position:long>>")


def in_order(docs: DataFrame, doc: str, text: str, ranges: int) -> tuple[DataFrame, int]:
    """Rows (range, extra, key, tie, doc, text): each row in its range, and the first row of each range once more, as an extra,
    in the range before it (the first of all in the last). Whole texts are shuffled once; what the driver gets is a row a range.

    The order is by id, null first, then by a hash of the text. Ranges are cut at ids of a sample of SAMPLE rows a range, compared
    as longs; an id that several cuts fall on is cut into as many ranges by that hash. Copies that share both are one range."""
    lowest = -(1 << 63)
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("key", F.coalesce("doc", F.lit(lowest))).withColumn("tie", F.xxhash64("text"))
    spark, keys = docs.sparkSession, docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(lowest)).alias("key"))
    sample = sorted(r[0] for r in keys.sample(min(1.0, SAMPLE * ranges / max(1, keys.count())), 17).collect()) if ranges > 1 else []
    quantiles = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []
    cuts = sorted(set(quantiles))
    found = rows.withColumn("bucket", range_of(F.col("key"), cuts).cast("int"))
    several = spark.createDataFrame([(i, None if not i else cuts[i - 1], 1 if not i else quantiles.count(cuts[i - 1])) for i in range(len(cuts) + 1)], "bucket int, cut long, parts int")
    part = F.least(F.floor((F.col("tie") / 2.0**64 + 0.5) * F.col("parts")).cast("int"), F.col("parts") - 1)
    within = F.when(F.col("parts") < 2, 0).when(F.col("key") == F.col("cut"), part).otherwise(F.col("parts"))
    found = found.join(F.broadcast(several), "bucket").withColumn("range", (F.col("bucket") * (ranges + 1) + within).cast("int"))
    firsts = sorted((r["range"], *r["first"]) for r in found.groupBy("range").agg(F.min(F.struct("key", "tie")).alias("first")).collect())
    if not firsts:
        return found.select("range", F.lit(False).alias("extra"), "key", "tie", "doc", "text"), 0
    small = F.broadcast(spark.createDataFrame([(r, key, tie, firsts[i - 1][0]) for i, (r, key, tie) in enumerate(firsts)], "range int, key long, tie long, before int"))
    extras = found.join(small, ["range", "key", "tie"]).groupBy("before", "key", "tie").agg(F.min(F.struct("doc", "text")).alias("row"))
    extras = extras.select(F.col("before").alias("range"), F.lit(True).alias("extra"), "key", "tie", "row.doc", "row.text")
    return found.select("range", F.lit(False).alias("extra"), "key", "tie", "doc", "text").unionByName(extras), len(firsts)


def edited_likeness(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """How well fingerprints tell an edited text from another one, for every row.

    The edited text has its last quarter of code points (rounded down) replaced by as many of the beginning of the next
    document (or all it has), in ascending order of ids; after the last comes the first. doc, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, positions, edited_positions (of the hashes of either
    fingerprint: what a match says about where the texts agree). Ids are longs of any size, negative ones as well. Null ids come
    first, ties by a hash of the text. Null texts count as empty, texts of any length are read whole; a single row follows
    itself; repeated rows follow each other; an empty table gives no rows; other columns are ignored."""
    parts = partitions(docs.sparkSession)
    rows, _ = in_order(docs, doc, text, 4 * parts)
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()]
    names = [doc, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions", "edited_positions"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # the row that waits for the next: range, doc, text, codes, hashes and positions, sorted hashes

        def emit(codes, prints) -> tuple:
            _, d, t, own, (hashes, places), distinct = held
            n = len(own) // 4
            taken = codes[:n]
            edited = np.concatenate((own[: len(own) - n], taken)) if n else own
            new, moved = winnow(edited, k, window) if n else (hashes, places)
            digest = hashlib.sha256(edited.tobytes().decode("utf-32-le").encode() if n else t.encode()).hexdigest()
            return d, len(own), digest, written(hashes), written(new), likeness(distinct, np.unique(new)), likeness(distinct, prints), written(places), written(moved)

        for batch in batches:
            for r, extra, d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if extra and (held is None or held[0] != r):
                    continue  # only the first extra follows the range's last row
                t = t.as_py()
                codes = points(t)
                kept = winnow(codes, k, window)
                distinct = np.unique(kept[0])
                if held is not None and held[0] == r:
                    out.append(emit(codes, distinct))
                held = None if extra else (r, d, t, codes, kept, distinct)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    dealt = rows.repartition(parts, "range").sortWithinPartitions("range", "extra", "key", "tie", "text").select("range", "extra", "doc", "text")
    return dealt.mapInArrow(run, f"`{doc}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions string, edited_positions string")
