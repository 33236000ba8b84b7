"""Importance resampling of documents towards a target distribution, by external sort-count.

A feature is a word or two words in a row; its bucket is a CRC-32. One pass over the texts writes streams of packed 16-bit
buckets, each for a block of documents and with the number of words of each, from which the offsets of the documents follow.
The streams are sorted and run-length encoded for the counts, and later read again: a bucket's gain is gathered for each
feature and added up between the offsets with np.add.reduceat. Texts are read once, and only rows of a few numbers are shuffled.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import partitions, stored

BUCKETS, SHARE, LEAST_WORDS, SEED = 10000, 25, 20, 7
#: Words of a block of documents (a longer document is a block); words that a worker remembers, and the longest of them.
BLOCK_WORDS, CACHED_WORDS, CACHED_LENGTH = 1 << 18, 1 << 19, 63
#: Letters of words, A-Z as a-z: ASCII digits and letters and all bytes of other characters. What parts words becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def _shifts() -> np.ndarray:
    """For each number of bytes up to CACHED_LENGTH + 1, and each byte of a CRC-32, what that byte is after as many zero bytes.

    CRC(a + b) is the exclusive or of CRC(a), moved so for the bytes of b, and CRC(b)."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    moved = np.concatenate([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    table = [moved]
    for _ in range(CACHED_LENGTH + 1):
        moved = one[moved & 255] ^ moved >> np.uint32(8)
        table.append(moved)
    return np.concatenate(table)


class Words(dict):
    """Numbers of words; for each number the CRC-32 of the word, that of a space and the word, and the bytes of both."""

    def __init__(self):
        super().__init__()
        self.alone, self.after, self.size, self.shifts = np.zeros(1024, np.uint32), np.zeros(1024, np.uint32), np.zeros(1024, np.int64), _shifts()

    def __missing__(self, word: bytes) -> int:
        if len(word) > CACHED_LENGTH:
            raise KeyError(word)
        n = len(self)
        if n == len(self.alone):
            self.alone, self.after, self.size = (np.concatenate((a, np.zeros_like(a))) for a in (self.alone, self.after, self.size))
        self.alone[n], self.after[n], self.size[n] = zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1
        self[word] = n
        return n

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        """CRC-32 of each word, a space and the word after it."""
        a, at = self.alone[ids[:-1]], self.size[ids[1:]] << 10
        out = self.after[ids[1:]].copy()
        for k in range(4):
            out ^= self.shifts[at + (256 * k) + (a >> np.uint32(8 * k) & np.uint32(255))]
        return out


def features(texts: list[bytes], known: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all features as 16 bits, words of each text): each word's bucket is followed by that of it and the next."""
    words = [t.translate(LETTERS).split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    if len(known) > CACHED_WORDS:
        known.clear()
    try:
        ids = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
    except KeyError:  # a very long word
        return np.concatenate([_plain(w, buckets) for w in words]), counts
    if not len(ids):
        return np.empty(0, np.uint16), counts
    both = np.empty(2 * len(ids) - 1, np.uint32)
    both[::2] = known.alone[ids]
    both[1::2] = known.pairs(ids)
    keep = np.ones(len(both), bool)
    last = np.cumsum(counts)[counts > 0][:-1]
    keep[2 * last - 1] = False  # pairs of one document's last word and the next one's first
    return (both[keep] % np.uint32(buckets)).astype(np.uint16), counts


def _plain(words: list[bytes], buckets: int) -> np.ndarray:
    """The same for a text with very long words, one by one."""
    out = np.empty(max(0, 2 * len(words) - 1), np.uint16)
    out[::2] = [zlib.crc32(w) % buckets for w in words]
    out[1::2] = [zlib.crc32(b" " + b, zlib.crc32(a)) % buckets for a, b in zip(words, words[1:], strict=False)]
    return out


def bucket_streams(docs: DataFrame, doc: str, text: str, buckets: int = BUCKETS) -> DataFrame:
    """Stored rows, one for a block of documents: docs (ids), words (of each), stream (packed little-endian 16-bit buckets)."""
    if buckets > 1 << 16:
        raise ValueError("a bucket has 16 bits")
    kinds = pa.schema([("docs", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("stream", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, streams, words, size = Words(), [], [], [], 0

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"docs": [ids], "words": [np.concatenate(words)], "stream": [np.concatenate(streams).astype("<u2").tobytes()]}, kinds)

        for batch in batches:
            column = batch.column(1).cast(pa.binary())
            for at in range(0, len(batch), 64):
                some = [x or b"" for x in column[at : at + 64].to_pylist()]
                for group in ([x] for x in some) if sum(map(len, some)) > 1 << 20 else (some,):
                    stream, counts = features(group, known, buckets)
                    streams.append(stream)
                    words.append(counts)
                    size += int(counts.sum())
                ids.extend(batch.column(0)[at : at + 64].to_pylist())
                if size >= BLOCK_WORDS:
                    yield block()
                    ids, streams, words, size = [], [], [], 0
        if ids:
            yield block()

    return stored(docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(run, "docs array<long>, words array<long>, stream binary"), "streams")


def bucket_counts(streams: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: blocks sorted and run-length encoded, runs added up; the driver gets a row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for stream in batch.column(0):
                ordered = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
                if len(ordered):
                    starts = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1))
                    held[ordered[starts]] += np.diff(starts, append=len(ordered))
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int32()), "n": pa.array(held[found], pa.int64())})

    out = np.zeros(buckets, np.int64)
    for bucket, n in streams.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares of each bucket in target and source, rounded down."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(source, target, strict=True)], np.int64)


def noise(doc: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel variable that depends on the id (null: no digits) and the seed alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(streams: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc, n_words, n_features, weight (mean gain of its features, rounded down; 0 without features), score (weight and noise)."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc", "n_words", "n_features", "weight", "score")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, words, stream in zip(*(batch.column(i) for i in range(3)), strict=True):
                docs, words = docs.as_py(), words.values.to_numpy()
                n = np.maximum(2 * words - 1, 0)
                some, sums = n > 0, np.zeros(len(n), np.int64)
                if some.any():
                    offsets = (np.cumsum(n) - n)[some]
                    sums[some] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), "<u2")], offsets)
                weight = sums // np.maximum(n, 1)
                score = weight + np.array([noise(d, seed) for d in docs], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *map(pa.array, (words, n, weight, score))], schema=schema)

    return streams.select("docs", "words", "stream").mapInArrow(run, "doc long, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, share: int = SHARE) -> DataFrame:
    """rows (stored) with rank: 1, 2, 3... of the share (in hundredths, rounded down) of them with the highest scores, ties to
    the smaller doc (null first), equal ones in any order. Sorted by ranges; the driver gets a row a range."""
    spark = rows.sparkSession
    order = [F.desc("score"), F.asc_nulls_first("doc"), "spread"]
    ranged = rows.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = stored(ranged.drop("spread").withColumn("at", F.monotonically_increasing_id()), "ranked")
    starts, total = [], 0
    for part, n in sorted((r[0], r[1]) for r in placed.groupBy(F.shiftright("at", 33).cast("int")).count().collect()):
        starts.append((part, total))
        total += n
    small = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    place = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = placed.withColumn("part", F.shiftright("at", 33).cast("int")).join(small, "part").withColumn("rank", F.when(place <= share * total // 100, place))
    return drawn.drop("at", "part", "start")


def importance_resample(docs: DataFrame, target: DataFrame, doc: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc, n_features, weight, score and rank (null: not drawn) of every row: documents that look like those of target, drawn
    without replacement by the Gumbel trick.

    Words are runs of ASCII letters (in lower case) and digits and of all other characters but ASCII. Of the rows with
    least_words words or more the share (in hundredths, rounded down) with the highest scores is drawn. Null texts count as
    empty: no features, weight 0. A null id is an id without digits, before all others. Repeated rows are drawn one by one.
    A text of any length is read whole, and is a block of the streams by itself if long. An empty table gives no rows, an
    empty target counts of zero. Other columns are ignored."""
    own = bucket_streams(docs, doc, text, buckets)
    wanted = bucket_streams(target.withColumn("_none", F.lit(None).cast("long")).select("_none", F.col(target_text).alias("text")), "_none", "text", buckets)
    rows = stored(scored(own, gains(bucket_counts(own, buckets), bucket_counts(wanted, buckets)), seed), "scores")
    out = ranked(rows.filter(F.col("n_words") >= least_words), share).unionByName(rows.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("doc").alias(doc), "n_features", "weight", "score", "rank")
