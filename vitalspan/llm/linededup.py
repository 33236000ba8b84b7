"""Line deduplication that can be undone: exact reference counts with sharded cuckoo filters in front.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. The state holds, for each key, the
number of documents that contain it (exact; keys are 128-bit hashes). For each shard of the key space a cuckoo filter
holds the keys at or above the threshold: inserting documents adds keys that cross it upwards, deleting documents
removes those that fall below it, so a later pass sees what a rebuild from the remaining documents would give.

To apply the state, a document's keys go to the shard's filter, in a stream that holds one filter at a time; only the few
that pass go on to the exact table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import ASCII_SPACE, ascii_lower, stored, unused

#: Keys in a filter's shard, at most on average; slots of a bucket; parts of the keys to test in a shard, each with a copy of its filter.
SHARD_KEYS, SLOTS, SALTS = 1 << 16, 4, 32
FILTER_SCHEMA = "shard long, buckets int, table binary, stash binary"


class CuckooFilter:
    """Partial-key cuckoo hashing with 16-bit fingerprints, four slots a bucket, and a stash of whole keys that found none.

    `lo` picks the fingerprint, `hi` the first bucket; both are 64-bit hashes of the key."""

    def __init__(self, buckets: int, table: np.ndarray | None = None, stash: list[tuple[int, int]] | None = None):
        self.buckets = buckets  # a power of two
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table
        self.stash = list(stash or [])

    @staticmethod
    def buckets_for(keys: int) -> int:
        return 1 << max(0, math.ceil(math.log2(max(1, keys) / (SLOTS * 0.8))))

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(cls.buckets_for(keys))

    def _places(self, hi, lo):
        fp = (np.asarray(lo, np.int64).view(np.uint64) & np.uint64(0xFFFF)).astype(np.int64)
        fp = np.where(fp == 0, 1, fp)
        first = (np.asarray(hi, np.int64).view(np.uint64) & np.uint64(self.buckets - 1)).astype(np.int64)
        return fp, first, first ^ self._jump(fp)

    def _jump(self, fp):
        return ((fp * 0x5BD1E995) >> 7) & (self.buckets - 1)

    def insert(self, hi: int, lo: int) -> None:
        fp, a, b = (int(x[0]) for x in self._places([hi], [lo]))
        at = a
        for i in (a, b):
            free = np.flatnonzero(self.table[i] == 0)
            if free.size:
                self.table[i, free[0]] = fp
                return
        moved = []
        for kick in range(200):
            slot = (fp + kick) % SLOTS
            moved.append((at, slot, int(self.table[at, slot])))
            fp, self.table[at, slot] = int(self.table[at, slot]), fp
            at ^= int(self._jump(fp))
            free = np.flatnonzero(self.table[at] == 0)
            if free.size:
                self.table[at, free[0]] = fp
                return
        for at, slot, old in reversed(moved):  # no room: as it was, and the key is kept whole
            self.table[at, slot] = old
        self.stash.append((int(hi), int(lo)))

    def delete(self, hi: int, lo: int) -> bool:
        if (int(hi), int(lo)) in self.stash:
            self.stash.remove((int(hi), int(lo)))
            return True
        fp, a, b = (int(x[0]) for x in self._places([hi], [lo]))
        for i in (a, b):
            held = np.flatnonzero(self.table[i] == fp)
            if held.size:
                self.table[i, held[0]] = 0
                return True
        return False

    def contains(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(hi, lo)
        found = ((self.table[a] == fp[:, None]) | (self.table[b] == fp[:, None])).any(axis=1)
        if self.stash:
            stash = set(self.stash)
            found |= np.fromiter(((int(x), int(y)) in stash for x, y in zip(hi, lo, strict=True)), bool, len(hi))
        return found

    def row(self, shard: int) -> dict:
        return {"shard": shard, "buckets": self.buckets, "table": self.table.tobytes(), "stash": np.array(self.stash, np.int64).tobytes()}

    @classmethod
    def read(cls, buckets: int, table: bytes, stash: bytes) -> CuckooFilter:
        return cls(buckets, np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy(), [tuple(map(int, x)) for x in np.frombuffer(stash, np.int64).reshape(-1, 2)])


def lines(text: Column) -> Column:
    """A null text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashed(key: Column) -> Column:
    """Two 64-bit hashes with different seeds."""
    return F.struct(F.xxhash64(key).alias("hi"), F.xxhash64(F.lit("line"), key).alias("lo"))


SEEDS = 42, xxhash.xxh64_intdigest(b"line", 42)


def hashed_line(line: str) -> tuple[int, int] | None:
    """What `hashed` gives for a line's key, as signed numbers; None for an empty key, which never counts."""
    key = line.strip(ASCII_SPACE).encode().lower()  # bytes: ASCII letters only
    hi, lo = (xxhash.xxh64_intdigest(key, seed) for seed in SEEDS) if key else (0, 0)
    return (hi - (hi >> 63 << 64), lo - (lo >> 63 << 64)) if key else None


def document_keys(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, hi, lo: each distinct key of each row of docs.

    Step by step over the whole array: within one lambda the trimmed line would be made anew for each use. Keys are told
    apart as strings, by hashing; arrays of structs would be compared pair by pair."""
    trimmed = F.transform(lines(F.col(text)), lambda x: F.btrim(x, F.lit(ASCII_SPACE)))
    keys = F.array_distinct(F.filter(F.transform(trimmed, ascii_lower), lambda k: F.length(k) > 0))
    return docs.select(F.col(doc).alias("doc"), F.explode(F.transform(keys, hashed)).alias("k")).select("doc", "k.hi", "k.lo")


class LineLedger:
    """The state: counts (hi, lo, n) and filters (shard, cuckoo filter), both tables in the shared folder."""

    def __init__(self, counts: DataFrame, filters: DataFrame, shards: int, threshold: int):
        self.counts, self.filters, self.shards, self.threshold = counts, filters, shards, threshold

    @classmethod
    def build(cls, docs: DataFrame, threshold: int = 10, doc: str = "doc_id", text: str = "text") -> LineLedger:
        counts = stored(document_keys(docs, doc, text).groupBy("hi", "lo").agg(F.count("*").alias("n")), "line-counts")
        shards = cls._shards(counts, threshold)
        return cls(counts, cls._filters(counts.filter(F.col("n") >= threshold), shards), shards, threshold)

    @staticmethod
    def _shards(counts: DataFrame, threshold: int) -> int:
        return max(1, math.ceil(counts.filter(F.col("n") >= threshold).count() / SHARD_KEYS))

    @staticmethod
    def _filters(keys: DataFrame, shards: int) -> DataFrame:
        """A filter for each shard, from scratch. A shard holds a bounded number of keys."""

        def make(group: pa.Table) -> pa.Table:
            made = CuckooFilter.sized(group.num_rows)
            for hi, lo in zip(group["hi"].to_pylist(), group["lo"].to_pylist(), strict=True):
                made.insert(hi, lo)
            return rows([made.row(group["shard"][0].as_py())])

        return stored(keys.select(shard_of(shards), "hi", "lo").groupBy("shard").applyInArrow(make, FILTER_SCHEMA), "line-filters")

    def update(self, added: DataFrame | None = None, removed: DataFrame | None = None, doc: str = "doc_id", text: str = "text") -> LineLedger:
        """The state after documents came or went. A removed document must be given with the text it was added with.

        Filters have the shards and buckets that a build would give them: keys that cross the threshold are inserted or
        deleted; a shard that outgrows its buckets, or could do with fewer, is made anew from the exact keys, and all are
        if the number of shards changes."""
        parts = [self.counts.withColumn("d", F.lit(0).cast("long"))]
        for docs, sign in ((added, 1), (removed, -1)):
            if docs is not None:
                parts.append(document_keys(docs, doc, text).select("hi", "lo", F.lit(0).cast("long").alias("n"), F.lit(sign).cast("long").alias("d")))
        both = parts[0]
        for part in parts[1:]:
            both = both.unionByName(part)
        now = stored(both.groupBy("hi", "lo").agg(F.sum("n").alias("was"), (F.sum("n") + F.sum("d")).alias("n")), "line-counts")
        counts, shards = now.filter("n > 0").select("hi", "lo", "n"), self._shards(now, self.threshold)
        if shards != self.shards:
            return LineLedger(counts, self._filters(counts.filter(F.col("n") >= self.threshold), shards), shards, self.threshold)
        up, was_up = F.col("n") >= self.threshold, F.col("was") >= self.threshold
        held_keys = now.filter(up | was_up).select(shard_of(shards), "hi", "lo", up.alias("up"), was_up.alias("was_up"))

        def change(held: pa.Table, keys: pa.Table) -> pa.Table:
            if not keys.num_rows:
                return held
            shard, up = keys["shard"][0].as_py(), keys["up"].to_numpy()
            size = int(up.sum())
            if not size:
                return rows([])
            anew = not held.num_rows or held["buckets"][0].as_py() != CuckooFilter.buckets_for(size)
            f = CuckooFilter.sized(size) if anew else CuckooFilter.read(*(held[c][0].as_py() for c in ("buckets", "table", "stash")))
            for hi, lo, now_up, before in zip(*(keys[c].to_pylist() for c in ("hi", "lo", "up", "was_up")), strict=True):
                if now_up and (anew or not before):
                    f.insert(hi, lo)
                elif before and not now_up and not anew:
                    f.delete(hi, lo)
            return rows([f.row(shard)])

        filters = stored(self.filters.groupBy("shard").cogroup(held_keys.groupBy("shard")).applyInArrow(change, FILTER_SCHEMA), "line-filters")
        return LineLedger(counts, filters, shards, self.threshold)

    def repeated(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (doc, hi, lo) whose key is at the threshold: filters first, then the exact counts.

        Keys and filters meet by shard. A shard's keys are dealt into SALTS parts by the partition they come from, so a line
        of many documents is no task of its own; within a part the filter comes first and the keys stream past it."""
        none = {"doc": dict(keys.dtypes)["doc"], "hi": "long", "lo": "long", "buckets": "int", "table": "binary", "stash": "binary"}
        null = lambda names: [F.lit(None).cast(none[n]).alias(n) for n in names]
        tested = keys.select(shard_of(self.shards), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), F.lit(True).alias("is_key"), "doc", "hi", "lo", *null(["buckets", "table", "stash"]))
        copies = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(False).alias("is_key"), *null(["doc", "hi", "lo"]), "buckets", "table", "stash")
        met = copies.unionByName(tested).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "is_key")

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, held = None, None
            for batch in batches:
                at, is_key = batch.column("shard").to_numpy(), batch.column("is_key").to_numpy(zero_copy_only=False)
                hi, lo = (batch.column(c).fill_null(0).to_numpy() for c in ("hi", "lo"))
                found = np.zeros(len(at), bool)
                edges = [0, *(np.flatnonzero((np.diff(at) != 0) | ~is_key[1:]) + 1).tolist(), len(at)]
                for start, end in zip(edges, edges[1:], strict=False):
                    if start < end and not is_key[start]:
                        shard, held = at[start], CuckooFilter.read(*(batch.column(c)[start].as_py() for c in ("buckets", "table", "stash")))
                        start += 1
                    if start < end and held is not None and at[start] == shard:
                        found[start:end] = held.contains(hi[start:end], lo[start:end])
                yield batch.select(["doc", "hi", "lo"]).filter(pa.array(found))

        passed = met.mapInArrow(test, keys.select("doc", "hi", "lo").schema)
        return passed.join(self.counts.filter(F.col("n") >= self.threshold).select("hi", "lo"), ["hi", "lo"])


def shard_of(shards: int) -> Column:
    """Other bits than those of a filter's fingerprint."""
    return F.pmod(F.shiftright("lo", 20), F.lit(shards)).alias("shard")


def rows(found: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(found, pa.schema([("shard", pa.int64()), ("buckets", pa.int32()), ("table", pa.binary()), ("stash", pa.binary())]))


def line_dedup(docs: DataFrame, threshold: int = 10, doc: str = "doc_id", text: str = "text", ledger: LineLedger | None = None) -> DataFrame:
    """docs with lines whose key is in `threshold` documents or more taken out, and the columns n_lines and n_dropped.

    A text is split at \\n; a null or empty one is one empty line, which stays. The others are joined again by \\n; a text
    that loses all lines becomes empty, one of any length is read whole. Rows that share an id, or have none, count as a
    document each; what a row loses is looked up by a hash of its id and text, so it is handed the keys of its own lines alone.
    Other columns of docs stay, n_lines and n_dropped excepted. An empty table gives no rows."""
    ledger = ledger or LineLedger.build(docs, threshold, doc, text)
    kept_columns = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    owner, drop, row = unused(docs, "_doc", "_drop", "_row")
    hashed_rows = docs.withColumn(row, F.xxhash64(doc, text))  # rows that share it by chance share keys to drop, which are the same for all
    dropped = ledger.repeated(document_keys(hashed_rows, row, text)).groupBy(F.col("doc").alias(owner)).agg(F.collect_set(F.struct("hi", "lo")).alias(drop))
    joined = hashed_rows.select(*kept_columns, row).join(dropped, F.col(row) == F.col(owner), "left").select(*kept_columns, drop)
    at, schema = kept_columns.index(text), docs.select(*kept_columns).schema

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines are looked up in a document's set, so the time is linear; texts that lose nothing pass as they are."""
        for batch in batches:
            texts, before, after = [], [], []
            for t, gone in zip(batch.column(at), batch.column(len(kept_columns)), strict=True):
                t = t.as_py() or ""
                n = m = t.count("\n") + 1
                if gone.is_valid:
                    out = {(k["hi"], k["lo"]) for k in gone.as_py()}
                    stay = [x for x in t.split("\n") if hashed_line(x) not in out]
                    t, m = "\n".join(stay), len(stay)
                texts.append(t)
                before.append(n)
                after.append(n - m)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(kept_columns))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int64()), pa.array(after, pa.int64())], names=[*kept_columns, "n_lines", "n_dropped"])

    return joined.mapInArrow(remove, schema.add("n_lines", "long").add("n_dropped", "long"))
