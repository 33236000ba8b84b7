"""Token ids as length-delimited binary records.

A data set is a folder of shards. Shard k holds the documents of one range of ids in ascending order, in two files:
`shard-k.rec` is a run of records, each framed as

    length of the payload (u64) | masked CRC-32 of those 8 bytes (u32) | payload | masked CRC-32 of the payload (u32)

and `shard-k.idx` has an entry (offset of the record, tokens of the shard before it; both u64) for each record and one
for the end, so any record can be read alone, in any order. A payload is a flag (1: the id is null), the id (i64), the
width of an id in bytes, the number of ids (u32) and the ids; all little-endian. `manifest.json` lists the shards.
Each attempt of a task writes files of its own names and the manifest names those that count, so nothing is ever renamed
or overwritten when a task is lost or run twice; what other attempts left is removed at the end.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from itertools import compress, count, islice
from operator import not_

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.llm.common import file_bytes, is_word_level, partitions, shared_dir

MASK, FRAME, HEAD = 0xA282EAD8, struct.Struct("<QI"), struct.Struct("<BqBI")
#: Bytes of input files to a shard; bytes of texts that are looked up together, and of a piece of a long one.
SHARD_BYTES, BATCH_BYTES, PIECE_BYTES = 256 << 20, 1 << 20, 1 << 18
#: Bytes that a worker may take to remember the ids of runs; about as many as an entry takes itself; the longest run remembered.
CACHED_BYTES, ENTRY_BYTES, CACHED_RUN = 288 << 20, 140, 200
#: Marks that end a run and are a word of their own after an ASCII letter or digit.
ENDS = b".,;:!?"
#: Bytes of ASCII and of characters up to U+017F: none of those combines with another.
LATIN = bytes([*range(0xC0), 0xC2, 0xC3, 0xC4, 0xC5])


def masked(data: bytes) -> int:
    """A CRC stored beside its data shouldn't be a valid CRC of the two together, hence rotated and offset."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(read) -> bytes:
    """The payload of the record that begins here; read(n) gives the next n bytes."""
    head = read(FRAME.size)
    size, check = FRAME.unpack(head)
    if masked(head[:8]) != check:
        raise ValueError("the length of a record is damaged")
    payload, check = read(size), struct.unpack("<I", read(4))[0]
    if len(payload) != size or masked(payload) != check:
        raise ValueError("a record is damaged")
    return payload


def pack(doc: int | None, ids: bytes, width: int) -> bytes:
    return HEAD.pack(doc is None, doc or 0, width, len(ids) // width) + ids


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, doc, width, n = HEAD.unpack_from(payload)
    return None if null else doc, np.frombuffer(payload, f"<u{width}", n, HEAD.size)


class Encoder:
    """The tokenizers library over whole texts, each distinct run between ASCII white space encoded once and remembered.

    The ids of a text are those of its runs, one after the other: the library's normaliser composes nothing across white
    space, its pre-tokenizer parts words there, and its added tokens hold none. For the same reason runs of Latin letters that
    differ in case or in a full stop or the like at the end share what the library is asked (`plain`). What is remembered
    is bounded in bytes. Files of which any of this may not hold (`is_word_level`) are left to the library, text by text."""

    def __init__(self, source: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        self.model, self.code = Tokenizer.from_str(source), {2: "H", 4: "I"}[width]
        self.by_runs = is_word_level(json.loads(source))
        self.model.no_truncation()
        self.model.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.taken = 0

    def encode(self, texts: Iterator[bytes]) -> Iterator[bytes]:
        """The ids of each text (in UTF-8), little-endian, in order."""
        if not self.by_runs:  # another kind of file: the library reads whole texts
            while some := list(islice(texts, 64)):
                yield from map(self._bytes, self.model.encode_batch_fast([x.decode() for x in some], add_special_tokens=False))
            return
        waiting: list[bytes] = []
        size = 0
        for text in texts:
            if len(text) > PIECE_BYTES:
                yield from self._encoded(waiting)
                waiting, size = [], 0
                yield b"".join(x for piece in pieces(text) for x in self._encoded([piece]))
                continue
            waiting.append(text)
            size += len(text)
            if size > BATCH_BYTES:
                yield from self._encoded(waiting)
                waiting, size = [], 0
        yield from self._encoded(waiting)

    def _encoded(self, texts: list[bytes]) -> Iterator[bytes]:
        runs = [t.split() for t in texts]
        if self.taken > CACHED_BYTES:
            self.known.clear()
            self.taken = 0
        found = [list(map(self.known.get, r)) for r in runs]
        new: set[bytes] = set()
        for r, f in zip(runs, found, strict=True):
            new.update(compress(r, map(not_, f)))
        long = self._learn(new) if new else {}
        for r, f in zip(runs, found, strict=True):
            for i in compress(count(), map(not_, f)):
                x = r[i]
                f[i] = long[x] if x in long else self.known[x]
            yield b"".join(f)

    def _learn(self, new: set[bytes]) -> dict[bytes, bytes]:
        """Remember these runs; those too long for that are returned."""
        known, ask, made = self.known, set(), []
        for x in new:
            stem, mark = plain(x)
            if mark:
                made.append((x, stem, mark))
                if mark not in known:
                    ask.add(mark)
            elif stem != x:
                made.append((x, stem, b""))
            if stem not in known:
                ask.add(stem)
        before = len(known)
        known.update(zip(ask, map(self._bytes, self.model.encode_batch_fast([x.decode() for x in ask], add_special_tokens=False)), strict=True))
        for x, stem, mark in made:
            known[x] = known[stem] + known[mark] if mark else known[stem]
        self.taken += sum(map(len, new)) + sum(map(len, ask)) + 4 * len(ask) + ENTRY_BYTES * (len(known) - before)
        long = {x for x in new | ask if len(x) > CACHED_RUN} if max(map(len, new)) > CACHED_RUN else ()
        return {x: known.pop(x) for x in long}

    def _bytes(self, encoded) -> bytes:
        ids = array(self.code, encoded.ids)
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


def plain(run: bytes) -> tuple[bytes, bytes]:
    """(run in lower case, marks after it), if the run is ASCII, or Latin with letters that are a character each and not one
    whose lower case is two; else (run, none). A sign that an added token begins with keeps a run as it is."""
    if b"<" in run:
        return run, b""
    stem = run.rstrip(ENDS)
    if run.isascii():
        if stem and len(stem) < len(run) and stem[-1:].isalnum():
            return stem.lower(), run[len(stem) :]
        return run.lower(), b""
    if run.translate(None, LATIN) or b"\xc4\xb0" in run:
        return run, b""
    if len(stem) < len(run) and (stem[-1:].isalnum() or stem.decode()[-1:].isalpha()):
        return stem.decode().lower().encode(), run[len(stem) :]
    return run.decode().lower().encode(), b""


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that begin at a space, so that few of its runs are held at once."""
    start = 0
    while len(text) - start > PIECE_BYTES and (cut := text.find(b" ", start + PIECE_BYTES)) >= 0:
        yield text[start:cut]
        start = cut
    yield text[start:]


_MADE: dict[tuple[str, int], Encoder] = {}


def encoder_of(source: str, width: int) -> Encoder:
    """One for each worker and file: tasks share what it remembers."""
    key = hashlib.sha256(source.encode()).hexdigest(), width
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Encoder(source, width)
    return _MADE[key]


def write_records(docs: DataFrame, tokenizer: str, end: int, out: str | None = None, doc: str = "doc_id", text: str = "text", shards: int | None = None) -> str:
    """Encode all rows and write them in ascending order of ids (null first, ties by content). Returns the folder.

    tokenizer: path of a tokenizers JSON file; end: the id appended to each document. Null texts count as empty and
    give the end id alone. Repeated rows are records of their own; a text of any length is one record. An empty table gives
    shards without records. Other columns are ignored. The number of shards
    follows from the size of the files that docs are read from: a shard for SHARD_BYTES of them, and as many as shuffle partitions at least."""
    spark = docs.sparkSession
    out, shards = out or shared_dir(spark, "records"), shards or max(partitions(spark), -(-file_bytes(docs) // SHARD_BYTES))
    with open(tokenizer, encoding="utf-8") as f:
        source = f.read()
    spec = json.loads(source)
    width = 2 if max([end, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) < 1 << 16 else 4
    sent = spark.sparkContext.broadcast(source)
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        k, store_path = task.partitionId(), fs.FileSystem.from_uri(out)
        store, folder = store_path
        store.create_dir(folder, recursive=True)
        encoder, tail = encoder_of(sent.value, width), np.array([end], f"<u{width}").tobytes()
        offset, tokens, index = 0, 0, []
        name = f"shard-{k:06d}-{task.taskAttemptId()}"
        with store.open_output_stream(f"{folder}/{name}.rec") as data:
            for batch in batches:
                for d, ids in zip(batch.column(0).to_pylist(), encoder.encode(iter(batch.column(1).cast(pa.binary()).to_pylist())), strict=True):
                    ids += tail
                    record = frame(pack(d, ids, width))
                    index.append((offset, tokens))
                    data.write(record)
                    offset, tokens = offset + len(record), tokens + len(ids) // width
        index.append((offset, tokens))
        with store.open_output_stream(f"{folder}/{name}.idx") as data:
            data.write(np.array(index, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": [k], "documents": [len(index) - 1], "tokens": [tokens], "bytes": [offset], "name": [name]}, pa.schema([*((n, pa.int64()) for n in ("shard", "documents", "tokens", "bytes")), ("name", pa.string())]))

    ranged = rows.repartitionByRange(shards, F.asc_nulls_first("doc"), "tie").sortWithinPartitions(F.asc_nulls_first("doc"), "tie")
    written = ranged.select("doc", "text").mapInArrow(write, "shard long, documents long, tokens long, bytes long, name string").collect()  # a row for each shard
    start, listed = 0, []
    for r in sorted(written, key=lambda r: r["shard"]):
        listed.append(r.asDict() | {"start": start})
        start += r["tokens"]
    store, folder = fs.FileSystem.from_uri(out)
    store.create_dir(folder, recursive=True)
    named = {f"{s['name']}.{kind}" for s in listed for kind in ("rec", "idx")}
    for left in store.get_file_info(fs.FileSelector(folder)):
        if re.fullmatch(r"shard-\d+-\d+\.(rec|idx)", left.base_name) and left.base_name not in named:
            store.delete_file(left.path)
    with store.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"width": width, "end": end, "shards": listed}).encode())
    return out


def manifest(out: str) -> dict:
    store, folder = fs.FileSystem.from_uri(out)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        return json.loads(f.read())


def read_record(out: str, shard: int, k: int) -> tuple[int | None, np.ndarray]:
    """Record k of a shard alone, through the offset index: what shuffled reads do."""
    store, folder = fs.FileSystem.from_uri(out)
    name = next(s["name"] for s in manifest(out)["shards"] if s["shard"] == shard)
    with store.open_input_file(f"{folder}/{name}.idx") as f:
        f.seek(16 * k)
        offset = int(np.frombuffer(f.read(8), "<u8")[0])
    with store.open_input_file(f"{folder}/{name}.rec") as f:
        f.seek(offset)
        return unpack(unframe(f.read))


def _read(spark: SparkSession, out: str, fields: list[pa.Field], schema: str, make) -> DataFrame:
    shards = [(s["name"], s["start"]) for s in manifest(out)["shards"] if s["documents"]]
    table = spark.createDataFrame(shards, "name string, start long").repartition(max(1, len(shards)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(out)
        for batch in batches:
            for name, start in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                with store.open_input_stream(f"{folder}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
                with store.open_input_stream(f"{folder}/{name}.rec", buffer_size=1 << 20) as f:
                    for at in range(0, len(index) - 1, 512):
                        found = []
                        for before, after in zip(index[at : at + 512], index[at + 1 : at + 513], strict=False):
                            doc, ids = unpack(unframe(f.read))
                            if len(ids) != after[1] - before[1]:
                                raise ValueError("a record and the index differ")
                            found.append(make(doc, start + int(before[1]), ids))
                        yield pa.RecordBatch.from_arrays([pa.array(c, x.type) for c, x in zip(zip(*found, strict=True), fields, strict=True)], schema=pa.schema(fields))

    return table.mapInArrow(read, schema)


def read_records(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (tokens before it in the whole set), ids: one task a shard, records and index checked."""
    fields = [pa.field("doc_id", pa.int64()), pa.field("start", pa.int64()), pa.field("ids", pa.list_(pa.int32()))]
    return _read(spark, out, fields, "doc_id long, start long, ids array<int>", lambda doc, start, ids: (doc, start, ids.astype(np.int32)))


def read_digest(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as 32-bit integers, from the files."""
    fields = [pa.field(n, pa.int64()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")]
    return _read(spark, out, fields, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda doc, start, ids: (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
