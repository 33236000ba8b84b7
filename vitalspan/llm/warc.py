"""Web archives: WARC files of a table of pages, and their index by external merge.

Payloads are told apart by their SHA-1. Of equal ones one is kept as a response record, all others are revisit records that
refer to it and keep the headers alone. Each task writes its records to archive files, each record a gzip member, and the index
entries of an archive, sorted, as a run. Runs are merged by a loser tree, at most FAN_IN at a time and each group cut into
ranges of keys that are merged side by side, until one is left: the captures of all archives in the order of URL key and
time. Through that index archives are read.

Tasks write files of new names and return them; only returned files count, so a lost or repeated task leaves nothing but
files that nobody reads. The driver gets a row for each archive, and for each piece of an index with some of its keys.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.llm.common import HOT_KEYS, file_bytes, looked_up, partitions, shared_dir, stored

#: Bytes of an archive file and entries of a run, after which a task begins new ones; bytes of input for an archive.
ARCHIVE_BYTES, RUN_ENTRIES, INPUT_BYTES = 1 << 30, 100_000, 512 << 20
#: Runs merged at once; entries of a merged piece; entries between two keys that the driver gets; entries of a Parquet row group.
FAN_IN, PIECE_ENTRIES, KEY_STEP, GROUP_ENTRIES = 64, 250_000, 4096, 2048
#: Copies of one record that are written by one row.
COPIES = 10_000
LAST_SECOND = 253402300799  # of the year 9999
ENTRY = pa.schema([("urlkey", pa.string()), ("time", pa.int64()), ("record", pa.string()), ("kind", pa.string()), ("digest", pa.string()), ("archive", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
ENTRY_SQL = "urlkey string, time long, record string, kind string, digest string, archive string, start long, length long"


def url_key(url: str | None) -> str:
    """The URL sorted by host: labels of the host from the top, without www, then port, path and query, in lower case.

    What doesn't parse as a URL stays as it is, in lower case; null gives an empty key."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    labels = host.split(".")
    if len(labels) > 2 and re.fullmatch(r"www\d*", labels[0]):
        labels = labels[1:]
    default = {"http": 80, "https": 443}.get(parts.scheme)
    return ",".join(reversed(labels)) + ("" if port in (None, default) else f":{port}") + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def warc_date(second: int) -> str:
    return (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=second)).strftime("%Y-%m-%dT%H:%M:%SZ")


def target_uri(url: str) -> str:
    """White space and control characters as percent signs and digits, so that a header stays one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record_of(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    data = zlib.decompress(member, 31)
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a record of a web archive")
    headers = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    block = data[end + 4 : end + 4 + int(headers["content-length"])]
    if len(block) != int(headers["content-length"]) or data[end + 4 + len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is damaged")
    return headers, block


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """The rows of sorted runs in order, by a tree of losers: a row costs one comparison a level. Equal rows keep the order of runs."""
    k = len(runs)
    heads = [next(r, None) for r in runs]

    def before(a: int, b: int) -> bool:
        if heads[a] is None or heads[b] is None:
            return heads[b] is None and (heads[a] is not None or a < b)
        return (heads[a], a) < (heads[b], b)

    # Leaves are k to 2k - 1; a node keeps the loser of its two subtrees and hands up the winner.
    losers, winners = [0] * k, [*[0] * k, *range(k)]
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if before(a, b) else (b, a)
    best = winners[1] if k > 1 else 0
    while k and heads[best] is not None:
        yield heads[best]
        heads[best] = next(runs[best], None)
        node = (best + k) // 2
        while node:
            if before(losers[node], best):
                losers[node], best = best, losers[node]
            node //= 2


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    return store, path


class _Piece:
    """A sorted Parquet file of entries being written, with every KEY_STEP-th key."""

    def __init__(self, folder: str):
        store, path = _store(folder)
        self.name = f"run-{uuid.uuid4().hex}.parquet"
        self.out, self.rows, self.n, self.keys = pq.ParquetWriter(store.open_output_stream(f"{path}/{self.name}"), ENTRY), [], 0, []

    def add(self, row: tuple) -> None:
        if self.n % KEY_STEP == 0:
            self.keys.append(row[:3])
        self.rows.append(row)
        self.n += 1
        if len(self.rows) == GROUP_ENTRIES:
            self._flush()

    def _flush(self) -> None:
        self.out.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows, strict=True), ENTRY, strict=True)], schema=ENTRY), row_group_size=GROUP_ENTRIES)
        self.rows = []

    def close(self) -> tuple:
        if self.rows:
            self._flush()
        self.out.close()
        self.out.file_handle and self.out.file_handle.close()
        return self.name, self.n, self.keys


PIECE_SQL = "task int, name string, entries long, keys array<struct<urlkey:string,time:long,record:string>>"
_PIECE = pa.schema([("task", pa.int32()), ("name", pa.string()), ("entries", pa.int64()), ("keys", pa.list_(pa.struct([("urlkey", pa.string()), ("time", pa.int64()), ("record", pa.string())])))])


def _piece_row(task: int, made: tuple) -> pa.RecordBatch:
    name, n, keys = made
    return pa.RecordBatch.from_pydict({"task": [task], "name": [name], "entries": [n], "keys": [[dict(zip(("urlkey", "time", "record"), k, strict=True)) for k in keys]]}, _PIECE)


def _entries(folder: str, names: list[str], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """The rows of a run (its pieces in order) from low on and before high, a row group at a time, those outside skipped."""
    store, path = fs.FileSystem.from_uri(folder)
    for name in names:
        with store.open_input_file(f"{path}/{name}") as source:
            file = pq.ParquetFile(source)
            for g in range(file.num_row_groups):
                stats = file.metadata.row_group(g).column(0).statistics
                if stats is not None and stats.has_min_max and ((low and stats.max < low[0]) or (high and stats.min > high[0])):
                    continue
                for row in zip(*(c.to_pylist() for c in file.read_row_group(g).columns), strict=True):
                    if (low is None or row[:3] >= low) and (high is None or row[:3] < high):
                        yield row


def merge_runs(spark: SparkSession, folder: str, runs: list[list[dict]], fan_in: int = FAN_IN, piece_entries: int = PIECE_ENTRIES) -> list[dict]:
    """One run, as pieces (name, entries, keys) in order, of many: rounds of merges of fan_in runs each.

    A group is cut at keys that its pieces name, so that a task merges about piece_entries of all its runs; a URL or host with
    very many captures is cut as well, by time and record. A task holds one row group of each of its runs."""
    while len(runs) > 1:
        groups, tasks = [runs[i : i + fan_in] for i in range(0, len(runs), fan_in)], []
        for g, group in enumerate(groups):
            keys = sorted((k["urlkey"], k["time"], k["record"]) for run in group for piece in run for k in piece["keys"])
            total = sum(piece["entries"] for run in group for piece in run)
            parts = max(1, min(len(keys), -(-total // piece_entries)))
            cuts = [None, *sorted({keys[len(keys) * i // parts] for i in range(1, parts)}), None]
            for low, high in zip(cuts, cuts[1:], strict=False):
                tasks.append((len(tasks), g, low, high, [[p["name"] for p in _overlapping(run, low, high)] for run in group]))
        key = "struct<urlkey:string,time:long,record:string>"
        table = spark.createDataFrame([(t, low, high, [x for x in names if x]) for t, _, low, high, names in tasks], f"task int, low {key}, high {key}, runs array<array<string>>")

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    low, high = (row[x] and (row[x]["urlkey"], row[x]["time"], row[x]["record"]) for x in ("low", "high"))
                    piece = _Piece(folder)
                    for entry in merged([_entries(folder, names, low, high) for names in row["runs"]]):
                        piece.add(entry)
                    yield _piece_row(row["task"], piece.close())

        made = {r["task"]: r.asDict(True) for r in table.repartition(len(tasks)).mapInArrow(merge, PIECE_SQL).collect()}  # a row a piece
        runs = [[made[t] for t, at, *_ in tasks if at == g and made[t]["entries"]] for g in range(len(groups))]
    return runs[0] if runs else []


def _overlapping(run: list[dict], low: tuple | None, high: tuple | None) -> list[dict]:
    """Pieces of a run that may hold keys from low on and before high: a piece begins at its first key and ends before the next piece."""
    firsts = [tuple(p["keys"][0].values()) for p in run]
    return [p for p, first, after in zip(run, firsts, [*firsts[1:], None], strict=True) if (high is None or first < high) and (low is None or after is None or after > low)]


class Archive:
    """A folder of archive files and the pieces of their index in order."""

    def __init__(self, spark: SparkSession, folder: str, pieces: list[dict]):
        self.spark, self.folder, self.pieces = spark, folder, pieces

    def captures(self) -> DataFrame:
        """The index: position (from 0, over all archives), urlkey, time (second), record, kind, digest, archive, start, length."""
        starts, n = [], 0
        for p in self.pieces:
            starts.append((p["name"], n))
            n += p["entries"]
        folder = self.folder

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, path = fs.FileSystem.from_uri(folder)
            for batch in batches:
                for name, start in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                    with store.open_input_file(f"{path}/{name}") as source:
                        for found in pq.ParquetFile(source).iter_batches(GROUP_ENTRIES):
                            yield pa.RecordBatch.from_arrays([pa.array(np.arange(start, start + len(found))), *found.columns], names=["position", *ENTRY.names])
                            start += len(found)

        return self.spark.createDataFrame(starts, "name string, start long").repartition(max(1, len(starts))).mapInArrow(read, f"position long, {ENTRY_SQL}")

    def records(self, payloads: bool = True) -> DataFrame:
        """Every record, found through the index and read from its archive in the order of the files.

        page (null if the page had none), url, time, payload_bytes, payload_digest, kind, refers_to (the response's page) and
        payload (null for a revisit, or where payloads aren't asked for). Digests and lengths are checked."""
        folder = self.folder
        kinds = pa.schema([("page", pa.int64()), ("url", pa.string()), ("time", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, path = fs.FileSystem.from_uri(folder)
            name, source, out, held = None, None, [], 0
            for batch in batches:
                for archive, start, length, record, time in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if archive != name:
                        source, name = store.open_input_file(f"{path}/{archive}"), archive
                    source.seek(start)
                    found = _capture(*parse_record(source.read(length)), record)
                    out.append((*found[:2], time, *found[2:6], found[6] if payloads else None))
                    held += length
                    if len(out) == 1000 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), kinds, strict=True)], schema=kinds)

        order = ["archive", "start"]
        dealt = self.captures().select(*order, "length", "record", "time").repartitionByRange(partitions(self.spark), *order).sortWithinPartitions(*order)
        return dealt.mapInArrow(read, "page long, url string, time long, payload_bytes long, payload_digest string, kind string, refers_to long, payload binary")


def _capture(headers: dict[str, str], block: bytes, record: str) -> tuple:
    """page, url, payload bytes, digest, kind, refers_to, payload of a record."""
    if headers["warc-record-id"] != f"<{record}>":
        raise ValueError("the index leads to another record")
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("a payload is damaged")
    other = headers.get("warc-refers-to")
    return _page(record), headers.get("warc-target-uri"), size, digest, kind, _page(other[1:-1]) if other else None, payload if kind == "response" else None


def record_name(page: int | None, digest: str, url: str | None, time: int, copy: int) -> str:
    """An URI of its own for each record: page, payload, URL, time and the number of the copy make it."""
    place = "" if url is None else hashlib.sha1(url.encode()).hexdigest()
    return f"urn:capture:{'' if page is None else page}:{digest}:{place}:{time}:{copy}"


def _page(record: str) -> int | None:
    page = record.split(":")[2]
    return int(page) if page else None


def _decided(pages: DataFrame, least_bytes: int) -> DataFrame:
    """Stored, small: page, url, time, sha (of the payload), bytes, same (equal rows of these), to (page, url, time of the response
    with that payload), how many rows have the payload (`held`) and how many there are (`total`).

    Equal rows are counted before they are shuffled, and a payload that many rows share meets its response by broadcast."""
    kinds = stored(pages.groupBy("page", "url", "time", "sha", "bytes").agg(F.count("*").alias("same")), "payloads")
    best = kinds.groupBy("sha").agg(F.max(F.struct(F.col("page").isNotNull().alias("known"), "page", "url", "time")).alias("best"), F.sum("same").alias("held"), F.count("*").alias("rows"))
    best = stored(best.select("sha", F.struct("best.page", "best.url", "best.time").alias("to"), "held", "rows"), "responses")
    total, rows = best.agg(F.sum("held"), F.sum("rows")).first()
    found = looked_up(kinds, best.withColumn("weight", F.col("held")).select("sha", "to", "weight", "rows"), ["sha"], "rows", rows or 0)
    small = F.col("bytes") < least_bytes
    first = F.col("page").eqNullSafe(F.col("to.page")) & F.col("url").eqNullSafe(F.col("to.url")) & (F.col("time") == F.col("to.time"))
    return found.withColumn("total", F.lit(total or 0)).withColumn("alone", small).withColumn("response", small | first)


def write_archive(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", time: Column | None = None, least_bytes: int = 0, folder: str | None = None, fan_in: int = FAN_IN, piece_entries: int = PIECE_ENTRIES) -> Archive:
    """A record for every row, its payload the html in UTF-8 (null: empty), and the merged index.

    Of rows with equal payloads of least_bytes or more that with the largest page is the response (ties: the largest URL, then the
    latest; null last; of rows that are equal in all of these the first written), the others are revisits of it. Smaller
    payloads are all responses. time: the second of the capture, by default the page's number as seconds since 1970, as far as it
    is within years of four digits. Repeated rows get records of their own; rows without a page or URL too. Payloads of any
    length are written whole. An empty table gives an archive without records. Other columns are ignored.

    Payloads are shuffled once, to their decision; those of hot payloads aren't: one row of each is found map-side."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "archive")
    second = F.coalesce(time if time is not None else F.col(page), F.lit(0)).cast("long")
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).alias("url"), F.greatest(F.least(second, F.lit(LAST_SECOND)), F.lit(0)).cast("long").alias("time"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("html"))).withColumn("bytes", F.octet_length("html").cast("long"))
    decided = stored(_decided(rows.drop("html"), least_bytes), "decided")

    # A hot payload has a thousandth of the rows or more, so at most HOT_KEYS payloads are hot: their text is met by broadcast.
    hot = decided.filter(F.col("weight") * HOT_KEYS >= F.col("total"))
    cold = decided.filter((F.col("weight") * HOT_KEYS < F.col("total")) & F.col("response"))
    few = F.broadcast(hot.select("sha").distinct().withColumn("hot", F.lit(True)))
    by = [F.col(f"r.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ("page", "url")] + [F.col(f"r.{c}") == F.col(f"d.{c}") for c in ("time", "sha")]
    rest = rows.join(few, "sha", "left").filter("hot IS NULL").select("page", "url", "time", "sha", "html")
    columns = ["d.page", "d.url", "d.time", "d.sha", "d.bytes", "d.same", "d.to", "d.alone", "d.response", "r.html"]
    written = rest.alias("r").join(cold.hint("shuffle_hash").alias("d"), by).select(*columns)
    if not decided.filter("same > 1").isEmpty():  # equal rows give one response: here `same` tells how many records
        written = written.filter("same = 1").unionByName(written.filter("same > 1").dropDuplicates(["page", "url", "time", "sha"]))
    whole = written.unionByName(decided.filter("NOT response").withColumn("html", F.lit(None).cast("string")).select(*written.columns))
    if not hot.isEmpty():
        text = stored(rows.join(few, "sha").groupBy("sha").agg(F.first("html").alias("html")), "hot")
        small = F.col("bytes") < least_bytes  # many rows, but a text of less than that; of the others a row a payload
        short = F.broadcast(text.filter(F.octet_length("html") < least_bytes))
        for some, texts in ((hot.filter("response").filter(small), short), (hot.filter("response").filter(~small), text)):
            whole = whole.unionByName(some.join(texts, "sha").select(*written.columns))
    copies = F.when(F.col("same") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.expr(f"(same - 1) DIV {COPIES}")))
    files = max(partitions(spark), -(-file_bytes(pages) // INPUT_BYTES))
    whole = whole.coalesce(files).select("page", "url", "time", "sha", "bytes", "same", "to", "alone", "response", F.explode(copies).alias("part"), "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        name, out, at, entries = None, None, 0, []

        def close() -> pa.RecordBatch:
            out.close()
            piece = _Piece(folder)
            for entry in sorted(entries):
                piece.add(entry)
            return _piece_row(0, piece.close())

        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.binary())
            for row, text in zip(batch.drop_columns(["html"]).to_pylist(), texts, strict=True):
                digest, target = base64.b32encode(row["sha"]).decode(), row["to"]
                payload = text.as_py() or b""
                for copy in range(row["part"] * COPIES, min(row["same"], (row["part"] + 1) * COPIES)):
                    if out is None:
                        name = f"capture-{uuid.uuid4().hex}.warc.gz"
                        out, at, entries = store.open_output_stream(f"{path}/{name}", compression=None), 0, []
                        info = record_of("warcinfo", [("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", warc_date(row["time"])), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(info)
                        at = len(info)
                    kind = "response" if row["response"] and (row["alone"] or copy == 0) else "revisit"
                    record = record_name(row["page"], digest, row["url"], row["time"], copy)
                    headers = [("WARC-Record-ID", f"<{record}>"), ("WARC-Date", warc_date(row["time"])), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
                    if row["url"] is not None:
                        headers.append(("WARC-Target-URI", target_uri(row["url"])))
                    if kind == "revisit":
                        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
                        headers.append(("WARC-Refers-To", f"<{record_name(target['page'], digest, target['url'], target['time'], 0)}>"))
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n".encode()
                    member = record_of(kind, headers, head + payload if kind == "response" else head)
                    out.write(member)
                    entries.append((url_key(row["url"]), row["time"], record, kind, digest, name, at, len(member)))
                    at += len(member)
                    if at >= ARCHIVE_BYTES or len(entries) >= RUN_ENTRIES:
                        yield close()
                        out = None
        if out is not None:
            yield close()

    runs = [[r.asDict(True)] for r in whole.mapInArrow(write, PIECE_SQL).collect()]  # a row an archive
    return Archive(spark, folder, merge_runs(spark, folder, runs, fan_in, piece_entries))


def archive_digest(archive: Archive) -> DataFrame:
    """The columns of the query, from the records read back."""
    return archive.records(payloads=False).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")
