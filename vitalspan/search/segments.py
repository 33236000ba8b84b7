"""A lasting keyword index: segments of postings in blocks with bounds of their scores.

What is new is added as a segment, nothing is built again for a search. A list of postings is kept in the order of what they
can add to a score, cut into blocks that know their largest count and shortest text: whatever the mean length has become, no
posting of a block scores more than those two together would. A search reads the best block or two of each word for a floor
under the k-th score, and then only blocks that can reach it. Scores are those of BM25 over all texts that are held."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.catalog import Catalog
from vitalspan.search.keyword import K1, LEAST_IDF, B, porter, query_terms, spaced

#: Postings of a block; texts of a list before it is cut into several; segments before they are merged.
BLOCK, LIST_TEXTS, SEGMENTS = 128, 1_000_000, 16
#: Tasks for a part when its texts are taken out of the counts.
SHARES = 32


def _part(tf: Column | np.ndarray, length: Column | np.ndarray, mean: float) -> Column | np.ndarray:
    """What a posting adds, but for its word's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / (mean or 1.0)))


BLOCKS = "term string, part int, place int, n long, most int, shortest int, entries array<struct<id:long,tf:int,length:int>>"
#: Postings of a word in some texts, each column the bytes of its numbers; without a word: the texts themselves, with their lengths.
LISTS = "term string, ids binary, tfs binary, lengths binary"
#: Bytes of texts whose words are counted at once.
TEXTS = 16 << 20
_WORD = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])


def _bytes_of(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A value for each end: the bytes of the numbers up to there, from the end before."""
    offsets = np.r_[0, ends].astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all values, and how many each value has."""
    whole = [(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1], c.buffers()[2]) for c in column.cast(pa.binary()).chunks if len(c)]
    size = np.dtype(kind).itemsize
    values = [np.frombuffer(b, kind, (o[-1] - o[0]) // size, o[0]) if o[-1] > o[0] else np.empty(0, kind) for o, b in whole]
    return np.concatenate([np.empty(0, kind), *values]), np.concatenate([np.empty(0, np.int64), *[np.diff(o) // size for o, _ in whole]])


def _listed(codes: np.ndarray, terms: pa.Array, ids: np.ndarray, tfs: np.ndarray, lengths: np.ndarray) -> list[pa.Array]:
    """The columns of LISTS, from postings in the order of the codes of their terms."""
    ends = np.r_[np.flatnonzero(codes[1:] != codes[:-1]) + 1, len(codes)] if len(codes) else np.empty(0, np.int64)
    return [terms.take(pa.array(codes[ends - 1])), _bytes_of(ids, ends), _bytes_of(tfs, ends), _bytes_of(lengths, ends)]


def _counted(ids: np.ndarray, texts: pa.Array, stem: Callable[[str], str] | None) -> pa.RecordBatch:
    """Of texts as `spaced` gives them: a row of LISTS for each word, and one of the texts."""
    n, offsets = len(texts), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    bounds = offsets - offsets[0]
    word = _WORD[data]
    before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
    before[bounds[:-1][bounds[:-1] < len(data)]] = after[bounds[1:][bounds[1:] > 0] - 1] = False  # a word ends with its text
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    spans = np.r_[0, np.cumsum(ends - starts)].astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(data[word]))).dictionary_encode()
    codes, terms = found.indices.to_numpy().astype(np.int64), found.dictionary
    if stem:
        stems = pa.array([stem(w) for w in terms.to_pylist()], pa.string()).dictionary_encode()
        codes, terms = stems.indices.to_numpy().astype(np.int64)[codes], stems.dictionary
    lengths = np.diff(np.searchsorted(starts, bounds)).astype(np.int32)
    pairs, tfs = np.unique(codes * n + np.repeat(np.arange(n), lengths), return_counts=True)
    codes, text = np.divmod(pairs, max(n, 1))
    rows = _listed(codes, terms, ids[text], tfs.astype(np.int32), lengths[text])
    whole = [pa.nulls(1, pa.string()), _bytes_of(ids, np.array([n])), pa.nulls(1, pa.binary()), _bytes_of(lengths, np.array([n]))]
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(rows, whole, strict=True)], names=["term", "ids", "tfs", "lengths"])


def _grouped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    """Texts as they come, about `most` bytes of them at once; a text that has more is by itself."""
    group: list[pa.RecordBatch] = []
    held = at = 0
    for batch in batches:
        text = batch["text"]
        upto = np.r_[0, np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64) + 16)]
        at = 0
        while at < len(text):
            end = max(int(np.searchsorted(upto, upto[at] + most - held, "right")) - 1, at + (not group))
            if end > at:
                group.append(batch.slice(at, end - at))
                held += int(upto[end] - upto[at])
                at = end
            if at < len(text):
                yield group
                group, held = [], 0
    if group:
        yield group


def _lists(stem: Callable[[str], str] | None, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = functools.lru_cache(1 << 20)(stem) if stem else None
        for group in _grouped(batches, most):
            yield _counted(np.concatenate([b["id"].to_numpy() for b in group]), pa.concat_arrays([b["text"] for b in group]).cast(pa.string()), known)

    return run


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of LISTS: id, length."""
    for batch in batches:
        ids, lengths = (_numbers(pa.chunked_array([batch[c]]), kind)[0] for c, kind in (("ids", np.int64), ("lengths", np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(lengths)], names=["id", "length"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """LISTS of single postings (term, id, tf, length)."""
    for batch in batches:
        found = batch["term"].dictionary_encode()
        order = np.argsort(found.indices.to_numpy(), kind="stable")
        columns = [batch[c].to_numpy()[order] for c in ("id", "tf", "length")]
        yield pa.RecordBatch.from_arrays(_listed(found.indices.to_numpy()[order], found.dictionary, *columns), names=["term", "ids", "tfs", "lengths"])


def _pieces(rows: pa.Table, starts: np.ndarray, most: int = 1 << 20) -> Iterator[pa.Table]:
    """Rows of LISTS by about `most` postings, cut at some of the starts only (the first of which is 0)."""
    upto = np.r_[0, np.cumsum(pc.binary_length(rows["ids"]).to_numpy() // 8)][np.r_[starts, rows.num_rows]]
    at = 0
    while at < len(starts):
        end = max(int(np.searchsorted(upto, upto[at] + most, "right")) - 1, at + 1)
        begin = int(starts[at])
        yield rows.slice(begin, (int(starts[end]) if end < len(starts) else rows.num_rows) - begin)
        at = end


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """pmod(xxhash64(id), parts) as Spark has it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = turned(ids.view(np.uint64) * p2, 31) * p1 ^ (p5 + np.uint64(50))
    h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return np.mod((h ^ (h >> np.uint64(32))).view(np.int64), parts)


def _dealt(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """LISTS with the part of each list: a row becomes one for each part that its texts are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _pieces(pa.Table.from_batches([batch]), np.arange(batch.num_rows)):
                (ids, n), (tfs, _), (lengths, _) = (_numbers(rows[c], kind) for c, kind in (("ids", np.int64), ("tfs", np.int32), ("lengths", np.int32)))
                code = np.repeat(np.arange(len(n)), n) * parts + _part_of(ids, parts)
                order = np.argsort(code, kind="stable")
                code = code[order]
                ends = np.r_[np.flatnonzero(code[1:] != code[:-1]) + 1, len(code)] if len(code) else np.empty(0, np.int64)
                term = rows["term"].combine_chunks().take(pa.array(code[ends - 1] // parts))
                part = pa.array((code[ends - 1] % parts).astype(np.int32))
                yield pa.RecordBatch.from_arrays([term, *[_bytes_of(x[order], ends) for x in (ids, tfs, lengths)], part], names=["term", "ids", "tfs", "lengths", "part"])

    return run


def _cut(size: int, mean: float, repeats: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of LISTS with their parts, in the order of term and part, blocks of `size`. A task holds a batch and a list.
    repeats: whether an id may be twice in a list; its counts are added up then."""

    def starts_of(rows: pa.Table) -> np.ndarray:
        terms, parts = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy(), rows["part"].to_numpy()
        return np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (parts[1:] != parts[:-1])])

    def blocks(rows: pa.Table) -> pa.RecordBatch:
        firsts = starts_of(rows)
        (ids, n), (tf, _), (length, _) = (_numbers(rows[c], kind) for c, kind in (("ids", np.int64), ("tfs", np.int32), ("lengths", np.int32)))
        of = np.repeat(np.repeat(np.arange(len(firsts)), np.diff(np.r_[firsts, rows.num_rows])), n)
        if repeats:
            order = np.lexsort((ids, of))
            ids, of, tf, length = ids[order], of[order], tf[order], length[order]
            one = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])])
            ids, of, tf, length = ids[one], of[one], np.add.reduceat(tf, one, dtype=np.int32), np.maximum.reduceat(length, one)
        order = np.lexsort((ids, -_part(tf, length, mean), of))
        lengths = np.bincount(of, minlength=len(firsts))
        cuts = -(-lengths // size)
        place = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin = np.repeat(np.cumsum(lengths) - lengths, cuts) + place * size
        n = np.diff(np.r_[begin, len(order)])
        order = order[np.lexsort((ids[order], np.repeat(np.arange(len(begin)), n)))]  # by id within a block
        ids, tf, length = ids[order], tf[order], length[order]
        entries = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(order)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(ids), pa.array(tf), pa.array(length)], names=["id", "tf", "length"]))
        some = rows.select(["term", "part"]).take(pa.array(np.repeat(firsts, cuts)))
        columns = [some["term"].combine_chunks(), some["part"].combine_chunks(), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(np.maximum.reduceat(tf, begin)), pa.array(np.minimum.reduceat(length, begin)), entries]
        return pa.RecordBatch.from_arrays(columns, names=["term", "part", "place", "n", "most", "shortest", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waits: list[pa.RecordBatch] = []  # of the last list, which may go on
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([*waits, batch])
                starts = starts_of(rows)
                if len(starts) > 1:
                    yield from map(blocks, _pieces(rows.slice(0, int(starts[-1])), starts[:-1]))
                waits = rows.slice(int(starts[-1])).to_batches()
        if waits:
            yield blocks(pa.Table.from_batches(waits))

    return run


def _gone_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the ids of each row (term, segment, ids) are among those of the row without a term that came last."""
    gone = np.empty(0, np.int64)
    for batch in batches:
        ends = np.r_[np.flatnonzero(batch["term"].is_null().to_numpy(zero_copy_only=False)), batch.num_rows]
        at = 0
        for end in map(int, ends):
            rows = batch.slice(at, end - at)
            if rows.num_rows and len(gone):
                ids = rows["ids"].flatten().to_numpy()
                found = gone[np.minimum(np.searchsorted(gone, ids), len(gone) - 1)] == ids
                n = np.diff(np.r_[0, np.cumsum(found)][np.r_[0, np.cumsum(pc.list_value_length(rows["ids"]).to_numpy())]])
                some = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([rows["term"].take(some), rows["segment"].take(some), pa.array(-n[n > 0])], names=["term", "segment", "df"])
            if end < batch.num_rows:
                gone = np.sort(batch["ids"].slice(end, 1).flatten().to_numpy())
            at = end + 1


class KeywordIndex:
    """In a catalog of its own. stem: of words, None for none; the same as long as the index lasts."""

    def __init__(self, spark: SparkSession, path: str, stem: Callable[[str], str] | None = porter):
        self.spark, self.stem = spark, stem
        self.tables = Catalog.open(spark, path, "keywords", create=True)

    # What is held.

    def sync(self, chunk: DataFrame, key: str = "id", text: str = "text") -> dict:
        """Hold these texts and no others: new ids become a segment, ids that are gone are taken out of all counts. A text that
        changes has to come under another id. Counts of both come back."""
        t = self.tables
        with t.transaction():
            known, fresh = t.table("text").select("id"), chunk.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
            if known.isEmpty():  # no text is shuffled then
                out = {"removed": 0, "added": self._add(fresh)}
            else:
                lost = known.join(chunk.select(F.col(key).cast("long").alias("id")), "id", "left_anti")
                out = {"removed": self._remove(lost), "added": self._add(fresh.join(known, "id", "left_anti"))}
            if t.table("word").agg(F.count_distinct("segment")).first()[0] > SEGMENTS:
                self.merge()
        return out

    def _add(self, fresh: DataFrame) -> int:
        t = self.tables
        segment = int(t.fact("segments") or 0)
        with t.scratch() as folder:
            # Texts are split once: their words are counted within each, and listed by word for many texts, before anything is shuffled.
            spaced(fresh, "id", "text").mapInArrow(_lists(self.stem, TEXTS), LISTS).write.parquet(folder)
            lists = self.spark.read.schema(LISTS).parquet(folder)
            texts = t.append("text", lists.filter("term IS NULL").select("ids", "lengths").mapInArrow(_lengths, "id long, length int"))
            n, mean, ids = texts.agg(F.count("*"), F.avg("length"), F.count_distinct("id")).first()
            if n:
                self._write(lists.filter("term IS NOT NULL"), segment, n, mean, ids < n)
                t.set_fact("segments", str(segment + 1))
        return n

    def _write(self, lists: DataFrame, segment: int, texts: int, mean: float, repeats: bool = False) -> None:
        """lists: LISTS. A list is that of a word in one of as many parts of the texts as keep it bounded. Blocks are laid down as
        they are made, in the order of word, part and place in each file."""
        t, parts = self.tables, -(-texts // LIST_TEXTS)
        dealt = lists.mapInArrow(_dealt(parts), f"{LISTS}, part int") if parts > 1 else lists.withColumn("part", F.lit(0))
        blocks = dealt.repartition("term", "part").sortWithinPartitions("term", "part").mapInArrow(_cut(BLOCK, mean, repeats), BLOCKS)
        held = t.append("block", blocks.withColumn("segment", F.lit(segment)))
        t.append("word", held.groupBy("term", "segment").agg(F.sum("n").alias("df")))
        t.set_fact(f"parts-{segment}", str(parts))

    def _remove(self, lost: DataFrame) -> int:
        """Their postings stay in the blocks until the next merge, passed over, and are subtracted from their words' counts."""
        t = self.tables
        if lost.isEmpty():
            return 0
        gone = t.append("gone", lost.distinct())
        t.append("word", self._lost_words(gone).groupBy("term", "segment").agg(F.sum("df").alias("df")))
        return t.delete("text", gone, ["id"])

    def _lost_words(self, gone: DataFrame) -> DataFrame:
        """term, segment, df: less than 0. The ids of a part, as many as LIST_TEXTS or so, meet its blocks in a stream, so that no
        posting is a row; each part is dealt by word to SHARES tasks, which get these ids each."""
        t = self.tables
        parts = {s: int(t.fact(f"parts-{s}") or 0) for s in range(int(t.fact("segments") or 0))}
        blocks = t.table("block").select("term", "segment", "part", F.col("entries.id").alias("ids"))
        known = F.array(*[F.struct(F.lit(s).alias("segment"), F.lit(p).alias("parts")) for s, p in parts.items() if p])
        out = None
        if any(parts.values()):
            ids = gone.select("id", F.explode(known).alias("of")).groupBy("of.segment", F.pmod(F.xxhash64("id"), F.col("of.parts")).cast("int").alias("part")).agg(F.collect_list("id").alias("ids"))
            ids = ids.select(F.lit(None).cast("string").alias("term"), "segment", "part", "ids", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
            both = ids.unionByName(blocks.filter(F.col("segment").isin(*[s for s, p in parts.items() if p])).withColumn("share", F.pmod(F.xxhash64("term"), F.lit(SHARES)).cast("int")))
            keys = ["segment", "part", "share"]
            out = both.repartition(*keys).sortWithinPartitions(*keys, F.asc_nulls_first("term")).select("term", "segment", "ids").mapInArrow(_gone_of, "term string, segment int, df long")
        if not all(parts.values()):  # segments from before it was noted how many parts they have
            older = blocks.filter(F.col("segment").isin(*[s for s, p in parts.items() if not p]))
            each = older.select("term", "segment", F.explode("ids").alias("id")).join(gone, "id", "left_semi").select("term", "segment", F.lit(-1).cast("long").alias("df"))
            out = each if out is None else out.unionByName(each)
        return out

    def merge(self) -> None:
        """All segments in one, without what is gone."""
        t = self.tables
        with t.transaction():
            postings = self._live(t.table("block").select("term", F.explode("entries").alias("e")).select("term", "e.*"))
            n, mean = t.table("text").agg(F.count("*"), F.avg("length")).first()
            segment = int(t.fact("segments") or 0)
            with t.scratch() as folder:
                postings.mapInArrow(_packed, LISTS).write.parquet(folder)
                for name in ("block", "word", "gone"):
                    t.write(name, t.table(name).limit(0))
                if n:
                    self._write(self.spark.read.schema(LISTS).parquet(folder), segment, n, mean)
            t.set_fact("segments", str(segment + 1))

    def _live(self, postings: DataFrame) -> DataFrame:
        gone = self.tables.table("gone")
        return postings if gone.isEmpty() else postings.join(gone, "id", "left_anti")

    # Search.

    def search(self, query: str, k: int = 5, among: DataFrame | None = None) -> DataFrame:
        """id, score of the k best texts, ids settle ties; `among` (id) restricts what may be found, not the counts."""
        return self.explained(query, k, among)[0]

    def explained(self, query: str, k: int = 5, among: DataFrame | None = None) -> tuple[DataFrame, dict]:
        """The same, and how many postings the words asked for have, and how many of them the search reads."""
        t, terms = self.tables, query_terms(query, self.stem)
        none = self.spark.createDataFrame([], "id long, score double")
        total, mean = t.table("text").agg(F.count("*"), F.avg("length")).first()
        counts = {r["term"]: r["df"] for r in t.table("word").filter(F.col("term").isin(*set(terms))).groupBy("term").agg(F.sum("df").alias("df")).collect() if r["df"] > 0} if terms and total else {}
        if not counts:
            return none, {"postings": 0, "read": 0}
        raw = {w: F.log(F.lit((total - n + 0.5) / (n + 0.5))) for w, n in counts.items()}
        weights = self.spark.range(1).select(*[(F.when(x > 0, x).otherwise(LEAST_IDF) * terms.count(w)).alias(f"w{i}") for i, (w, x) in enumerate(raw.items())]).first()
        weight = F.create_map(*[x for i, w in enumerate(counts) for x in (F.lit(w), F.lit(weights[i]))])[F.col("term")]
        blocks = t.table("block").filter(F.col("term").isin(*counts))
        meta = blocks.select("term", "segment", "part", "place", "n", (weight * _part(F.col("most"), F.col("shortest"), mean)).alias("bound"))
        meta = meta.filter("bound IS NOT NULL")

        def scores(some: DataFrame) -> DataFrame:
            found = self._live(some.select("term", F.explode("entries").alias("e")).select("term", "e.*"))
            found = found if among is None else found.join(among.select(F.col("id").cast("long")).distinct(), "id", "left_semi")
            return found.groupBy("id").agg(F.sum(weight * _part(F.col("tf"), F.col("length"), mean)).alias("score"))

        best = {r["term"]: r["bound"] for r in meta.groupBy("term").agg(F.max("bound").alias("bound")).collect()}
        # A floor: the k-th score that a few of the best blocks give. What they leave out can only add to it.
        firsts = []
        for w in best:
            firsts += meta.filter(F.col("term") == w).orderBy(F.desc("bound")).limit(-(-k // BLOCK) + 1).collect()  # two blocks a word, for the usual k
        chosen = F.broadcast(self.spark.createDataFrame([(r["term"], r["segment"], r["part"], r["place"]) for r in firsts], "term string, segment int, part int, place int"))
        upto = scores(blocks.filter(F.col("place") <= max(r["place"] for r in firsts)).join(chosen, ["term", "segment", "part", "place"], "left_semi")).orderBy(F.desc("score")).limit(k).agg(F.min("score"), F.count("*")).first()
        floor = upto[0] * (1 - 1e-12) if upto[1] == k else float("-inf")  # sums in another order may differ in the last digit
        others = F.create_map(*[x for w in best for x in (F.lit(w), F.lit(sum(b for v, b in best.items() if v != w)))])[F.col("term")]
        kept = meta.filter(F.col("bound") + others >= floor)
        last = {r["term"]: (r["place"], r["n"]) for r in kept.groupBy("term").agg(F.max("place").alias("place"), F.sum("n").alias("n")).collect()}
        # Blocks stand in files by word and place: up to the last place that counts, the rest isn't read.
        reach = [(F.col("term") == w) & (F.col("place") <= place) for w, (place, _) in last.items()]
        wanted = reach[0]
        for r in reach[1:]:
            wanted = wanted | r
        bound = weight * _part(F.col("most"), F.col("shortest"), mean)
        out = scores(blocks.filter(wanted).filter(bound + others >= floor)).orderBy(F.desc("score"), "id").limit(k)
        return out, {"postings": sum(counts.values()), "read": sum(n for _, n in last.values())}
