"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources share a budget of words by weight; a source's target stops at CAP times its size and the rest is shared again.
The targets are votes for a house whose seats are equal blocks of words: they go to the highest quotients target / (2s + 1)
over all sources, s being the seats a source has so far, ties to the source that comes first. A seat is BLOCK words, or as many
fewer as let the smallest target have a fair number of seats (`seat_words`), so every source sits in the house and none vanishes.

The words of a source lie in shards (rows dealt by a hash, in a seeded order), cut into blocks across the borders of
documents. What a source has won is dealt to its shards in the same way, by highest quotients words / (2s + 1); the last
block may be a partial one, and a shard that gives CAP times its words gives no more. A shard's quota then takes whole
rounds of its blocks and, of one more round, blocks in a seeded order, of which the words at the end that go beyond the
quota are left off. No word is taken more than CAP times.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.llm.common import ASCII_SPACE, partitions, stored, unused

WEIGHTS, SHARE, CAP, BLOCK, SEED = (5, 2, 1), 1.5, 2, 128, 17
#: Seats that the smallest target has at least, unless a seat is a single word: one more or less is little then.
LEAST_SEATS = 256
#: Words, and rows, of a shard on average.
SHARD_WORDS, SHARD_DOCUMENTS = 1 << 20, 1 << 14
#: Thresholds that one pass over the sources tries.
TRIED = 128
WORD = r"[^\x20\x09-\x0D]+"


def _shares(votes: np.ndarray, least: float) -> np.ndarray:
    """How many quotients votes / (2s + 1) of each party are `least` or more."""
    about = np.maximum(np.floor((votes / least + 1) / 2) - 1, 0)
    for _ in range(3):
        about += votes / (2 * about + 1) >= least
    return about.astype(np.int64)


def sainte_lague(votes: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients votes / (2s + 1), ties to the earlier party: the quotient of the last seat is found by counting."""
    votes = np.asarray(votes, np.float64)
    if seats <= 0 or not votes.sum():
        return np.zeros(len(votes), np.int64)
    low = _bits(float(votes.sum()) / (2 * seats + len(votes)) * (1 - 1e-9))
    last = _double(_highest(low, _bits(float(votes.max())), lambda tried: [int(_shares(votes, _double(t)).sum()) >= seats for t in tried], 1))
    given, tied = _shares(votes, _double(_bits(last) + 1)), _shares(votes, last)
    tied -= given
    upto = np.minimum(np.cumsum(tied), seats - int(given.sum()))
    return given + np.diff(upto, prepend=0)


def quotas(words: np.ndarray, target: float, cap: float = CAP, block: int = BLOCK) -> np.ndarray:
    """The words that each shard of a source gives: the target in all, rounded, or cap times the words if that is less.

    A few numbers a shard are held, in arrays; what the last block and shards at their limit leave is dealt one by one."""
    words = np.asarray(words, np.int64)
    limits = (cap * words).astype(np.int64)
    left = min(int(target + 0.5), int(limits.sum()))
    blocks = sainte_lague(words, left // block)
    given = np.minimum(blocks * block, limits)
    left -= int(given.sum())
    open_shards = np.flatnonzero(given < limits) if left else []
    queue = [(-int(words[i]) / (2 * int(blocks[i]) + 1), int(i)) for i in open_shards]
    heapify(queue)
    while left > 0:
        i = queue[0][1]
        n = min(block, left, int(limits[i] - given[i]))
        given[i], blocks[i], left = given[i] + n, blocks[i] + 1, left - n
        if given[i] < limits[i]:
            heapreplace(queue, (-int(words[i]) / (2 * int(blocks[i]) + 1), i))
        else:
            heappop(queue)
    return given


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: source, size. source, source_size, documents, rank, target and given (the words that it has won) of each source.

    Weights repeat over the sources by code point, null last. Sources are ranked range by range and targets found by
    rounds of one sum, so neither needs all sources in one place; the driver gets a row for each range."""
    spark = sizes.sparkSession
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents"))
    order = [F.col("source").isNull(), F.col("source")]
    ranges = stored(sources.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id()), "sources")
    before, at = [], 0
    for r in sorted(ranges.groupBy("range").count().collect()):
        before.append((r["range"], at))
        at += r["count"]
    offsets = spark.createDataFrame(before, "range int, before long")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = stored(ranges.join(F.broadcast(offsets), "range").withColumn("rank", rank).withColumn("weight", weight).drop("range", "before"), "ranked")
    limit = F.col("source_size") * float(cap)
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, F.lit(False)
    while True:  # level: the target for each unit of weight among sources that haven't stopped
        full, open_weight = ranked.agg(F.sum(F.when(stopped, limit)), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not open_weight:
            level = float("inf")
            break
        new = (total - (full or 0.0)) / open_weight
        if new <= level:
            break
        level, stopped = new, limit <= F.col("weight") * new
    target = F.least(limit, F.col("weight") * F.lit(level)) if np.isfinite(level) else limit
    parties = stored(ranked.select("source", "source_size", "documents", "rank", target.alias("target")), "targets")
    some = F.col("target") > 0
    wanted, smallest = parties.filter(some).agg(F.sum("target"), F.min("target")).first()
    seat = seat_words(smallest or 0.0)
    seated = house(parties.filter(some).withColumn("votes", F.col("target")), int((wanted or 0.0) / seat + 0.5)).withColumn("given", F.least(F.col("won") * seat, limit.cast("long")))
    columns = ["source", "source_size", "documents", "rank", "target", "given"]
    return stored(seated.select(*columns).unionByName(parties.filter(~some).withColumn("given", F.lit(0).cast("long")).select(*columns)), "given")


def seat_words(smallest: float) -> int:
    """The words of a seat: the largest power of two up to BLOCK of which LEAST_SEATS fit into the smallest target, or one."""
    words = BLOCK
    while words > 1 and words * LEAST_SEATS > smallest:
        words //= 2
    return words


def _highest(low: int, high: int, enough: Callable[[list[int]], list[bool]], at_once: int = TRIED) -> int:
    """The largest of low..high that is enough (low is, and enough only ever turns from true to false), some tried at once."""
    while low < high:
        step = -(-(high - low) // (at_once + 1 if at_once == 1 else at_once))
        tried = list(range(low + step, high + 1, step))
        answers = enough(tried)
        below = [t for t, yes in zip(tried, answers, strict=True) if yes]
        above = [t for t, yes in zip(tried, answers, strict=True) if not yes]
        low, high = max(below, default=low), min(above, default=high + 1) - 1
    return low


def _double(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def _bits(x: float) -> int:
    """Positive doubles are ordered as these integers are."""
    return struct.unpack("<q", struct.pack("<d", x))[0]


def _won(votes: Column, least: Column) -> Column:
    """How many quotients votes / (2s + 1) are `least` or more: about (votes / least + 1) / 2, made exact by the quotients there."""
    about = F.greatest(F.floor((votes / least + 1) / 2) - 1, F.lit(0)).cast("long")
    more = lambda n: (votes / (2 * (about + n) + 1) >= least).cast("long")
    return about + more(0) + more(0) * more(1) + more(0) * more(1) * more(2)


def house(parties: DataFrame, seats: int) -> DataFrame:
    """parties: rank (distinct), votes (above zero), others. The same with won: the seats by highest quotients, ties to the lower rank.

    The quotient that gets the last seat is searched for by counting, a few passes of one sum, so the parties stay distributed."""
    n, total, most = parties.agg(F.count("*"), F.sum("votes"), F.max("votes")).first()
    if not n or seats <= 0:
        return parties.withColumn("won", F.lit(0).cast("long"))

    def counted(thresholds: list[float], of: Callable[[Column], Column]) -> list[int]:
        tried = F.explode(F.array(*[F.lit(float(t)) for t in thresholds]))
        found = {r["t"]: r["n"] for r in parties.select("votes", "rank", tried.alias("t")).groupBy("t").agg(F.sum(of(F.col("t"))).alias("n")).collect()}
        return [found[float(t)] for t in thresholds]

    # At total / (2 * seats + n) there are enough quotients, whatever the roundings.
    low = _bits(total / (2 * seats + n) * (1 - 1e-9))
    last = _double(_highest(low, _bits(most), lambda tried: [c >= seats for c in counted([_double(t) for t in tried], lambda t: _won(F.col("votes"), t))]))
    above = _double(_bits(last) + 1)
    sure, least = parties.agg(F.sum(_won(F.col("votes"), F.lit(above))), F.sum(_won(F.col("votes"), F.lit(last)))).first()
    own, tied = _won(F.col("votes"), F.lit(above)), _won(F.col("votes"), F.lit(last)) - _won(F.col("votes"), F.lit(above))
    if least > seats:  # more parties have that very quotient than there are seats left
        low, high = parties.agg(F.min("rank"), F.max("rank")).first()
        first_without = _highest(low, high, lambda tried: [c <= seats - sure for c in counted(tried, lambda t: F.when(F.col("rank") < t, tied).otherwise(0))])
        tied = F.when(F.col("rank") < first_without, tied).otherwise(0)
    return parties.withColumn("won", (own + tied).cast("long"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that looks random."""
    x = x.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def choose(sizes: np.ndarray, target: float, seed: int, block: int = BLOCK) -> tuple[int, np.ndarray]:
    """Whole rounds, and the fewest blocks of one more that reach the rest, for a shard with these documents in order."""
    words, wanted = int(sizes.sum()), int(target + 0.5)
    if not words or not wanted:
        return 0, np.empty(0, np.int64)
    rounds, rest = divmod(wanted, words)
    if rounds >= CAP:
        return CAP, np.empty(0, np.int64)
    blocks = np.arange(-(-words // block))
    order = np.argsort(_mixed(blocks.astype(np.uint64) + np.uint64(seed % (1 << 64))), kind="stable")
    ends = np.cumsum(np.minimum(block, words - blocks * block)[order])
    n = int(np.searchsorted(ends, rest)) + 1 if rest else 0
    return rounds, np.sort(order[:n])


def taken_spans(sizes: np.ndarray, chosen: np.ndarray, block: int = BLOCK, most: int | None = None) -> list[list[dict]]:
    """For each document the runs of its words (start, end) that chosen blocks hold, up to `most` words in all."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    out: list[list[dict]] = [[] for _ in sizes]
    left = int(ends[-1]) if most is None else most
    for b in chosen:
        lo, hi = int(b) * block, min((int(b) + 1) * block, int(ends[-1]))
        hi = min(hi, lo + left)
        left -= hi - lo
        i = int(np.searchsorted(ends, lo, side="right"))
        while i < len(sizes) and starts[i] < hi:
            a, z = max(lo, int(starts[i])) - int(starts[i]), min(hi, int(ends[i])) - int(starts[i])
            if z > a:
                if out[i] and out[i][-1]["end"] == a:
                    out[i][-1]["end"] = z
                else:
                    out[i].append({"start": a, "end": z})
            i += 1
    return out


def mix(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc, source, tie (a hash of the text), copy, size, source_size, target, rounds, spans (array of start, end in words), taken of every row.

    taken = rounds * size + the words of spans. Null texts have no words. Repeated rows (the same id, source and text) are
    rows of their own, numbered by copy. Null ids and sources are values like others. An empty table gives no rows; other
    columns are ignored."""
    sized = docs.select(F.col(doc).alias("doc"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("tie"))
    sized = stored(sized.withColumn("part", F.spark_partition_id()), "sizes")
    targets = source_targets(sized, weights, share, cap)
    shards = F.ceil(F.greatest(F.col("source_size") / SHARD_WORDS, F.col("documents") / SHARD_DOCUMENTS)).cast("long")
    # Copies of a row are numbered within each part first, then the parts' counts are added up: no copy's group meets in one task.
    key = ["doc", "source", "tie"]
    within = sized.withColumn("place", F.row_number().over(Window.partitionBy(*key, "part").orderBy("size")))
    many = sized.groupBy(*key, "part").agg(F.count("*").alias("n"))
    before = many.withColumn("before", F.sum("n").over(Window.partitionBy(*key).orderBy("part")) - F.col("n")).filter("before > 0")
    same = [within[c].eqNullSafe(before[c]) for c in [*key, "part"]]
    numbered = within.join(before, same, "left").select(*[within[c] for c in [*key, "size"]], (F.col("place") + F.coalesce("before", F.lit(0))).cast("long").alias("copy"))
    rows = numbered.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc", "tie", "copy"), F.greatest(shards, F.lit(1))))
    rows = rows.withColumn("place", F.xxhash64(F.lit(seed + 1), "doc", "tie", "copy")).select("doc", "source", "tie", "copy", "size", "source_size", "target", "given", "shard", "place")
    rows = stored(rows, "rows")
    shares = rows.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("given").alias("given"))  # a row a shard

    def dealt(source: pa.Table) -> pa.Table:
        source = source.sort_by("shard")
        quota = quotas(source["words"].to_numpy(), source["given"][0].as_py(), cap)
        return pa.table({"source": source["source"], "shard": source["shard"], "quota": pa.array(quota, pa.int64())})

    quota = shares.groupBy("source").applyInArrow(dealt, "source string, shard long, quota long")
    kind = dict(rows.dtypes)["doc"]
    schema = f"doc {kind}, source string, tie long, copy long, size long, source_size long, target double, rounds int, spans array<struct<start:long,end:long>>, taken long"

    def allot(shard: pa.Table, quota: pa.Table) -> pa.Table:
        shard = shard.sort_by([("place", "ascending"), ("doc", "ascending"), ("tie", "ascending"), ("copy", "ascending")])
        sizes = shard["size"].to_numpy()
        mine = quota["quota"][0].as_py()
        mark = hash_of(f"{seed}/{shard['source'][0].as_py()}/{shard['shard'][0].as_py()}")
        rounds, chosen = choose(sizes, mine, mark)
        spans = taken_spans(sizes, chosen, most=mine - rounds * int(sizes.sum())) if len(chosen) else [[] for _ in sizes]
        taken = [rounds * int(n) + sum(s["end"] - s["start"] for s in x) for n, x in zip(sizes, spans, strict=True)]
        columns = {c: shard[c] for c in ("doc", "source", "tie", "copy", "size", "source_size", "target")}
        return pa.table(columns | {"rounds": pa.array([rounds] * len(taken), pa.int32()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "taken": pa.array(taken, pa.int64())})

    return rows.groupBy("source", "shard").cogroup(quota.groupBy("source", "shard")).applyInArrow(allot, schema)


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")


def mixed_documents(docs: DataFrame, mixed: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents as the mix takes them, with the columns of docs: a row with the whole text for each round, and one with
    the passages of its spans where a part is taken: as they stand in the text, white space between words included, a line
    break between passages. Rows of which nothing is taken go; rows without words too."""
    tie, copy, owner, its_source, its_tie, its_copy, rounds, spans, part = unused(docs, "_tie", "_copy", "_doc", "_source", "_t", "_c", "_rounds", "_spans", "_part")
    numbered = docs.withColumn(tie, F.xxhash64(text)).withColumn(copy, F.row_number().over(Window.partitionBy(doc, source, tie).orderBy(tie)))
    plan = mixed.select(F.col("doc").alias(owner), F.col("source").alias(its_source), F.col("tie").alias(its_tie), F.col("copy").alias(its_copy), F.col("rounds").alias(rounds), F.col("spans").alias(spans), "size").filter((F.col("size") > 0) & ((F.col(rounds) > 0) | (F.size(spans) > 0))).drop("size")
    both = numbered.join(plan, F.col(doc).eqNullSafe(F.col(owner)) & F.col(source).eqNullSafe(F.col(its_source)) & (F.col(tie) == F.col(its_tie)) & (F.col(copy) == F.col(its_copy)))
    whole = F.transform(F.filter(F.array(*[F.lit(i) for i in range(int(CAP))]), lambda i: i < F.col(rounds)), lambda i: F.array().cast("array<struct<start:long,end:long>>"))
    parts = F.concat(whole, F.when(F.size(spans) > 0, F.array(spans)).otherwise(F.array().cast("array<array<struct<start:long,end:long>>>")))
    rows = both.withColumn(part, F.explode(parts))
    # Words with the white space after them, cut in the JVM, and only where a part is taken.
    words = F.regexp_extract_all(F.col(text), F.lit(f"{WORD}[\\x20\\x09-\\x0D]*"), F.lit(0))
    passage = lambda s: F.rtrim(F.array_join(F.slice(words, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), ""), F.lit(ASCII_SPACE))
    cut = F.when(F.size(part) > 0, F.array_join(F.transform(F.col(part), passage), "\n")).otherwise(F.col(text))
    return rows.select(*[cut.alias(c) if c == text else F.col(c) for c in docs.columns])
