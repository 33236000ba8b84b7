"""SimHash near-duplicates with anchor-point covering.

Fingerprints of 64 bits that differ in at most THRESHOLD bits are linked. The anchors are the words of a covering code:
every string of bits is within the code's covering radius of an anchor. A fingerprint is at home at the nearest anchor
and is copied to every anchor within that radius plus the threshold; if x and y are linked, y has a copy at x's home, so
comparing what meets at each anchor finds every link. The code is the product of two perfect binary Golay codes (each 23
bits, 4096 words, radius 3) on the first 46 bits, the other bits being free: 16.8 million anchors, one nearest anchor for
each fingerprint and 61 copies on average, whatever the number of fingerprints.

Only distinct fingerprints meet at the anchors, only anchors that are somebody's home and hold something else are
compared, and an anchor emits a spanning forest of its links, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.llm.common import pieces, stored, unused
from vitalspan.llm.components import connected

THRESHOLD, SHINGLE, SEED = 2, 3, 42
#: The Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 over 23 bits.
GENERATOR, LENGTH, CHECKS, RADIUS, CODES = 0xC75, 23, 11, 3, 2
#: Fingerprints at home, and copies, in a cell; an anchor with more is compared in several cells.
HOMES, COPIES = 4096, 16384
#: Bits of a byte, each in a byte of its own, so that 255 rows can be added up at once.
SPREAD = np.array([sum(((b >> k) & 1) << (8 * k) for k in range(8)) for b in range(256)], np.uint64)


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """Words are runs of other than ASCII white space, A-Z lower-cased; a bit is set if it is in over half of the shingles' hashes."""
    found = text.encode().lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return 0
    runs = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    count = max(1, len(found) - words + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in runs), "<u8", count)
    spread = SPREAD[hashes.view(np.uint8).reshape(count, 8)]
    sums = np.add.reduceat(spread, np.arange(0, count, 255), axis=0)
    per_bit = sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * per_bit > count, bitorder="little").tobytes(), "little")


def fingerprinted(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, tie (a hash of the text), fp (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps = lambda texts: pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))
        yield from pieces(batches, lambda b: pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps(b.column(2))], names=["doc", "tie", "fp"]))

    rows = docs.select(F.col(doc).alias("doc"), F.xxhash64(text).alias("tie"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.mapInArrow(run, f"doc {dict(docs.dtypes)[doc]}, tie long, fp long")


def _remainder(x: np.ndarray) -> np.ndarray:
    """The syndrome: the polynomial modulo the generator."""
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - CHECKS)), x)
    return x


@lru_cache(1)
def cosets() -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each excess over the radius (0: at most 3 bits, 1: 4, 2: 5), the errors by syndrome (starts, errors); and the smallest error of each syndrome."""
    by_excess = []
    for excess in range(THRESHOLD + 1):
        weights = range(RADIUS + 1) if excess == 0 else [RADIUS + excess]
        errors = np.array([sum(1 << b for b in c) for w in weights for c in combinations(range(LENGTH), w)], np.int64)
        syndromes = _remainder(errors)
        order = np.argsort(syndromes, kind="stable")
        by_excess.append((np.searchsorted(syndromes[order], np.arange((1 << CHECKS) + 1)), errors[order]))
    return by_excess, by_excess[0][1]  # radius 3, perfect: one error for each syndrome


def anchors(fps: np.ndarray, blocks: int = CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home) of every copy of these fingerprints; blocks: Golay codes in use."""
    by_excess, nearest = cosets()
    bits = fps.view(np.uint64)
    row, anchor, home, left = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool), np.full(len(fps), THRESHOLD)
    for block in range(blocks):
        part = (bits >> np.uint64(LENGTH * block) & np.uint64((1 << LENGTH) - 1)).astype(np.int64)
        syndrome = _remainder(part)
        out = []
        for excess, (starts, errors) in enumerate(by_excess):
            can = np.flatnonzero(left >= excess)
            s = syndrome[row[can]]
            n = starts[s + 1] - starts[s]
            which = np.repeat(can, n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[s], n)
            word = part[row[which]] ^ errors[place]
            out.append((row[which], anchor[which] << LENGTH | word, home[which] & (excess == 0), left[which] - excess))
        row, anchor, home, left = (np.concatenate(c) for c in zip(*out, strict=True))
    return row, anchor, home


def _forest(homes: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for each node linked with another: homes are compared with copies, a few million at a time."""
    nodes = np.unique(np.concatenate((homes, copies)))
    at_home, at_copy = np.searchsorted(nodes, homes), np.searchsorted(nodes, copies)
    label = np.arange(len(nodes))
    step = max(1, 2_000_000 // max(1, len(copies)))
    left, right = homes.view(np.uint64), copies.view(np.uint64)
    for lo in range(0, len(homes), step):
        near = np.bitwise_count(left[lo : lo + step, None] ^ right[None, :]) <= THRESHOLD
        for i in np.flatnonzero(near.sum(axis=1) > 1) if len(copies) > 1 else range(len(near)):
            met = np.unique(np.append(label[at_copy[near[i]]], label[at_home[lo + i]]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
        if len(copies) > 1:  # one link only, and not with itself
            for i in np.flatnonzero(near.sum(axis=1) == 1):
                j = at_copy[int(near[i].argmax())]
                if label[j] != label[at_home[lo + i]]:
                    met = sorted((label[j], label[at_home[lo + i]]))
                    label[label == met[1]] = met[0]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def links(fps: DataFrame) -> DataFrame:
    """a, b: edges that connect all fingerprints (column fp, distinct) that are linked, within each anchor a forest."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch: pa.RecordBatch) -> pa.RecordBatch:
            some = batch.column(0).to_numpy()
            row, anchor, home = anchors(some)
            return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(some[row]), pa.array(home)], names=["anchor", "fp", "home"])

        yield from pieces(batches, made)

    copies = stored(fps.select("fp").mapInArrow(copy, "anchor long, fp long, home boolean"), "copies")
    # Only what meets somebody at home. Anchors with many fingerprints become a grid of cells.
    held = copies.groupBy("anchor").agg(F.count_if("home").alias("h"), F.count("*").alias("n")).filter("h > 0 AND n > 1")
    grid = held.select("anchor", F.ceil(F.col("h") / HOMES).cast("int").alias("rows"), F.ceil(F.col("n") / COPIES).cast("int").alias("columns"))
    placed = copies.join(grid, "anchor")
    spread = F.pmod(F.xxhash64("fp", F.lit(1)), F.greatest("rows", F.lit(1))).cast("int")
    across = F.pmod(F.xxhash64("fp", F.lit(2)), F.greatest("columns", F.lit(1))).cast("int")
    as_home = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: F.struct(spread.alias("i"), c.alias("j"), F.lit(True).alias("at_home")))).otherwise(F.array().cast("array<struct<i:int,j:int,at_home:boolean>>"))
    as_copy = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.struct(r.alias("i"), across.alias("j"), F.lit(False).alias("at_home")))
    cells = placed.select("anchor", "fp", F.explode(F.concat(as_home, as_copy)).alias("c")).select("anchor", "c.i", "c.j", "fp", "c.at_home")

    def compare(cell: pa.Table) -> pa.Table:
        fp, home = cell["fp"].to_numpy(), cell["at_home"].to_numpy(zero_copy_only=False)
        node, root = _forest(np.sort(fp[home]), np.sort(fp[~home]))
        return pa.table({"a": pa.array(node, pa.int64()), "b": pa.array(root, pa.int64())})

    return cells.groupBy("anchor", "i", "j").applyInArrow(compare, "a long, b long")


def simhash_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, tie (a hash of the text), fp (64 bits as a long), root (a fingerprint that names the group) and component (the
    smallest id among all rows it is connected with) of every row.

    Texts without a word, null ones too, have fingerprint zero and are linked like any other. Repeated rows are rows of
    their own with equal results. A null id never is the smallest; a group of nulls only has a null component. An empty
    table gives no rows; other columns are ignored."""
    rows = stored(fingerprinted(docs, doc, text), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc").alias("least")), "distinct")
    roots = connected(links(distinct))
    owned = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    owned = stored(owned, "owned")
    smallest = owned.groupBy("root").agg(F.min("least").alias("component"))
    of = owned.join(smallest, "root").select("fp", "root", "component")
    return rows.join(of, "fp").select(F.col("doc").alias(doc), "tie", "fp", "root", "component")


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without near-duplicates: of each group the row with the smallest id stays (null last, then by a hash of the text)."""
    groups = simhash_groups(docs, doc, text)
    key, tie, number = unused(docs, "_key", "_tie", "_n")
    hashed = lambda c: F.coalesce(F.xxhash64(c), F.lit(-(1 << 63)).cast("long"))
    first = groups.groupBy("root").agg(F.min(F.struct(F.col(doc).isNull(), F.col(doc).alias("doc"), "tie")).alias("m"))
    chosen = first.select(hashed(F.col("m.doc")).alias(key), F.col("m.tie").alias(tie)).distinct()
    numbered = docs.withColumn(key, hashed(F.col(doc))).withColumn(tie, F.xxhash64(text))
    numbered = numbered.withColumn(number, F.row_number().over(Window.partitionBy(key, tie).orderBy(tie)))
    return numbered.filter(F.col(number) == 1).join(chosen, [key, tie], "left_semi").select(*docs.columns)
