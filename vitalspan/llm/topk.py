"""Exact top-k by inner product with a KD-tree for each shard.

Vectors are dealt into shards by a top tree, grown on a bounded sample, so that a shard holds what lies together; a leaf
with more rows than a shard may hold (many equal vectors, say) becomes several shards. A shard is searched through a KD-tree
of its own: splits at the median of the widest dimension, and a tight bounding box for each node. The inner product of a
query with anything in a box is at most the sum over dimensions of the larger of q * low and q * high, so a best-first
traversal may stop at the first node whose bound is below the kth score found.

Each query is searched in the shard where it lives first. Its kth score there is its floor: it goes on only to shards whose
whole box can reach that floor, and prunes their trees from the start. The queries of a shard come in blocks of bounded size, so a task
holds one shard and one block, however many there are of either; a shard's own queries are few blocks, so the search at
home reads a shard a few times at most, whatever the table's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.llm.common import stored

SHARD_ROWS, BLOCK_ROWS, LEAF_ROWS = 8192, 4096, 128
#: Numbers in the sample that a top tree is grown on, and shards whose boxes are held against a block of queries at once.
SAMPLE_NUMBERS, BOXES = 1 << 21, 2048


def quantized(vectors: DataFrame, vec: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """row, vec, q (array<long>): floor(scale * x) of each component. Rows take no part if the id or the vector is null, or
    a component is null, NaN or infinite. The ids of rows tell repeated rows apart."""
    numbers = F.transform(F.col(embedding), lambda x: x.cast("double"))
    finite = ~F.coalesce(F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    rows = vectors.select(F.col(vec).cast("long").alias("vec"), numbers.alias("x")).filter(F.col("x").isNotNull() & F.col("vec").isNotNull() & finite)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("q"))


class Tree:
    """Over integer vectors: nodes in arrays, rows reordered so that a leaf is a slice."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.order = np.arange(len(x))
        self.low, self.high, self.span, self.children, self.least = [], [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            start, end, parent, side = todo.pop()
            part = self.order[start:end]
            rows = x[part]
            low, high = rows.min(axis=0), rows.max(axis=0)
            node = len(self.span)
            self.low.append(low)
            self.high.append(high)
            self.span.append((start, end))
            self.children.append(None)
            self.least.append(int(ids[part].min()))
            if parent >= 0:
                self.children[parent] = (node, None) if side == 0 else (self.children[parent][0], node)
            axis = int((high - low).argmax()) if len(low) else 0
            if end - start > LEAF_ROWS and len(low) and high[axis] > low[axis]:
                middle = (end - start) // 2
                self.order[start:end] = part[np.argpartition(rows[:, axis], middle)]
                self.children[node] = (None, None)
                todo += [(start + middle, end, node, 1), (start, start + middle, node, 0)]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The most that each query's inner product with a row below each node can be."""
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T


def search(x: np.ndarray, vec: np.ndarray, row: np.ndarray, q: np.ndarray, q_row: np.ndarray, floor: list, k: int) -> list[list[tuple[int, int, int]]]:
    """For each query the k best (score, vec, row) of a shard, its own row left out, that are no worse than its floor
    (score, vec) or None. Best: highest score, then smallest vec, then smallest row."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    kind = np.float64 if most < 2.0**52 else np.int64 if most < 2.0**62 else object  # sums stay exact
    x, q = x.astype(kind), q.astype(kind)
    tree = Tree(x, vec)
    x, vec, row = x[tree.order], vec[tree.order], row[tree.order]
    bounds = tree.bounds(q)
    out = []
    for i in range(len(q)):
        found: list[tuple[int, int, int]] = []  # (score, -vec, -row), the worst first
        worst, bound = floor[i], bounds[i]
        kth = (worst[0], -worst[1]) if worst else None
        heap = [(-bound[0], 0)]
        while heap:
            least, node = heapq.heappop(heap)
            top = -least
            if kth is not None and (top < kth[0] or top == kth[0] and -tree.least[node] < kth[1]):
                if top < kth[0]:
                    break  # so are all others
                continue
            if tree.children[node] is not None:
                for child in tree.children[node]:
                    heapq.heappush(heap, (-bound[child], child))
                continue
            start, end = tree.span[node]
            scores = x[start:end] @ q[i]
            for j in range(end - start) if kth is None else np.flatnonzero(scores >= kth[0]):
                j = start + int(j)
                item = (int(scores[j - start]), -int(vec[j]), -int(row[j]))
                if row[j] == q_row[i] or kth is not None and item[:2] < kth:
                    continue
                if len(found) < k:
                    heapq.heappush(found, item)
                elif item > found[0]:
                    heapq.heapreplace(found, item)
                if len(found) == k and (kth is None or found[0][:2] > kth):
                    kth = found[0][:2]
        out.append([(s, -v, -r) for s, v, r in sorted(found, reverse=True)])
    return out


def grown(x: np.ndarray, leaves: int) -> list[tuple[int, float, int, int]]:
    """A top tree with about so many leaves: (axis, cut, left, right) of each node; leaves have axis -1 and their number as left.

    Rows below the cut, the median of the widest dimension, go left. What has no spread isn't split."""
    nodes: list[tuple[int, float, int, int]] = []
    count = 0
    todo = [(np.arange(len(x)), leaves, -1, 0)]
    while todo:
        at, want, parent, side = todo.pop()
        me, part = len(nodes), x[at]
        if parent >= 0:
            axis, cut, left, right = nodes[parent]
            nodes[parent] = (axis, cut, me, right) if side == 0 else (axis, cut, left, me)
        spread = part.max(axis=0) - part.min(axis=0) if len(part) and x.shape[1] else np.zeros(1)
        axis = int(spread.argmax())
        cut = float(np.partition(part[:, axis], len(part) // 2)[len(part) // 2]) if len(part) and spread[axis] > 0 else 0.0
        low = part[:, axis] < cut if len(part) and spread[axis] > 0 else np.zeros(0, bool)
        if want < 2 or not low.any():
            nodes.append((-1, 0.0, count, -1))
            count += 1
            continue
        nodes.append((axis, cut, -1, -1))
        todo += [(at[~low], want - want // 2, me, 1), (at[low], want // 2, me, 0)]
    return nodes


def placed(nodes: list[tuple[int, float, int, int]], x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    axis, cut, left, right = (np.array(c) for c in zip(*nodes, strict=True))
    at = np.zeros(len(x), int)
    while len(moving := np.flatnonzero(axis[at] >= 0)):
        here = at[moving]
        at[moving] = np.where(x[moving, axis[here]] < cut[here], left[here], right[here])
    return left[at]


def _dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """dim, shard, row, vec, q; and dim, shards: by a top tree for each length of vectors, and by a hash within full leaves."""
    sized = rows.select(F.size("q").alias("dim"), "row", "vec", "q")
    trees = {}
    for r in sized.groupBy("dim").count().filter(F.col("count") > SHARD_ROWS).collect():  # lengths with many vectors: few
        sample = sized.filter(F.col("dim") == r["dim"]).orderBy(F.xxhash64(F.lit(3), "row"), "row").limit(max(64, SAMPLE_NUMBERS // max(1, r["dim"])))
        trees[r["dim"]] = grown(np.array([x["q"] for x in sample.select("q").collect()], np.int64), -(-2 * r["count"] // SHARD_ROWS))
    sent = rows.sparkSession.sparkContext.broadcast(trees)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, leaf = batch.column(0).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for d, tree in sent.value.items():
                at = np.flatnonzero(dim == d)
                if len(at):
                    leaf[at] = placed(tree, batch.column(3).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=["dim", "row", "vec", "q", "leaf"])

    leafed = stored(sized.mapInArrow(place, "dim int, row long, vec long, q array<long>, leaf long"), "leaves")
    counted = leafed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / SHARD_ROWS).cast("long").alias("parts"))
    first = F.sum("parts").over(Window.partitionBy("dim").orderBy("leaf")) - F.col("parts")  # a row a leaf
    leaves = stored(counted.withColumn("first", first), "leaf-sizes")
    shard = F.col("first") + F.pmod(F.xxhash64(F.lit(4), "row"), F.col("parts"))
    return leafed.join(leaves, ["dim", "leaf"]).select("dim", shard.alias("shard"), "row", "vec", "q"), leaves.groupBy("dim").agg(F.sum("parts").alias("shards"))


def _boxes(dealt: DataFrame) -> DataFrame:
    """dim, shard, low, high of each shard's rows."""

    def box(shard: pa.Table) -> pa.Table:
        x = shard["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(shard.num_rows, -1)
        longs = pa.list_(pa.int64())
        return pa.table({"dim": shard["dim"][:1], "shard": shard["shard"][:1], "low": pa.array([x.min(axis=0)], longs), "high": pa.array([x.max(axis=0)], longs)})

    return stored(dealt.select("dim", "shard", "q").groupBy("dim", "shard").applyInArrow(box, "dim int, shard long, low array<long>, high array<long>"), "boxes")


def _within_reach(asks: DataFrame, boxes: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of asks (with home, block and floors) once for each shard whose box can reach the floor, their home left out.

    Boxes are held against queries in groups of BOXES: a query is copied once for each group, not for each shard."""
    copied = asks.join(groups, "dim").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("shards") - 1) / BOXES)))).drop("shards")
    schema = "dim int, shard long, block int, row long, vec long, q array<long>, floor_score long, floor_vec long"

    def reach(queries: pa.Table, held: pa.Table) -> pa.Table:
        names = [f.split()[0] for f in schema.split(", ")]
        if not queries.num_rows or not held.num_rows:
            return queries.slice(0, 0).append_column("shard", pa.array([], pa.int64())).select(names)
        dim = queries["dim"][0].as_py()
        grid = lambda t, c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, dim)
        q, low, high, shard = grid(queries, "q"), grid(held, "low"), grid(held, "high"), held["shard"].to_numpy()
        most = float(max(np.abs(low).max(initial=0), np.abs(high).max(initial=0))) * float(np.abs(q).max(initial=0)) * max(1, dim)
        kind = np.float64 if most < 2.0**52 else np.int64 if most < 2.0**62 else object  # bounds stay exact
        q, low, high = q.astype(kind), low.astype(kind), high.astype(kind)
        floors = queries["floor_score"].to_pylist()
        home = queries["home"].to_numpy()
        at, to = [], []
        for lo in range(0, len(q), 256):
            part = q[lo : lo + 256]
            bounds = np.maximum(part, 0) @ high.T + np.minimum(part, 0) @ low.T
            for i, bound in enumerate(bounds):
                floor = floors[lo + i]
                near = np.flatnonzero((np.ones(len(shard), bool) if floor is None else bound >= floor) & (shard != home[lo + i]))
                at.append(np.full(len(near), lo + i))
                to.append(shard[near])
        return queries.take(pa.array(np.concatenate(at))).append_column("shard", pa.array(np.concatenate(to), pa.int64())).select(names)

    grouped = boxes.withColumn("group", F.floor(F.col("shard") / BOXES))
    blocked = grouped.join(stored(asks.select("dim", "block").distinct(), "blocks"), "dim")  # the boxes for each block that has queries of that length
    return copied.groupBy("dim", "group", "block").cogroup(blocked.groupBy("dim", "group", "block")).applyInArrow(reach, schema)


FOUND = "query_row long, query_id long, score long, vec_id long, vec_row long"


def _searched(cells: DataFrame, k: int) -> DataFrame:
    """cells: dim, shard, block, is_query, row, vec, q, floor_score, floor_vec."""

    def run(cell: pa.Table) -> pa.Table:
        asks = cell["is_query"].to_numpy(zero_copy_only=False)
        dim = cell["dim"][0].as_py()
        flat = cell["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(asks), dim)
        row, vec = cell["row"].to_numpy(), cell["vec"].to_numpy()
        floors = [None if s is None else (s, v) for s, v, a in zip(cell["floor_score"].to_pylist(), cell["floor_vec"].to_pylist(), asks, strict=True) if a]
        found = search(flat[~asks], vec[~asks], row[~asks], flat[asks], row[asks], floors, k) if asks.any() and not asks.all() else []
        rows = [(int(r), int(v), s, o, n) for r, v, best in zip(row[asks], vec[asks], found, strict=False) for s, o, n in best]
        names = ("query_row", "query_id", "score", "vec_id", "vec_row")
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows, strict=True) if rows else [[]] * 5, strict=True)})

    return cells.groupBy("dim", "shard", "block").applyInArrow(run, FOUND)


def _cells(dealt: DataFrame, asks: DataFrame) -> DataFrame:
    """What `_searched` takes: the rows of each shard that somebody asks, once for each block of those that ask it.

    The queries of a shard are dealt into blocks of BLOCK_ROWS by their own number, so a shard is copied and its tree grown
    as often as its queries need, however many others there are; a shard that nobody asks isn't read."""
    asked = stored(asks.groupBy("dim", "shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "asked")
    none = F.lit(None).cast("long")
    held = dealt.join(asked, ["dim", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("dim", "shard", "block", F.lit(False).alias("is_query"), "row", "vec", "q", none.alias("floor_score"), none.alias("floor_vec"))
    block = F.pmod(F.xxhash64(F.lit(5), "row"), F.col("blocks")).cast("int")  # not the hash that dealt the shards
    return held.unionByName(asks.drop("block").join(asked, ["dim", "shard"]).select("dim", "shard", block.alias("block"), F.lit(True).alias("is_query"), "row", "vec", "q", "floor_score", "floor_vec"))


def top_k(vectors: DataFrame, queries: str = "pmod(vec, 100) = 0", k: int = 10, vec: str = "vec_id", embedding: str = "embedding", scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query row its k best other rows (all, if there are fewer).

    queries: SQL over `vec`, the id. Scores are inner products of the quantized vectors (see `quantized`) and must fit a
    long; a query meets vectors of its own length only. Ties go to the smaller vec_id. Repeated rows are rows of their own:
    each asks if it is a query, and finds the others. An empty table, or one without queries, gives no rows; other columns
    are ignored."""
    rows = stored(quantized(vectors, vec, embedding, scale), "quantized")
    dealt, shards = _dealt(rows)
    dealt = stored(dealt, "dealt")
    none = F.lit(None).cast("long")
    asks = dealt.filter(queries)
    found = stored(_searched(_cells(dealt, asks.withColumn("floor_score", none).withColumn("floor_vec", none)), k), "found")
    if not shards.filter("shards > 1").isEmpty():
        worst = found.groupBy(F.col("query_row").alias("row")).agg(F.count("*").alias("n"), F.max(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("w"))
        floors = worst.filter(F.col("n") >= k).select("row", (-F.col("w.s")).alias("floor_score"), F.col("w.vec_id").alias("floor_vec"))
        blocks = max(1, -(-asks.count() // BLOCK_ROWS))
        floored = stored(asks.join(floors, "row", "left").select("dim", F.col("shard").alias("home"), F.pmod(F.xxhash64(F.lit(4), "row"), F.lit(blocks)).cast("int").alias("block"), "row", "vec", "q", "floor_score", "floor_vec"), "floored")
        away = stored(_within_reach(floored, _boxes(dealt), shards), "away")
        found = found.unionByName(_searched(_cells(dealt, away), k))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
