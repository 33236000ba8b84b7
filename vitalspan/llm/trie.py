"""Prefix trie of conversations by prefix-doubling naming.

A name stands for equal things. Turns are named by the digest of role and text. An aligned block of 2^(k+1) turns is named by
the digest of the names of its two halves. A prefix of d turns falls into blocks by the binary digits of d, largest first; its
name is made from the name of the prefix without the last of them and the name of that block. As digests, names need no
lookup: within a run of RUN turns doubling takes place in one row. Runs of a longer conversation are named like turns, by the
same step again, so there are as many rounds as the longest conversation's length has digits to the base RUN. Nodes are the groups
of equal (depth, name).

What a node sums over its subtree comes from its members' own turns, without a walk down the trie: a conversation's turn is
stored for the first time where it is its node's smallest conversation, which holds from some depth on to its end, and all
its turns before are saved; a childless node is counted by its smallest conversation.

A name belongs to two texts only if they are equal but for a collision of SHA-256. Texts are read once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import looked_up, numbered, partitions, pieces, stored

#: Conversations whose ids share all but the last two digits begin with turns of the first of them: fewer than SHARED of them.
FAMILY, SHARED = 100, 6
#: Turns (or runs, and so on) that are named in one row.
RUN = 64
#: Characters of a piece of a list of ids.
PIECE = 1 << 20
#: The name of the prefix without a turn.
ROOT = b""


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes over: the CRC-32 of its decimal id, modulo SHARED."""
    return (F.crc32(conv.cast("string").cast("binary")) % SHARED).cast("int")


def ordered_turns(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(conv, at, name, size), where at numbers all turns in the order of conversation and turn (null first, ties by digest),
    and (conv, first, n): the first number of each conversation and its turns.

    The order is global, by ranges, so a conversation of any length may span tasks."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(by).cast("string"), F.lit(":"), by, said), 256))
    turns = conversations.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), digest.alias("name"), F.length(said).cast("long").alias("size"))
    order = ["conv", F.asc_nulls_first("turn"), "name"]
    ranged = turns.repartitionByRange(partitions(conversations.sparkSession), *order).sortWithinPartitions(*order)
    rows = numbered(ranged.select("conv", "name", "size"), "turns", "at")
    return rows, stored(rows.groupBy("conv").agg(F.min("at").alias("first"), F.count("*").alias("n")), "conversations")


def rebuilt(turns: DataFrame, firsts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the turns they take over, as (conv, j, name, size, deep), deep being the turns of all the conversation,
    and (conv, deep) of every conversation.

    The first h turns come from the first conversation of the family, as far as it has them; from its own turns a
    conversation loses as many as h. At most SHARED - 1 turns of a conversation are gathered in one row. Joins are by
    conversation with one row of it, and an exchange follows, so that Spark may split a long one."""
    n = partitions(turns.sparkSession)
    i = F.col("at") - F.col("first")
    base = turns.filter(F.col("conv") % FAMILY == 0).join(firsts, "conv").filter(i < SHARED - 1).select(F.col("conv").alias("base"), F.struct(i.alias("j"), "name", "size").alias("t"))
    base = base.repartition(n, "base").groupBy("base").agg(F.sort_array(F.collect_list("t")).alias("begin"))
    known = firsts.withColumn("base", F.col("conv") - F.col("conv") % FAMILY).withColumn("h", shared_turns(F.col("conv"))).join(base, "base", "left")
    known = known.withColumn("begin", F.slice(F.coalesce("begin", F.array().cast("array<struct<j:bigint,name:binary,size:bigint>>")), F.lit(1), F.col("h")))
    known = known.withColumn("taken", F.size("begin").cast("long"))
    known = stored(known.select("conv", "first", "h", "taken", "begin", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("deep")), "families")
    begin = known.select("conv", "deep", F.inline("begin")).select("conv", "j", "name", "size", "deep")
    own = turns.join(known.select("conv", "first", "h", "taken", "deep"), "conv").filter(i >= F.col("h"))
    return begin.unionByName(own.select("conv", (F.col("taken") + i - F.col("h")).alias("j"), "name", "size", "deep")), known.select("conv", "deep")


def prefix_names_of(names: list[bytes]) -> list[bytes]:
    """The names of all prefixes of these names: aligned blocks by doubling, then a prefix from the one without its last block."""
    blocks = [names]
    while len(blocks[-1]) > 1:
        last = blocks[-1]
        blocks.append([hashlib.sha256(last[i] + last[i + 1]).digest() for i in range(0, len(last) - 1, 2)])
    found: list[bytes] = []
    for d in range(1, len(names) + 1):
        low = d & -d
        block = blocks[low.bit_length() - 1][d // low - 1]
        found.append(block if d == low else hashlib.sha256(found[d - low - 1] + block).digest())
    return found


PREFIX = "conv long, deep long, depth long, name binary, up_name binary, before long, size long"


def prefix_names(turns: DataFrame, longest: int) -> DataFrame:
    """turns: conv, j, name, size, deep. (conv, deep, depth, name, up_name, before, size) of every prefix of every conversation
    with a turn: the name of the prefix without its last turn (null for none), the sizes of the turns before that, and its own.
    A run of RUN turns at most is gathered in one row."""

    def named(part: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for conv, deep, run in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
            before, up = 0, None
            for t, name in zip(run, prefix_names_of([t["name"] for t in run]), strict=True):
                out.append((conv, deep, t["j"] + 1, name, up, before, t["size"]))
                before, up = before + t["size"], name
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in PREFIX.split(", ")])

    runs = turns.withColumn("run", F.expr(f"j div {RUN}")).repartition(partitions(turns.sparkSession), "conv", "run").groupBy("conv", "run").agg(F.max("deep").alias("deep"), F.sort_array(F.collect_list(F.struct("j", "name", "size"))).alias("turns"))
    within = stored(runs.select("conv", "deep", "turns").mapInArrow(lambda batches: pieces(batches, named), PREFIX), "runs")
    if longest <= RUN:
        return within
    # Of longer conversations, runs are the turns of the round above: what it calls a run's prefix and the prefix before it hold here.
    long, last = within.filter(F.col("deep") > RUN), F.col("depth") % RUN == 0
    of = F.expr(f"(depth - 1) div {RUN}")
    heads = long.filter(last | (F.col("depth") == F.col("deep"))).select("conv", of.alias("j"), "name", (F.col("before") + F.col("size")).alias("size"), F.expr(f"(deep + {RUN - 1}) div {RUN}").alias("deep"))
    above = prefix_names(heads, -(-longest // RUN)).select("conv", (F.col("depth") - 1).alias("run"), F.col("name").alias("through"), F.col("up_name").alias("ahead"), F.col("before").alias("start"))
    after = lambda name: F.when(F.col("ahead").isNull(), name).otherwise(F.unhex(F.sha2(F.concat("ahead", name), 256)))
    both = long.withColumn("run", of).join(above, ["conv", "run"])
    name = F.when(last, F.col("through")).otherwise(after(F.col("name")))
    up = F.when(F.col("up_name").isNull(), F.col("ahead")).otherwise(after(F.col("up_name")))
    both = both.select("conv", "deep", "depth", name.alias("name"), up.alias("up_name"), (F.col("start") + F.col("before")).alias("before"), "size")
    return within.filter(F.col("deep") <= RUN).unionByName(stored(both, "prefixes"))


def ends_digest(ends: DataFrame) -> DataFrame:
    """ends: depth, name, conv. (depth, name, ends_sha256) of each node at which a conversation ends: SHA-256 of its decimal ids
    in ascending order, joined by commas. Ids are joined to pieces by ranges first, and a node's pieces pass in order
    through one running hash: nothing grows with a node but the time."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"depth": [node[0]], "name": [node[1]], "first": [first], "piece": [",".join(held)]}, pa.schema([("depth", pa.int64()), ("name", pa.binary()), ("first", pa.int64()), ("piece", pa.string())]))

        made = []
        for batch in batches:
            for depth, name, conv in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (depth, name) != node or size > PIECE:
                    if held:
                        made.append(piece())
                    node, first, held, size = (depth, name), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield from _merged(made)
            made = []
        if held:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True))
        out = []
        for node, group in groupby(rows, lambda r: r[:2]):
            running = hashlib.sha256(next(group)[2].encode())
            for r in group:
                running.update(b"," + r[2].encode())
            out.append((*node, running.hexdigest()))
            if len(out) == 1000:
                yield _digests(out)
                out = []
        if out:
            yield _digests(out)

    n = partitions(ends.sparkSession)
    ranged = ends.repartitionByRange(n, "depth", "name", "conv").sortWithinPartitions("depth", "name", "conv")
    cut = ranged.select("depth", "name", "conv").mapInArrow(joined, "depth long, name binary, first long, piece string")
    return cut.repartition(n, "depth", "name").sortWithinPartitions("depth", "name", "first").mapInArrow(digest, "depth long, name binary, ends_sha256 string")


def _merged(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    depth, name, digest = zip(*rows, strict=True)
    return pa.RecordBatch.from_pydict({"depth": pa.array(depth, pa.int64()), "name": pa.array(name, pa.binary()), "ends_sha256": pa.array(digest, pa.string())})


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each distinct beginning of the rebuilt conversations (see `rebuilt`), from the root without a turn on.

    conv_id: its smallest conversation; depth; parent_conv_id: the parent's conv_id (null at the root); n_convs; n_children;
    n_leaves: childless nodes of its subtree, itself included; saved_tokens: code points of last turns that its subtree stores
    once instead of n_convs times; ends_sha256: of the ids of the conversations that end here.

    Null roles and texts count as empty; rows without a conversation belong to none; turns that share a number follow the
    digest of role and text, a null number comes first; repeated rows are turns of their own. Texts of any length are read
    whole. An empty table gives no rows. Other columns are ignored."""
    spark = conversations.sparkSession
    whole, depths = rebuilt(*ordered_turns(conversations, conv, turn, role, text))
    longest, smallest, total = depths.agg(F.max("deep"), F.min("conv"), F.count("*")).first()
    prefixes = prefix_names(whole, longest or 0).withColumn("up_name", F.coalesce("up_name", F.lit(ROOT)))

    root = spark.createDataFrame([(0, ROOT, smallest, total, 0, None)] if total else [], "depth long, name binary, conv long, n long, size long, up_name binary")
    nodes = prefixes.groupBy("depth", "name").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("size").alias("size"), F.max("up_name").alias("up_name"))
    nodes = stored(nodes.unionByName(root), "nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_name").alias("name")).agg(F.count("*").alias("n_children"))
    own = stored(nodes.join(children, ["depth", "name"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "linked")

    # Of each conversation: the childless node that it stands for, if any, and what its turns before its own nodes hold.
    stands = own.filter("depth > 0").select("conv", (F.col("n_children") == 0).cast("long").alias("leaf"), (-F.col("size")).alias("shared"))
    stands = stands.unionByName(prefixes.filter("depth = deep").select("conv", F.lit(0).cast("long").alias("leaf"), (F.col("before") + F.col("size")).alias("shared")))
    stands = stored(stands.groupBy("conv").agg(F.sum("leaf").alias("leaf"), F.sum("shared").alias("shared")), "stands")
    below = prefixes.join(stands, "conv").select("depth", "name", "leaf", F.greatest(F.col("shared") - F.col("before"), F.lit(0)).alias("saved"))
    below = below.unionByName(stands.select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"), "leaf", F.col("shared").alias("saved")))
    sums = below.groupBy("depth", "name").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))

    parents = own.select((F.col("depth") + 1).alias("depth"), F.col("name").alias("up_name"), F.col("conv").alias("parent_conv_id"), "n_children")
    with_parent = looked_up(own.filter("depth > 0"), parents, ["depth", "up_name"], "n_children", own.count())
    out = with_parent.unionByName(own.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    ending = prefixes.filter("depth = deep").select("depth", "name", "conv").unionByName(depths.filter("deep = 0").select(F.col("deep").alias("depth"), F.lit(ROOT).alias("name"), "conv"))
    out = out.join(sums, ["depth", "name"], "left").join(ends_digest(ending), ["depth", "name"], "left")
    # Without any turn the root is the only node, and childless.
    leaves, saved = F.coalesce("leaves", F.lit(1)), F.coalesce("saved", F.lit(0))
    return out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", leaves.cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
