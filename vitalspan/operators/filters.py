"""Blocked Bloom filters of keys, kept as tables: which folders may hold a key, without reading them.

A filter is a row a block: its number, and a bitmap of 32,768 bits. A key belongs to one block and sets PROBES bits of it.
A filter has a power of two of blocks, with KEYS keys each at most on average, so it takes 4 to 8 bytes a key and one foreign key
in 150,000 or fewer passes it. A key that is held always passes. Null is a key like others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block are those of a bitmap of bitmap_construct_agg.
BITS, KEYS, PROBES = 32_768, 1024, 8
FILTER = "block long, bits binary"


def blocks_for(keys: int) -> int:
    """How many blocks a filter of so many keys has."""
    blocks = 1
    while blocks * KEYS < keys:
        blocks *= 2
    return blocks


def bit_is_set(bits: Column, position: Column) -> Column:
    """Of a bitmap of bitmap_construct_agg."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def block_of(key: str | Column, blocks: int) -> Column:
    return F.xxhash64(F.lit(1), key).bitwiseAND(F.lit(blocks - 1).cast("long"))


def _position(mark: Column, probe: int) -> Column:
    """The place of a probe: a start, and an odd step, of a key's mark."""
    step = F.shiftright(mark, 15).bitwiseAND(F.lit(BITS - 1).cast("long")).bitwiseOR(F.lit(1).cast("long"))
    return (mark.bitwiseAND(F.lit(BITS - 1).cast("long")) + step * F.lit(probe)).bitwiseAND(F.lit(BITS - 1).cast("long"))


def mark_of(key: str | Column) -> Column:
    return F.xxhash64(F.lit(2), key)


def built(rows: DataFrame, key: str, blocks: int) -> DataFrame:
    """The filter of the keys of rows. Marks of eight bytes are shuffled to their block, bitmaps aren't."""
    placed = rows.select(block_of(key, blocks).alias("block"), mark_of(key).alias("m")).repartition("block")
    bit = placed.select("block", F.explode(F.array(*[_position(F.col("m"), i) for i in range(PROBES)])).alias("bit"))
    return bit.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))


def passing(keys: DataFrame, key: str, filters: DataFrame, blocks: int) -> DataFrame:
    """folder of each (key, filter) that passes. filters: folder, block, bits; all of them with that number of blocks, so that
    a key is shuffled once to all filters of a size."""
    asked = keys.select(block_of(key, blocks).alias("_b"), mark_of(key).alias("_m"))
    probe = F.col("_b") == F.col("block")
    for i in range(PROBES):
        probe = probe & bit_is_set(F.col("bits"), _position(F.col("_m"), i))
    return filters.join(asked, probe).select("folder")
