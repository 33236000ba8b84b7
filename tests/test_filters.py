"""Filters of keys: no key lost, folders skipped, and the way without filters."""

import json

from pyspark.sql import functions as F

from vitalspan.catalog import Catalog
from vitalspan.operators import filters


def keyed(spark, start, end, seq=0):
    """Records with the keys of these numbers; columns as in the table."""
    at = F.col("id").cast("string")
    return spark.range(start, end).select(F.lit("t").alias("type"), F.col("id").cast("double").alias("value_num"), F.lit("2026-01-01").cast("date").alias("local_date"), F.unhex(F.sha2(at, 256)).alias("dedup_key"), (F.col("id") + seq).alias("seq"))


def numbers(df):
    return sorted(int(r[0]) for r in df.select("value_num").collect())


def test_held_keys_pass_and_few_others(spark, tmp_path):
    blocks = filters.blocks_for(20_000)
    assert (filters.blocks_for(0), filters.blocks_for(1024), filters.blocks_for(1025), blocks) == (1, 1, 2, 32)
    made = filters.built(keyed(spark, 0, 20_000), "dedup_key", blocks).withColumn("folder", F.lit("f"))
    made.write.parquet(str(tmp_path / "f"))
    held = spark.read.parquet(str(tmp_path / "f"))
    assert held.count() == blocks and {len(r[0]) for r in held.select("bits").collect()} == {4096}
    assert filters.passing(keyed(spark, 0, 20_000), "dedup_key", held, blocks).count() == 20_000
    assert filters.passing(keyed(spark, 20_000, 220_000), "dedup_key", held, blocks).count() <= 5


def test_folders_skipped_and_no_key_lost(spark, tmp_path):
    c = Catalog.open(spark, str(tmp_path), create=True)
    for i in range(5):  # sizes with several numbers of blocks
        c.append("record", c.unheld("record", keyed(spark, 10_000 * i, 10_000 * i + 600 * 2**i), "seq"))
    folders = c._state()["tables"]["record"]
    assert len({c._state()["filters"][f]["blocks"] for f in folders}) > 2
    assert c.may_hold("record", keyed(spark, 90_000, 90_100)) == []
    assert c.may_hold("record", keyed(spark, 10_500, 10_510)) == [folders[1]]
    mixed = keyed(spark, 0, 300).unionByName(keyed(spark, 30_000, 30_300)).unionByName(keyed(spark, 70_000, 70_050))
    assert c.may_hold("record", mixed) == [folders[0], folders[3]]
    # The first of a key in the order given, once; what is held isn't added.
    twice = mixed.unionByName(keyed(spark, 70_000, 70_050, seq=-1).withColumn("value_num", F.col("value_num") + 0.5))
    got = c.unheld("record", twice, "seq")
    assert got.count() == 50 and {r[0] % 1 for r in got.select("value_num").collect()} == {0.5}
    assert c.unheld("record", c.table("record"), "seq").isEmpty()
    # Rows that are gone are no longer held, whatever the filter says; a folder that is compacted has a new filter.
    c.delete("record", F.col("value_num") < 100)
    assert numbers(c.unheld("record", keyed(spark, 0, 300), "seq")) == list(range(100))
    c.compact("record", share=0.01)
    assert numbers(c.unheld("record", keyed(spark, 0, 300), "seq")) == list(range(100))
    state = c._state()
    assert set(state["filters"]) == set(state["tables"]["record"])


def test_null_keys_empty_tables_and_folders_without_a_filter(spark, tmp_path):
    c = Catalog.open(spark, str(tmp_path), create=True)
    none = keyed(spark, 0, 3).withColumn("dedup_key", F.lit(None).cast("binary"))
    assert c.may_hold("record", none) == []
    assert c.append("record", c.unheld("record", none, "seq")).count() == 1  # null is one key
    assert c.unheld("record", none, "seq").isEmpty() and c.unheld("record", none.limit(0), "seq").isEmpty()
    c.append("record", none.limit(0))
    c.append("record", keyed(spark, 0, 10))
    # As an index of the layout before has it: folders without filters are read.
    state = c._state()
    c._save({k: v for k, v in state.items() if k != "filters"})
    assert len(c.may_hold("record", keyed(spark, 50, 60))) == 3
    assert numbers(c.unheld("record", keyed(spark, 5, 15), "seq")) == list(range(10, 15))
    c.append("record", c.unheld("record", keyed(spark, 5, 15), "seq"))
    assert len(c._state()["filters"]) == 1 and c.table("record").count() == 16


def test_filters_go_with_their_folders(spark, tmp_path):
    c = Catalog.open(spark, str(tmp_path), create=True)
    c.append("record", keyed(spark, 0, 10))
    try:
        with c.transaction():
            c.append("record", keyed(spark, 10, 20))
            raise OSError
    except OSError:
        pass
    assert len(list(tmp_path.glob("filter-*"))) == 1
    for _ in range(3):
        c.write("record", c.table("record"))
    named = {x["at"] for p in tmp_path.glob("catalog-*.json") for x in json.loads(p.read_text())["filters"].values()}
    assert {p.name for p in tmp_path.glob("filter-*")} == named and len(named) == 2
