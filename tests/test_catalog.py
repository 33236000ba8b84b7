"""Deletes without rewriting, folders by date, and what a batch reads."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from vitalspan.catalog import Catalog
from vitalspan.operators import series
from vitalspan.streaming import records as stream


def files(tmp_path, name):
    return {f.name: f.stat().st_mtime_ns for d in tmp_path.glob(f"{name}-*") for f in d.glob("*.parquet")}


def test_deleting_one_of_a_million_rewrites_nothing(spark, tmp_path):
    c = Catalog.open(spark, str(tmp_path), create=True)
    rows = spark.range(1_000_000).select(F.col("id"), F.col("id").alias("document_id"), F.lit("x").alias("text"))
    c.append("chunk", rows.repartition(4))
    before = files(tmp_path, "chunk")
    assert c.delete("chunk", F.col("id") == 777_777) == 1 and c.delete("chunk", F.col("id") == 777_777) == 0
    assert files(tmp_path, "chunk") == before
    assert c.table("chunk").count() == 999_999 and c.table("chunk").filter("id BETWEEN 777776 AND 777778").count() == 2
    gone = spark.createDataFrame([(i,) for i in (0, 32_767, 32_768, 999_999, 5_000_000)], "id long")
    assert c.delete("chunk", gone, ["id"]) == 4 and c.table("chunk").filter("id IN (0, 32767, 32768, 999999)").isEmpty()
    assert sum(f.stat().st_size for f in tmp_path.glob("deleted-*/*.parquet")) < 1_000_000
    assert c.compact("chunk") == [] and files(tmp_path, "chunk") == before
    c.delete("chunk", F.col("id") % 2 == 0)
    assert len(c.compact("chunk")) == 1 and c._state()["deleted"]["chunk"] == []
    assert c.table("chunk").count() == 499_997 and c.table("chunk").filter("id % 2 = 0").isEmpty()


def test_replace_reads_the_table_it_changes(spark, tmp_path):
    c = Catalog.open(spark, str(tmp_path), create=True)
    make = lambda *rows: spark.createDataFrame(list(rows), "key string, value string")
    c.replace("characteristic", make(("a", "1"), ("b", "1"), (None, "1")), ["key"])
    c.replace("characteristic", c.table("characteristic").filter("key = 'a' OR key IS NULL").withColumn("value", F.concat("value", F.lit("+"))), ["key"])
    assert {tuple(r) for r in c.table("characteristic").collect()} == {("a", "1+"), ("b", "1"), (None, "1+")}
    c.replace("characteristic", make(("c", "2")), ["key"], among=make(("b", ""), ("a", "")))
    assert {tuple(r) for r in c.table("characteristic").collect()} == {("c", "2"), (None, "1+")}
    # A transaction that fails leaves no vector behind.
    try:
        with c.transaction():
            c.delete("characteristic", F.col("key") == "c")
            assert c.table("characteristic").count() == 1
            raise OSError
    except OSError:
        pass
    assert c.table("characteristic").count() == 2
    # Many small replacements are compacted in the end.
    c.FOLDERS = 4
    for i in range(12):
        c.replace("characteristic", make(("k", str(i))), ["key"])
    state = c._state()
    assert c.table("characteristic").filter("key = 'k'").first()["value"] == "11" and c.table("characteristic").count() == 3
    assert len(state["tables"]["characteristic"]) <= 5 and len(state["deleted"].get("characteristic", [])) <= 5


def day_of_records(spark, day, n=5, kind="t"):
    at = str(day)
    return spark.range(n).select(F.lit(kind).alias("type"), F.col("id").cast("double").alias("value_num"), F.lit(at).cast("date").alias("local_date"), F.lit("w").alias("source_name"), F.unhex(F.sha2(F.concat_ws("/", F.lit(at), "id", F.lit(kind)), 256)).alias("dedup_key"), F.col("id").alias("seq"))


def test_a_batch_reads_only_folders_of_its_days(spark, tmp_path):
    c = Catalog.open(spark, str(tmp_path), create=True)
    wide = lambda df: df.select(*[F.col(x) if x in df.columns else F.lit(None).cast(t).alias(x) for x, t in c.table("record").dtypes])
    for i in range(6):
        assert stream.absorb(c, wide(day_of_records(spark, date(2026, 1, 1) + timedelta(days=i)))) == 5
    read = c.table("record", [date(2026, 1, 3)])
    assert len({f.rsplit("/", 2)[1] for f in read.inputFiles()}) == 1 and read.count() == 5
    assert len(c.table("daily_metric", [date(2026, 1, 3)]).inputFiles()) <= 2
    # Late rows of an old day, some of them known; rows without a date.
    late = day_of_records(spark, date(2026, 1, 2), 8).unionByName(day_of_records(spark, date(2026, 1, 2), 3, "u"))
    assert stream.absorb(c, wide(late)) == 6 and stream.absorb(c, wide(late)) == 0
    dateless = wide(day_of_records(spark, date(2026, 1, 2), 4, "v").withColumn("local_date", F.lit(None).cast("date")))
    assert stream.absorb(c, dateless) == 4 and stream.absorb(c, dateless) == 0
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(c.table("daily_metric")) == key(series.daily_rollup(c.table("record")))
    assert c.table("record").count() == 40
