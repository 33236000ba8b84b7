"""Optional incremental ingest: a stream of record files into the record table and its rollup.

A batch is deduplicated against what is held by an anti-join, and only the (type, date) pairs that it touches are rolled
up again, so late data for old days is as good as any: the tables are what one batch over all files would have made. Both
read only the folders that may have dates of the batch, the first only those whose Bloom filter passes one of its keys, and rows of the rollup are replaced without rewriting others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalspan.catalog import Catalog
from vitalspan.operators import series


def absorb(catalog: Catalog, batch: DataFrame) -> int:
    """New rows of a batch, added once; running it again with the same batch adds nothing.

    Records and rollup become visible in one step, so a batch that fails in between leaves neither and is absorbed whole
    when it comes again."""
    # A key names its start, and so its date: only folders with dates of the batch can hold it, or have to be rolled up again.
    days = [r[0] for r in batch.select("local_date").distinct().collect()]
    with catalog.transaction():
        added = catalog.append("record", catalog.unheld("record", batch.select(*catalog.table("record").columns), "seq", days))
        n = added.count()
        if n:
            changed = added.select("type", "local_date").distinct()
            catalog.replace("daily_metric", series.rollup_of(catalog.table("record", days), changed), ["type", "local_date"], changed)
    return n


def record_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(folder)


def ingest_stream(catalog: Catalog, stream: DataFrame, checkpoint: str, once: bool = True, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Start absorbing; with `once`, stop when everything there is has been read."""

    def batch(df: DataFrame, number: int) -> None:
        absorb(catalog, df)
        if after:
            after(number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def live_counts(stream: DataFrame, delay: str = "1 day", window: str = "1 hour") -> DataFrame:
    """Records, and their sum, by type and window of event time, as windows close; later rows than `delay` are left to the batch."""
    timed = stream.withColumn("at", F.timestamp_micros((F.col("start_epoch") * 1e6).cast("long"))).withWatermark("at", delay)
    return timed.groupBy(F.window("at", window), "type").agg(F.count("*").alias("n"), F.sum("value_num").alias("sum_value"))
