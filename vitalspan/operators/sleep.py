"""Sleep by night: noon to noon, and one device's figures wholesale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.constants import SLEEP_TYPE, SLEEP_VALUE
from vitalspan.functions.exprs import between, night_of

UNNAMED = "unnamed source"


def sleep_nights(record: DataFrame, start: str | None = None, end: str | None = None, sleep_type: str = SLEEP_TYPE, prefix: str = SLEEP_VALUE) -> DataFrame:
    """night, source, asleep_seconds, in_bed_seconds, stages (map), first_start, last_end, sources, multi_source, per_source.

    The device with the most sleep, then time in bed, then the last name, gives all figures of a night: stages taken one
    by one from several devices would describe a night that none recorded. Dates filter nights, not segments."""
    rows = record.filter(F.col("type") == sleep_type).withColumn("night", night_of("start_date", "local_date")).filter(between("night", start, end))
    source = F.coalesce(F.nullif("source_name", F.lit("")), F.lit(UNNAMED))
    stage = F.coalesce(F.nullif("value_text", F.lit("")), F.lit("Unknown"))
    # A stage may come with and without its prefix: one entry of the map, but only prefixed ones count as sleep.
    by_stage = rows.groupBy("night", source.alias("source"), F.replace(stage, F.lit(prefix), F.lit("")).alias("k")).agg(
        F.coalesce(F.sum(F.when(stage.startswith(prefix), F.col("duration_sec"))), F.lit(0.0)).alias("known"),
        F.coalesce(F.sum("duration_sec"), F.lit(0.0)).alias("seconds"), F.min("start_date").alias("first_start"), F.max("end_date").alias("last_end")
    )
    by_source = by_stage.groupBy("night", "source").agg(
        F.coalesce(F.sum(F.when(F.col("k").startswith("Asleep"), F.col("known"))), F.lit(0.0)).alias("asleep_seconds"),
        F.coalesce(F.sum(F.when(F.col("k") == "InBed", F.col("known"))), F.lit(0.0)).alias("in_bed_seconds"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "seconds")))).alias("stages"),
        F.min("first_start").alias("first_start"),
        F.max("last_end").alias("last_end"),
    )
    figures = F.struct("source", "asleep_seconds", "in_bed_seconds", "stages", "first_start", "last_end")
    return (
        by_source.groupBy("night")
        .agg(
            F.max_by(figures, F.struct("asleep_seconds", "in_bed_seconds", "source")).alias("c"),
            F.array_sort(F.collect_set(F.when(F.col("source") != UNNAMED, F.col("source")))).alias("sources"),
            (F.count("*") > 1).alias("multi_source"),
            F.map_from_entries(F.collect_list(F.struct("source", F.struct("asleep_seconds", "in_bed_seconds", "stages")))).alias("per_source"),
        )
        .select("night", "c.*", "sources", "multi_source", "per_source")
    )


def sleep_coverage(record: DataFrame, sleep_type: str = SLEEP_TYPE) -> DataFrame:
    return record.filter(F.col("type") == sleep_type).agg(F.count("*").alias("n"), F.min("local_date").alias("first"), F.max("local_date").alias("last"))
