"""Wearable exports: XML to records, workouts, activity summaries and characteristics.

`exports.scan` reads a file once, as tagged elements with their attributes as text; everything here is made from those rows.
Nothing is inferred, so a timestamp keeps its own offset and a number that isn't one stays text. Functions take the path
of an export or archive, or rows of `elements`, which several of them may share."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.constants import QUANTITY
from vitalspan.functions import exprs as X
from vitalspan.operators.writes import first_wins, last_wins
from vitalspan.sources import exports, streams
from vitalspan.sources.exports import ROOT, MalformedExport

RECORD_ATTRIBUTES = ("type", "sourceName", "sourceVersion", "device", "unit", "creationDate", "startDate", "endDate", "value")
WORKOUT_ATTRIBUTES = ("workoutActivityType", "duration", "durationUnit", "totalDistance", "totalDistanceUnit", "totalEnergyBurned", "totalEnergyBurnedUnit", "sourceName", "sourceVersion", "device", "creationDate", "startDate", "endDate")
STATISTIC_ATTRIBUTES = ("type", "startDate", "endDate", "average", "minimum", "maximum", "sum", "unit")
SUMMARY = {
    "dateComponents": "local_date", "activeEnergyBurned": "active_energy", "activeEnergyBurnedGoal": "active_energy_goal", "activeEnergyBurnedUnit": "active_energy_unit",
    "appleMoveTime": "move_time", "appleMoveTimeGoal": "move_time_goal", "appleExerciseTime": "exercise_time", "appleExerciseTimeGoal": "exercise_time_goal",
    "appleStandHours": "stand_hours", "appleStandHoursGoal": "stand_hours_goal",
}
INDOOR = "HKIndoorWorkout"


def check_root(spark: SparkSession, path: str) -> None:
    """The first 64 KB name the root element, whatever the size of the file, in an archive or not."""
    head = exports.member_head(path, 65536) if path.lower().endswith(".zip") else streams.end_of(spark, path, 65536)
    text = re.sub(r"<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^\[>]*(\[.*?\])?\s*>", "", head.decode("utf-8", "replace"), flags=re.DOTALL)
    found = re.search(r"<([A-Za-z][\w:.-]*)", text)
    if not found or found[1] != ROOT:
        raise MalformedExport(f"{path}: the root is {found[1] if found else 'unreadable'}, not {ROOT}")


def is_whole(spark: SparkSession, source: str | DataFrame) -> bool:
    """Whether the root element is closed: in the last 4 KB of a file, or among the elements."""
    if isinstance(source, str) and not source.lower().endswith(".zip"):
        return f"</{ROOT}>".encode() in streams.end_of(spark, source, 4096, tail=True)
    return not elements(spark, source).filter(F.col("tag") == f"/{ROOT}").isEmpty()


def elements(spark: SparkSession, source: str | DataFrame, folder: str | None = None) -> DataFrame:
    return exports.scan(spark, source, folder) if isinstance(source, str) else source


def _read(rows: DataFrame, tag: str, names, *more: str) -> DataFrame:
    """The elements of a tag, their attributes as columns."""
    return rows.filter(F.col("tag") == tag).select("seq", "nested", *[F.try_element_at("attributes", F.lit(a)).alias(f"_{a}") for a in names], *more)


def instant(text: Column | str) -> Column:
    """The usual format, or ISO; without an offset, UTC; else null."""
    t = F.col(text) if isinstance(text, str) else text
    usual = F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss Z"))
    zoned = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.when(t.rlike(r"([+-]\d{2}:?\d{2}|Z)$"), t).otherwise(F.concat(t, F.lit("Z"))))
    return F.coalesce(usual, F.try_to_timestamp(zoned))


def epoch(text: Column | str) -> Column:
    return F.unix_micros(instant(text)) / 1e6


def _times(rows: DataFrame) -> DataFrame:
    """A row without a usable start goes; without a usable end only the duration is unknown."""
    start, end = epoch("_startDate"), epoch("_endDate")
    return rows.withColumn("start_epoch", start).filter(F.col("start_epoch").isNotNull()).withColumn("duration_sec", end - F.col("start_epoch")).withColumn("local_date", F.substring("_startDate", 1, 10).try_cast("date"))


def _entries(column: str) -> Column:
    """Metadata as a map; entries without a key go, the last of repeated keys stays, and none at all is null."""
    keyed = F.filter(F.col(column), lambda e: e["key"].isNotNull())
    last = F.filter(keyed, lambda e, i: ~F.exists(F.slice(keyed, i + 2, F.size(keyed)), lambda x: x["key"] == e["key"]))
    return F.when(F.size(keyed) > 0, F.map_from_entries(last))


IDENTITY = ("_type", "_startDate", "_endDate", "_sourceName", "_value", "_unit")


def records(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """Records, once each: those within a correlation repeat what stands beside them and are left out, repeated ones share a
    key. The first in the file stays."""
    rows = _times(_read(elements(spark, source), "Record", RECORD_ATTRIBUTES, "metadata")).filter(F.col("_type").isNotNull() & ~F.col("nested"))
    raw = X.number("_value")
    value = F.when(~F.isnan(raw), raw)  # NaN is no value, and no text either
    out = rows.select(
        F.col("_type").alias("type"), value.alias("value_num"), F.when(raw.isNull(), F.col("_value")).alias("value_text"), F.col("_unit").alias("unit"),
        F.col("_sourceName").alias("source_name"), F.col("_sourceVersion").alias("source_version"), F.col("_device").alias("device"),
        F.col("_startDate").alias("start_date"), F.col("_endDate").alias("end_date"), F.col("_creationDate").alias("creation_date"),
        "start_epoch", "duration_sec", "local_date", _entries("metadata").alias("metadata"), X.identity(*IDENTITY).alias("dedup_key"), "seq",
    )
    return first_wins(out, ["dedup_key"], "seq")


def workout_rows(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    rows = _times(_read(elements(spark, source), "Workout", WORKOUT_ATTRIBUTES, "metadata", "statistics"))
    known = lambda s: F.map_filter(s, lambda k, v: k.isin(*STATISTIC_ATTRIBUTES))
    out = rows.withColumn("metadata", _entries("metadata")).select(
        F.col("_workoutActivityType").alias("activity_type"), X.number("_duration").alias("duration"), F.col("_durationUnit").alias("duration_unit"),
        X.number("_totalDistance").alias("total_distance"), F.col("_totalDistanceUnit").alias("total_distance_unit"),
        X.number("_totalEnergyBurned").alias("total_energy"), F.col("_totalEnergyBurnedUnit").alias("total_energy_unit"),
        F.col("_sourceName").alias("source_name"), F.col("_sourceVersion").alias("source_version"), F.col("_device").alias("device"),
        F.col("_startDate").alias("start_date"), F.col("_endDate").alias("end_date"), F.col("_creationDate").alias("creation_date"),
        "start_epoch", "local_date", "metadata", F.when(F.size("statistics") > 0, F.transform("statistics", known)).alias("statistics"),
        X.indoor_flag(F.try_element_at("metadata", F.lit(INDOOR))).alias("indoor"),
        X.identity("_workoutActivityType", "_startDate", "_endDate", "_sourceName", "_duration").alias("dedup_key"), "seq",
    )
    return first_wins(out, ["dedup_key"], "seq").withColumn("id", F.conv(F.substring(F.hex("dedup_key"), 1, 15), 16, 10).cast("long"))


def activity_summaries(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """The rings of each day; the last of repeated days stays."""
    rows = _read(elements(spark, source), "ActivitySummary", SUMMARY)
    text = {"local_date", "active_energy_unit"}
    out = rows.select(*[(F.col(f"_{a}") if c in text else X.number(f"_{a}")).alias(c) for a, c in SUMMARY.items()], "seq")
    return last_wins(out.filter(F.col("local_date").isNotNull()), ["local_date"], "seq").drop("seq")


def characteristics(spark: SparkSession, source: str | DataFrame, names: tuple[str, ...] = ("DateOfBirth", "BiologicalSex", "BloodType", "FitzpatrickSkinType", "CardioFitnessMedicationsUse")) -> DataFrame:
    """key, value of the person; the last of repeated ones stays."""
    attributes = [f"HKCharacteristicTypeIdentifier{n}" for n in names]
    rows = _read(elements(spark, source), "Me", attributes)
    pairs = F.array(*[F.struct(F.lit(a).alias("key"), F.col(f"_{a}").alias("value")) for a in attributes])
    out = rows.select(F.explode(pairs).alias("p"), "seq").select("p.*", "seq").filter(F.col("value").isNotNull())
    return last_wins(out, ["key"], "seq").drop("seq")


def ingest_counts(spark: SparkSession, source: str | DataFrame) -> DataFrame:
    """One row of counts, never content: records read (those within correlations aren't), unusable, stored, numbers, nested, duplicate."""
    rows = _read(elements(spark, source), "Record", RECORD_ATTRIBUTES)
    usable = epoch("_startDate").isNotNull() & F.col("_type").isNotNull()
    value, beside = X.number("_value"), ~F.col("nested")
    keyed = rows.select(usable.alias("usable"), "nested", F.when(usable & beside, X.identity(*IDENTITY)).alias("key"), (value.isNotNull() & ~F.isnan(value)).alias("numeric"))
    every = keyed.groupBy("key").agg(F.count_if(~F.col("nested")).alias("read"), F.count_if(~F.col("nested") & ~F.col("usable")).alias("unusable"), F.count_if(F.col("nested") & F.col("usable")).alias("nested"), F.bool_or("numeric").alias("numeric"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("read", "unusable", "nested")]
    out = every.agg(*sums, F.count("key").alias("stored"), F.count_if(F.col("key").isNotNull() & F.col("numeric")).alias("numeric"))
    return out.select("read", "unusable", "stored", "numeric", "nested", (F.col("read") - F.col("unusable") - F.col("stored")).alias("duplicate"))


def is_quantity() -> Column:
    return F.col("type").startswith(QUANTITY)
