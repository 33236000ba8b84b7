"""What an index holds of a figure that a window lacks, and how deep a side's measure was sampled.

All of it is aggregated by Spark to one row; lists have the TOP entries with the most workouts, ties by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.constants import find_metric
from vitalspan.functions import exprs as X
from vitalspan.operators import workouts
from vitalspan.operators.windows import Spec

TOP = 6


def _top(counts: DataFrame, name: str, column: str) -> DataFrame:
    """One row: the names with the most workouts as an array of (workouts, name)."""
    first = counts.orderBy(F.desc("workouts"), name).limit(TOP)
    entry = F.struct((-F.col("workouts")).alias("w"), F.col(name).alias("name"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["name"].alias("name"), (-e["w"]).alias("workouts")))
    return first.agg(listed.alias(column))


def held(spec: Spec, rollup: DataFrame | None = None, workout: DataFrame | None = None, stat: DataFrame | None = None) -> DataFrame:
    """One row, over all dates and devices, whatever the spec leaves out of them.

    A metric: total (its records), first, last. Workouts: total, first, last of all; activity_n, activity_first, activity_last and
    alike (the activities whose name contains the one asked for); activities; timed (workouts with a duration); measure_n,
    measure_first, measure_last (workouts with a number for the measure) and measures (those that have numbers).
    Counts are 0 and dates null where there is nothing."""
    day = lambda c: c.cast("string")
    if spec.metric:
        found = rollup.filter(F.col("type") == find_metric(spec.metric).identifier)
        return found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), day(F.min("local_date")).alias("first"), day(F.max("local_date")).alias("last"))
    like = F.col("activity_type").ilike(f"%{spec.activity}%") if spec.activity else F.lit(True)
    of = lambda c: F.when(like, c)
    out = workout.agg(
        F.count("*").alias("total"), day(F.min("local_date")).alias("first"), day(F.max("local_date")).alias("last"),
        F.count_if(like).alias("activity_n"), day(F.min(of(F.col("local_date")))).alias("activity_first"), day(F.max(of(F.col("local_date")))).alias("activity_last"),
        F.count_if(like & X.seconds("duration", "duration_unit").isNotNull()).alias("timed"),
    )
    named = workout.filter(F.col("activity_type").isNotNull()).groupBy("activity_type", like.alias("like")).agg(F.count("*").alias("workouts"))
    parts = [_top(named, "activity_type", "activities"), _top(named.filter("like"), "activity_type", "alike")]
    key = spec.measure or (workouts.HEART_RATE if spec.derive == "efficiency" else None)
    if key:
        numeric = stat.filter(F.col("value_num").isNotNull()).join(workout.select(F.col("id").alias("workout_id"), "local_date"), "workout_id")
        parts.append(numeric.filter(F.col("key") == key).agg(F.countDistinct("workout_id").alias("measure_n"), day(F.min("local_date")).alias("measure_first"), day(F.max("local_date")).alias("measure_last")))
        parts.append(_top(numeric.groupBy("key").agg(F.countDistinct("workout_id").alias("workouts")), "key", "measures"))
    for part in parts:
        out = out.join(F.broadcast(part))  # one row each
    return out


def depth(spec: Spec, span: tuple[str, str], workout: DataFrame, record: DataFrame) -> DataFrame:
    """One row: how many records of the measure's type a side's workouts have within them: type, counted (workouts with a count),
    uncounted (without a usable duration) and median. Only for a measure that is a statistic of a type of record."""
    key = spec.measure or (workouts.HEART_RATE if spec.derive == "efficiency" else None)
    if not key or ":" not in key:
        raise ValueError("there is no type of record to count")
    kind = key.split(":")[0]
    chosen = workouts.select_workouts(workout, activity=spec.activity, start=span[0], end=span[1], indoor=spec.indoor, exclude=spec.exclude)
    counts = workouts.sample_depth(chosen, record, [kind])
    return counts.agg(F.lit(kind).alias("type"), F.count("count").alias("counted"), F.count_if(F.col("count").isNull()).alias("uncounted"), F.median("count").alias("median"))
