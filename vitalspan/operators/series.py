"""The daily rollup and what is read from it: period views, metric series, listings, coverage.

Sources are devices. They are never added up unless asked: a figure is the largest device's (sums, counts, durations),
the extreme over devices (min, max), or the mean over all samples (avg).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.constants import metric_of
from vitalspan.functions.exprs import UNLABELLED, between, period_bounds, period_label, sources

AGGREGATES = ("sum", "avg", "min", "max", "count", "duration")
UNKNOWN = "(unknown)"


def daily_rollup(record: DataFrame) -> DataFrame:
    """The grain (date, type, source, unit, category): one partially combined aggregation of the raw records."""
    return record.groupBy("local_date", "type", "source_name", "unit", F.col("value_text").alias("category")).agg(
        F.count("*").alias("n"),
        F.sum("value_num").alias("sum_value"),
        F.avg("value_num").alias("avg_value"),
        F.min("value_num").alias("min_value"),
        F.max("value_num").alias("max_value"),
        F.sum("duration_sec").alias("duration_sec"),
    )


def rollup_of(record: DataFrame, changed: DataFrame) -> DataFrame:
    """The rollup of the (type, local_date) pairs of `changed` alone, computed anew. Null dates are dates of their own."""
    touched = changed.select("type", "local_date").distinct().alias("t")
    same = (F.col("r.type") == F.col("t.type")) & F.col("r.local_date").eqNullSafe(F.col("t.local_date"))
    return daily_rollup(record.alias("r").join(touched, same, "left_semi"))


def refresh_rollup(rollup: DataFrame, record: DataFrame, changed: DataFrame) -> DataFrame:
    """The rollup with the (type, local_date) pairs of `changed` computed anew from the records and all others kept."""
    touched = changed.select("type", "local_date").distinct()
    return rollup.join(touched, ["type", "local_date"], "left_anti").unionByName(rollup_of(record, touched))


def period_view(rollup: DataFrame, period: str) -> DataFrame:
    """Weeks by their Monday or months: means weighted by records."""
    return rollup.groupBy(period_label("local_date", period).alias("period"), "type", "source_name", "unit", "category").agg(
        F.sum("n").alias("n"),
        F.sum("sum_value").alias("sum_value"),
        F.try_divide(F.sum(F.col("avg_value") * F.col("n")), F.sum("n")).alias("avg_value"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.sum("duration_sec").alias("duration_sec"),
        F.min("local_date").alias("period_start"),
        F.max("local_date").alias("period_end"),
    )


def _value(agg: str) -> Column:
    """What one source reports for a period."""
    return {"sum": F.col("s"), "count": F.col("n").cast("double"), "duration": F.col("d"), "min": F.col("lo"), "max": F.col("hi"), "avg": F.try_divide("s", F.col("n").cast("double"))}[agg]


def metric_series(
    rollup: DataFrame,
    metric: str,
    period: str = "day",
    agg: str | None = None,
    start: str | None = None,
    end: str | None = None,
    source: str | None = None,
    exclude: Sequence[str] = (),
    combine: str = "auto",
) -> DataFrame:
    """period, category, value, n, by_source (map), n_sources, multi_source, source and source_n (whose figure it is, null
    where it is of several), period_start, period_end, units and unit of the whole series.

    combine: auto (the largest source for sums, counts and durations), max, or sum. Ties between sources go to the name
    that sorts first. Category metrics have a row for each category; others merge stray categories into their counts."""
    m = metric_of(metric)
    agg = agg or m.default_agg
    if agg not in AGGREGATES or combine not in ("auto", "max", "sum"):
        raise ValueError(f"unknown aggregate or way to combine: {agg}, {combine}")
    rows = rollup.filter((F.col("type") == m.identifier) & between("local_date", start, end) & sources([source] if source else [], exclude))
    category = F.col("category") if m.kind == "category" else F.lit(None).cast("string")
    named = F.coalesce(F.nullif(F.col("source_name"), F.lit("")), F.lit(UNKNOWN))
    per_source = rows.groupBy(period_label("local_date", period).alias("period"), category.alias("category"), named.alias("src")).agg(
        F.sum("n").alias("n"),
        F.sum("sum_value").alias("s"),
        F.coalesce(F.sum("duration_sec"), F.lit(0.0)).alias("d"),
        F.min("min_value").alias("lo"),
        F.max("max_value").alias("hi"),
        F.min("local_date").alias("first"),
        F.array_sort(F.collect_set(F.coalesce("unit", F.lit(UNLABELLED)))).alias("units"),
    )
    per_source = per_source.withColumn("v", _value(agg))
    additive = agg in ("sum", "count", "duration")
    value = {"min": F.min("v"), "max": F.max("v"), "avg": F.try_divide(F.sum("s"), F.sum(F.when(F.col("s").isNotNull(), F.col("n"))).cast("double"))}.get(agg, F.sum("v") if combine == "sum" else F.max("v"))
    valued = F.col("v").isNotNull()
    # The extreme's source: the largest (or smallest) value first, then the name.
    signed = F.col("v") if agg == "min" else -F.col("v")
    best = F.min(F.when(valued, F.struct(signed.alias("o"), F.col("src"), F.col("n"))))
    only = F.min(F.struct("src", "n"))
    one = (F.count_if(valued) == 0) & (F.count("*") == 1)
    blended = F.lit(agg == "avg" or (additive and combine == "sum"))
    single = F.count_if(valued) == 1
    whose = F.when(one, only["src"]).when(single | ~blended, best["src"])
    points = per_source.groupBy("period", "category").agg(
        value.alias("value"),
        F.sum("n").alias("n"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("src", "v")))).alias("by_source"),
        F.count("*").alias("n_sources"),
        whose.alias("source"),
        F.when(one, only["n"]).when(single | ~blended, best["n"]).otherwise(F.sum("n")).alias("source_n"),
        F.min("first").alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("units")))).alias("units"),
    )
    lo, hi = period_bounds("first", period)
    out = points.withColumn("multi_source", F.col("n_sources") > 1).withColumn("period_start", lo).withColumn("period_end", hi).drop("first")
    seen = rows.agg(F.array_sort(F.collect_set(F.coalesce("unit", F.lit(UNLABELLED)))).alias("series_units"))
    unit = F.lit("s") if agg == "duration" else F.when(F.size("series_units") == 1, F.element_at("series_units", 1))
    return out.join(F.broadcast(seen)).withColumn("unit", unit)  # one row


def overall(points: DataFrame, agg: str) -> DataFrame:
    """The whole range in one figure: a sum, an extreme, or the mean weighted by the records behind each point."""
    weight = F.when(F.col("value").isNotNull(), F.col("source_n"))
    value = {"min": F.min("value"), "max": F.max("value"), "avg": F.try_divide(F.sum(F.col("value") * weight), F.sum(weight).cast("double"))}.get(agg, F.sum("value"))
    return points.agg(value.alias("value"), F.count("value").alias("periods"), F.sum("n").alias("n"))


def list_types(rollup: DataFrame, search: str | None = None, limit: int | None = None) -> DataFrame:
    rows = rollup.filter(F.col("type").ilike(f"%{search}%")) if search else rollup
    out = rows.groupBy("type").agg(F.sum("n").alias("n"), F.min("local_date").alias("first"), F.max("local_date").alias("last"), F.countDistinct("source_name").alias("sources")).orderBy(F.desc("n"), "type")
    return out.limit(limit) if limit else out


def coverage(rollup: DataFrame, metric: str | None = None) -> DataFrame:
    """n, first, last: of the whole history, whatever a question's window is."""
    rows = rollup.filter(F.col("type") == metric_of(metric).identifier) if metric else rollup
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("local_date").alias("first"), F.max("local_date").alias("last"))


def index_summary(rollup: DataFrame, workout: DataFrame) -> DataFrame:
    """One row: records, span, types, sources by volume, workouts and their span. Reads the rollup, never the records."""
    per_source = rollup.filter(F.col("source_name").isNotNull()).groupBy("source_name").agg(F.sum("n").alias("n"))
    ranked = per_source.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "source_name"))), lambda x: x["source_name"]).alias("sources"))
    records = rollup.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.min("local_date").alias("first_date"), F.max("local_date").alias("last_date"), F.countDistinct("type").alias("distinct_types"))
    held = workout.agg(F.count("*").alias("workouts"), F.min("local_date").alias("workouts_first"), F.max("local_date").alias("workouts_last"))
    return records.join(F.broadcast(ranked)).join(F.broadcast(held))  # one row each
