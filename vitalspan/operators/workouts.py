"""Workouts: listings, measures, derivations, series with guarded units, and how many samples each workout holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions import exprs as X
from vitalspan.operators.ranks import nearest_ranks

DERIVATIONS = ("pace", "speed", "efficiency")
SERIES_DERIVATIONS = ("ratio", "percentile")
STAT_AGGREGATES = ("average", "minimum", "maximum", "sum")
HEART_RATE = "HKQuantityTypeIdentifierHeartRate:average"


def select_workouts(workout: DataFrame, activity: str | None = None, start: str | None = None, end: str | None = None, indoor: bool | None = None, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """indoor: True, False, or None for no filter; workouts that don't say match neither."""
    keep = X.between("local_date", start, end) & X.sources(include, exclude)
    if activity:
        keep = keep & F.col("activity_type").ilike(f"%{activity}%")
    if indoor is not None:
        keep = keep & (F.col("indoor") == F.lit(indoor))
    return workout.filter(keep)


def list_workouts(workout: DataFrame, limit: int = 50, **selection) -> DataFrame:
    """Newest first; ids settle ties."""
    return select_workouts(workout, **selection).orderBy(F.desc("start_epoch"), F.desc("id")).limit(limit)


def workout_summary(workout: DataFrame, limit: int | None = 20, **selection) -> DataFrame:
    """By activity and by units: figures in different units are different rows."""
    out = (
        select_workouts(workout, **selection)
        .groupBy("activity_type", "duration_unit", "total_distance_unit", "total_energy_unit")
        .agg(
            F.count("*").alias("n"),
            F.sum("duration").alias("total_duration"),
            F.sum("total_distance").alias("total_distance"),
            F.sum("total_energy").alias("total_energy"),
            F.min("local_date").alias("first"),
            F.max("local_date").alias("last"),
        )
        .orderBy(F.desc("n"), "activity_type", "duration_unit", "total_distance_unit", "total_energy_unit")
    )
    return out.limit(limit) if limit else out


def stat_rows(workout: DataFrame) -> DataFrame:
    """workout_id, kind, key, value_num, value_text, unit from `statistics` (array of maps) and `metadata` (map).

    A statistic gives a row for each aggregate it has, keyed type:aggregate; what isn't a number stays as text."""
    aggregates = F.array(*[F.lit(a) for a in STAT_AGGREGATES])
    statistics = (
        workout.select(F.col("id").alias("workout_id"), F.posexplode("statistics").alias("at", "s"))
        .select("workout_id", "at", "s", F.explode(aggregates).alias("agg"))
        .filter((F.col("s")["type"] != "") & F.map_contains_key("s", F.col("agg")))
        .select("workout_id", "at", F.lit("statistic").alias("kind"), F.concat(F.col("s")["type"], F.lit(":"), "agg").alias("key"), F.col("s")[F.col("agg")].alias("raw"), F.try_element_at("s", F.lit("unit")).alias("unit"))
    )
    metadata = workout.select(F.col("id").alias("workout_id"), F.explode("metadata").alias("key", "raw")).select("workout_id", F.lit(0).alias("at"), F.lit("metadata").alias("kind"), "key", "raw", F.lit(None).cast("string").alias("unit"))
    value = X.finite(X.number("raw"))
    out = statistics.unionByName(metadata).select("workout_id", "at", "kind", "key", value.alias("value_num"), F.when(value.isNull(), F.col("raw")).alias("value_text"), "unit")
    # The first of repeated keys in the workout's own order stays, as an insert that ignores conflicts keeps it.
    first = Window.partitionBy("workout_id", "kind", "key").orderBy("at", "value_num", "value_text")
    return out.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "at")


def measure_inventory(workout: DataFrame, stat: DataFrame, **selection) -> DataFrame:
    """What can be asked for: key, kind, in how many workouts, with how many numbers, in which units."""
    held = stat.join(select_workouts(workout, **selection).select(F.col("id").alias("workout_id")), "workout_id")
    return held.groupBy("key", "kind").agg(F.countDistinct("workout_id").alias("workouts"), F.count("value_num").alias("numeric"), F.array_sort(F.collect_set("unit")).alias("units")).orderBy(F.desc("workouts"), "key")


def stat_coverage(workout: DataFrame, stat: DataFrame) -> DataFrame:
    kinds = stat.agg(F.countDistinct(F.when(F.col("kind") == "statistic", F.col("workout_id"))).alias("with_statistics"), F.countDistinct(F.when(F.col("kind") == "metadata", F.col("workout_id"))).alias("with_metadata"))
    return workout.agg(F.count("*").alias("workouts")).join(F.broadcast(kinds))  # one row each


def with_measures(workouts: DataFrame, stat: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Each workout with `measures`, a map from every requested key to (kind, value, text, unit); nulls where it has none.

    A key that is a statistic and an entry of the metadata as well gives the statistic."""
    wanted = stat.filter(F.col("key").isin(*measures)).select("workout_id", "key", F.struct("kind", F.col("value_num").alias("value"), F.col("value_text").alias("text"), "unit").alias("m"))
    wanted = wanted.groupBy("workout_id", "key").agg(F.max_by("m", F.struct("m.kind", "m.value", "m.text")).alias("m"))
    held = wanted.groupBy("workout_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "m"))).alias("held"))
    joined = workouts.join(held, workouts["id"] == held["workout_id"], "left").drop("workout_id")
    filled = F.map_from_entries(F.array(*[F.struct(F.lit(k).alias("key"), F.try_element_at("held", F.lit(k)).alias("m")) for k in measures]))
    return joined.withColumn("measures", filled).drop("held")


def derivation(name: str) -> Column:
    """Over the columns of a workout, and `measures` for its heart rate."""
    own = ("total_distance", "total_distance_unit", "duration", "duration_unit")
    if name == "pace":
        return X.pace(*own)
    if name == "speed":
        return X.speed(*own)
    if name == "efficiency":
        rate = F.try_element_at("measures", F.lit(HEART_RATE))
        return X.efficiency(*own, rate["value"], rate["unit"])
    raise ValueError(f"{name} needs more than one workout; use workout_series" if name in SERIES_DERIVATIONS else f"unknown derivation: {name}")


def workout_detail(workout: DataFrame, stat: DataFrame | None = None, measures: Sequence[str] = (), derive: Sequence[str] = (), limit: int | None = 200, **selection) -> DataFrame:
    """A row for each workout with the measures and derivations asked for, newest first."""
    for name in derive:
        if name not in DERIVATIONS:
            derivation(name)
    rows = select_workouts(workout, **selection)
    if limit:
        rows = rows.orderBy(F.desc("start_epoch"), F.desc("id")).limit(limit)
    keys = list(dict.fromkeys([*measures, *([HEART_RATE] if "efficiency" in derive and HEART_RATE in measures else [])]))
    if keys:
        rows = with_measures(rows, stat, keys)
    else:
        rows = rows.withColumn("measures", F.create_map().cast("map<string,struct<kind:string,value:double,text:string,unit:string>>"))
    for name in derive:
        rows = rows.withColumn(name, derivation(name))
    activity = F.coalesce(F.nullif("activity_type", F.lit("")), F.lit("workout"))
    return rows.withColumn("citation", F.concat(activity, F.lit(" on "), F.date_format("local_date", "yyyy-MM-dd")))


def sample_depth(workouts: DataFrame, record: DataFrame, types: Sequence[str], bucket_seconds: int = 3600) -> DataFrame:
    """id, type, count, window_seconds, reason: records of a type from a workout's start to its end, both included.

    No workout meets its records: a count is how many stand up to its end less how many stand before its start. Equal instants are
    counted first, and so are equal bounds; how many records stand before a bound is the sum of the buckets before its own, of the
    seconds before its own in that bucket, and of the instants before it in that second, so what one task orders is the
    buckets of a type, the seconds of a bucket or the instants of a second, and the work grows with the two tables, not with the
    records that workouts hold. A workout without a usable duration has no count, which isn't zero."""
    window = X.seconds("duration", "duration_unit")
    reason = F.when(F.col("duration").isNull(), "workout has no duration").when(X.finite("duration").isNull(), "workout duration is not a finite number").when(window.isNull(), F.concat(F.lit("duration unit not recognized: "), F.coalesce("duration_unit", F.lit("None"))))
    asked = workouts.select("id", "start_epoch", window.alias("window_seconds"), reason.alias("reason")).withColumn("type", F.explode(F.array(*[F.lit(t) for t in types])))
    end = F.col("start_epoch") + F.col("window_seconds")
    counted = record.filter(F.col("type").isin(*types) & F.col("start_epoch").isNotNull()).groupBy("type", F.col("start_epoch").cast("double").alias("at")).agg(F.count("*").alias("n"))
    # Bounds stay within the records' own span: a workout's claimed duration may be absurd.
    span = counted.agg(F.min("at").alias("_from"), F.max("at").alias("_to"))
    within = asked.filter("window_seconds >= 0").join(F.broadcast(span)).filter((F.col("start_epoch") <= F.col("_to")) & (end >= F.col("_from")))  # against one row
    bound = lambda at, side: F.struct(at.cast("double").alias("at"), F.lit(side).alias("side"))
    bounds = within.select("id", "type", F.explode(F.array(bound(F.greatest("start_epoch", "_from"), -1), bound(F.least(end, F.col("_to")), 1))).alias("b")).select("id", "type", "b.*")
    # Records stand between the bounds that leave them out (-1, starts) and those that take them in (1, ends).
    line = counted.withColumn("side", F.lit(0)).unionByName(bounds.select("type", "at", "side").distinct().withColumn("n", F.lit(0).cast("long")))
    place = F.least("at", F.lit(1e18))  # NaN is the last
    line = line.withColumn("bucket", F.floor(place / bucket_seconds)).withColumn("second", F.floor(place))
    before = lambda *by: F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1])) - F.col("n")
    seconds = line.groupBy("type", "bucket", "second").agg(F.sum("n").alias("n"))
    buckets = seconds.groupBy("type", "bucket").agg(F.sum("n").alias("n")).select("type", "bucket", before("type", "bucket").alias("_bucket"))
    seconds = seconds.select("type", "bucket", "second", before("type", "bucket", "second").alias("_second"))
    held = F.sum("n").over(Window.partitionBy("type", "bucket", "second").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0))
    upto = line.withColumn("_held", held).filter("side <> 0").join(seconds, ["type", "bucket", "second"]).join(buckets, ["type", "bucket"])
    upto = upto.select("type", "at", "side", (F.col("_bucket") + F.col("_second") + F.col("_held")).alias("upto"))
    counts = bounds.join(upto, ["type", "at", "side"]).groupBy("id", "type").agg(F.sum(F.col("side") * F.col("upto")).alias("count"))
    return asked.join(counts, ["id", "type"], "left").select("id", "type", F.when(F.col("reason").isNull(), F.coalesce("count", F.lit(0))).alias("count"), "window_seconds", "reason")


def workout_series(
    workout: DataFrame,
    stat: DataFrame | None = None,
    period: str = "week",
    measures: Sequence[str] = (),
    derive: Sequence[str] = (),
    ratio_of: Sequence[str] = (),
    percentile_of: str | None = None,
    record: DataFrame | None = None,
    **selection,
) -> DataFrame:
    """A row for each period: n, guarded sums of duration, distance and energy, a guarded median for each measure with n
    and missing, medians of derivations, p50 and p90 of one measure, the ratio of two medians, and with `record` the depth
    of samples. No figure mixes units: it is refused with a reason instead."""
    _check_series(measures, derive, ratio_of, percentile_of, record)
    own = [d for d in derive if d in DERIVATIONS]
    rows = workout_detail(workout, stat, measures, own, None, **selection).withColumn("period", X.period_label("local_date", period))
    aggs = [F.count("*").alias("n")]
    aggs += [X.guarded_sum(c, f"{c}_unit", c) for c in ("duration", "total_distance", "total_energy")]
    aggs.append(F.array_sort(F.collect_set(F.coalesce("activity_type", F.lit("workout")))).alias("activities"))
    of = lambda k: F.try_element_at("measures", F.lit(k))
    for i, key in enumerate(measures):
        aggs.append(X.guarded_median(of(key)["value"], of(key)["unit"], key).alias(f"m{i}"))
        aggs += [F.count(of(key)["value"]).alias(f"m{i}_n"), F.count_if(of(key)["value"].isNull()).alias(f"m{i}_missing")]
    aggs += [X.guarded_median(F.col(d)["value"], F.col(d)["unit"], d) for d in own]
    quantile_of = percentile_of or (measures[0] if len(measures) == 1 else None)
    out = rows.groupBy("period").agg(*aggs)
    if "percentile" in derive:
        if quantile_of:
            found = nearest_ranks(rows.select("period", of(quantile_of)["value"].alias("value")), ["period"], "value", (50, 90))
            out = out.alias("o").join(found.withColumnRenamed("period", "_period"), F.col("o.period").eqNullSafe(F.col("_period")), "left").drop("_period")
        out = _guarded_percentiles(out, list(measures).index(quantile_of) if quantile_of else None)
    if "ratio" in derive:
        a, b = (F.col(f"m{list(measures).index(k)}") for k in ratio_of)
        mixed = F.when((a["unit"] == X.MIXED) | (b["unit"] == X.MIXED), F.coalesce(a["reason"], b["reason"]))
        plain = X.ratio(a["value"], a["unit"], b["value"], b["unit"])
        out = out.withColumn("ratio", F.when(mixed.isNull(), plain).otherwise(X.derived(plain["value"], plain["unit"], mixed)))
    if record is not None:
        bases = sorted({k.split(":", 1)[0] for k in measures if ":" in k})
        depth = sample_depth(rows.select("id", "start_epoch", "duration", "duration_unit"), record, bases).join(rows.select("id", "period"), "id")
        per_type = depth.groupBy("period", "type").agg(F.median("count").alias("median"), F.array_sort(F.collect_list("count")).alias("counts"), F.count("count").alias("counted"), F.count_if(F.col("count").isNull()).alias("without"), F.array_sort(F.collect_list("reason")).alias("reasons"))
        held = per_type.groupBy("period").agg(F.map_from_entries(F.collect_list(F.struct("type", F.struct("median", "counts", "counted", "without", "reasons")))).alias("depth"))
        out = out.join(held, "period", "left")
    return out


def _guarded_percentiles(out: DataFrame, i: int | None) -> DataFrame:
    if i is None:
        why = F.lit("percentile needs one measure; say which with percentile_of")
        return out.withColumn("percentile", F.struct(F.lit(None).cast("double").alias("p50"), F.lit(None).cast("double").alias("p90"), F.lit(None).cast("string").alias("unit"), why.alias("reason")))
    m = F.col(f"m{i}")
    return out.withColumn("percentile", F.struct(*[F.when(m["reason"].isNull(), F.col(p)).alias(p) for p in ("p50", "p90")], m["unit"].alias("unit"), m["reason"].alias("reason"))).drop("p50", "p90")


def _check_series(measures, derive, ratio_of, percentile_of, record) -> None:
    for name in derive:
        if name not in (*DERIVATIONS, *SERIES_DERIVATIONS):
            raise ValueError(f"unknown derivation: {name}")
    if ratio_of and "ratio" not in derive or "ratio" in derive and (len(set(ratio_of)) != 2 or not set(ratio_of) <= set(measures)):
        raise ValueError("ratio needs two different measures that are asked for")
    if percentile_of and ("percentile" not in derive or percentile_of not in measures):
        raise ValueError("percentile_of needs the percentile derivation and a measure that is asked for")
    if record is not None and not measures:
        raise ValueError("sample counts need a statistic among the measures, to say which records to count")
