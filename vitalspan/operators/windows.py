"""Two windows side by side with a verdict on whether they can be compared. The difference itself is never computed."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.constants import SHIFT_THRESHOLDS, find_metric, suggest_metrics
from vitalspan.functions import exprs as X
from vitalspan.operators import series, workouts

THIN = 2
VERDICTS = ("insufficient_data", "unit_mixed_on_one_side", "missing_measure_on_one_side", "unit_mismatch", "thin_on_one_side", "no_overlap", "ok")


@dataclass(frozen=True)
class Spec:
    """What is compared: a metric, or workouts (their summed duration, a measure, or a derivation)."""

    metric: str | None = None
    agg: str | None = None
    workouts: bool = False
    activity: str | None = None
    measure: str | None = None
    derive: str | None = None
    indoor: bool | None = None
    exclude: tuple[str, ...] = ()

    def checked(self) -> Spec:
        if self.metric and (self.workouts or self.measure or self.derive):
            raise ValueError("a metric and workouts can't be compared together")
        if self.derive in workouts.SERIES_DERIVATIONS:
            raise ValueError(f"{self.derive} can't be compared between windows")
        if self.metric:
            found = find_metric(self.metric)
            if not found:
                near = ", ".join(m.aliases[0] for m in suggest_metrics(self.metric) if m.aliases)
                raise ValueError(f"unknown metric: {self.metric}" + (f"; did you mean {near}?" if near else ""))
            if found.kind == "category":
                raise ValueError(f"{found.label} is a category, without a single figure for a period")
        elif not self.workouts:
            raise ValueError("nothing to compare")
        return self

    @property
    def label(self) -> str:
        if self.metric:
            return find_metric(self.metric).label
        return " ".join(x for x in (self.activity or "workouts", self.measure or self.derive or "duration") if x)


def resolve_anchor(fact: DataFrame | None = None, on: str | None = None, named: str | None = None) -> tuple[str | None, list[str]]:
    """(date, candidates): a date as given, or the only onset of facts whose name contains the words. Several dates are
    ambiguous: no date, and all of them listed. None at all: no date and no candidates."""
    if bool(on) == bool(named):
        raise ValueError("say either a date or a fact")
    if on:
        return date.fromisoformat(on).isoformat(), [on]
    found = fact.filter(F.col("name").ilike(f"%{named}%") & F.col("onset_date").isNotNull()).select(F.substring("onset_date", 1, 10).alias("d"))
    dates = [r["d"] for r in found.distinct().orderBy("d").collect()]  # onsets of one person's facts of one name
    return (dates[0], dates) if len(dates) == 1 else (None, dates)


def anchored(anchor: str, before: int, after: int) -> tuple[tuple[str, str], tuple[str, str]]:
    """The days before and after; the anchor's own day is in neither."""
    if before < 1 or after < 1:
        raise ValueError("each side needs at least one day")
    day = date.fromisoformat(anchor)
    shift = lambda n: (day + timedelta(days=n)).isoformat()
    return (shift(-before), shift(-1)), (shift(1), shift(after))


def expected_periods(start: str, end: str, period: str) -> int:
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    days = [first + timedelta(days=i) for i in range((last - first).days + 1)]
    key = {"day": lambda d: d, "week": lambda d: d - timedelta(days=d.weekday()), "month": lambda d: (d.year, d.month)}[period]
    return len({key(d) for d in days})


def entries(spec: Spec, period: str, start: str, end: str, rollup: DataFrame | None = None, workout: DataFrame | None = None, stat: DataFrame | None = None) -> DataFrame:
    """period, value, unit, units, counted, sources, multi_source, attributed: a row for each period of a side."""
    spec = spec.checked()
    if spec.metric:
        points = series.metric_series(rollup, spec.metric, period, spec.agg, start, end, exclude=spec.exclude)
        named = F.array_sort(F.filter(F.map_keys("by_source"), lambda s: s != series.UNKNOWN))
        return points.select("period", "value", F.coalesce("unit", F.when(F.size("series_units") > 1, X.MIXED)).alias("unit"), F.col("series_units").alias("units"), F.col("n").alias("counted"), named.alias("sources"), "multi_source", F.col("source").alias("attributed"))
    selection = {"activity": spec.activity, "start": start, "end": end, "indoor": spec.indoor, "exclude": spec.exclude}
    measures = [spec.measure] if spec.measure else [workouts.HEART_RATE] if spec.derive == "efficiency" else []
    rows = workouts.workout_series(workout, stat, period, measures, [spec.derive] if spec.derive else [], **selection)
    figure = F.col("m0") if spec.measure and not spec.derive else F.col(spec.derive) if spec.derive else F.col("duration")
    devices = workouts.select_workouts(workout, **selection).groupBy(X.period_label("local_date", period).alias("p")).agg(F.array_sort(F.collect_set("source_name")).alias("sources"))
    return rows.join(devices, rows["period"] == devices["p"]).select("period", figure["value"].alias("value"), figure["unit"].alias("unit"), figure["units"].alias("units"), F.col("n").alias("counted"), "sources", (F.size("sources") > 1).alias("multi_source"), F.when(F.size("sources") == 1, F.element_at("sources", 1)).alias("attributed"))


def summarize(side: DataFrame, expected: int) -> DataFrame:
    """One row for a side: n, empty_periods, value_periods, low, high, median, mean, units, unit, unit_mixed, counted, sources, multi_source_periods."""
    value = X.finite("value")
    listed = F.filter(F.coalesce("units", F.array().cast("array<string>")), lambda u: u != X.MIXED)
    own = F.when(F.size(listed) > 0, listed).when(F.col("unit").isNotNull() & (F.col("unit") != X.MIXED), F.array("unit")).when(F.col("value").isNotNull(), F.array(F.lit(X.UNLABELLED))).otherwise(F.array().cast("array<string>"))
    units = F.array_sort(F.array_distinct(F.flatten(F.collect_list(own))))
    mixed = F.coalesce(F.max(F.coalesce(F.col("unit") == X.MIXED, F.lit(False))), F.lit(False)) | (F.size(units) > 1)
    n = F.countDistinct("period")
    return side.agg(
        n.alias("n"), F.greatest(F.lit(expected) - n, F.lit(0)).alias("empty_periods"), F.count(value).alias("value_periods"),
        F.min(value).alias("low"), F.max(value).alias("high"), F.median(value).alias("median"), F.avg(value).alias("mean"),
        units.alias("units"), mixed.alias("unit_mixed"), F.coalesce(F.sum("counted"), F.lit(0)).alias("counted"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"), F.count_if("multi_source").alias("multi_source_periods"),
    ).withColumn("unit", F.when(~F.col("unit_mixed"), F.try_element_at("units", F.lit(1))))


def verdict(a: str = "before", b: str = "after") -> Column:
    """Over structs of two sides. The order of the rules is the contract; ranges that touch overlap."""
    x, y = F.col(a), F.col(b)
    either = lambda f: f(x) | f(y)
    return (
        F.when(either(lambda s: s["n"] == 0), "insufficient_data")
        .when(either(lambda s: s["unit_mixed"]), "unit_mixed_on_one_side")
        .when(either(lambda s: s["value_periods"] == 0), "missing_measure_on_one_side")
        .when(~x["unit"].eqNullSafe(y["unit"]), "unit_mismatch")
        .when(either(lambda s: s["value_periods"] < THIN), "thin_on_one_side")
        .when((x["high"] < y["low"]) | (y["high"] < x["low"]), "no_overlap")
        .otherwise("ok")
    )


def compare(spec: Spec, left: tuple[str, str], right: tuple[str, str], period: str = "day", **tables: DataFrame) -> DataFrame:
    """One row: before, after (structs), verdict, devices_differ. tables: rollup, workout, stat."""
    sides = [summarize(entries(spec, period, *span, **tables), expected_periods(*span, period)) for span in (left, right)]
    packed = [s.select(F.struct(*s.columns).alias(name)) for s, name in zip(sides, ("before", "after"), strict=True)]
    named = (F.size("before.sources") > 0) & (F.size("after.sources") > 0)
    return packed[0].join(F.broadcast(packed[1])).withColumn("verdict", verdict()).withColumn("devices_differ", named & (F.col("before.sources") != F.col("after.sources")))  # one row each


def window(spec: Spec, anchor: str, before: int = 30, after: int = 30, period: str = "day", **tables: DataFrame) -> DataFrame:
    return compare(spec, *anchored(anchor, before, after), period, **tables).withColumn("anchor", F.lit(anchor))


def compare_or_substitute(spec: Spec, left, right, period: str = "day", **tables: DataFrame) -> tuple[DataFrame, bool]:
    """Where no workout on either side carries the measure, their durations are compared instead, and that is said."""
    out = compare(spec, left, right, period, **tables)
    if spec.workouts and (spec.measure or spec.derive):
        row = out.select("verdict", F.col("before.value_periods").alias("a"), F.col("after.value_periods").alias("b")).first()
        if row["a"] == 0 and row["b"] == 0 and row["verdict"] == "missing_measure_on_one_side":
            return compare(replace(spec, measure=None, derive=None), left, right, period, **tables), True
    return out, False


def metric_shifts(daily: DataFrame, window_days: int = 30, thresholds: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """daily: metric, date, value, sources (array). A row for each metric: the last `window_days` days up to its own last day
    and as many before: means, days, devices, gap (why they can't be compared) and shifted."""
    rules = thresholds or SHIFT_THRESHOLDS
    rows = daily.filter(F.col("value").isNotNull())
    last = rows.groupBy("metric").agg(F.max("date").alias("last"))
    days = F.datediff("last", "date")
    side = F.when(days < window_days, "recent").when(days < 2 * window_days, "prior")
    placed = rows.join(last, "metric").withColumn("side", side)
    of = lambda s, c: F.when(F.col("side") == s, c)
    devices = lambda s: F.array_sort(F.array_distinct(F.flatten(F.collect_list(of(s, F.col("sources"))))))
    out = placed.groupBy("metric", "last").agg(
        F.avg(of("recent", F.col("value"))).alias("recent_mean"), F.avg(of("prior", F.col("value"))).alias("prior_mean"),
        F.countDistinct(of("recent", F.col("date"))).alias("recent_days"), F.countDistinct(of("prior", F.col("date"))).alias("prior_days"),
        devices("recent").alias("recent_sources"), devices("prior").alias("prior_sources"),
    )
    need = max(1, window_days // 2)
    moved = F.abs(F.col("recent_mean") - F.col("prior_mean"))
    rule = F.lit(None).cast("boolean")
    for name, (kind, amount) in rules.items():
        enough = moved >= amount if kind == "abs" else F.coalesce(F.try_divide(moved, F.abs("prior_mean")) * 100 >= amount, F.lit(False))
        rule = F.when(F.col("metric") == name, enough).otherwise(rule)
    gap = F.when(F.col("recent_days") < need, "recent").when(F.col("prior_days") < need, "prior")
    return out.withColumn("gap", gap).withColumn("shifted", F.when(F.col("gap").isNull(), rule).otherwise(False)).withColumn("devices_differ", F.col("recent_sources") != F.col("prior_sources"))
