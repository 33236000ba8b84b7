"""Two windows in words: each kind of absence and each verdict, from generated workouts and a rollup."""

import pytest
from pyspark.sql import functions as F

from vitalspan import constants as C
from vitalspan.catalog import Catalog
from vitalspan.functions import sides
from vitalspan.operators import held, windows
from vitalspan.tools import Context, compare_windows

RUN, ROW, YOGA = "HKWorkoutActivityTypeRunning", "HKWorkoutActivityTypeRowing", "HKWorkoutActivityTypeYoga"
CADENCE, PULSE = "CadenceThing:average", "HKQuantityTypeIdentifierHeartRate:average"


@pytest.fixture(scope="module")
def ctx(spark, tmp_path_factory):
    c = Catalog.open(spark, str(tmp_path_factory.mktemp("sides") / "i"), create=True)
    steps = C.find_metric("steps").identifier
    day = lambda m, d: f"2026-{m:02d}-{d:02d}"
    # Steps: March by one device, April by another, with one day of two devices; June alone is in another unit.
    rolled = [(day(3, d), steps, "Old", "count", 1, 100.0 * d) for d in range(1, 5)] + [(day(4, d), steps, "New", "count", 1, 150.0 * d) for d in range(1, 5)]
    rolled += [(day(4, 2), steps, "Old", "count", 1, 5.0), (day(6, 1), steps, "New", "paces", 1, 7.0), (day(6, 2), steps, "New", "paces", 1, 9.0)]
    rows = spark.createDataFrame(rolled, "d string, type string, source_name string, unit string, n long, sum_value double")
    c.write("daily_metric", rows.withColumn("local_date", F.to_date("d")))
    rides = [(1, RUN, 30.0, "min", day(3, 1), 0.0, True, "Old"), (2, RUN, 20.0, "min", day(3, 2), 86_400.0, False, "Old"), (3, RUN, None, None, day(3, 3), 172_800.0, True, "New"), (4, ROW, 10.0, "min", day(4, 1), 2_678_400.0, None, "New"), (5, "HKWorkoutActivityTypeRunningOnSand", 5.0, "min", day(4, 2), 2_764_800.0, None, "New")]
    c.write("workout", spark.createDataFrame(rides, "id long, activity_type string, duration double, duration_unit string, d string, start_epoch double, indoor boolean, source_name string").withColumn("local_date", F.to_date("d")))
    stats = [(1, PULSE, 120.0), (2, PULSE, 130.0), (4, PULSE, 140.0), (5, PULSE, None)]
    c.write("workout_stat", spark.createDataFrame(stats, "workout_id long, key string, value_num double").withColumn("kind", F.lit("statistic")).withColumn("unit", F.lit("count/min")))
    beats = [(60.0 * i, "HKQuantityTypeIdentifierHeartRate", 100.0) for i in range(7)] + [(86_400.0 + i, "HKQuantityTypeIdentifierHeartRate", 90.0) for i in range(3)]
    c.write("record", spark.createDataFrame(beats, "start_epoch double, type string, value_num double"))
    return Context(c)


def ask(ctx, left, right, **given):
    return compare_windows(ctx, left=[f"2026-{x}" for x in left], right=[f"2026-{x}" for x in right], **given)


MARCH, APRIL, MAY, JUNE = (("03-01", "03-31"), ("04-01", "04-30"), ("05-01", "05-31"), ("06-01", "06-30"))


def test_what_is_held(ctx):
    w, s = ctx.index.table("workout"), ctx.index.table("workout_stat")
    got = held.held(windows.Spec(workouts=True, activity="running", measure=CADENCE), workout=w, stat=s).first()
    assert (got["total"], got["first"], got["last"]) == (5, "2026-03-01", "2026-04-02")
    assert (got["activity_n"], got["activity_first"], got["activity_last"], got["timed"]) == (4, "2026-03-01", "2026-04-02", 3)
    assert [tuple(e) for e in got["alike"]] == [(RUN, 3), ("HKWorkoutActivityTypeRunningOnSand", 1)]
    assert [tuple(e) for e in got["activities"]] == [(RUN, 3), (ROW, 1), ("HKWorkoutActivityTypeRunningOnSand", 1)]
    assert (got["measure_n"], got["measure_first"]) == (0, None) and [tuple(e) for e in got["measures"]] == [(PULSE, 3)]
    none = held.held(windows.Spec(workouts=True, measure=PULSE), workout=w.limit(0), stat=s.limit(0)).first()
    assert (none["total"], none["first"], none["activities"], none["measures"], none["measure_n"]) == (0, None, [], [], 0)
    steps = held.held(windows.Spec(metric="steps"), rollup=ctx.index.table("daily_metric")).first()
    assert tuple(steps) == (11, "2026-03-01", "2026-06-02")
    assert tuple(held.held(windows.Spec(metric="steps"), rollup=ctx.index.table("daily_metric").limit(0)).first()) == (0, None, None)


def test_depth(ctx):
    w, r = ctx.index.table("workout"), ctx.index.table("record")
    of = lambda spec, span: tuple(held.depth(spec, span, w, r).first())[1:]
    spec = windows.Spec(workouts=True, measure=PULSE)
    assert of(spec, ("2026-03-01", "2026-03-31")) == (2, 1, 5.0) and of(spec, ("2026-05-01", "2026-05-31")) == (0, 0, None)
    assert of(windows.Spec(workouts=True, measure=PULSE, indoor=True, exclude=("New",)), ("2026-03-01", "2026-03-31")) == (1, 0, 7.0)
    assert sides.sampled(None) == "" and "can't be counted in 2 workouts" in sides.sampled({"type": "x", "counted": 0, "uncounted": 2, "median": None})
    with pytest.raises(ValueError):
        held.depth(windows.Spec(workouts=True), ("2026-03-01", "2026-03-31"), w, r)


def test_devices_are_named(ctx):
    got = ask(ctx, MARCH, APRIL, metric="steps")
    assert got["verdict"] == "ok" and got["devices_differ"] and "held" not in got
    assert "first side by Old, second by New, Old" in got["text"] and "1 period of the second side with several devices" in got["text"]
    assert "27 periods empty" in got["text"].splitlines()[1] and "median 250 count" in got["text"]
    same = ask(ctx, ("03-01", "03-02"), ("03-02", "03-04"), metric="steps")
    assert same["verdict"] == "ok" and "device" not in same["text"]
    # Without the one device the two sides have one each, and that is said only where a side is empty.
    assert ask(ctx, MARCH, APRIL, metric="steps", exclude_source="New")["verdict"] == "thin_on_one_side"
    left_out = ask(ctx, MARCH, JUNE, metric="steps", exclude_source="New")
    assert left_out["verdict"] == "insufficient_data" and left_out["text"].endswith("both sides leave out New.")


def test_an_empty_window_says_what_there_is(ctx):
    got = ask(ctx, MAY, APRIL, metric="steps")
    assert got["verdict"] == "insufficient_data" and got["held"]["total"] == 11
    assert got["text"].count("11 records of it, 2026-03-01 to 2026-06-02") == 2 and "the first side has no period" in got["text"]
    both = ask(ctx, MAY, ("07-01", "07-31"), metric="steps")
    assert "the first side and the second side have no period" in both["text"]
    never = ask(ctx, MAY, APRIL, metric="resting-hr")
    assert "no such records on any day" in never["text"]
    yoga = ask(ctx, MARCH, APRIL, workouts=True, activity="yoga")
    assert "no activity is like yoga; there are Running in 3 workouts, Rowing in 1 workout, RunningOnSand in 1 workout" in yoga["text"]
    run = ask(ctx, MARCH, MAY, workouts=True, activity="running", indoor=True)
    assert "activities like running come to 4 workouts, 2026-03-01 to 2026-04-02: Running in 3 workouts, RunningOnSand in 1 workout" in run["text"]
    assert "both sides take only workouts marked indoor" in run["text"] and "5 workouts of all kinds" in run["text"]


def test_measures(ctx):
    got = ask(ctx, MARCH, APRIL, workouts=True, measure=PULSE)
    assert got["sample_depth"][0]["median"] == 5.0 and "5 samples of heart rate in the median workout (2 of 3 could be counted)" in got["text"]
    # A measure that no workout of either side has gives way to durations, and that is said.
    instead = ask(ctx, MARCH, APRIL, workouts=True, measure=CADENCE)
    assert instead["substituted"] and "Compared instead: durations" in instead["text"] and instead["held"]["measures"] == [{"name": PULSE, "workouts": 3}]
    one = ask(ctx, ("03-03", "03-03"), MARCH, workouts=True, measure=PULSE)
    assert one["verdict"] == "missing_measure_on_one_side" and f"{PULSE} has a number in 3 workouts, 2026-03-01 to 2026-04-01" in one["text"]


def test_units_thin_sides_and_ranges(ctx):
    units = ask(ctx, MARCH, JUNE, metric="steps")
    assert units["verdict"] == "unit_mismatch" and "count on the first side, paces on the second; units are never converted" in units["text"]
    mixed = ask(ctx, ("04-01", "06-30"), MARCH, metric="steps")
    assert mixed["verdict"] == "unit_mixed_on_one_side" and "the first side mixes count, paces" in mixed["text"] and "hence without a figure" in mixed["text"]
    thin = ask(ctx, ("03-01", "03-01"), APRIL, metric="steps")
    assert thin["verdict"] == "thin_on_one_side" and "the first side has 1 value; each needs 2" in thin["text"]
    apart = ask(ctx, ("03-01", "03-02"), ("04-03", "04-04"), metric="steps")
    assert apart["verdict"] == "no_overlap" and "the ranges 100 to 200 and 450 to 600 don't overlap" in apart["text"]
    anchored = compare_windows(ctx, metric="steps", anchor_date="2026-03-31", before_days=31, after_days=10)
    assert "The day itself, 2026-03-31, is in neither window." in anchored["text"]
