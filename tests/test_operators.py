"""Single operators against hand-computed values."""

import math
import random
from datetime import date, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from vitalspan import constants as C
from vitalspan.functions import exprs as X
from vitalspan.operators import clinical, documents, labs, series, windows, workouts, writes


def one(spark, **values):
    cols = [(F.lit(None).cast("double") if v is None else F.lit(v)).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols)


def test_registries():
    assert len(C.metrics()) == 52 and len(C.analytes()) == 49 + 1 and len(C.LOINC) == 27
    assert set(C.LOINC.values()) <= {a.key for a in C.analytes()}
    assert C.find_metric("Resting_HR").label == "Resting heart rate" and C.find_metric("RestingHeartRate").default_agg == "avg"
    assert C.metric_of("HKCategoryTypeIdentifierNew").default_agg == "duration" and C.metric_of("odd").kind == "discrete"
    assert [m.aliases[0] for m in C.suggest_metrics("blood-pressure-systolic")][:1] == ["systolic"] or C.suggest_metrics("blood-pressure-systolic")
    assert C.analyte_key("LDL Chol Calc (NIH)") == ("ldl", "lipids") and C.analyte_key("Hemoglobin Alc")[0] == "hba1c" and C.analyte_key("Odd Thing, X") == ("odd_thing_x", None)
    assert C.coded_key([("http://loinc.org", "30522-7")], "whatever") == ("hs_crp", "inflammation")
    assert C.unit_looks_wrong("hdl", "kg") and not C.unit_looks_wrong("hdl", "mg/dL") and not C.unit_looks_wrong("hdl", None)
    assert C.tier_of(["Review", "Meta-Analysis"])[0] == "meta_analysis" and C.tier_of(["Letter"])[2] == "unmapped"


def test_nearest_rank_for_all(spark):
    cases = [(n, p) for n in range(1, 60) for p in range(101)]
    df = spark.createDataFrame(cases, "n int, p int").withColumn("v", F.transform(F.sequence(F.lit(1), "n"), lambda i: i * 10))
    got = {(r["n"], r["p"]): r["x"] for r in df.select("n", "p", X.nearest_rank(F.shuffle("v"), F.col("p")).alias("x")).collect()}
    assert got == {(n, p): 10 * max(1, math.ceil(Fraction(p * n, 100))) for n, p in cases}


def test_derivations(spark):
    def value(c, **row):
        return tuple(one(spark, **row).select(c.alias("x")).first()["x"])

    row = {"d": 5.0, "du": "km", "t": 30.0, "tu": "min", "hr": 150.0, "hu": "count/min"}
    assert value(X.pace("d", "du", "t", "tu"), **row) == (6.0, "min/km", None)
    assert value(X.speed("d", "du", "t", "tu"), **row) == (10.0, "km/hr", None)
    assert value(X.efficiency("d", "du", "t", "tu", "hr", "hu"), **row)[1:] == ("km/hr per 100 count/min", None)
    assert value(X.pace("d", "du", "t", "tu"), **row | {"d": 0.0}) == (None, None, "distance is zero")
    assert value(X.speed("d", "du", "t", "tu"), **row | {"tu": "fortnight"})[2] == "unknown duration unit: fortnight"
    assert value(X.speed("d", "du", "t", "tu"), **row | {"d": None})[2] == "a value this needs is missing"
    assert value(X.pace("d", "du", "t", "tu"), **row | {"t": float("nan")})[2].startswith("not a number")
    assert value(X.ratio("d", "du", "t", "tu"), **row)[2] == "incompatible units: km and min"
    assert value(X.ratio("d", "du", "t", "du"), **row | {"t": 0.0})[2] == "denominator is zero"
    assert value(X.ratio("d", "du", "t", "du"), **row) == (5 / 30, None, None)


def test_numbers_and_flags(spark):
    rows = [("1.5", 1.5), (" 2 ", 2.0), ("1.0d", None), ("1_000", None), ("x", None), ("-3e2", -300.0), (None, None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "t string").select(X.number("t").alias("v"))
    assert [r["v"] for r in df.collect()] == [v for _, v in rows]
    flags = spark.createDataFrame([("1",), ("No",), ("maybe",), (None,)], "t string").select(X.indoor_flag("t").alias("v"))
    assert [r["v"] for r in flags.collect()] == [True, False, None, None]
    ranges = spark.createDataFrame([("70-99",), ("<100",), (">= 40",), ("3.5 to 5.1",), ("Not Estab.",), ("",), ("less than 5",)], "t string").select(X.reference_range("t").alias("r"))
    assert [tuple(r["r"])[:2] for r in ranges.collect()] == [(70, 99), (None, 100), (40, None), (3.5, 5.1), (None, None), (None, None), (None, 5)]
    ids = spark.createDataFrame([(None, "a"), ("", "a"), ("a", None)], "x string, y string").select(X.identity("x", "y").alias("k"))
    a, b, c = (bytes(r["k"]) for r in ids.collect())
    assert a == b != c and len(a) == 16
    keys = spark.createDataFrame([("t:avg:x",), ("plain",)], "k string").select(X.stat_base("k").alias("b"), X.stat_aggregate("k").alias("a"), X.is_stat_key("k").alias("i"))
    assert [tuple(r) for r in keys.collect()] == [("t", "avg:x", True), ("plain", "", False)]


def test_range_status(spark):
    rows = [(128.0, None, 100.0, None, "out_of_range", True), (5.7, 4.8, 5.6, "", "out_of_range", True), (5.4, 4.8, 5.6, "N", "in_range", False), (5.4, 4.8, 5.6, "H", "out_of_range", False), (None, 1.0, 2.0, None, "not_numeric", None), (3.0, None, None, None, "no_printed_range", None)]
    df = spark.createDataFrame([r[:4] for r in rows], "value_num double, ref_low double, ref_high double, flag string")
    assert [tuple(r) for r in df.select(X.range_status(), X.out_of_range()).collect()] == [r[4:] for r in rows]


def test_evidence(spark):
    cases = [["Review", "Meta-Analysis"], ["Clinical Trial Protocol", "Randomized Controlled Trial"], ["Letter"], [], ["Case Reports", " clinical trial, phase III "]]
    got = [tuple(r["e"]) for r in spark.createDataFrame([(c,) for c in cases], "t array<string>").select(X.evidence("t").alias("e")).collect()]
    assert got == [C.tier_of(c) for c in cases]


def record(spark, rows):
    return spark.createDataFrame([(d, t, s, u, v, c, 60.0) for d, t, s, u, v, c in rows], "d string, type string, source_name string, unit string, value_num double, value_text string, duration_sec double").withColumn("local_date", F.to_date("d"))


def test_series_rules(spark):
    steps = "HKQuantityTypeIdentifierStepCount"
    rows = [("2026-03-02", steps, "Watch", "count", 6.0, None), ("2026-03-02", steps, "Phone", None, 4.0, None), ("2026-03-02", steps, None, "count", 9.0, None), ("2026-03-03", steps, "Watch", "count", None, "stray")]
    rollup = series.daily_rollup(record(spark, rows))
    week = {a: series.metric_series(rollup, "steps", "week", a).first() for a in series.AGGREGATES}
    assert {a: w["value"] for a, w in week.items()} == {"sum": 9.0, "avg": 19 / 4, "min": 4.0, "max": 9.0, "count": 2.0, "duration": 120.0}
    assert week["sum"]["source"] == "(unknown)" and week["avg"]["source"] is None and week["avg"]["source_n"] == 4 and week["min"]["source"] == "Phone"
    assert week["sum"]["unit"] is None and week["sum"]["series_units"] == ["count", "unlabelled"] and week["duration"]["unit"] == "s"
    assert week["sum"]["period_start"] == date(2026, 3, 2) and week["sum"]["period_end"] == date(2026, 3, 8)
    assert series.metric_series(rollup, "steps", "week", "sum", combine="sum").first()["value"] == 19
    assert series.metric_series(rollup, "steps", exclude=["Watch"]).filter("period = '2026-03-02'").first()["by_source"] == {"(unknown)": 9.0, "Phone": 4.0}
    tied = series.daily_rollup(record(spark, [("2026-03-02", steps, s, "count", 5.0, None) for s in ("b", "a")]))
    assert series.metric_series(tied, "steps").first()["source"] == "a"
    with pytest.raises(ValueError):
        series.metric_series(rollup, "steps", source="Watch", exclude=["Watch"])
    with pytest.raises(ValueError):
        series.metric_series(rollup, "steps", period="year")
    assert series.metric_series(rollup.limit(0), "steps").count() == 0
    # A weighted mean of days that differ in samples.
    days = [("2026-03-02", "HKQuantityTypeIdentifierRestingHeartRate", "W", "u", v, None) for v in (60.0, 62.0, 64.0)] + [("2026-03-03", "HKQuantityTypeIdentifierRestingHeartRate", "W", "u", 50.0, None)]
    hr = series.daily_rollup(record(spark, days))
    assert series.metric_series(hr, "resting-hr", "week").first()["value"] == 59.0
    assert series.overall(series.metric_series(hr, "resting-hr"), "avg").first()["value"] == 59.0
    assert series.period_view(hr, "week").first()["avg_value"] == 59.0


def ride(i, day, minutes, unit="min", km=None, hr=None, start=0.0, source="W"):
    return (i, "Cycling", minutes, unit, km, "km", None, None, source, date.fromisoformat(day), start, None), (i, "statistic", "hr:average", hr, None, "bpm")


@pytest.fixture
def rides(spark):
    rows = [ride(1, "2025-03-03", 40.0, km=10.0, hr=140.0, start=0.0), ride(2, "2025-03-05", 50.0, hr=None, start=100_000.0), ride(3, "2025-03-10", 1800.0, "s", hr=130.0, start=200_000.0), ride(4, "2025-03-12", 30.0, hr=120.0, start=300_000.0), ride(5, "2025-03-18", None, hr=100.0, start=400_000.0)]
    w = spark.createDataFrame([r[0] for r in rows], "id int, activity_type string, duration double, duration_unit string, total_distance double, total_distance_unit string, total_energy double, total_energy_unit string, source_name string, local_date date, start_epoch double, indoor boolean")
    s = spark.createDataFrame([r[1] for r in rows], "workout_id int, kind string, key string, value_num double, value_text string, unit string")
    return w, s


def test_workout_series(spark, rides):
    w, s = rides
    record = spark.createDataFrame([("hr", t) for t in (0.0, 2400.0, 2400.1, 200_000.0, 201_800.0)], "type string, start_epoch double")
    got = {r["period"]: r for r in workouts.workout_series(w, s, "week", ["hr:average"], ["percentile", "speed"], record=record).collect()}
    first, mixed, none = got["2025-03-03"], got["2025-03-10"], got["2025-03-17"]
    assert first["duration"]["value"] == 90 and first["m0"]["value"] == 140 and (first["m0_n"], first["m0_missing"]) == (1, 1) and first["speed"]["value"] == 15
    assert mixed["duration"]["value"] is None and mixed["duration"]["unit"] == "mixed" and mixed["m0"]["value"] == 125
    assert mixed["percentile"]["p50"] == 120 and mixed["percentile"]["p90"] == 130
    assert none["duration"]["value"] is None and none["duration"]["unit"] is None
    assert first["depth"]["hr"]["counts"] == [0, 2] and mixed["depth"]["hr"]["median"] == 1
    assert none["depth"]["hr"]["without"] == 1 and none["depth"]["hr"]["reasons"] == ["workout has no duration"]
    for bad in ({"derive": ["nope"]}, {"derive": ["ratio"], "ratio_of": ["a"]}, {"percentile_of": "x"}, {"record": record}):
        with pytest.raises(ValueError):
            workouts.workout_series(w, s, **bad)
    with pytest.raises(ValueError):
        workouts.workout_detail(w, s, derive=["ratio"])
    listed = workouts.list_workouts(w, 2).collect()
    assert [r["id"] for r in listed] == [5, 4]


def test_ratio_of_measures(spark, rides):
    w, s = rides
    both = s.union(s.withColumns({"key": F.lit("hr:maximum"), "value_num": F.col("value_num") * 2}))
    got = workouts.workout_series(w, both, "month", ["hr:maximum", "hr:average"], ["ratio"], ratio_of=["hr:maximum", "hr:average"]).first()
    assert got["ratio"]["value"] == 2
    units = both.withColumn("unit", F.when(F.col("workout_id") == 1, "other").otherwise(F.col("unit")))
    refused = workouts.workout_series(w, units, "month", ["hr:maximum", "hr:average"], ["ratio"], ratio_of=["hr:maximum", "hr:average"]).first()
    assert refused["ratio"]["value"] is None and "more than one unit" in refused["ratio"]["reason"]


LAB = "id int, analyte_key string, collected_date string, value_num double, value_text string, unit string, ref_text string, ref_low double, ref_high double, flag string, via_ocr boolean, source string"


def lab(spark, rows):
    return spark.createDataFrame([(i, "k", d, v, None, "u", "r" if rng else None, 10.0, 20.0, flag, ocr, src) for i, (d, v, src, rng, ocr, flag) in enumerate(rows)], LAB)


def test_collapse(spark):
    rows = [("d1", 15.0, "pdf", False, True, None), ("d1", 15.0, "fhir", True, False, None), ("d1", 15.0, "pdf", True, False, None), ("d2", 15.0, "pdf", True, False, None), ("d2", 15.0, "pdf", True, False, None), ("d3", 11.0, "pdf", True, False, None), ("d3", 12.0, "fhir", True, False, None), (None, 9.0, "fhir", True, False, None)]
    got = sorted((r["id"], r["also_from"], r["clash"]) for r in labs.collapse(lab(spark, rows)).collect())
    # Two of the three of d1 stay (a report has two), both with a range; the first not from the health system is also from it.
    assert got == [(1, ["pdf"], False), (2, ["fhir"], False), (3, [], False), (4, [], False), (5, [], True), (6, [], True), (7, [], False)]


@pytest.mark.parametrize(
    "draws, kind",
    [
        ([("d1", 15.0, None), ("d2", 25.0, None)], "lab_out_of_range"),
        ([("d1", 25.0, None), ("d2", 15.0, None)], "lab_returned_to_range"),
        ([("d1", 15.0, None), ("d2", 19.5, None)], "lab_near_limit"),
        ([("d1", 20.0, None), ("d2", 19.5, None)], None),
        ([("d1", 15.0, "N")], "lab_out_of_range"),
        ([("d1", 15.0, None), ("d2", 15.0, None), ("d2", 16.0, None)], "lab_sources_disagree"),
        ([(None, 25.0, None)], None),
    ],
)
def test_lab_signals(spark, draws, kind):
    got = labs.lab_signals(lab(spark, [(d, v, "pdf", True, False, f) for d, v, f in draws])).collect()
    assert [r["kind"] for r in got] == ([kind] if kind else [])


def test_windows(spark):
    hr = "HKQuantityTypeIdentifierRestingHeartRate"
    anchor = date(2023, 2, 18)
    rows = [((anchor + timedelta(days=d)).isoformat(), hr, "W", "bpm", v, None) for d, v in [*zip(range(-7, 0), range(60, 67), strict=True), (0, 99), *zip(range(1, 7), range(64, 70), strict=True)]]
    rows += [(f"{y}-01-{d:02d}", hr, s, "bpm", base + d % 3, None) for y, base, s in ((2022, 58, "A"), (2024, 70, "B")) for d in range(1, 32)]
    rollup = series.daily_rollup(record(spark, [(d, t, s, u, float(v), c) for d, t, s, u, v, c in rows]))
    spec = windows.Spec(metric="resting-hr")
    got = windows.window(spec, "2023-02-18", 7, 7, rollup=rollup).first()
    assert (got["before"]["n"], got["before"]["median"], got["after"]["n"], got["after"]["empty_periods"], got["verdict"]) == (7, 63, 6, 1, "ok")
    apart = windows.compare(spec, ("2022-01-01", "2022-01-31"), ("2024-01-01", "2024-01-31"), rollup=rollup).first()
    assert apart["verdict"] == "no_overlap" and apart["devices_differ"]
    assert windows.compare(spec, ("2021-01-01", "2021-01-31"), ("2024-01-01", "2024-01-31"), rollup=rollup).first()["verdict"] == "insufficient_data"
    assert windows.compare(spec, ("2024-01-01", "2024-01-01"), ("2024-01-01", "2024-01-31"), rollup=rollup).first()["verdict"] == "thin_on_one_side"
    fact = spark.createDataFrame([("Torn ligament", "2023-02-18"), ("Torn ligament", "2023-02-18T10:00"), ("Torn nail", "2020-01-01"), ("Cold", None)], "name string, onset_date string")
    assert windows.resolve_anchor(fact, named="ligament") == ("2023-02-18", ["2023-02-18"])
    assert windows.resolve_anchor(fact, named="torn") == (None, ["2020-01-01", "2023-02-18"]) and windows.resolve_anchor(fact, named="flu") == (None, [])
    for bad in (windows.Spec(metric="nope"), windows.Spec(metric="sleep"), windows.Spec(metric="steps", workouts=True), windows.Spec(), windows.Spec(workouts=True, derive="ratio")):
        with pytest.raises(ValueError):
            bad.checked()
    with pytest.raises(ValueError):
        windows.anchored("2023-02-18", 0, 5)
    with pytest.raises(ValueError):
        windows.resolve_anchor(fact)
    assert windows.expected_periods("2026-01-01", "2026-02-01", "month") == 2 and windows.expected_periods("2026-03-01", "2026-03-02", "week") == 2


def test_window_of_workouts_substitutes(rides):
    w, s = rides
    spans = ("2025-03-01", "2025-03-07"), ("2025-03-08", "2025-03-14")
    out, said = windows.compare_or_substitute(windows.Spec(workouts=True, measure="none:sum"), *spans, "week", workout=w, stat=s)
    assert said and out.first()["before"]["high"] == 90 and out.first()["verdict"] == "unit_mixed_on_one_side"
    out, said = windows.compare_or_substitute(windows.Spec(workouts=True, measure="hr:average"), *spans, "week", workout=w, stat=s)
    assert not said and out.first()["verdict"] == "thin_on_one_side"


def test_shifts(spark):
    day = date(2026, 3, 31)
    rows = [("steps", day - timedelta(days=i), 1000.0 if i < 10 else 2000.0, ["W"]) for i in range(20)] + [("weight", day, 80.0, ["S"])]
    df = spark.createDataFrame(rows, "metric string, date date, value double, sources array<string>")
    got = {r["metric"]: r for r in windows.metric_shifts(df, 10).collect()}
    assert got["steps"]["shifted"] and got["steps"]["recent_mean"] == 1000 and not got["steps"]["devices_differ"]
    assert got["weight"]["gap"] == "recent" and not got["weight"]["shifted"]


def test_writes(spark):
    old = spark.createDataFrame([("a", 1, "x"), (None, 2, "y")], "k string, seq int, status string")
    new = spark.createDataFrame([("a", 3, "z"), ("b", 5, "p"), ("b", 4, "q"), (None, 6, "r")], "k string, seq int, status string")
    assert [tuple(r) for r in writes.insert_ignore(old, new, ["k"], "seq").collect()] == [("b", 4, "q")]
    assert writes.last_wins(new, ["k"], "seq").filter("k = 'b'").first()["seq"] == 5
    upserted = {r["k"]: (r["seq"], r["status"]) for r in writes.upsert_changed(old.filter("k = 'a'"), new.filter("seq in (3, 5)"), "k", "status", []).collect()}
    assert upserted == {"a": (1, "z"), "b": (5, "p")}
    assert sorted(r["seq"] for r in writes.replace_by(old.filter("k = 'a'"), new.filter("k = 'a'"), "k").collect()) == [3]
    article = spark.createDataFrame([("1", False), ("2", True), ("3", None)], "pmid string, retracted boolean")
    marked, newly = writes.mark_retracted(article, spark.createDataFrame([("1",), ("2",), ("9",)], "pmid string"))
    assert sorted(map(tuple, marked.select("pmid", "retracted").collect())) == [("1", True), ("2", True), ("3", False)] and [r["pmid"] for r in newly.collect()] == ["1"]


def test_documents_and_holdings(spark):
    doc = spark.createDataFrame([(1, "/a", "pdf", None), (2, "/b", "note", "2026-01-01"), (3, "/c", "fhir", None), (4, "/d", "image", None)], "id long, path string, kind string, doc_date string").withColumns({"ingested_at": F.lit("2026-02-01"), "fhir_resource_type": F.lit("DocumentReference")})
    tag = spark.createDataFrame([(2, "sleep"), (2, "b"), (4, "sleep")], "document_id long, tag string")
    chunk = spark.createDataFrame([(10, 2, None)], "id long, document_id long, embedded_with string")
    held = spark.createDataFrame([], "document_id long, extracted_by string, collected_date string, analyte_key string")
    listed = documents.list_documents(doc, held, chunk, tag).collect()
    assert [(r["id"], r["chunks"], r["tags"]) for r in listed] == [(2, 1, "b, sleep"), (1, 0, None), (4, 0, "sleep")]
    assert [r["id"] for r in documents.list_documents(doc, held, chunk, tag, "note").collect()] == [2, 4]
    assert [r["tag"] for r in documents.tags_matching(tag, "how did I #Sleep?").collect()] == ["sleep"]
    empty = spark.createDataFrame([], "kind string, onset_date string, local_date string")
    rows = clinical.holdings(empty, empty, held, doc).collect()
    assert clinical.holdings_phrase(rows) == "1 note references" and clinical.holdings_phrase([]) == "nothing"


def test_first_statistic_stays_and_keys_meet(spark):
    maps = [{"type": "HR", "average": "150", "unit": "bpm"}, {"type": "HR", "average": "140", "unit": "bpm"}]
    workout = spark.createDataFrame([(1, maps, {"HR:average": "7", "note": "x"})], "id long, statistics array<map<string,string>>, metadata map<string,string>")
    stat = workouts.stat_rows(workout)
    assert sorted((r["kind"], r["key"], r["value_num"]) for r in stat.collect()) == [("metadata", "HR:average", 7.0), ("metadata", "note", None), ("statistic", "HR:average", 150.0)]
    held = workouts.with_measures(workout.select("id"), stat, ["HR:average", "none"]).first()["measures"]
    assert (held["HR:average"]["kind"], held["HR:average"]["value"], held["none"]) == ("statistic", 150.0, None)


def test_a_stage_with_and_without_its_prefix(spark):
    from vitalspan.operators import sleep

    kind, prefix = C.SLEEP_TYPE, C.SLEEP_VALUE
    rows = [(kind, s, "Ring", 600.0 * (i + 1), f"2026-03-04 2{i}:00:00 +0000", f"2026-03-04 2{i}:30:00 +0000", date(2026, 3, 4)) for i, s in enumerate((prefix + "InBed", "InBed", prefix + "AsleepCore", "AsleepCore"))]
    night = sleep.sleep_nights(spark.createDataFrame(rows, "type string, value_text string, source_name string, duration_sec double, start_date string, end_date string, local_date date")).first()
    assert night["stages"] == {"InBed": 1800.0, "AsleepCore": 4200.0} and (night["in_bed_seconds"], night["asleep_seconds"]) == (600.0, 1800.0)


def test_sample_depth_of_an_absurd_duration(spark):
    rides = spark.createDataFrame([(1, 0.0, 1e12, "hr"), (2, 7200.0, 1.0, "hr"), (3, 1e9, 1.0, "hr")], "id long, start_epoch double, duration double, duration_unit string")
    record = spark.createDataFrame([("T", float(x)) for x in (10, 7300, 9000, 20000)], "type string, start_epoch double")
    assert {(r["id"], r["count"]) for r in workouts.sample_depth(rides, record, ["T"]).collect()} == {(1, 4), (2, 2), (3, 0)}


def test_sample_depth_is_that_of_all_pairs(spark):
    rng = random.Random(5)
    at = lambda: rng.choice([float(rng.randrange(9000)), rng.randrange(9_000_000) / 1000, 500.0, -3600.0, 86400.0 * rng.randrange(3)])
    record = [(rng.choice("TUV"), at()) for _ in range(400)] + [("T", None), (None, 5.0)]
    rides = [(i, at(), rng.choice([0.0, 0.25, 1.0, 90.0, 1e12, -1.0, None, float("nan")]), rng.choice(["s", "min", "hr", "??"])) for i in range(300)] + [(300, None, 1.0, "s"), (301, 500.0, 0.0, "s"), (301, 500.0, 0.0, "s")]
    got = workouts.sample_depth(spark.createDataFrame(rides, "id long, start_epoch double, duration double, duration_unit string"), spark.createDataFrame(record, "type string, start_epoch double"), ["T", "U"])
    scale, want = {"s": 1, "min": 60, "hr": 3600}, {}
    for i, start, long, unit in rides:
        for t in "TU":
            usable = long is not None and long == long and unit in scale
            met = sum(start is not None and x is not None and k == t and start <= x <= start + long * scale[unit] for k, x in record) if usable else None
            want[i, t] = met if met is None else want.get((i, t), 0) + met
    assert {(r["id"], r["type"]): r["count"] for r in got.collect()} == want and sum(n or 0 for n in want.values()) > 5000


def joined_rows(plan):
    """How many rows each join of an executed plan gave."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return joined_rows(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return joined_rows(plan.plan())
    own = [plan.metrics().apply("numOutputRows").value()] if "Join" in plan.nodeName() else []
    return own + [n for i in range(plan.children().size()) for n in joined_rows(plan.children().apply(i))]


def test_sample_depth_makes_no_pairs(spark):
    """Every ride holds every record, 20 million pairs: no join gives more rows than there are bounds and instants."""
    rides = spark.range(1000).select("id", F.col("id").cast("double").alias("start_epoch"), F.lit(9.0).alias("duration"), F.lit("hr").alias("duration_unit"))
    record = spark.range(20_000).select(F.lit("T").alias("type"), (F.lit(3000) + F.col("id") / 1000).alias("start_epoch"))
    depth = workouts.sample_depth(rides, record, ["T"])
    assert {r["count"] for r in depth.collect()} == {20_000}
    rows = joined_rows(depth._jdf.queryExecution().executedPlan())
    assert rows and max(rows) <= 22_000


def test_all_categories_are_looked_through(spark):
    from vitalspan.sources import fhir

    def of(category):
        import json

        return (json.dumps({"resourceType": "Observation", "id": "1", "category": category}),)

    cases = [of([{"coding": [{"display": "x"}]}, {"coding": [{"system": "s"}, {"code": "laboratory"}]}]), of([{"text": ""}, {"text": "Laboratory"}]), of({"text": "vital"}), of(["plain"]), of([]), ('{"resourceType": "Observation"}',)]
    df = spark.createDataFrame(cases, "content string").select(F.try_parse_json("content").alias("v"))
    assert [r[0] for r in df.select(fhir.category()).collect()] == ["laboratory", "Laboratory", "vital", "plain", None, None]


def test_accents_of_all_letters(spark):
    from vitalspan.search import keyword

    df = spark.createDataFrame([("Ünï Žluťoučký ấ ōsaka naïve",)], "t string")
    assert df.select(keyword.words("t")).first()[0] == ["uni", "zlutoucky", "a", "osaka", "naive"]
