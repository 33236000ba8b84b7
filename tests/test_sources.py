"""Exports, clinical JSON, notes, printed results, articles and packs, from generated inputs."""

import json
import zipfile

import pytest

from vitalspan.operators import labs, series, sleep, workouts
from vitalspan.sources import archives, exports, fhir, medline, texts, wearable

HR, STEPS = "HKQuantityTypeIdentifierRestingHeartRate", "HKQuantityTypeIdentifierStepCount"


def record(kind, start, end=None, value=None, source="Watch", unit="count", inner=""):
    value = "" if value is None else f' value="{value}"'
    unit = "" if unit is None else f' unit="{unit}"'
    return f'<Record type="{kind}" sourceName="{source}"{unit} creationDate="{start}" startDate="{start}" endDate="{end or start}"{value}>{inner}</Record>'


def export(tmp_path, body, name="export.xml", root="HealthData"):
    path = tmp_path / name
    path.write_text(f'<?xml version="1.0"?>\n<!DOCTYPE {root} [<!ELEMENT {root} (Record*)>]>\n<{root}>\n{body}\n</{root}>')
    return str(path)


@pytest.fixture
def wearable_export(tmp_path):
    rows = [record(HR, f"2026-03-0{i + 1} 08:00:00 -0500", value=v, unit="count/min") for i, v in enumerate((58, 60, 62, 59, 61, 57, 63))]
    rows += [record(STEPS, f"2026-03-02 0{h}:00:00 -0500", value=v) for h, v in ((7, 1000), (8, 2000), (9, 3000))]
    rows += [record(STEPS, f"2026-03-02 0{h}:30:00 -0500", value=v, source="Phone") for h, v in ((7, 2500), (8, 3000))]
    rows += [record(STEPS, "2026-03-08 23:30:00 -0500", value=5), record(STEPS, "2026-03-09 00:30:00 -0400", value=7)]
    pair = record("BP", "2026-03-03 09:00:00 -0500", value=120) + record("BP2", "2026-03-03 09:00:00 -0500", value=80)
    stage = "HKCategoryValueSleepAnalysis"
    night = [("InBed", "2026-03-04 22:30:00", "2026-03-04 23:00:00", "Watch"), ("AsleepCore", "2026-03-05 00:00:00", "2026-03-05 02:00:00", "Watch"), ("AsleepDeep", "2026-03-05 02:00:00", "2026-03-05 02:45:00", "Watch"), ("AsleepCore", "2026-03-05 00:00:00", "2026-03-05 01:00:00", "Ring")]
    rows += [record("HKCategoryTypeIdentifierSleepAnalysis", a + " -0500", b + " -0500", stage + s, source, None) for s, a, b, source in night]
    ride = """<Workout workoutActivityType="HKWorkoutActivityTypeRunning" duration="30" durationUnit="min" totalDistance="5" totalDistanceUnit="km" sourceName="Watch" startDate="2026-03-06 08:00:00 -0500" endDate="2026-03-06 08:30:00 -0500">
      <MetadataEntry key="HKIndoorWorkout" value="0"/><WorkoutStatistics type="HKQuantityTypeIdentifierHeartRate" average="150" minimum="110" maximum="175" unit="count/min"/></Workout>"""
    rings = '<ActivitySummary dateComponents="2026-03-01" activeEnergyBurned="100"/><ActivitySummary dateComponents="2026-03-01" activeEnergyBurned="200"/>'
    me = '<Me HKCharacteristicTypeIdentifierBloodType="A"/>'
    body = me + "\n".join(rows) + pair + f'<Correlation type="BP" startDate="2026-03-03 09:00:00 -0500" endDate="2026-03-03 09:00:00 -0500">{pair}</Correlation>' + ride + rings
    return export(tmp_path, body)


def test_records_only_within_a_correlation_are_left_out(spark, tmp_path):
    at = "2026-03-03 09:00:00 -0500"
    alone, both = record("ONLY_INSIDE", at, value=1), record("BESIDE", at, value=2)
    body = both + f'<Correlation type="BP" startDate="{at}" endDate="{at}">{alone}{both}</Correlation>' + record("PLAIN", at, value=3)
    path = export(tmp_path, body)
    assert {r["type"] for r in wearable.records(spark, path).collect()} == {"BESIDE", "PLAIN"}
    counts = wearable.ingest_counts(spark, path).first().asDict()
    assert counts == {"read": 2, "unusable": 0, "stored": 2, "numeric": 2, "nested": 2, "duplicate": 0}


def test_export_to_figures(spark, wearable_export):
    wearable.check_root(spark, wearable_export)
    found = wearable.records(spark, wearable_export).cache()
    assert found.count() == 7 + 7 + 2 + 4
    rollup = series.daily_rollup(found)
    total = {r["period"]: (r["value"], r["n"]) for r in series.metric_series(rollup, "resting-hr", "week").collect()}
    assert total["2026-02-23"] == (58.0, 1) and round(total["2026-03-02"][0], 4) == 60.3333
    day = {r["period"]: r for r in series.metric_series(rollup, "steps").collect()}["2026-03-02"]
    assert (day["value"], day["by_source"], day["multi_source"], day["source"]) == (6000, {"Watch": 6000, "Phone": 5500}, True, "Watch")
    assert {r["value"] for r in series.metric_series(rollup, "steps", combine="sum", start="2026-03-02", end="2026-03-02").collect()} == {11500}
    assert series.metric_series(rollup, "steps", source="Phone").first()["value"] == 5500
    # The date is the record's own, on either side of a change of offset.
    assert {str(r["local_date"]): r["sum_value"] for r in rollup.filter(f"type = '{STEPS}' AND local_date > '2026-03-05'").collect()} == {"2026-03-08": 5, "2026-03-09": 7}
    night = sleep.sleep_nights(found).first()
    assert (str(night["night"]), night["source"], night["asleep_seconds"], night["in_bed_seconds"], night["multi_source"]) == ("2026-03-04", "Watch", 9900, 1800, True)
    assert night["stages"] == {"InBed": 1800, "AsleepCore": 7200, "AsleepDeep": 2700}
    counts = wearable.ingest_counts(spark, wearable_export).first()
    assert counts["stored"] == 20 and counts["nested"] == 2 and counts["duplicate"] == counts["read"] - 20


def test_export_workouts(spark, wearable_export):
    w = wearable.workout_rows(spark, wearable_export)
    row = w.first()
    assert (row["duration"], row["duration_unit"], row["total_distance"], row["indoor"], row["total_energy"]) == (30, "min", 5, False, None)
    stats = workouts.stat_rows(w)
    held = {(r["kind"], r["key"].split(":")[-1]): (r["value_num"], r["unit"]) for r in stats.collect()}
    assert held == {("statistic", "average"): (150, "count/min"), ("statistic", "minimum"): (110, "count/min"), ("statistic", "maximum"): (175, "count/min"), ("metadata", "HKIndoorWorkout"): (0, None)}
    detail = workouts.workout_detail(w, stats, [workouts.HEART_RATE], ["pace", "speed", "efficiency"]).first()
    assert detail["pace"]["value"] == 6 and detail["speed"]["value"] == 10 and round(detail["efficiency"]["value"], 4) == 6.6667
    assert wearable.activity_summaries(spark, wearable_export).first()["active_energy"] == 200
    assert [tuple(r) for r in wearable.characteristics(spark, wearable_export).collect()] == [("HKCharacteristicTypeIdentifierBloodType", "A")]


def test_malformed_exports(spark, tmp_path):
    good = "2026-03-01 08:00:00 -0500"
    rows = [record(HR, good, value=1), record(HR, "someday", value=2), record(HR, "", value=3), record(HR, "2026-03-01 09:00:00 -0500", value="unknown"), record(HR, "2026-03-01T10:00:00", value=4, unit=None), record(HR, "2026-03-02 08:00:00 -0500", end="never", value="nan")]
    found = {r["start_date"]: r for r in wearable.records(spark, export(tmp_path, "\n".join(rows))).collect()}
    assert len(found) == 4
    assert (found["2026-03-01 09:00:00 -0500"]["value_num"], found["2026-03-01 09:00:00 -0500"]["value_text"]) == (None, "unknown")
    assert found["2026-03-01T10:00:00"]["start_epoch"] == 1772359200.0 and found["2026-03-01T10:00:00"]["unit"] is None
    assert [found["2026-03-02 08:00:00 -0500"][c] for c in ("value_num", "value_text", "duration_sec")] == [None, None, None]
    with pytest.raises(wearable.MalformedExport):
        wearable.check_root(spark, export(tmp_path, "", "other.xml", "Other"))
    cut = tmp_path / "cut.xml"
    cut.write_text("<HealthData>" + record(HR, good, value=1) + '<Record type="x" startDate="2026')
    assert wearable.records(spark, str(cut)).count() == 1


def test_export_from_archive_above_two_gigabytes(spark, tmp_path, wearable_export):
    archive = tmp_path / "export.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("apple_health_export/export_cda.xml", "<x/>")
        z.writestr("other/export.xml", "<other/>")
        z.fp.seek(2_200_000_000)  # a hole before the member: the archive is sparse, and far above what one row may hold
        z.start_dir = z.fp.tell()
        z.write(wearable_export, "apple_health_export/export.xml")
    assert archive.stat().st_size > 2_200_000_000
    path = str(archive)
    wearable.check_root(spark, path)
    found = wearable.elements(spark, path)
    assert wearable.is_whole(spark, found)
    key = lambda rows: sorted(str(r) for r in rows.collect())
    assert key(wearable.records(spark, found)) == key(wearable.records(spark, wearable_export))
    assert exports.export_member(["a/export_cda.xml"]) is None
    assert [p for p in tmp_path.iterdir() if p.name == "export.xml"] == [tmp_path / "export.xml"]


@pytest.mark.parametrize("size", [1, 7, 97, 500])
def test_ranges_of_an_export_find_each_element_once(spark, tmp_path, size):
    at = "2026-03-03 09:00:00 -0500"
    beat = '<HeartRateVariabilityMetadataList><InstantaneousBeatsPerMinute bpm="60" time="8"/><MetadataEntry key="no" value="no"/></HeartRateVariabilityMetadataList>'
    rows = [record("A", at, value="1 &gt; 0 &amp; &#228;", inner='<MetadataEntry key="k" value="a > b"/>' + beat), record("B", at, value=2).replace("></Record>", "/>"), "<!-- <Record type='no'/> -->"]
    inner = record("C", at, value=3) + record("D", at, value=4, inner="<MetadataEntry key='x'/>")
    body = "\n".join(rows) + inner + f'<Correlation type="BP"><MetadataEntry key="of" value="it"/>{inner}</Correlation>' + record("E", at, value=5) + "<Correlation type='empty'/>" + record("F", at)
    path = export(tmp_path, body)
    whole = wearable.elements(spark, path).drop("part")
    assert [(r["tag"], r["attributes"].get("type"), r["nested"]) for r in whole.orderBy("seq").collect() if r["tag"] == "Record"] == [("Record", x, n) for x, n in [("A", False), ("B", False), ("C", False), ("D", False), ("C", True), ("D", True), ("E", False), ("F", False)]]
    first = whole.filter("attributes['type'] = 'A'").first()
    assert first["attributes"]["value"] == "1 > 0 & ä" and [tuple(m) for m in first["metadata"]] == [("k", "a > b")]
    content = open(path, "rb").read()
    found = []
    for start in range(0, len(content), size):
        pieces = (content[i : i + 13] for i in range(start, len(content), 13))
        found += [(r[0], r[1], tuple(sorted(r[3].items()))) for r in exports.elements(pieces, start, start + size, start == 0)]
    known = [(r["seq"], r["tag"], tuple(sorted(r["attributes"].items()))) for r in whole.orderBy("seq").collect()]
    comment = content.index(b"<!--"), content.index(b"-->")
    inside = [x for x in found if comment[0] < x[0] < comment[1]]  # a range that begins within a comment takes it for markup
    assert [x for x in found if x not in inside] == known
    if size > 90:
        spread = exports.scan(spark, path, range_bytes=size).filter(f"seq NOT IN ({','.join(str(x[0]) for x in inside) or -1})")
        assert {(r["seq"], r["nested"]) for r in spread.collect()} == {(r["seq"], r["nested"]) for r in whole.collect()}


def test_clinical_json(spark, tmp_path):
    def save(name, obj):
        (tmp_path / name).write_text(obj if isinstance(obj, str) else json.dumps(obj))

    loinc = {"text": "CALCULATED LDL", "coding": [{"system": "http://loinc.org", "code": "13457-7"}]}
    save("lab.json", {"resourceType": "Observation", "id": "1", "category": [{"text": "Laboratory"}], "code": loinc, "valueQuantity": {"value": 128, "unit": "mg/dL"}, "referenceRange": [{"text": "<100", "high": {"value": 100}}], "interpretation": [{"text": "High"}], "effectiveDateTime": "2026-03-10T09:00:00Z"})
    save("text.json", {"resourceType": "Observation", "id": "2", "category": [{"coding": [{"code": "laboratory"}]}], "code": {"text": "Culture"}, "valueString": "none seen"})
    save("true.json", {"resourceType": "Observation", "id": "3", "category": [{"text": "vital-signs"}], "code": {"text": "Body Weight"}, "valueQuantity": {"value": True, "unit": "kg"}, "effectiveDateTime": "2026-03-11"})
    save("flag.json", {"resourceType": "Observation", "id": "9", "code": {"text": "Smoker"}, "valueBoolean": False})
    save("med.json", {"resourceType": "MedicationRequest", "id": "4", "status": "active", "authoredOn": "2026-01-02", "contained": [{"resourceType": "Medication", "code": {"text": "Aspirin", "coding": [{"system": "s", "code": "c"}]}}], "dosageInstruction": [{"text": "daily"}]})
    save("cond.json", {"resourceType": "Condition", "id": "5", "code": {"text": "Asthma"}, "clinicalStatus": {"coding": [{"code": "active"}]}, "recordedDate": "2020-05-06T00:00:00Z"})
    save("vax.json", {"resourceType": "Immunization", "id": "6", "vaccineCode": {"text": "Flu"}, "status": "completed", "occurrenceDateTime": "2025-10-01"})
    save("doc.json", {"resourceType": "DocumentReference", "id": "7", "type": {"text": "Visit note"}, "date": "2026-02-03T10:00:00Z", "content": [{"attachment": {"data": "SECRET"}}]})
    save("patient.json", {"resourceType": "Patient", "id": "8", "name": [{"text": "SECRET NAME"}]})
    save("broken.json", '{"resourceType": "Obser')
    out = fhir.ingest(fhir.read_members(spark, str(tmp_path)))
    found = {r["analyte"]: r for r in out["lab"].collect()}
    ldl = found["CALCULATED LDL"]
    assert [ldl[c] for c in ("analyte_key", "panel", "value_num", "unit", "ref_low", "ref_high", "flag", "collected_date")] == ["ldl", "lipids", 128, "mg/dL", None, 100, "High", "2026-03-10"]
    assert (found["Culture"]["value_text"], found["Culture"]["analyte_key"]) == ("none seen", "culture")
    vital = {r["metric_key"]: r for r in out["vital"].collect()}
    assert [vital["body_weight"][c] for c in ("value_num", "unit", "value_text", "local_date")] == [None, "kg", None, "2026-03-11"]
    assert vital["smoker"]["value_text"] == "False"
    assert {(r["kind"], r["name"], r["status"], r["onset_date"], r["detail_text"], r["code"]) for r in out["fact"].collect()} == {("medication", "Aspirin", "active", "2026-01-02", "daily", "c"), ("condition", "Asthma", "active", "2020-05-06", None, None), ("immunization", "Flu", "completed", "2025-10-01", None, None)}
    assert out["document"].count() == 8 and out["document_reference"].first()["title"] == "Visit note"
    assert {r["error"]: r["count"] for r in out["counts"].groupBy("error").sum("count").withColumnRenamed("sum(count)", "count").collect()} == {None: 9, "unreadable": 1}
    assert not any("SECRET" in str(r) for t in ("lab", "vital", "fact", "document") for r in out[t].collect())
    with pytest.raises(ValueError):
        fhir.ingest(fhir.read_members(spark, str(tmp_path)), "nothing")


def observation(i, name, value, **more):
    return json.dumps({"resourceType": "Observation", "id": str(i), "category": [{"text": "Laboratory"}], "code": {"text": name}, "valueQuantity": {"value": value, "unit": "mg/dL"}} | more)


def test_a_resource_is_stored_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    known = fhir.coded_key
    monkeypatch.setattr(fhir, "coded_key", lambda codings, name: 1 / 0 if name == "Bad" else known(codings, name))
    files = {"good": observation(1, "Glucose", 90), "bad": observation(2, "Bad", 1), "endless": observation(3, "Sodium", 7).replace("7", "1e400"), "cut": '{"resourceType": "Observ', "list": "[1]", "person": '{"resourceType": "Patient"}', "held": json.dumps({"resourceType": "Condition", "id": "5", "code": {"text": "Asthma"}})}
    for name, text in files.items():
        (tmp_path / f"{name}.json").write_text(text)
    out = fhir.ingest(fhir.read_members(spark, str(tmp_path)), "condition")
    assert out["counters"].first().asDict() == {"stored": 1, "unreadable": 2, "failed": 2, "skipped": 1, "ignored": 1}
    assert [r["analyte"] for r in out["lab"].collect()] == ["Glucose"] and [r["path"] for r in out["document"].collect()] == ["good.json"]
    assert {r["member"]: r["fault"] for r in out["faults"].collect()} == {"bad.json": "ZeroDivisionError", "endless.json": "value_num isn't finite"}


def test_clinical_archive_above_two_gigabytes(spark, tmp_path):
    path = tmp_path / "all.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(40):
            z.writestr(f"apple/clinical-records/{i:02}.json", observation(i, "Glucose", i) + " " * 2000)
        z.fp.seek(2_300_000_000)
        z.start_dir = z.fp.tell()
        z.writestr("apple/clinical-records/last.json", observation(99, "Glucose", 99))
        z.writestr("apple/elsewhere/no.json", "{}")
        z.writestr("apple/clinical-records/no.txt", "")
    with open(path, "r+b") as f:  # one member is damaged
        f.seek(f.read(10_000).index(b'"id": "3"') + 7)
        f.write(b"?")
    found = archives.members(spark, str(path), "*clinical-records/*.json", part_bytes=10_000)
    assert found.rdd.getNumPartitions() > 5 and found.filter("error IS NOT NULL").select("member", "error").collect() == [("apple/clinical-records/03.json", "BadZipFile")]
    held = fhir.read_archive(spark, str(path))
    assert held.count() == 41 and {r["member"] for r in held.collect()} == {f"{i:02}.json" for i in range(40)} | {"last.json"}
    out = fhir.ingest(held)
    assert out["lab"].count() == 40 and out["counters"].first()["unreadable"] == 1
    assert archives.members(spark, str(path), "*.pdf").count() == 0


def test_packs_are_trusted_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    import gzip

    monkeypatch.setattr(medline, "PIECE", 7)
    pack = tmp_path / "p.jsonl.gz"
    rows = [{"pmid": str(i), "title": f"line\u2028separated {i}", "abstract": "é" * i} for i in range(1200)]
    medline.write_pack(str(pack), {"slug": "p"}, rows)
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **k: 1 / 0)  # nothing of a pack passes through the driver
    manifest, found = medline.read_pack(spark, str(pack), str(tmp_path / "staged"))
    monkeypatch.undo()
    assert manifest["article_count"] == 1200 and {(r["pmid"], r["title"], len(r["abstract"])) for r in found.collect()} == {(r["pmid"], r["title"], len(r["abstract"])) for r in rows}
    body = gzip.decompress(pack.read_bytes())
    damages = {"cut": pack.read_bytes()[:-300], "short": gzip.compress(body[: body.rindex(b"{")]), "more": gzip.compress(body + b'{"pmid": "x"}\n'), "none": gzip.compress(b""), "text": b"no gzip", "other": gzip.compress(b'{"format": 9}\n')}
    for name, content in damages.items():
        (tmp_path / name).write_bytes(content)
        with pytest.raises(medline.PackError):
            medline.read_pack(spark, str(tmp_path / name), str(tmp_path / "staged"))


def test_notes(spark, tmp_path):
    (tmp_path / "2026-03-14 log.md").write_text("---\ntags: [Sleep, headache]\nextra: {a: 1}\n---\n# Day\nBad #night, not #1.\n## Later\n```\n# no heading\n```\ntext")
    (tmp_path / "plain.txt").write_text("just words")
    (tmp_path / ".hidden.md").write_text("no")
    noted = texts.notes(texts.read_notes(spark, str(tmp_path)))
    found = {r["title"]: r for r in noted.collect()}
    day = found["Day"]
    assert day["doc_date"] == "2026-03-14" and day["tags"] == ["sleep", "headache", "night"]
    assert [c["section"] for c in day["chunks"]] == ["Day", "Day > Later"] and "# no heading" in day["chunks"][1]["text"]
    assert found["plain"]["doc_date"] is None and texts.chunk_rows(noted).count() == 3
    meta, body = texts.front_matter("---\ntitle: 'T'\nn: 3\nlist:\n  - a\n  - b\nempty:\n---\nrest")
    assert meta == {"title": "T", "n": 3, "list": ["a", "b"]} and body == "rest"
    assert texts.front_matter("no front")[0] == {} and texts.note_date("2026-03-14T08:30:00Z") == "2026-03-14"


def test_chunks():
    assert texts.chunk_text("  ") == [] and texts.chunk_text("short") == ["short"]
    blocks = [f"{i} " + "x" * 400 for i in range(6)]
    pieces = texts.chunk_text("\n\n".join(blocks))
    assert len(pieces) == 3 and all(b in "".join(pieces) for b in blocks) and pieces[1].startswith("x" * 150 + "\n2 ")
    long = texts.chunk_text("\n".join(f"line {i} " + "y" * 100 for i in range(30)), overlap=0)
    assert max(map(len, long)) <= 1000 and sum(p.count("line") for p in long) == 30
    assert texts.chunk_abstract("a" * 1500 + "\n\n" + "b" * 1500) == ["a" * 1500, "b" * 1500]


@pytest.mark.parametrize(
    "line, expected",
    [
        ("Sodium, total   139     mmol/L    135 to 146", ("sodium", 139.0, None, "mmol/L", 135.0, 146.0, None)),
        ("Triglycerides\t204 High mg/dL  less than 150", ("triglycerides", 204.0, None, "mg/dL", None, 150.0, "HIGH")),
        ("Ferritin   < 5   L  ng/ml", ("ferritin", 5.0, "<5", "ng/ml", None, None, "L")),
        ("Platelets   1,204   K/uL   150-400 (see note)", ("platelets", 1204.0, None, "K/uL", 150.0, 400.0, None)),
        ("TSH   2.1   0.4 – 4.5", ("tsh", 2.1, None, None, 0.4, 4.5, None)),
        ("Folate   none   ng/ml", None),
        ("A1   5   mg/dL", None),
        ("eGFR   88   mL/min/1.73 >59", ("egfr", 88.0, None, "mL/min/1.73", 59.0, None, None)),
        ("Vitamin B12   >1500   pg/mL", ("vitamin_b12", 1500.0, ">1500", "pg/mL", None, None, None)),
        ("Hemoglobin Alc   5.9   %   4.0-5.5", ("hba1c", 5.9, None, "%", 4.0, 5.5, None)),
        ("Phone   555 1234", None),
        ("Patient ID      12345", None),
        ("prose without a column", None),
    ],
)
def test_result_lines(line, expected):
    r = texts.result_of_line(line)
    assert (r and tuple(r[c] for c in ("analyte_key", "value_num", "value_text", "unit", "ref_low", "ref_high", "flag"))) == expected


def test_result_tables_and_dates(spark):
    table = [["Test", "Result", "Flag", "Units", "Reference Range"], ["HDL", "37", "L", "mg/dL", ">40"], ["", "", "", "", ""], ["Sodium", "see note", "", "", ""]]
    found = texts.results_of_table(table)
    assert [(r["analyte_key"], r["value_num"], r["value_text"], r["ref_low"], r["flag"]) for r in found] == [("hdl", 37.0, None, 40.0, "L"), ("sodium", None, "see note", None, None)]
    bare = texts.results_of_table([["Potassium", "4.1", "mmol/L", "3.5-5.1"], ["Chloride", "100", "mmol/L", "98 to 107"]])
    assert [(r["analyte_key"], r["unit"], r["ref_high"]) for r in bare] == [("potassium", "mmol/L", 5.1), ("chloride", "mmol/L", 107.0)]
    assert texts.document_date(["no date", "Reported: 03/12/2026\nCollected: 03/10/2026"]) == "2026-03-10"
    pages = spark.createDataFrame([(1, 1, "Glucose   95   mg/dL   70-99\nnot a result"), (1, 2, None)], "document_id long, page_no int, text string")
    assert texts.lab_lines(pages).select("analyte_key", "page_no").collect() == [("glucose", 1)]
    boxes = [{"line": 1, "left": 0, "width": 30, "text": "HDL", "confidence": 90}, {"line": 1, "left": 200, "width": 20, "text": "39", "confidence": 90}, {"line": 2, "left": 0, "width": 30, "text": "xxx", "confidence": 5}]
    assert texts.reconstruct_columns(boxes) == "HDL" + " " * 17 + "39"


def test_articles_and_packs(spark, tmp_path):
    def article(pmid, types, title="T", extra="", year="<Year>2020</Year>"):
        listed = "".join(f"<PublicationType>{t}</PublicationType>" for t in types)
        return f"""<PubmedArticle><MedlineCitation><PMID>{pmid}</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate>{year}</PubDate></JournalIssue></Journal><ArticleTitle>{title}</ArticleTitle>
          <Abstract><AbstractText Label="AIM">why</AbstractText><AbstractText>what</AbstractText></Abstract><PublicationTypeList>{listed}</PublicationTypeList></Article>{extra}</MedlineCitation>
          <PubmedData><ArticleIdList><ArticleId IdType="doi">10/{pmid}</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""

    mesh = '<MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="Y">Sleep</DescriptorName></MeshHeading><MeshHeading><DescriptorName>Humans</DescriptorName></MeshHeading></MeshHeadingList>'
    gone = '<CommentsCorrectionsList><CommentsCorrections RefType="RetractionIn"><RefSource>J 2021</RefSource></CommentsCorrections></CommentsCorrectionsList>'
    path = tmp_path / "a.xml"
    path.write_text("<PubmedArticleSet>" + article(1, ["Review", "Meta-Analysis"], extra=mesh) + article(2, ["Clinical Trial Protocol", "Randomized Controlled Trial"], year="<MedlineDate>2019 Jan-Feb</MedlineDate>") + article(3, ["Letter"], extra=gone) + article("", ["Review"]) + "</PubmedArticleSet>")
    rows = medline.articles(spark, str(path))
    found = {r["pmid"]: r for r in rows.collect()}
    assert set(found) == {"1", "2", "3"}
    assert [found["1"][c] for c in ("abstract", "mesh_terms", "major_terms", "evidence_tier", "evidence_rank", "doi")] == ["AIM: why\n\nwhat", ["Sleep", "Humans"], ["Sleep"], "meta_analysis", 1, "10/1"]
    assert (found["2"]["evidence_tier"], found["2"]["evidence_rank"], found["2"]["pub_year"]) == ("protocol", None, 2019)
    assert (found["3"]["evidence_tier"], found["3"]["tier_source"], found["3"]["retracted"], found["3"]["retraction_note"]) == ("unknown", "unmapped", True, "J 2021")
    pack = str(tmp_path / "p.jsonl.gz")
    dicts = [r.asDict() | {"abstract": "one two"} for r in rows.collect()]
    medline.write_pack(pack, {"slug": "p"}, dicts)
    manifest, read = medline.read_pack(spark, pack)
    assert manifest["article_count"] == 3 and read.filter("abstract = 'one two'").count() == 3
    import gzip

    with gzip.open(pack, "rt") as f:
        text = f.read()
    with gzip.open(pack, "wt") as f:
        f.write(text.replace("one", "two"))
    with pytest.raises(medline.PackError):
        medline.read_pack(spark, pack)
    assert medline.month_slices("2024-01-20", "2024-03-02") == [("2024-01-20", "2024-01-31"), ("2024-02-01", "2024-02-29"), ("2024-03-01", "2024-03-02")]


def test_trend_of_two_reports(spark):
    lines = [("Glucose   95   mg/dL   70-99", "2026-03-10"), ("Glucose   101  H  mg/dL   70-99", "2026-04-10")]
    rows = [r | {"id": i, "collected_date": d, "document_id": 1, "page_no": 1, "via_ocr": False} for i, (text, d) in enumerate(lines) if (r := texts.result_of_line(text))]
    other = rows[0] | {"id": 7, "extracted_by": "fhir", "ref_text": None, "ref_low": None, "ref_high": None}
    lab = spark.createDataFrame([*rows, other], "id int, document_id int, page_no int, analyte string, analyte_key string, panel string, value_num double, value_text string, unit string, ref_low double, ref_high double, ref_text string, flag string, raw_line string, extracted_by string, collected_date string, via_ocr boolean")
    trend = labs.lab_trend(lab, key="glucose").collect()
    assert [(r["id"], r["also_from"], r["range_status"], r["clash"]) for r in trend] == [(0, ["fhir"], "in_range", False), (1, [], "out_of_range", False)]
