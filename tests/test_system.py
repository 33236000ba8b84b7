"""Catalog, ingest, search, tools, guard, sheet and stream together, on small files."""

import gzip
import json
from datetime import date

import pytest
from pyspark.sql import functions as F
from test_sources import export, record, wearable_export  # noqa: F401

from vitalspan import guard, ingest, report, tools
from vitalspan.catalog import Catalog, NotFound, RollupMissing, VersionMismatch
from vitalspan.search import corpus as literature
from vitalspan.search import keyword, vectors
from vitalspan.sources import medline
from vitalspan.streaming import records as stream


@pytest.fixture
def index(spark, tmp_path, wearable_export):  # noqa: F811
    catalog = Catalog.open(spark, str(tmp_path / "index"), create=True)
    ingest.ingest_export(catalog, wearable_export)
    return catalog


def test_catalog_guards(spark, tmp_path):
    path = str(tmp_path / "c")
    with pytest.raises(NotFound):
        Catalog.open(spark, path)
    c = Catalog.open(spark, path, create=True)
    assert c.table("record").count() == 0 and c.fact("x") is None
    c.set_fact("x", "1")
    assert Catalog.open_for_read(spark, path).fact("x") == "1"
    c.write("record", spark.createDataFrame([("t", 1.0)], "type string, value_num double"))
    with pytest.raises(RollupMissing):
        Catalog.open_for_read(spark, path)
    c.rebuild_rollup()
    assert Catalog.open_for_read(spark, path).table("daily_metric").first()["n"] == 1
    def relabel(version):
        c._save(c._state() | {"version": version})

    relabel(99)
    with pytest.raises(VersionMismatch):
        Catalog.open(spark, path)
    relabel(5)
    assert Catalog.open_for_read(spark, path)._state()["version"] == 6
    corpus = Catalog.open(spark, str(tmp_path / "k"), "corpus", create=True)
    corpus._save(corpus._state() | {"version": 4})
    assert Catalog.open_for_read(spark, str(tmp_path / "k"), "corpus")._state()["version"] == 5
    assert Catalog.open_for_read(spark, str(tmp_path / "k"), "corpus").table("refresh_log").count() == 0
    c.reset()
    with pytest.raises(NotFound):
        Catalog.open(spark, path)


def test_catalog_appends_and_transactions(spark, tmp_path, monkeypatch):
    c = Catalog.open(spark, str(tmp_path / "c"), create=True)
    row = lambda t, v: spark.createDataFrame([(t, v)], "type string, value_num double")
    c.append("record", row("a", 1.0))
    first = c._state()["tables"]["record"]
    assert c.append("record", row("b", 2.0)).count() == 1
    assert c._state()["tables"]["record"][:1] == first and c.table("record").count() == 2  # what was there stays as it was
    with pytest.raises(ZeroDivisionError), c.transaction():
        c.append("record", row("c", 3.0))
        c.write("characteristic", spark.createDataFrame([("k", "v")], "key string, value string"))
        assert c.table("record").count() == 3
        1 / 0  # noqa: B018
    assert c.table("record").count() == 2 and c.table("characteristic").count() == 0
    assert len([x for x in (tmp_path / "c").iterdir() if x.name.startswith("record-")]) == 2
    # A pointer that can't be written leaves the one before.
    monkeypatch.setattr(c, "_save", lambda state: (_ for _ in ()).throw(OSError()))
    with pytest.raises(OSError):
        c.set_fact("x", "1")
    monkeypatch.undo()
    assert Catalog.open(spark, str(tmp_path / "c")).table("record").count() == 2
    monkeypatch.setattr(Catalog, "FOLDERS", 3)
    for i in range(3):
        c.append("record", row("d", float(i)))
    assert len(c._state()["tables"]["record"]) == 2 and c.table("record").count() == 5
    for path in ("/home/o'brien/export.xml", "b", "/home/o'brien/export.xml"):
        c.note_file(path, "export", "h", 1, 1, "complete")
    assert sorted(r["path"] for r in c.table("source_file").collect()) == ["/home/o'brien/export.xml", "b"]


def test_a_crash_between_records_and_rollup_is_made_good(spark, index, tmp_path, monkeypatch):  # noqa: F811
    other = Catalog.open(spark, str(tmp_path / "o"), create=True)
    rows = index.table("record")
    refresh = stream.series.rollup_of
    monkeypatch.setattr(stream.series, "rollup_of", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        stream.absorb(other, rows)
    assert other.table("record").count() == 0
    monkeypatch.setattr(stream.series, "rollup_of", refresh)
    assert stream.absorb(other, rows) == 20 and stream.absorb(other, rows) == 0
    assert other.table("daily_metric").count() == index.table("daily_metric").count() > 0


def test_exports_of_more_than_two_gigabytes(spark, tmp_path):
    from vitalspan.sources import streams, wearable

    path = tmp_path / "export.xml"
    with open(path, "wb") as f:  # sparse: only its ends take room
        f.write(b"<?xml version='1.0'?>\n<HealthData locale='x'>")
        f.seek(2_200_000_000)
        f.write(b"</HealthData>")
    wearable.check_root(spark, str(path))
    assert wearable.is_whole(spark, str(path)) and streams.listed(spark, str(path)).first()["length"] == 2_200_000_013
    small = tmp_path / "small.bin"
    small.write_bytes(b"abc" * 5_000_000)
    import hashlib

    assert streams.hashed(streams.listed(spark, str(small))).first()["sha256"] == hashlib.sha256(b"abc" * 5_000_000).hexdigest()


def test_ingest_is_idempotent(spark, index, wearable_export, tmp_path):  # noqa: F811
    def state():
        return {t: sorted(map(str, index.table(t).drop("seq").collect())) for t in ("record", "workout", "workout_stat", "daily_metric", "activity_summary", "characteristic")}

    before = state()
    assert len(before["record"]) == 20 and len(before["workout_stat"]) == 4
    assert ingest.ingest_export(index, wearable_export)["skipped"]
    again = ingest.ingest_export(index, wearable_export, force=True)
    assert again["records"] == 0 and state() == before
    cut = tmp_path / "cut.xml"
    cut.write_text("<HealthData>" + record("T", "2026-03-01 08:00:00 -0500", value=1) + '<Record type="x"')
    assert ingest.ingest_export(index, str(cut))["records"] == 1
    assert {r["path"]: r["status"] for r in index.table("source_file").collect()} == {wearable_export: "complete", str(cut): "partial"}


def test_clinical_ingest_takes_status_over(spark, tmp_path):
    index = Catalog.open(spark, str(tmp_path / "i"), create=True)
    (tmp_path / "c").mkdir()

    def save(status):
        (tmp_path / "c" / "a.json").write_text(json.dumps({"resourceType": "Condition", "id": "5", "code": {"text": "Asthma"}, "clinicalStatus": {"text": status}, "onsetDateTime": "2020-05-06"}))
        return ingest.ingest_clinical(index, str(tmp_path / "c"))

    save("active")
    save("resolved")
    assert [(r["status"], r["name"]) for r in index.table("clinical_fact").collect()] == [("resolved", "Asthma")]
    assert index.table("document").count() == 1


def test_tools(spark, index, tmp_path):
    ctx = tools.Context(index)
    ask = lambda name, **a: tools.dispatch(ctx, name, a)
    steps = ask("query_healthkit", metric="steps", start_date="2026-03-02", end_date="2026-03-02")
    assert steps["points"][0]["value"] == 6000 and steps["points"][0]["per_source"] == {"Watch": 6000, "Phone": 5500} and "multi_source_warning" in steps
    assert ask("query_healthkit", metric="resting-hr", period="week")["overall"]["value"] == 60.0
    assert ask("query_healthkit", metric="steps", start_date="2030-01-01")["no_data_in_range"]
    assert ask("query_healthkit", metric="blood pressure")["error"] == "unknown_metric"
    assert ask("query_healthkit", metric="sleep")["nights"][0]["source"] == "Watch"
    assert "error" in ask("query_healthkit", metric="steps", start_date="soon") and "error" in ask("nope") and "error" in ask("query_healthkit", wrong=1)
    assert ask("get_workouts")["summary"][0]["n"] == 1 and ask("get_workouts", period="week")["periods"][0]["duration"]["value"] == 30
    assert ask("get_workouts", activity="Running", indoor=True)["without_one_filter"] == {"indoor": 1}
    compared = ask("compare_windows", metric="resting-hr", anchor_date="2026-03-04", before_days=3, after_days=3)
    assert compared["verdict"] == "ok" and compared["left"]["n"] == 3 and "overlap" in compared["text"]
    assert ask("compare_windows", metric="resting-hr", anchor_fact="none")["error"] == "anchor_not_found"
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "2026-03-14.md").write_text("---\ntags: [headache]\n---\n# Head\nHeadaches were worse on training days.")
    assert ingest.ingest_notes(index, str(notes)) == 1 and ingest.ingest_notes(index, str(notes)) == 1
    assert index.table("chunk").count() == 1
    found = ask("search_records", query="headache train")
    assert found["search"] == "keyword" and found["hits"][0]["section"] == "Head"
    assert ask("search_records", query="zzz headache".replace("headache", "#headache").replace("zzz", ""))["hits"]
    embedder = vectors.HashingEmbedder(64)
    ctx.vectors, ctx.embed = vectors.embed_pending(index.table("chunk"), embedder), embedder.embed
    assert ask("search_records", query="training days")["search"] == "semantic"
    pages = spark.createDataFrame([(1, 1, "Collected: 03/10/2026\nGlucose   126  H   mg/dL   70-99", False), (2, 1, "Collected: 04/10/2026\nGlucose   98   mg/dL   70-99", True)], "document_id long, page_no int, text string, via_ocr boolean")
    assert ingest.ingest_pages(index, pages) == 2 and ingest.ingest_pages(index, pages) == 2
    trend = ask("get_lab_trend", analyte="Glucose")
    assert [(p["collected_date"], p["range_status"]) for p in trend["points"]] == [("2026-03-10", "out_of_range"), ("2026-04-10", "in_range")]
    assert ask("get_lab_trend", analytes=["glucose", "hdl"])["results"][1]["no_data_in_range"]
    assert ask("get_clinical_history")["held"] != "" and ask("get_clinical_history", kind="odd")["error"] and ask("get_clinical_vitals")["no_data_in_range"]
    assert json.loads(tools.serialize(tools.data_inventory(ctx)))["summary"]["records"] == 20
    assert {s["name"] for s in tools.schemas()} == set(tools.TOOLS)
    sheet = report.gather(index, 30, date(2026, 5, 1))
    assert [s.kind for s in sheet.signals] == ["lab_returned_to_range"] and any("Weight" in g or "Body mass" in g for g in sheet.gaps)
    text = report.render(sheet)
    assert "126 on 2026-03-10" in text and not guard.check(text)


def test_bm25_by_definition(spark):
    import math

    texts = ["the cat sat", "the dog sat on the cat", "a bird", "cats and dogs running", "Élan vital", ""]
    chunk = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = keyword.build_index(chunk)
    got = {r["id"]: r["score"] for r in keyword.bm25(*index, "cats? running", None).collect()}
    words = [[keyword.porter(w) for w in __import__("re").findall(r"\w+", t.lower().replace("é", "e"))] for t in texts]
    mean = sum(map(len, words)) / len(words)
    expect = {}
    for term in ("cat", "run"):
        df = sum(term in w for w in words)
        idf = math.log((len(words) - df + 0.5) / (df + 0.5))
        idf = idf if idf > 0 else 1e-6
        for i, w in enumerate(words):
            if tf := w.count(term):
                expect[i] = expect.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    assert got == pytest.approx(expect)
    assert keyword.bm25(*index, "elan").first()["id"] == 4 and keyword.bm25(*index, "?").count() == 0
    among = spark.createDataFrame([(1,)], "id long")
    assert [r["id"] for r in keyword.bm25(*index, "cat", among=among).collect()] == [1]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("vietnamization", "vietnam"), ("hopefulness", "hope"), ("formaliti", "formal"), ("electrical", "electr"), ("adjustment", "adjust"), ("adoption", "adopt"), ("effective", "effect"), ("probate", "probat"), ("rate", "rate"), ("controlling", "control"), ("sky", "sky"), ("as", "as")])
def test_porter(word, stem):
    assert keyword.porter(word) == stem


def test_vectors(spark):
    e = vectors.HashingEmbedder(32)
    one, none = e.embed(["Alpha beta", ""])
    assert sum(x * x for x in one) == pytest.approx(1) and not any(none)
    chunk = spark.createDataFrame([(1, "alpha beta", None), (2, "gamma", "old"), (3, "alpha", e.name)], "id long, text string, embedded_with string")
    made = vectors.embed_pending(chunk, e)
    assert sorted(r["chunk_id"] for r in made.collect()) == [1, 2]
    marked = vectors.mark_embedded(chunk, made, e.name)
    assert vectors.pending(marked, e.name).count() == 0
    hits = vectors.vector_search(made, one, 5, e.name).collect()
    assert hits[0]["chunk_id"] == 1 and hits[0]["score"] == pytest.approx(1, abs=1e-6)
    assert vectors.reclaim(made, chunk.filter("id = 1")).count() == 1

    calls = []

    def broken():
        calls.append(1)
        raise OSError

    once = vectors.OnceEmbedder(broken)
    assert once.embed(["x"]) is None and once.embed(["x"]) is None and len(calls) == 1


def article(pmid, types, abstract="Sleep helps.", title="Sleep", year=2020):
    return {"pmid": pmid, "title": title, "abstract": abstract, "pub_year": year, "publication_types": types, "mesh_terms": ["Sleep", "Humans"], "major_terms": ["Sleep"], **dict(zip(("evidence_tier", "evidence_rank", "tier_source"), __import__("vitalspan.constants", fromlist=["tier_of"]).tier_of(types), strict=True)), "retracted": False}


def test_corpus(spark, tmp_path):
    corpus = Catalog.open(spark, str(tmp_path / "corpus"), "corpus", create=True)
    pack = str(tmp_path / "sleep.jsonl.gz")
    medline.write_pack(pack, {"slug": "sleep"}, [article("1", ["Observational Study"], "Sleep sleep sleep."), article("2", ["Meta-Analysis"]), article("3", ["Clinical Trial Protocol"]), article("4", ["Letter"], year=None)])
    manifest, rows = medline.read_pack(spark, pack)
    ingest.install_pack(corpus, manifest["slug"], rows)
    ingest.install_pack(corpus, "other", rows.filter("pmid IN ('2', '4')"))
    chunk, arts = corpus.table("article_chunk"), corpus.table("article")
    index = keyword.build_index(chunk)
    order = lambda **f: [r["pmid"] for r in literature.keyword_search(index, chunk, arts, "sleep", **f).collect()]
    assert order()[:2] == ["2", "1"] and set(order()) == {"1", "2", "3", "4"}
    assert order(min_tier="observational") == ["2", "1"] and set(order(since_year=2021)) == {"4"}
    with pytest.raises(ValueError):
        order(min_tier="best")
    assert literature.in_several_packs(corpus.table("article_pack")).count() == 2
    assert [r["term"] for r in literature.topics(corpus.table("mesh_term")).collect()] == ["Sleep"]
    # Chunks of unchanged texts keep their ids, and what they were embedded with.
    corpus.write("article_chunk", chunk.withColumn("embedded_with", F.lit("e")))
    changed = rows.withColumn("abstract", F.when(F.col("pmid") == "1", "New words.").otherwise(F.col("abstract")))
    ingest.install_pack(corpus, "sleep", changed.filter("pmid <> '3'"))
    assert {r["pmid"]: r["embedded_with"] for r in corpus.table("article_chunk").collect()} == {"1": None, "2": "e", "4": "e"}
    with pytest.raises(KeyError):
        ingest.refresh_pack(corpus, "absent", rows, rows.select("pmid").limit(0), "2026-01-01")
    new = spark.createDataFrame([("9",)], "pmid string").join(rows.drop("pmid").limit(1))
    assert ingest.refresh_pack(corpus, "sleep", new, spark.createDataFrame([("2",), ("77",)], "pmid string"), "2026-01-02") == {"added": 1, "retracted": 1}
    assert literature.latest_refresh(corpus.table("refresh_log")).first()["added"] == 1
    assert {r["pmid"] for r in corpus.table("article").filter(literature.citable()).collect()} == {"1", "9"}
    ctx = tools.Context(Catalog.open(spark, str(tmp_path / "i"), create=True), corpus)
    found = tools.dispatch(ctx, "search_medical_literature", {"query": "sleep"})["findings"]
    assert found[0]["pmid"] == "2" and not found[0]["citable"]
    ingest.remove_pack(corpus, "sleep")
    assert {r["pmid"] for r in corpus.table("article").collect()} == {"2", "4"}
    with gzip.open(pack, "rt") as f:
        assert json.loads(f.readline())["article_count"] == 4


GUARDED = {
    "diagnosis": ["You have prediabetes.", "You have type two diabetes.", "Your results suggest that you have anemia.", "You likely have a mild iron deficiency.", "You are obese.", "The diagnosis is clear.", "These labs confirm that you do not have kidney disease.", "You were never diagnosed with asthma.", "You do not have diabetes.", "You aren't diabetic.", "You have no known allergies.", "You have no history of stroke."],
    "treatment": ["You should stop the pills.", "You need to take vitamin D.", "Take 400 mg daily.", "I recommend that you start magnesium.", "I suggest 500 mg a day."],
    "uncited_medical_claim": ["LDL below 100 is considered optimal.", "The normal range for ferritin is wide.", "Glucose of 100 to 125 mg/dL is classified as prediabetes.", "Diabetes: HbA1c \u2265 6.5%", "A TSH over 4 is generally considered high (PMID 12345678)."],
    None: ["Your notes say you were taking 2000 IU daily.", "Your clinical records list no diabetes; they don't mention it.", "According to your chart, you have no history of stroke.", "A TSH over 4 is generally considered high (PMID 42609254).", "Your ferritin of 12 is below the 15-150 range the report printed.", "HDL cholesterol: 48 mg/dL, above the >40 limit", "The report lists LDL above 130 as high.", "Your LDL went from 128 to 112 mg/dL.", "You have 12 workouts in March.", "You have had high readings twice.", "Your steps were above 10000 on 3 days.", "You may want to ask about it."],
}


@pytest.mark.parametrize("text, category", [(t, c) for c, listed in GUARDED.items() for t in listed])
def test_guard(text, category):
    assert {f.category for f in guard.check(text, returned_pmids={"42609254"})} == ({category} if category else set())


MORE = {
    "diagnosis": ["You have a rather stubborn form-free iron deficiency.", "Those values say you have early kidney disease.", "From this panel, you do not have diabetes.", "You have had no episode of arrhythmia.", "On most days of a long and otherwise quiet month, as far as one can see from here, and without any doubt at all, you are anemic."],
    "treatment": ["You should halve the tablets.", "You must be on 40 mg.", "I advise skipping it.", "I propose 20 mg at night.", "You need to quit taking it."],
    None: ["You have questions about asthma.", "You logged asthma attacks.", "You have walked with asthma in mind.", "You have no episode of apnea in your export.", "That long list says you have no allergies.", "You should ask about 20 minutes of walking."],
}


@pytest.mark.parametrize("text, category", [(t, c) for c, listed in MORE.items() for t in listed])
def test_guard_reads_phrases(text, category):
    assert {f.category for f in guard.check(text)} == ({category} if category else set())


def test_guard_applies(spark):
    out = guard.apply("You have anemia.", lambda t, flags: "Your report printed a hemoglobin of 10.", ["get_lab_trend"])
    assert out.rewritten and not out.blocked and out.disclaimer and out.fired and guard.NOTICE in out.text
    kept = guard.apply("You have anemia.")
    assert kept.blocked and "go beyond" in kept.text
    assert [f.category for f in guard.check("I cannot interpret that.", used_tools=False)] == ["unhelpful_refusal"]
    assert guard.units("It rose, e.g. in May. Then (see Fig. 2) it fell! Yes\nNo? maybe. Next") == ["It rose, e.g. in May.", "Then (see Fig. 2) it fell!", "Yes", "No? maybe.", "Next"]
    assert guard.cited_pmids("PMIDs 12345678, 23456789 and PMID: 34567890") == {"12345678", "23456789", "34567890"}
    df = spark.createDataFrame([(1, "You have anemia."), (2, None)], "id int, text string")
    assert [len(r["flags"]) for r in guard.flagged(df).orderBy("id").collect()] == [1, 0]


def test_stream_equals_batch(spark, index, tmp_path):
    whole = {str(r["local_date"]) + r["type"]: r["sum_value"] for r in index.table("daily_metric").groupBy("local_date", "type").agg(F.sum("sum_value").alias("sum_value")).collect()}
    rows = index.table("record")
    folder = str(tmp_path / "in")
    rows.filter("seq % 2 = 0").write.parquet(folder)
    other = Catalog.open(spark, str(tmp_path / "other"), create=True)
    run = lambda: stream.ingest_stream(other, stream.record_stream(spark, folder, rows.schema), str(tmp_path / "cp")).awaitTermination(120)
    assert run()
    rows.write.mode("append").parquet(folder)  # late days, and what came before once more
    assert run()
    assert other.table("record").count() == 20
    assert {str(r["local_date"]) + r["type"]: r["sum_value"] for r in other.table("daily_metric").groupBy("local_date", "type").agg(F.sum("sum_value").alias("sum_value")).collect()} == whole
    live = stream.live_counts(stream.record_stream(spark, folder, rows.schema)).writeStream.outputMode("complete").format("memory").queryName("live").trigger(availableNow=True).start()
    assert live.awaitTermination(120) and spark.table("live").agg(F.sum("n")).first()[0] == 20 + rows.filter("seq % 2 = 0").count()
