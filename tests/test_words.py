"""Words, citations, discovery, archives, and research beside flagged results."""

import json
import zipfile

from test_system import article

from vitalspan import ingest, report
from vitalspan.catalog import Catalog
from vitalspan.functions import words
from vitalspan.sources import fhir, texts


def test_words():
    assert [words.unit_in_words(u) for u in (None, "unlabelled", "bpm")] == ["no unit at all", "no unit named", "bpm"]
    assert words.activity_name("HKWorkoutActivityTypeRunning") == "Running" and words.activity_name(None) == "workout"
    assert [words.number_in_words(x) for x in (None, 60.0, 1234.56, 0.04)] == ["no number", "60", "1,234.6", "0"]
    assert words.span_in_words("a", "b") == "a to b" and words.span_in_words("a", "a") == "a" and words.span_in_words(None, None) == ""
    assert words.tier_at_least("rct", "observational") and not words.tier_at_least("unknown", "case_report") and not words.tier_at_least("case_report", "rct")
    assert texts.document_title("\n--\n12 34\nLab report of March\nmore") == "Lab report of March" and texts.document_title("1 2") is None


def test_citations(spark):
    df = spark.createDataFrame([("pdf", "/r/a.pdf", 2, None, None), ("note", "/n/b.md", None, "Day > Head", "2026-03-14"), ("fhir", "/c/c.json", None, None, None)], "kind string, path string, page_no int, section string, doc_date string")
    assert [r[0] for r in df.select(words.passage_citation()).collect()] == ["a.pdf, p. 2", "b.md, 2026-03-14, Day > Head", "c.json"]
    arts = spark.createDataFrame([("Sleep.", "J", 2020, "1")], "title string, journal string, year int, pmid string")
    assert arts.select(words.article_citation()).first()[0] == "Sleep, J, 2020, PMID 1"


def test_discovery_and_archives(spark, tmp_path):
    (tmp_path / "a" / "clinical-records").mkdir(parents=True)
    one = json.dumps({"resourceType": "Condition", "id": "1", "code": {"text": "Asthma"}})
    for name in ("export.xml", "clinical-records/x.json", "report.pdf", "note.md", ".hidden.md"):
        (tmp_path / "a" / name).write_text(one)
    with zipfile.ZipFile(tmp_path / "a" / "all.zip", "w") as z:
        z.writestr("apple/clinical-records/c1.json", one)
        z.writestr("apple/other/c2.json", one)
    found = ingest.discover(spark, str(tmp_path))
    assert {k: [p.rsplit("/", 1)[1] for p in v] for k, v in found.items()} == {"archive": ["all.zip"], "clinical": ["clinical-records"], "export": ["export.xml"], "note": ["note.md"], "report": ["report.pdf"]}
    held = fhir.read_archive(spark, str(tmp_path / "a" / "all.zip")).collect()
    assert [(r["member"], json.loads(r["content"])["id"]) for r in held] == [("c1.json", "1")]


def test_lab_context(spark, tmp_path):
    corpus = Catalog.open(spark, str(tmp_path / "c"), "corpus", create=True)
    rows = [article(str(i), [t], "LDL cholesterol falls.", "LDL") for i, t in enumerate(("Letter", "Observational Study", "Meta-Analysis", "Randomized Controlled Trial"))]
    from vitalspan.sources.medline import FIELDS

    ingest.install_pack(corpus, "p", spark.createDataFrame([[r.get(c) for c in FIELDS] for r in rows], ", ".join(f"{c} {t}" for c, t in FIELDS.items())))
    sheet = report.Sheet("2026-01-01", 30, [report.Signal("lab_out_of_range", "ldl", "LDL cholesterol", {})], [], {})
    (context,) = report.lab_context(sheet, corpus)
    assert [f["pmid"] for f in context["findings"]] == ["2", "3"] and "PMID 2" in context["findings"][0]["citation"]
    assert report.attach_literature(sheet, corpus).signals[0].finding["pmid"] == "2"
