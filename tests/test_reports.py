"""Report files: one that fails costs no other, what comes again replaces, and only what is left is read again."""

from vitalspan import ingest
from vitalspan.catalog import Catalog
from vitalspan.sources import reports

BLOOD = "Harbour Clinic\nCollected: 03/10/2026\nGlucose   95   mg/dL   70-99\nSodium, total   139   mmol/L   135 to 146\nGlucose   95   mg/dL   70-99\f" + "Remarks on the second page.\n" * 60
TABLE = [["Test", "Result", "Flag", "Units", "Reference Range"], ["HDL", "37", "L", "mg/dL", ">40"], ["Ferritin", "see note", "", "", ""]]


def reader():
    """Pages as a reader of another format would give them, with a ruled table of which the lines show the same."""
    table = TABLE

    def printed(content):
        if b"POISON" in content:
            raise ZeroDivisionError("never to be seen: POISON")
        pages = reports.text_pages(content)
        if b"TABLE" in content:
            pages[0] |= {"tables": [table], "text": pages[0]["text"] + "\nHDL   37   L   mg/dL   >40", "extraction": "ocr"}
        return pages

    return printed


READERS = {"txt": reader()}


def test_one_bad_file_of_five(spark, tmp_path):
    folder, index = tmp_path / "in", Catalog.open(spark, str(tmp_path / "index"), create=True)
    folder.mkdir()
    for name, text in {"a": BLOOD, "b": "TABLE of results\nReported: 04/01/2026", "c": "POISON", "d": "Only one page\f \f", "e": " ", ".hidden": BLOOD}.items():
        (folder / f"{name}.txt").write_text(text)
    (folder / "other.doc").write_text(BLOOD)
    run = lambda **k: ingest.ingest_reports(index, str(folder), READERS, **k)
    first = run()
    assert first == {"documents": 4, "pages_text": 3, "pages_ocr": 1, "pages_empty": 3, "lab_values": 4, "lab_values_duplicate": 2, "chunks": first["chunks"], "unit_warnings": 0, "failed": 1, "unchanged": 0}
    name = lambda p: p.rsplit("/", 1)[1][0]
    assert {name(r["path"]): (r["status"], r["record_count"]) for r in index.table("source_file").collect()} == {"a": ("complete", 2), "b": ("complete", 2), "c": ("failed", 0), "d": ("partial", 0), "e": ("partial", 0)}
    held = {name(r["path"]): (r["title"], r["doc_date"], r["page_count"], r["extraction"]) for r in index.table("document").collect()}
    assert held == {"a": ("Harbour Clinic", "2026-03-10", 2, "text"), "b": ("TABLE of results", "2026-04-01", 1, "ocr"), "d": ("Only one page", None, 3, "text"), "e": ("e", None, 1, "none")}
    lab = {r["analyte_key"]: r for r in index.table("lab_result").collect()}
    assert {k: (r["value_num"], r["value_text"], r["extracted_by"], r["via_ocr"], r["collected_date"]) for k, r in lab.items()} == {"glucose": (95.0, None, "line", False, "2026-03-10"), "sodium": (139.0, None, "line", False, "2026-03-10"), "hdl": (37.0, None, "table", True, "2026-04-01"), "ferritin": (None, "see note", "table", True, "2026-04-01")}
    assert index.table("document_page").count() == 7 and index.table("chunk").filter("length(text) > 1200").isEmpty() and first["chunks"] == index.table("chunk").count() >= 5
    assert not any("POISON" in str(r) for t in index.schemas for r in index.table(t).collect())

    # Again: only what isn't complete is read. A mended file is stored, a changed one replaced wholesale.
    again = run()
    assert (again["unchanged"], again["documents"], again["failed"]) == (2, 2, 1) and index.table("lab_result").count() == 4
    (folder / "c.txt").write_text("Mended\nGlucose   99   mg/dL   70-99")
    (folder / "a.txt").write_text("Harbour Clinic\nGlucose   101   mg/dL   70-99")
    last = run()
    assert (last["unchanged"], last["failed"], last["documents"]) == (1, 0, 4)
    assert sorted((r["analyte_key"], r["value_num"]) for r in index.table("lab_result").collect() if r["value_num"]) == [("glucose", 99.0), ("glucose", 101.0), ("hdl", 37.0)]
    assert index.table("document_page").count() == 7 - 2 + 1 + 1 and index.table("document").count() == 5
    assert run(force=True)["unchanged"] == 0 and index.table("lab_result").count() == 4 and index.table("source_file").count() == 5


def test_a_crash_before_the_end_leaves_nothing(spark, tmp_path, monkeypatch):
    index = Catalog.open(spark, str(tmp_path / "index"), create=True)
    (tmp_path / "a.txt").write_text(BLOOD)
    monkeypatch.setattr(reports, "counters", lambda rows: 1 / 0)
    try:
        ingest.ingest_reports(index, str(tmp_path), READERS)
    except ZeroDivisionError:
        pass
    assert all(index.table(t).isEmpty() for t in index.schemas)
    assert [p.name for p in (tmp_path / "index").iterdir() if not p.name.startswith((".catalog", "catalog"))] == []
    monkeypatch.undo()
    assert ingest.ingest_reports(index, str(tmp_path), READERS)["lab_values"] == 2 and index.table("lab_result").count() == 2
