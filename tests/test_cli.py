"""Commands and document files."""

import io
import json
import zipfile

import pytest
from test_sources import export, record, wearable_export  # noqa: F401

from vitalspan import cli
from vitalspan.sources import files


def test_commands(spark, wearable_export, tmp_path, capsys):  # noqa: F811
    index, corpus = str(tmp_path / "index"), str(tmp_path / "corpus")

    def ask(*words):
        args = cli.parser().parse_args(["--index", index, "--corpus", corpus, *words])
        return json.loads(json.dumps(cli.run(args, spark), default=str))

    assert ask("ingest", wearable_export)["export"]["records"] == 20
    assert ask("metric", "steps", "--start", "2026-03-02", "--end", "2026-03-02", "--combine", "sum")["points"][0]["value"] == 11500
    assert ask("types", "--search", "step")[0]["n"] == 7 and ask("check")["workout"] == 1 and ask("stats")["summary"]["workouts"] == 1
    assert ask("sleep")["nights"] and ask("workouts", "--derive", "pace", "--detail")["workouts"][0]["pace"]["value"] == 6
    assert ask("workouts", "--indoor")["without_one_filter"] == {"indoor": 1}
    assert ask("compare", "--metric", "resting-hr", "--left", "2026-03-01:2026-03-03", "--right", "2026-03-04:2026-03-07")["verdict"] == "ok"
    left_out = ask("compare", "--workouts", "--indoor", "--exclude-source", "Watch", "--left", "2026-03-01:2026-03-03", "--right", "2026-03-04:2026-03-07")
    assert left_out["verdict"] == "insufficient_data" and "marked indoor; both sides leave out Watch" in left_out["text"] and left_out["held"]["total"] == 1
    assert ask("documents") == [] and ask("notes", "--tags") == [] and ask("labs") == [] and "points" in ask("labs", "--analyte", "ldl")
    assert ask("clinical")["facts"] == [] and ask("vitals")["readings"] == [] and ask("search", "anything")["hits"] == []
    assert ask("literature", "status")["packs"] == [] and ask("embed")["embedded"] == 0
    args = cli.parser().parse_args(["--index", index, "visit-prep"])
    assert "Nothing stood out" in cli.run(args, spark)
    assert ask("reset")["reset"] == index


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    p = lambda text, style="": f'<w:p>{f"""<w:pPr><w:pStyle w:val="{style}"/></w:pPr>""" if style else ""}<w:r><w:t>{text}</w:t></w:r></w:p>'
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    content = docx(p("Top", "Heading1") + p("text") + table + p("Sub", "Heading2"))
    assert files.docx_text(content) == "# Top\n\ntext\n\na | b\n\n## Sub"
    (tmp_path / "n.docx").write_bytes(content)
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    found = {r["path"].rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert found["n.docx"]["text"].startswith("# Top") and found["broken.docx"]["text"] is None and "BadZipFile" in found["broken.docx"]["error"]


def test_missing_readers_say_so():
    with pytest.raises(files.ReaderMissing):
        files._library("no_such_library", "this")
