"""Printed reports: each file read on its own in a task, to rows of one table of outcomes.

A file gives a document, its pages, results and chunks, or else one error: what goes wrong with one costs no other, and a
half-read file leaves no half document."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from vitalspan.constants import unit_looks_wrong
from vitalspan.sources import files, streams, texts

FOUND = ", ".join(f.strip().replace(" ", ":", 1) for f in texts.RESULT.split(", ")[2:])
OUTCOME = f"path string, sha256 string, length long, kind string, n int, page_no int, text string, extraction string, title string, doc_date string, result struct<{FOUND}>, unit_warning boolean, error string"
#: What reads a kind of file: its bytes to pages (page_no, text, extraction: text, ocr or none, tables).
Reader = Callable[[bytes], list[dict]]


def text_pages(content: bytes) -> list[dict]:
    """A report that a tool has printed as text already: form feeds part pages."""
    return [{"page_no": i, "text": t, "extraction": "text" if t.strip() else "none", "tables": []} for i, t in enumerate(content.decode("utf-8").split("\f"), 1)]


READERS: dict[str, Reader] = {"pdf": files.pdf_pages}


def find(spark: SparkSession, root: str, readers: dict[str, Reader] | None = None) -> DataFrame:
    """path, length of the files below a folder that there is a reader for, but for hidden and empty ones; contents aren't read."""
    name = F.element_at(F.split("path", "/"), -1)
    kinds = [k.lower() for k in (readers or READERS)]
    return streams.listed(spark, root).filter(F.lower(F.element_at(F.split(name, r"\."), -1)).isin(*kinds) & ~name.startswith("."))


def outcomes(path: str, pages: list[dict]) -> list[dict]:
    """The rows of one file: a document, its pages, results of tables and lines, and chunks, each in order."""
    pages = sorted(pages, key=lambda p: p["page_no"])
    kinds = {p["extraction"] for p in pages} - {"none"}
    dates = (texts.document_date([p["text"] or ""]) for p in pages)
    title = texts.document_title(pages[0]["text"] or "") if pages else None
    out = [{"kind": "document", "n": len(pages), "extraction": "none" if not kinds else min(kinds) if len(kinds) == 1 else "mixed", "title": title or PurePosixPath(path).stem, "doc_date": next(filter(None, dates), None)}]
    results, chunks = [], []
    for p in pages:
        at, text = {"page_no": p["page_no"], "extraction": p["extraction"]}, p["text"] or ""
        out.append({"kind": "page", "n": len(text), "text": text} | at)
        results += [(at, r) for table in p.get("tables") or [] for r in texts.results_of_table(table)]
        results += [(at, r) for line in text.splitlines() if (r := texts.result_of_line(line))]
        chunks += [(at, piece) for piece in texts.chunk_text(text)]
    out += [{"kind": "result", "n": i, "result": r, "unit_warning": unit_looks_wrong(r["analyte_key"], r["unit"])} | at for i, (at, r) in enumerate(results)]
    return out + [{"kind": "chunk", "n": i, "text": piece} | at for i, (at, piece) in enumerate(chunks)]


def read(found: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Rows of OUTCOME for files (path, sha256, length): those of each file, or an `error` row with the kind of error alone,
    never its words, which might quote the file."""
    known = {k.lower(): r for k, r in (readers or READERS).items()}

    shape = to_arrow_schema(StructType.fromDDL(OUTCOME))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, sha256, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    store, name = streams.located(path)
                    with store.open_input_file(name) as file:
                        content = file.read()
                    rows = outcomes(path, known[path.rsplit(".", 1)[-1].lower()](content))
                except Exception as e:
                    rows = [{"kind": "error", "error": type(e).__name__}]
                yield pa.RecordBatch.from_pylist([{"path": path, "sha256": sha256, "length": length} | r for r in rows], schema=shape)

    return found.select("path", "sha256", "length").mapInArrow(run, OUTCOME)


def counters(rows: DataFrame) -> DataFrame:
    """One row of counts, never content."""
    kind = lambda k: F.col("kind") == k
    page = lambda e: F.count_if(kind("page") & (F.col("extraction") == e))
    return rows.agg(
        F.count_if(kind("document")).alias("documents"), page("text").alias("pages_text"), page("ocr").alias("pages_ocr"), page("none").alias("pages_empty"),
        F.count_if(kind("result")).alias("lab_values"), F.count_if(kind("chunk")).alias("chunks"), F.count_if("unit_warning").alias("unit_warnings"), F.count_if(kind("error")).alias("failed"),
    )
