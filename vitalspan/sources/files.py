"""Document files: DOCX by its own XML; PDF and images where their libraries are installed, else a clear refusal."""

from __future__ import annotations

import importlib
import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.sources.texts import reconstruct_columns

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: A page with less text than this is a picture of one.
LEAST_TEXT = 40


class ReaderMissing(RuntimeError):
    """A library that this kind of file needs isn't installed."""


def _library(name: str, why: str):
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise ReaderMissing(f"{why} needs {name}, which isn't installed") from e


def docx_text(content: bytes) -> str:
    """Paragraphs in order, headings as #, tables as rows with bars."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    plain = lambda node: "".join((n.text or "") if n.tag == f"{WORD}t" else "\t" if n.tag == f"{WORD}tab" else "" for n in node.iter())
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{WORD}p":
            style = node.find(f"{WORD}pPr/{WORD}pStyle")
            name = (style.get(f"{WORD}val") or "").lower() if style is not None else ""
            level = 1 if name == "title" else int(name[7:]) if name.startswith("heading") and name[7:].isdigit() else 0
            text = plain(node).strip()
            if text:
                out.append("#" * min(level, 6) + " " * bool(level) + text)
        elif node.tag == f"{WORD}tbl":
            rows = [" | ".join(" ".join(plain(cell).split()) for cell in row.iter(f"{WORD}tc")) for row in node.iter(f"{WORD}tr")]
            out.append("\n".join(r for r in rows if r.strip(" |")))
    return "\n\n".join(out)


def image_text(content: bytes) -> str:
    """Words of an image, upright, set on a grid so that columns stay apart."""
    images, ops, ocr = _library("PIL.Image", "reading images"), _library("PIL.ImageOps", "reading images"), _library("pytesseract", "reading images")
    found = ocr.image_to_data(ops.exif_transpose(images.open(io.BytesIO(content))), config="--psm 6", output_type=ocr.Output.DICT)
    boxes = [{"line": (b, p, n), "left": x, "width": w, "text": t, "confidence": float(c)} for b, p, n, x, w, t, c in zip(*(found[k] for k in ("block_num", "par_num", "line_num", "left", "width", "text", "conf")), strict=True)]
    return reconstruct_columns(boxes)


def pdf_pages(content: bytes, ocr: bool = True) -> list[dict]:
    """page_no, text, extraction (text or ocr) and tables of each page."""
    plumber = _library("pdfplumber", "reading PDF files")
    out = []
    with plumber.open(io.BytesIO(content)) as pdf:
        for i, page in enumerate(pdf.pages, 1):
            text, kind = page.extract_text(layout=True) or "", "text"
            if len(text.strip()) < LEAST_TEXT and ocr:
                picture = io.BytesIO()
                page.to_image(resolution=300).original.save(picture, format="PNG")
                text, kind = image_text(picture.getvalue()), "ocr"
            out.append({"page_no": i, "text": text, "extraction": kind, "tables": page.extract_tables()})
    return out


READERS: dict[str, Callable[[bytes], str]] = {"docx": docx_text, "png": image_text, "jpg": image_text, "jpeg": image_text, "heic": image_text}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, text, error of DOCX files and images below a folder: a file that can't be read is an error of its own."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,png,jpg,jpeg,heic}").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((name, READERS[name.rsplit(".", 1)[-1].lower()](bytes(content)), None))
                except Exception as e:
                    rows.append((name, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    named = files.filter(~F.element_at(F.split("path", "/"), -1).startswith("."))
    return named.select("path", "content").mapInPandas(run, "path string, text string, error string")
