"""Documents, tags, notes and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOTE_KINDS = ("note", "image")


def of_kind(kind: str | None) -> Column:
    """Notes include images; without a kind, all but the health system's resources."""
    if kind == "note":
        return F.col("kind").isin(*NOTE_KINDS)
    return F.col("kind") == kind if kind else F.col("kind") != "fhir"


def list_documents(document: DataFrame, lab: DataFrame, chunk: DataFrame, tag: DataFrame, kind: str | None = None) -> DataFrame:
    """With counts of results and chunks and the sorted tags: each counted once before the join, not for each document."""
    count = lambda df, name: df.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias(name))
    tags = tag.groupBy(F.col("document_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("tag")), ", ").alias("tags"))
    out = document.filter(of_kind(kind)).join(count(lab, "labs"), "id", "left").join(count(chunk, "chunks"), "id", "left").join(tags, "id", "left")
    return out.fillna(0, ["labs", "chunks"]).orderBy(F.coalesce(F.col("doc_date").cast("string"), F.col("ingested_at").cast("string")), "id")


def list_tags(document: DataFrame, tag: DataFrame, limit: int | None = None) -> DataFrame:
    held = tag.join(document.select(F.col("id").alias("document_id"), "doc_date"), "document_id")
    out = held.groupBy("tag").agg(F.count("*").alias("n"), F.min("doc_date").alias("first"), F.max("doc_date").alias("last")).orderBy(F.desc("n"), "tag")
    return out.limit(limit) if limit else out


def notes_by_tag(document: DataFrame, tag: DataFrame, name: str) -> DataFrame:
    held = tag.filter(F.col("tag") == name).select(F.col("document_id").alias("id")).distinct()
    return document.join(held, "id", "left_semi").orderBy(F.coalesce(F.col("doc_date").cast("string"), F.col("ingested_at").cast("string")), "id")


def tags_matching(tag: DataFrame, query: str) -> DataFrame:
    """Tags that are words of the query, sorted."""
    words = {w.strip("#.,;:!?\"'()").lower() for w in query.split()} - {""}
    return tag.select("tag").distinct().filter(F.lower("tag").isin(*words) if words else F.lit(False)).orderBy("tag")


def note_summary(document: DataFrame, tag: DataFrame, chunk: DataFrame) -> DataFrame:
    notes = document.filter(F.col("kind").isin(*NOTE_KINDS))
    held = notes.agg(F.count("*").alias("notes"), F.count_if(F.col("kind") == "image").alias("images"), F.min("doc_date").alias("first"), F.max("doc_date").alias("last"), F.count_if(F.col("doc_date").isNull()).alias("undated"))
    chunks = chunk.join(notes.select(F.col("id").alias("document_id")), "document_id", "left_semi").agg(F.count("*").alias("chunks"))
    return held.join(F.broadcast(tag.agg(F.countDistinct("tag").alias("tags")))).join(F.broadcast(chunks))  # one row each


def document_summary(document: DataFrame, page: DataFrame, chunk: DataFrame, lab: DataFrame) -> DataFrame:
    """One row: documents that aren't the health system's resources, their pages, scanned pages, results, embedded chunks."""
    held = document.filter(F.col("kind") != "fhir")
    ids = held.select(F.col("id").alias("document_id"))
    docs = held.agg(F.count("*").alias("documents"), F.min("doc_date").alias("first"), F.max("doc_date").alias("last"))
    pages = page.join(ids, "document_id", "left_semi").agg(F.count("*").alias("pages"), F.count_if(F.col("extraction") == "ocr").alias("ocr_pages"))
    chunks = chunk.join(ids, "document_id", "left_semi").agg(F.count("*").alias("chunks"), F.count("embedded_with").alias("embedded"))
    labs = lab.agg(F.count("*").alias("labs"), F.countDistinct("analyte_key").alias("analytes"))
    return docs.join(F.broadcast(pages)).join(F.broadcast(chunks)).join(F.broadcast(labs))  # one row each
