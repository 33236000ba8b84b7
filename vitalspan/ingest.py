"""From files to an index and a corpus: what is new is added once, what comes again changes nothing."""

from __future__ import annotations

import functools
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.catalog import Catalog
from vitalspan.operators import series, workouts, writes
from vitalspan.sources import fhir, reports, streams, texts, wearable


def _at_once(ingest):
    """The tables of the first argument, a catalog, change together when the function returns, or not at all."""

    @functools.wraps(ingest)
    def run(catalog: Catalog, *args, **kwargs):
        with catalog.transaction():
            return ingest(catalog, *args, **kwargs)

    return run


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="seconds")


def _fingerprint(spark: SparkSession, path: str) -> tuple[str, int]:
    """(sha256, bytes) of a file or of all files below a folder, hashed by the executors."""
    row = streams.hashed(streams.listed(spark, path)).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("path", "sha256"))), ","), 256), F.coalesce(F.sum("length"), F.lit(0))).first()
    return row[0], row[1]


def discover(spark: SparkSession, folder: str) -> dict[str, list[str]]:
    """What there is to ingest below a folder, by kind: exports, archives, clinical folders, reports, notes. Only names are read."""
    listed = streams.listed(spark, folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = (
        F.when(name.startswith("."), None)
        .when(name == "export.xml", "export")
        .when(name.endswith(".zip"), "archive")
        .when(F.col("path").contains("/clinical-records/") & name.endswith(".json"), "clinical")
        .when(name.endswith(".pdf"), "report")
        .when(F.lower(name).rlike(r"\.(md|markdown|txt|docx|png|jpe?g|heic)$"), "note")
    )
    parent = F.regexp_replace("path", "/[^/]*$", "")
    found = listed.select(kind.alias("kind"), F.when(kind == "clinical", parent).otherwise(F.col("path")).alias("p")).filter("kind IS NOT NULL").distinct()
    out: dict[str, list[str]] = {}
    for r in found.orderBy("kind", "p").collect():  # the files of one person
        out.setdefault(r["kind"], []).append(r["p"])
    return out


@_at_once
def ingest_export(catalog: Catalog, path: str, force: bool = False) -> dict:
    """A wearable export, or the one in an archive, into the index. Unchanged complete files are skipped unless forced;
    forcing inserts nothing twice. The file is parsed once: all tables are made from the elements found, which are kept
    beside the tables until all is done. Statistics and the rollup are made anew only for what was added."""
    spark = catalog.spark
    digest, size = _fingerprint(spark, path)
    known = catalog.table("source_file").filter((F.col("path") == path) & (F.col("sha256") == digest) & (F.col("status") == "complete"))
    if not force and not known.isEmpty():
        return {"skipped": True}
    wearable.check_root(spark, path)
    with catalog.scratch() as folder:
        found = wearable.elements(spark, path, folder)
        counts = wearable.ingest_counts(spark, found).first().asDict()
        added = catalog.append("record", catalog.unheld("record", wearable.records(spark, found), "seq"))
        rides = catalog.append("workout", catalog.unheld("workout", wearable.workout_rows(spark, found), "seq"))
        catalog.append("workout_stat", workouts.stat_rows(rides))
        for name, rows, key in (("activity_summary", wearable.activity_summaries(spark, found), "local_date"), ("characteristic", wearable.characteristics(spark, found), "key")):
            catalog.replace(name, rows.select(*catalog.table(name).columns), [key])
        changed = added.select("type", "local_date").distinct()
        days = [r[0] for r in changed.select("local_date").distinct().collect()]
        catalog.replace("daily_metric", series.rollup_of(catalog.table("record", days), changed), ["type", "local_date"], changed)
        counts |= {"rollup": catalog.table("daily_metric").count(), "records": added.count(), "workouts": rides.count(), "skipped": False}
        whole = wearable.is_whole(spark, found)
    catalog.note_file(path, "export", digest, size, counts["records"], "complete" if whole else "partial")
    return counts


@_at_once
def ingest_clinical(catalog: Catalog, path: str, skip: str = "") -> dict:
    """Clinical JSON, of a folder or of an archive, into the index. Documents are known by type and id; a fact whose status
    changed takes it over. A resource is stored whole or not at all. What became of the members is under "counters"."""
    with catalog.scratch() as folder:
        members = streams.staged(fhir.read_archive(catalog.spark, path) if path.lower().endswith(".zip") else fhir.read_members(catalog.spark, path), folder)
        parsed = fhir.ingest(members, skip)
        catalog.append("document", writes.insert_ignore(catalog.table("document"), parsed["document"], ["id"], "path"))
        of = lambda df: df.withColumn("document_id", F.xxhash64("resource_type", F.coalesce(F.nullif("resource_id", F.lit("")), "member")))
        fields = [f.split()[0] for f in catalog.schemas["clinical_fact"].split(", ")]
        facts = writes.first_wins(of(parsed["fact"]), ["dedup_key"], "member").select(*fields)
        catalog.replace("clinical_fact", writes.upserts(catalog.table("clinical_fact"), facts, "dedup_key", "status", ["document_id"]), ["dedup_key"])
        vitals = of(parsed["vital"]).withColumnRenamed("member", "m")
        catalog.append("clinical_vital", writes.insert_ignore(catalog.table("clinical_vital"), vitals, ["metric_key", "measured_at", "value_num", "value_text", "unit"], "m"))
        labs = of(parsed["lab"]).withColumn("id", F.xxhash64("document_id", "analyte", "value_num", "value_text"))
        catalog.append("lab_result", writes.insert_ignore(catalog.table("lab_result"), labs, ["document_id", "analyte_key", "value_num", "value_text", "unit", "collected_date"], "id"))
        counts = {(r["resource_type"], r["error"]): r["count"] for r in parsed["counts"].collect()}  # a row for each type of resource
        return counts | {("counters", k): n for k, n in parsed["counters"].first().asDict().items()}


@_at_once
def ingest_notes(catalog: Catalog, path: str) -> int:
    """Notes into the index; a note that comes again replaces what was held of it, and nothing else is rewritten."""
    with catalog.scratch() as folder:
        noted = streams.staged(texts.notes(texts.read_notes(catalog.spark, path)).withColumn("id", F.xxhash64("path")), folder)
        documents = noted.select("id", "path", F.lit("note").alias("kind"), "title", "doc_date", F.lit("text").alias("extraction"))
        tags = noted.select(F.col("id").alias("document_id"), F.explode("tags").alias("tag"))
        pieces = texts.chunk_rows(noted).withColumn("document_id", F.xxhash64("path")).withColumn("id", F.xxhash64("path", "chunk_index", "text"))
        ids = noted.select(F.col("id").alias("document_id"))
        catalog.replace("document", documents, ["id"])
        for name, rows in (("document_tag", tags), ("chunk", pieces)):
            catalog.replace(name, rows, ["document_id"], ids)
        return noted.count()


@_at_once
def ingest_pages(catalog: Catalog, pages: DataFrame) -> int:
    """Results of the pages of reports (document_id, page_no, text, via_ocr) into the index, replacing those documents' results.
    A document's date is the first that a page states, in the order of pages."""

    @F.pandas_udf("string")
    def stated(text):
        return text.map(lambda t: texts.document_date([t or ""]))

    dates = pages.select("document_id", "page_no", stated("text").alias("day")).filter("day IS NOT NULL")
    dated = dates.groupBy("document_id").agg(F.min_by("day", "page_no").alias("collected_date"))
    found = texts.lab_lines(pages).join(dated, "document_id", "left").join(pages.select("document_id", "page_no", "via_ocr"), ["document_id", "page_no"])
    rows = found.withColumn("id", F.xxhash64("document_id", "page_no", "raw_line"))
    return catalog.replace("lab_result", writes.first_wins(rows, ["document_id", "analyte_key", "value_num", "value_text", "unit"], "id"), ["document_id"], pages.select("document_id")).count()


@_at_once
def ingest_reports(catalog: Catalog, root: str, readers: dict | None = None, force: bool = False) -> dict:
    """Report files below a folder into the index: documents, pages, results, chunks and the ledger, in one transaction.

    Files held complete with the same content are left alone unless forced; whatever is read replaces what was held of the
    file. One that can't be read is noted as failed and tried again the next time, one with pages that gave no text as
    partial. A table's results come before those of the page's lines; the first of equal ones stays. Counts come back."""
    spark = catalog.spark
    with catalog.scratch() as folder:
        listed = streams.staged(streams.hashed(reports.find(spark, root, readers)), folder)
        todo = listed if force else writes.unprocessed(listed, catalog.table("source_file"))
        rows = streams.staged(reports.read(todo.repartition(spark.sparkContext.defaultParallelism, "path"), readers), folder)
        rows = rows.withColumn("document_id", F.xxhash64("path"))
        tried = rows.select("document_id").distinct()
        document = rows.filter("kind = 'document'").select(F.col("document_id").alias("id"), "path", F.lit("pdf").alias("kind"), "title", "doc_date", F.lit(_now()).alias("ingested_at"), F.col("n").alias("page_count"), "extraction")
        page = rows.filter("kind = 'page'").select("document_id", "page_no", "text", "extraction")
        dates = rows.filter("kind = 'document'").select("document_id", F.col("doc_date").alias("collected_date"))
        found = rows.filter("kind = 'result'").select("document_id", "page_no", "n", (F.col("extraction") == "ocr").alias("via_ocr"), "result.*").join(dates, "document_id")
        found = writes.first_wins(found, ["document_id", "page_no", "analyte_key", "value_num", "value_text", "unit"], "n")
        found = streams.staged(found.withColumn("id", F.xxhash64("document_id", "page_no", "n", "raw_line")), folder)
        chunk = rows.filter("kind = 'chunk'").select(F.xxhash64("path", "n", "text").alias("id"), "document_id", F.col("n").alias("chunk_index"), F.lit(None).cast("string").alias("section"), "text", F.lit(None).cast("string").alias("embedded_with"))
        catalog.replace("document", document, ["id"], tried.select(F.col("document_id").alias("id")))
        for name, new in (("document_page", page), ("lab_result", found), ("chunk", chunk)):
            catalog.replace(name, new, ["document_id"], tried)
        stored = found.groupBy("document_id").agg(F.count("*").alias("record_count"))
        state = F.when(F.bool_or(F.col("kind") == "error"), "failed").when(F.bool_or((F.col("kind") == "page") & (F.col("extraction") == "none")), "partial").otherwise("complete")
        ledger = rows.groupBy("document_id", "path", "sha256").agg(F.max("length").alias("size_bytes"), state.alias("status")).join(stored, "document_id", "left")
        catalog.replace("source_file", ledger.select("path", F.lit("report").alias("kind"), "sha256", "size_bytes", F.lit(_now()).alias("ingested_at"), F.coalesce("record_count", F.lit(0)).alias("record_count"), "status"), ["path"])
        counts = reports.counters(rows).first().asDict()
        stored_values = found.count()
        return counts | {"lab_values": stored_values, "lab_values_duplicate": counts["lab_values"] - stored_values, "unchanged": listed.count() - tried.count()}


# The corpus.


def _shaped(articles: DataFrame) -> DataFrame:
    names = {"pub_year": "year", "evidence_tier": "tier", "evidence_rank": "tier_rank"}
    return articles.withColumnsRenamed(names)


def _chunks(articles: DataFrame) -> DataFrame:
    @F.pandas_udf("array<string>")
    def cut(text):
        return text.map(lambda t: texts.chunk_abstract(t) if t else [])

    body = F.concat_ws("\n\n", "title", F.nullif("abstract", F.lit("")))
    pieces = articles.select("pmid", F.posexplode(cut(body)).alias("chunk_index", "text"))
    return pieces.withColumn("id", F.xxhash64("pmid", "chunk_index", "text")).withColumn("embedded_with", F.lit(None).cast("string"))


@_at_once
def install_pack(corpus: Catalog, pack: str, articles: DataFrame, keep_members: bool = False, title: str = "", version: str = "") -> dict:
    """Articles of a pack: upserted by identifier and linked. Chunks of unchanged texts keep their ids, and so their vectors.
    Unless members are kept (a refresh), those the pack no longer has are unlinked, and articles of no pack go. Rows of other
    articles stay in their files as they are."""
    with corpus.scratch() as folder:
        fresh = streams.staged(writes.last_wins(_shaped(articles), ["pmid"], "title").withColumn("retracted", F.coalesce("retracted", F.lit(False))), folder)
        links = fresh.select("pmid", F.lit(pack).alias("pack"))
        corpus.replace("article", fresh, ["pmid"])
        if not keep_members:
            corpus.delete("article_pack", F.col("pack") == pack)
        corpus.replace("article_pack", links, ["pmid", "pack"])
        mesh = fresh.select("pmid", F.explode("mesh_terms").alias("term"), "major_terms").select("pmid", "term", F.array_contains("major_terms", F.col("term")).alias("major")).distinct()
        corpus.replace("mesh_term", mesh, ["pmid"], fresh)
        chunk = corpus.table("article_chunk")
        same = chunk.select("id", F.col("embedded_with").alias("was"))
        corpus.replace("article_chunk", _chunks(fresh).join(same, "id", "left").withColumn("embedded_with", F.col("was")), ["pmid"], fresh)
        corpus.replace("pack", corpus.spark.createDataFrame([(pack, title, version, "")], corpus.schemas["pack"]), ["pack"])
        if not keep_members:
            drop_orphans(corpus)
        return {"articles": links.count(), "held": corpus.table("article").count()}


@_at_once
def drop_orphans(corpus: Catalog) -> None:
    members = corpus.table("article_pack").select("pmid").distinct()
    for name in ("article", "mesh_term", "article_chunk"):
        corpus.delete(name, writes.orphans(corpus.table(name), members, "pmid"), ["pmid"])


@_at_once
def remove_pack(corpus: Catalog, pack: str) -> None:
    for name in ("article_pack", "pack"):
        corpus.delete(name, F.col("pack") == pack)
    drop_orphans(corpus)


@_at_once
def refresh_pack(corpus: Catalog, pack: str, articles: DataFrame, retracted: DataFrame, ran_at: str) -> dict:
    """What arrived since the last time: linked, never unlinked; then retractions are marked; then the run is logged."""
    if corpus.table("pack").filter(F.col("pack") == pack).isEmpty():
        raise KeyError(f"pack {pack} isn't installed; install it first")
    known = corpus.table("article_pack").filter(F.col("pack") == pack).select("pmid")
    added = articles.select("pmid").distinct().join(known, "pmid", "left_anti").count()
    install_pack(corpus, pack, articles, keep_members=True)
    marked, newly = writes.mark_retracted(corpus.table("article"), retracted)
    count = newly.count()
    if count:
        corpus.replace("article", marked.join(newly, "pmid", "left_semi"), ["pmid"])
    log = corpus.table("refresh_log")
    row = corpus.spark.createDataFrame([(log.count() + 1, pack, ran_at, added, count)], corpus.schemas["refresh_log"])
    corpus.append("refresh_log", row)
    return {"added": added, "retracted": count}


def tables(catalog: Catalog, *names: str) -> list[DataFrame]:
    return list(map(functools.partial(Catalog.table, catalog), names))


__all__ = ["drop_orphans", "ingest_clinical", "ingest_export", "ingest_notes", "ingest_pages", "ingest_reports", "install_pack", "refresh_pack", "remove_pack", "tables"]
