"""Facts and vitals that a health system sent: listings, coverage, holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.constants import slug
from vitalspan.functions import exprs as X

FACT_KINDS = ("condition", "medication", "allergy", "immunization", "procedure")


def _cited(rows: DataFrame, document: DataFrame) -> DataFrame:
    return rows.join(document.select(F.col("id").alias("document_id"), F.col("path").alias("citation")), "document_id")


def clinical_facts(fact: DataFrame, document: DataFrame, kind: str | None = None, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first, undated last, then by name; `since` keeps undated facts."""
    rows = fact.filter(F.col("kind") == kind) if kind else fact
    if since:
        rows = rows.filter(F.col("onset_date").isNull() | (F.col("onset_date") >= since))
    out = _cited(rows, document).orderBy(F.desc(F.coalesce("onset_date", F.lit("0000"))), "name").select("kind", "name", "code", "code_system", "status", "onset_date", "detail_text", "category", "citation")
    return out.limit(limit) if limit is not None else out


def fact_coverage(fact: DataFrame) -> DataFrame:
    return fact.groupBy("kind").agg(F.count("*").alias("n"), F.min("onset_date").alias("first"), F.max("onset_date").alias("last"))


def clinical_vitals(vital: DataFrame, document: DataFrame, metric: str | None = None, start: str | None = None, end: str | None = None, limit: int | None = 200) -> DataFrame:
    rows = vital.filter(F.col("metric_key") == slug(metric)) if metric else vital
    rows = _cited(rows.filter(X.between("local_date", start, end)), document)
    out = rows.orderBy(F.desc(F.coalesce("measured_at", F.lit(""))), "metric_key")
    return out.limit(limit) if limit is not None else out


def vital_metrics(vital: DataFrame) -> DataFrame:
    """A unit only if it is the only one; `units` lists all."""
    units = F.array_sort(F.collect_set("unit"))
    out = vital.groupBy("metric_key").agg(F.max("metric").alias("metric"), F.count("*").alias("n"), F.min("local_date").alias("first"), F.max("local_date").alias("last"), units.alias("units"))
    return out.withColumn("unit", F.when(F.size("units") == 1, F.element_at("units", 1))).orderBy(F.desc("n"), "metric_key")


def content_counts(lab: DataFrame, document: DataFrame) -> DataFrame:
    """One row: laboratory values from the health system, and references to notes whose text isn't held."""
    labs = lab.filter(F.col("extracted_by") == "fhir").agg(F.count("*").alias("labs"), F.min("collected_date").alias("labs_first"), F.max("collected_date").alias("labs_last"))
    referred = (F.col("kind") == "fhir") & F.col("fhir_resource_type").isin("DocumentReference", "DiagnosticReport")
    notes = document.filter(referred).agg(F.count("*").alias("note_references"), F.min("doc_date").alias("note_references_first"), F.max("doc_date").alias("note_references_last"))
    return labs.join(F.broadcast(notes))  # one row each


def holdings(fact: DataFrame, vital: DataFrame, lab: DataFrame, document: DataFrame) -> DataFrame:
    """holding, n, first, last: what there is to ask about, kinds of facts first, whatever has no rows left out."""
    facts = fact_coverage(fact).select(F.col("kind").alias("holding"), "n", F.col("first").cast("string"), F.col("last").cast("string"))
    vitals = vital.agg(F.count("*").alias("n"), F.min("local_date").cast("string").alias("first"), F.max("local_date").cast("string").alias("last")).select(F.lit("vitals").alias("holding"), "n", "first", "last")
    counts = content_counts(lab, document)
    labs = counts.select(F.lit("labs").alias("holding"), F.col("labs").alias("n"), F.col("labs_first").cast("string").alias("first"), F.col("labs_last").cast("string").alias("last"))
    notes = counts.select(F.lit("note references").alias("holding"), F.col("note_references").alias("n"), F.col("note_references_first").cast("string").alias("first"), F.col("note_references_last").cast("string").alias("last"))
    return facts.unionByName(vitals).unionByName(labs).unionByName(notes).filter("n > 0")


def holdings_phrase(rows: list) -> str:
    """Collected holdings in words."""
    said = [f"{r['n']} {r['holding']}" + (f" ({r['first']} to {r['last']})" if r["first"] and r["first"] != r["last"] else f" ({r['first']})" if r["first"] else "") for r in rows]
    return "nothing" if not said else said[0] if len(said) == 1 else ", ".join(said[:-1]) + " and " + said[-1]
