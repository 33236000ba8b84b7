"""Clinical JSON, one resource a file: laboratory results, vitals, facts and references to documents.

Parsed by the JVM as VARIANT; a file that isn't JSON or no resource is counted, not fatal."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.constants import coded_key
from vitalspan.functions.exprs import identity
from vitalspan.operators.writes import first_wins
from vitalspan.sources import archives

FACTS = {"Condition": "condition", "MedicationRequest": "medication", "AllergyIntolerance": "allergy", "Immunization": "immunization", "Procedure": "procedure"}
DOCUMENTS = ("DocumentReference", "DiagnosticReport")
#: What becomes of a member.
FATES = ("stored", "unreadable", "failed", "skipped", "ignored")
CODINGS = "array<struct<system:string,code:string>>"


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """member, content of the JSON files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("member"), F.decode("content", "utf-8").alias("content"))


def read_archive(spark: SparkSession, path: str, folder: str = "clinical-records") -> DataFrame:
    """The same from an archive of any size: JSON members of that folder, wherever it stands. A damaged member has no content."""
    found = archives.members(spark, path, "*.json").filter(F.array_contains(F.slice(F.split("member", "/"), 1, F.size(F.split("member", "/")) - 1), folder))
    return found.select(F.element_at(F.split("member", "/"), -1).alias("member"), F.decode("content", "utf-8").alias("content"))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def _text(path: str) -> Column:
    """Only if it is text."""
    return F.when(F.schema_of_variant(F.try_variant_get("v", path, "variant")) == "STRING", _get(path))


def _number(path: str) -> Column:
    """Only if it is a number: true casts to one, and isn't."""
    node = F.try_variant_get("v", path, "variant")
    return F.when(F.schema_of_variant(node).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), _get(path, "double"))


def _has(path: str) -> Column:
    return F.try_variant_get("v", path, "variant").isNotNull()


def _date(stamp: Column) -> Column:
    return F.when(F.length(stamp) >= 10, F.substring(stamp, 1, 10))


def _first(*options: Column) -> Column:
    return functools.reduce(lambda rest, c: F.coalesce(F.nullif(c, F.lit("")), rest), reversed(options[:-1]), options[-1])


def resources(members: DataFrame) -> DataFrame:
    """member, v (variant), resource_type, resource_id, error (unreadable, or null)."""
    parsed = members.select("member", F.try_parse_json("content").alias("v"))
    kind = _text("$.resourceType")
    return parsed.select("member", "v", kind.alias("resource_type"), F.coalesce(_text("$.id"), F.lit("")).alias("resource_id"), F.when(F.col("v").isNull() | kind.isNull(), "unreadable").alias("error"))


def category() -> Column:
    """The first usable one of all categories: its text, or the first of its codes; a category may be a plain word or not in a list."""
    word = lambda node, path: F.nullif(F.try_variant_get(node, path, "string"), F.lit(""))
    listed = F.coalesce(F.try_variant_get("v", "$.category", "array<variant>"), F.array(F.try_variant_get("v", "$.category", "variant")))

    def usable(node: Column) -> Column:
        codes = F.transform(F.coalesce(F.try_variant_get(node, "$.coding", "array<variant>"), F.array().cast("array<variant>")), lambda c: word(c, "$.code"))
        plain = F.when(F.schema_of_variant(node) == "STRING", word(node, "$"))
        return F.coalesce(word(node, "$.text"), F.try_element_at(F.filter(codes, lambda c: c.isNotNull()), F.lit(1)), plain)

    return F.try_element_at(F.filter(F.transform(listed, usable), lambda c: c.isNotNull()), F.lit(1))


def _value() -> tuple[Column, Column, Column]:
    """(number, unit, text): a quantity with a number, a quantity that only names a unit, or another form as text."""
    num, unit = _number("$.valueQuantity.value"), _text("$.valueQuantity.unit")
    boolean = F.initcap(_get("$.valueBoolean"))
    other = F.when(_has("$.valueString"), _get("$.valueString")).when(_has("$.valueBoolean"), boolean).when(_has("$.valueInteger"), _get("$.valueInteger")).otherwise(_text("$.valueCodeableConcept.text"))
    quantity = num.isNotNull() | (unit != "")
    return num, F.when(quantity, unit), F.when(~F.coalesce(quantity, F.lit(False)), other)


def _codings(path: str) -> Column:
    listed = F.try_variant_get("v", f"{path}.coding", CODINGS)
    return F.filter(F.coalesce(listed, F.array().cast(CODINGS)), lambda c: c["system"].isNotNull() & c["code"].isNotNull())


def _observations(found: DataFrame) -> DataFrame:
    num, unit, text = _value()
    rows = found.filter(F.col("resource_type") == "Observation")
    return rows.select("member", "v", "resource_type", "resource_id", F.coalesce(_text("$.code.text"), F.lit("")).alias("name"), _codings("$.code").alias("codings"), num.alias("value_num"), unit.alias("unit"), text.alias("value_text"), category().alias("category"), _text("$.effectiveDateTime").alias("at"))


def _is_lab() -> Column:
    return F.coalesce(F.lower(F.trim("category")) == "laboratory", F.lit(False))


def labs(found: DataFrame) -> DataFrame:
    """Laboratory results, with the key of their analyte by code or name."""
    rows = _observations(found).filter(_is_lab())
    rows = rows.select("member", "resource_type", "resource_id", F.col("name").alias("analyte"), "codings", "value_num", "value_text", "unit", _text("$.referenceRange[0].text").alias("ref_text"), _number("$.referenceRange[0].low.value").alias("ref_low"), _number("$.referenceRange[0].high.value").alias("ref_high"), _text("$.interpretation[0].text").alias("flag"), _date(F.col("at")).alias("collected_date"))

    @F.pandas_udf("analyte_key string, panel string, fault string")
    def keyed(names, codings):
        def one(name, listed):
            try:
                return *coded_key([(c["system"], c["code"]) for c in listed], name), None
            except Exception as e:  # one resource must not cost the others
                return None, None, type(e).__name__

        return pd.DataFrame([one(n, cs) for n, cs in zip(names, codings, strict=True)], columns=["analyte_key", "panel", "fault"])

    return rows.withColumn("k", keyed("analyte", "codings")).select("*", "k.analyte_key", "k.panel", "k.fault").drop("k").withColumn("extracted_by", F.lit("fhir"))


def vitals(found: DataFrame) -> DataFrame:
    rows = _observations(found).filter(~_is_lab())
    key = F.regexp_replace(F.regexp_replace(F.lower(F.trim("name")), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    first = F.try_element_at("codings", F.lit(1))
    return rows.select("member", "resource_type", "resource_id", F.col("name").alias("metric"), F.coalesce(F.nullif(key, F.lit("")), F.lit("unknown")).alias("metric_key"), first["code"].alias("code"), first["system"].alias("code_system"), "category", "value_num", "value_text", "unit", F.col("at").alias("measured_at"), _date(F.col("at")).alias("local_date"))


def facts(found: DataFrame) -> DataFrame:
    rows = found.filter(F.col("resource_type").isin(*FACTS))
    medication = F.col("resource_type") == "MedicationRequest"
    contained = F.filter(F.coalesce(_get("$.contained", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.try_variant_get(c, "$.resourceType", "string") == "Medication")
    inner = F.transform(contained, lambda c: F.struct(F.try_variant_get(c, "$.code.text", "string").alias("text"), F.try_variant_get(c, "$.code.coding", CODINGS).alias("codings")))
    inner_text = F.try_element_at(F.filter(inner, lambda c: c["text"].isNotNull() & (c["text"] != "")), F.lit(1))["text"]
    inner_codings = F.try_element_at(F.filter(inner, lambda c: F.size(F.coalesce(c["codings"], F.array().cast(CODINGS))) > 0), F.lit(1))["codings"]
    named = F.when(medication, _first(_text("$.medicationReference.display"), inner_text, _text("$.medicationCodeableConcept.text"))).otherwise(F.coalesce(_text("$.code.text"), F.when(~_has("$.code"), _text("$.vaccineCode.text"))))
    coded = F.when(medication, F.coalesce(inner_codings, _codings("$.medicationCodeableConcept"))).when(_has("$.code"), _codings("$.code")).otherwise(_codings("$.vaccineCode"))
    onset = F.when(medication, _text("$.authoredOn")).otherwise(_first(_text("$.onsetDateTime"), _text("$.occurrenceDateTime"), _text("$.performedDateTime"), _text("$.performedPeriod.start"), _text("$.recordedDate")))
    status = F.when(medication, _text("$.status")).otherwise(F.coalesce(_text("$.clinicalStatus.coding[0].code"), _text("$.clinicalStatus.text"), _text("$.status")))
    kind = F.create_map(*[F.lit(x) for p in FACTS.items() for x in p])[F.col("resource_type")]
    first = F.try_element_at("codings", F.lit(1))
    out = rows.select("member", "resource_type", "resource_id", kind.alias("kind"), F.coalesce(named, F.lit("")).alias("name"), coded.alias("codings"), status.alias("status"), _date(onset).alias("onset_date"), F.when(medication, _text("$.dosageInstruction[0].text")).alias("detail_text"), category().alias("category"))
    out = out.select("*", first["code"].alias("code"), first["system"].alias("code_system")).drop("codings")
    return out.withColumn("dedup_key", identity("kind", "name", "code", "onset_date"))


def document_references(found: DataFrame) -> DataFrame:
    """References only: attachments and identities are never read."""
    rows = found.filter(F.col("resource_type").isin(*DOCUMENTS))
    title = F.coalesce(_text("$.type.text"), _text("$.code.text"), _text("$.description"))
    return rows.select("member", "resource_type", "resource_id", title.alias("title"), _date(_first(_text("$.date"), _text("$.effectiveDateTime"), _text("$.issued"))).alias("doc_date"))


def document_rows(*parsed: DataFrame) -> DataFrame:
    """A document for each resource, by type and id (or member without one), the first of each."""
    shown = []
    for df in parsed:
        title = next(c for c in ("title", "analyte", "metric", "name") if c in df.columns)
        day = next(c for c in ("doc_date", "collected_date", "local_date", "onset_date") if c in df.columns)
        shown.append(df.select("member", "resource_type", F.coalesce(F.nullif("resource_id", F.lit("")), "member").alias("fhir_id"), F.col(title).alias("title"), F.col(day).alias("doc_date")))
    rows = functools.reduce(DataFrame.unionByName, shown)
    out = first_wins(rows, ["resource_type", "fhir_id"], "member")
    return out.select(F.xxhash64("resource_type", "fhir_id").alias("id"), F.col("member").alias("path"), F.lit("fhir").alias("kind"), "title", "doc_date", F.col("resource_type").alias("fhir_resource_type"), "fhir_id")


def skip_list(text: str) -> set[str]:
    """Kinds not to read; an unknown one is an error."""
    kinds = {*FACTS.values(), "lab", "vital", "document"}
    wanted = {k.strip().lower() for k in text.split(",") if k.strip()}
    if wanted - kinds:
        raise ValueError(f"unknown kinds: {', '.join(sorted(wanted - kinds))}; known: {', '.join(sorted(kinds))}")
    return wanted


#: Numbers of a row that have to be finite to be stored.
NUMBERS = {"lab": ("value_num", "ref_low", "ref_high"), "vital": ("value_num",)}


def checked(rows: DataFrame, kind: str) -> DataFrame:
    """Rows with `fault`: why a row can't be stored, or null: something that this library couldn't do, or a number without end."""
    endless = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), f"{c} isn't finite") for c in NUMBERS.get(kind, ())]
    own = [F.col("fault")] if "fault" in rows.columns else []
    return rows.withColumn("fault", F.coalesce(*own, *endless, F.lit(None).cast("string")))


def ingest(members: DataFrame, skip: str = "") -> dict[str, DataFrame]:
    """Tables by name, counts of resources by type and error, and one row of `counters`.

    A resource is stored whole or not at all: one child row that can't be stored (`checked`) takes its siblings and its
    document with it. `unreadable` is a member that is no resource; `failed` one that is, with a row that can't be stored;
    `skipped` one of a kind not asked for; `ignored` one of a type that nothing is read from."""
    found, left_out = resources(members), skip_list(skip)
    good = found.filter("error IS NULL")
    made = {"lab": labs(good), "vital": vitals(good), "fact": facts(good), "document_reference": document_references(good)}
    faults = {t: checked(df, t) for t, df in made.items()}
    failed = functools.reduce(DataFrame.unionByName, [df.filter("fault IS NOT NULL").select("member", "fault") for df in faults.values()])
    failed = failed.groupBy("member").agg(F.min("fault").alias("fault"))
    out = {t: df.join(failed.select("member"), "member", "left_anti").drop("fault") for t, df in faults.items()}
    out["fact"] = out["fact"].filter(~F.col("kind").isin(*left_out) if left_out else F.lit(True))
    for kind, table in (("lab", "lab"), ("vital", "vital"), ("document", "document_reference")):
        if kind in left_out:
            out[table] = out[table].limit(0)
    out["document"] = document_rows(out["lab"], out["vital"], out["fact"], out["document_reference"])
    shown = found.join(failed, "member", "left").withColumn("error", F.coalesce("error", F.when(F.col("fault").isNotNull(), "failed")))
    out["counts"] = shown.groupBy("resource_type", "error").count()
    out["faults"] = failed
    lab = F.coalesce(F.lower(F.trim(category())) == "laboratory", F.lit(False))
    kind = F.coalesce(F.create_map(*[F.lit(x) for p in FACTS.items() for x in p])[F.col("resource_type")], F.when(F.col("resource_type").isin(*DOCUMENTS), "document"), F.when(F.col("resource_type") == "Observation", F.when(lab, "lab").otherwise("vital")))
    fate = F.coalesce("error", F.when(kind.isNull(), "ignored"), F.when(kind.isin(*left_out), "skipped") if left_out else F.lit(None), F.lit("stored"))
    out["counters"] = shown.select(fate.alias("fate")).agg(*[F.count_if(F.col("fate") == f).alias(f) for f in FATES])
    return out
