"""Laboratory results: trends that reconcile duplicate reports, status against printed ranges, signals, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.constants import NEAR_SINGLE, NEAR_SPAN
from vitalspan.functions import exprs as X

KEY, DATE = "analyte_key", "collected_date"


def lab_source() -> Column:
    return F.when(F.col("extracted_by") == "fhir", "fhir").otherwise("pdf")


def collapse(lab: DataFrame) -> DataFrame:
    """One row for each result, however many sources report it, with also_from and the date's clash flag.

    Rows: analyte_key, collected_date, id (their order), value_num, value_text, unit, ref_text, via_ocr, source. Within a
    date (null is one), equal (value_num, value_text, unit) from several sources collapse to as many rows as the source
    with most of them has; rows with a printed range, not scanned, from a report, and earlier ones stay first. The first
    c(s) of them that aren't from source s are also from s, which reports c(s). A date clashes if two different sources each
    report a value that no other source does."""
    value = [KEY, DATE, "value_num", "value_text", "unit"]
    per_source = Window.partitionBy(*value, "source")
    group = Window.partitionBy(*value)
    rank = [F.coalesce(F.col("ref_text") == "", F.lit(True)), F.coalesce("via_ocr", F.lit(False)), F.col("source") != "pdf", F.col("id")]
    # Dealt once by analyte and date, which holds for every window below.
    counted = lab.repartition(KEY, DATE).withColumn("_c", F.count("*").over(per_source))
    counted = counted.withColumn("_most", F.max("_c").over(group)).withColumn("_sources", F.collect_set(F.struct("source", "_c")).over(group))
    ranked = counted.withColumn("_r", F.row_number().over(group.orderBy(*rank)))
    several = F.size("_sources") > 1
    kept = ranked.filter(~several | (F.col("_r") <= F.col("_most")))
    # For each other source, how many survivors up to this one aren't from it; two sources exist, reports and the health system.
    before = group.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    for s in ("pdf", "fhir"):
        kept = kept.withColumn(f"_not_{s}", F.count_if(F.col("source") != s).over(before))
    count_of = lambda s: F.aggregate(F.filter("_sources", lambda x: x["source"] == s), F.lit(0).cast("long"), lambda a, x: a + x["_c"])
    also = F.array_sort(F.array_compact(F.array(*[F.when(several & (F.col("source") != s) & (F.col(f"_not_{s}") <= count_of(s)), F.lit(s)) for s in ("fhir", "pdf")])))
    kept = kept.withColumn("also_from", also)
    alone = F.when(~several, F.element_at("_sources", 1)["source"])
    clash = F.size(F.collect_set(alone).over(Window.partitionBy(KEY, DATE))) > 1
    return kept.withColumn("clash", clash).drop("_c", "_most", "_sources", "_r", "_not_pdf", "_not_fhir")


def lab_trend(lab: DataFrame, document: DataFrame | None = None, key: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Results of an analyte (or all) in order of date (none last), page and id, collapsed, with range_status and out_of_range."""
    rows = lab.filter(X.between(DATE, start, end))
    if key:
        rows = rows.filter(F.col(KEY) == key)
    if document is not None:
        rows = rows.join(document.select(F.col("id").alias("document_id"), "path"), "document_id").withColumn("citation", F.concat_ws(", p. ", "path", F.col("page_no").cast("string")))
    if "source" not in rows.columns:
        rows = rows.withColumn("source", lab_source())
    out = collapse(rows).withColumn("range_status", X.range_status()).withColumn("out_of_range", X.out_of_range())
    return out.orderBy(KEY, F.asc_nulls_last(DATE), "id")


def lab_coverage(lab: DataFrame, key: str) -> DataFrame:
    return lab.filter(F.col(KEY) == key).agg(F.count("*").alias("n"), F.min(DATE).alias("first"), F.max(DATE).alias("last"))


def list_analytes(lab: DataFrame, search: str | None = None, limit: int | None = None) -> DataFrame:
    rows = lab.filter(F.col("analyte").ilike(f"%{search}%") | F.col(KEY).ilike(f"%{search}%")) if search else lab
    out = rows.groupBy(KEY, "panel").agg(F.count("*").alias("n"), F.min(DATE).alias("first"), F.max(DATE).alias("last"), F.max("analyte").alias("printed_as")).orderBy(F.desc("n"), KEY)
    return out.limit(limit) if limit else out


def panel_siblings(lab: DataFrame, key: str) -> DataFrame:
    """The other analytes of the same panel that reports hold; of several panels the first by name counts."""
    panel = lab.filter((F.col(KEY) == key) & (F.col("panel") != "")).agg(F.min("panel").alias("panel"))
    held = lab.join(F.broadcast(panel), "panel", "left_semi").filter(F.col(KEY) != key)  # one row
    return held.groupBy(KEY).agg(F.count("*").alias("n"), F.max("analyte").alias("printed_as"), F.min(DATE).alias("first"), F.max(DATE).alias("last")).orderBy(F.desc("n"), KEY)


def lab_signals(collapsed: DataFrame) -> DataFrame:
    """At most one signal for each analyte, from the draws of its dates: sources that disagree about the latest, out of range,
    returned to range, near a limit and moving toward it. A latest result in text gives none unless flagged.

    analyte_key, kind, latest_date, latest, latest_text, previous_date, previous, limit_side, limit."""
    usable = collapsed.filter(F.col(DATE).isNotNull() & (F.col("value_num").isNotNull() | (F.col("value_text") != "")))
    flagged = F.coalesce(F.col("flag") != "", F.lit(False)) | F.coalesce(X.out_of_range(), F.lit(False))
    draw = F.struct("id", "value_num", "value_text", "ref_low", "ref_high", flagged.alias("out"))
    by_date = usable.groupBy(KEY, DATE).agg(
        F.max_by(draw, "id").alias("d"),
        (F.size(F.collect_set(F.struct("value_num", "value_text", "unit"))) > 1).alias("disagree"),
        F.max_by(F.when(flagged, draw), F.when(flagged, F.col("id"))).alias("last_out"),
    )
    order = Window.partitionBy(KEY).orderBy(DATE)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    dated = by_date.withColumn("p", F.lag(F.struct(F.col(DATE), F.col("d"))).over(order))
    dated = dated.withColumn("o", F.last(F.when(F.col("last_out").isNotNull(), F.struct(F.col(DATE), F.col("last_out").alias("d"))), ignorenulls=True).over(earlier))
    last = dated.withColumn("_r", F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(DATE)))).filter("_r = 1")
    v, low, high, moved = F.col("d.value_num"), F.col("d.ref_low"), F.col("d.ref_high"), F.col("d.value_num") - F.col("p.d.value_num")
    band = F.when(low.isNotNull() & high.isNotNull(), (high - low) * NEAR_SPAN).otherwise(F.abs(F.coalesce(high, low)) * NEAR_SINGLE)
    side = F.when((high - v <= band) & (moved > 0), "high").when((v - low <= band) & (moved < 0), "low")
    kind = (
        F.when(F.col("disagree"), "lab_sources_disagree")
        .when(F.col("d.out"), "lab_out_of_range")
        .when(v.isNull(), None)
        .when(F.col("o").isNotNull(), "lab_returned_to_range")
        .when(side.isNotNull(), "lab_near_limit")
    )
    before = F.when(F.col("kind") == "lab_returned_to_range", F.col("o")).when(F.col("kind") != "lab_sources_disagree", F.col("p"))
    near = F.col("kind") == "lab_near_limit"
    return (
        last.withColumn("kind", kind)
        .filter(F.col("kind").isNotNull())
        .withColumn("b", before)
        .select(
            KEY, "kind", F.col(DATE).alias("latest_date"), v.alias("latest"), F.col("d.value_text").alias("latest_text"),
            F.col(f"b.{DATE}").alias("previous_date"), F.col("b.d.value_num").alias("previous"),
            F.when(near, side).alias("limit_side"), F.when(near, F.when(side == "high", high).otherwise(low)).alias("limit"),
        )
    )
