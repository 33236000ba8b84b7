"""The questions an index answers, as tools with JSON payloads: figures with their sources, units, coverage, and reasons.

A tool never raises: an argument that can't be used is an error in its payload. Lists are capped to the latest entries and
say so. What is collected here is what is shown: a page of periods, results or passages."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan import constants as C
from vitalspan.catalog import Catalog
from vitalspan.functions import exprs as X
from vitalspan.functions import sides as words
from vitalspan.functions.words import passage_citation
from vitalspan.operators import clinical, documents, held, labs, series, sleep, windows, workouts
from vitalspan.search import corpus as literature
from vitalspan.search.keyword import bm25, build_index
from vitalspan.search.vectors import vector_search

#: Entries shown at most.
POINTS, LAB_POINTS, FACTS, HITS, FINDINGS, HIT_CHARS, FINDING_CHARS, ANALYTES, BATCH_POINTS, NOTES = 60, 40, 200, 8, 5, 600, 700, 30, 6, 5


@dataclass
class Context:
    index: Catalog
    corpus: Catalog | None = None
    embed: Callable[[list[str]], list | None] | None = None
    vectors: DataFrame | None = None


def _plain(x):
    if hasattr(x, "asDict"):
        return {k: _plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, (date, datetime)):
        return x.isoformat()
    return float(x) if isinstance(x, Decimal) else x


def _rows(df: DataFrame, most: int, order: list, latest: bool = False) -> tuple[list[dict], dict]:
    """Up to `most` rows in order (the latest, if asked) and a note if there are more."""
    by = [F.desc(c) for c in order] if latest else order
    found = [_plain(r) for r in df.orderBy(*by).limit(most + 1).collect()]
    more = len(found) > most
    found = found[:most]
    return (found[::-1] if latest else found), ({"truncated": True, "shown": f"the {'latest' if latest else 'first'} {most}"} if more else {})


def _unit(payload: dict) -> dict:
    """A missing unit is said, never shown as if it were one."""
    for key in ("unit",):
        if payload.get(key) == X.UNLABELLED:
            payload[key] = None
            payload["unit_note"] = "these records name no unit"
    return payload


def query_metric(ctx: Context, metric: str, start_date: str | None = None, end_date: str | None = None, period: str = "day", aggregation: str | None = None, source: str | None = None, combine: str = "auto") -> dict:
    rollup = ctx.index.table("daily_metric")
    known = C.metric_of(metric)
    if known.identifier == C.SLEEP_TYPE:
        return query_sleep(ctx, start_date, end_date)
    held = _plain(series.coverage(rollup, metric).first())
    if not held["n"] and not C.find_metric(metric):
        similar = [r["type"] for r in series.list_types(rollup, metric.split()[0] if metric.split() else None, 5).collect()]
        return {"error": "unknown_metric", "metric": metric, "did_you_mean": [m.aliases[0] if m.aliases else m.identifier for m in C.suggest_metrics(metric)], "similar_types": similar}
    base = {"metric": known.identifier, "label": known.label, "total_records": held["n"], "available_from": held["first"], "available_to": held["last"]}
    points = series.metric_series(rollup, metric, period, aggregation, start_date, end_date, source, combine=combine)
    agg = aggregation or known.default_agg
    shown, note = _rows(points, POINTS, ["period", "category"], latest=True)
    if not shown:
        why = "no such records at all; nothing else stands in for them" if not held["n"] else "records exist, but not in this range"
        return base | {"points": [], "no_data_in_range": True, "note": why}
    whole = _plain(series.overall(points, agg).first())
    several = points.filter("multi_source").count()
    out = base | {"aggregation": agg, "period": period, "unit": shown[0]["unit"], "overall": whole, "points": [{"period": p["period"], "value": p["value"], "samples": p["source_n"], "source": p["source"], **({"category": p["category"]} if p["category"] else {}), **({"per_source": p["by_source"]} if p["multi_source"] else {})} for p in shown]} | note
    if several and not source:
        how = "each figure is the largest device's, since adding devices that overlap counts twice" if agg in ("sum", "count", "duration") else "figures of several devices are weighted by their samples"
        out["multi_source_warning"] = f"{several} periods have more than one device; {how}"
    if len(shown[0]["series_units"]) > 1:
        out["unit_warning"] = f"several units, none converted: {', '.join(shown[0]['series_units'])}"
    return _unit(out)


def query_sleep(ctx: Context, start_date: str | None = None, end_date: str | None = None) -> dict:
    record = ctx.index.table("record")
    asked = sleep.sleep_nights(record, start_date, end_date)
    nights, note = _rows(asked, POINTS, ["night"], latest=True)
    held = _plain(sleep.sleep_coverage(record).first())
    out = {"metric": C.SLEEP_TYPE, "label": "Sleep analysis", "nights": nights, "total_records": held["n"], "available_from": held["first"], "available_to": held["last"]} | note
    if not nights:
        out["no_data_in_range"] = True
    else:
        # Over all nights asked for, however many are shown.
        out["average_asleep_seconds"] = asked.agg(F.avg(F.when(F.col("asleep_seconds") > 0, F.col("asleep_seconds")))).first()[0]
    return out


def _trend(ctx: Context, analyte: str, start: str | None, end: str | None, most: int) -> dict:
    lab = ctx.index.table("lab_result")
    key = C.analyte_key(analyte)[0]
    shown, note = _rows(labs.lab_trend(lab, key=key, start=start, end=end).withColumn("_d", F.coalesce("collected_date", F.lit("9999"))), most, ["_d", "id"], latest=True)
    held = _plain(labs.lab_coverage(lab, key).first())
    out = {"analyte": key, "label": C.analyte_label(key), "points": [{k: p.get(k) for k in ("collected_date", "value_num", "value_text", "unit", "ref_text", "flag", "range_status", "also_from", "clash")} for p in shown], "total_results": held["n"], "available_from": held["first"], "available_to": held["last"]} | note
    if not shown:
        out |= {"no_data_in_range": True, "note": "no such result in the reports" if not held["n"] else "results exist, but not in this range"}
    if any(p["clash"] for p in shown):
        out["source_disagreement"] = "reports and the health system give different values for a date; both are shown"
    odd = sorted({p["unit"] for p in shown if C.unit_looks_wrong(key, p["unit"])})
    return out | ({"unit_advice": f"unusual for this analyte: {', '.join(odd)}"} if odd else {})


def get_lab_trend(ctx: Context, analyte: str | None = None, analytes: list[str] | str | None = None, start_date: str | None = None, end_date: str | None = None) -> dict:
    wanted = [analytes] if isinstance(analytes, str) else analytes or []
    if not wanted:
        if not analyte:
            return {"error": "analyte is required"}
        siblings = _plain(labs.panel_siblings(ctx.index.table("lab_result"), C.analyte_key(analyte)[0]).limit(ANALYTES).collect())
        return _trend(ctx, analyte, start_date, end_date, LAB_POINTS) | {"same_panel": siblings}
    trends = [_trend(ctx, a, start_date, end_date, BATCH_POINTS) for a in wanted[:ANALYTES]]
    out_now = [{"analyte": t["analyte"], **t["points"][-1]} for t in trends if t["points"] and t["points"][-1]["range_status"] == "out_of_range"]
    return {"results": trends, "out_of_range_on_latest": out_now} | ({"_and_more": len(wanted) - ANALYTES} if len(wanted) > ANALYTES else {})


def get_workouts(ctx: Context, start_date: str | None = None, end_date: str | None = None, activity: str | None = None, indoor: bool | None = None, exclude_source: list[str] | str | None = None, measures: list[str] | str | None = None, derive: list[str] | str | None = None, period: str | None = None, detail: bool = False, limit: int = 20) -> dict:
    workout, stat = ctx.index.table("workout"), ctx.index.table("workout_stat")
    as_list = lambda x: [x] if isinstance(x, str) else list(x or [])
    chosen = {"activity": activity, "start": start_date, "end": end_date, "indoor": indoor, "exclude": as_list(exclude_source)}
    held = _plain(workout.agg(F.count("*").alias("n"), F.min("local_date").alias("first"), F.max("local_date").alias("last")).first())
    base = {"total_workouts": held["n"], "available_from": held["first"], "available_to": held["last"]}
    if period:
        shown, note = _rows(workouts.workout_series(workout, stat, period, as_list(measures), as_list(derive), **chosen), POINTS, ["period"], latest=True)
        found = {"periods": shown} | note
    elif detail or measures or derive:
        rows = workouts.workout_detail(workout, stat, as_list(measures), as_list(derive), None, **chosen).drop("statistics", "metadata", "dedup_key", "seq")
        shown, note = _rows(rows, limit, ["start_epoch"], latest=True)
        found = {"workouts": shown} | note
    else:
        shown, note = _rows(workouts.workout_summary(workout, None, **chosen), limit, [F.desc("n"), "activity_type"])
        found = {"summary": shown} | note
    if not shown:
        found |= {"no_data_in_range": True, "without_one_filter": filter_relaxation(workout, chosen)}
    return base | found


def filter_relaxation(workout: DataFrame, chosen: dict) -> dict[str, int]:
    """Which single filter, left out, brings workouts back, and how many."""
    probes = {}
    for name, value in chosen.items():
        if value not in (None, [], ()):
            n = workouts.select_workouts(workout, **{k: v for k, v in chosen.items() if k != name}).count()
            if n:
                probes[name] = n
    return probes


def compare_windows(ctx: Context, metric: str | None = None, workouts: bool = False, activity: str | None = None, measure: str | None = None, derive: str | None = None, aggregation: str | None = None, anchor_date: str | None = None, anchor_fact: str | None = None, before_days: int = 30, after_days: int = 30, left: list[str] | None = None, right: list[str] | None = None, period: str = "day", indoor: bool | None = None, exclude_source: list[str] | str | None = None) -> dict:
    leave = (exclude_source,) if isinstance(exclude_source, str) else tuple(exclude_source or ())
    spec = windows.Spec(metric, aggregation, workouts, activity, measure, derive, indoor, leave)
    note = {}
    if left and right:
        spans = tuple(left), tuple(right)
    else:
        anchor, candidates = windows.resolve_anchor(ctx.index.table("clinical_fact"), anchor_date, anchor_fact)
        if anchor is None:
            return {"error": "anchor_ambiguous" if candidates else "anchor_not_found", "candidates": candidates}
        spans, note = windows.anchored(anchor, int(before_days), int(after_days)), {"anchor": anchor}
    tables = {"rollup": ctx.index.table("daily_metric")} if metric else {"workout": ctx.index.table("workout"), "stat": ctx.index.table("workout_stat")}
    out, substituted = windows.compare_or_substitute(spec.checked(), *spans, period, **tables)
    row = _plain(out.first())
    raw = [{"from": f, "to": t} | row[k] for (f, t), k in zip(spans, ("before", "after"), strict=True)]
    lacking = any(not s["n"] or not s["value_periods"] for s in raw)
    there = _plain(held.held(spec, **tables).first()) if lacking or substituted else None
    key = spec.measure or ("efficiency" if spec.derive == "efficiency" else None)
    depths = (None, None)
    if key and not substituted and (key == "efficiency" or ":" in key):
        depths = tuple(_plain(held.depth(spec, span, tables["workout"], ctx.index.table("record")).first()) for span in spans)
    instead = "durations, since no workout has the measure" if substituted else None
    payload = {"compared": spec.label, "left": _unit(raw[0]), "right": _unit(raw[1]), "verdict": row["verdict"], "devices_differ": row["devices_differ"]}
    payload["text"] = words.text(spec, raw, row["verdict"], windows.THIN, there, depths, note.get("anchor"), instead)
    return payload | note | ({"substituted": instead} if substituted else {}) | ({"held": there} if there else {}) | ({"sample_depth": depths} if any(depths) else {})


def search_records(ctx: Context, query: str, limit: int = HITS, kind: str | None = None) -> dict:
    document, chunk = ctx.index.table("document"), ctx.index.table("chunk")
    held = document.filter(documents.of_kind(kind)) if kind else document
    among = chunk.join(held.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("id")
    hits, how = None, "keyword"
    made = ctx.embed([query]) if ctx.embed and ctx.vectors is not None else None
    if made:
        near = vector_search(ctx.vectors, made[0], min(limit, HITS), among=among).select(F.col("chunk_id").alias("id"), "score")
        hits, how = (near, "semantic") if not near.isEmpty() else (None, how)
    if hits is None:
        hits = bm25(*build_index(chunk), query, min(limit, HITS), among=among)
    shown = hits.join(chunk, "id").join(document.select(F.col("id").alias("document_id"), "path", "title", "kind", "doc_date"), "document_id").withColumn("page_no", F.lit(None).cast("int")).select("score", "path", "title", "kind", "doc_date", "section", passage_citation().alias("citation"), F.substring("text", 1, HIT_CHARS).alias("text"))
    found = [_plain(r) for r in shown.orderBy(F.desc("score"), "path").collect()]
    out = {"query": query, "search": how, "hits": found}
    if not found:
        out["tags_that_match"] = [r["tag"] for r in documents.tags_matching(ctx.index.table("document_tag"), query).limit(HITS).collect()]
        out["note"] = "nothing found; that isn't evidence of absence outside these documents"
    return out


def search_medical_literature(ctx: Context, query: str, limit: int = FINDINGS, min_tier: str | None = None, since_year: int | None = None) -> dict:
    if ctx.corpus is None:
        return {"error": "no_corpus", "note": "no literature is installed"}
    chunk, article = ctx.corpus.table("article_chunk"), ctx.corpus.table("article")
    found = literature.search(build_index(chunk), ctx.vectors, chunk, article, query, ctx.embed, min(limit, FINDINGS), min_tier=min_tier, since_year=since_year)
    rows = found.select("pmid", "title", "journal", "year", "tier", "retracted", literature.citable().alias("citable"), F.substring("text", 1, FINDING_CHARS).alias("text"), "position", "tier_rank")
    shown = [_plain(r) for r in literature.evidence_order(rows).collect()]
    return {"query": query, "findings": shown} | ({} if shown else {"note": "the literature held doesn't cover this"})


def notes_beside(ctx: Context, kind: str | None) -> list[dict]:
    """Passages of the person's notes on the same kind of thing, one for each document."""
    words = {"condition": "diagnosed condition diagnosis", "medication": "medication taking dose mg", "allergy": "allergy allergic reaction", "immunization": "vaccine vaccination shot", "procedure": "surgery procedure operation"}
    chunk = ctx.index.table("chunk")
    hits = bm25(*build_index(chunk), words.get(kind or "", " ".join(words.values())), NOTES * 4)
    rows = hits.join(chunk, "id").orderBy(F.desc("score")).select("document_id", F.substring("text", 1, HIT_CHARS).alias("text")).collect()
    seen: dict[int, str] = {}
    for r in rows:
        seen.setdefault(r["document_id"], r["text"])
    return [{"document_id": d, "text": t} for d, t in list(seen.items())[:NOTES]]


def get_clinical_history(ctx: Context, kind: str | None = None, since: str | None = None) -> dict:
    fact, document = ctx.index.table("clinical_fact"), ctx.index.table("document")
    if kind and kind not in clinical.FACT_KINDS:
        return {"error": f"unknown kind: {kind}", "kinds": list(clinical.FACT_KINDS)}
    shown = [_plain(r) for r in clinical.clinical_facts(fact, document, kind, since, FACTS + 1).collect()]
    held = [_plain(r) for r in clinical.holdings(fact, *(ctx.index.table(t) for t in ("clinical_vital", "lab_result", "document"))).collect()]
    out = {"facts": shown[:FACTS], "holdings": held, "held": clinical.holdings_phrase(held), "notes_beside": notes_beside(ctx, kind)}
    return out | ({"truncated": True} if len(shown) > FACTS else {}) | ({} if shown else {"note": "the clinical records hold none; that says nothing about the person"})


def get_clinical_vitals(ctx: Context, metric: str | None = None, start_date: str | None = None, end_date: str | None = None) -> dict:
    vital, document = ctx.index.table("clinical_vital"), ctx.index.table("document")
    shown = [_plain(r) for r in clinical.clinical_vitals(vital.withColumn("local_date", F.to_date("local_date")), document, metric, start_date, end_date, FACTS + 1).drop("dedup_key").collect()]
    out = {"readings": shown[:FACTS], "metrics": [_plain(r) for r in clinical.vital_metrics(vital).limit(FACTS).collect()]}
    return out | ({"truncated": True} if len(shown) > FACTS else {}) | ({} if shown else {"no_data_in_range": True})


TOOLS: dict[str, tuple[Callable[..., dict], str]] = {
    "query_healthkit": (query_metric, "a metric from the wearable export over time"),
    "get_lab_trend": (get_lab_trend, "laboratory results with their printed ranges, one analyte or several"),
    "get_workouts": (get_workouts, "workouts: by activity, one by one, or by period"),
    "compare_windows": (compare_windows, "two windows side by side, with a verdict on whether they can be compared"),
    "search_records": (search_records, "passages of the person's own documents"),
    "search_medical_literature": (search_medical_literature, "research findings, strongest evidence first"),
    "get_clinical_history": (get_clinical_history, "conditions, medications, allergies, immunizations, procedures"),
    "get_clinical_vitals": (get_clinical_vitals, "vitals that clinicians measured"),
}


def schemas() -> list[dict]:
    """Names, purposes and arguments of the tools."""
    import inspect

    return [{"name": n, "description": why, "arguments": {p.name: None if p.default is p.empty else p.default for p in list(inspect.signature(f).parameters.values())[1:]}, "required": [p.name for p in list(inspect.signature(f).parameters.values())[1:] if p.default is p.empty]} for n, (f, why) in TOOLS.items()]


def dispatch(ctx: Context, name: str, arguments: dict | None = None) -> dict:
    if name not in TOOLS:
        return {"error": f"unknown tool: {name}", "tools": list(TOOLS)}
    for key, value in (arguments or {}).items():
        if key.endswith("_date") and value:
            try:
                date.fromisoformat(value)
            except (TypeError, ValueError):
                return {"error": f"{key} must be a date like 2026-03-01, not {value!r}"}
    try:
        return TOOLS[name][0](ctx, **(arguments or {}))
    except Exception as e:  # what goes wrong is the answer
        return {"error": f"{type(e).__name__}: {str(e).splitlines()[0][:300]}"}


def serialize(payload: dict) -> str:
    return json.dumps(payload, default=str, ensure_ascii=False)


def data_inventory(ctx: Context, most: int = 30) -> dict:
    """What there is to ask about, in short lists that say how much they leave out."""

    def capped(df: DataFrame, column: str) -> dict:
        found = [r[column] for r in df.select(column).limit(most + 1).collect()]
        return {"listed": found[:most]} | ({"_and_more": df.count() - most} if len(found) > most else {})

    t = ctx.index.table
    return {
        "summary": _plain(series.index_summary(t("daily_metric"), t("workout")).first()),
        "metrics": capped(series.list_types(t("daily_metric")), "type"),
        "analytes": capped(labs.list_analytes(t("lab_result")), "analyte_key"),
        "workouts": capped(workouts.workout_summary(t("workout"), None).select("activity_type").distinct(), "activity_type"),
        "tags": capped(documents.list_tags(t("document"), t("document_tag")), "tag"),
        "clinical": [_plain(r) for r in clinical.holdings(t("clinical_fact"), t("clinical_vital"), t("lab_result"), t("document")).collect()],
        "literature": {r["pack"]: r["articles"] for r in literature.pack_counts(ctx.corpus.table("article_pack")).collect()} if ctx.corpus else None,
    }
