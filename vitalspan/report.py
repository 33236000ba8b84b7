"""A sheet of questions for a visit: what stood out in results and metrics, each with its figures, dates and sources."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan import constants as C
from vitalspan.catalog import Catalog
from vitalspan.functions.words import article_citation
from vitalspan.guard import NOTICE
from vitalspan.operators import labs, series, sleep, windows
from vitalspan.search import corpus as literature
from vitalspan.search.keyword import build_index

ORDER = ("lab_out_of_range", "lab_sources_disagree", "lab_near_limit", "lab_returned_to_range", "metric_shift")
QUESTIONS = {
    "lab_out_of_range": "Ask whether your {} needs another look.",
    "lab_sources_disagree": "Ask which record of your {} is right.",
    "lab_near_limit": "Ask whether your {} is worth watching.",
    "lab_returned_to_range": "Ask whether your {} should still be checked.",
    "metric_shift": "Ask about your {}.",
}
#: Shown units and what raw values are divided by, where the export's aren't what people say.
SHOWN = {"resting-hr": ("bpm", 1.0), "sleep": ("min", 60.0)}


@dataclass
class Signal:
    kind: str
    subject: str
    label: str
    evidence: dict
    caveats: list[str] = field(default_factory=list)
    finding: dict | None = None


@dataclass
class Sheet:
    prepared: str
    window_days: int
    signals: list[Signal]
    gaps: list[str]
    looked_at: dict


def daily_values(index: Catalog, aliases: tuple[str, ...] = tuple(C.SHIFT_THRESHOLDS)) -> DataFrame:
    """metric, date, value, sources of the watched metrics: sleep by night, without nights that have none."""
    rollup, out = index.table("daily_metric"), None
    for alias in aliases:
        if alias == "sleep":
            rows = sleep.sleep_nights(index.table("record")).filter("asleep_seconds > 0").select(F.col("night").alias("date"), F.col("asleep_seconds").alias("value"), F.array("source").alias("sources"))
        else:
            rows = series.metric_series(rollup, alias).select(F.to_date("period").alias("date"), "value", F.filter(F.map_keys("by_source"), lambda s: s != series.UNKNOWN).alias("sources"))
        rows = rows.select(F.lit(alias).alias("metric"), "date", "value", "sources")
        out = rows if out is None else out.unionByName(rows)
    return out


def gather(index: Catalog, window_days: int = 30, today: date | None = None) -> Sheet:
    lab = index.table("lab_result")
    found = labs.lab_signals(labs.lab_trend(lab))
    signals = [Signal(r["kind"], r["analyte_key"], C.analyte_label(r["analyte_key"]), r.asDict()) for r in found.collect()]  # one for each analyte at most
    shifts = {r["metric"]: r for r in windows.metric_shifts(daily_values(index), window_days).collect()}  # a row for each watched metric
    gaps = []
    for alias in C.SHIFT_THRESHOLDS:
        r, label = shifts.get(alias), C.metric_of(alias).label
        if r is None:
            gaps.append(f"{label}: none in the export")
        elif r["gap"]:
            gaps.append(f"{label}: {r[r['gap'] + '_days']} days in the {window_days} {'up to' if r['gap'] == 'recent' else 'before the window ending'} {r['last']}")
        elif r["shifted"]:
            caveat = [f"Recorded by {', '.join(r['recent_sources']) or 'an unnamed device'} lately and by {', '.join(r['prior_sources']) or 'an unnamed device'} before; a change of device can move the level by itself."] if r["devices_differ"] else []
            signals.append(Signal("metric_shift", C.metric_of(alias).identifier, label, r.asDict() | {"alias": alias, "window_days": window_days}, caveat))
    held = lab.agg(F.count("*").alias("results"), F.countDistinct("analyte_key").alias("analytes"), F.min("collected_date").alias("first"), F.max("collected_date").alias("last")).first().asDict()
    signals.sort(key=lambda s: (ORDER.index(s.kind), s.subject))
    return Sheet((today or date.today()).isoformat(), window_days, signals, gaps, held)


def attach_literature(sheet: Sheet, corpus: Catalog, most: int = 3) -> Sheet:
    """For the first flagged analytes, the strongest finding that may be cited."""
    chunk, article = corpus.table("article_chunk"), corpus.table("article")
    index = build_index(chunk)
    for s in [s for s in sheet.signals if s.kind == "lab_out_of_range"][:most]:
        hits = literature.keyword_search(index, chunk, article, s.label, 5).filter(literature.citable())
        best = literature.evidence_order(hits, 1).first()
        s.finding = best.asDict() if best else None
    return sheet


def lab_context(sheet: Sheet, corpus: Catalog, analytes: int = 3, findings: int = 2) -> list[dict]:
    """For results out of range: the strongest findings that may be cited, a few for a few analytes."""
    chunk, article = corpus.table("article_chunk"), corpus.table("article")
    index, out = build_index(chunk), []
    for s in [s for s in sheet.signals if s.kind == "lab_out_of_range"][:analytes]:
        hits = literature.keyword_search(index, chunk, article, s.label, findings * 4).filter(literature.citable()).dropDuplicates(["pmid"])
        rows = literature.evidence_order(hits, findings).select("pmid", "title", "year", "tier", article_citation().alias("citation")).collect()
        out.append({"analyte": s.subject, "label": s.label, "findings": [r.asDict() for r in rows]})
    return out


def _figure(x: float | None, text: str | None = None) -> str:
    return text or "no number" if x is None else f"{x:g}"


def sentence(s: Signal) -> str:
    """The figures of a signal in words that only report."""
    e = s.evidence
    if s.kind == "metric_shift":
        unit, by = SHOWN.get(e["alias"], ("", 1.0))
        kind, amount = C.SHIFT_THRESHOLDS[e["alias"]]
        cutoff = f"{amount:g}%" if kind == "pct" else f"{amount / by:g} {unit}".strip()
        start = e["last"] - timedelta(days=e["window_days"] - 1)
        return f"It averaged {e['recent_mean'] / by:.1f} {unit} from {start} to {e['last']} and {e['prior_mean'] / by:.1f} {unit} in the {e['window_days']} days before, more than this sheet's cutoff of {cutoff} apart.".replace("  ", " ")
    latest = f"{_figure(e['latest'], e['latest_text'])} on {e['latest_date']}"
    before = f"{_figure(e['previous'])} on {e['previous_date']}" if e["previous_date"] else None
    if s.kind == "lab_sources_disagree":
        return f"The records of {e['latest_date']} give more than one value."
    if s.kind == "lab_near_limit":
        return f"It was {latest}, inside the printed range and closer to its {'upper' if e['limit_side'] == 'high' else 'lower'} limit of {e['limit']:g} than {before}."
    if s.kind == "lab_returned_to_range":
        return f"It was {before}, outside the printed range or flagged, and {latest}."
    return f"It was {latest}, outside the printed range or flagged" + (f", after {before}." if before else ".")


def render(sheet: Sheet) -> str:
    held = sheet.looked_at
    lines = ["# Questions for your next visit", "", f"Prepared {sheet.prepared} from your own files. Each item is a value that stood out and a question it may be worth asking.", "", "## Looked at"]
    lines.append(f"- {held['results']} laboratory results of {held['analytes']} analytes, {held['first']} to {held['last']}" if held["results"] else "- No laboratory results")
    lines += [f"- Wearable metrics in windows of {sheet.window_days} days, each up to its own last day", ""]
    lines.append("## Questions" if sheet.signals else "Nothing stood out by this sheet's cutoffs, which says nothing about your health.")
    for i, s in enumerate(sheet.signals, 1):
        lines.append(f"{i}. **{QUESTIONS[s.kind].format(s.label)}** {sentence(s)}")
        lines += [f"   {c}" for c in s.caveats]
        if s.finding:
            lines.append(f"   Research you could bring: *{s.finding['title']}* ({s.finding['year']}, {s.finding['tier'].replace('_', ' ')}, PMID {s.finding['pmid']}).")
    if sheet.gaps:
        lines += ["", "## Not enough data to check", *(f"- {g}" for g in sheet.gaps)]
    return "\n".join([*lines, "", f"_{NOTICE}_", ""])
