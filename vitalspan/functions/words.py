"""Figures and names in a reader's words, and where a passage comes from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalspan.constants import TIERS
from vitalspan.functions.exprs import UNLABELLED

ACTIVITY = "HKWorkoutActivityType"


def unit_in_words(unit: str | None) -> str:
    """The absence of a unit said, not shown as if it were one."""
    return "no unit at all" if unit is None else "no unit named" if unit == UNLABELLED else unit


def activity_name(kind: str | None) -> str:
    return (kind or "workout").removeprefix(ACTIVITY)


def number_in_words(x: float | None, places: int = 1) -> str:
    """Without needless zeros, thousands apart."""
    if x is None:
        return "no number"
    text = f"{x:,.{places}f}"
    return text.rstrip("0").rstrip(".") if "." in text else text


def span_in_words(first: str | None, last: str | None) -> str:
    return "" if not first else first if not last or first == last else f"{first} to {last}"


def tier_in_words(tier: str) -> str:
    return tier.replace("_", " ")


def tier_at_least(tier: str, floor: str) -> bool:
    """Unranked tiers are never at least anything."""
    return tier in TIERS and floor in TIERS and TIERS[tier] <= TIERS[floor]


def passage_citation(kind: str = "kind", path: str = "path", page: str = "page_no", section: str = "section", dated: str = "doc_date") -> Column:
    """A report by its page, a note by its date and heading, anything else by its path."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    report = F.concat_ws(", ", name, F.when(F.col(page).isNotNull(), F.concat(F.lit("p. "), F.col(page).cast("string"))))
    note = F.concat_ws(", ", name, F.col(dated).cast("string"), F.col(section))
    return F.when(F.col(kind) == "pdf", report).when(F.col(kind).isin("note", "image"), note).otherwise(name)


def article_citation(title: str = "title", journal: str = "journal", year: str = "year", pmid: str = "pmid") -> Column:
    return F.concat_ws(", ", F.regexp_replace(F.col(title), r"[\s.]+$", ""), F.col(journal), F.col(year).cast("string"), F.concat(F.lit("PMID "), F.col(pmid)))
