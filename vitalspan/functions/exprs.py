"""Column expressions: periods, nights, units, derivations, percentiles, identity. All of them built-ins inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalspan.constants import DURATION_SECONDS, NORMAL_FLAGS, PROTOCOL_TYPE, PUBLICATION_TYPES, TIERS

UNLABELLED, MIXED = "unlabelled", "mixed"
PERIODS = ("day", "week", "month")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_label(date: Column | str, period: str) -> Column:
    """The day, the Monday of the week, or the month as YYYY-MM."""
    if period not in PERIODS:
        raise ValueError(f"unknown period: {period}")
    d = _c(date)
    if period == "month":
        return F.date_format(d, "yyyy-MM")
    return F.date_format(d if period == "day" else F.date_trunc("week", d), "yyyy-MM-dd")


def period_bounds(date: Column | str, period: str) -> tuple[Column, Column]:
    d = _c(date)
    if period == "day":
        return d, d
    first = F.date_trunc(period, d).cast("date")
    return first, F.date_add(first, 6) if period == "week" else F.last_day(first)


def between(date: Column | str, start: str | None, end: str | None) -> Column:
    """Inclusive at both ends, either of which may be absent."""
    keep = F.lit(True)
    if start:
        keep = keep & (_c(date) >= F.lit(start).cast("date"))
    if end:
        keep = keep & (_c(date) <= F.lit(end).cast("date"))
    return keep


def sources(include: Sequence[str] = (), exclude: Sequence[str] = (), column: str = "source_name") -> Column:
    """Exclusion keeps rows without a source, since they aren't the excluded one."""
    both = set(include) & set(exclude)
    if both:
        raise ValueError(f"both included and excluded: {', '.join(sorted(both))}")
    keep = F.lit(True)
    if include:
        keep = keep & F.col(column).isin(*include)
    if exclude:
        keep = keep & (F.col(column).isNull() | ~F.col(column).isin(*exclude))
    return keep


def finite(c: Column | str) -> Column:
    """The number, or null for NaN and infinities."""
    x = _c(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def number(c: Column | str) -> Column:
    """Text to a number as Python reads it: no type suffixes, no underscores; else null."""
    text = F.trim(_c(c))
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"), text.try_cast("double"))


def seconds(duration: Column | str, unit: Column | str) -> Column:
    """Null for a unit that isn't known."""
    table = F.create_map(*[F.lit(x) for pair in DURATION_SECONDS.items() for x in pair])
    return finite(duration) * F.try_element_at(table, F.lower(F.trim(_c(unit))))


def night_of(start_text: Column | str, local_date: Column | str) -> Column:
    """Noon to noon: what starts before noon belongs to the night of the day before."""
    hour = F.substring(_c(start_text), 12, 2).try_cast("int")
    return F.when(hour >= 12, _c(local_date)).otherwise(F.date_sub(_c(local_date), 1))


def derived(value: Column, unit: Column, reason: Column) -> Column:
    return F.struct(F.when(reason.isNull(), value).alias("value"), F.when(reason.isNull(), unit).alias("unit"), reason.alias("reason"))


def _refused(*values: Column | str) -> Column:
    why = F.lit(None).cast("string")
    for v in reversed(values):
        why = F.when(_c(v).isNull(), "a value this needs is missing").when(finite(v).isNull(), F.concat(F.lit("not a number: "), _c(v).cast("string"))).otherwise(why)
    return why


def _known(unit: Column | str) -> Column:
    return F.coalesce(F.when(_c(unit) != "", _c(unit)), F.lit("?"))


def pace(distance, distance_unit, duration, duration_unit) -> Column:
    """Duration for each unit of distance, in the units given."""
    why = F.coalesce(_refused(distance, duration), F.when(_c(distance) == 0, "distance is zero"))
    return derived(F.try_divide(_c(duration), _c(distance)), F.concat(_known(duration_unit), F.lit("/"), _known(distance_unit)), why)


def speed(distance, distance_unit, duration, duration_unit) -> Column:
    """Distance an hour."""
    scale = seconds(F.lit(1.0), duration_unit)
    unknown = F.concat(F.lit("unknown duration unit: "), F.coalesce(_c(duration_unit), F.lit("None")))
    why = F.coalesce(_refused(distance, duration), F.when(_c(duration) == 0, "duration is zero"), F.when(scale.isNull(), unknown))
    return derived(F.try_divide(_c(distance), F.try_divide(_c(duration) * scale, F.lit(3600.0))), F.concat(_known(distance_unit), F.lit("/hr")), why)


def efficiency(distance, distance_unit, duration, duration_unit, heart_rate, heart_rate_unit) -> Column:
    """Speed for each hundred heartbeats a minute."""
    base = speed(distance, distance_unit, duration, duration_unit)
    why = F.coalesce(_refused(heart_rate), F.when(_c(heart_rate) == 0, "heart rate is zero"), base["reason"])
    return derived(F.try_divide(base["value"], _c(heart_rate) / 100.0), F.concat(base["unit"], F.lit(" per 100 "), _known(heart_rate_unit)), why)


def ratio(a, unit_a, b, unit_b) -> Column:
    """Within one unit only; without a unit itself."""
    named = lambda u: F.when(_c(u) != "", _c(u))
    said = lambda u: F.coalesce(_c(u), F.lit("None"))
    clash = F.concat(F.lit("incompatible units: "), said(unit_a), F.lit(" and "), said(unit_b))
    why = F.coalesce(_refused(a, b), F.when(~named(unit_a).eqNullSafe(named(unit_b)), clash), F.when(_c(b) == 0, "denominator is zero"))
    return derived(F.try_divide(_c(a), _c(b)), F.lit(None).cast("string"), why)


def nearest_rank(values: Column, p: int | Column) -> Column:
    """A percentile of an array that is a value of it: rank ceil(p * n / 100) in whole numbers, within 1 and n."""
    ordered = F.sort_array(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(ordered)
    p = F.lit(p) if isinstance(p, int) else p
    rank = F.greatest(F.lit(1), F.least(n, F.floor((p * n + 99) / F.lit(100)).cast("int")))
    return F.when(n > 0, F.element_at(ordered, rank))


def unit_set(unit: Column | str, present: Column | None = None) -> Column:
    """Aggregate: the units seen, sorted; a missing one is `unlabelled`, a unit of its own."""
    named = F.coalesce(F.when(_c(unit) != "", _c(unit)), F.lit(UNLABELLED))
    return F.array_sort(F.collect_set(named if present is None else F.when(present, named)))


def _one_unit(units: Column, value: Column) -> tuple[Column, Column]:
    single = F.nullif(F.element_at(units, 1), F.lit(UNLABELLED))
    return F.when(F.size(units) == 1, value), F.when(F.size(units) > 1, MIXED).when(F.size(units) == 1, single)


def guarded_sum(value: Column | str, unit: Column | str, name: str) -> Column:
    """Aggregate struct(value, unit, units): no value where units differ, since units are never converted."""
    present = _c(value).isNotNull()
    units = unit_set(unit, present)
    v, u = _one_unit(units, F.sum(_c(value)))
    return F.struct(v.alias("value"), u.alias("unit"), units.alias("units")).alias(name)


def guarded_median(value: Column | str, unit: Column | str, name: str) -> Column:
    """Aggregate struct(value, unit, units, reason): the median of finite values, refused where units differ."""
    present = _c(value).isNotNull()
    units = unit_set(unit, present)
    v, u = _one_unit(units, F.median(finite(value)))
    differ = F.concat(F.lit(f"{name} reported in more than one unit: "), F.array_join(units, ", "))
    reason = F.when(F.size(units) > 1, differ).when(v.isNull(), "no value in this period")
    return F.struct(v.alias("value"), u.alias("unit"), units.alias("units"), reason.alias("reason")).alias(name)


def identity(*parts: Column | str) -> Column:
    """16 bytes that name a row by its content; null and empty parts are the same."""
    joined = F.concat_ws("\x1f", *[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])
    return F.substring(F.unhex(F.sha2(joined, 256)), 1, 16)


def is_stat_key(key: Column | str) -> Column:
    return F.instr(_c(key), ":") > 0


def stat_base(key: Column | str) -> Column:
    return F.substring_index(_c(key), ":", 1)


def stat_aggregate(key: Column | str) -> Column:
    """After the first separator; empty without one."""
    return F.when(is_stat_key(key), F.regexp_replace(_c(key), "^[^:]*:", "")).otherwise("")


def indoor_flag(text: Column | str) -> Column:
    """True, False, or null where nothing was said, which isn't outdoors."""
    t = F.lower(F.trim(_c(text)))
    return F.when(t.isin("1", "true", "yes"), True).when(t.isin("0", "false", "no"), False)


def out_of_range(value="value_num", low="ref_low", high="ref_high") -> Column:
    """True or False by the printed limits alone; null without a number or limits."""
    v, lo, hi = _c(value), _c(low), _c(high)
    return F.when(v.isNull() | (lo.isNull() & hi.isNull()), None).otherwise(F.coalesce(v < lo, F.lit(False)) | F.coalesce(v > hi, F.lit(False)))


def range_status(value="value_num", low="ref_low", high="ref_high", flag="flag") -> Column:
    """The laboratory's own flag first, then the limits."""
    flagged = (F.trim(_c(flag)) != "") & ~F.upper(F.trim(_c(flag))).isin(*NORMAL_FLAGS)
    return (
        F.when(flagged, "out_of_range")
        .when(_c(value).isNull(), "not_numeric")
        .when(_c(low).isNull() & _c(high).isNull(), "no_printed_range")
        .when(out_of_range(value, low, high), "out_of_range")
        .otherwise("in_range")
    )


def reference_range(text: Column | str) -> Column:
    """struct(low, high, text) of a printed range; a one-sided range sets only the limit it states."""
    t = F.trim(_c(text))
    num = r"(-?\d+(?:\.\d+)?)"
    two, less, more = rf"^{num}\s*(?:-|–|to)\s*{num}", rf"^(?i:<=|<|less than)\s*{num}", rf"^(?i:>=|>|greater than)\s*{num}"
    take = lambda pattern, group: F.nullif(F.regexp_extract(t, pattern, group), F.lit("")).try_cast("double")
    both = t.rlike(two)
    return F.struct(
        F.when(both, take(two, 1)).when(t.rlike(more), take(more, 1)).alias("low"),
        F.when(both, take(two, 2)).when(t.rlike(less), take(less, 1)).alias("high"),
        F.nullif(t, F.lit("")).alias("text"),
    )


def evidence(types: Column | str) -> Column:
    """struct(tier, rank, source) of an array of publication types; a protocol overrides, else the strongest wins."""
    lowered = F.transform(_c(types), lambda t: F.lower(F.trim(t)))
    names = {t: tier for tier, named in PUBLICATION_TYPES.items() for t in named}
    order = list(TIERS)
    place = F.create_map(*[F.lit(x) for t, tier in names.items() for x in (t, TIERS[tier] * 100 + order.index(tier))])
    best = F.array_min(F.filter(F.transform(lowered, lambda t: F.try_element_at(place, t)), lambda x: x.isNotNull()))
    tier = F.element_at(F.array(*[F.lit(t) for t in order]), (best % 100 + 1).cast("int"))
    protocol = F.coalesce(F.array_contains(lowered, PROTOCOL_TYPE), F.lit(False))
    return F.struct(
        F.when(protocol, "protocol").when(best.isNull(), "unknown").otherwise(tier).alias("tier"),
        F.when(~protocol, F.floor(best / 100).cast("int")).alias("rank"),
        F.when(best.isNull() & ~protocol, "unmapped").otherwise("publication_type").alias("source"),
    )
