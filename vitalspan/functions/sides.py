"""Two windows in fixed words: what each holds, why they can or can't be compared, and what there is beside them.

Every sentence follows from the figures that `windows.compare`, `held.held` and `held.depth` give; no difference is stated."""

from __future__ import annotations

from vitalspan.constants import find_metric
from vitalspan.functions.exprs import UNLABELLED
from vitalspan.functions.words import activity_name, number_in_words, span_in_words

NAMES = ("First", "Second")


def counted(n: int, what: str) -> str:
    """1 period, 2 periods."""
    return f"{number_in_words(n, 0)} {what if n != 1 else what.removesuffix('s')}"


def _listed(entries: list[dict]) -> str:
    return ", ".join(f"{activity_name(e['name'])} in {counted(e['workouts'], 'workouts')}" for e in entries)


def elsewhere(spec, held: dict) -> str:
    """Where the index has the figure, for a side without a period."""
    what = "records" if spec.metric else "workouts"
    if not held["total"]:
        return f"the index has no such {what} on any day"
    return f"the index has {counted(held['total'], what)} {'of it' if spec.metric else 'of all kinds'}, {span_in_words(held['first'], held['last'])}"


def narrowed(spec, held: dict) -> list[str]:
    """What the measure, the activity and the filters asked for come to in the whole index, each said once."""
    out = []
    if not spec.metric and spec.activity and held["total"]:
        if held["activity_n"]:
            alike = f": {_listed(held['alike'])}" if len(held["alike"]) > 1 else ""
            out.append(f"activities like {spec.activity} come to {counted(held['activity_n'], 'workouts')}, {span_in_words(held['activity_first'], held['activity_last'])}{alike}")
        else:
            out.append(f"no activity is like {spec.activity}" + (f"; there are {_listed(held['activities'])}" if held["activities"] else ""))
    if "measure_n" in held:
        asked = spec.measure or "heart rate"
        if held["measure_n"]:
            out.append(f"{asked} has a number in {counted(held['measure_n'], 'workouts')}, {span_in_words(held['measure_first'], held['measure_last'])}")
        else:
            out.append(f"{asked} has a number in no workout; " + (f"there are {_listed(held['measures'])}" if held["measures"] else "no measure has any"))
    if not spec.metric and spec.indoor is not None:
        out.append(f"both sides take only workouts marked {'indoor' if spec.indoor else 'outdoor'}")
    if spec.exclude:
        out.append(f"both sides leave out {', '.join(spec.exclude)}")
    return out


def sampled(depth: dict | None) -> str:
    """How many records of a type a side's workouts hold."""
    if not depth or not depth["counted"] + depth["uncounted"]:
        return ""
    metric = find_metric(depth["type"])
    label, all_of = metric.label.lower() if metric else depth["type"], depth["counted"] + depth["uncounted"]
    if depth["median"] is None:
        return f"samples of {label} can't be counted in {counted(all_of, 'workouts')}, for want of a duration"
    return f"{depth['median']:g} samples of {label} in the median workout" + (f" ({depth['counted']} of {all_of} could be counted)" if depth["uncounted"] else "")


def devices(sides: list[dict]) -> list[str]:
    """Devices, where they aren't the same on both sides, or where one side has several in a period."""
    a, b = (s["sources"] for s in sides)
    out = [f"{NAMES[0].lower()} side by {', '.join(a)}, {NAMES[1].lower()} by {', '.join(b)}: another device may read differently"] if a and b and a != b else []
    for name, s in zip(NAMES, sides, strict=True):
        if s["multi_source_periods"]:
            out.append(f"{counted(s['multi_source_periods'], 'periods')} of the {name.lower()} side with several devices, of which the figure is one's or a mean")
    return out


def side_line(name: str, side: dict, held: dict | None, spec, depth: dict | None = None) -> str:
    """A side: its span, how much of it has the figure, and the figure."""
    span = f"{name} ({side['from']} to {side['to']})"
    if not side["n"]:
        return f"{span}: no period" + (f"; {elsewhere(spec, held)}" if held else "") + "."
    periods = counted(side["n"], "periods")
    if side["unit_mixed"]:
        return f"{span}: {periods}, in several units" + (f" ({', '.join(side['units'])})" if side["units"] else "") + ", hence without a figure."
    if not side["value_periods"]:
        return f"{span}: {periods}, without a value in any."
    unit = "" if side["unit"] in (None, UNLABELLED) else f" {side['unit']}"
    parts = [periods + (f", {side['value_periods']} with a value" if side["value_periods"] < side["n"] else ""), f"median {side['median']:g}{unit}{'' if unit else ' (no unit)'}", f"{side['low']:g} to {side['high']:g}"]
    parts += [x for x in (sampled(depth), f"by {', '.join(side['sources'])}" if side["sources"] else "", f"{counted(side['empty_periods'], 'periods')} empty" if side["empty_periods"] else "") if x]
    return f"{span}: {'; '.join(parts)}."


def reason(spec, sides: list[dict], verdict: str, thin: int, held: dict | None = None) -> str:
    """Why the verdict is what it is, with the numbers that decide it."""
    short = lambda test: [f"the {n.lower()} side" for n, s in zip(NAMES, sides, strict=True) if test(s)]
    beside = narrowed(spec, held) if held else []
    if verdict == "insufficient_data":
        who = short(lambda s: not s["n"])
        what = f"{' and '.join(who)} {'have' if len(who) > 1 else 'has'} no period"
        return "; ".join([what, *([elsewhere(spec, held)] if held else []), *beside])
    if verdict == "unit_mixed_on_one_side":
        return "; ".join(f"the {n.lower()} side mixes {', '.join(s['units']) or 'units that have no name'}" for n, s in zip(NAMES, sides, strict=True) if s["unit_mixed"]) + "; units are never converted"
    if verdict == "missing_measure_on_one_side":
        return "; ".join([f"the {n.lower()} side has {counted(s['n'], 'periods')} and no value" for n, s in zip(NAMES, sides, strict=True) if not s["value_periods"]] + beside)
    if verdict == "unit_mismatch":
        a, b = ("no unit" if s["unit"] in (None, UNLABELLED) else s["unit"] for s in sides)
        return f"{a} on the first side, {b} on the second; units are never converted"
    if verdict == "thin_on_one_side":
        return "; ".join(f"the {n.lower()} side has {counted(s['value_periods'], 'values')}" for n, s in zip(NAMES, sides, strict=True) if s["value_periods"] < thin) + f"; each needs {thin}"
    if verdict == "no_overlap":
        a, b = (f"{s['low']:g} to {s['high']:g}" for s in sides)
        return f"the ranges {a} and {b} don't overlap"
    return "; ".join(["the ranges overlap, in one unit", *devices(sides)])


def text(spec, sides: list[dict], verdict: str, thin: int, held: dict | None = None, depths: tuple = (None, None), anchor: str | None = None, substituted: str | None = None) -> str:
    """All of it, a line each."""
    lines = [f"{spec.label}: two windows.", *[side_line(n, s, held, spec, d) for n, s, d in zip(NAMES, sides, depths, strict=True)]]
    if anchor:
        lines.append(f"The day itself, {anchor}, is in neither window.")
    if substituted:
        lines.append(f"Compared instead: {substituted}.")
    lines.append(("Comparable: " if verdict == "ok" else f"Not comparable ({verdict}): ") + reason(spec, sides, verdict, thin, held) + ".")
    return "\n".join(lines)
