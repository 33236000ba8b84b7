"""Fetching from a service that gives no more than so many hits of a search: planning, retries and a ledger of slices.

The service is a callable; what is here decides what to ask it. A range of dates with more hits than the limit is halved until
every slice fits. Slices are fetched side by side by tasks, each on its own; one that fails for good is noted and costs no
other, and the next run plans and fetches only what isn't done."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.catalog import Catalog
from vitalspan.operators.writes import first_wins
from vitalspan.sources.streams import staged

#: Hits that a search gives at most, hits of a page, tries, and seconds before the second try (doubled for each one after).
LIMIT, PAGE, TRIES, PAUSE = 9_999, 500, 5, 1.0
#: Answers that say: later. Others of 400 and above are final.
LATER = frozenset({408, 425, 429, 500, 502, 503, 504})


class ServiceError(RuntimeError):
    """An answer with a status that isn't a success."""

    def __init__(self, status: int, message: str = ""):
        super().__init__(status, message)
        self.status = status


class TooMany(RuntimeError):
    """A single day with more hits than a search gives."""


@dataclass(frozen=True)
class Slice:
    first: str
    last: str
    hits: int


def is_transient(error: BaseException) -> bool:
    """Whether the same call may succeed later: a busy service or a broken connection, not a wrong question."""
    if isinstance(error, ServiceError):
        return error.status in LATER
    return isinstance(error, ConnectionError | TimeoutError)


def retried(call: Callable, *args, tries: int = TRIES, pause: float = PAUSE, sleep: Callable[[float], None] = time.sleep):
    """The call's result; transient errors are waited out, longer each time and never in step with others; final ones rise at once."""
    for left in range(tries - 1, -1, -1):
        try:
            return call(*args)
        except Exception as e:
            if not left or not is_transient(e):
                raise
            sleep(pause * 2 ** (tries - 1 - left) * (0.5 + random.random() / 2))


def plan(count: Callable[[str, str], int], first: str, last: str, limit: int = LIMIT) -> Iterator[Slice]:
    """Slices that cover a range of dates once, in order, none with more hits than the limit; days without hits are in none of
    their own. A day that has more is an error: dates alone can't divide it."""
    waiting = [(date.fromisoformat(first), date.fromisoformat(last))]
    while waiting:
        a, z = waiting.pop()
        if a > z:
            continue
        hits = retried(count, a.isoformat(), z.isoformat())
        if hits <= limit:
            if hits:
                yield Slice(a.isoformat(), z.isoformat(), hits)
        elif a == z:
            raise TooMany(f"{a}: {hits} hits in a day, a search gives {limit}")
        else:
            middle = a + (z - a) // 2
            waiting += [(middle + timedelta(days=1), z), (a, middle)]


def _open_ranges(done: list[tuple[str, str]], first: str, last: str) -> list[tuple[str, str]]:
    """What of the range isn't done."""
    out, at = [], date.fromisoformat(first)
    for a, z in sorted(done):
        if date.fromisoformat(a) > at:
            out.append((at.isoformat(), min(date.fromisoformat(a) - timedelta(days=1), date.fromisoformat(last)).isoformat()))
        at = max(at, date.fromisoformat(z) + timedelta(days=1))
    return [(a, z) for a, z in [*out, (at.isoformat(), last)] if a <= z]


def fetch(corpus: Catalog, query: str, first: str, last: str, count: Callable[[str, str, str], int], page: Callable[[str, str, str, int, int], list[dict]], schema: str, key: str = "pmid", limit: int = LIMIT, side_by_side: int = 3, tries: int = TRIES, pause: float = PAUSE) -> tuple[DataFrame, dict]:
    """(rows, counts): what the service has for a query between two dates, each key once, the first slice's row.

    count(query, first, last) and page(query, first, last, offset, size) are the service, and have to be sendable to tasks.
    The ledger (table `slice` of the corpus) has every slice that was fetched whole, or failed; done ones aren't asked for again.
    Rows are staged below the corpus, to be taken in by whoever called."""
    spark = corpus.spark
    held = corpus.table("slice").filter((F.col("query") == query) & (F.col("status") == "done"))
    done = [(r["first"], r["last"]) for r in held.select("first", "last").collect()]  # a row a slice
    planned = [s for a, z in _open_ranges(done, first, last) for s in plan(lambda a, z: count(query, a, z), a, z, limit)]
    asked = spark.createDataFrame([(s.first, s.last, s.hits) for s in planned], "first string, last string, hits long")
    names = [f.strip().split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, z, hits in zip(batch["first"], batch["last"], batch["hits"], strict=True):
                rows, error = [], None
                try:
                    for offset in range(0, hits, PAGE):
                        rows += retried(page, query, a, z, offset, PAGE, tries=tries, pause=pause)
                    if len(rows) < hits:
                        error = "short"
                except Exception as e:
                    error = type(e).__name__ if not isinstance(e, ServiceError) else f"{type(e).__name__} {e.status}"
                rows = [] if error else rows  # a slice counts whole or not at all
                frame = pd.DataFrame([{n: r.get(n) for n in names} for r in rows] or [dict.fromkeys(names)], columns=names)
                yield frame.assign(_first=a, _last=z, _hits=hits, _error=error, _row=bool(rows))

    found = staged(asked.repartition(max(1, min(side_by_side, len(planned)))).mapInPandas(run, f"{schema}, _first string, _last string, _hits long, _error string, _row boolean"), f"{corpus.path}/.fetched")
    outcome = found.groupBy(F.col("_first").alias("first"), F.col("_last").alias("last"), F.col("_hits").alias("hits"), F.col("_error").alias("error")).agg(F.count_if("_row").alias("fetched"))
    with corpus.transaction():
        corpus.delete("slice", (F.col("query") == query) & (F.col("status") == "failed"))
        noted = corpus.append("slice", outcome.withColumn("query", F.lit(query)).withColumn("status", F.when(F.col("error").isNull(), "done").otherwise("failed")))
    counts = noted.agg(F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("fetched"), F.lit(0)).alias("fetched")).first().asDict()
    rows = first_wins(found.filter("_row"), [key], "_first").select(*names)
    return rows, counts | {"skipped": len(done)}
