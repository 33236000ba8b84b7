"""A made-up service: ranges are halved until they fit, each hit is fetched once, and a second run asks only for the rest."""

from datetime import date, timedelta

import pytest

from vitalspan.catalog import Catalog
from vitalspan.sources import slices

SCHEMA = "pmid string, title string"
START = date(2020, 1, 1)


def service(broken=(), flaky=()):
    """45,000 hits, denser towards the end; one of a hundred comes in two days."""

    def hits(first, last):
        a, z = ((date.fromisoformat(x) - START).days for x in (first, last))
        return [i if i % 100 or not i else i - 1 for d in range(max(a, 0), min(z, 299) + 1) for i in range(d * d // 2, (d + 1) * (d + 1) // 2)]

    tried = {}

    def page(query, first, last, offset, size):
        if first in broken:
            raise slices.ServiceError(400)
        if first in flaky and tried.setdefault((first, offset), 0) < 2:
            tried[first, offset] += 1
            raise slices.ServiceError(503)
        return [{"pmid": str(i), "title": f"{query} {i}"} for i in hits(first, last)[offset : offset + size]]

    return lambda query, first, last: len(hits(first, last)), page


def test_each_hit_is_fetched_once(spark, tmp_path):
    corpus = Catalog.open(spark, str(tmp_path), "corpus", create=True)
    end = (START + timedelta(days=400)).isoformat()
    count, page = service()
    planned = list(slices.plan(lambda a, z: count("q", a, z), START.isoformat(), end, 5000))
    assert sum(s.hits for s in planned) == 45_000 and max(s.hits for s in planned) <= 5000 and all(a.last < b.first for a, b in zip(planned, planned[1:], strict=False))
    bad = planned[3].first
    count, page = service(broken={bad}, flaky={planned[1].first})
    run = lambda c, p: slices.fetch(corpus, "q", START.isoformat(), end, c, p, SCHEMA, limit=5000, pause=0.0)
    rows, counts = run(count, page)
    assert counts["failed"] == 1 and counts["done"] == len(planned) - 1 and counts["fetched"] == 45_000 - planned[3].hits
    (failed,) = corpus.table("slice").filter("status = 'failed'").collect()
    assert (failed["first"], failed["error"], failed["fetched"]) == (bad, "ServiceError 400", 0)
    first = {r["pmid"] for r in rows.collect()}
    count, page = service()
    asked = []
    again, counts = run(lambda q, a, z: asked.append((a, z)) or count(q, a, z), page)
    assert counts == {"done": 1, "failed": 0, "fetched": planned[3].hits, "skipped": len(planned) - 1} and all(planned[3].first <= a for a, _ in asked[:1])
    both = first | {r["pmid"] for r in again.collect()}
    assert len(both) == 45_000 - 449 and rows.count() == len(first)
    assert run(count, page)[0].count() == 0 and corpus.table("slice").filter("status = 'failed'").isEmpty()


def test_errors_are_told_apart():
    waits, calls = [], []

    def busy(n, error):
        def call():
            calls.append(1)
            if len(calls) <= n:
                raise error
            return "there"

        return call

    assert slices.retried(busy(2, slices.ServiceError(429)), sleep=waits.append) == "there" and len(waits) == 2 and waits[1] > waits[0] / 2
    calls.clear()
    with pytest.raises(slices.ServiceError):
        slices.retried(busy(1, slices.ServiceError(404)), sleep=waits.append)
    assert len(calls) == 1 and slices.is_transient(TimeoutError()) and not slices.is_transient(ValueError())
    with pytest.raises(ConnectionError):
        slices.retried(busy(99, ConnectionError()), sleep=waits.append)
    with pytest.raises(slices.TooMany):
        list(slices.plan(lambda a, z: 10, "2020-01-01", "2020-01-03", 5))
    assert slices._open_ranges([("2020-01-03", "2020-01-04")], "2020-01-01", "2020-01-09") == [("2020-01-01", "2020-01-02"), ("2020-01-05", "2020-01-09")]
