"""Percentiles against sorted lists."""

import random

from pyspark.sql import functions as F

from vitalspan.operators.ranks import nearest_ranks, stretch

PERCENTS = (0, 1, 25, 28, 50, 90, 100)


def expected(groups):
    out = {}
    for g, values in groups.items():
        held = sorted(v for v in values if v is not None and v == v and abs(v) != float("inf"))
        if held:
            out[g] = tuple(held[max(1, min(len(held), -(-p * len(held) // 100))) - 1] for p in PERCENTS)
    return out


def test_percentiles_match_sorted_lists(spark):
    rng = random.Random(4)
    groups = {f"g{n}": [rng.choice([rng.gauss(0, 1e3), rng.randrange(5), -rng.random() * 1e-9, 1e300, -0.0, None, float("nan"), float("inf")]) for _ in range(n)] for n in range(60)}
    groups |= {None: [1.0, 2.0], "none": [None], "same": [7.5] * 500, "25": [float(i) for i in range(1, 26)]}
    rows = spark.createDataFrame([(g, float(v) if v is not None else None) for g, values in groups.items() for v in values], "period string, x double")
    got = {r["period"]: tuple(r)[1:] for r in nearest_ranks(rows, ["period"], "x", PERCENTS).collect()}
    assert got == expected(groups) and got["25"][3] == 7.0
    assert nearest_ranks(rows.limit(0), ["period"], "x", PERCENTS).count() == 0


def test_stretches_keep_the_order(spark):
    df = spark.range(200_000).select(((F.rand(3) - 0.5) * F.pow(F.lit(10.0), F.floor(F.rand(4) * 20) - 10)).alias("v")).withColumn("s", stretch("v"))
    held = sorted((r["v"], r["s"]) for r in df.collect())
    assert all(a[1] <= b[1] for a, b in zip(held, held[1:], strict=False))


def test_a_group_of_ten_million(spark):
    """All rows of one group, all values different: no array of it, and no task orders more than a part."""
    n = 10_000_000
    rows = spark.range(n).select(F.lit("g").alias("period"), (F.pmod(F.col("id") * 7_919, F.lit(n)) + 1).cast("double").alias("x"))
    ranks = nearest_ranks(rows, ["period"], "x", (50, 90))
    assert tuple(ranks.first()) == ("g", n / 2, n * 0.9)
    assert "collect_list" not in ranks._jdf.queryExecution().executedPlan().toString()
