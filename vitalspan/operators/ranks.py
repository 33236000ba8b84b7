"""Percentiles of groups of any size, exact, without gathering a group anywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.functions.exprs import finite

#: Stretches of values to a unit of the logarithm.
FINENESS = 256


def stretch(value: Column | str) -> Column:
    """The number of the stretch that a value lies in: it never falls as the value grows, and about as many values share one
    wherever they lie."""
    v = F.col(value) if isinstance(value, str) else value
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * FINENESS)


def nearest_ranks(rows: DataFrame, by: Sequence[str], value: Column | str, percents: Sequence[int]) -> DataFrame:
    """by and a column p<percent> for each: the value of rank ceil(percent * n / 100), in whole numbers and within 1 and n, of
    the n finite values of each group (null is a group; one without values has none and is left out).

    Equal values are counted before they are shuffled. Counts of stretches tell in which of them a rank falls, and only the
    values of that stretch are put in order: what one task orders is the stretches of a group, or the different values of
    one stretch."""
    own = [f"_by{i}" for i in range(len(by))]
    counted = rows.select(*[F.col(c).alias(n) for c, n in zip(by, own, strict=True)], finite(value).alias("_v")).filter("_v IS NOT NULL").withColumn("_s", stretch("_v"))
    counted = counted.groupBy(*own, "_s", "_v").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*own)
    coarse = counted.groupBy(*own, "_s").agg(F.sum("_n").alias("_n"))
    coarse = coarse.withColumn("_upto", F.sum("_n").over(group.orderBy("_s"))).withColumn("_all", F.sum("_n").over(group))
    asked = coarse.withColumn("_p", F.explode(F.array(*[F.lit(p) for p in percents])))
    asked = asked.withColumn("_rank", F.greatest(F.lit(1), F.least(F.col("_all"), F.floor((F.col("_p") * F.col("_all") + 99) / 100))))
    asked = asked.filter((F.col("_rank") <= F.col("_upto")) & (F.col("_rank") > F.col("_upto") - F.col("_n")))
    asked = asked.select(*own, "_s", "_p", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"a.{c}")) for c in [*own, "_s"]]
    fine = counted.alias("c").join(asked.select(*own, "_s").distinct().alias("a"), same, "left_semi")
    fine = fine.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*own, "_s").orderBy("_v")))
    same = [F.col(f"f.{c}").eqNullSafe(F.col(f"a.{c}")) for c in [*own, "_s"]]
    met = fine.alias("f").join(asked.alias("a"), same).filter("a._rank <= f._upto AND a._rank > f._upto - f._n")
    out = met.groupBy(*[F.col(f"f.{c}").alias(c) for c in own]).agg(*[F.max(F.when(F.col("a._p") == p, F.col("f._v"))).alias(f"p{p}") for p in percents])
    return out.select(*[F.col(n).alias(c) for c, n in zip(by, own, strict=True)], *[f"p{p}" for p in percents])
