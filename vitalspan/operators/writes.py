"""What keeps tables right when data comes again: first writer wins, upserts, replacement, orphans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, key: Sequence[str], order: str | Column) -> DataFrame:
    """One row for each key: the first in order of arrival. Null is a key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(order))).filter("_r = 1").drop("_r")


def insert_ignore(existing: DataFrame, new: DataFrame, key: Sequence[str], order: str | Column) -> DataFrame:
    """The rows of `new` to append: of keys not held yet, the first of each."""
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"e.{k}")) for k in key]
    return first_wins(new, key, order).alias("n").join(existing.select(*key).alias("e"), same, "left_anti")


def last_wins(rows: DataFrame, key: Sequence[str], order: str | Column) -> DataFrame:
    by = F.col(order) if isinstance(order, str) else order
    return first_wins(rows, key, by.desc())


def upsert_changed(existing: DataFrame, new: DataFrame, key: str, watched: str, carried: Sequence[str]) -> DataFrame:
    """The table after `new` arrives: a known key takes `watched` and `carried` over only if `watched` differs (null-safe);
    an unknown key is added; nothing else changes."""
    both = existing.alias("e").join(new.alias("n"), F.col(f"e.{key}") == F.col(f"n.{key}"), "full_outer")
    absent = F.col(f"e.{key}").isNull()
    changed = F.col(f"n.{key}").isNotNull() & ~F.col(f"e.{watched}").eqNullSafe(F.col(f"n.{watched}"))
    taken = {watched, *carried}
    pick = lambda c: F.when(absent | (changed if c in taken else F.lit(False)), F.col(f"n.{c}")).otherwise(F.col(f"e.{c}"))
    return both.select(*[pick(c).alias(c) for c in existing.columns])


def upserts(existing: DataFrame, new: DataFrame, key: str, watched: str, carried: Sequence[str]) -> DataFrame:
    """The rows alone that `upsert_changed` adds or alters: to be written instead of those with their keys."""
    both = new.alias("n").join(existing.alias("e"), F.col(f"e.{key}") == F.col(f"n.{key}"), "left")
    absent = F.col(f"e.{key}").isNull()
    taken = {watched, *carried}
    pick = lambda c: F.col(f"n.{c}") if c in taken else F.when(absent, F.col(f"n.{c}")).otherwise(F.col(f"e.{c}"))
    return both.filter(absent | ~F.col(f"e.{watched}").eqNullSafe(F.col(f"n.{watched}"))).select(*[pick(c).alias(c) for c in existing.columns])


def replace_by(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Everything of the keys that come again is replaced wholesale."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str = "id") -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(F.col(parent_key).alias(child_key)), child_key, "left_semi")


def orphans(rows: DataFrame, referring: DataFrame, key: str) -> DataFrame:
    """Rows that nothing refers to."""
    return rows.join(referring.select(key).distinct(), key, "left_anti")


def unprocessed(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files to read: all but those held complete with the same hash."""
    done = ledger.filter(F.col("status") == "complete").select("path", "sha256")
    return files.join(done, ["path", "sha256"], "left_anti")


def mark_retracted(article: DataFrame, pmids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, those newly marked): known and not marked before."""
    named = pmids.select("pmid").distinct().withColumn("_named", F.lit(True))
    joined = article.join(named, "pmid", "left")
    newly = F.coalesce("_named", F.lit(False)) & ~F.coalesce("retracted", F.lit(False))
    out = joined.withColumn("retracted", F.coalesce("retracted", F.lit(False)) | F.coalesce("_named", F.lit(False)))
    return out.drop("_named"), joined.filter(newly).select("pmid")
