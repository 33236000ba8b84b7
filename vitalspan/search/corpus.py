"""Research articles: packs, coverage, and search that puts evidence before relevance."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalspan.constants import TIERS
from vitalspan.search.keyword import bm25, porter
from vitalspan.search.vectors import vector_search

UNRANKED, KEYWORD_OVER, SEMANTIC_OVER = 99, 4, 6


def strong_enough(min_tier: str | None = None, since_year: int | None = None) -> Column:
    """Unranked articles are never strong enough; articles without a year are never too old."""
    keep = F.lit(True)
    if min_tier:
        if min_tier not in TIERS:
            raise ValueError(f"unknown tier: {min_tier}; one of {', '.join(TIERS)}")
        keep = keep & F.col("tier_rank").isNotNull() & (F.col("tier_rank") <= TIERS[min_tier])
    if since_year:
        keep = keep & (F.col("year").isNull() | (F.col("year") >= since_year))
    return keep


def evidence_order(found: DataFrame, limit: int | None = None) -> DataFrame:
    """Strongest evidence first, then the order of retrieval (`position`)."""
    out = found.orderBy(F.coalesce("tier_rank", F.lit(UNRANKED)), "position")
    return out.limit(limit) if limit else out


def _placed(hits: DataFrame, chunk: DataFrame, article: DataFrame, by: Sequence[Column]) -> DataFrame:
    placed = hits.withColumn("position", F.row_number().over(Window.orderBy(*by)))  # a few hits, already limited
    return placed.join(chunk.select("id", "pmid", "text"), "id").join(article, "pmid")


def keyword_search(index: tuple[DataFrame, DataFrame], chunk: DataFrame, article: DataFrame, query: str, limit: int = 5, min_tier: str | None = None, since_year: int | None = None, stem=porter) -> DataFrame:
    """By BM25 over chunks of articles that pass, over-fetched, then by evidence. An article may appear with several chunks."""
    among = chunk.join(article.filter(strong_enough(min_tier, since_year)).select("pmid"), "pmid", "left_semi").select("id")
    hits = bm25(*index, query, limit * KEYWORD_OVER, stem, among)
    return evidence_order(_placed(hits, chunk, article, [F.desc("score"), F.col("id")]), limit)


def semantic_search(vectors: DataFrame, chunk: DataFrame, article: DataFrame, query: Sequence[float], limit: int = 5, min_tier: str | None = None, since_year: int | None = None, embedder: str | None = None) -> DataFrame:
    """By distance, over-fetched, then filtered, the best chunk of each article, then by evidence."""
    hits = vector_search(vectors, query, limit * SEMANTIC_OVER, embedder).withColumnRenamed("chunk_id", "id")
    placed = _placed(hits, chunk, article, [F.col("distance"), F.col("id")]).filter(strong_enough(min_tier, since_year))
    best = placed.withColumn("_r", F.row_number().over(Window.partitionBy("pmid").orderBy("position"))).filter("_r = 1").drop("_r")
    return evidence_order(best, limit)


def search(index, vectors: DataFrame | None, chunk: DataFrame, article: DataFrame, query: str, embed: Callable[[list[str]], list | None] | None = None, limit: int = 5, **filters) -> DataFrame:
    """Semantic where vectors and an embedder are there and find something, else by keyword."""
    strong_enough(filters.get("min_tier"))  # an unknown tier is an error even where nothing is found
    if vectors is not None and embed is not None:
        made = embed([query])
        if made:
            found = semantic_search(vectors, chunk, article, made[0], limit, **filters)
            if not found.isEmpty():
                return found
    return keyword_search(index, chunk, article, query, limit, **filters)


def citable() -> Column:
    """Neither retracted nor a protocol nor of unknown design."""
    return ~F.coalesce("retracted", F.lit(False)) & ~F.col("tier").isin("protocol", "unknown")


def latest_refresh(log: DataFrame) -> DataFrame:
    return log.withColumn("_r", F.row_number().over(Window.partitionBy("pack").orderBy(F.desc("ran_at"), F.desc("id")))).filter("_r = 1").drop("_r")


def pack_counts(membership: DataFrame) -> DataFrame:
    return membership.groupBy("pack").agg(F.countDistinct("pmid").alias("articles"))


def topics(mesh: DataFrame, limit: int = 20) -> DataFrame:
    """Terms by the articles they are a major topic of; if there are none, by all articles."""
    counted = mesh.groupBy("term").agg(F.countDistinct(F.when(F.col("major"), F.col("pmid"))).alias("major"), F.countDistinct("pmid").alias("articles"))
    any_major = counted.agg((F.max("major") > 0).alias("any_major"))
    kept = counted.join(F.broadcast(any_major)).filter(~F.col("any_major") | (F.col("major") > 0))  # one row
    return kept.orderBy(F.desc(F.when(F.col("any_major"), F.col("major")).otherwise(F.col("articles"))), "term").drop("any_major").limit(limit)


def tier_histogram(article: DataFrame) -> DataFrame:
    return article.groupBy("tier").agg(F.count("*").alias("n"), F.count_if("retracted").alias("retracted"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def in_several_packs(membership: DataFrame) -> DataFrame:
    return membership.groupBy("pmid").agg(F.countDistinct("pack").alias("packs")).filter("packs > 1")
