"""From documents to tokens in five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Tables other
than the documents are read from sf_dir. The last gives, for each row that the mix holds (a document that is taken in
several rounds has several), doc_id, n_tokens, ids_sha256 and decoded_sha256.

Null texts count as empty in every stage; null ids and sources are values like others; repeated rows are
rows of their own until the near-duplicates go; texts of any length are read whole; columns beside those of documents, whatever
their names, pass through. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.llm import bpe, linededup, mixing, quality, simhash
from vitalspan.llm.common import stored
from vitalspan.llm.queries import word_bpe


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents; n_chars follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go: score below 0.7. An empty text has the score of an even
    difference; without labels of both kinds every score is the share of label 1."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_scores(docs, model).filter("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go from all of them; a document that loses all its lines stays, empty."""
    return _measured(linededup.line_dedup(docs, threshold=10), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays, null last, then by a hash of the text. Texts
    without a word are one group."""
    return simhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes; those without words go."""
    return _measured(mixing.mixed_documents(docs, stored(mixing.mix(docs), "mix")), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, as many rows as there are documents; an empty text has none."""
    return bpe.bpe_digest(docs, word_bpe())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", tokens),
]

#: Compression, SimHash, seeded choice and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.split()[0].lower())
    return docs
