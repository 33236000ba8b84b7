"""More registered queries: sources and sinks over texts and resources written from the driver's tables, and their oracle SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalspan.functions import exprs as X
from vitalspan.functions import words
from vitalspan.operators import clinical, documents, labs, series, sleep, writes
from vitalspan.plans.registry import ROLLUP, _rollup, _table, _v, flat, query
from vitalspan.search import corpus as literature
from vitalspan.search import vectors
from vitalspan.sources import fhir, texts

# Printed results and notes.


@query("""SELECT p_partkey AS document_id, 'glucose' AS analyte_key, 'metabolic' AS panel, CAST(p_size AS DOUBLE) AS value_num, CASE WHEN p_partkey % 5 = 0 THEN concat('<', p_size) END AS value_text,
    CASE WHEN p_partkey % 3 <> 0 THEN 'mg/dL' END AS unit, 70.0 AS ref_low, 99.0 AS ref_high, CASE WHEN p_partkey % 2 = 0 THEN 'H' END AS flag FROM part""")
def lab_lines(spark, sf_dir):
    k = F.col("p_partkey")
    value = F.concat(F.when(k % 5 == 0, "<").otherwise(""), F.col("p_size").cast("string"))
    line = F.concat(F.lit("Glucose, fasting   "), value, F.when(k % 2 == 0, "   H").otherwise(""), F.when(k % 3 != 0, "   mg/dL").otherwise(""), F.lit("   70 - 99"))
    pages = _table(spark, sf_dir, "part").select(k.alias("document_id"), F.lit(1).alias("page_no"), F.concat(F.lit("Phone   555 1234\nno result here\n"), line).alias("text"))
    return texts.lab_lines(pages).select("document_id", "analyte_key", "panel", "value_num", "value_text", "unit", "ref_low", "ref_high", "flag")


def _noted(spark, sf_dir):
    k = F.col("s_suppkey")
    head = F.concat(F.lit("---\ntitle: Visit "), k.cast("string"), F.lit("\ndate: 2024-0"), (k % 9 + 1).cast("string"), F.lit("-15\ntags: [Sleep, "), F.concat(F.lit("t"), (k % 4).cast("string")), F.lit("]\n---\n"))
    body = F.concat(F.lit("# Day\nwords of note "), k.cast("string"), F.when(k % 2 == 0, "\n## Later\nmore words").otherwise(""))
    files = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("/notes/"), k.cast("string"), F.lit(".md")).alias("path"), F.concat(head, body).alias("text"))
    return texts.notes(files)


@query("""SELECT concat('/notes/', s_suppkey, '.md') AS path, concat('Visit ', s_suppkey) AS title, concat('2024-0', s_suppkey % 9 + 1, '-15') AS doc_date,
    concat('sleep,t', s_suppkey % 4) AS tags, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS chunks FROM supplier""")
def note_rows(spark, sf_dir):
    return _noted(spark, sf_dir).select("path", "title", "doc_date", F.array_join("tags", ",").alias("tags"), F.size("chunks").alias("chunks"))


@query("""SELECT concat('/notes/', s_suppkey, '.md') AS path, 0 AS chunk_index, 'Day' AS section, concat('words of note ', s_suppkey) AS text FROM supplier
    UNION ALL SELECT concat('/notes/', s_suppkey, '.md'), 1, 'Day > Later', 'more words' FROM supplier WHERE s_suppkey % 2 = 0""")
def note_chunks(spark, sf_dir):
    return texts.chunk_rows(_noted(spark, sf_dir)).select("path", "chunk_index", "section", "text")


# Clinical resources.


def _members(spark, sf_dir):
    """A resource for each customer, of a kind by its id; one in seven can't be read."""
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    observation = F.concat(F.lit('{"resourceType": "Observation", "id": "'), text(k), F.lit('", "category": [{"coding": [{"display": "-"}]}, {"coding": [{"code": "'), F.when(k % 2 == 0, "laboratory").otherwise("vital-signs"), F.lit('"}]}], "code": {"text": "Sodium"}, "valueQuantity": {"value": '), text(k % 50), F.lit(', "unit": "mmol/L"}, "effectiveDateTime": "2024-03-0'), text(k % 9 + 1), F.lit('T08:00:00Z"}'))
    condition = F.concat(F.lit('{"resourceType": "Condition", "id": "'), text(k), F.lit('", "code": {"text": "'), F.col("c_mktsegment"), F.lit('"}, "clinicalStatus": {"text": "'), F.when(F.col("c_acctbal") < 0, "inactive").otherwise("active"), F.lit('"}, "onsetDateTime": "2020-01-0'), text(k % 9 + 1), F.lit('"}'))
    report = F.concat(F.lit('{"resourceType": "DiagnosticReport", "id": "'), text(k), F.lit('", "code": {"text": "Panel"}, "issued": "2023-05-0'), text(k % 9 + 1), F.lit('T00:00:00Z"}'))
    content = F.when(k % 7 == 0, "not a resource").when(k % 3 == 0, condition).when(k % 3 == 1, observation).otherwise(report)
    return _table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), text(k), F.lit(".json")).alias("member"), content.alias("content"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS resource_id, 'sodium' AS analyte_key, CAST(c_custkey % 50 AS DOUBLE) AS value_num, 'mmol/L' AS unit, concat('2024-03-0', c_custkey % 9 + 1) AS collected_date
    FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 3 = 1 AND c_custkey % 2 = 0""")
def fhir_labs(spark, sf_dir):
    return fhir.ingest(_members(spark, sf_dir))["lab"].select("resource_id", "analyte_key", "value_num", "unit", "collected_date")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS resource_id, 'sodium' AS metric_key, 'vital-signs' AS category, CAST(c_custkey % 50 AS DOUBLE) AS value_num, concat('2024-03-0', c_custkey % 9 + 1) AS local_date
    FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 3 = 1 AND c_custkey % 2 = 1""")
def fhir_vitals(spark, sf_dir):
    return fhir.ingest(_members(spark, sf_dir))["vital"].select("resource_id", "metric_key", "category", "value_num", "local_date")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS resource_id, 'condition' AS kind, c_mktsegment AS name, CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status, concat('2020-01-0', c_custkey % 9 + 1) AS onset_date
    FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 3 = 0""")
def fhir_facts(spark, sf_dir):
    return fhir.ingest(_members(spark, sf_dir))["fact"].select("resource_id", "kind", "name", "status", "onset_date")


@query("""SELECT concat('m', c_custkey, '.json') AS path, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'Sodium' ELSE 'Panel' END AS title,
    CASE c_custkey % 3 WHEN 0 THEN concat('2020-01-0', c_custkey % 9 + 1) WHEN 1 THEN concat('2024-03-0', c_custkey % 9 + 1) ELSE concat('2023-05-0', c_custkey % 9 + 1) END AS doc_date FROM customer WHERE c_custkey % 7 <> 0""")
def fhir_documents(spark, sf_dir):
    return fhir.ingest(_members(spark, sf_dir))["document"].select("path", "title", "doc_date")


@query("""SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CASE c_custkey % 3 WHEN 0 THEN 'Condition' WHEN 1 THEN 'Observation' ELSE 'DiagnosticReport' END END AS resource_type,
    CASE WHEN c_custkey % 7 = 0 THEN 'unreadable' END AS error, count(*) AS n FROM customer GROUP BY 1, 2""")
def fhir_counts(spark, sf_dir):
    return fhir.ingest(_members(spark, sf_dir))["counts"].withColumnRenamed("count", "n")


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'fact' WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'lab' ELSE 'vital' END ELSE 'document_reference' END AS kind
    FROM customer WHERE c_custkey % 7 <> 0) WHERE kind NOT IN ('fact', 'vital') GROUP BY kind""")
def fhir_skip_list(spark, sf_dir):
    """What is left when two kinds aren't asked for."""
    out = fhir.ingest(_members(spark, sf_dir), "condition, Vital")
    kinds = [out[t].select(F.lit(t).alias("kind")) for t in ("fact", "lab", "vital", "document_reference")]
    return functools.reduce(DataFrame.unionByName, kinds).groupBy("kind").agg(F.count("*").alias("n"))


# Sinks.


@query("SELECT count(DISTINCT (type, source_name, unit, value_num)) AS keys, count(*) AS n FROM v_record")
def content_identity(spark, sf_dir):
    """Null and empty parts are the same; the view has no empty ones."""
    return _v(spark, sf_dir, "record").agg(F.count_distinct(X.identity("type", "source_name", "unit", "value_num")).alias("keys"), F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 3 <> 0")
def insert_ignore(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return writes.insert_ignore(rows.filter("k % 3 = 0"), rows, ["k"], "o_orderkey").select("k")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def orphans_of_pending(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").withColumnRenamed("o_custkey", "c_custkey")
    return writes.orphans(_table(spark, sf_dir, "customer"), orders, "c_custkey").select("c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return writes.cascade(_table(spark, sf_dir, "lineitem"), orders, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("SELECT CAST(p_partkey AS VARCHAR) AS pmid, p_partkey % 4 = 0 OR p_partkey % 5 = 0 AS retracted FROM part")
def mark_retracted(spark, sf_dir):
    k = F.col("p_partkey")
    article = _table(spark, sf_dir, "part").select(k.cast("string").alias("pmid"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("retracted"))
    named = _table(spark, sf_dir, "part").filter(k % 5 == 0).select(k.cast("string").alias("pmid"))
    return writes.mark_retracted(article, named.union(named))[0].select("pmid", "retracted")


@query(f"""WITH {ROLLUP} SELECT strftime(local_date, '%Y-%m-%d') AS local_date, type, source_name, unit, category, n, round(sum_value, 4) AS sum_value FROM r""")
def rollup_refresh(spark, sf_dir):
    """What a rollup without one source's records becomes when these arrive: the rollup of all."""
    record = _v(spark, sf_dir, "record")
    late = record.filter("source_name = 'src1'")
    before = series.daily_rollup(record.filter("source_name IS NULL OR source_name <> 'src1'"))
    return flat(series.refresh_rollup(before, record, late).select("local_date", "type", "source_name", "unit", "category", "n", "sum_value"))


@query("SELECT id FROM v_chunk WHERE embedded_with IS DISTINCT FROM 'hash'")
def embed_pending(spark, sf_dir):
    return vectors.pending(_v(spark, sf_dir, "chunk"), "hash").select("id")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'new' ELSE embedded_with END AS embedded_with FROM v_chunk")
def mark_embedded(spark, sf_dir):
    chunk = _v(spark, sf_dir, "chunk")
    done = chunk.filter("id % 3 = 0").select(F.col("id").alias("chunk_id"), F.lit("new").alias("embedder"))
    return vectors.mark_embedded(chunk, done.union(done), "new").select("id", "embedded_with")


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def reclaim_vectors(spark, sf_dir):
    chunk = _table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    return vectors.reclaim(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id")), chunk)


# Columns.


KEYS = "CASE WHEN p_partkey % 4 = 0 THEN concat('k', p_partkey) ELSE concat('k', p_partkey, ':a', CASE WHEN p_partkey % 4 = 1 THEN ':b' ELSE '' END) END"


@query(f"""SELECT p_partkey, p_partkey % 4 <> 0 AS is_stat, concat('k', p_partkey) AS base, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a:b' ELSE 'a' END AS aggregate FROM part WHERE {KEYS} IS NOT NULL""")
def stat_keys(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").withColumn("key", F.expr(KEYS))
    return rows.select("p_partkey", X.is_stat_key("key").alias("is_stat"), X.stat_base("key").alias("base"), X.stat_aggregate("key").alias("aggregate"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 1) THEN TRUE WHEN p_partkey % 5 = 2 THEN FALSE END AS indoor FROM part")
def indoor_flags(spark, sf_dir):
    said = F.element_at(F.array(*[F.lit(x) for x in (" 1", "TRUE", "no ", "maybe", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", X.indoor_flag(said).alias("indoor"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN -CAST(p_size AS DOUBLE) WHEN 2 THEN p_size * 100.0 END AS x FROM part")
def parsed_numbers(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 5 == 0, F.concat(F.lit(" "), n, F.lit(".5 "))).when(k % 5 == 1, F.concat(F.lit("-"), n)).when(k % 5 == 2, F.concat(n, F.lit("e2"))).when(k % 5 == 3, F.concat(n, F.lit("d"))).otherwise(F.concat(F.lit("1_"), n))
    return _table(spark, sf_dir, "part").select("p_partkey", X.number(text).alias("x"))


@query("SELECT id, strftime(CASE WHEN hour(CAST(start_date AS TIMESTAMP)) >= 12 THEN local_date ELSE local_date - 1 END, '%Y-%m-%d') AS night FROM v_record")
def night_of(spark, sf_dir):
    return flat(_v(spark, sf_dir, "record").select("id", X.night_of("start_date", "local_date").cast("date").alias("night")))


@query("""SELECT o_orderkey, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') AS week_from, strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d') AS week_to,
    strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_from, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_to FROM orders""")
def period_bounds(spark, sf_dir):
    week, month = (X.period_bounds(F.col("o_orderdate").cast("date"), p) for p in ("week", "month"))
    return flat(_table(spark, sf_dir, "orders").select("o_orderkey", week[0].alias("week_from"), week[1].alias("week_to"), month[0].alias("month_from"), month[1].alias("month_to")))


@query("SELECT id, strftime(local_date, '%Y-%m-%d') AS local_date FROM v_record WHERE local_date >= DATE '2024-01-10' AND local_date <= DATE '2024-02-20'")
def date_range(spark, sf_dir):
    return flat(_v(spark, sf_dir, "record").filter(X.between("local_date", "2024-01-10", "2024-02-20")).select("id", "local_date"))


@query("SELECT count(*) AS n, strftime(min(local_date), '%Y-%m-%d') AS first, strftime(max(local_date), '%Y-%m-%d') AS last FROM v_sleep")
def sleep_coverage(spark, sf_dir):
    return flat(sleep.sleep_coverage(_v(spark, sf_dir, "sleep")))


@query("SELECT count(*) AS n, strftime(min(collected_date), '%Y-%m-%d') AS first, strftime(max(collected_date), '%Y-%m-%d') AS last FROM v_lab WHERE analyte_key = 'a3'")
def lab_coverage(spark, sf_dir):
    return flat(labs.lab_coverage(_v(spark, sf_dir, "lab"), "a3"))


@query("""SELECT (SELECT count(*) FROM v_lab WHERE extracted_by = 'fhir') AS labs, (SELECT strftime(max(collected_date), '%Y-%m-%d') FROM v_lab WHERE extracted_by = 'fhir') AS labs_last,
    (SELECT count(*) FROM v_document WHERE kind = 'fhir') AS note_references, (SELECT strftime(min(doc_date), '%Y-%m-%d') FROM v_document WHERE kind = 'fhir') AS note_references_first""")
def content_counts(spark, sf_dir):
    lab, document = _v(spark, sf_dir, "lab", "document")
    return flat(clinical.content_counts(lab, document).select("labs", "labs_last", "note_references", "note_references_first"))


@query("SELECT DISTINCT tag FROM v_tag WHERE lower(tag) IN ('web', 'books', 'src0', 'src1')")
def tag_hints(spark, sf_dir):
    return documents.tags_matching(_v(spark, sf_dir, "tag"), "Anything on #web, books; SRC0 or (src1)?")


# The corpus.


def _articles(spark, sf_dir):
    k = F.col("p_partkey")
    tier = F.element_at(F.array(*[F.lit(t) for t in ("rct", "guideline", "protocol", "unknown", "narrative_review")]), (k % 5 + 1).cast("int"))
    rank = F.element_at(F.array(*[F.lit(r).cast("int") for r in (3, 2, None, None, 5)]), (k % 5 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select(k.cast("string").alias("pmid"), F.col("p_name").alias("title"), F.col("p_brand").alias("journal"), tier.alias("tier"), rank.alias("tier_rank"), F.when(k % 6 != 0, (2000 + k % 25).cast("int")).alias("year"), F.when(k % 8 == 0, True).when(k % 8 == 1, False).alias("retracted"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS pmid FROM part WHERE p_partkey % 5 IN (0, 1) AND (p_partkey % 6 = 0 OR 2000 + p_partkey % 25 >= 2010)")
def tier_floor(spark, sf_dir):
    return _articles(spark, sf_dir).filter(literature.strong_enough("rct", 2010)).select("pmid")


@query("SELECT CAST(p_partkey AS VARCHAR) AS pmid FROM part WHERE p_partkey % 8 <> 0 AND p_partkey % 5 NOT IN (2, 3)")
def citable_articles(spark, sf_dir):
    return _articles(spark, sf_dir).filter(literature.citable()).select("pmid")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS pmid, concat_ws(', ', p_name, p_brand, CASE WHEN p_partkey % 6 <> 0 THEN CAST(2000 + p_partkey % 25 AS VARCHAR) END, concat('PMID ', p_partkey)) AS citation FROM part""")
def article_citations(spark, sf_dir):
    return _articles(spark, sf_dir).withColumn("title", F.concat("title", F.lit(" . "))).select("pmid", words.article_citation().alias("citation"))


@query("""SELECT id, CASE kind WHEN 'pdf' THEN concat(id, ', p. 3') WHEN 'note' THEN concat_ws(', ', CAST(id AS VARCHAR), strftime(doc_date, '%Y-%m-%d'), 'Top') WHEN 'image' THEN concat_ws(', ', CAST(id AS VARCHAR), strftime(doc_date, '%Y-%m-%d'), 'Top') ELSE CAST(id AS VARCHAR) END AS citation FROM v_document""")
def passage_citations(spark, sf_dir):
    rows = _v(spark, sf_dir, "document").withColumn("page_no", F.lit(3)).withColumn("section", F.lit("Top"))
    return rows.select("id", words.passage_citation().alias("citation"))


@query("SELECT type, count(*) AS days FROM (SELECT DISTINCT type, local_date FROM v_record) x GROUP BY type")
def days_with_records(spark, sf_dir):
    return _rollup(spark, sf_dir).select("type", "local_date").distinct().groupBy("type").agg(F.count("*").alias("days"))
