"""The driver's tables seen as records, workouts, results and documents: the same SELECTs for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What the two engines spell differently.
SPARK = {"k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)", "at": "unix_micros(CAST(ts AS TIMESTAMP)) / 1e6D", "day_at": "unix_micros(CAST(o_orderdate AS TIMESTAMP)) / 1e6D", "text": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "div": "div"}
DUCKDB = {"k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER)", "at": "epoch_us(ts) / 1e6", "day_at": "epoch_us(CAST(o_orderdate AS TIMESTAMP)) / 1e6", "text": "strftime(ts, '%Y-%m-%d %H:%M:%S')", "div": "//"}

VIEWS = {
    "v_record": """
        SELECT event_id AS id, event_type AS type, CASE WHEN event_type <> 'error' THEN value END AS value_num,
               CASE WHEN event_type = 'error' THEN concat('stage_', k % 4) END AS value_text, CASE WHEN k % 50 <> 0 THEN 'u' END AS unit,
               CASE WHEN user_id % 17 <> 0 THEN concat('src', user_id % 3) END AS source_name, CAST(ts AS DATE) AS local_date,
               {text} AS start_date, {at} AS start_epoch, value AS duration_sec, user_id
        FROM (SELECT *, {k} AS k FROM events) e""",
    "v_sleep": """
        SELECT 'HKCategoryTypeIdentifierSleepAnalysis' AS type, concat('HKCategoryValueSleepAnalysis', CASE k % 4 WHEN 0 THEN 'InBed' WHEN 1 THEN 'AsleepCore' WHEN 2 THEN 'AsleepDeep' ELSE 'Awake' END) AS value_text,
               CASE WHEN user_id % 17 <> 0 THEN concat('src', user_id % 3) END AS source_name, CAST(ts AS DATE) AS local_date, {text} AS start_date, {text} AS end_date, CAST(k AS DOUBLE) AS duration_sec
        FROM (SELECT *, {k} AS k FROM events WHERE event_type = 'click') e""",
    "v_workout": """
        SELECT o_orderkey AS id, o_orderpriority AS activity_type, o_totalprice / 1000 AS duration, CASE o_orderstatus WHEN 'P' THEN 's' ELSE 'min' END AS duration_unit,
               CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey % 20 AS DOUBLE) END AS total_distance, CASE WHEN o_custkey % 2 = 0 THEN 'km' ELSE 'mi' END AS total_distance_unit,
               CAST(o_orderkey % 500 AS DOUBLE) AS total_energy, 'kcal' AS total_energy_unit, o_orderstatus AS source_name, CAST(o_orderdate AS DATE) AS local_date, {day_at} AS start_epoch,
               CASE o_custkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS indoor
        FROM orders""",
    "v_stat": """
        SELECT l_orderkey AS workout_id, 'statistic' AS kind, concat('qty:', l_returnflag) AS key, min(l_quantity) AS value_num, CAST(NULL AS VARCHAR(9)) AS value_text, 'u' AS unit
        FROM lineitem GROUP BY l_orderkey, l_returnflag""",
    "v_lab": """
        SELECT event_id AS id, 1 AS document_id, 1 AS page_no, concat('a', k % 10) AS analyte_key, concat('A', k % 10) AS analyte, concat('p', k % 3) AS panel, round(value) AS value_num, CAST(NULL AS VARCHAR(9)) AS value_text, 'u' AS unit,
               20.0 AS ref_low, 80.0 AS ref_high, CASE WHEN k % 3 = 0 THEN '20-80' END AS ref_text, CASE WHEN k % 11 = 0 THEN 'H' WHEN k % 11 = 1 THEN 'N' END AS flag, CAST(ts AS DATE) AS collected_date,
               CASE event_type WHEN 'purchase' THEN 'pdf' ELSE 'fhir' END AS source, CASE event_type WHEN 'purchase' THEN 'line' ELSE 'fhir' END AS extracted_by, k % 5 = 0 AS via_ocr
        FROM (SELECT *, {k} AS k FROM events WHERE event_type IN ('purchase', 'signup')) e""",
    "v_document": """
        SELECT doc_id AS id, concat('/docs/', doc_id) AS path, CASE lang WHEN 'en' THEN 'pdf' WHEN 'de' THEN 'note' WHEN 'fr' THEN 'image' ELSE 'fhir' END AS kind,
               CASE WHEN doc_id % 5 <> 0 THEN CAST(concat('2024-', CASE WHEN doc_id % 12 < 9 THEN '0' ELSE '' END, 1 + doc_id % 12, '-01') AS DATE) END AS doc_date, '2025-01-01' AS ingested_at,
               CASE WHEN doc_id % 2 = 0 THEN 'DocumentReference' ELSE 'DiagnosticReport' END AS fhir_resource_type
        FROM documents""",
    "v_tag": "SELECT doc_id AS document_id, source AS tag FROM documents",
    "v_chunk": "SELECT doc_id AS id, doc_id AS document_id, text, CASE WHEN doc_id % 4 = 0 THEN 'hash' END AS embedded_with FROM documents",
    "v_fact": """
        SELECT c_custkey AS document_id, CASE c_custkey % 5 WHEN 0 THEN 'condition' WHEN 1 THEN 'medication' WHEN 2 THEN 'allergy' WHEN 3 THEN 'immunization' ELSE 'procedure' END AS kind, c_name AS name,
               CAST(NULL AS VARCHAR(9)) AS code, CAST(NULL AS VARCHAR(9)) AS code_system, CASE WHEN c_acctbal < 0 THEN 'inactive' ELSE 'active' END AS status,
               CASE WHEN c_custkey % 4 <> 0 THEN concat('20', 10 + c_custkey % 10, '-06-01') END AS onset_date, c_mktsegment AS detail_text, c_mktsegment AS category, concat('key', c_custkey) AS dedup_key
        FROM customer""",
    "v_vital": """
        SELECT s_suppkey AS document_id, concat('Metric ', s_nationkey % 6) AS metric, concat('metric_', s_nationkey % 6) AS metric_key, s_acctbal AS value_num, CASE WHEN s_suppkey % 9 = 0 THEN NULL WHEN s_nationkey % 6 < 3 THEN 'x' ELSE concat('y', s_suppkey % 2) END AS unit,
               CAST(concat('2024-0', 1 + s_suppkey % 9, '-15') AS DATE) AS local_date, concat('2024-0', 1 + s_suppkey % 9, '-15T08:00') AS measured_at, 'vital-signs' AS category
        FROM supplier""",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over the tables that its SELECT names."""
    sql = VIEWS[name].format(**SPARK).replace("VARCHAR(9)", "STRING")
    for table in ("events", "orders", "lineitem", "documents", "customer", "supplier"):
        if f"FROM {table}" in sql:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(f"driver_{table}")
            sql = sql.replace(f"FROM {table}", f"FROM driver_{table}")
    return spark.sql(sql)


def with_views(sql: str) -> str:
    """Oracle SQL with the views it names as common table expressions."""
    used = [n for n in VIEWS if n in sql]
    ctes = ", ".join(f"{n} AS ({VIEWS[n].format(**DUCKDB).replace('VARCHAR(9)', 'VARCHAR')})" for n in used)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes}, {sql[5:]}"
    return f"WITH {ctes} {sql}"
