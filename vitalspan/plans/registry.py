"""Queries over the driver's tables and their oracle SQL, by name.

Outputs are flat: floats rounded to four places (sums differ in order; a nudge keeps ties from going either way), dates as
text, arrays joined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.functions import exprs as X
from vitalspan.operators import clinical, documents, labs, series, sleep, windows, workouts, writes
from vitalspan.plans.adapters import spark_view, with_views
from vitalspan.search import corpus as literature
from vitalspan.search import keyword, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            nudged = oracle.replace(", 4)", " + 1e-9, 4)")
            ORACLE_SQL[f.__name__] = with_views(nudged) if "v_" in oracle else nudged
        return f

    return register


def flat(df: DataFrame) -> DataFrame:
    """Dates as text, floats to four places."""
    shown = {"date": lambda c: F.date_format(c, "yyyy-MM-dd"), "double": lambda c: F.round(c + 1e-9, 4)}
    return df.select(*[shown[t](F.col(f"`{c}`")).alias(c) if t in shown else F.col(f"`{c}`") for c, t in df.dtypes])


def _v(spark, sf_dir, *names):
    found = [spark_view(spark, sf_dir, f"v_{n}") for n in names]
    return found[0] if len(found) == 1 else found


def _rollup(spark, sf_dir):
    return series.daily_rollup(_v(spark, sf_dir, "record"))


ROLLUP = """r AS (SELECT local_date, type, source_name, unit, value_text AS category, count(*) AS n, sum(value_num) AS sum_value,
    avg(value_num) AS avg_value, min(value_num) AS min_value, max(value_num) AS max_value, sum(duration_sec) AS duration_sec FROM v_record GROUP BY ALL)"""


# The rollup and what is read from it.


@query(f"""WITH {ROLLUP} SELECT strftime(local_date, '%Y-%m-%d') AS local_date, type, source_name, unit, category, n, round(sum_value, 4) AS sum_value,
    round(avg_value, 4) AS avg_value, round(min_value, 4) AS min_value, round(max_value, 4) AS max_value, round(duration_sec, 4) AS duration_sec FROM r""")
def daily_rollup(spark, sf_dir):
    return flat(_rollup(spark, sf_dir))


def _view_sql(label: str) -> str:
    return f"""WITH {ROLLUP} SELECT {label} AS period, type, source_name, unit, category, CAST(sum(n) AS BIGINT) AS n, round(sum(sum_value), 4) AS sum_value,
    round(sum(avg_value * n) / sum(n), 4) AS avg_value, round(min(min_value), 4) AS min_value, round(max(max_value), 4) AS max_value, round(sum(duration_sec), 4) AS duration_sec,
    strftime(min(local_date), '%Y-%m-%d') AS period_start, strftime(max(local_date), '%Y-%m-%d') AS period_end FROM r GROUP BY 1, 2, 3, 4, 5"""


WEEK = "strftime(date_trunc('week', local_date), '%Y-%m-%d')"
MONTH = "strftime(local_date, '%Y-%m')"


@query(_view_sql(WEEK))
def weekly_view(spark, sf_dir):
    return flat(series.period_view(_rollup(spark, sf_dir), "week"))


@query(_view_sql(MONTH))
def monthly_view(spark, sf_dir):
    return flat(series.period_view(_rollup(spark, sf_dir), "month"))


def _series(spark, sf_dir, metric, period, agg, **options):
    out = series.metric_series(_rollup(spark, sf_dir), metric, period, agg, **options)
    return flat(out.select("period", "category", "value", "n", "n_sources", "multi_source", F.array_join("units", ",").alias("units")))


def _series_sql(metric: str, label: str, source_value: str, value: str, category: str = "CAST(NULL AS VARCHAR)", where: str = "TRUE") -> str:
    return f"""WITH {ROLLUP},
    p AS (SELECT {label} AS period, {category} AS category, coalesce(source_name, '(unknown)') AS src, CAST(sum(n) AS BIGINT) AS n, sum(sum_value) AS s, coalesce(sum(duration_sec), 0) AS d,
             min(min_value) AS lo, max(max_value) AS hi, list(DISTINCT coalesce(unit, 'unlabelled')) AS us FROM r WHERE type = '{metric}' AND {where} GROUP BY 1, 2, 3),
    q AS (SELECT *, {source_value} AS v FROM p)
    SELECT period, category, round({value}, 4) AS value, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_sources, count(*) > 1 AS multi_source,
           array_to_string(list_sort(list_distinct(flatten(list(us)))), ',') AS units FROM q GROUP BY period, category"""


@query(_series_sql("view", WEEK, "s", "max(v)"))
def series_sum_max(spark, sf_dir):
    return _series(spark, sf_dir, "view", "week", "sum")


@query(_series_sql("click", MONTH, "s", "sum(v)"))
def series_sum_sum(spark, sf_dir):
    return _series(spark, sf_dir, "click", "month", "sum", combine="sum")


@query(_series_sql("purchase", WEEK, "s", "sum(s) / sum(CASE WHEN s IS NOT NULL THEN n END)"))
def series_avg_weighted(spark, sf_dir):
    return _series(spark, sf_dir, "purchase", "week", "avg")


@query(_series_sql("click", "strftime(local_date, '%Y-%m-%d')", "lo", "min(v)"))
def series_min(spark, sf_dir):
    return _series(spark, sf_dir, "click", "day", "min")


@query(_series_sql("click", WEEK, "hi", "max(v)"))
def series_max(spark, sf_dir):
    return _series(spark, sf_dir, "click", "week", "max")


@query(_series_sql("signup", "strftime(local_date, '%Y-%m-%d')", "n", "max(v)"))
def series_count(spark, sf_dir):
    return _series(spark, sf_dir, "signup", "day", "count")


@query(_series_sql("HKCategoryTypeIdentifierSleepAnalysis", WEEK, "d", "max(v)", "category").replace("v_record", "(SELECT type, value_text, source_name, local_date, duration_sec, CAST(NULL AS VARCHAR) AS unit, CAST(NULL AS DOUBLE) AS value_num FROM v_sleep)"))
def series_duration_category(spark, sf_dir):
    record = _v(spark, sf_dir, "sleep").withColumns({"unit": F.lit(None).cast("string"), "value_num": F.lit(None).cast("double")})
    out = series.metric_series(series.daily_rollup(record), "sleep", "week")
    return flat(out.select("period", "category", "value", "n", "n_sources", "multi_source", F.array_join("units", ",").alias("units")))


@query(_series_sql("view", WEEK, "s", "max(v)", where="local_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND (source_name IS NULL OR source_name <> 'src1')"))
def series_source_exclude(spark, sf_dir):
    return _series(spark, sf_dir, "view", "week", "sum", start="2024-01-05", end="2024-01-20", exclude=["src1"])


@query(f"""WITH {ROLLUP}, p AS (SELECT {WEEK} AS period, coalesce(source_name, '(unknown)') AS src, CAST(sum(n) AS BIGINT) AS n, sum(sum_value) AS v FROM r WHERE type = 'view' GROUP BY 1, 2)
    SELECT period, src AS source, n AS source_n, round(v, 4) AS value FROM p QUALIFY row_number() OVER (PARTITION BY period ORDER BY v DESC, src) = 1""")
def series_attribution(spark, sf_dir):
    return flat(series.metric_series(_rollup(spark, sf_dir), "view", "week", "sum").select("period", "source", "source_n", "value"))


@query(f"""WITH {ROLLUP}, p AS (SELECT {WEEK} AS period, coalesce(source_name, '(unknown)') AS src, sum(n) AS n, sum(sum_value) AS s FROM r WHERE type = 'purchase' GROUP BY 1, 2),
    t AS (SELECT period, sum(s) / sum(n) AS v, sum(n) AS n FROM p GROUP BY period)
    SELECT round(sum(v * n) / sum(n), 4) AS value, count(v) AS periods, CAST(sum(n) AS BIGINT) AS n FROM t""")
def overall_weighted(spark, sf_dir):
    return flat(series.overall(series.metric_series(_rollup(spark, sf_dir), "purchase", "week", "avg"), "avg"))


@query(f"""WITH {ROLLUP} SELECT type, CAST(sum(n) AS BIGINT) AS n, strftime(min(local_date), '%Y-%m-%d') AS first, strftime(max(local_date), '%Y-%m-%d') AS last, count(DISTINCT source_name) AS sources FROM r WHERE type ILIKE '%i%' GROUP BY type""")
def type_list(spark, sf_dir):
    return flat(series.list_types(_rollup(spark, sf_dir), "i"))


@query(f"""WITH {ROLLUP} SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n, strftime(min(local_date), '%Y-%m-%d') AS first, strftime(max(local_date), '%Y-%m-%d') AS last FROM r WHERE type = 'click'""")
def coverage(spark, sf_dir):
    return flat(series.coverage(_rollup(spark, sf_dir), "click"))


@query(f"""WITH {ROLLUP}, s AS (SELECT source_name, sum(n) AS n FROM r WHERE source_name IS NOT NULL GROUP BY 1)
    SELECT CAST((SELECT sum(n) FROM r) AS BIGINT) AS records, (SELECT strftime(min(local_date), '%Y-%m-%d') FROM r) AS first_date, (SELECT strftime(max(local_date), '%Y-%m-%d') FROM r) AS last_date,
    (SELECT count(DISTINCT type) FROM r) AS distinct_types, (SELECT string_agg(source_name, ',' ORDER BY n DESC, source_name) FROM s) AS sources, (SELECT count(*) FROM v_workout) AS workouts,
    (SELECT strftime(min(local_date), '%Y-%m-%d') FROM v_workout) AS workouts_first, (SELECT strftime(max(local_date), '%Y-%m-%d') FROM v_workout) AS workouts_last""")
def index_summary(spark, sf_dir):
    return flat(series.index_summary(_rollup(spark, sf_dir), _v(spark, sf_dir, "workout")).withColumn("sources", F.array_join("sources", ",")))


@query(f"""WITH {ROLLUP} SELECT type, strftime(local_date, '%Y-%m-%d') AS local_date, CAST(sum(n) AS BIGINT) AS n, round(sum(sum_value), 4) AS sum_value FROM r GROUP BY 1, 2""")
def rollup_refresh(spark, sf_dir):
    record = _v(spark, sf_dir, "record")
    late = F.col("id") % 10 == 0
    out = series.refresh_rollup(series.daily_rollup(record.filter(~late)), record, record.filter(late))
    return flat(out.groupBy("type", "local_date").agg(F.sum("n").alias("n"), F.sum("sum_value").alias("sum_value")))


# Nights.


@query("""WITH s AS (SELECT CASE WHEN CAST(substr(start_date, 12, 2) AS INT) >= 12 THEN local_date ELSE local_date - 1 END AS night, coalesce(source_name, 'unnamed source') AS source,
             sum(CASE WHEN value_text LIKE '%Asleep%' THEN duration_sec ELSE 0 END) AS asleep_seconds, sum(CASE WHEN value_text LIKE '%InBed' THEN duration_sec ELSE 0 END) AS in_bed_seconds,
             sum(CASE WHEN value_text LIKE '%Deep' THEN duration_sec END) AS deep, min(start_date) AS first_start, max(end_date) AS last_end FROM v_sleep GROUP BY 1, 2),
    c AS (SELECT *, row_number() OVER (PARTITION BY night ORDER BY asleep_seconds DESC, in_bed_seconds DESC, source DESC) AS k, count(*) OVER (PARTITION BY night) > 1 AS multi_source,
             string_agg(CASE WHEN source <> 'unnamed source' THEN source END, ',') OVER (PARTITION BY night ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS sources FROM s)
    SELECT strftime(night, '%Y-%m-%d') AS night, source, asleep_seconds, in_bed_seconds, deep, first_start, last_end, coalesce(sources, '') AS sources, multi_source FROM c WHERE k = 1""")
def sleep_nights(spark, sf_dir):
    out = sleep.sleep_nights(_v(spark, sf_dir, "sleep"))
    return flat(out.select("night", "source", "asleep_seconds", "in_bed_seconds", F.try_element_at("stages", F.lit("AsleepDeep")).alias("deep"), "first_start", "last_end", F.array_join("sources", ",").alias("sources"), "multi_source"))


# Workouts.


@query("""SELECT activity_type, duration_unit, total_distance_unit, total_energy_unit, count(*) AS n, round(sum(duration), 4) AS total_duration, round(sum(total_distance), 4) AS total_distance,
    round(sum(total_energy), 4) AS total_energy, strftime(min(local_date), '%Y-%m-%d') AS first, strftime(max(local_date), '%Y-%m-%d') AS last FROM v_workout GROUP BY 1, 2, 3, 4""")
def workout_summary(spark, sf_dir):
    return flat(workouts.workout_summary(_v(spark, sf_dir, "workout"), None))


@query("""SELECT w.id, strftime(local_date, '%Y-%m-%d') AS local_date, max(CASE WHEN key = 'qty:A' THEN value_num END) AS a, max(CASE WHEN key = 'qty:R' THEN value_num END) AS r,
    concat(activity_type, ' on ', strftime(local_date, '%Y-%m-%d')) AS citation FROM v_workout w LEFT JOIN v_stat s ON s.workout_id = w.id WHERE indoor AND activity_type ILIKE '%urg%' GROUP BY 1, 2, 5""")
def workout_detail(spark, sf_dir):
    w, s = _v(spark, sf_dir, "workout", "stat")
    out = workouts.workout_detail(w, s, ["qty:A", "qty:R"], limit=None, indoor=True, activity="URG")
    return flat(out.select("id", "local_date", F.col("measures")["qty:A"]["value"].alias("a"), F.col("measures")["qty:R"]["value"].alias("r"), "citation"))


@query("""WITH d AS (SELECT *, CASE WHEN total_distance IS NULL THEN 'a value this needs is missing' WHEN total_distance = 0 THEN 'distance is zero' END AS pr, CASE WHEN total_distance IS NULL THEN 'a value this needs is missing' END AS sr FROM v_workout)
    SELECT id, round(CASE WHEN pr IS NULL THEN duration / nullif(total_distance, 0) END, 4) AS pace, CASE WHEN pr IS NULL THEN concat(duration_unit, '/', total_distance_unit) END AS pace_unit, pr AS pace_reason,
           round(total_distance / (duration * CASE duration_unit WHEN 's' THEN 1 ELSE 60 END / 3600), 4) AS speed, CASE WHEN sr IS NULL THEN concat(total_distance_unit, '/hr') END AS speed_unit FROM d""")
def derive_pace_speed(spark, sf_dir):
    out = workouts.workout_detail(_v(spark, sf_dir, "workout"), derive=["pace", "speed"], limit=None)
    return flat(out.select("id", F.col("pace.value").alias("pace"), F.col("pace.unit").alias("pace_unit"), F.col("pace.reason").alias("pace_reason"), F.col("speed.value").alias("speed"), F.col("speed.unit").alias("speed_unit")))


@query("""WITH d AS (SELECT id, total_energy, duration, total_distance, total_distance / (duration * CASE duration_unit WHEN 's' THEN 1 ELSE 60 END / 3600) AS speed FROM v_workout)
    SELECT id, round(speed / (nullif(total_energy, 0) / 100), 4) AS efficiency,
           CASE WHEN total_energy = 0 THEN 'heart rate is zero' WHEN total_distance IS NULL THEN 'a value this needs is missing' END AS efficiency_reason,
           round(CASE WHEN total_energy <> 0 THEN duration / total_energy END, 4) AS ratio, CASE WHEN total_energy = 0 THEN 'denominator is zero' END AS ratio_reason FROM d""")
def derive_efficiency_ratio(spark, sf_dir):
    w = _v(spark, sf_dir, "workout")
    e = X.efficiency("total_distance", "total_distance_unit", "duration", "duration_unit", "total_energy", F.lit("bpm"))
    r = X.ratio("duration", F.lit("u"), "total_energy", F.lit("u"))
    out = w.select("id", e.alias("e"), r.alias("r"))
    return flat(out.select("id", F.col("e.value").alias("efficiency"), F.col("e.reason").alias("efficiency_reason"), F.col("r.value").alias("ratio"), F.col("r.reason").alias("ratio_reason")))


@query("""WITH m AS (SELECT workout_id, value_num FROM v_stat WHERE key = 'qty:N')
    SELECT strftime(local_date, '%Y-%m') AS period, count(*) AS n, round(median(value_num), 4) AS median, count(value_num) AS with_measure, count(*) FILTER (value_num IS NULL) AS missing
    FROM v_workout w LEFT JOIN m ON m.workout_id = w.id GROUP BY 1""")
def workout_series_median(spark, sf_dir):
    w, s = _v(spark, sf_dir, "workout", "stat")
    out = workouts.workout_series(w, s, "month", ["qty:N"])
    return flat(out.select("period", "n", F.col("m0.value").alias("median"), F.col("m0_n").alias("with_measure"), F.col("m0_missing").alias("missing")))


@query("""SELECT strftime(local_date, '%Y-%m') AS period, round(CASE WHEN count(DISTINCT duration_unit) = 1 THEN sum(duration) END, 4) AS duration, CASE WHEN count(DISTINCT duration_unit) > 1 THEN 'mixed' ELSE min(duration_unit) END AS duration_unit,
    round(CASE WHEN count(DISTINCT CASE WHEN total_distance IS NOT NULL THEN total_distance_unit END) = 1 THEN sum(total_distance) END, 4) AS distance, round(sum(total_energy), 4) AS energy
    FROM v_workout WHERE source_name <> 'P' OR month(local_date) = 3 GROUP BY 1""")
def workout_mixed_units(spark, sf_dir):
    w = _v(spark, sf_dir, "workout").filter((F.col("source_name") != "P") | (F.month("local_date") == 3))
    out = workouts.workout_series(w, period="month")
    return flat(out.select("period", F.col("duration.value").alias("duration"), F.col("duration.unit").alias("duration_unit"), F.col("total_distance.value").alias("distance"), F.col("total_energy.value").alias("energy")))


@query("""WITH l AS (SELECT strftime(local_date, '%Y-%m') AS period, list_sort(list(value_num)) AS v FROM v_workout w JOIN v_stat s ON s.workout_id = w.id AND key = 'qty:N' GROUP BY 1)
    SELECT period, v[greatest(1, (50 * len(v) + 99) // 100)] AS p50, v[greatest(1, (90 * len(v) + 99) // 100)] AS p90 FROM l""")
def percentile_nearest_rank(spark, sf_dir):
    w, s = _v(spark, sf_dir, "workout", "stat")
    held = w.join(s.filter("key = 'qty:N'").select("workout_id"), F.col("id") == F.col("workout_id"), "left_semi")
    out = workouts.workout_series(held, s, "month", ["qty:N"], ["percentile"])
    return flat(out.select("period", F.col("percentile.p50").alias("p50"), F.col("percentile.p90").alias("p90")))


@query("""WITH w AS (SELECT id, start_epoch, value_num * 10 AS duration FROM v_record WHERE type = 'purchase' AND value_num > 0)
    SELECT w.id, r.type, count(*) AS count FROM w JOIN v_record r ON r.type IN ('click', 'view') AND r.start_epoch BETWEEN w.start_epoch AND w.start_epoch + duration * 60 GROUP BY 1, 2""")
def sample_depth(spark, sf_dir):
    record = _v(spark, sf_dir, "record")
    rides = record.filter("type = 'purchase' AND value_num > 0").select("id", "start_epoch", (F.col("value_num") * 10).alias("duration"), F.lit("min").alias("duration_unit"))
    return workouts.sample_depth(rides, record, ["click", "view"]).filter("count > 0").select("id", "type", "count")


@query("""SELECT key, kind, count(DISTINCT workout_id) AS workouts, count(value_num) AS numeric, 'u' AS units FROM v_stat s JOIN v_workout w ON w.id = s.workout_id GROUP BY 1, 2""")
def measure_inventory(spark, sf_dir):
    return flat(workouts.measure_inventory(*_v(spark, sf_dir, "workout", "stat")).withColumn("units", F.array_join("units", ",")))


@query("""SELECT (SELECT count(*) FROM v_workout) AS workouts, count(DISTINCT workout_id) AS with_statistics, CAST(0 AS BIGINT) AS with_metadata FROM v_stat""")
def stat_coverage(spark, sf_dir):
    return workouts.stat_coverage(*_v(spark, sf_dir, "workout", "stat"))


@query("""WITH x AS (SELECT id, total_distance, total_energy, indoor FROM v_workout)
    SELECT id AS workout_id, 'statistic' AS kind, 'dist:sum' AS key, round(total_distance, 4) AS value_num, CAST(NULL AS VARCHAR) AS value_text, 'km' AS unit FROM x WHERE total_distance IS NOT NULL
    UNION ALL SELECT id, 'statistic', 'dist:average', round(total_energy, 4), NULL, 'km' FROM x WHERE total_distance IS NOT NULL
    UNION ALL SELECT id, 'metadata', 'where', NULL, CASE WHEN indoor THEN 'inside' ELSE 'outside' END, NULL FROM x""")
def stat_explode(spark, sf_dir):
    w = _v(spark, sf_dir, "workout")
    one = F.create_map(F.lit("type"), F.lit("dist"), F.lit("unit"), F.lit("km"), F.lit("sum"), F.col("total_distance").cast("string"), F.lit("average"), F.col("total_energy").cast("string"))
    w = w.withColumn("statistics", F.when(F.col("total_distance").isNotNull(), F.array(one)))
    w = w.withColumn("metadata", F.create_map(F.lit("where"), F.when(F.col("indoor"), "inside").otherwise("outside")))
    return flat(workouts.stat_rows(w))


# Laboratory results.


@query("""WITH c AS (SELECT *, count(*) OVER (PARTITION BY analyte_key, collected_date, value_num, source) AS c FROM v_lab),
    m AS (SELECT *, max(c) OVER g AS most, count(DISTINCT source) OVER g AS ns, row_number() OVER (PARTITION BY analyte_key, collected_date, value_num ORDER BY ref_text IS NULL, via_ocr, source <> 'pdf', id) AS r FROM c WINDOW g AS (PARTITION BY analyte_key, collected_date, value_num)),
    s AS (SELECT analyte_key, collected_date, count(DISTINCT CASE WHEN ns = 1 THEN source END) > 1 AS clash FROM m GROUP BY 1, 2)
    SELECT m.analyte_key, strftime(m.collected_date, '%Y-%m-%d') AS collected_date, m.id, m.value_num, m.source, s.clash FROM m JOIN s USING (analyte_key, collected_date) WHERE ns = 1 OR r <= most""")
def lab_collapse(spark, sf_dir):
    return flat(labs.collapse(_v(spark, sf_dir, "lab")).select("analyte_key", "collected_date", "id", "value_num", "source", "clash"))


@query("""SELECT id, CASE WHEN flag = 'H' THEN 'out_of_range' WHEN value_num < ref_low OR value_num > ref_high THEN 'out_of_range' ELSE 'in_range' END AS range_status, value_num < ref_low OR value_num > ref_high AS out_of_range FROM v_lab""")
def lab_range_status(spark, sf_dir):
    return _v(spark, sf_dir, "lab").select("id", X.range_status().alias("range_status"), X.out_of_range().alias("out_of_range"))


@query("""WITH c AS (SELECT *, count(*) OVER (PARTITION BY analyte_key, collected_date, value_num, source) AS c FROM v_lab),
    m AS (SELECT *, max(c) OVER g AS most, count(DISTINCT source) OVER g AS ns, row_number() OVER (PARTITION BY analyte_key, collected_date, value_num ORDER BY ref_text IS NULL, via_ocr, source <> 'pdf', id) AS r FROM c WINDOW g AS (PARTITION BY analyte_key, collected_date, value_num)),
    u AS (SELECT *, (flag IS NOT NULL AND flag <> '') OR value_num < ref_low OR value_num > ref_high AS out FROM m WHERE ns = 1 OR r <= most),
    d AS (SELECT analyte_key, collected_date, arg_max(value_num, id) AS v, arg_max(out, id) AS out, count(DISTINCT value_num) > 1 AS disagree, max(CASE WHEN out THEN id END) AS oid, arg_max(value_num, id) FILTER (out) AS ov FROM u GROUP BY 1, 2),
    l AS (SELECT *, row_number() OVER (PARTITION BY analyte_key ORDER BY collected_date DESC) AS k, lag(v) OVER o AS pv, lag(collected_date) OVER o AS pd,
             last_value(ov IGNORE NULLS) OVER e AS eo, last_value(CASE WHEN oid IS NOT NULL THEN collected_date END IGNORE NULLS) OVER e AS ed
          FROM d WINDOW o AS (PARTITION BY analyte_key ORDER BY collected_date), e AS (PARTITION BY analyte_key ORDER BY collected_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT *, CASE WHEN disagree THEN 'lab_sources_disagree' WHEN out THEN 'lab_out_of_range' WHEN ed IS NOT NULL THEN 'lab_returned_to_range'
                         WHEN 80 - v <= 6 AND v > pv OR v - 20 <= 6 AND v < pv THEN 'lab_near_limit' END AS kind FROM l WHERE k = 1)
    SELECT analyte_key, kind, strftime(collected_date, '%Y-%m-%d') AS latest_date, v AS latest,
           CASE kind WHEN 'lab_sources_disagree' THEN NULL WHEN 'lab_returned_to_range' THEN strftime(ed, '%Y-%m-%d') ELSE strftime(pd, '%Y-%m-%d') END AS previous_date,
           CASE kind WHEN 'lab_sources_disagree' THEN NULL WHEN 'lab_returned_to_range' THEN eo ELSE pv END AS previous FROM s WHERE kind IS NOT NULL""")
def lab_signals(spark, sf_dir):
    out = labs.lab_signals(labs.collapse(_v(spark, sf_dir, "lab")))
    return flat(out.select("analyte_key", "kind", "latest_date", "latest", "previous_date", "previous"))


@query("""SELECT analyte_key, panel, count(*) AS n, strftime(min(collected_date), '%Y-%m-%d') AS first, strftime(max(collected_date), '%Y-%m-%d') AS last, max(analyte) AS printed_as FROM v_lab GROUP BY 1, 2""")
def analyte_list(spark, sf_dir):
    return flat(labs.list_analytes(_v(spark, sf_dir, "lab")))


@query("""WITH p AS (SELECT min(panel) AS panel FROM v_lab WHERE analyte_key = 'a3') SELECT analyte_key, count(*) AS n, max(analyte) AS printed_as, strftime(min(collected_date), '%Y-%m-%d') AS first, strftime(max(collected_date), '%Y-%m-%d') AS last
    FROM v_lab JOIN p USING (panel) WHERE analyte_key <> 'a3' GROUP BY 1""")
def panel_siblings(spark, sf_dir):
    return flat(labs.panel_siblings(_v(spark, sf_dir, "lab"), "a3"))


# Clinical records and documents.


@query("""SELECT f.kind, name, status, onset_date, detail_text, path AS citation FROM v_fact f JOIN v_document d ON d.id = f.document_id WHERE f.kind = 'condition' AND (onset_date IS NULL OR onset_date >= '2015')""")
def clinical_facts(spark, sf_dir):
    out = clinical.clinical_facts(*_v(spark, sf_dir, "fact", "document"), kind="condition", since="2015")
    return out.select("kind", "name", "status", "onset_date", "detail_text", "citation")


@query("SELECT kind, count(*) AS n, min(onset_date) AS first, max(onset_date) AS last FROM v_fact GROUP BY 1")
def fact_coverage(spark, sf_dir):
    return clinical.fact_coverage(_v(spark, sf_dir, "fact"))


@query("""SELECT metric_key, metric, round(value_num, 4) AS value_num, unit, measured_at, path AS citation FROM v_vital v JOIN v_document d ON d.id = v.document_id WHERE metric_key = 'metric_3' AND local_date >= DATE '2024-03-01'""")
def clinical_vitals(spark, sf_dir):
    out = clinical.clinical_vitals(*_v(spark, sf_dir, "vital", "document"), metric="Metric 3", start="2024-03-01", limit=None)
    return flat(out.select("metric_key", "metric", "value_num", "unit", "measured_at", "citation"))


@query("""SELECT metric_key, max(metric) AS metric, count(*) AS n, strftime(min(local_date), '%Y-%m-%d') AS first, strftime(max(local_date), '%Y-%m-%d') AS last, CASE WHEN count(DISTINCT unit) <= 1 THEN min(unit) END AS unit,
    coalesce(string_agg(DISTINCT unit, ',' ORDER BY unit), '') AS units FROM v_vital GROUP BY 1""")
def vital_metrics(spark, sf_dir):
    return flat(clinical.vital_metrics(_v(spark, sf_dir, "vital")).withColumn("units", F.array_join("units", ",")))


@query("""SELECT kind AS holding, count(*) AS n, min(onset_date) AS first, max(onset_date) AS last FROM v_fact GROUP BY 1
    UNION ALL SELECT 'vitals', count(*), strftime(min(local_date), '%Y-%m-%d'), strftime(max(local_date), '%Y-%m-%d') FROM v_vital
    UNION ALL SELECT 'labs', count(*), strftime(min(collected_date), '%Y-%m-%d'), strftime(max(collected_date), '%Y-%m-%d') FROM v_lab WHERE extracted_by = 'fhir'
    UNION ALL SELECT 'note references', count(*), strftime(min(doc_date), '%Y-%m-%d'), strftime(max(doc_date), '%Y-%m-%d') FROM v_document WHERE kind = 'fhir'""")
def clinical_holdings(spark, sf_dir):
    return clinical.holdings(*_v(spark, sf_dir, "fact", "vital", "lab", "document"))


@query("""SELECT d.id, d.kind, strftime(doc_date, '%Y-%m-%d') AS doc_date, (SELECT count(*) FROM v_chunk c WHERE c.document_id = d.id) AS chunks, (SELECT count(*) FROM v_lab l WHERE l.document_id = d.id) AS labs,
    (SELECT string_agg(tag, ', ' ORDER BY tag) FROM v_tag t WHERE t.document_id = d.id) AS tags FROM v_document d WHERE kind <> 'fhir'""")
def documents_list(spark, sf_dir):
    document, lab, chunk, tag = _v(spark, sf_dir, "document", "lab", "chunk", "tag")
    return flat(documents.list_documents(document, lab, chunk, tag).select("id", "kind", "doc_date", "chunks", "labs", "tags"))


@query("""SELECT tag, count(*) AS n, strftime(min(doc_date), '%Y-%m-%d') AS first, strftime(max(doc_date), '%Y-%m-%d') AS last FROM v_tag t JOIN v_document d ON d.id = t.document_id GROUP BY 1""")
def tags_list(spark, sf_dir):
    return flat(documents.list_tags(*_v(spark, sf_dir, "document", "tag")))


@query("SELECT id, kind, path FROM v_document WHERE id IN (SELECT document_id FROM v_tag WHERE tag = 'src3')")
def notes_by_tag(spark, sf_dir):
    return documents.notes_by_tag(*_v(spark, sf_dir, "document", "tag"), "src3").select("id", "kind", "path")


@query("""SELECT count(*) AS notes, count(*) FILTER (kind = 'image') AS images, strftime(min(doc_date), '%Y-%m-%d') AS first, strftime(max(doc_date), '%Y-%m-%d') AS last, count(*) FILTER (doc_date IS NULL) AS undated,
    (SELECT count(DISTINCT tag) FROM v_tag) AS tags, (SELECT count(*) FROM v_chunk c JOIN v_document d ON d.id = c.document_id WHERE d.kind IN ('note', 'image')) AS chunks FROM v_document WHERE kind IN ('note', 'image')""")
def note_summary(spark, sf_dir):
    return flat(documents.note_summary(*_v(spark, sf_dir, "document", "tag", "chunk")))


# Windows.


def _side_sql(span: str, t: str) -> str:
    return f"""(SELECT count(*) AS n, count(v) AS vp, min(v) AS lo, max(v) AS hi, median(v) AS med, avg(v) AS mean, sum(n) AS counted FROM
      (SELECT local_date, max(s) AS v, sum(n) AS n FROM (SELECT local_date, source_name, sum(sum_value) AS s, sum(n) AS n FROM r WHERE type = 'view' AND {span} GROUP BY 1, 2) GROUP BY 1)) {t}"""


def _compare_sql(left: str, right: str) -> str:
    return f"""WITH {ROLLUP} SELECT b.n AS before_n, a.n AS after_n, round(b.med, 4) AS before_median, round(a.med, 4) AS after_median, round(b.mean, 4) AS before_mean, round(a.mean, 4) AS after_mean, CAST(b.counted AS BIGINT) AS before_counted,
      CASE WHEN b.n = 0 OR a.n = 0 THEN 'insufficient_data' WHEN b.vp = 0 OR a.vp = 0 THEN 'missing_measure_on_one_side' WHEN b.vp < 2 OR a.vp < 2 THEN 'thin_on_one_side' WHEN b.hi < a.lo OR a.hi < b.lo THEN 'no_overlap' ELSE 'ok' END AS verdict
      FROM {_side_sql(left, "b")}, {_side_sql(right, "a")}"""


def _compared(spark, sf_dir, left, right):
    # One unit, so that the verdict goes past the rule on mixed ones.
    rollup = series.daily_rollup(_v(spark, sf_dir, "record").withColumns({"type": F.when(F.col("type") == "view", "HKQuantityTypeIdentifierStepCount").otherwise(F.col("type")), "unit": F.lit("u")}))
    out = windows.compare(windows.Spec(metric="steps"), left, right, "day", rollup=rollup)
    return flat(out.selectExpr("before.n AS before_n", "after.n AS after_n", "before.median AS before_median", "after.median AS after_median", "before.mean AS before_mean", "after.mean AS after_mean", "before.counted AS before_counted", "verdict"))


@query(_compare_sql("local_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-14'", "local_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-25'"))
def anchor_window(spark, sf_dir):
    return _compared(spark, sf_dir, *windows.anchored("2024-01-15", 10, 10))


@query(_compare_sql("local_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20'", "local_date BETWEEN DATE '2024-01-22' AND DATE '2024-01-22'"))
def range_compare_verdict(spark, sf_dir):
    return _compared(spark, sf_dir, ("2024-01-01", "2024-01-20"), ("2024-01-22", "2024-01-22"))


@query("""WITH d AS (SELECT type AS metric, local_date AS date, sum(value_num) AS value FROM v_record WHERE value_num IS NOT NULL GROUP BY 1, 2), l AS (SELECT metric, max(date) AS last FROM d GROUP BY 1)
    SELECT metric, strftime(last, '%Y-%m-%d') AS last, round(avg(value) FILTER (last - date < 7), 4) AS recent_mean, round(avg(value) FILTER (last - date BETWEEN 7 AND 13), 4) AS prior_mean,
           count(*) FILTER (last - date < 7) AS recent_days, count(*) FILTER (last - date BETWEEN 7 AND 13) AS prior_days,
           coalesce(abs(avg(value) FILTER (last - date < 7) - avg(value) FILTER (last - date BETWEEN 7 AND 13)) / abs(avg(value) FILTER (last - date BETWEEN 7 AND 13)) * 100 >= 5, FALSE) AS shifted FROM d JOIN l USING (metric) GROUP BY metric, last""")
def metric_shift(spark, sf_dir):
    daily = _v(spark, sf_dir, "record").filter("value_num IS NOT NULL").groupBy(F.col("type").alias("metric"), F.col("local_date").alias("date")).agg(F.sum("value_num").alias("value"), F.array_sort(F.collect_set("source_name")).alias("sources"))
    out = windows.metric_shifts(daily, 7, {t: ("pct", 5.0) for t in ("click", "view", "purchase", "signup")})
    return flat(out.select("metric", "last", "recent_mean", "prior_mean", "recent_days", "prior_days", "shifted"))


# Writing.


@query("SELECT type, strftime(local_date, '%Y-%m-%d') AS local_date, source_name, min(id) AS id, arg_min(round(duration_sec, 4), id) AS duration_sec FROM v_record GROUP BY 1, 2, 3")
def dedup_first_wins(spark, sf_dir):
    out = writes.first_wins(_v(spark, sf_dir, "record"), ["type", "local_date", "source_name"], "id")
    return flat(out.select("type", "local_date", "source_name", "id", "duration_sec"))


@query("SELECT o_custkey, max(o_orderkey) AS id FROM orders GROUP BY 1")
def dedup_last_wins(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return writes.last_wins(orders, ["o_custkey"], "o_orderkey").select("o_custkey", F.col("o_orderkey").alias("id"))


@query("""WITH n AS (SELECT dedup_key, 'active' AS status, document_id + 1000 AS document_id, name FROM v_fact WHERE document_id % 2 = 0)
    SELECT f.dedup_key, CASE WHEN n.status IS NOT NULL AND n.status <> f.status THEN n.status ELSE f.status END AS status, CASE WHEN n.status IS NOT NULL AND n.status <> f.status THEN n.document_id ELSE f.document_id END AS document_id
    FROM v_fact f LEFT JOIN n USING (dedup_key)""")
def upsert_status(spark, sf_dir):
    fact = _v(spark, sf_dir, "fact").select("dedup_key", "status", "document_id", "name")
    new = fact.filter("document_id % 2 = 0").withColumns({"status": F.lit("active"), "document_id": F.col("document_id") + 1000})
    return writes.upsert_changed(fact, new, "dedup_key", "status", ["document_id"]).select("dedup_key", "status", "document_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def orphan_antijoin(spark, sf_dir):
    """Customers that no urgent order refers to."""
    customer, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    orders = orders.filter("o_orderpriority = '1-URGENT'")
    return writes.orphans(customer, orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


@query("SELECT id, kind FROM v_document WHERE id % 4 <> 1 UNION ALL SELECT id, 'new' FROM v_document WHERE id % 4 = 1")
def replace_by_file(spark, sf_dir):
    document = _v(spark, sf_dir, "document").select("id", "kind")
    return writes.replace_by(document, document.filter("id % 4 = 1").withColumn("kind", F.lit("new")), "id")


@query("SELECT id FROM v_document WHERE id % 3 <> 0 OR id % 6 <> 0")
def ledger_unprocessed(spark, sf_dir):
    files = _v(spark, sf_dir, "document").select("id", "path", F.sha2("path", 256).alias("sha256"))
    ledger = files.filter("id % 3 = 0").select("path", "sha256", F.when(F.col("id") % 6 == 0, "complete").otherwise("partial").alias("status"))
    return writes.unprocessed(files, ledger).select("id")


# Search.

WORDS = """x AS (SELECT id, regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)') AS w FROM v_chunk), l AS (SELECT id, len(w) AS length FROM x),
    t AS (SELECT id, u AS term, count(*) AS tf FROM (SELECT id, unnest(w) AS u FROM x) GROUP BY 1, 2),
    n AS (SELECT count(*) AS total, avg(length) AS mean FROM l), d AS (SELECT term, count(*) AS df FROM t WHERE term IN ('thtion', 'token', 'ledge') GROUP BY 1),
    s AS (SELECT t.id, sum(CASE WHEN ln((total - df + 0.5) / (df + 0.5)) > 0 THEN ln((total - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score
          FROM t JOIN d USING (term) JOIN l ON l.id = t.id, n GROUP BY 1)"""


@query(f"WITH {WORDS} SELECT id, round(score, 4) AS score FROM s ORDER BY s.score DESC, id LIMIT 20".replace("\\\\", "\\"))
def bm25_search(spark, sf_dir):
    index = keyword.build_index(_v(spark, sf_dir, "chunk"), None)
    return flat(keyword.bm25(*index, "thtion token ledge", 20, None))


@query("""SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 4) AS distance FROM embeddings WHERE label <> 3 ORDER BY 2, 1 LIMIT 10""")
def vector_topk(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = table.filter("vec_id = 0").first()["embedding"]
    among = table.filter("label <> 3").select(F.col("vec_id").alias("id"))
    return flat(vectors.vector_search(table, asked, 10, among=among, key="vec_id", vector="embedding").select("vec_id", "distance"))


@query("""SELECT doc_id, tier_rank, n_chars FROM (SELECT doc_id, CASE WHEN doc_id % 8 > 0 THEN doc_id % 8 END AS tier_rank, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents)
    WHERE tier_rank IS NULL OR tier_rank <= 5 ORDER BY coalesce(tier_rank, 99), position LIMIT 50""")
def evidence_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", "n_chars", F.when(F.col("doc_id") % 8 > 0, F.col("doc_id") % 8).alias("tier_rank"), F.struct(-F.col("n_chars"), "doc_id").alias("position"))
    return literature.evidence_order(found.filter("tier_rank IS NULL OR tier_rank <= 5"), 50).select("doc_id", "tier_rank", "n_chars")


# The corpus, and functions of text.


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT o_orderpriority AS pack, strftime(max(o_orderdate), '%Y-%m-%d') AS ran_at, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS id FROM orders GROUP BY 1")
def latest_refresh(spark, sf_dir):
    log = _table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pack"), F.col("o_orderdate").alias("ran_at"), F.col("o_orderkey").alias("id"))
    return literature.latest_refresh(log).withColumn("ran_at", F.date_format("ran_at", "yyyy-MM-dd"))


@query("""SELECT concat(l_returnflag, l_partkey % 60) AS term, count(DISTINCT CASE WHEN l_linenumber = 1 THEN l_orderkey END) AS major, count(DISTINCT l_orderkey) AS articles
    FROM lineitem GROUP BY 1 HAVING major > 0 ORDER BY major DESC, term LIMIT 20""")
def corpus_topics(spark, sf_dir):
    mesh = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pmid"), F.concat("l_returnflag", (F.col("l_partkey") % 60).cast("string")).alias("term"), (F.col("l_linenumber") == 1).alias("major"))
    return literature.topics(mesh)


@query("SELECT l_orderkey AS pmid, count(DISTINCT l_returnflag) AS packs FROM lineitem GROUP BY 1 HAVING packs > 1")
def articles_in_several_packs(spark, sf_dir):
    return literature.in_several_packs(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pmid"), F.col("l_returnflag").alias("pack")))


@query("SELECT event_type AS tier, count(*) AS n, count(*) FILTER (user_id % 10 = 0) AS retracted, min(user_id) AS first_year, max(user_id) AS last_year FROM events GROUP BY 1")
def tier_histogram(spark, sf_dir):
    return literature.tier_histogram(_table(spark, sf_dir, "events").select(F.col("event_type").alias("tier"), (F.col("user_id") % 10 == 0).alias("retracted"), F.col("user_id").alias("year")))


TYPES = ["Meta-Analysis", "Letter", "Review", "Case Reports", "Clinical Trial Protocol", "Randomized Controlled Trial", "Guideline", "Comparative Study"]


@query("""WITH t(i, tier, rank) AS (VALUES (0, 'meta_analysis', 1), (1, NULL, NULL), (2, 'narrative_review', 5), (3, 'case_report', 7), (4, 'protocol', 0), (5, 'rct', 3), (6, 'guideline', 2), (7, 'observational', 6)),
    p AS (SELECT c_custkey, unnest([c_custkey % 8, (c_custkey * 3 + 1) % 8]) AS i FROM customer),
    b AS (SELECT c_custkey, arg_min(tier, rank) AS tier, min(rank) AS rank FROM p JOIN t USING (i) GROUP BY 1)
    SELECT c_custkey, coalesce(tier, 'unknown') AS tier, CASE WHEN rank > 0 THEN rank END AS rank, CASE WHEN tier IS NULL THEN 'unmapped' ELSE 'publication_type' END AS source FROM b""")
def evidence_tiers(spark, sf_dir):
    named = F.array(*[F.lit(t) for t in TYPES])
    of = lambda c: F.element_at(named, (c % len(TYPES) + 1).cast("int"))
    rows = _table(spark, sf_dir, "customer").withColumn("e", X.evidence(F.array(of(F.col("c_custkey")), of(F.col("c_custkey") * 3 + 1))))
    return rows.select("c_custkey", "e.tier", "e.rank", "e.source")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_partkey % 50 AS DOUBLE) WHEN 2 THEN CAST(p_partkey % 90 AS DOUBLE) END AS low,
    CASE p_partkey % 4 WHEN 0 THEN p_partkey % 50 + 10.5 WHEN 1 THEN CAST(p_partkey % 70 AS DOUBLE) END AS high FROM part""")
def reference_ranges(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.concat((k % 50).cast("string"), F.lit(" - "), (k % 50 + 10).cast("string"), F.lit(".5"))).when(k % 4 == 1, F.concat(F.lit("< "), (k % 70).cast("string"))).when(k % 4 == 2, F.concat(F.lit(">= "), (k % 90).cast("string"))).otherwise("Not Estab.")
    return _table(spark, sf_dir, "part").withColumn("r", X.reference_range(text)).select("p_partkey", "r.low", "r.high")


@query("SELECT id, strftime(local_date, '%Y-%m-%d') AS local_date FROM v_workout WHERE source_name <> 'P' AND NOT indoor ORDER BY start_epoch DESC, id DESC LIMIT 50")
def workout_list(spark, sf_dir):
    return flat(workouts.list_workouts(_v(spark, sf_dir, "workout"), 50, exclude=["P"], indoor=False).select("id", "local_date"))


@query("""SELECT (SELECT count(*) FROM v_document WHERE kind <> 'fhir') AS documents, (SELECT count(*) FROM v_chunk c JOIN v_document d ON d.id = c.document_id WHERE kind <> 'fhir') AS chunks,
    (SELECT count(embedded_with) FROM v_chunk c JOIN v_document d ON d.id = c.document_id WHERE kind <> 'fhir') AS embedded, (SELECT count(DISTINCT analyte_key) FROM v_lab) AS analytes""")
def document_summary(spark, sf_dir):
    document, chunk, lab = _v(spark, sf_dir, "document", "chunk", "lab")
    pages = document.select(F.col("id").alias("document_id"), F.lit("text").alias("extraction"))
    return documents.document_summary(document, pages, chunk, lab).select("documents", "chunks", "embedded", "analytes")


def guard_flags(spark, sf_dir):
    """Rules over every turn of the conversations; no SQL says the same."""
    from vitalspan.guard import flagged

    rows = flagged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"))
    return rows.select("conv_id", "turn", F.size("flags").alias("flags"))


QUERIES["guard_flags"] = guard_flags
