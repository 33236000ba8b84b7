"""Registered queries over what is kept: tables that change without being rewritten, indexes that last, batches one after the other."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from vitalspan.catalog import Catalog
from vitalspan.functions import exprs as X
from vitalspan.operators import held
from vitalspan.operators.ranks import nearest_ranks
from vitalspan.operators.windows import Spec
from vitalspan.plans.parsed import _members
from vitalspan.plans.registry import ORACLE_SQL, _table, _v, flat, query
from vitalspan.search.segments import KeywordIndex
from vitalspan.search.vectors import VectorStore
from vitalspan.sources import fhir, wearable
from vitalspan.streaming.records import absorb


def same_as(name: str):
    """Registers a query with the oracle of another one."""

    def register(f):
        ORACLE_SQL[f.__name__] = ORACLE_SQL[name]
        return query()(f)

    return register


def _place(spark) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or a temporary one where all runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="vitalspan-")
    return f"{base.rstrip('/')}/kept-{uuid.uuid4().hex}"


def _records(spark, sf_dir):
    """The records with a key and a place of their own."""
    return _v(spark, sf_dir, "record").withColumn("dedup_key", X.identity("id", "type", "start_epoch")).withColumn("seq", F.col("id"))


# Tables that change.


@query("""SELECT type, count(*) AS n, round(sum(value_num), 4) AS total, count(value_num) AS numbers FROM v_record
    WHERE type <> 'error' AND NOT coalesce(value_num > 60, FALSE) AND local_date NOT IN (SELECT local_date FROM v_record WHERE type = 'purchase' AND value_num < 1) GROUP BY type""")
def catalog_delete(spark, sf_dir):
    """By conditions and by keys; only deletion vectors are written."""
    c = Catalog.open(spark, _place(spark), create=True)
    c.append("record", _records(spark, sf_dir))
    days = c.table("record").filter("type = 'purchase' AND value_num < 1").select("local_date")
    c.delete("record", days, ["local_date"])
    c.delete("record", F.col("type") == "error")
    c.delete("record", F.col("value_num") > 60)
    return flat(c.table("record").groupBy("type").agg(F.count("*").alias("n"), F.sum("value_num").alias("total"), F.count("value_num").alias("numbers")))


@query("""SELECT type, count(*) AS n, round(sum(CASE WHEN type IN ('click', 'view') THEN 2 * value_num ELSE value_num END), 4) AS total FROM v_record GROUP BY type""")
def catalog_replace(spark, sf_dir):
    """Rows of two types are replaced by what is read from the very table."""
    c = Catalog.open(spark, _place(spark), create=True)
    c.append("record", _records(spark, sf_dir))
    doubled = c.table("record").filter("type IN ('click', 'view')").withColumn("value_num", F.col("value_num") * 2)
    c.replace("record", doubled, ["type", "local_date"])
    return flat(c.table("record").groupBy("type").agg(F.count("*").alias("n"), F.sum("value_num").alias("total")))


@query("""WITH b AS (SELECT b.range AS batch, count(*) AS n_rows,
        count(CASE WHEN type <> 'error' AND day(local_date) % 3 = b.range OR type = 'error' AND b.range = 0 THEN 1 END) AS n_added
        FROM v_record, range(3) AS b WHERE type = 'error' OR day(local_date) % 3 = b.range GROUP BY b.range)
    SELECT batch, n_rows, n_added FROM b UNION ALL SELECT 3, count(*), 0 FROM v_record""")
def batches_by_filter(spark, sf_dir):
    """Days in three batches, each with all errors, then everything once more: what each adds to folders known by their filters."""
    c, rows = Catalog.open(spark, _place(spark), create=True), _records(spark, sf_dir)
    out = None
    for batch in range(4):
        part = rows if batch == 3 else rows.filter((F.col("type") == "error") | (F.dayofmonth("local_date") % 3 == batch))
        added = c.append("record", c.unheld("record", part, "seq"))
        line = part.agg(F.lit(batch).cast("long").alias("batch"), F.count("*").alias("n_rows")).crossJoin(added.agg(F.count("*").alias("n_added")))  # a row each
        out = line if out is None else out.unionByName(line)
    return out


@same_as("daily_rollup")
def rollup_by_batches(spark, sf_dir):
    """Days in three batches that interleave, then everything once more: the rollup is that of one pass."""
    c, rows = Catalog.open(spark, _place(spark), create=True), _records(spark, sf_dir)
    wide = rows.select(*[F.col(x) if x in rows.columns else F.lit(None).cast(t).alias(x) for x, t in c.table("record").dtypes])
    for batch in [wide.filter(F.dayofmonth("local_date") % 3 == b) for b in range(3)] + [wide]:
        absorb(c, batch)
    return flat(c.table("daily_metric"))


# Indexes that last.


@same_as("bm25_search")
def segment_search(spark, sf_dir):
    """Words without a stemmer, since the oracle has none: a first segment, a second one, some texts that go again."""
    index, chunk = KeywordIndex(spark, _place(spark), None), _v(spark, sf_dir, "chunk")
    longest = chunk.agg(F.max("id")).first()[0] or 0
    early, extra = chunk.filter(F.col("id") <= longest / 2), chunk.select((F.col("id") + longest + 1).alias("id"), F.concat(F.lit("token thtion "), "text").alias("text"))
    index.sync(early.select("id", "text").unionByName(extra))
    index.sync(chunk)
    return flat(index.search("thtion token ledge", 20))


@same_as("vector_topk")
def vector_store(spark, sf_dir):
    table = _table(spark, sf_dir, "embeddings")
    store = VectorStore(Catalog.open(spark, _place(spark), create=True))
    store.add(table.select(F.col("vec_id").alias("chunk_id"), F.lit("given").alias("embedder"), F.col("embedding").alias("vector")))
    store.delete(table.filter("label = 3").select("vec_id"), "vec_id")
    asked = table.filter("vec_id = 0").first()["embedding"]
    return flat(store.search(asked, "given", 10).select(F.col("chunk_id").alias("vec_id"), "distance"))


# Ranks, instants, counters.

_RANK = "round((list_sort(list(value_num) FILTER (value_num IS NOT NULL)))[greatest(1, ({p} * count(value_num) + 99) // 100)], 4) AS p{p}"


@query(f"SELECT type, source_name, {', '.join(_RANK.format(p=p) for p in (1, 25, 28, 50, 90))} FROM v_record GROUP BY type, source_name HAVING count(value_num) > 0")
def percentiles_by_type(spark, sf_dir):
    return flat(nearest_ranks(_v(spark, sf_dir, "record"), ["type", "source_name"], "value_num", (1, 25, 28, 50, 90)))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch(date_trunc('second', ts)) + 5 * 3600 WHEN 1 THEN epoch(date_trunc('second', ts)) WHEN 2 THEN epoch(date_trunc('second', ts)) - 5.5 * 3600 END AS at FROM events""")
def instants_parsed(spark, sf_dir):
    """Timestamps of exports: the usual format with an offset, ISO with and without one, and none."""
    k, day, hour = F.col("event_id") % 4, F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    text = F.when(k == 0, F.concat(day, F.lit(" "), hour, F.lit(" -0500"))).when(k == 1, F.concat(day, F.lit("T"), hour)).when(k == 2, F.concat(day, F.lit("T"), hour, F.lit("+05:30"))).otherwise(F.concat(F.lit("someday "), day))
    return _table(spark, sf_dir, "events").select("event_id", wearable.epoch(text).alias("at"))


@query("""SELECT count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 3 <> 0) AS stored, count(*) FILTER (c_custkey % 7 = 0) AS unreadable, 0 AS failed,
    count(*) FILTER (c_custkey % 7 <> 0 AND c_custkey % 3 = 0) AS skipped, 0 AS ignored FROM customer""")
def clinical_counters(spark, sf_dir):
    """What becomes of each member when conditions aren't asked for."""
    return fhir.ingest(_members(spark, sf_dir), "condition")["counters"]


@query("""SELECT c_custkey AS id, 'sodium' AS analyte_key, CAST(c_custkey % 90 AS DOUBLE) AS value_num, CASE WHEN c_custkey % 4 <> 0 THEN 30.0 END AS ref_low, CASE WHEN c_custkey % 5 <> 0 THEN 60.5 END AS ref_high,
    CASE WHEN c_custkey % 3 = 0 THEN 'High' END AS flag, CASE WHEN c_custkey % 4 <> 0 OR c_custkey % 5 <> 0 THEN 'as printed' END AS ref_text FROM customer WHERE c_custkey % 11 <> 0""")
def fhir_ranges(spark, sf_dir):
    """Laboratory results with one, both or no limits, a flag or none; a resource whose number has no end is left out whole."""
    k = F.col("c_custkey")
    text = lambda c: c.cast("string")
    limits = F.concat_ws(", ", F.when(k % 4 != 0, F.lit('"low": {"value": 30}')), F.when(k % 5 != 0, F.lit('"high": {"value": 60.5}')), F.when((k % 4 != 0) | (k % 5 != 0), F.lit('"text": "as printed"')))
    flag = F.when(k % 3 == 0, ', "interpretation": [{"text": "High"}]').otherwise("")
    value = F.when(k % 11 == 0, "1e400").otherwise(text(k % 90))
    content = F.concat(F.lit('{"resourceType": "Observation", "id": "'), text(k), F.lit('", "category": [{"text": "Laboratory"}], "code": {"text": "Sodium"}, "valueQuantity": {"value": '), value, F.lit('}, "referenceRange": [{'), limits, F.lit("}]"), flag, F.lit("}"))
    members = _table(spark, sf_dir, "customer").select(F.concat(text(k), F.lit(".json")).alias("member"), content.alias("content"))
    return fhir.ingest(members)["lab"].select(F.col("resource_id").cast("long").alias("id"), "analyte_key", "value_num", "ref_low", "ref_high", "flag", "ref_text")


# What an index holds of a figure that a window lacks.

_TOP = """array_to_string(list_transform(list_sort(list(struct_pack(w := -workouts, n := {n})))[1:6], lambda x: concat(x.n, '=', -x.w)), ',')"""


@query(f"""WITH a AS (SELECT activity_type, activity_type ILIKE '%urg%' AS alike, count(*) AS workouts FROM v_workout WHERE activity_type IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT s.key, w.id, w.local_date FROM v_stat s JOIN v_workout w ON w.id = s.workout_id WHERE s.value_num IS NOT NULL), m AS (SELECT key, count(DISTINCT id) AS workouts FROM s GROUP BY 1)
    SELECT count(*) AS total, strftime(min(local_date), '%Y-%m-%d') AS first, strftime(max(local_date), '%Y-%m-%d') AS last, count(*) FILTER (activity_type ILIKE '%urg%') AS activity_n,
    strftime(min(CASE WHEN activity_type ILIKE '%urg%' THEN local_date END), '%Y-%m-%d') AS activity_first, strftime(max(CASE WHEN activity_type ILIKE '%urg%' THEN local_date END), '%Y-%m-%d') AS activity_last,
    count(*) FILTER (activity_type ILIKE '%urg%' AND duration IS NOT NULL) AS timed, (SELECT {_TOP.format(n='activity_type')} FROM a) AS activities, (SELECT {_TOP.format(n='activity_type')} FROM a WHERE alike) AS alike,
    (SELECT count(DISTINCT id) FROM s WHERE key = 'qty:N') AS measure_n, (SELECT strftime(min(local_date), '%Y-%m-%d') FROM s WHERE key = 'qty:N') AS measure_first,
    (SELECT strftime(max(local_date), '%Y-%m-%d') FROM s WHERE key = 'qty:N') AS measure_last, (SELECT {_TOP.format(n='key')} FROM m) AS measures FROM v_workout""")
def window_held(spark, sf_dir):
    """Of all workouts, of an activity and of a measure."""
    w, s = _v(spark, sf_dir, "workout", "stat")
    found = held.held(Spec(workouts=True, activity="urg", measure="qty:N"), workout=w, stat=s)
    shown = lambda c: F.array_join(F.transform(c, lambda e: F.concat(e["name"], F.lit("="), e["workouts"].cast("string"))), ",").alias(c)
    return found.select(*[shown(c) if c in ("activities", "alike", "measures") else F.col(c) for c in found.columns])


@query("""WITH w AS (SELECT id, start_epoch, CASE WHEN value_num <= 40 THEN value_num * 10 END AS duration, local_date FROM v_record WHERE type = 'purchase' AND value_num > 0 AND coalesce(source_name, '') <> 'src1'),
    c AS (SELECT w.id, w.local_date, w.duration, count(r.id) AS n FROM w LEFT JOIN v_record r ON r.type = 'click' AND r.start_epoch BETWEEN w.start_epoch AND w.start_epoch + w.duration * 60 GROUP BY 1, 2, 3)
    SELECT s.side, 'click' AS type, count(c.duration) AS counted, count(*) FILTER (c.id IS NOT NULL AND c.duration IS NULL) AS uncounted, round(median(CASE WHEN c.duration IS NOT NULL THEN c.n END), 4) AS median
    FROM (VALUES ('first', DATE '2024-01-01', DATE '2024-01-10'), ('second', DATE '2024-01-11', DATE '2024-12-31')) s(side, a, b) LEFT JOIN c ON c.local_date BETWEEN s.a AND s.b GROUP BY 1""")
def window_depth(spark, sf_dir):
    """Records within the workouts of two windows, one device left out, some workouts without a duration."""
    record = _v(spark, sf_dir, "record")
    rides = record.filter("type = 'purchase' AND value_num > 0").select("id", "start_epoch", "local_date", "source_name", F.when(F.col("value_num") <= 40, F.col("value_num") * 10).alias("duration"), F.lit("min").alias("duration_unit"))
    spec = Spec(workouts=True, measure="click:average", exclude=("src1",))
    sides = [held.depth(spec, span, rides, record).withColumn("side", F.lit(name)) for name, span in (("first", ("2024-01-01", "2024-01-10")), ("second", ("2024-01-11", "2024-12-31")))]
    return flat(sides[0].unionByName(sides[1]))
