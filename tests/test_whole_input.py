"""Registered queries read whole tables: against plain Python over every row, without the views' SQL."""

import math
import re
from collections import Counter, defaultdict

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from vitalspan.operators import clinical
from vitalspan.plans import registry
from vitalspan.plans.adapters import spark_view

DATA = "/root/testdata/sf0.001"


def table(name, columns, data=DATA):
    return pq.read_table(f"{data}/{name}.parquet", columns=columns).to_pylist()


def test_chunks_and_tags_of_all_documents(spark):
    docs = {r["doc_id"]: r for r in table("documents", ["doc_id", "text", "source", "lang"])}
    for view in ("v_chunk", "v_tag"):
        assert sorted(r["document_id"] for r in spark_view(spark, DATA, view).select("document_id").collect()) == sorted(docs)
    listed = {r["id"]: (r["chunks"], r["tags"]) for r in registry.QUERIES["documents_list"](spark, DATA).collect()}
    assert listed and listed == {i: (1, d["source"]) for i, d in docs.items() if d["lang"] in ("en", "de", "fr")}
    tags = {r["tag"]: r["n"] for r in registry.QUERIES["tags_list"](spark, DATA).collect()}
    assert tags == Counter(d["source"] for d in docs.values())


def test_bm25_over_all_documents(spark):
    words = {r["doc_id"]: re.findall(r"[^\W_]+", r["text"].lower()) for r in table("documents", ["doc_id", "text"])}
    mean, asked, scores = sum(map(len, words.values())) / len(words), ("thtion", "token", "ledge"), defaultdict(float)
    for term in asked:
        tf = {i: w.count(term) for i, w in words.items() if term in w}
        idf = math.log((len(words) - len(tf) + 0.5) / (len(tf) + 0.5))
        for i, n in tf.items():
            scores[i] += (idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
    expect = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:20]
    got = [(r["id"], r["score"]) for r in registry.QUERIES["bm25_search"](spark, DATA).collect()]
    assert any(i % 2 for i, _ in got)
    assert [i for i, _ in got] == [i for i, _ in expect] and all(abs(a[1] - b[1]) < 1e-3 for a, b in zip(got, expect, strict=True))


def test_lab_signals_of_all_results(spark):
    """Collapsed, then the signals' rules, in plain Python."""
    draws = defaultdict(list)
    for e in table("events", ["event_id", "event_type", "ts", "value", "props"]):
        if e["event_type"] in ("purchase", "signup"):
            k, v = int(re.search("[0-9]+", e["props"])[0]), float(math.floor(abs(e["value"]) + 0.5) * (1 if e["value"] >= 0 else -1))
            flag = k % 11 in (0, 1)
            rank = (k % 3 != 0, k % 5 == 0, e["event_type"] != "purchase", e["event_id"])
            draws[f"a{k % 10}", e["ts"].date(), v].append((rank, e["event_id"], e["event_type"], flag or not 20 <= v <= 80))
    dates = defaultdict(lambda: defaultdict(list))
    for (key, date, v), rows in draws.items():
        per_source = Counter(r[2] for r in rows)
        for _, i, _, out in sorted(rows)[: max(per_source.values()) if len(per_source) > 1 else None]:
            dates[key][date].append((i, v, out))
    expect = set()
    for key, by in dates.items():
        *earlier, last = sorted(by)
        (_, v, out), pd = max(by[last]), earlier[-1] if earlier else None
        pv = max(by[pd])[1] if pd else None
        was_out = next(((d, max(r for r in by[d] if r[2])) for d in reversed(earlier) if any(r[2] for r in by[d])), None)
        near = pv is not None and (80 - v <= 6 and v > pv or v - 20 <= 6 and v < pv)
        kind = "disagree" if len({r[1] for r in by[last]}) > 1 else "out" if out else "returned" if was_out else "near" if near else None
        kind, of = {"disagree": ("lab_sources_disagree", None), "out": ("lab_out_of_range", (pd, pv)), "returned": ("lab_returned_to_range", was_out and (was_out[0], was_out[1][1])), "near": ("lab_near_limit", (pd, pv)), None: (None, None)}[kind]
        if kind:
            expect.add((key, kind, last.isoformat(), v, of[0].isoformat() if of and of[0] else None, of[1] if of else None))
    got = {(r["analyte_key"], r["kind"], r["latest_date"], round(r["latest"], 4), r["previous_date"], None if r["previous"] is None else round(r["previous"], 4)) for r in registry.QUERIES["lab_signals"](spark, DATA).collect()}
    assert got == expect


def test_facts_of_all_customers(spark):
    data = "/root/testdata/sf0.01"
    customers = {r["c_custkey"]: r["c_acctbal"] for r in table("customer", ["c_custkey", "c_acctbal"], data)}
    assert len(customers) > 900
    assert {r["kind"]: r["n"] for r in registry.QUERIES["fact_coverage"](spark, data).collect()} == Counter(("condition", "medication", "allergy", "immunization", "procedure")[k % 5] for k in customers)
    held = {r["dedup_key"]: (r["status"], r["document_id"]) for r in registry.QUERIES["upsert_status"](spark, data).collect()}
    assert held == {f"key{k}": ("active", k if k % 2 or b >= 0 else k + 1000) if k % 2 == 0 or b >= 0 else ("inactive", k) for k, b in customers.items()}
    # A fact whose document does not exist is left out by the join.
    documents = {r["doc_id"] for r in table("documents", ["doc_id"], data)}
    cited = {r["citation"] for r in registry.QUERIES["clinical_facts"](spark, data).collect()}
    assert len(documents) < max(customers)
    assert cited == {f"/docs/{k}" for k in customers if k % 5 == 0 and k in documents and (k % 4 == 0 or 10 + k % 10 >= 15)}


def test_vitals_without_a_limit(spark):
    vital = spark.range(250).select(F.lit(1).alias("document_id"), F.lit("m").alias("metric_key"), F.lit("2024-01-01").alias("local_date"), F.col("id").cast("string").alias("measured_at"))
    document = spark.range(1, 2).select("id", F.lit("/a").alias("path"))
    assert clinical.clinical_vitals(vital, document, limit=None).count() == 250 and clinical.clinical_vitals(vital, document).count() == 200
    assert "Limit" not in registry.QUERIES["clinical_vitals"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
