"""The operators' queries against their oracles on the smallest tables, and what is registered."""

import pytest
from naive_compare import oracle_rows, rows_of, views

import __spark_entry__ as entry
from vitalspan.llm import queries, topk

DATA = "/root/testdata/sf0.001"


def test_registered():
    names = list(entry.queries())
    assert [next(n for n in names if n.startswith(f"op{i}_")) for i in range(1, 14)] and "pipeline" in names


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    assert rows_of(queries.QUERIES[name](spark, DATA)) == oracle_rows(views(DATA), queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    table = "pages" if name.startswith("op8_") else "documents"
    assert queries.QUERIES[name](spark, DATA).count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_exact_topk_over_many_shards(spark, monkeypatch):
    """The registered query with small shards and blocks: the search away from home decides most rows of the oracle."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 2)
    cells, inner = [], topk._cells
    monkeypatch.setattr(topk, "_cells", lambda *a: cells.append(topk.stored(inner(*a), "seen")) or cells[-1])
    assert rows_of(queries.op5_exact_topk(spark, DATA)) == oracle_rows(views(DATA), queries.ORACLE_SQL["op5_exact_topk"])
    home, away = cells
    asked = home.filter("is_query").groupBy("shard").count().collect()
    assert sum(r["count"] for r in asked) == 5  # each query at home once
    copies = home.filter("NOT is_query").groupBy("shard", "row").count().groupBy("shard").agg({"count": "max"}).collect()
    assert {r[0]: r[1] for r in copies} == {r["shard"]: -(-r["count"] // 2) for r in asked}  # a shard once for its own blocks
    assert away.filter("is_query").select("shard").distinct().count() > len(asked)
