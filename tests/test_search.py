"""The lasting keyword index against BM25 over all texts, and the store of vectors."""

import random

import pytest
from pyspark.sql import functions as F

from vitalspan.catalog import Catalog
from vitalspan.search import keyword, segments, vectors


def texts_of(rng, n):
    words = ["sleep", "sleeping", "heart", "rates", "running", "glucose", "the", "of"] + [f"word{i}" for i in range(40)]
    return [" ".join(rng.choices(words, weights=[3, 2, 2, 2, 1, 1, 30, 30] + [1] * 40, k=rng.randrange(1, 40))) for _ in range(n)]


QUERIES = ["sleep", "the", "the sleep", "running hearts rates", "glucose glucose of", "nowhere", "word3 word7 word9", "sleep nowhere"]


def same(index, chunk, query, k, among=None):
    want = keyword.bm25(*keyword.build_index(chunk.fillna("")), query, k, among=among).collect()
    got = index.search(query, k, among).collect()
    assert [(r["id"], pytest.approx(r["score"], rel=1e-9)) for r in want] == [(r["id"], r["score"]) for r in got]


def test_segments_are_bm25(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 4)
    monkeypatch.setattr(segments, "LIST_TEXTS", 100)
    rng = random.Random(6)
    rows = [*enumerate(texts_of(rng, 220)), (1000, ""), (1001, None)]
    make = lambda r: spark.createDataFrame(r, "id long, text string")
    index = segments.KeywordIndex(spark, str(tmp_path / "k"))
    assert index.search("sleep").count() == 0
    assert index.sync(make(rows[:120])) == {"removed": 0, "added": 120}
    assert index.sync(make(rows)) == {"removed": 0, "added": 102} and index.sync(make(rows)) == {"removed": 0, "added": 0}
    for query in QUERIES:
        same(index, make(rows), query, 5)
    same(index, make(rows), "sleep the", 3, make(rows[50:60]).select("id"))
    # Texts go: counts, lengths and scores are those of the others.
    left = [r for r in rows if r[0] % 3]
    assert index.sync(make(left))["removed"] == len(rows) - len(left)
    for query in QUERIES[:4]:
        same(index, make(left), query, 5)
    index.merge()
    assert index.tables.table("gone").isEmpty() and index.tables.table("word").select("segment").distinct().count() == 1
    same(index, make(left), "the sleep", 7)
    assert segments.KeywordIndex(spark, str(tmp_path / "k")).search("sleep", 1).count() == 1


def test_postings_read_fall_with_k(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK", 16)
    rng = random.Random(7)
    chunk = spark.createDataFrame(list(enumerate(texts_of(rng, 3000))), "id long, text string")
    index = segments.KeywordIndex(spark, str(tmp_path / "k"))
    index.sync(chunk)
    read = [index.explained("sleep", k)[1] for k in (1, 20, 3000)]
    assert read[0]["postings"] == read[1]["postings"] > 1000 and 0 < read[0]["read"] < read[1]["read"] < read[2]["read"] == read[2]["postings"]
    assert read[0]["read"] * 5 < read[0]["postings"]
    both = index.explained("glucose the", 1)[1]
    assert both["read"] < both["postings"]
    same(index, chunk, "sleep", 20)


def test_texts_are_split_once_for_what_is_asked(spark):
    """Without a stemmer no text is split for a list of distinct words, nor to ask whether it has words at all."""
    chunk = spark.createDataFrame([(1, "alpha beta alpha"), (2, "Bêta gamma"), (3, ""), (4, None)], "id long, text string")
    postings, lengths = keyword.build_index(chunk, None)
    assert sorted((r["term"], r["id"], r["tf"], r["length"]) for r in postings.collect()) == [("alpha", 1, 2, 3), ("beta", 1, 1, 3), ("beta", 2, 1, 2), ("gamma", 2, 1, 2)]
    stemmed = keyword.build_index(spark.createDataFrame([(1, "cats cat running")], "id long, text string"))[0]
    assert sorted((r["term"], r["tf"], r["length"]) for r in stemmed.collect()) == [("cat", 2, 3), ("run", 1, 3)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(postings).count("regexp_extract_all") == 1
    assert plan(keyword.bm25(postings, lengths, "alpha beta", 5, None)).count("regexp_extract_all") == 4  # postings, their counts by word, lengths and their mean


def test_blocks_are_made_once(spark, tmp_path, monkeypatch):
    """Blocks are read back from where they were laid down, and nothing of that stays."""
    made = []
    append = Catalog.append
    monkeypatch.setattr(Catalog, "append", lambda self, name, rows: (made.append((name, rows._jdf.queryExecution().optimizedPlan().toString())), append(self, name, rows))[1])
    index = segments.KeywordIndex(spark, str(tmp_path / "k"), None)
    index.sync(spark.createDataFrame(list(enumerate(texts_of(random.Random(8), 50))), "id long, text string"))
    plan = next(p for name, p in made if name == "block")
    assert "Window" not in plan and "Generate" not in plan and not list((tmp_path / "k").glob(".scratch*"))


def test_texts_are_split_once_for_a_segment(spark, tmp_path):
    """Lengths and postings come from one pass over new texts, and texts that are held aren't looked at again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(i):
        seen.add(1)
        return f"alpha beta{i} alpha"

    index = segments.KeywordIndex(spark, str(tmp_path / "k"), None)
    chunk = lambda n: spark.range(0, n, 1, 3).select("id", text("id").alias("text"))
    assert index.sync(chunk(40))["added"] == 40 and seen.value == 40
    assert {(r["term"], r["df"]) for r in index.tables.table("word").filter("term IN ('alpha', 'beta7')").collect()} == {("alpha", 40), ("beta7", 1)}


def test_words_of_segments_are_those_of_texts(spark, tmp_path, monkeypatch):
    """Whatever the letters, however the texts are grouped, in several parts, with an id twice, and after texts went."""
    monkeypatch.setattr(segments, "BLOCK", 3)
    monkeypatch.setattr(segments, "LIST_TEXTS", 7)
    monkeypatch.setattr(segments, "TEXTS", 150)
    odd = ["", None, "  ", "a", "A-b_c", "Žluťoučký kůň, ﬁne", "ΣΊΣΥΦΟΣ x\u0301y ά", "İstanbul\tI\u0130", "naïve—naive “q”", "日本語 テキスト\u3000ab", "x٣٤y ²½ Ⅷ", "\U0001d504b \U0001f600c", "e\u0301te\u0301 K", "a\u00a0b\u200bc", "end", "end"]
    rows = [(i, x) for i, x in enumerate(odd * 3 + [" ".join(["long", f"w{i}"] * 40) for i in range(9)])]
    make = lambda r: spark.createDataFrame(r, "id long, text string")
    found = lambda index: sorted((r["term"], r["id"], r["tf"], r["length"]) for r in index._live(index.tables.table("block").select("term", F.explode("entries").alias("e")).select("term", "e.*")).collect())

    def held(index, r):
        postings, lengths = keyword.build_index(make(r).fillna(""), index.stem)
        assert found(index) == sorted((x["term"], x["id"], x["tf"], x["length"]) for x in postings.collect())
        assert sorted(map(tuple, index.tables.table("text").collect())) == sorted(map(tuple, lengths.collect()))
        counts = index.tables.table("word").groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, postings.groupBy("term").count().collect()))

    for stem in (None, keyword.porter):
        index = segments.KeywordIndex(spark, str(tmp_path / f"k{stem is None}"), stem)
        index.sync(make(rows[:30]))
        held(index, rows[:30])
        index.sync(make(rows[5:]))
        held(index, rows[5:])
        index.tables.set_fact("parts-0", "0")  # as a segment of before has it
        index.sync(make(rows[9:40]))
        held(index, rows[9:40])
        index.merge()
        held(index, rows[9:40])
    twice = segments.KeywordIndex(spark, str(tmp_path / "t"), None)
    twice.sync(make([(1, "a b a"), (2, "b"), (1, "a c c c"), (3, "a")]))
    assert found(twice) == [("a", 1, 3, 4), ("a", 3, 1, 1), ("b", 1, 1, 3), ("b", 2, 1, 1), ("c", 1, 3, 4)]
    ids = spark.range(-500, 500).select("id", F.pmod(F.xxhash64("id"), F.lit(7)).alias("part")).toPandas()
    assert segments._part_of(ids["id"].to_numpy(), 7).tolist() == ids["part"].tolist()


def test_vector_store(spark, tmp_path):
    index = Catalog.open(spark, str(tmp_path / "i"), create=True)
    index.write("chunk", spark.createDataFrame([(i, 7, f"alpha {i}") for i in range(50)], "id long, document_id long, text string"))
    store, embedder = vectors.VectorStore(index), vectors.HashingEmbedder(16)
    assert store.count() == 0 and store.sync(embedder) == {"embedded": 50, "reclaimed": 0} and store.sync(embedder) == {"embedded": 0, "reclaimed": 0}
    assert vectors.pending(index.table("chunk"), embedder.name).isEmpty() and {r["document_id"] for r in store.rows().collect()} == {7}
    files = {f for f in (tmp_path / "i").glob("vector-*/*.parquet")}
    assert store.delete(spark.createDataFrame([(3,), (4,), (99,)], "chunk_id long")) == 2 and store.count() == 48
    assert files <= set((tmp_path / "i").glob("vector-*/*.parquet"))
    index.write("chunk", index.table("chunk").filter("id < 40"))
    assert store.sync(embedder) == {"embedded": 0, "reclaimed": 10} and store.chunk_ids().count() == 38
    found = store.search(embedder.embed(["alpha 7"])[0], embedder.name, 1).first()
    assert found["chunk_id"] == 7 and found["score"] == pytest.approx(1, abs=1e-6)
    other = vectors.HashingEmbedder(8)
    assert store.sync(other)["embedded"] == 40 and store.count() == 78 and store.search(other.embed(["alpha 7"])[0], other.name, 3).count() == 3
    store.drop()
    assert store.count() == 0
