"""The pipeline's stages against what their operators decide, on the smallest driver table."""

import hashlib

import pytest

DATA = "/root/testdata/sf0.001"
cp = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark):
    from vitalspan.llm.common import stored

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(stored(stage(spark, out[-1], DATA), "test"))
    return out


def test_columns_and_flow(stages):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[0].count() >= stages[1].count() == stages[2].count() >= stages[3].count() and stages[4].count() == stages[5].count()


def test_decisions_take_effect(spark, stages):
    from tests_llm_naive import deduplicated, naive_fingerprint, naive_groups

    from vitalspan.llm import mixing, quality

    model = quality.fit(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    scorer = quality.Scorer(model)
    kept = {r["doc_id"] for r in stages[0].collect() if scorer.score(r["text"] or "") >= 0.7}
    assert {r["doc_id"] for r in stages[1].collect()} == kept
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert {(str(r["doc_id"]), r["text"]) for r in stages[2].collect()} == {(i, t) for i, _, _, t in deduplicated(rows, 10)}
    rows = sorted((r["doc_id"], r["text"]) for r in stages[2].collect())
    groups = naive_groups([naive_fingerprint(t) for _, t in rows])
    first = {}
    for (i, _), g in zip(rows, groups, strict=True):
        first.setdefault(g, i)
    assert {r["doc_id"] for r in stages[3].collect()} == set(first.values())
    taken = {r["doc"]: r["taken"] for r in mixing.mix(stages[3]).collect()}
    words = {}
    for r in stages[4].collect():
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert words == {i: n for i, n in taken.items() if n}


def test_tokens(stages):
    from tokenizers import Tokenizer

    from vitalspan.llm import queries

    library = Tokenizer.from_file(queries.word_bpe())
    expect = sorted((r["doc_id"], hashlib.sha256(" ".join(map(str, library.encode(r["text"], add_special_tokens=False).ids)).encode()).hexdigest()) for r in stages[4].collect())
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in stages[5].collect()) == expect


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls everywhere, empty and long texts, repeated rows and columns with the operators' own names, through every stage."""
    good = [" ".join(f"word{(i * 7 + j) % 50}" for j in range(60)) + f" ending {i}." for i in range(60)]
    bad = ["$$ %% ## " * 20 + str(i) for i in range(60)]
    rows = [(i, t, "en", f"s{i % 2}" if i % 9 else None, len(t), 1, "x") for i, t in enumerate(good + bad)]
    rows += [(None, good[0], None, None, None, None, None), (None, None, None, None, None, None, None), (200, "", "en", "s0", 0, 2, ""), (201, None, "en", "s1", None, 2, "")]
    rows += [(202, "long word0 word1 " * 30_000, "en", "s0", 5, 1, "x")] + [(203, good[5], "de", "s1", 7, 1, "x")] * 4
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp int, _doc string"
    docs = spark.createDataFrame(rows, schema)
    sf = str(tmp_path)
    spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    from vitalspan.llm.common import stored

    here = docs
    for name, stage in cp.STAGES:
        here = stored(stage(spark, here, sf), "odd")
        assert name == cp.STAGES[-1][0] or here.columns == docs.columns
    assert here.count() > 40 and set(here.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    nothing = docs.limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, nothing, sf).count() == 0
