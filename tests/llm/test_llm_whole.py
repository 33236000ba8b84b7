"""Cases in which an operator once did less than its whole job."""

import re

import numpy as np

from vitalspan.llm import html_extract, mixing, winnow


def test_quotas_by_highest_quotients():
    rng = np.random.default_rng(10)
    for _ in range(300):
        words = rng.integers(0, int(rng.choice([8, 300, 90_000])), int(rng.integers(1, 9))).tolist()
        target = float(rng.random() * 2 * sum(words)) if rng.random() < 0.8 else 2.0 * sum(words)
        got, wanted = mixing.quotas(words, target).tolist(), int(target + 0.5)
        given, blocks = [0] * len(words), [0] * len(words)
        while sum(given) < wanted:  # the definition, block by block
            i = max((i for i in range(len(words)) if given[i] < 2 * words[i]), key=lambda i: (words[i] / (2 * blocks[i] + 1), -i))
            given[i] += min(mixing.BLOCK, wanted - sum(given), 2 * words[i] - given[i])
            blocks[i] += 1
        assert sum(got) == wanted and all(0 <= g <= 2 * w for g, w in zip(got, words, strict=True))
        assert sum(abs(a - b) for a, b in zip(got, given, strict=True)) <= 2 * mixing.BLOCK and (wanted % mixing.BLOCK or max(given, default=0) >= 2 * min(words) or got == given)


def test_small_sources_are_met(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCUMENTS", 2)  # many shards, each with a target of a few words
    rows = [(i, "w " * 3, "a") for i in range(40)] + [(100, "one two three", "b"), (101, "x", None)] + [(200 + i, "v " * 50, "c") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = {}, {}
    for r in mixing.mix(df).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]], target[r["source"]] = taken.get(r["source"], 0) + r["taken"], r["target"]
    assert taken == {s: int(t + 0.5) for s, t in target.items()} and min(taken.values()) > 0
    out = mixing.mixed_documents(df, mixing.mix(df)).collect()
    assert sum(len(re.findall(r"\S+", r["text"])) for r in out) == sum(taken.values())


def test_house_is_sainte_lague(spark):
    """Seats found by counting, with ties, against highest quotients one by one."""
    rng = np.random.default_rng(16)
    for case in range(6):
        n = int(rng.integers(1, 40))
        votes = [1000.0] * n if case == 0 else rng.choice([3.0, 9.0, 15.0, 30.0, 450.0], n).tolist() if case < 3 else (rng.random(n) * 10 ** rng.uniform(0, 6, n) + 0.01).tolist()
        seats = int(rng.choice([1, 5, 77, 2000]))
        given, order = [0] * n, list(range(n))
        for _ in range(seats):
            i = max(order, key=lambda i: (votes[i] / (2 * given[i] + 1), -i))
            given[i] += 1
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(votes)], "rank long, votes double")
        assert [r["won"] for r in mixing.house(df, seats).orderBy("rank").collect()] == given == mixing.sainte_lague(votes, seats).tolist()
    none = spark.createDataFrame([], "rank long, votes double")
    assert mixing.house(none, 7).count() == 0


def test_blocks_of_all_sources_by_highest_quotients(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "quotas", lambda words, target, cap=2, block=8, quotas=mixing.quotas: quotas(words, target, cap, 8))
    rng = np.random.default_rng(17)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", "c", "d", "e", None, "tiny"][int(rng.choice(7, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.04, 0.01]))]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    target, size, taken = {}, {}, {}
    for r in got:
        target[r["source"]], size[r["source"]] = r["target"], r["source_size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    order = sorted(target, key=lambda s: (s is None, s or ""))
    seat = mixing.seat_words(min(t for t in target.values() if t > 0))
    seats, given = int(sum(target.values()) / seat + 0.5), dict.fromkeys(order, 0)
    for _ in range(seats):
        s = max(order, key=lambda s: (target[s] / (2 * given[s] + 1), -order.index(s)))
        given[s] += 1
    assert len(order) == 7 and taken == {s: min(seat * given[s], 2 * size[s]) for s in order}


def test_seats_fit_the_smallest_target():
    assert [mixing.seat_words(t) for t in (0.0, 3.0, 512.0, 1000.0, 32767.0, 32768.0, 1e12)] == [1, 1, 2, 2, 64, 128, 128]


def test_a_source_of_many_shards():
    """A few arrays of the shards, whatever the words."""
    words = np.random.default_rng(3).integers(0, 2_000_000, 100_000)
    got = mixing.quotas(words, float(words.sum()) * 1.7)
    assert int(got.sum()) == int(float(words.sum()) * 1.7 + 0.5) and (got <= 2 * words).all()
    assert np.abs(got - words * 1.7).max() <= mixing.BLOCK


def test_copies_are_numbered_across_parts(spark):
    rows = [(None, "same words here", None)] * 50 + [(1, "same words here", "a")] * 30 + [(1, "other words", "a")] * 3 + [(None, None, "a")] * 5
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    keys = {}
    for r in got:
        keys.setdefault((r["doc"], r["source"], r["tie"]), []).append(r["copy"])
    assert sorted(map(sorted, keys.values())) == sorted([list(range(1, n + 1)) for n in (50, 30, 3, 5)])


def test_passages_stay_as_they_stand(spark):
    text = "  One two\nthree   four\tfive six\n\nseven eight  "
    mixed = spark.createDataFrame([(1, "a", 0, [(0, 3), (4, 8)], 1), (1, "a", 1, [], 2)], "doc long, source string, rounds int, spans array<struct<start:long,end:long>>, copy long").selectExpr("*", f"xxhash64({text!r}) AS tie", "8L AS size")
    docs = spark.createDataFrame([(1, text, "a")] * 2, "doc_id long, text string, source string")
    out = sorted(r["text"] for r in mixing.mixed_documents(docs, mixed).collect())
    assert out == sorted(["One two\nthree\nfive six\n\nseven eight", text])


STORY = "<p>A first paragraph that is long enough to be read as a sentence by anyone.</p><p>And a second one, which says some more about it all.</p>"
TEXT = "A first paragraph that is long enough to be read as a sentence by anyone.\n\nAnd a second one, which says some more about it all."
ASIDE = '<div class="sidebar"><p>Other stories that you might like to read on this site, all of them good.</p></div>'


def test_wrappers_named_after_what_stands_beside_the_text():
    for wrapper in ("layout has-sidebar", "with-header search-page", "widget-area share"):
        for body in ("article", "main"):
            assert html_extract.main_text(f'<div class="{wrapper}"><div id="header-fixed"><{body}>{STORY}</{body}></div>{ASIDE}</div>') == TEXT
    assert html_extract.main_text(f'<div class="has-sidebar"><article>{STORY}<div class="ad">{STORY}</div></article></div>') == TEXT
    # What is beside the story stays out: articles in a sidebar, comments of a story without an article element, what is hidden.
    teaser = "<article><p>Another story that you might like to read on this site, one of the best.</p></article>"
    for page in (f"<article>{STORY}</article><div class='related'>{teaser}{teaser}</div>", f"<div>{STORY}</div><div class='sidebar'>{teaser}</div>", f"<div>{STORY}</div><section id='comments'><article class='comment'>{STORY * 4}</article></section>", f"<article>{STORY}</article><div hidden><article>{STORY}</article></div>"):
        assert html_extract.main_text(page) == TEXT


def test_short_edited_texts_stay_near():
    rng = np.random.default_rng(11)
    for n in range(31, 80):  # three quarters are 23 code points or more
        for _ in range(20):
            own, other = (rng.integers(97, 123, n).astype("<u4") for _ in range(2))
            edited = np.concatenate((own[: n - n // 4], other[: n // 4]))
            assert winnow.likeness(*(np.unique(winnow.winnow(x)[0]) for x in (own, edited))) > 0
