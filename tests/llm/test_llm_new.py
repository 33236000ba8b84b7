"""Archives, importance resampling, the prefix trie, and ids and texts that once were too much."""

import base64
import gzip
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyarrow import fs
from pyspark.sql import functions as F

from vitalspan.llm import common, importance, secrets, trie, warc, winnow

# What several operators share.


def test_numbers_are_dense(spark):
    got = common.numbered(spark.range(100).repartition(7).withColumn("_at", F.lit(1)), "t", "n").collect()
    assert sorted(r["n"] for r in got) == list(range(100)) and {r["_at"] for r in got} == {1}
    assert common.numbered(spark.range(0), "t", "n").count() == 0


def test_hot_keys_are_looked_up_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 4)
    keys = [0] * 60 + [1] * 30 + list(range(2, 12))
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, k long")
    table = spark.createDataFrame([(k, k * 10, keys.count(k)) for k in range(11)], "k long, v long, n long")
    got = sorted((r["i"], r["v"]) for r in common.looked_up(rows, table, ["k"], "n", len(keys)).collect())
    assert got == sorted((i, k * 10) for i, k in enumerate(keys) if k < 11)


def test_ranges_compare_longs(spark):
    keys = [-(2**63), -(2**60) - 1, -1, 0, 2**53, 2**53 + 1, 2**60, 2**60 + 1, 2**63 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for cuts in ([], keys, keys[1:-1:2], [2**60 + 1]):
        assert sorted((r["k"], r["b"]) for r in df.withColumn("b", common.range_of(F.col("k"), cuts)).collect()) == [(k, sum(c <= k for c in cuts)) for k in keys]


# Web archives.


def pages_of(rows, spark):
    return spark.createDataFrame(rows, "page_id long, url string, html string, WARC string")


PAGES = [
    (1, "http://www.Example.com:80/A?b=C", "<p>same</p>", "x"), (2, "https://example.com/a", "<p>same</p>", "x"), (3, None, None, "x"), (4, "", "", None), (None, "http://b.org/\n two", "<p>same</p>", None),
    (5, "http://a.b.example.com/ü", "é" * 5000, None), (5, "http://a.b.example.com/ü", "é" * 5000, None), (6, "not a url", "alone\r\n\r\nx", None), (None, None, None, None), (None, None, None, None), (2, "https://other.net/", "<p>same</p>", "y"),
]


def expected_records(rows, least=0):
    payload = [(h or "").encode() for _, _, h, *_ in rows]
    digest = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payload]
    out, best = [], {}
    rank = lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or "", -i)
    for i, d in enumerate(digest):
        if len(payload[i]) >= least and (d not in best or rank(i) > rank(best[d])):
            best[d] = i
    for i, (page, *_) in enumerate(rows):
        alone = len(payload[i]) < least or best[digest[i]] == i
        out.append((page, len(payload[i]), digest[i], "response" if alone else "revisit", None if alone else rows[best[digest[i]]][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, hot", [(0, 1000), (12, 1000), (0, 3), (12, 3)])
def test_archive_round_trip(spark, monkeypatch, least, hot):
    monkeypatch.setattr(warc, "HOT_KEYS", hot)
    monkeypatch.setattr(warc, "COPIES", 2)
    monkeypatch.setattr(warc, "RUN_ENTRIES", 3)
    made = warc.write_archive(pages_of(PAGES, spark), least_bytes=least, fan_in=2, piece_entries=2)
    assert sorted(map(tuple, warc.archive_digest(made).collect()), key=str) == expected_records(PAGES, least)
    index = made.captures().orderBy("position").collect()
    assert [r["position"] for r in index] == list(range(len(PAGES)))
    keys = [(r["urlkey"], r["time"], r["record"]) for r in index]
    assert keys == sorted(keys)
    read = {(r["page"], r["url"]): bytes(r["payload"]) for r in made.records().collect() if r["kind"] == "response"}
    assert read[(5, "http://a.b.example.com/ü")] == ("é" * 5000).encode() and all("\n" not in (u or "") for _, u in read)


def test_archive_of_nothing_and_others(spark):
    assert warc.archive_digest(warc.write_archive(pages_of([], spark))).count() == 0
    one = warc.write_archive(pages_of([(7, "http://a.org", "x" * 100, None)], spark), time=F.lit(86400))
    row = one.captures().first()
    assert (row["urlkey"], row["time"], row["kind"]) == ("org,a)/", 86400, "response")
    # Any reader of gzip and of the format can read it: members one after the other.
    store, path = fs.FileSystem.from_uri(one.folder)
    with store.open_input_file(f"{path}/{row['archive']}") as f:
        data = f.read()
    whole = gzip.decompress(data)
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and whole.count(b"WARC/1.1\r\n") == 2 and b"WARC-Date: 1970-01-02T00:00:00Z" in whole
    assert gzip.decompress(data[row["start"] : row["start"] + row["length"]]).endswith(b"x" * 100 + b"\r\n\r\n")
    with store.open_output_stream(f"{path}/{row['archive']}", compression=None) as f:
        f.write(data[: row["start"]] + warc.record_of("response", [("WARC-Record-ID", f"<{row['record']}>"), ("WARC-Payload-Digest", "sha1:" + "A" * 32)], b"HTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\ny"))
    with pytest.raises(Exception, match="damaged|Error"):
        one.records().collect()


def test_loser_tree_merges(spark):
    rng = random.Random(3)
    for _ in range(200):
        runs = [sorted((rng.randrange(20), rng.randrange(3)) for _ in range(rng.randrange(8))) for _ in range(rng.randrange(10))]
        assert list(warc.merged([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://www2.Sub.Example.com:8443/Path?Q=1#frag") == "com,example,sub:8443)/path?q=1"
    assert warc.url_key("http://www.org") == "org,www)/" and warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


# Importance resampling.


def naive_importance(docs, target, share=25, least=20, buckets=10000):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    def found(t):
        w = words(t)
        return [zlib.crc32(x.encode()) % buckets for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = [0] * buckets, [0] * buckets
    for texts, counts in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            for b in found(x):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for d, x in docs:
        f = found(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(x))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for i, r in enumerate(able[: share * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_importance_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_WORDS", 50)
    monkeypatch.setattr(importance, "CACHED_WORDS", 40)
    rng = random.Random(5)
    vocabulary = ["The", "über", "x1", "日本語", "a" * 70, "b", "Zz", "end.", "don't", " ", "\x7f"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(45)))) for i in range(150)] + [(None, "one two " * 15), (None, None), (500, ""), (501, "-- !!"), (7, "again " * 25), (2**60, "ümlaut " * 9000)]
    target = [" ".join(rng.choice(vocabulary[:20]) for _ in range(30)) for _ in range(12)] + [None, ""]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, words string").repartition(5)
    got = importance.importance_resample(df, spark.createDataFrame([(t,) for t in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=str) == naive_importance(docs, target)
    none = importance.importance_resample(df.limit(0), spark.createDataFrame([], "text string"))
    assert none.count() == 0 and none.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_equal_rows_are_drawn_one_by_one(spark):
    df = spark.createDataFrame([(1, "w " * 30)] * 8 + [(2, "w")], "doc_id long, text string")
    ranks = [r["rank"] for r in importance.importance_resample(df, df, share=50).collect()]
    assert sorted(r for r in ranks if r) == [1, 2, 3, 4]


def test_pairs_by_moved_checksums():
    known, rng = importance.Words(), random.Random(2)
    words = [bytes(rng.choice(b"abcz09\xc3\xa9") for _ in range(rng.randrange(1, 64))) for _ in range(500)]
    ids = np.array([known[w] for w in words])
    assert known.pairs(ids).tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:], strict=False)]


# Prefix trie.


def naive_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    own = {c: [t[3] for t in sorted(x)] for c, x in turns.items()}
    members, ends = {}, {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - int(math.fmod(c, 100)), [])[:h] + x[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append(c)
        ends.setdefault(tuple(whole), []).append(c)
    out = []
    for node, m in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if not any(len(k) == len(n) + 1 and k[:-1] == n for k in below)]
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), sum(len(n) == len(node) + 1 for n in below), len(leaves), sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations_of(rows, spark):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, name string")


def test_trie_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 5)
    monkeypatch.setattr(trie, "PIECE", 10)
    rng = random.Random(8)
    for longest in (1, 3, 20):
        rows = []
        for c in [*range(0, 30), *range(100, 125), *range(301, 310), -5, 2**60]:
            for i in range(rng.randrange(longest + 1)):
                rows.append((c, rng.choice([i, i, i, None, 0]), rng.choice(["user", "bot", None]), rng.choice(["hi", "é😀", "", None, "long " * 3])))
            rows += [(c, 9, "user", "same")] * rng.randrange(3)
        rows += [(None, 1, "user", "belongs to none"), (7, 1, "a", "bc"), (8, 1, "ab", "c")]
        got = trie.prefix_trie(conversations_of(rows, spark))
        assert sorted(map(tuple, got.collect()), key=str) == naive_trie(rows)


def test_trie_of_turnless_and_none(spark):
    # 103 takes over two turns of a conversation that isn't there, and loses its own: it has none.
    lost = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(lost, 1, "user", "a"), (lost, 2, "bot", "b")]
    got = trie.prefix_trie(conversations_of(rows, spark)).collect()
    assert [tuple(r) for r in got] == naive_trie(rows) == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]
    assert trie.prefix_trie(conversations_of([], spark)).count() == 0


def test_copies_and_a_long_conversation(spark):
    rows = [(100 * i, t, "user", f"turn {t}") for i in range(40) for t in range(3)] + [(9900, t, "user", f"turn {t % 7}") for t in range(130)]
    got = {(r["conv_id"], r["depth"]): r for r in trie.prefix_trie(conversations_of(rows, spark)).collect()}
    assert got[(0, 0)]["n_convs"] == 41 and got[(0, 3)]["n_convs"] == 41 and len(got) == 131 and got[(9900, 130)]["n_leaves"] == 1
    assert got[(0, 0)]["saved_tokens"] == 40 * 18 and got[(0, 3)]["ends_sha256"] == hashlib.sha256(",".join(str(100 * i) for i in range(40)).encode()).hexdigest()


@pytest.mark.parametrize("names", [1, 2, 3, 7, 8, 21])
def test_prefixes_are_named_by_what_they_hold(names):
    turns = [bytes([i % 3]) for i in range(names)]
    found = trie.prefix_names_of(turns)
    assert found == [trie.prefix_names_of(turns[:d])[-1] for d in range(1, names + 1)] and len(set(found)) == names


def test_trie_in_runs_of_runs(spark, monkeypatch):
    # Conversations of up to four rounds, some ending with a run; texts of several turns are alike.
    monkeypatch.setattr(trie, "RUN", 2)
    rows = [(100 * c, t, "user", f"turn {t % 3}{'!' * (t == cut)}") for c, cut in enumerate([99, 3, 4, 8, 15]) for t in range([16, 8, 12, 16, 16][c])]
    rows += [(101, t, "user", f"turn {t}") for t in range(9)] + [(102, 0, None, None)]
    assert sorted(map(tuple, trie.prefix_trie(conversations_of(rows, spark)).collect()), key=str) == naive_trie(rows)


def test_jobs_of_a_trie_dont_grow_with_its_depth(spark):
    # 305 for 130 turns when each round of doubling was a round of joins: what they left filled the driver's memory.
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    assert trie.prefix_trie(conversations_of([(100, t, "user", f"turn {t % 7}") for t in range(130)], spark)).count() == 131
    assert scheduler.numTotalJobs() - before < 80


# Large ids, many matches.


@pytest.mark.parametrize("ids", [[2**60 + i for i in range(600)], [-(2**60) - i for i in range(600)], [2**60 + i // 200 for i in range(600)], [None] * 300 + [2**62 + 3] * 200 + list(range(-50, 50))])
def test_next_documents_of_large_ids(spark, ids):
    rows = [(d, f"{i} " * (1 + i % 9) + "text " * (i % 5)) for i, d in enumerate(ids)]
    random.Random(1).shuffle(rows)
    tie = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))
    expect = []
    for i, (d, t) in enumerate(ordered):
        n = len(t) // 4
        expect.append((str(d), hashlib.sha256((t[: len(t) - n] + ordered[(i + 1) % len(ordered)][1][:n]).encode()).hexdigest()))
    got = winnow.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in got.collect()) == sorted(expect)


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000, 100_000])
def test_spans_of_many_matches(spark, n):
    df = spark.createDataFrame([(1, "é " + "token=abcdef; " * n)], "doc_id long, text string")
    spans = secrets.secret_scan(df).first()["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [(2 + 14 * i, 14 + 14 * i) for i in range(n)]


def test_members_are_gzip():
    headers, block = warc.parse_record(warc.record_of("response", [("A", "b: c")], b"\x00payload\r\n\r\n"))
    assert headers == {"warc-type": "response", "a": "b: c", "content-length": "12"} and block == b"\x00payload\r\n\r\n"
    assert gzip.GzipFile(fileobj=io.BytesIO(warc.record_of("x", [], b""))).read().endswith(b"\r\n\r\n\r\n\r\n")


# Files of other tokenizers.


def test_other_tokenizers_are_left_to_the_library_or_refused(spark):
    import json

    from tokenizers import Tokenizer
    from vitalspan.llm import bpe, queries, records

    with open(queries.word_bpe(), encoding="utf-8") as f:
        spec = json.load(f)
    assert common.is_word_level(spec)
    other = json.loads(json.dumps(spec))
    other["normalizer"]["normalizers"] = other["normalizer"]["normalizers"][:2]  # nothing is lower-cased
    source = json.dumps(other)
    texts = ["AbC", "a. B!", "", "A b\nC. É"]
    library = Tokenizer.from_str(source)
    got = list(records.Encoder(source, 2).encode(iter([t.encode() for t in texts])))
    assert [np.frombuffer(x, "<u2").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    with pytest.raises(ValueError):
        bpe.tokenizer(source)


def test_rows_without_an_id_lose_their_own_lines(spark):
    from vitalspan.llm import linededup

    rows = [(None, f"own {i}\nshared {i % 5}\nx") for i in range(60)] + [(7, "shared 0\nkept"), (7, "shared 1\nx")]
    out = linededup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), threshold=10)
    assert sorted(r["text"] for r in out.collect()) == sorted([f"own {i}" for i in range(60)] + ["kept", ""])


def test_a_worker_gives_back_what_it_took(spark, monkeypatch):
    """Large batches are worked on in parts, and at the end of a task, even one that isn't read to its end, memory goes back."""
    import pyarrow as pa

    from vitalspan.llm import common, simhash

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batches = lambda: iter([pa.record_batch({"x": list(range(n))}) for n in (2500, 0, 1)])
    parts = list(common.pieces(batches(), lambda b: b))
    assert [p.num_rows for p in parts] == [1000, 1000, 500, 1] and [x for p in parts for x in p.column(0).to_pylist()] == [*range(2500), 0] and given == [1]
    some = common.pieces(batches(), lambda b: b)
    next(some)
    some.close()
    assert given == [1, 1]
    docs = spark.range(2500).selectExpr("id AS doc_id", "concat('word ', id % 7, ' of ', id) AS text").coalesce(1)
    got = {r["doc"]: r["fp"] for r in simhash.fingerprinted(docs).collect()}
    assert {d: f % (1 << 64) for d, f in got.items()} == {i: simhash.fingerprint(f"word {i % 7} of {i}") for i in range(2500)}
