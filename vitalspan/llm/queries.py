"""One query for each operator of this subpackage over the driver's tables, and oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalspan.llm import bpe, html_extract, importance, linededup, mixing, quality, records, secrets, simhash, topk, trie, warc, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    kept = linededup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=10)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return records.read_digest(spark, records.write_records(docs, word_bpe(), end=1))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_likeness(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.selectExpr("doc AS doc_id", "size", "source_size", "target", "taken")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(_table(spark, sf_dir, "documents").select("doc_id", "text"), word_bpe())


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(warc.write_archive(_table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _secrets_sql() -> str:
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    parts = [
        f"""SELECT doc_id, '{r.kind}' AS kind, {i} AS pos, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
              's': list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
              'n': length(m[i]), 'c': length(g[i])}})) AS x
            FROM (SELECT doc_id, regexp_extract_all(t, {quoted(r.pattern)}, 0) AS m, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS g,
                         string_split_regex(t, {quoted(r.pattern)}) AS b FROM d)"""
        for i, r in enumerate(secrets.RULES)
    ]
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in secrets.RULES)
    return f"""
      WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
      f AS ({" UNION ALL ".join(parts)}),
      s AS (SELECT doc_id, kind, pos, CAST(x.s AS BIGINT) AS s, CAST(x.s + x.n AS BIGINT) AS e FROM f WHERE x.c >= CASE kind {least} END),
      a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                   count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, pos) AS spans
            FROM s GROUP BY doc_id)
      SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
             sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
      FROM d LEFT JOIN a USING (doc_id)"""


LINE_DEDUP_SQL = r"""
  WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
  k AS (SELECT doc_id, ls, list_transform(ls, lambda x: translate(regexp_replace(regexp_replace(x, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ks FROM l),
  h AS (SELECT k FROM (SELECT DISTINCT doc_id, unnest(ks) AS k FROM k) WHERE length(k) >= 1 GROUP BY k HAVING count(*) >= 10),
  e AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS x, unnest(ks) AS k FROM k),
  j AS (SELECT e.*, h.k IS NOT NULL AS dropped FROM e LEFT JOIN h USING (k))
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
         sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
  FROM j GROUP BY doc_id"""

TOPK_SQL = """
  WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings
             WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
  s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
        FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s QUALIFY rank <= 10"""

#: CRC-32 of a list of bytes `b`, with the table of CTE `crc` beside it.
CRC_TABLE = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, n)) AS tab)"
CRC = "xor(list_reduce({bytes}, lambda a, b: xor(a >> 8, tab[CAST(xor(a, b) & 255 AS BIGINT) + 1]), 4294967295), 4294967295)"

TRIE_SQL = f"""
  WITH {CRC_TABLE},
  g AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k
        FROM conversations WHERE conv_id IS NOT NULL),
  s AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS c, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k) AS t FROM g GROUP BY conv_id),
  h AS (SELECT conv_id, t, {CRC.format(bytes="list_transform(range(1, length(c) + 1), lambda i: CAST(ascii(c[i]) AS BIGINT))")} % 6 AS h FROM s, crc),
  w AS (SELECT a.conv_id, list_concat(coalesce(list_slice(b.t, 1, a.h), []), list_slice(a.t, a.h + 1, len(a.t))) AS t
        FROM h a LEFT JOIN s b ON b.conv_id = a.conv_id - a.conv_id % 100),
  p AS (SELECT conv_id, d, CASE WHEN d = 0 THEN 0 ELSE t[d].n END AS size, sha256(array_to_string(list_transform(t[1:d], lambda z: z.k), '')) AS node, d = len(t) AS last
        FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM w)),
  n AS (SELECT node, d, min(conv_id) AS c, count(*) AS n, max(size) AS size,
               sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends FROM p GROUP BY node, d),
  u AS (SELECT n.*, q.node AS up FROM n LEFT JOIN p q ON q.conv_id = n.c AND q.d = n.d - 1),
  k AS (SELECT up, d - 1 AS d, count(*) AS kids FROM u WHERE d > 0 GROUP BY ALL),
  v AS (SELECT u.*, coalesce(kids, 0) AS kids FROM u LEFT JOIN k ON k.up = u.node AND k.d = u.d),
  t AS (SELECT p.node, p.d, count(*) FILTER (kids = 0) AS leaves, sum((v.n - 1) * v.size) AS saved FROM v JOIN p ON p.conv_id = v.c AND p.d <= v.d GROUP BY ALL)
  SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, w.c AS parent_conv_id, v.n AS n_convs, v.kids AS n_children, t.leaves AS n_leaves,
         CAST(t.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
  FROM v JOIN t ON t.node = v.node AND t.d = v.d LEFT JOIN n w ON w.node = v.up AND w.d = v.d - 1"""

WARC_SQL = """
  WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
  s AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS h FROM p),
  b AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS best FROM s)
  SELECT page_id, payload_bytes,
         array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda i:
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((CAST('0x' || h[5 * g + 1 : 5 * g + 5] AS BIGINT) >> (15 - 5 * i)) & 31)]), '')), '') AS payload_digest,
         CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
  FROM b"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}')"
IMPORTANCE_SQL = f"""
  WITH {CRC_TABLE},
  w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  v AS (SELECT {_WORDS} AS w FROM benchmark),
  f AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM w),
  g AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS x FROM v),
  d AS (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM f UNION SELECT x FROM g)),
  k AS (SELECT x, {CRC.format(bytes="list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))")} % 10000 AS b FROM d, crc),
  s AS (SELECT b, count(*) AS n FROM f JOIN k USING (x) GROUP BY b),
  t AS (SELECT b, count(*) AS n FROM g JOIN k USING (x) GROUP BY b),
  z AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS s, (SELECT coalesce(sum(n), 0) FROM t) AS t),
  a AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (z.s + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * (z.t + 10000)::DOUBLE))) AS BIGINT) AS gain
        FROM s LEFT JOIN t USING (b), z),
  m AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS gain FROM f JOIN k USING (x) JOIN a USING (b) GROUP BY doc_id),
  e AS (SELECT w.doc_id, len(w.w) AS words, coalesce(m.n, 0) AS n_features,
               CASE WHEN m.n IS NULL THEN 0 ELSE CAST((m.gain - ((m.gain % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS weight,
               CAST('0x' || sha256('7:' || w.doc_id)[1:8] AS BIGINT) AS h FROM w LEFT JOIN m USING (doc_id)),
  r AS (SELECT doc_id, words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
  o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM r WHERE words >= 20)
  SELECT r.doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM r LEFT JOIN o USING (doc_id)"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_line_dedup,
        op3_quality,
        op4_token_records,
        op5_exact_topk,
        op6_winnowing,
        op7_simhash,
        op8_html_extraction,
        op9_mixing,
        op10_bpe,
        op11_warc,
        op12_importance,
        op13_prefix_trie,
    )
}
ORACLE_SQL = {"op1_secret_scan": _secrets_sql(), "op2_line_dedup": LINE_DEDUP_SQL, "op5_exact_topk": TOPK_SQL, "op11_warc": WARC_SQL, "op12_importance": IMPORTANCE_SQL, "op13_prefix_trie": TRIE_SQL}
