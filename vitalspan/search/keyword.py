"""Keyword search: an inverted index in two tables and BM25 over it.

The text stays in the JVM: words are split, folded and counted by built-ins, and only distinct words go through the
stemmer."""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
# Suffixes of the Porter algorithm with what replaces them, by step (2 and 3), and those of step 4.
STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
STEP4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize"


def _pairs(text: str) -> list[tuple[str, str]]:
    return sorted((tuple(p.split(":")) for p in text.split()), key=lambda p: -len(p[0]))


_STEP2, _STEP3, _STEP4 = _pairs(STEP2), _pairs(STEP3), sorted(STEP4.split(), key=len, reverse=True)


def _shape(stem: str) -> str:
    """v and c for the letters; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(stem):
        vowel = ch in "aeiou" or ch == "y" and i > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    """How many times consonants follow vowels."""
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


def porter(word: str) -> str:
    """The stem of an English word by Porter's published algorithm; words of other letters or of two letters stay."""
    w = word
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _shape(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz" and _shape(w)[-1] == "c":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        for end, new in table:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in ("ion", *_STEP4):
        if w.endswith(end) and (end != "ion" or w[-4:-3] in ("s", "t")):
            if _measure(w[: -len(end)]) > 1:
                w = w[: -len(end)]
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short_end(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def words(text: str):
    """Column: the words of a text column, folded to lower case without accents, of which ASCII has none."""
    lower = F.expr(f"lower(`{text}`)")
    plain = F.when(F.octet_length(text) == F.length(text), lower).otherwise(_unaccented(F.regexp_replace(lower, r"\p{M}+", "")))
    return F.regexp_extract_all(plain, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def spaced(chunk: DataFrame, key: str, text: str) -> DataFrame:
    """id, text: the same words; whatever isn't ASCII in a text belongs to one, and any ASCII but letters and digits is between them."""
    lower = chunk.select(F.col(key).cast("long").alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    others = F.regexp_replace(_unaccented(F.regexp_replace("text", r"\p{M}+", "")), r"[^\p{L}\p{N}]+", " ")
    return lower.select("id", F.when(F.octet_length("text") == F.length("text"), F.col("text")).otherwise(others).alias("text"))


@functools.lru_cache(1)
def _accents() -> tuple[str, str]:
    """Every lower-case letter that decomposes into a base letter and marks, and that base letter."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and parts[0].isalpha() and all(unicodedata.combining(x) for x in parts[1:]):
            pairs.append((c, parts[0]))
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def _unaccented(c):
    """Letters with accents as their base letters."""
    return F.translate(c, *_accents())


def _stemmed(terms: DataFrame, stem: Callable[[str], str]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(stem=[stem(w) for w in batch["word"]])

    return terms.mapInPandas(run, "word string, stem string")


def build_index(chunk: DataFrame, stem: Callable[[str], str] | None = porter, key: str = "id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(postings: term, id, tf, length of the text; lengths: id, length). Words are counted within each chunk before anything
    is shuffled. A text is split once for the lengths and once for the postings, with a stemmer once more for the words."""
    split = chunk.select(F.col(key).alias("id"), words(text).alias("w"))
    lengths = split.select("id", F.size("w").alias("length"))
    # The outer kind: before the other one Spark asks whether there are words at all, and splits the text for that again.
    exploded = split.select("id", F.size("w").alias("length"), F.explode_outer("w").alias("word")).filter("word IS NOT NULL")
    counted = exploded.groupBy("word", "id").agg(F.count("*").alias("tf"), F.max("length").alias("length"))
    if stem is None:
        return counted.select(F.col("word").alias("term"), "id", "tf", "length"), lengths
    stems = _stemmed(counted.select("word").distinct(), stem)
    return counted.join(stems, "word").groupBy(F.col("stem").alias("term"), "id").agg(F.sum("tf").alias("tf"), F.max("length").alias("length")), lengths


def query_terms(query: str, stem: Callable[[str], str] | None = porter) -> list[str]:
    """Runs of letters and digits longer than one, any of which may match."""
    found = [t.lower() for t in re.findall("[A-Za-z0-9]+", query) if len(t) > 1]
    return [stem(t) for t in found] if stem else found


def bm25(postings: DataFrame, lengths: DataFrame, query: str, limit: int | None = 5, stem: Callable[[str], str] | None = porter, among: DataFrame | None = None) -> DataFrame:
    """id, score: higher is better, ids settle ties. `among` (id) restricts what may be found before the limit; document
    frequencies and lengths stay those of the whole index."""
    terms = query_terms(query, stem)
    spark: SparkSession = postings.sparkSession
    if not terms:
        return spark.createDataFrame([], f"id {dict(postings.dtypes)['id']}, score double")
    times = F.create_map(*[F.lit(x) for t in dict.fromkeys(terms) for x in (t, terms.count(t))])
    asked = postings.select("term", "id", "tf").filter(F.col("term").isin(*set(terms)))  # pushed down to the postings' files, or to the words of texts
    df = asked.groupBy("term").agg(F.count("*").alias("df"))
    whole = lengths.agg(F.count("*").alias("total"), F.avg("length").alias("mean"))
    idf = F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    held = asked if among is None else asked.join(among.select("id").distinct(), "id", "left_semi")
    scored = held.join(F.broadcast(df), "term").join(F.broadcast(whole)).join(lengths, "id")  # a row for each word asked; one row
    weight = F.when(idf > 0, idf).otherwise(LEAST_IDF) * times[F.col("term")]
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    out = scored.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.desc("score"), "id")
    return out.limit(limit) if limit else out
