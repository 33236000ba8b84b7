"""Research articles: MEDLINE XML and pack files."""

from __future__ import annotations

import gzip
import hashlib
import json
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.functions.exprs import evidence
from vitalspan.sources.streams import located, staged

TEXT = "struct<_VALUE:string,_Label:string>"
SCHEMA = f"""MedlineCitation struct<
    PMID:struct<_VALUE:string>,
    Article:struct<Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,ArticleTitle:string,
                   Abstract:struct<AbstractText:array<{TEXT}>>,PublicationTypeList:struct<PublicationType:array<struct<_VALUE:string>>>>,
    MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string,_MajorTopicYN:string>>>>,
    CommentsCorrectionsList:struct<CommentsCorrections:array<struct<_RefType:string,RefSource:string>>>>,
  PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"""
FORMAT = 1
#: The longest manifest; bytes of a piece of a pack.
MANIFEST, PIECE = 16 << 20, 1 << 20
#: The lists of an article in a pack, and its other fields.
LISTS = ("publication_types", "mesh_terms", "major_terms")
FIELDS = {"pmid": "string", "title": "string", "abstract": "string", "doi": "string", "journal": "string", "pub_year": "int", **{c: "array<string>" for c in LISTS}, "evidence_tier": "string", "evidence_rank": "int", "tier_source": "string", "retracted": "boolean", "retraction_note": "string"}


class PackError(ValueError):
    """A pack that can't be trusted."""


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles with an identifier, in the fields of a pack; sections of an abstract keep their labels."""
    raw = spark.read.format("xml").option("rowTag", "PubmedArticle").option("valueTag", "_VALUE").schema(SCHEMA).load(path)
    a, c = F.col("MedlineCitation.Article"), F.col("MedlineCitation")
    parts = F.filter(a["Abstract"]["AbstractText"], lambda t: _filled(t["_VALUE"]).isNotNull())
    labelled = F.transform(parts, lambda t: F.concat(F.coalesce(F.concat(_filled(t["_Label"]), F.lit(": ")), F.lit("")), F.trim(t["_VALUE"])))
    types = F.filter(F.transform(a["PublicationTypeList"]["PublicationType"], lambda t: _filled(t["_VALUE"])), lambda t: t.isNotNull())
    mesh = F.filter(F.transform(c["MeshHeadingList"]["MeshHeading"], lambda m: F.struct(_filled(m["DescriptorName"]["_VALUE"]).alias("term"), m["DescriptorName"]["_MajorTopicYN"].alias("major"))), lambda m: m["term"].isNotNull())
    pub = a["Journal"]["JournalIssue"]["PubDate"]
    year = lambda t: F.when(F.trim(t).rlike(r"^\d{4}"), F.substring(F.trim(t), 1, 4).try_cast("int"))
    notices = F.filter(c["CommentsCorrectionsList"]["CommentsCorrections"], lambda n: n["_RefType"] == "RetractionIn")
    retracted = F.coalesce(F.size(notices) > 0, F.lit(False))
    dois = F.filter(F.col("PubmedData.ArticleIdList.ArticleId"), lambda i: i["_IdType"] == "doi")
    none = F.array().cast("array<string>")
    out = raw.select(
        _filled(c["PMID"]["_VALUE"]).alias("pmid"), F.coalesce(_filled(a["ArticleTitle"]), F.lit("(untitled)")).alias("title"), F.coalesce(F.array_join(labelled, "\n\n"), F.lit("")).alias("abstract"),
        _filled(F.try_element_at(dois, F.lit(-1))["_VALUE"]).alias("doi"), _filled(a["Journal"]["Title"]).alias("journal"), F.coalesce(year(pub["Year"]), year(pub["MedlineDate"])).alias("pub_year"),
        F.coalesce(types, none).alias("publication_types"), F.coalesce(F.transform(mesh, lambda m: m["term"]), none).alias("mesh_terms"),
        F.coalesce(F.transform(F.filter(mesh, lambda m: F.upper(F.trim(m["major"])) == "Y"), lambda m: m["term"]), none).alias("major_terms"),
        retracted.alias("retracted"), F.when(retracted, F.coalesce(_filled(F.try_element_at(notices, F.lit(1))["RefSource"]), F.lit("retraction recorded, source not stated"))).alias("retraction_note"),
        a.isNotNull().alias("_has"),
    )
    ranked = out.filter("pmid IS NOT NULL AND _has").withColumn("e", evidence("publication_types"))
    return ranked.select(*[c if c in out.columns else {"evidence_tier": F.col("e.tier"), "evidence_rank": F.col("e.rank"), "tier_source": F.col("e.source")}[c].alias(c) for c in FIELDS])


def write_pack(path: str, manifest: dict, rows: list[dict]) -> dict:
    """A gzipped manifest line and a line for each article; the digest covers the articles."""
    body = "".join(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in rows)
    full = manifest | {"format": FORMAT, "article_count": len(rows), "sha256_of_articles": hashlib.sha256(body.encode()).hexdigest()}
    with gzip.open(path, "wt", encoding="utf-8", newline="\n") as f:
        f.write(json.dumps(full, sort_keys=True) + "\n" + body)
    return full


def _manifest(path: str) -> dict:
    """The first line of a pack: all that the driver reads of it."""
    store, name = located(path)
    line = b""
    try:
        with store.open_input_stream(name, compression="gzip") as stream:
            while b"\n" not in line and len(line) < MANIFEST and (piece := stream.read(1 << 16)):
                line += piece
        manifest = json.loads(line.split(b"\n", 1)[0])
    except (ValueError, OSError) as e:
        raise PackError(f"{path}: the first line is no manifest") from e
    if not isinstance(manifest, dict) or manifest.get("format") != FORMAT:
        raise PackError(f"{path}: format {manifest.get('format') if isinstance(manifest, dict) else None!r}, not {FORMAT}")
    return manifest


def pack_lines(path: str) -> Iterator[tuple[int, str | None, str | None]]:
    """(place, line, None) of the articles of a pack in order, and at the end (how many, None, digest of all, or what is damaged).

    One stream, in pieces: the digest runs along with it, and no more than a piece and a line are held."""
    store, name = located(path)
    running, rest, place, first = hashlib.sha256(), b"", 0, True
    try:
        with store.open_input_stream(name, compression="gzip") as stream:
            while piece := stream.read(PIECE):
                *lines, rest = (rest + piece).split(b"\n")
                for line in lines:
                    if first:  # the manifest
                        first = False
                        continue
                    running.update(line + b"\n")
                    if line:
                        yield place, line.decode(), None
                        place += 1
            if not first:
                running.update(rest)
            if rest:
                yield place, rest.decode(), None
                place += 1
    except (OSError, ValueError) as e:
        yield place, None, f"damaged: {type(e).__name__}"
        return
    yield place, None, running.hexdigest()


def read_pack(spark: SparkSession, path: str, folder: str | None = None) -> tuple[dict, DataFrame]:
    """(manifest, articles). Nothing of a pack is returned that doesn't match its digest and count; lines end at \\n only, and
    a field that is missing takes its default.

    A gzip stream is read by one task, which passes its lines on in order and their digest after them; all of that is written
    (below `folder`, or as `streams.staged` does), and rows are parsed from there, in parallel, once the digest has matched."""
    manifest = _manifest(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            held: list[tuple] = []
            for row in pack_lines(path):
                held.append(row)
                if len(held) == 500:
                    yield pd.DataFrame(held, columns=["place", "line", "digest"])
                    held = []
            if held:
                yield pd.DataFrame(held, columns=["place", "line", "digest"])

    lines = staged(spark.range(1, numPartitions=1).mapInPandas(run, "place long, line string, digest string"), folder)
    count, digest = lines.filter("digest IS NOT NULL").select("place", "digest").first()
    if digest != manifest.get("sha256_of_articles"):
        raise PackError(f"{path}: the articles don't match the manifest's digest" + (f" ({digest})" if digest.startswith("damaged") else ""))
    if count != manifest.get("article_count"):
        raise PackError(f"{path}: {count} articles, not {manifest.get('article_count')}")
    schema = ", ".join(f"{c} {t}" for c, t in FIELDS.items())
    parallel = lines.filter("line IS NOT NULL").select("line")
    parsed = parallel.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("a")).select("a.*")
    return manifest, parsed.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in LISTS} | {"retracted": F.coalesce("retracted", F.lit(False)), "abstract": F.coalesce("abstract", F.lit(""))})


def month_slices(start: str, end: str) -> list[tuple[str, str]]:
    """The months of a range, cut to it: what a search is divided into where it finds more than a page limit."""
    first, last, out = date.fromisoformat(start), date.fromisoformat(end), []
    while first <= last:
        following = (first.replace(day=28) + timedelta(days=4)).replace(day=1)
        out.append((first.isoformat(), min(last, following - timedelta(days=1)).isoformat()))
        first = following
    return out


def refresh_window(last_run: str | None, built: str, today: str) -> tuple[str, str]:
    """From a day before the last run (or build) to today: what arrived on the day itself isn't missed."""
    since = date.fromisoformat((last_run or built)[:10]) - timedelta(days=1)
    return since.isoformat(), today
