"""Commands over an index: what can be asked, as JSON on standard output.

python -m vitalspan.cli --index DIR [--corpus DIR] COMMAND ..."""

from __future__ import annotations

import argparse
import sys

from vitalspan import ingest, report, tools
from vitalspan.catalog import Catalog, CatalogError, NotFound
from vitalspan.operators import documents, labs, series
from vitalspan.session import build_session
from vitalspan.sources import medline


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vitalspan")
    p.add_argument("--index", required=True)
    p.add_argument("--corpus")
    p.add_argument("--master", default="local[*]")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *flags, **options):
        s = sub.add_parser(name)
        for f in flags:
            s.add_argument(f)
        for f, kind in options.items():
            flag = "--" + f.rstrip("_").replace("_", "-")
            s.add_argument(flag, dest=f.rstrip("_"), **({"action": "store_true"} if kind is bool else {"action": "append"} if kind is list else {"type": kind}))
        return s

    add("ingest", "path", force=bool, clinical=str, notes=str, reports=str, skip_clinical=str)
    for name in ("stats", "check", "reset", "embed"):
        add(name)
    add("types", search=str, limit=int)
    add("metric", "name", by=str, agg=str, start=str, end=str, source=str, combine=str)
    add("sleep", start=str, end=str)
    add("workouts", start=str, end=str, activity=str, period=str, measure=list, derive=list, exclude_source=list, indoor=bool, outdoor=bool, detail=bool, limit=int)
    add("compare", metric=str, workouts=bool, activity=str, measure=str, derive=str, anchor=str, anchor_fact=str, before=int, after=int, left=str, right=str, period=str, exclude_source=list, indoor=bool, outdoor=bool)
    add("documents", kind=str)
    add("notes", tag=str, tags=bool)
    add("labs", analyte=list, search=str, start=str, end=str, limit=int)
    add("clinical", kind=str, since=str)
    add("vitals", metric=str, start=str, end=str)
    add("search", "query", limit=int, kind=str)
    add("visit-prep", window=int)
    add("literature", "action", pack=str, query=str, min_tier=str, since=int)
    return p


def _given(args: argparse.Namespace, **names: str) -> dict:
    """Arguments that were given, under a tool's names."""
    return {to: getattr(args, name) for name, to in names.items() if getattr(args, name) not in (None, False)}


def run(args: argparse.Namespace, spark) -> dict | list | str:
    if args.command == "ingest":
        catalog = Catalog.open(spark, args.index, create=True)
        out = {"export": ingest.ingest_export(catalog, args.path, args.force)}
        if args.clinical:
            out["clinical"] = {"/".join(map(str, k)): n for k, n in ingest.ingest_clinical(catalog, args.clinical, args.skip_clinical or "").items()}
        if args.reports:
            out["reports"] = ingest.ingest_reports(catalog, args.reports, force=args.force)
        return out | ({"notes": ingest.ingest_notes(catalog, args.notes)} if args.notes else {})
    if args.command == "reset":
        Catalog(spark, args.index).reset()
        return {"reset": args.index}
    index = Catalog.open_for_read(spark, args.index)
    corpus = _corpus(spark, args)
    ctx = tools.Context(index, corpus)
    ask = lambda name, **a: tools.dispatch(ctx, name, a)
    rows = lambda df: [tools._plain(r) for r in df.collect()]  # noqa: E731  listings of one person's index
    match args.command:
        case "stats":
            return tools.data_inventory(ctx)
        case "check":
            return {t: index.table(t).count() for t in index.schemas} | {"version": index.VERSION["index"]}
        case "types":
            return rows(series.list_types(index.table("daily_metric"), args.search, args.limit or 40))
        case "metric":
            return ask("query_healthkit", metric=args.name, **_given(args, by="period", agg="aggregation", start="start_date", end="end_date", source="source", combine="combine"))
        case "sleep":
            return ask("query_healthkit", metric="sleep", **_given(args, start="start_date", end="end_date"))
        case "workouts":
            where = {"indoor": True} if args.indoor else {"indoor": False} if args.outdoor else {}
            return ask("get_workouts", **where, **_given(args, start="start_date", end="end_date", activity="activity", period="period", measure="measures", derive="derive", exclude_source="exclude_source", detail="detail", limit="limit"))
        case "compare":
            spans = {side: getattr(args, side).split(":") for side in ("left", "right") if getattr(args, side)}
            where = {"indoor": True} if args.indoor else {"indoor": False} if args.outdoor else {}
            return ask("compare_windows", **spans, **where, **_given(args, metric="metric", workouts="workouts", activity="activity", measure="measure", derive="derive", anchor="anchor_date", anchor_fact="anchor_fact", before="before_days", after="after_days", period="period", exclude_source="exclude_source"))
        case "documents":
            return rows(documents.list_documents(*ingest.tables(index, "document", "lab_result", "chunk", "document_tag"), args.kind))
        case "notes":
            document, tag = ingest.tables(index, "document", "document_tag")
            return rows(documents.list_tags(document, tag)) if args.tags else rows(documents.notes_by_tag(document, tag, args.tag)) if args.tag else rows(documents.note_summary(document, tag, index.table("chunk")))
        case "labs":
            if not args.analyte:
                return rows(labs.list_analytes(index.table("lab_result"), args.search, args.limit))
            return ask("get_lab_trend", **({"analyte": args.analyte[0]} if len(args.analyte) == 1 else {"analytes": args.analyte}), **_given(args, start="start_date", end="end_date"))
        case "clinical":
            return ask("get_clinical_history", **_given(args, kind="kind", since="since"))
        case "vitals":
            return ask("get_clinical_vitals", **_given(args, metric="metric", start="start_date", end="end_date"))
        case "search":
            return ask("search_records", query=args.query, **_given(args, limit="limit", kind="kind"))
        case "visit-prep":
            sheet = report.gather(index, args.window or 30)
            return report.render(report.attach_literature(sheet, corpus) if corpus else sheet)
        case "embed":
            from vitalspan.search.vectors import HashingEmbedder, VectorStore

            embedder = HashingEmbedder()
            return VectorStore(index).sync(embedder) | {"embedder": embedder.name}
        case _:
            return _literature(args, spark, ctx)


def _corpus(spark, args: argparse.Namespace) -> Catalog | None:
    """The corpus, made by the commands about it; elsewhere it may be absent."""
    if not args.corpus:
        return None
    try:
        return Catalog.open(spark, args.corpus, "corpus", create=args.command == "literature")
    except NotFound:
        return None


def _literature(args: argparse.Namespace, spark, ctx: tools.Context) -> dict:
    from vitalspan.search import corpus as literature

    corpus = ctx.corpus
    if corpus is None:
        return {"error": "say where the corpus is with --corpus"}
    if args.action == "install":
        manifest, articles = medline.read_pack(spark, args.pack)
        return ingest.install_pack(corpus, manifest["slug"], articles, title=manifest.get("title", ""), version=manifest.get("version", ""))
    if args.action == "build":
        return ingest.install_pack(corpus, "own", medline.articles(spark, args.pack))
    if args.action == "remove":
        ingest.remove_pack(corpus, args.pack)
    if args.action == "search":
        return tools.dispatch(ctx, "search_medical_literature", {"query": args.query or "", **_given(args, min_tier="min_tier", since="since_year")})
    held = {"packs": literature.pack_counts(corpus.table("article_pack")), "topics": literature.topics(corpus.table("mesh_term")), "tiers": literature.tier_histogram(corpus.table("article")), "refreshed": literature.latest_refresh(corpus.table("refresh_log"))}
    return {name: [tools._plain(r) for r in df.collect()] for name, df in held.items()} | {"in_several_packs": literature.in_several_packs(corpus.table("article_pack")).count()}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session("vitalspan", args.master)
    try:
        out = run(args, spark)
    except CatalogError as e:
        print(str(e), file=sys.stderr)
        return 1
    print(out if isinstance(out, str) else tools.serialize(out))
    return int(isinstance(out, dict) and "error" in out)


if __name__ == "__main__":
    sys.exit(main())
