"""Command line: mirror a folder of HTML, plan its structure, search, check and relink what was mirrored."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions.media import INLINE_PIXELS, from_yaml
from inkloom.functions.predicates import asset_path
from inkloom.operators import rewrite
from inkloom.operators.catalog import document_roots, folder_index, link_path_map, resolve_links, search, sync_report
from inkloom.operators.structure import catalog_summary, folders_to_refresh, stale_paths
from inkloom.session import build_session, drop_stored, read_if_there, ship, store
from inkloom.sources.export import append_history, delete_pages, write_catalog, write_folder_indexes, write_pages, write_root_markers
from inkloom.sources.assets import materialise
from inkloom.sources.local import crawl_local

HOST = "https://localhost/"
TABLES = ("pages", "links", "assets", "issues", "structure", "summary", "sync", "sync_history")


def verify(pages: DataFrame, links: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: placeholders, errors, unresolved links, and a status by precedence."""
    counts = [
        pages.agg(F.count_if(F.col("placeholder")).alias("placeholders")), issues.agg(F.count_if(F.col("severity") == "error").alias("errors")), links.agg(F.count_if(F.col("kind") == "internal_unresolved").alias("unresolved"))
    ]
    row = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # single rows
    return row.withColumn("status", F.when(F.col("placeholders") > 0, "needs_mirror").when(F.col("errors") > 0, "errors").when(F.col("unresolved") > 0, "link_leaks").otherwise("ok"))


def catalog_items(text: str, root: str) -> list[dict]:
    """The rows under the root key of a catalog that was written as YAML."""
    found = from_yaml(text)
    rows = found.get(root) if isinstance(found, dict) else None
    return [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []


def _crawled(spark: SparkSession, source: str, max_depth: int, max_pages: int) -> tuple[DataFrame, DataFrame]:
    """Pages with their address, file and digest, in the state in which the catalog holds them; and the issues."""
    pages, issues = crawl_local(spark, source, max_depth, max_pages)
    pages = pages.withColumn("source_path", F.col("path")).withColumns({"url": F.concat(F.lit(HOST), "path"), "path": F.regexp_replace("path", r"(?i)\.x?html?$", ".md"), "placeholder": F.lit(False), "ord": F.col("seq")})
    return pages, issues


def _digest(text: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def mirror(spark: SparkSession, source: str, output: str, max_depth: int, max_pages: int) -> int:
    """Crawl, rewrite links, write page files, folder indexes and catalogs, delete what went stale; the number of pages."""
    catalog = f"{output.rstrip('/')}/_catalog"
    pages, issues = _crawled(spark, source, max_depth, max_pages)
    pages = store(pages)
    named = pages.select("url", F.col("source_path").alias("page"), "path", F.explode("assets").alias("a")).select("url", "page", "a.source", "a.kind", "a.alt", asset_path(F.col("path"), F.col("a.source")).alias("target"))
    assets = store(materialise(named, source, output))
    issues = issues.unionByName(assets.where("problem is not null").select(F.lit("warning").alias("severity"), F.col("problem").alias("kind"), F.col("source").alias("message"), F.col("url").alias("path")))
    pages = store(_rewritten(pages, assets))
    previous = read_if_there(spark, f"{catalog}/pages.parquet")
    before = pages.limit(0) if previous is None else store(previous)  # read before it is overwritten
    report = store(sync_report(before, pages, "path", "content_hash"))
    append_history(report.groupBy("status").count(), catalog)
    write_catalog(report, catalog, "sync")
    links = pages.select(F.col("url").alias("src"), F.explode("links_internal").alias("to")).select("src", F.concat(F.lit(HOST), "to").alias("dst"))
    kinds = store(resolve_links(links, pages))
    for name, rows in (("links", kinds), ("issues", issues), ("assets", assets.drop("problem")), ("summary", catalog_summary(pages, kinds, assets, issues))):
        write_catalog(rows, catalog, name)
    delete_pages(stale_paths(before.select("url", "path", "ord"), pages.select("url", "path")), output)
    written = write_pages(pages.select("path", "title", "url", "depth", "content_hash", "markdown"), output)
    index = folder_index(pages.select("path", "title", "ord"))
    write_folder_indexes(index.join(folders_to_refresh(index.select(F.col("path").alias("folder")), None), F.col("path") == F.col("folder"), "left_semi"), output)
    write_root_markers(document_roots(pages), output)
    write_catalog(pages, catalog, "pages")
    return written


def _rewritten(pages: DataFrame, assets: DataFrame) -> DataFrame:
    """The pages with links to one another and to assets made relative, and the digests of the texts as they are written."""
    bare = pages.drop("path", "assets")
    done = rewrite.rewrite_links(bare, pages.select("url", "path"), assets, image_limit=INLINE_PIXELS)
    return done.withColumn("markdown", F.col("rewritten")).drop("rewritten").withColumn("content_hash", _digest("markdown"))


def structure(spark: SparkSession, source: str, output: str, max_depth: int, max_pages: int) -> int:
    """The plan of a mirror without its texts; the number of entries.  Issues are written only if there are some."""
    catalog = f"{output.rstrip('/')}/_catalog"
    pages, issues = _crawled(spark, source, max_depth, max_pages)
    entries = store(pages.select("url", "title", "depth", F.array("title").alias("nav_path"), F.when(F.col("parent").isNotNull(), F.concat(F.lit(HOST), "parent")).alias("parent"), F.col("url").alias("fetch_url"), "path", "ord", F.lit(True).alias("placeholder")))
    write_catalog(entries, catalog, "structure")
    issues = store(issues)
    if not issues.isEmpty():
        write_catalog(issues, catalog, "issues")
    return entries.count()


def relink(spark: SparkSession, output: str, prefix: str = "", dry_run: bool = False) -> dict:
    """Rewrite the links of mirrored pages again, all or those below a path; counts of changed, unchanged and skipped pages."""
    catalog = f"{output.rstrip('/')}/_catalog"
    pages = read_if_there(spark, f"{catalog}/pages.parquet")
    if pages is None:
        raise FileNotFoundError(f"no catalog in {catalog}")
    pages = store(pages)
    planned = read_if_there(spark, f"{catalog}/structure.parquet")
    planned = pages.select("url", "path", "ord").limit(0) if planned is None else planned
    asked = pages.where((F.col("path") == prefix) | F.startswith("path", F.lit(prefix.rstrip("/") + "/"))) if prefix and prefix != "." else pages
    paths = store(link_path_map(planned, pages))
    done = store(rewrite.rewrite_links(asked.drop("path"), paths))
    counts = rewrite.relink_counts(done).first().asDict()
    if not dry_run:
        changed = done.where(F.rtrim("markdown") != F.rtrim("rewritten")).select("url", "rewritten")
        merged = store(pages.join(changed, "url", "left").withColumn("markdown", F.coalesce("rewritten", "markdown")).withColumn("content_hash", _digest("markdown")))
        write_pages(merged.where("rewritten is not null").select("path", "title", "url", "depth", "content_hash", "markdown"), output)
        report = sync_report(pages, merged, "path", "content_hash")
        append_history(report.groupBy("status").count(), catalog)
        write_catalog(report, catalog, "sync")
        entries = rewrite.link_entries(done, paths)
        earlier = read_if_there(spark, f"{catalog}/link_entries.parquet")
        if prefix and earlier is not None:  # entries of pages that weren't asked for stay
            entries = store(earlier.join(done.select(F.col("path").alias("from_path")).distinct(), "from_path", "left_anti").unionByName(entries))
        write_catalog(entries, catalog, "link_entries")
        write_catalog(merged.drop("rewritten"), catalog, "pages")
    return counts


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="inkloom")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (("mirror", "mirror a folder of HTML files"), ("structure", "plan a mirror without texts")):
        made = commands.add_parser(name, help=about)
        made.add_argument("source")
        made.add_argument("output")
        made.add_argument("--max-depth", type=int, default=3)
        made.add_argument("--max-pages", type=int, default=500)
    query = commands.add_parser("query", help="search a mirror")
    query.add_argument("output")
    query.add_argument("text")
    query.add_argument("--limit", type=int, default=10)
    commands.add_parser("verify", help="check a mirror").add_argument("output")
    commands.add_parser("catalog", help="name the tables of a mirror").add_argument("output")
    again = commands.add_parser("relink", help="rewrite links again")
    again.add_argument("output")
    again.add_argument("--path-prefix", default="")
    again.add_argument("--dry-run", action="store_true")
    args = parser.parse_args(argv)
    catalog = f"{args.output.rstrip('/')}/_catalog"
    if args.command == "catalog":
        print("\n".join(f"{catalog}/{name}.parquet" for name in TABLES))
        return 0
    spark = build_session()
    ship(spark)
    try:
        return _run(spark, args, catalog)
    finally:
        drop_stored(spark)


def _run(spark: SparkSession, args: argparse.Namespace, catalog: str) -> int:
    if args.command in ("mirror", "structure"):
        run = mirror if args.command == "mirror" else structure
        print("pages", run(spark, args.source, args.output, args.max_depth, args.max_pages))
    elif args.command == "relink":
        print(relink(spark, args.output, args.path_prefix, args.dry_run))
    elif args.command == "query":
        pages = spark.read.parquet(f"{catalog}/pages.parquet")
        for n, r in enumerate(search(pages, "path", "markdown", args.text, args.limit).collect(), 1):
            print(n, r.score, r.path, r.snippet)
    else:
        read = lambda name: spark.read.parquet(f"{catalog}/{name}.parquet")
        row = verify(read("pages"), read("links"), read("issues")).first()
        print(row.asDict())
        return 0 if row.status == "ok" else 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
