"""Crawl of HTML files on a shared file system: one scan, then joins over the link graph."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.functions.html import parse_document
from inkloom.functions.markdown import normalize_markdown
from inkloom.session import cut, store

HTML = (".html", ".htm", ".xhtml")
_ASSETS = "array<struct<source:string,kind:string,alt:string>>"


def local_target(href: str, page: str, root: str) -> str | None:
    """The file a link names, as a path below ``root``; None for other schemes and pure fragments."""
    parsed = urlparse(href)
    if parsed.scheme not in ("", "file") or parsed.netloc or not parsed.path:
        return None
    path = unquote(parsed.path)
    if parsed.scheme == "file":
        return posixpath.relpath(path, root) if path.startswith(root.rstrip("/") + "/") else None
    full = path.lstrip("/") if path.startswith("/") else posixpath.join(posixpath.dirname(page), path)
    full = posixpath.normpath(full)
    return None if full.startswith("..") else full


def start_file(paths: list[str]) -> str | None:
    """index.html, then index.htm, else the first of the HTML files by name."""
    top = sorted(p for p in paths if "/" not in p and p.lower().endswith(HTML))
    return next((n for n in ("index.html", "index.htm") if n in top), top[0] if top else None)


def scan_html(spark: SparkSession, root: str) -> DataFrame:
    """Every HTML file below a folder, parsed: ``path, title, description, markdown, hrefs, assets``."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).where(F.lower("path").rlike(r"\.(html|htm|xhtml)$")).select("path", "content")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                own = unquote(urlparse(path).path)
                doc = parse_document(bytes(content).decode("utf-8", "replace"), "")
                rows.append((posixpath.relpath(own, base), doc["title"], doc["description"], normalize_markdown(doc["markdown"]), doc["links"], doc["assets"]))
            yield pd.DataFrame(rows, columns=["path", "title", "description", "markdown", "hrefs", "assets"])

    return files.mapInPandas(parse, f"path string, title string, description string, markdown string, hrefs array<string>, assets {_ASSETS}")


def crawl_local(spark: SparkSession, root: str, max_depth: int = 3, max_pages: int = 500, start: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(pages, issues)``: breadth first from the start file; the first discoverer is the parent, so depth is least.

    A page's place is ``seq``.  Links to files that aren't there become issues of kind ``local_link_missing``; without a
    start file the only issue is ``source_missing``.
    """
    scanned = store(scan_html(spark, root))
    # The choice of start_file over all names at the top, however many: one row comes back.
    rank = F.when(F.col("path") == "index.html", 0).when(F.col("path") == "index.htm", 1).otherwise(2)
    best = scanned.where(~F.contains("path", F.lit("/"))).agg(F.min(F.struct(rank.alias("rank"), "path")).alias("first")).first()["first"]
    first = start or (best["path"] if best else None)
    page_schema = f"path string, title string, description string, markdown string, assets {_ASSETS}, links_internal array<string>, links_external array<string>, depth int, parent string, seq bigint"
    if first is None:
        return spark.createDataFrame([], page_schema), spark.createDataFrame([("error", "source_missing", root, None)], "severity string, kind string, message string, path string")

    def targets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, n, h, local_target(h, p, root)) for p, links in zip(batch["path"], batch["hrefs"], strict=True) for n, h in enumerate(links)]
            yield pd.DataFrame(rows, columns=["src", "ordinal", "href", "dst"])

    links = scanned.select("path", "hrefs").mapInPandas(targets, "src string, ordinal int, href string, dst string")
    known = scanned.select(F.col("path").alias("dst"), F.lit(True).alias("there"))
    html_target = F.lower(F.coalesce("dst", F.lit(""))).rlike(r"\.(html|htm|xhtml)$")
    links = store(links.join(known, "dst", "left").select("src", "ordinal", "href", "dst", F.coalesce("there", F.lit(False)).alias("there"), html_target.alias("html")))
    edges = links.where("there").select("src", "dst", "ordinal")
    seen = cut(scanned.where(F.col("path") == first).select("path", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"), F.lit(1).cast("bigint").alias("seq")))
    frontier, count = seen, 1
    for depth in range(1, max_depth + 1):
        found = frontier.select(F.col("path").alias("src"), "seq").join(edges, "src").groupBy("dst").agg(F.min(F.struct("seq", "ordinal", "src")).alias("by"))
        found = found.join(seen.select(F.col("path").alias("dst")), "dst", "left_anti")
        # The order of one level, cut to the pages still allowed, so never longer than the page cap.
        level = found.orderBy("by.seq", "by.ordinal").limit(max(0, max_pages - count))
        frontier = cut(level.select(F.col("dst").alias("path"), F.lit(depth).alias("depth"), F.col("by.src").alias("parent"), (F.row_number().over(Window.orderBy("by.seq", "by.ordinal")) + count).cast("bigint").alias("seq")))
        n = frontier.count()
        if not n:
            break
        count += n
        seen = cut(seen.unionByName(frontier))
    ordered = lambda which: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("ordinal", F.coalesce("dst", "href").alias("to"))))), lambda s: s["to"]))
    split = links.groupBy(F.col("src").alias("path")).agg(ordered(F.col("there")).alias("links_internal"), ordered(~F.col("there") & ~F.col("html")).alias("links_external"))
    empty = F.array().cast("array<string>")
    pages = seen.join(scanned.drop("hrefs"), "path").join(split, "path", "left").select(
        "path", "title", "description", "markdown", "assets", F.coalesce("links_internal", empty).alias("links_internal"), F.coalesce("links_external", empty).alias("links_external"), "depth", "parent", "seq"
    )
    missing = links.where("html and not there").join(seen.select(F.col("path").alias("src")), "src", "left_semi")
    issues = missing.select(F.lit("warning").alias("severity"), F.lit("local_link_missing").alias("kind"), F.col("href").alias("message"), F.col("src").alias("path")).distinct()
    return pages, issues
