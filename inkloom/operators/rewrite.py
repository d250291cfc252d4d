"""Link rewriting: targets of a text become relative paths to the mirror's own pages and assets.

Targets are cut out of the texts once, resolved against their page, joined with the paths of pages, the assets of the page
and the headings behind anchors, and put back in one Arrow batch function.  No map of all pages goes to a worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote, urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.media import relative_path, render_image
from inkloom.functions.urls import canonical_url, with_language_prefix

LINK = re.compile(r"(!?)\[((?:[^\[\]]|!?\[[^\]]*\](?:\([^)]*\))?)*)\]\(([^()]+)\)")
MEDIA_TAGS, MEDIA_ATTRIBUTES = ("a", "video", "source"), ("href", "path", "src")
_TAG = re.compile(rf"<(?:{'|'.join(MEDIA_TAGS)})\b[^>]*>", re.I)
_ATTRIBUTE = re.compile(rf"(\b(?:{'|'.join(MEDIA_ATTRIBUTES)})=)([\"'])([^\"']+)\2", re.I)


def link_targets(text: str) -> list[str]:
    """Distinct targets of Markdown links and images, those inside labels too, and of media tags."""
    found: list[str] = []
    for m in LINK.finditer(text):
        found += [m[3].strip(), *link_targets(m[2])]
    found += [m[3].strip() for tag in _TAG.finditer(text) for m in _ATTRIBUTE.finditer(tag[0])]
    return list(dict.fromkeys(x for x in found if x))


def resolve_target(target: str, page: str) -> tuple[str, str]:
    """The address a target names, seen from its page, and its fragment, unquoted."""
    base, _, fragment = target.partition("#")
    return (urljoin(page, base) if base else page), unquote(fragment).strip()


def page_targets(pages: DataFrame, text: str = "markdown") -> DataFrame:
    """``url, target, base, fragment`` of every distinct target of a page; ``base`` in canonical form, with its language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(u, t, *resolve_target(t, u)) for u, value in zip(batch["url"], batch["text"], strict=True) for t in link_targets(value)]
            yield pd.DataFrame(rows, columns=["url", "target", "base", "fragment"])

    raw = pages.where(F.col(text).isNotNull() & F.col("url").isNotNull()).select("url", F.col(text).alias("text"))
    raw = raw.mapInPandas(run, "url string, target string, base string, fragment string").distinct()
    web = F.col("base").rlike(r"(?i)^https?:")
    return raw.withColumn("base", F.when(F.col("base") == F.col("url"), F.col("url")).when(web, with_language_prefix("base", F.col("url"))).otherwise(F.col("base")))


def apply_targets(text: str, page: str, known: dict[str, tuple[str, str, str, int, int]], image_limit: int | None = None) -> str:
    """A text with its known targets replaced; ``known``: target to ``kind, path, anchor, width, height``.

    Images that are assets are rendered, other links get the relative path; to the page itself only the anchor is left;
    code stays as it is.
    """

    def to(target: str) -> str | None:
        found = known.get(target.strip())
        if found is None:
            return None
        kind, path, anchor, *_ = found
        way = relative_path(path, page)
        if kind == "asset":
            return way if way.startswith((".", "/")) else f"./{way}"
        return f"#{anchor}" if anchor and path == page else f"{way}#{anchor}" if anchor else way

    def link(m: re.Match) -> str:
        found = known.get(m[3].strip())
        if m[1] and found and found[0] == "asset" and image_limit is not None:
            return render_image(to(m[3]), m[2], found[3], found[4], image_limit)
        label = LINK.sub(link, m[2]) if "](" in m[2] else m[2]
        way = to(m[3])
        return f"{m[1]}[{label}]({m[3] if way is None else way})"

    def attribute(m: re.Match) -> str:
        way = to(m[3])
        return m[0] if way is None else f"{m[1]}{m[2]}{way}{m[2]}"

    out = []
    for i, piece in enumerate(re.split(r"(?ms)(^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\Z))", text)):
        out.append(piece if i % 2 else _TAG.sub(lambda t: _ATTRIBUTE.sub(attribute, t[0]), LINK.sub(link, piece)))
    return "".join(out)


def rewrite_links(pages: DataFrame, paths: DataFrame, assets: DataFrame | None = None, anchors: DataFrame | None = None, image_limit: int | None = None) -> DataFrame:
    """The pages with a column ``rewritten``.

    ``pages``: ``page_id, url, markdown``; ``paths``: ``url, path``, one for a URL; ``assets``: ``url`` (of the page),
    ``source, local_path, width, height``; ``anchors``: ``url, anchor, heading``.  An asset is told by its exact source,
    else by the resolved one; a fragment becomes the heading behind it, else stays.  Texts that are null stay null, and
    so do those of pages without a path.
    """
    targets = page_targets(pages)
    known = targets.join(paths.select(F.col("url").alias("base"), F.col("path").alias("page_path")), "base", "left")
    if anchors is not None:
        first = anchors.groupBy(F.col("url").alias("base"), F.col("anchor").alias("fragment")).agg(F.min("heading").alias("heading"))
        known = known.join(first, ["base", "fragment"], "left").withColumn("anchor", F.coalesce("heading", "fragment"))
    else:
        known = known.withColumn("anchor", F.col("fragment"))
    if assets is not None:
        own = assets.where(F.coalesce("local_path", F.lit("")) != "").groupBy("url", "source").agg(F.min(F.struct("local_path", "width", "height")).alias("a"))
        known = known.join(own.select("url", F.col("source").alias("target"), F.col("a").alias("exact")), ["url", "target"], "left")
        known = known.join(own.select("url", F.col("source").alias("base"), F.col("a").alias("resolved")), ["url", "base"], "left").withColumn("asset", F.coalesce("exact", "resolved"))
    else:
        known = known.withColumn("asset", F.lit(None).cast("struct<local_path:string,width:int,height:int>"))
    hit = known.where(F.col("asset").isNotNull() | F.col("page_path").isNotNull())
    entry = F.struct(
        "target", F.when(F.col("asset").isNotNull(), "asset").otherwise("page").alias("kind"), F.coalesce("asset.local_path", "page_path").alias("path"),
        F.when(F.col("asset").isNull(), F.col("anchor")).otherwise("").alias("anchor"), F.coalesce("asset.width", F.lit(0)).cast("int").alias("width"), F.coalesce("asset.height", F.lit(0)).cast("int").alias("height"),
    )
    maps = hit.groupBy("url").agg(F.collect_list(entry).alias("known"))  # the targets of one text
    joined = pages.join(paths, "url", "left").join(maps, "url", "left")
    schema = T.StructType([*joined.drop("known").schema.fields, T.StructField("rewritten", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for text, path, found in zip(batch["markdown"], batch["path"], batch["known"], strict=True):
                if text is None or path is None or found is None or not len(found):
                    done.append(text)
                else:
                    done.append(apply_targets(text, path, {x["target"]: (x["kind"], x["path"], x["anchor"], x["width"], x["height"]) for x in found}, image_limit))
            out = batch.drop(columns="known")
            out["rewritten"] = done
            yield out

    return joined.mapInPandas(run, schema)


def frontmatter_links(text: str) -> tuple[list[str], list[str]]:
    """Distinct internal and external targets of a text's links, in order; images and mere fragments don't count."""
    found = list(dict.fromkeys(m[3].strip() for m in LINK.finditer(text) if not m[1] and not m[3].strip().startswith("#")))
    web = [x for x in found if x.startswith(("http://", "https://"))]
    return [x for x in found if x not in set(web)], web


def link_entries(pages: DataFrame, paths: DataFrame, text: str = "rewritten") -> DataFrame:
    """``from_path, kind, to``, distinct, of the links of rewritten texts: web targets that are mirrored count by their path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url, path, value in zip(batch["url"], batch["path"], batch["text"], strict=True):
                inner, web = frontmatter_links(value)
                rows += [(path, t, "") for t in inner] + [(path, t, resolve_target(t, url)[0]) for t in web]
            yield pd.DataFrame(rows, columns=["from_path", "target", "base"])

    rows = pages.where(F.col(text).isNotNull() & F.col("path").isNotNull()).select("url", "path", F.col(text).alias("text")).mapInPandas(run, "from_path string, target string, base string")
    joined = rows.withColumn("base", F.when(F.col("base") != "", canonical_url("base"))).join(paths.select(F.col("url").alias("base"), F.col("path").alias("known")), "base", "left")
    inside = F.col("base").isNull() | F.col("known").isNotNull()
    return joined.select("from_path", F.when(inside, "internal").otherwise("external").alias("kind"), F.coalesce("known", "target").alias("to")).distinct()


def relink_counts(rewritten: DataFrame) -> DataFrame:
    """One row, ``changed, unchanged, skipped``: texts that differ but for white space at the end, and rows without text or path."""
    usable = F.col("markdown").isNotNull() & F.col("path").isNotNull()
    same = F.rtrim(F.col("markdown")) == F.rtrim(F.col("rewritten"))
    return rewritten.agg(F.count_if(usable & ~same).alias("changed"), F.count_if(usable & same).alias("unchanged"), F.count_if(~usable).alias("skipped"))
