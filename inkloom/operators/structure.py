"""Layout from a saved structure and an earlier catalog: overlay, paths, relocated and stale files, folders to refresh.

Frames: ``pages`` and ``structure`` have ``url, title, depth, nav_path, parent``; pages ``placeholder`` besides, structure
``fetch_url, path, ord``; an earlier catalog (``previous``) has ``url, path, nav_path, placeholder, ord``.  Null or empty
URLs and paths name nothing.  Of several rows of one key the last by ``ord`` holds unless another rule is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.predicates import is_main_page, placeholder_body
from inkloom.functions.urls import let, markdown_relpath, slugify, url_host, url_path
from inkloom.operators.catalog import folder_ancestors, parent_folder
from inkloom.session import cut


def _named(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.col(column) != ""))


def _placed(df: DataFrame) -> DataFrame:
    return df.where(F.size(F.coalesce("nav_path", F.array().cast("array<string>"))) > 0)


def structure_ancestors(pages: DataFrame, structure: DataFrame) -> DataFrame:
    """``url`` of everything above a page that isn't a placeholder, along the structure's parents.

    A join a level until nothing new is found, so any depth is covered and cycles end.
    """
    up = _named(_named(structure, "url"), "parent").groupBy("url").agg(F.max_by("parent", "ord").alias("above"))
    seen = None
    level = cut(pages.where(~F.coalesce("placeholder", F.lit(False))).select("url").join(up, "url").select(F.col("above").alias("url")).distinct())
    while not level.isEmpty():
        seen = level if seen is None else cut(seen.unionByName(level))
        level = cut(level.join(up, "url").select(F.col("above").alias("url")).distinct().join(seen, "url", "left_anti"))
    return level if seen is None else seen


def in_scopes(df: DataFrame, path: Column, scopes: DataFrame) -> DataFrame:
    """The rows whose path lies in one of the scope folders (``folder``), which may be many: ancestors are exploded."""
    chain = F.when(path != ".", F.array_union(folder_ancestors(path), F.array(path)))
    marked = df.withColumn("_n", F.monotonically_increasing_id()).withColumn("_chain", chain)
    inside = marked.select("_n", F.explode("_chain").alias("folder")).join(scopes.select("folder").distinct(), "folder", "left_semi").select("_n").distinct()
    return marked.join(inside, "_n", "left_semi").drop("_n", "_chain")


def overlay(pages: DataFrame, structure: DataFrame, previous: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """Pages placed by the structure, and a placeholder for each of its entries that isn't mirrored.

    Entries without a navigation path say nothing.  An entry's depth, path and parent replace a page's.  With scopes,
    only entries in them and those above pages become placeholders.  ``ord``: the structure's order, else one past its end.
    """
    entries = _placed(_named(structure, "url"))
    last = entries.groupBy("url").agg(F.max_by(F.struct("depth", "nav_path", "parent"), "ord").alias("s"), F.min_by(F.struct("title", "fetch_url", "path"), "ord").alias("f"), F.min("ord").alias("ord"))
    end = structure.count() + 1
    own = pages.select("url", "title", "depth", "nav_path", "parent", F.coalesce("placeholder", F.lit(False)).alias("placeholder"), "markdown").join(last, "url", "left")
    from_entry = F.col("s").isNotNull()
    empty = lambda c: F.when(c != "", c)
    kept = own.select(
        "url", "title", F.when(from_entry, F.coalesce("s.depth", F.lit(0))).otherwise(F.col("depth")).alias("depth"), F.when(from_entry, F.col("s.nav_path")).otherwise(F.col("nav_path")).alias("nav_path"),
        F.when(from_entry, empty(F.col("s.parent"))).otherwise(F.col("parent")).alias("parent"), "placeholder", "markdown", F.coalesce("ord", F.lit(end)).cast("bigint").alias("ord"),
    )
    mirrored = _named(previous.where(~F.coalesce("placeholder", F.lit(False))), "url").select("url")
    open_ = last.join(pages.select("url"), "url", "left_anti").join(mirrored, "url", "left_anti")
    if scopes is not None:
        above = open_.join(structure_ancestors(pages, structure), "url", "left_semi")
        rest = open_.join(above.select("url"), "url", "left_anti")
        open_ = above.unionByName(in_scopes(rest, F.coalesce(empty(F.col("f.path")), markdown_relpath("url")), scopes))
    title = F.coalesce(empty(F.col("f.title")), F.element_at("s.nav_path", -1))
    fetched = F.coalesce(empty(F.col("f.fetch_url")), F.col("url"))
    made = open_.select(
        "url", title.alias("title"), F.coalesce("s.depth", F.lit(0)).alias("depth"), F.col("s.nav_path").alias("nav_path"), empty(F.col("s.parent")).alias("parent"), F.lit(True).alias("placeholder"),
        placeholder_body(title, fetched).alias("markdown"), F.col("ord").cast("bigint").alias("ord"),
    )
    return kept.unionByName(made)


def is_reusable(url: Column | str, path: Column, nav_path: Column) -> Column:
    """Whether an earlier path may be kept: it came from navigation, or lies under the same first folder as the URL gives."""
    fits = lambda own: own.isin("index.md", "_index.md") | (F.lower(F.split(path, "/")[0]) == F.lower(own))
    return (F.size(F.coalesce(nav_path, F.array().cast("array<string>"))) > 0) | let(F.split(markdown_relpath(url), "/")[0], fits)


def earlier_paths(previous: DataFrame, with_placeholders: bool = True) -> DataFrame:
    """``url, path`` of the earlier catalog's rows whose path may be kept; the last of several."""
    rows = _named(_named(previous, "url"), "path")
    rows = rows if with_placeholders else rows.where(~F.coalesce("placeholder", F.lit(False)))
    return rows.where(is_reusable("url", F.col("path"), F.col("nav_path"))).groupBy("url").agg(F.max_by("path", "ord").alias("path"))


def page_paths(pages: DataFrame, structure: DataFrame, previous: DataFrame) -> DataFrame:
    """``url, path``: the structure's path, else the earlier one if it may be kept, else below the folder of the page that
    the navigation path leads through, else what the URL gives."""
    planned = _named(_placed(_named(structure, "url")), "path").groupBy("url").agg(F.min_by("path", "ord").alias("planned"))
    earlier = earlier_paths(previous).withColumnRenamed("path", "earlier")
    way = _named(_placed(previous), "path").groupBy(F.col("nav_path").alias("above")).agg(F.max_by("path", "ord").alias("above_path"))
    size = F.size("nav_path")
    asked = pages.select("url", F.when(size > 1, F.slice("nav_path", F.lit(1), F.greatest(size - 1, F.lit(0)))).alias("above")).dropDuplicates(["url"])
    joined = asked.join(planned, "url", "left").join(earlier, "url", "left").join(way, "above", "left")
    folder = parent_folder(F.col("above_path"))

    def chosen(natural: Column) -> Column:
        parts = F.split(natural, "/")
        name = F.when(F.element_at(parts, -1) == "_index.md", F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.lit("_index.md"))).otherwise(F.element_at(parts, -1))
        below = F.when(folder == ".", name).otherwise(F.concat(folder, F.lit("/"), name))
        return F.coalesce("planned", "earlier", F.when(F.col("above_path").isNotNull(), below), natural)

    return joined.select("url", let(markdown_relpath("url"), chosen).alias("path"))


def merge_paths(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``url, path``: this run's, and the earlier ones of pages it doesn't have."""
    return current.select("url", "path").unionByName(earlier_paths(previous, with_placeholders=False).join(current.select("url"), "url", "left_anti"))


def relocated_paths(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``path``: earlier paths of pages that have another one now."""
    joined = _named(previous, "path").select("url", F.col("path").alias("old")).join(current.select("url", "path"), "url")
    return joined.where(F.col("old") != F.col("path")).select(F.col("old").alias("path")).distinct()


def stale_paths(previous: DataFrame, current: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """``path``: files to delete - those of relocated pages, and earlier paths of this run's pages that no page has now."""
    current = cut(current.select("url", "path"))
    previous = cut(_named(previous, "path").select("url", "path"))
    old = previous.join(current.select("url"), "url", "left_semi").select("path").distinct()
    unused = old.join(current.select("path"), "path", "left_anti")
    unused = unused if scopes is None else in_scopes(unused, F.col("path"), scopes)
    return unused.unionByName(relocated_paths(previous, current)).distinct()


def scoped_hashes(hashes: DataFrame, previous: DataFrame, current: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """The earlier hashes (``path, content_hash``) of this run's pages, those in the scopes only."""
    paths = _named(previous, "path").join(current.select("url"), "url", "left_semi").select("path").distinct()
    paths = paths if scopes is None else in_scopes(paths, F.col("path"), scopes)
    return hashes.join(paths, "path", "left_semi")


def folders_to_refresh(folders: DataFrame, scopes: DataFrame | None) -> DataFrame:
    """``folder``: those in a scope, and those above one; without scopes all."""
    distinct = folders.select("folder").distinct()
    if scopes is None:
        return distinct
    above = scopes.select(F.explode(folder_ancestors(F.col("folder"))).alias("folder")).unionByName(scopes.select("folder")).distinct()
    return in_scopes(distinct, F.col("folder"), scopes).unionByName(distinct.join(above, "folder", "left_semi")).distinct()


def pages_to_write(pages: DataFrame, previous: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """The pages whose files are written: all that have content, and placeholders of what isn't mirrored yet.

    ``pages``: ``url, path, placeholder``.  With scopes, of the placeholders only those in a scope or on the way to one.
    """
    pages = cut(pages)
    empty = F.coalesce("placeholder", F.lit(False))
    mirrored = _named(previous.where(~F.coalesce("placeholder", F.lit(False))), "url").select("url").distinct()
    open_ = pages.where(empty).join(mirrored, "url", "left_anti")
    if scopes is not None:
        inside = in_scopes(open_, F.col("path"), scopes)
        folder = F.when(F.col("path").rlike(r"(^|/)_index\.md$"), parent_folder(F.col("path"))).otherwise(F.col("path"))
        above = scopes.select(F.explode(folder_ancestors(F.col("folder"))).alias("_folder")).distinct()
        rest = open_.join(inside.select("url"), "url", "left_anti").withColumn("_folder", folder)
        open_ = inside.unionByName(rest.join(above, "_folder", "left_semi").drop("_folder"))
    return pages.where(~empty).unionByName(open_)


def structure_order(pages: DataFrame, structure: DataFrame) -> DataFrame:
    """The pages with ``ord``, that of the first structure entry of their URL, else one past the structure's end."""
    first = _named(structure, "url").groupBy("url").agg(F.min("ord").alias("ord"))
    return pages.join(first, "url", "left").withColumn("ord", F.coalesce("ord", F.lit(structure.count() + 1)).cast("bigint"))


def drop_synthetic_root(structure: DataFrame, root: str) -> DataFrame:
    """Without the entry of a root that is only a main page; what hung on it is top-level."""
    synthetic = (F.col("url") == root) & is_main_page("url") & (F.size(F.coalesce("nav_path", F.array().cast("array<string>"))) == 0)
    gone = structure.where(synthetic).select(F.col("url").alias("parent"), F.lit(True).alias("_gone")).distinct()
    return structure.where(~F.coalesce(synthetic, F.lit(False))).join(gone, "parent", "left").withColumn("parent", F.when(F.col("_gone").isNull(), F.col("parent"))).drop("_gone")


def structure_root(url: Column | str) -> Column:
    """The main page of a help system for an address below its ``content`` folder; other addresses stay."""
    column = F.col(url) if isinstance(url, str) else url
    parts = F.split(column, "/")
    at = F.array_position(F.transform(parts, F.lower), "content").cast("int")
    main = F.concat(F.array_join(F.slice(parts, F.lit(1), at), "/"), F.lit("/main_page.htm"))
    return F.when((at > 0) & ~is_main_page(column), main).otherwise(column)


def source_root_name(source: Column | str) -> Column:
    """A name for the folder of a mirror: from the host of an address, else from the last part of a path."""
    column = F.col(source) if isinstance(source, str) else source
    return slugify(F.when(url_host(column) != "", url_host(column)).otherwise(F.regexp_extract(F.regexp_replace(url_path(column), r"/+$", ""), r"([^/]*)$", 1)))


def mirror_source(pages: DataFrame) -> DataFrame:
    """One row, ``url``: the first web address of the catalog by ``ord``, else that of the local host."""
    return pages.where(F.startswith("url", F.lit("http"))).agg(F.coalesce(F.min_by("url", "ord"), F.lit("https://localhost/")).alias("url"))


def same_body(left: Column, right: Column) -> Column:
    """Whether two texts are equal but for white space at their ends."""
    return F.regexp_replace(left, r"\s+$", "") == F.regexp_replace(right, r"\s+$", "")


def catalog_summary(pages: DataFrame, links: DataFrame, assets: DataFrame, issues: DataFrame) -> DataFrame:
    """One row of counts: pages, links by kind, assets and how many of them are here, errors and warnings."""
    rows = [
        pages.agg(F.count(F.lit(1)).alias("pages")),
        links.agg(*[F.count_if(F.col("kind") == k).alias(f"links_{k}") for k in ("internal", "internal_unresolved", "external")]),
        assets.agg(F.count(F.lit(1)).alias("assets"), F.count_if(F.coalesce("local_path", F.lit("")) != "").alias("assets_localized")),
        issues.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(~F.col("severity").eqNullSafe("error")).alias("warnings")),
    ]
    return rows[0].crossJoin(rows[1]).crossJoin(rows[2]).crossJoin(rows[3])  # single rows
