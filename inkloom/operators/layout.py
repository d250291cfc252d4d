"""Where pages go: parents, index files and the folders of their children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.operators.hierarchy import resolve_hierarchy
from inkloom.session import store


def nav_parents(pages: DataFrame) -> DataFrame:
    """``url, parent``: a page's parent by its navigation path, else the one it names.

    ``pages``: ``url, nav_path, nav_parent_url, seq``.  A page that names itself, and one whose path is a single step,
    has none; with a longer path the first page with the path above is the parent; else a named parent that is a page.
    """
    size = F.size("nav_path")
    above = F.slice("nav_path", F.lit(1), F.greatest(size - 1, F.lit(0)))
    owners = pages.where(size > 0).groupBy(F.col("nav_path").alias("above")).agg(F.min_by("url", "seq").alias("by_path"))
    known = pages.select(F.col("url").alias("nav_parent_url"), F.lit(True).alias("known")).distinct()
    joined = pages.withColumn("above", F.when(size > 1, above)).join(owners, "above", "left").join(known, "nav_parent_url", "left")
    self_named = F.col("nav_parent_url") == F.col("url")
    parent = F.when(F.coalesce(self_named, F.lit(False)) | (size == 1), F.lit(None)).otherwise(F.coalesce(F.when(F.col("by_path") != F.col("url"), F.col("by_path")), F.when(F.col("known"), F.col("nav_parent_url"))))
    return joined.select("url", parent.alias("parent"))


def index_path(path: Column) -> Column:
    """``x.md`` to ``x/_index.md``; ``a/a.md`` to ``a/_index.md``; index files stay."""
    stem = F.regexp_replace(path, r"\.md$", "")
    own = F.element_at(F.split(stem, "/"), -1)
    folder = F.regexp_replace(stem, r"/?[^/]*$", "")
    return F.when(path.rlike(r"(^|/)_index\.md$"), path).when(F.element_at(F.split(folder, "/"), -1) == own, F.concat(folder, F.lit("/_index.md"))).otherwise(F.concat(stem, F.lit("/_index.md")))


def under_folder(path: Column, folder: Column) -> Column:
    """A path moved below a folder: an index file takes its own folder along."""
    parts = F.split(path, "/")
    name = F.when(F.element_at(parts, -1) == "_index.md", F.concat_ws("/", F.try_element_at(parts, F.lit(-2)), F.lit("_index.md"))).otherwise(F.element_at(parts, -1))
    return F.when((folder == "") | F.startswith(path, F.concat(folder, F.lit("/"))), path).otherwise(F.concat(folder, F.lit("/"), name))


def parent_first(pages: DataFrame) -> DataFrame:
    """``url, path``: parents become index files and children lie below their parent's final folder.

    ``pages``: ``url, parent, path, placeholder``.  The tree is solved first, so levels cost no rounds and may be many;
    what stands on a cycle or hangs on one keeps its own path.
    """
    has_children = pages.where("parent is not null").select(F.col("parent").alias("url"), F.lit(True).alias("is_parent")).distinct()
    marked = pages.join(has_children, "url", "left")
    marked = marked.select("url", "parent", F.when(F.coalesce("is_parent", F.lit(False)) | F.coalesce("placeholder", F.lit(False)), index_path(F.col("path"))).otherwise(F.col("path")).alias("path"))
    known = marked.select(F.col("url").alias("parent"), F.lit(True).alias("known")).distinct()
    rows = store(marked.join(known, "parent", "left").select(F.monotonically_increasing_id().alias("no"), "url", F.when(F.col("known"), F.col("parent")).alias("parent"), "path", F.lit("").alias("tree")))
    solved = resolve_hierarchy(rows, "no", "url", "parent", "tree", "no", with_paths=True)
    # A page's path follows from those of the pages above it, from the root down.
    above = solved.select("id", F.posexplode("path").alias("at", "no")).join(rows.select("no", F.col("path").alias("file")), "no")
    chain = F.transform(F.array_sort(F.collect_list(F.struct("at", "file"))), lambda x: x["file"])
    placed = F.aggregate(chain, F.lit(""), lambda done, path: F.when(done == "", path).otherwise(under_folder(path, F.regexp_replace(done, r"/?[^/]*$", ""))))
    final = above.groupBy("id").agg(placed.alias("placed"))
    return rows.join(final, F.col("no") == F.col("id"), "left").select("url", F.coalesce("placed", "path").alias("path"))


def merge_nav_hints(hints: DataFrame) -> DataFrame:
    """``url, parent, nav_path`` of each page from all its discoveries ``url, parent, nav_path, from_toc, seq``.

    A strictly longer path from a table of contents wins, ties keeping the first; without one the first discovery holds.
    """
    best = F.max_by(F.struct("parent", "nav_path"), F.when(F.col("from_toc"), F.struct(F.size("nav_path").alias("n"), (-F.col("seq")).alias("s"))))
    first = F.min_by(F.struct("parent", "nav_path"), "seq")
    return hints.groupBy("url").agg(F.coalesce(best, first).alias("h")).select("url", "h.parent", "h.nav_path")
