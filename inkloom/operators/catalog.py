"""Catalog operators: links, merges, change reports, folders, layout, search."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.media import humanise_column
from inkloom.functions.predicates import is_allowed, is_html_candidate, is_placeholder_candidate, is_service
from inkloom.session import cut

ROOT_TITLE = "Documentation Mirror"  # fixed value


def resolve_links(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """``edges`` (``src, dst``) with ``kind``: ``internal`` where ``dst`` is a page's ``url``, ``internal_unresolved`` on
    a page's host without a page, else ``external``.  A plain equi-join; the engine picks its side by measured size."""
    known = pages.select(F.col("url").alias("dst"), F.lit(True).alias("hit")).distinct()
    hosts = pages.select(F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1).alias("host"), F.lit(True).alias("own")).distinct()
    joined = edges.withColumn("host", F.regexp_extract("dst", r"^[a-z]+://([^/]*)", 1)).join(known, "dst", "left").join(hosts, "host", "left")
    kind = F.when(F.col("hit"), "internal").when(F.col("own"), "internal_unresolved").otherwise("external")
    return joined.select("src", "dst", kind.alias("kind"))


def link_catalog(internal: DataFrame, external: DataFrame, pages: DataFrame) -> DataFrame:
    """``src, dst, kind``, distinct: links found as internal that no page answers are unresolved, links found as external
    that a page answers are internal."""
    known = pages.select(F.col("url").alias("dst"), F.lit(True).alias("hit")).distinct()
    both = internal.select("src", "dst", F.lit("internal_unresolved").alias("miss")).unionByName(external.select("src", "dst", F.lit("external").alias("miss")))
    return both.distinct().join(known, "dst", "left").select("src", "dst", F.when(F.col("hit"), "internal").otherwise(F.col("miss")).alias("kind")).distinct()


def link_warnings(links: DataFrame) -> DataFrame:
    """An issue for every link that leads to no page."""
    return links.where(F.col("kind") == "internal_unresolved").select(F.lit("warning").alias("severity"), F.lit("link_unresolved").alias("kind"), F.col("dst").alias("message"), F.col("src").alias("path"))


def children_lists(pages: DataFrame, parent: str, child: str, order: Column) -> DataFrame:
    """``parent, children``: distinct children in order."""
    first = pages.where(F.col(parent).isNotNull()).groupBy(parent, child).agg(F.min(order).alias("o"))
    return first.groupBy(F.col(parent).alias("parent")).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", child))), lambda s: s[child]).alias("children"))


def sibling_order(pages: DataFrame, parent: str, child: str, order: Column) -> DataFrame:
    """1-based position of each distinct child under its parent; null parents are one group."""
    first = pages.groupBy(parent, child).agg(F.min(order).alias("o"))
    return first.select(parent, child, F.row_number().over(Window.partitionBy(parent).orderBy("o", child)).alias("position"))


def sync_report(before: DataFrame, now: DataFrame, key: str | list[str], digest: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Each key, of one column or several, with ``added``, ``deleted``, ``changed`` or ``unchanged``.

    Rows without a key or a digest (null or empty) don't count.  Of several rows of one key the last by ``order`` holds;
    where that is a tie, or there is no order, the greatest digest.
    """
    last = lambda df: F.max_by(digest, F.struct(*order, digest)) if all(c in df.columns for c in order) else F.max(digest)
    keys = [key] if isinstance(key, str) else key
    usable = reduce(lambda a, b: a & b, [F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys]) & (F.col(digest) != "")
    side = lambda df, name: df.where(usable).groupBy(*keys).agg(last(df).alias(name))
    joined = side(before, "old").join(side(now, "new"), keys, "full")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return joined.select(*keys, status.alias("status"))


def merge_catalog(before: DataFrame, now: DataFrame, key: str | list[str], in_scope: Column) -> DataFrame:
    """Rows out of scope stay, rows in scope stay unless this run has their key; this run's rows follow."""
    keys = [key] if isinstance(key, str) else key
    return before.where(~in_scope).unionByName(before.where(in_scope).join(now.select(*keys).distinct(), keys, "left_anti")).unionByName(now)


def link_path_map(structure: DataFrame, pages: DataFrame) -> DataFrame:
    """``url, path``: a page's own path, else the planned one; placeholders have none of their own, the last row by ``ord`` holds."""
    last = lambda df, name: df.where((F.col("url") != "") & (F.col("path") != "")).groupBy("url").agg(F.max_by("path", F.struct("ord", "path")).alias(name))
    both = last(pages.where(~F.coalesce("placeholder", F.lit(False))), "own").join(last(structure, "planned"), "url", "full")
    return both.select("url", F.coalesce("own", "planned").alias("path"))


def missing_pages(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """``url``, distinct, of those wanted that no page has which isn't a placeholder."""
    return wanted.select("url").distinct().join(pages.where(~F.coalesce("placeholder", F.lit(False))).select("url"), "url", "left_anti")


def anchor_headings(headings: DataFrame, page: str, anchor: str, heading: str, order: str) -> DataFrame:
    """``page, anchor, heading``: the heading behind each anchor of a page, the first by place."""
    return headings.groupBy(page, anchor).agg(F.min_by(heading, F.struct(order, heading)).alias("heading"))


def folder_entries(pages: DataFrame) -> DataFrame:
    """``folder, kind, position, path, title``: what lies in each folder, a row each, so that no folder is one row.

    ``pages``: ``path, title, ord``.  Child folders (kind ``folder``) by name, pages (``page``) by ``ord`` and path.
    """
    up = pages.select(F.explode(folder_ancestors(F.col("path"))).alias("folder")).distinct().where("folder <> '.'")
    children = up.select(parent_folder(F.col("folder")).alias("folder"), F.lit("folder").alias("kind"), F.lit(0).cast("bigint").alias("ord"), F.col("folder").alias("path"), F.lit(None).cast("string").alias("title"))
    files = pages.select(parent_folder(F.col("path")).alias("folder"), F.lit("page").alias("kind"), F.col("ord").cast("bigint").alias("ord"), "path", "title")
    place = F.row_number().over(Window.partitionBy("folder", "kind").orderBy("ord", "path"))
    return children.unionByName(files).select("folder", "kind", place.alias("position"), "path", "title")


def folder_ancestors(path: Column) -> Column:
    """All folders above a path, the root as ``.`` first."""
    parts = F.split(path, "/")
    up = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(".")), up)


def parent_folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def minimal_scopes(folders: DataFrame, folder: str) -> DataFrame:
    """Folders that lie in no other folder of the set; ancestors are exploded, so the containment is an equi-join."""
    distinct = folders.select(folder).distinct()
    above = distinct.select(folder, F.explode(F.slice(folder_ancestors(F.col(folder)), F.lit(1), F.lit(1 << 20))).alias("up"))
    covered = above.join(distinct.select(F.col(folder).alias("up")), "up", "left_semi").where(F.col("up") != F.col(folder))
    return distinct.join(covered.select(folder).distinct(), folder, "left_anti")


def resolve_collisions(pages: DataFrame, path: str, seq: Column, source_folder: Column, identity: Column) -> DataFrame:
    """Give every page its own path: the first by ``seq`` keeps it, later ones take their source folder as a prefix, and
    if that is taken too, a hash, longer by four digits every round.  Rounds repeat until no path is owned twice; rows of
    one identity can't be told apart and are one."""
    out = pages.dropDuplicates().withColumn("final_path", F.col(path)).withColumn("_id", identity).dropDuplicates(["_id", path]).drop("_id")
    for n in count():
        rank = F.row_number().over(Window.partitionBy("final_path").orderBy(F.col("final_path") != F.col(path), seq))  # natural owners first
        out = out.withColumn("rank", rank)
        if n > 14 or out.where("rank > 1").isEmpty():  # a whole hash is used up
            break
        stem = F.regexp_replace("final_path", r"\.md$", "")
        prefixed = F.concat(source_folder, F.lit("-"), F.col("final_path")) if n == 0 else F.concat(stem, F.lit("-"), F.substring(F.sha2(identity, 256), 1, 8 + 4 * n), F.lit(".md"))
        out = cut(out.withColumn("final_path", F.when(F.col("rank") > 1, prefixed).otherwise(F.col("final_path"))).drop("rank"))
    return out.drop("rank")


def query_terms(query: str) -> list[str]:
    """Letters and digits of two or more, lower case; repeated terms stay."""
    import re

    return [t.lower() for t in re.findall(r"[A-Za-zА-Яа-яЁё0-9]{2,}", query)]


def markdown_body(text: Column) -> Column:
    """The text behind its front matter."""
    parts = F.split(text, "---", 3)
    return F.when(F.startswith(text, F.lit("---")) & (F.size(parts) == 3), F.trim(F.get(parts, F.lit(2)))).otherwise(text)


def search_score(text: Column, terms: list[str]) -> Column:
    low = F.lower(text)
    parts = [((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / F.lit(len(t))).cast("bigint") for t in terms]
    return sum(parts[1:], parts[0]) if parts else F.lit(0).cast("bigint")


def search_snippet(text: Column, terms: list[str], size: int = 220) -> Column:
    low = F.lower(text)
    places = F.filter(F.array(*[F.instr(low, t) for t in terms]), lambda p: p > 0)
    begin = F.greatest(F.array_min(places) - 1 - size // 3, F.lit(0))
    found = F.trim(F.regexp_replace(F.substring(text, begin + 1, F.lit(size)), r"[\s\x{A0}]+", " "))
    return F.when(F.size(places) == 0, F.trim(F.replace(F.substring(text, 1, size), F.lit("\n"), F.lit(" ")))).otherwise(found)


def search(docs: DataFrame, key: str, text: str, query: str, limit: int = 10) -> DataFrame:
    """The best documents by number of hits, ties by key."""
    terms = query_terms(query)
    if not terms:
        return docs.select(key, F.lit(0).cast("bigint").alias("score"), F.lit("").alias("snippet")).limit(0)
    scored = docs.select(key, text, search_score(F.col(text), terms).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(limit)
    return scored.select(key, "score", search_snippet(markdown_body(F.col(text)), terms).alias("snippet"))


def bounded_bfs(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """``node, depth`` of the nodes within ``max_depth`` links of a start, each at its least depth.  One join a level."""
    seen = cut(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = cut(reached)
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def discover_links(links: DataFrame, root: str, max_depth: int, max_pages: int, scope: str = "subtree", extra: tuple[str, ...] = ()) -> DataFrame:
    """``url, depth, parent, ord, placeholder``: the pages a crawl from ``root`` finds, breadth first.

    ``links``: ``src, dst, ordinal, from_toc`` in canonical form.  Links to the page itself, back to the root, to service
    addresses and to other than HTML lead nowhere; one that isn't allowed becomes a placeholder if it could be a page,
    and isn't followed.  On each page links of a table of contents come first.  The first discovery counts: its page is
    the parent, ``ord`` the place in order of discovery.  Placeholders don't count against ``max_pages``, the root does.
    """
    usable = links.where((F.col("dst") != F.col("src")) & (F.col("dst") != F.lit(root)) & ~is_service("dst") & is_html_candidate("dst"))
    usable = usable.withColumn("placeholder", ~is_allowed("dst", root, scope, extra)).where(~F.col("placeholder") | is_placeholder_candidate("dst", root))
    usable = cut(usable.select("src", "dst", "ordinal", F.coalesce("from_toc", F.lit(False)).alias("from_toc"), "placeholder"))
    spark = links.sparkSession
    seen = cut(spark.createDataFrame([(root, 0, None, 1, False)], "url string, depth int, parent string, ord long, placeholder boolean"))
    frontier, fetched, last = seen, 1, 1
    for depth in range(1, max_depth + 1):
        by = F.min(F.struct(F.col("ord"), (~F.col("from_toc")).alias("late"), "ordinal", "src"))
        found = frontier.where("not placeholder").select(F.col("url").alias("src"), "ord").join(usable, "src").groupBy(F.col("dst").alias("url"), "placeholder").agg(by.alias("by"))
        found = cut(found.join(seen.select("url"), "url", "left_anti"))
        pages = found.where("not placeholder").orderBy("by", "url").limit(max(0, max_pages - fetched))  # no more than the page cap
        level = cut(pages.unionByName(found.where("placeholder")).withColumn("range", F.floor(F.col("by.ord") / 1000)))
        # Numbers run on over the level: ranks inside ranges of parents, behind the ranges before.
        counts = level.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
        before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row for 1,000 parents
        rank = F.row_number().over(Window.partitionBy("range").orderBy("by", "url"))
        frontier = cut(level.join(before, "range").select("url", F.lit(depth).alias("depth"), F.col("by.src").alias("parent"), (F.lit(last) + F.col("before") + rank).cast("bigint").alias("ord"), "placeholder"))
        sizes = frontier.agg(F.count(F.lit(1)), F.count_if(~F.col("placeholder"))).first()
        if not sizes[0]:
            break
        seen, last, fetched = cut(seen.unionByName(frontier)), last + sizes[0], fetched + sizes[1]
    return seen


def distinct_assets(assets: DataFrame, order: list[str]) -> DataFrame:
    """One asset for each page, kind and source: the first in order."""
    rank = F.row_number().over(Window.partitionBy("page", "kind", "source").orderBy(*order))
    return assets.withColumn("_r", rank).where("_r = 1").drop("_r")


def scaled(width: Column, height: Column, limit: int) -> list[Column]:
    """Width, height and per cent of an image under a width limit; halves go to even."""
    wide = F.least(width, F.lit(limit))
    ratio = wide / width
    return [wide.cast("bigint").alias("width"), F.greatest(F.lit(1), F.bround(height * ratio, 0)).cast("bigint").alias("height"), F.greatest(F.lit(1), F.bround(F.lit(100.0) * wide / width, 0)).cast("bigint").alias("scale")]


def nav_label_key(label: Column) -> Column:
    """A label without its site suffix, in lower case, letters and digits only."""
    return F.regexp_replace(F.lower(F.regexp_replace(label, r"\s+[-–—]\s+.*$", "")), r"[^0-9a-zа-яё]+", "")


def insert_placeholders(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """``known`` (``url, depth, parent, nav_path, ord, placeholder``) and a placeholder for each wanted URL it lacks.

    ``wanted``: ``url, title, parent, seq``; the first of several rows counts.  A placeholder lies one step below its
    parent, carries its path on by the title, and is numbered on behind what is there.
    """
    first = wanted.groupBy("url").agg(F.min_by(F.struct("title", "parent", "seq"), "seq").alias("w")).select("url", "w.*").join(known.select("url"), "url", "left_anti")
    above = known.select(F.col("url").alias("parent"), F.col("depth").alias("up"), F.col("nav_path").alias("way"))
    last = known.agg(F.coalesce(F.max("ord"), F.lit(0)).cast("bigint")).first()[0]
    # Numbers run on over all placeholders: ranks inside hash ranges of seq, behind the ranges before.
    placed = first.join(above, "parent", "left").withColumn("range", F.floor(F.col("seq") / 10_000))
    counts = placed.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))  # a row for 10,000 places
    rank = F.row_number().over(Window.partitionBy("range").orderBy("seq", "url"))
    made = placed.join(before, "range").select(
        "url", (F.coalesce("up", F.lit(0)) + 1).cast("int").alias("depth"), "parent", F.concat(F.coalesce("way", F.array().cast("array<string>")), F.array("title")).alias("nav_path"),
        (F.lit(last) + F.col("before") + rank).cast("bigint").alias("ord"), F.lit(True).alias("placeholder"),
    )
    return known.select(made.columns).unionByName(made)


def folder_index(pages: DataFrame) -> DataFrame:
    """One row a folder: ``path, title, children, pages, keywords`` from ``path, title, ord``.

    Folders above those with pages are there too.  The title is that of the index file, else the folder's name; child
    folders are sorted, pages in order, keywords distinct and sorted.
    """
    files = pages.withColumn("folder", parent_folder(F.col("path")))
    up = pages.select(F.explode(folder_ancestors(F.col("path"))).alias("folder")).distinct()
    children = up.where("folder <> '.'").select(parent_folder(F.col("folder")).alias("folder"), F.col("folder").alias("child")).groupBy("folder").agg(F.array_sort(F.collect_list("child")).alias("children"))
    index = F.col("path").rlike(r"(^|/)_index\.md$")
    own = files.groupBy("folder").agg(
        F.max_by(F.when(index & (F.col("title") != ""), F.col("title")), F.when(index & (F.col("title") != ""), F.col("ord"))).alias("title"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "path", "title"))), lambda s: F.struct(s["path"].alias("path"), s["title"].alias("title"))).alias("pages"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all(F.lower("title"), F.lit(r"[a-zа-яё0-9]{3,}"), F.lit(0)))))).alias("keywords"),
    )
    name = F.when(F.col("folder") == ".", ROOT_TITLE).otherwise(humanise_column(F.element_at(F.split("folder", "/"), -1)))
    joined = up.join(own, "folder", "left").join(children, "folder", "left")
    return joined.select(F.col("folder").alias("path"), F.coalesce("title", name).alias("title"), F.coalesce("children", F.array().cast("array<string>")).alias("children"), "pages", "keywords")


def document_roots(pages: DataFrame) -> DataFrame:
    """Distinct folders that hold a segment ``content``, whatever its case: the roots of help systems."""
    parts = F.split(F.col("path"), "/")
    at = F.array_position(F.transform(parts, F.lower), "content").cast("int")
    return pages.where(at > 0).select(F.when(at == 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(1))), "/")).alias("folder")).distinct()


def relink(links: DataFrame, structure: DataFrame, pages: DataFrame) -> DataFrame:
    """``links`` (``src, dst``) with the path that their target has now: a page's own, else the planned one, else none."""
    real = pages.where(~F.coalesce("placeholder", F.lit(False))).groupBy(F.col("url").alias("dst")).agg(F.max("path").alias("page_path"))
    planned = structure.groupBy(F.col("url").alias("dst")).agg(F.max("path").alias("planned_path"))
    both = real.join(planned, "dst", "full").select("dst", F.coalesce("page_path", "planned_path").alias("path"))
    return links.join(both, "dst", "left").select("src", "dst", "path", F.when(F.col("path").isNull(), "internal_unresolved").otherwise("internal").alias("kind"))
