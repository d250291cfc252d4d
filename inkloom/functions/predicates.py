"""Predicates on URLs and paths, and small texts, all as Column expressions that push down where they can."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions.media import IMAGE_SUFFIXES
from inkloom.functions.urls import HTML_SUFFIXES, url_host, url_path

# Fixed values.
SERVICE_ENDS = ("...", "login", "logout", "signin", "sign-in", "auth", "register")
SERVICE_PARTS = ("_profile", "_settings")
PLACEHOLDER_NOTE = "Раздел ожидает отдельного зеркалирования."
PLACEHOLDER_SOURCE = "Источник: "


def _parts(url: Column | str) -> Column:
    return F.filter(F.transform(F.split(url_path(url), "/"), lambda p: F.lower(F.trim(p))), lambda p: p != "")


def is_html(url: Column | str) -> Column:
    return F.lower(url_path(url)).rlike(r"\.(" + "|".join(HTML_SUFFIXES) + ")$")


def is_html_candidate(url: Column | str) -> Column:
    """No suffix, or one of HTML."""
    return ~F.element_at(F.split(url_path(url), "/"), -1).rlike(r"[^.]\.[^.]+$") | is_html(url)


def is_main_page(url: Column | str) -> Column:
    return F.coalesce(F.try_element_at(_parts(url), F.lit(-1)).rlike(r"^main_page\.x?html?$"), F.lit(False))


def is_service(url: Column | str) -> Column:
    parts = _parts(url)
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return last.isin(*SERVICE_ENDS) | (F.size(parts) == 1) & last.isin("t", "tags") | F.arrays_overlap(parts, F.array(*map(F.lit, SERVICE_PARTS)))


def is_service_href(href: Column) -> Column:
    """Empty, a pure fragment, dots, or a service path."""
    text = F.trim(href)
    return (text == "") | F.startswith(text, F.lit("#")) | text.rlike(r"^(\.\.\.|…)") | is_service(text)


def is_section_landing(url: Column | str) -> Column:
    """After ``content``: a single part, or a page named as its folder, or one ending in ``_toc``."""
    parts = _parts(url)
    tail = F.slice(parts, F.array_position(parts, "content").cast("int") + 1, F.lit(1000))
    stem = F.regexp_replace(F.coalesce(F.try_element_at(tail, F.lit(-1)), F.lit("")), r"\.[^.]+$", "")
    return (F.size(tail) == 1) | (stem == F.coalesce(F.try_element_at(tail, F.lit(-2)), F.lit("/"))) | F.endswith(stem, F.lit("_toc"))


def is_placeholder_candidate(url: Column | str, root: str) -> Column:
    return (url_host(url) == url_host(F.lit(root))) & is_html(url) & ~is_main_page(url)


def allowed_prefixes(root: str, scope: str = "subtree", extra: tuple[str, ...] = ()) -> list[str]:
    """Prefixes a crawl may follow: for a page without suffix itself and what is below, else its folder; for a whole domain the extra ones only."""
    if scope == "domain":
        return list(extra)
    tail = root.rsplit("/", 1)[-1]
    return [*([root.rsplit("/", 1)[0] + "/"] if "." in tail else [root, root.rstrip("/") + "/"]), *extra]


def is_allowed(url: Column | str, root: str, scope: str = "subtree", extra: tuple[str, ...] = (), include_external: bool = False) -> Column:
    column = F.col(url) if isinstance(url, str) else url
    prefixes = allowed_prefixes(root, scope, extra)
    inside = F.lit(True) if scope == "domain" else reduce(lambda a, b: a | b, [F.startswith(column, F.lit(p)) for p in prefixes])
    return ~is_service(column) & F.when(url_host(column) != url_host(F.lit(root)), F.lit(include_external)).otherwise(inside)


def in_folder(path: Column, folder: Column) -> Column:
    """Whether a path lies in a folder, part by part; ``.`` holds everything."""
    return (folder == ".") | (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def in_scopes(path: Column, scopes: list[str]) -> Column:
    """Never for the root itself."""
    return (path != ".") & reduce(lambda a, b: a | b, [in_folder(path, F.lit(s)) for s in scopes], F.lit(False))


def is_above_scope(folder: Column, scopes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [(folder == ".") & F.lit(s != ".") | F.startswith(F.lit(s), F.concat(folder, F.lit("/"))) for s in scopes], F.lit(False))


def is_local(reference: Column) -> Column:
    return ~reference.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | reference.rlike(r"(?i)^file:")


def is_image(target: Column) -> Column:
    return F.lower(F.regexp_replace(target, r"[#?].*$", "")).rlike("(" + "|".join(s.replace(".", r"\.") for s in IMAGE_SUFFIXES) + ")$")


def markdown_images(text: Column) -> Column:
    """Distinct image targets of a text in order, those of images inside links too."""
    targets = F.regexp_extract_all(text, F.lit(r"\]\(([^()\s]+)\)"), F.lit(1))
    return F.array_distinct(F.filter(targets, is_image))


def breadcrumb_path(text: Column) -> Column:
    """Parts of the first line with text if it is a breadcrumb, links reduced to their labels; else null."""
    line = F.regexp_extract(text, r"^\s*([^\n]+)", 1)
    parts = F.transform(F.split(F.regexp_replace(line, r"\[([^\]]*)\]\([^)]*\)", "$1"), " > "), lambda p: F.trim(p))
    return F.when(F.contains(line, F.lit(" > ")), F.filter(parts, lambda p: p != ""))


def page_title(title: Column | str, text: Column | str) -> Column:
    """A page's title, else its first title heading; null if both are empty."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^#[ \t]+([^\n]+)", 1))
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(F.trim(title)), filled(heading))


def placeholder_body(title: Column, url: Column) -> Column:
    return F.format_string(f"# %s\n\n{PLACEHOLDER_NOTE}\n\n{PLACEHOLDER_SOURCE}%s\n", title, url)


def asset_path(page: Column, source: Column) -> Column:
    """A page's asset beside it: stem, short hash, suffix; the assets of index files lie in their folder."""
    name = F.regexp_extract(F.regexp_replace(source, r"[#?].*$", ""), r"([^/]*)$", 1)
    suffix = F.regexp_extract(name, r"[^.](\.[^.]+)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(suffix))
    folder = F.when(page.rlike(r"(^|/)_index\.md$"), F.regexp_replace(page, r"_index\.md$", "")).otherwise(F.concat(F.regexp_replace(page, r"\.md$", ""), F.lit("/")))
    return F.concat(folder, stem, F.lit("-"), F.substring(F.sha2(source, 256), 1, 12), suffix)


def searchable_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, text`` of the Markdown and YAML files of a mirror, assets aside."""
    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.where(F.lower("path").rlike(r"\.(md|ya?ml)$") & ~F.contains("path", F.lit("/_assets/")))
