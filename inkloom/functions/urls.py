"""URL scalar functions as Column expressions.

Everything here stays in the JVM: percent-decoding and re-encoding go through the engine's own codec, with the few
characters on which it differs from RFC 3986 path quoting patched before and after.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote, unquote, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Already in canonical form: nothing to decode, lower or cut.
_CLEAN = r"^https?://[a-z0-9.:\-]+(/[A-Za-z0-9_.~:@\-]+)+$"
HTML_SUFFIXES = ("html", "htm", "xhtml")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _decode(value: Column) -> Column:
    """Percent-decode; a stray ``%`` and every ``+`` stay as they are."""
    guarded = F.replace(F.regexp_replace(value, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(guarded), value)


def _encode(value: Column) -> Column:
    """Percent-encode as UTF-8, leaving ``/ : @`` and the unreserved characters."""
    out = F.url_encode(value)
    for coded, plain in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%3A", ":"), ("%40", "@"), ("%7E", "~")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def url_scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def url_path(url: Column | str) -> Column:
    """The raw path, without parameters, query and fragment."""
    path = F.regexp_extract(_col(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def canonical_url(url: Column | str) -> Column:
    """Lower-case scheme and host, path unquoted and requoted, no query, fragment or trailing slash.

    An empty path becomes ``/``.  Null stays null.  URLs that are canonical already skip all the work.
    """
    raw = F.regexp_replace(F.trim(_col(url)), r"[\t\r\n]", "")
    path = url_path(raw)
    path = F.when(path == "", F.lit("/")).otherwise(_encode(_decode(path)))
    path = F.when(path == "/", path).otherwise(F.regexp_replace(path, r"/+$", ""))
    scheme, host = url_scheme(raw), url_host(raw)
    built = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(raw.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"), F.concat(F.lit("//"), host)).otherwise(""),
        path,
    )
    return F.when(_col(url).rlike(_CLEAN), _col(url)).otherwise(built)


def canonical(url: str) -> str:
    """``canonical_url`` of one value, for driver-side code and batch functions."""
    parts = urlsplit("".join(c for c in url.strip() if c not in "\t\r\n"))
    folder, slash, last = parts.path.rpartition("/")
    path = quote(unquote(folder + slash + last.partition(";")[0]), safe="/:@")
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), path.rstrip("/") or "/", "", ""))


def is_url(value: Column | str) -> Column:
    return _col(value).rlike(r"(?i)^https?:")


def same_domain(url: Column | str, root: Column | str) -> Column:
    return url_host(url) == url_host(root)


def slugify(value: Column | str) -> Column:
    """Lower-case Latin and Cyrillic letters, digits and ``. _ -``; everything else becomes one dash."""
    low = F.lower(F.trim(_decode(_col(value))))
    low = F.regexp_replace(low, r"[^a-z0-9а-яё._\-]+", "-")
    low = F.regexp_replace(low, r"^[\-._]+|[\-._]+$", "")
    return F.when(low == "", F.lit("index")).otherwise(low)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def markdown_relpath(url: Column | str) -> Column:
    """Path of a page's Markdown file: ``a/b.html`` gives ``a/b.md``, ``a/b`` gives ``a/b/_index.md``."""
    page_id = F.regexp_extract(_col(url), r"(?i)[?&]pageid=([^&#]+)", 1)

    def named(last: Column) -> Column:
        suffix = F.regexp_extract(last, r"[^.](\.[^.]+)$", 1)
        stem = slugify(F.substring(last, F.lit(1), F.length(last) - F.length(suffix)))
        wiki_page = (last == "viewpage.action") & (page_id != "")
        file = F.when(wiki_page, F.concat(stem, F.lit("-"), slugify(page_id), F.lit(".md"))).otherwise(F.concat(stem, F.lit(".md")))
        return F.when(suffix != "", file).otherwise(F.concat(last, F.lit("/_index.md")))

    def placed(slugs: Column) -> Column:
        folder = F.slice(slugs, 1, F.greatest(F.size(slugs) - 1, F.lit(0)))
        return F.when(F.size(slugs) == 0, F.lit("_index.md")).otherwise(F.array_join(F.concat(folder, F.array(let(F.try_element_at(slugs, F.lit(-1)), named))), "/"))

    parts = F.filter(F.split(_decode(url_path(canonical_url(url))), "/"), lambda p: p != "")
    return let(F.transform(parts, slugify), placed)


def short_hash(value: Column | str) -> Column:
    return F.substring(F.sha2(_col(value), 256), 1, 12)


def content_hash(value: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(_col(value), 256))


def confluence_url(url: Column | str) -> Column:
    """Canonical URL that keeps the first page id of a ``viewpage.action`` address."""
    page_id = F.regexp_extract(_col(url), r"(?i)[?&]pageid=([^&#]+)", 1)
    keep = url_path(url).rlike(r"(?i)(^|/)viewpage\.action$") & (page_id != "")
    return F.when(keep, F.concat(canonical_url(url), F.lit("?pageId="), page_id)).otherwise(canonical_url(url))


def with_language_prefix(url: Column | str, root: Column | str) -> Column:
    """Put the root's two-letter first segment before a target of the same host that lacks it."""

    def prefixed(target: Column) -> Column:
        def built(both: Column) -> Column:
            mine, theirs = both["mine"], both["theirs"]
            lang, tail, mine_tail = F.get(theirs, 0), F.array_join(F.slice(theirs, 2, F.lit(1000)), "/"), F.array_join(mine, "/")
            under = (tail == "") | (mine_tail == tail) | F.startswith(mine_tail, F.concat(tail, F.lit("/")))
            fits = (F.length(lang) == 2) & (F.size(mine) > 0) & (F.lower(F.get(mine, 0)) != F.lower(lang)) & under
            return F.when(F.coalesce(fits, F.lit(False)), F.concat(url_scheme(target), F.lit("://"), url_host(target), F.lit("/"), lang, F.lit("/"), mine_tail)).otherwise(target)

        segments = lambda u: F.filter(F.split(url_path(u), "/"), lambda p: p != "")
        pair = F.struct(segments(target).alias("mine"), segments(canonical_url(root)).alias("theirs"))
        # Only roots with a first segment of two letters have a language.
        spoken = F.coalesce((url_host(target) == url_host(root)) & url_path(root).rlike(r"^/+[^/]{2}(/|$)"), F.lit(False))
        return F.when(spoken, let(pair, built)).otherwise(target)

    return let(canonical_url(url), prefixed)


def toc_path(url: Column | str) -> Column:
    """Titles in the ``TocPath`` query key, split at bars; filler parts starting with five underscores drop out."""
    raw = F.regexp_extract(_col(url), r"(?i)[?&]tocpath=([^&#]*)", 1)
    decoded = F.try_url_decode(F.regexp_replace(raw, r"%(?![0-9A-Fa-f]{2})", "%25"))
    parts = F.transform(F.split(F.coalesce(decoded, raw), r"\|"), lambda p: F.trim(_decode(p)))
    return F.filter(parts, lambda p: (p != "") & ~F.startswith(p, F.lit("_____")))
