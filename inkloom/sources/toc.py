"""Tables of contents of help systems: script files with a tree and chunks of titles."""

from __future__ import annotations

import ast
import re
from urllib.parse import quote, urljoin, urlsplit
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from inkloom.functions.html import squash
from inkloom.functions.urls import canonical

ENTRY = "title string, url string, fetch_url string, depth int, ord int, nav_path array<string>, nav_parent_url string"


def help_system_toc(xml: str) -> str:
    """The ``Toc`` attribute of a help system's root element."""
    found = ElementTree.fromstring(xml).attrib.get("Toc")
    if not found:
        raise ValueError("the help system names no table of contents")
    return found


def read_script(text: str) -> dict:
    """The object literal inside ``define(...)``; bare keys are quoted before it is read as a literal."""
    body = text[text.index("(") + 1 : text.rindex(")")]
    return ast.literal_eval(re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r"\1'\2':", body))


def chunk_titles(chunk: dict) -> dict[int, tuple[str, str]]:
    """Node id to ``(url, title)``; ids and titles of a URL go together by place."""
    return {i: (url, squash(t)) for url, own in chunk.items() for i, t in zip(own.get("i", []), own.get("t", []), strict=False)}


def root_url(url: str) -> str:
    """The address up to the segment ``content``, whatever its case; else the folder."""
    found = re.search(r"/content(?=/)", url, re.I)
    return url[: found.start() + 1] if found else url.rsplit("/", 1)[0] + "/"


def toc_fetch_url(url: str, path: list[str]) -> str:
    return f"{url}{'&' if '?' in url else '?'}TocPath={quote('|'.join([*path, '_____0']), safe='')}" if path else url


SOURCE_TYPES = ("auto", "generic", "madcap", "wikijs", "confluence")
STRUCTURE_MODES = ("auto", "toc", "links")


def uses_toc(source_type: str = "auto", structure_mode: str = "auto") -> bool:
    """Whether a mirror goes by a help system's table of contents; unknown names are errors."""
    if source_type not in SOURCE_TYPES or structure_mode not in STRUCTURE_MODES:
        raise ValueError(f"unknown source type or structure mode: {source_type}, {structure_mode}")
    return source_type == "madcap" or source_type == "auto" and structure_mode != "links"


def flatten(tree: dict, titles: dict[int, tuple[str, str]], base: str, start: str | None = None, scope: str = "subtree") -> list[tuple]:
    """Pre-order entries of the tree, or of the part below the node whose address is ``start``, in canonical form.

    All of it is taken for a start that is a main page or no node's, and for a scope other than a subtree.  A node
    without an address of its own has that of the root.
    """
    out: list[tuple] = []
    main = start is not None and re.fullmatch(r"main_page\.x?html?", urlsplit(start).path.rpartition("/")[2].lower()) is not None
    wanted = canonical(start) if start and scope == "subtree" and not main else None

    def node(n: dict) -> tuple[str, str]:
        url, title = titles.get(n["i"], ("", f"#{n['i']}"))
        return canonical(urljoin(base, url.lstrip("/"))), title

    def find(nodes: list[dict]) -> dict | None:
        for n in nodes:
            hit = n if node(n)[0] == wanted else find(n.get("n", []))
            if hit:
                return hit
        return None

    top = tree.get("n", [])
    hit = find(top) if wanted else None
    stack = [(n, [], "") for n in reversed([hit] if hit else top)]
    while stack:
        n, above, parent = stack.pop()
        url, title = node(n)
        path = [*above, title]
        out.append((title, url, toc_fetch_url(url, path), len(above), len(out) + 1, path, parent or None))
        stack += [(k, path, url) for k in reversed(n.get("n", []))]
    return out


def toc_entries(spark: SparkSession, xml: str, scripts: dict[str, str], base: str, start: str | None = None, scope: str = "subtree") -> tuple[DataFrame, str | None]:
    """``(entries, problem)`` from the texts of one table of contents; whatever is wrong with them gives no entries."""
    try:
        toc = read_script(scripts[help_system_toc(xml).rsplit("/", 1)[-1]])
        titles: dict[int, tuple[str, str]] = {}
        for k in range(int(toc["numchunks"])):
            titles |= chunk_titles(read_script(scripts[f"{toc['prefix']}{k}.js"]))
        return spark.createDataFrame(flatten(toc["tree"], titles, base, start, scope), ENTRY), None
    except (KeyError, ValueError, SyntaxError, ElementTree.ParseError) as e:
        return spark.createDataFrame([], ENTRY), f"madcap_toc_unavailable: {e}"
