"""Wiki documents: the content of a page, with plain tables as pipes and others as blocks, its links and images."""

from __future__ import annotations

import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.html import SILENT, Node, _Writer, parse_tree, squash, table_markdown, table_rows, wiki_body
from inkloom.functions.markdown import code_mask, squeeze_blanks
from inkloom.functions.recover import block_table
from inkloom.functions.urls import canonical

# What a cell of a plain table doesn't hold.  Fixed values.
NOT_PLAIN = frozenset({"table", "pre", "blockquote", "ul", "ol", "li", "div", "p"})


def canonical_page(url: str) -> str:
    """An address in canonical form; one that shows a page by its id keeps the id."""
    page_id = re.search(r"(?i)[?&]pageid=([^&#]+)", url)
    made = canonical(url)
    return f"{made}?pageId={page_id[1]}" if page_id and made.lower().endswith("viewpage.action") else made


def is_plain(table: Node) -> bool:
    """Whether a table has neither spans nor anything but running text in its cells."""
    cells = [n for n in table.walk() if n.tag in ("td", "th")]
    return not any(c.attrs.get("rowspan") or c.attrs.get("colspan") for c in cells) and not any(x.tag in NOT_PLAIN for c in cells for x in c.walk() if x is not c)


class _WikiWriter(_Writer):
    """Markdown of wiki content: tables in their own ways, addresses with their page ids."""

    def element(self, n: Node, depth: int, pre: bool) -> str:
        if n.tag != "table":
            return super().element(n, depth, pre)
        if not is_plain(n):
            spans = any(r or c for row in table_rows(n) for _, _, r, c in row)
            return f"\n\n{table_markdown(n) if spans else block_table(n)}\n\n"
        rows = [[self.cell(c) for c in row.children if isinstance(c, Node) and c.tag in ("td", "th")] for row in n.walk() if row.tag == "tr"]
        rows = [row for row in rows if row]
        if not rows:
            return ""
        width = max(map(len, rows))
        lines = ["| " + " | ".join(row + [""] * (width - len(row))) + " |" for row in rows]
        return "\n\n" + "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) + "\n\n"

    def cell(self, n: Node) -> str:
        text = self.children(n, 0).replace("  \n", "<br>").replace("\n", " ")
        return squash(text).replace("|", "\\|")


def wiki_markdown(html: str, base: str = "") -> str:
    """The Markdown of a wiki page's content."""
    raw = _WikiWriter(base).children(wiki_body(parse_tree(html)), 0).split("\n")
    inside = code_mask(raw)
    return "\n".join(squeeze_blanks(x if code or x.lstrip().startswith("-") or x.startswith("   ") else x.lstrip(" ") for x, code in zip(raw, inside, strict=True))).strip() + "\n"


def _sounding(n: Node):
    yield n
    for c in n.children:
        if isinstance(c, Node) and c.tag not in SILENT:
            yield from _sounding(c)


def wiki_links(html: str, base: str = "") -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """``(address, text)`` of all links of the content, which count as internal, and ``(source, alt)`` of its images."""
    nodes = list(_sounding(wiki_body(parse_tree(html))))
    links = []
    for n in nodes:
        if n.tag == "a" and n.attrs.get("href", "").strip():
            full = urljoin(base, n.attrs["href"].strip())
            url = canonical_page(full) if re.match(r"(?i)https?:", full) else full
            links.append((url, " ".join(n.text().split()) or url))
    return links, [(urljoin(base, n.attrs["src"].strip()), n.attrs.get("alt", "")) for n in nodes if n.tag == "img" and n.attrs.get("src", "").strip()]


WIKI = T.StructType([
    T.StructField("markdown", T.StringType()),
    T.StructField("links", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("url", "text")]))),
    T.StructField("images", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("source", "alt")]))),
])


def wiki_column(html: Column, base: Column) -> Column:
    """Markdown, links and images of wiki pages in one struct, in Arrow batches; null HTML gives nulls."""

    @F.pandas_udf(WIKI)
    def run(values: pd.Series, at: pd.Series) -> pd.DataFrame:
        rows = []
        for value, url in zip(values, at, strict=True):
            if value is None:
                rows.append((None, None, None))
                continue
            links, images = wiki_links(value, url or "")
            rows.append((wiki_markdown(value, url or ""), [{"url": u, "text": t} for u, t in links], [{"source": s, "alt": a} for s, a in images]))
        return pd.DataFrame(rows, columns=["markdown", "links", "images"])

    return run(html, base)
