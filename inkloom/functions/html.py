"""HTML documents to Markdown, links, headings and tables: one parse of a document gives everything.

A document becomes a small tree; void elements never nest, so an unclosed ``br`` or ``img`` swallows nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkloom.functions.markdown import code_mask, repair_mojibake, squeeze_blanks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset({"script", "style", "noscript", "svg"})
BLOCKS = frozenset("p div section article main header footer nav aside ul ol li table tr blockquote h1 h2 h3 h4 h5 h6 pre figure form".split())
AUTO_CLOSE = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def walk(self):
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.walk()

    def text(self) -> str:
        if self.tag in SILENT:
            return ""
        return "".join(c if isinstance(c, str) else " " if c.tag == "br" else c.text() for c in self.children)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        closes, at = AUTO_CLOSE.get(tag, set()), 0
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in closes:
                at = i
            elif self.open[i].tag in ("ul", "ol", "table", "div", "body"):
                break
        if at:
            del self.open[at:]
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse_tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def squash(text: str) -> str:
    return " ".join(repair_mojibake(text).replace("\u00a0", " ").split())


def heading_level(node: Node) -> int:
    """Of h1 to h6, and of paragraphs and boxes styled as such."""
    if re.fullmatch(r"h[1-6]", node.tag):
        return int(node.tag[1])
    if node.tag in ("p", "div"):
        return next((int(c[1]) for c in node.classes() if re.fullmatch(r"[Hh][1-6]", c)), 0)
    return 0


def document_title(root: Node) -> str:
    """The first of the title and the h1 that isn't empty."""
    for tag in ("title", "h1"):
        for node in root.walk():
            if node.tag == tag and (text := squash(unescape(node.text()))):
                return text
    return ""


def description(root: Node) -> str:
    return next((squash(n.attrs.get("content", "")) for n in root.walk() if n.tag == "meta" and n.attrs.get("name", "").lower() == "description"), "")


class _Writer:
    def __init__(self, base: str):
        self.base, self.links, self.assets = base, [], []

    def join(self, url: str) -> str:
        return urljoin(self.base, url.strip())

    def asset(self, kind: str, url: str, alt: str = "") -> str:
        full = self.join(url)
        if not any(a[0] == full and a[1] == kind for a in self.assets):
            self.assets.append((full, kind, alt))
        return full

    def children(self, node: Node, depth: int, pre: bool = False) -> str:
        return "".join(self.inline(c, pre) if isinstance(c, str) else self.element(c, depth, pre) for c in node.children)

    @staticmethod
    def inline(text: str, pre: bool) -> str:
        return text if pre else re.sub(r"\s+", " ", text)

    def element(self, n: Node, depth: int, pre: bool) -> str:
        tag = n.tag
        if tag in SILENT or tag in ("title", "head") or tag in ("meta", "link"):
            return ""
        level = heading_level(n)
        if level:
            return f"\n\n{'#' * level} {squash(self.children(n, depth))}\n\n"
        if tag == "br":
            return "\n" if pre else "  \n"
        if tag == "pre":
            return f"\n\n```\n{self.children(n, depth, True).strip(chr(10))}\n```\n\n"
        if tag == "code" and not pre:
            return f"`{self.children(n, depth, True)}`"
        if tag in ("strong", "b", "em", "i") and not pre:
            inner, mark = self.children(n, depth), "**" if tag in ("strong", "b") else "*"
            return f"{mark}{inner.strip()}{mark}" if inner.strip() else inner
        if tag == "li":
            return f"\n{'  ' * max(depth - 1, 0)}- {self.children(n, depth).strip()}"
        if tag in ("ul", "ol"):
            return f"{self.children(n, depth + 1)}\n" + ("\n" if depth == 0 else "")
        if tag == "a":
            href, inner = n.attrs.get("href", "").strip(), self.children(n, depth)
            if not href:
                return inner
            full = self.join(href)
            self.links.append(full)
            return f"[{inner.strip() or full}]({full})"
        if tag == "img":
            src = n.attrs.get("src", "")
            return f"![{n.attrs.get('alt', '')}]({self.asset('images', src, n.attrs.get('alt', ''))})" if src else ""
        if tag in ("video", "audio"):
            kind = "videos" if tag == "video" else "files"
            for source in [n, *[c for c in n.children if isinstance(c, Node) and c.tag == "source"]]:
                if source.attrs.get("src"):
                    self.asset(kind, source.attrs["src"])
            return ""
        if tag == "iframe" and n.attrs.get("src"):
            full = self.asset("files", n.attrs["src"])
            return f"\n\n[{full}]({full})\n\n"
        if tag == "table":
            return f"\n\n{table_markdown(n)}\n\n"
        inner = self.children(n, depth, pre)
        return f"\n\n{inner}\n\n" if tag in ("p", "blockquote", "tr") else f"\n{inner}\n" if tag in BLOCKS else inner


def table_rows(node: Node) -> list[list[tuple[str, str, str, str]]]:
    """``text, tag, rowspan, colspan`` of the cells of a table, row by row, without those of tables inside."""

    def rows(n: Node):
        for c in n.children:
            if isinstance(c, Node) and c.tag != "table":
                if c.tag == "tr":
                    yield [(cell_text(x), x.tag, x.attrs.get("rowspan", ""), x.attrs.get("colspan", "")) for x in c.children if isinstance(x, Node) and x.tag in ("td", "th")]
                else:
                    yield from rows(c)

    return [r for r in rows(node) if r]


def cell_text(cell: Node) -> str:
    """A cell on lines: one for each block in it; a bullet alone goes with the line after it."""
    text = _Writer("").children(cell, 0)
    lines = [squash(x) for x in text.split("\n")]
    out: list[str] = []
    for line in (x for x in lines if x):
        if out and out[-1] in ("-", "*", "•"):
            out[-1] += " " + line
        else:
            out.append(line)
    return "\n".join(out)


def table_markdown(node: Node) -> str:
    """Pipes for plain tables; HTML with its spans where cells span or hold several lines."""
    rows = table_rows(node)
    if not rows:
        return ""
    spans = any(r or c for row in rows for _, _, r, c in row)
    if not spans and not any("\n" in t for row in rows for t, *_ in row):
        width = max(map(len, rows))
        lines = ["| " + " | ".join([t.replace("|", "\\|") for t, *_ in row] + [""] * (width - len(row))) + " |" for row in rows]
        return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]])
    cells = lambda row: "".join(f"<{t}{f' rowspan={chr(34)}{r}{chr(34)}' if r else ''}{f' colspan={chr(34)}{c}{chr(34)}' if c else ''}>{x}</{t}>" for x, t, r, c in row)
    return "<table>\n" + "\n".join(f"<tr>{cells(row)}</tr>" for row in rows) + "\n</table>"


def column_widths(rows: list[list[str]]) -> list[int]:
    """512 for columns with a cell of 80 characters or more, 256 for the others."""
    return [512 if any(len(r[i]) >= 80 for r in rows if i < len(r)) else 256 for i in range(max(map(len, rows), default=0))]


def headings(root: Node) -> list[tuple[int, str, list[str], str]]:
    """``level, text, anchors, snippet`` of the headings in order; the snippet is of the text that follows, up to 60 characters."""
    flat: list[tuple[str, object]] = []

    def visit(n: Node) -> None:
        for c in n.children:
            if isinstance(c, str):
                flat.append(("text", c))
            elif c.tag not in SILENT and c.tag not in ("title", "head"):
                level = heading_level(c)
                if level:
                    inner = [c, *[x for x in c.walk() if x is not c]]
                    flat.append(("head", (level, squash(c.text()), list(dict.fromkeys(a for x in inner for a in (x.attrs.get("id"), x.attrs.get("name")) if a)))))
                else:
                    if c.tag == "a" and not c.attrs.get("href") and (c.attrs.get("name") or c.attrs.get("id")):
                        flat.append(("anchor", c.attrs.get("name") or c.attrs.get("id")))
                    visit(c)
                    if c.tag in BLOCKS:
                        flat.append(("text", " "))

    visit(root)
    out, waiting = [], []
    for i, (kind, value) in enumerate(flat):
        if kind == "anchor":
            waiting.append(value)
        elif kind == "text" and str(value).strip():
            waiting = []
        elif kind == "head":
            level, text, own = value
            after = ""
            for k, v in flat[i + 1 :]:
                if k == "head" or len(after) > 80:
                    break
                after += str(v) if k == "text" else ""
            after = squash(after)
            out.append((level, text, [*waiting, *[a for a in own if a not in waiting]], after if len(after) <= 60 else after[:60].rpartition(" ")[0] or after[:60]))
            waiting = []
    return [h for h in out if h[1]]


def anchor_headings(root: Node) -> dict[str, str]:
    made: dict[str, str] = {}
    for _, text, anchors, _ in headings(root):
        for a in anchors:
            made.setdefault(a, text)
    return made


def toc_labels(root: Node) -> list[str]:
    """Distinct texts of fragment links inside lists of class TOC."""
    lists = [n for n in root.walk() if n.tag == "ul" and any(c.lower() == "toc" for c in n.classes())]
    return list(dict.fromkeys(squash(a.text()) for n in lists for a in n.walk() if a.tag == "a" and a.attrs.get("href", "").startswith("#") and squash(a.text())))


def promote_headings(markdown: str, found: list[tuple[int, str, list[str], str]]) -> str:
    """Lines that equal a source heading get its level, outside code."""
    levels: dict[str, int] = {}
    for level, text, *_ in found:
        levels.setdefault(text.casefold(), level)
    out, inside = [], False
    for line in markdown.split("\n"):
        inside ^= line.lstrip().startswith("```")
        text = squash(re.sub(r"^\s*#{1,6}\s+|^\s*\*\*(.+)\*\*\s*$", r"\1", line))
        out.append(f"{'#' * levels[text.casefold()]} {text}" if not inside and text.casefold() in levels else line)
    return "\n".join(out)


def wiki_body(root: Node) -> Node:
    """The wiki content inside the main content, else the first one, else everything."""
    main = next((n for n in root.walk() if n.attrs.get("id") == "main-content"), root)
    return next((n for n in main.walk() if "wiki-content" in n.classes()), next((n for n in root.walk() if "wiki-content" in n.classes()), root))


def parse_document(html: str, base: str = "") -> dict:
    root = parse_tree(html)
    writer = _Writer(base)
    raw = repair_mojibake(writer.children(root, 0)).split("\n")
    lines = squeeze_blanks([x if code or x.lstrip().startswith("-") else x.lstrip(" ") for x, code in zip(raw, code_mask(raw), strict=True)])
    return {
        "title": document_title(root), "description": description(root), "markdown": "\n".join(lines).strip() + "\n", "links": list(dict.fromkeys(writer.links)),
        "assets": [{"source": s, "kind": k, "alt": a} for s, k, a in writer.assets], "headings": [{"level": v, "text": t, "anchors": a, "snippet": s} for v, t, a, s in headings(root)],
        "toc_labels": toc_labels(root),
    }


DOCUMENT = T.StructType(
    [
        T.StructField("title", T.StringType()), T.StructField("description", T.StringType()), T.StructField("markdown", T.StringType()), T.StructField("links", T.ArrayType(T.StringType())),
        T.StructField("assets", T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("source", "kind", "alt")]))),
        T.StructField("headings", T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("anchors", T.ArrayType(T.StringType())), T.StructField("snippet", T.StringType())]))),
        T.StructField("toc_labels", T.ArrayType(T.StringType())),
    ]
)


def parse_column(html: Column, base: Column) -> Column:
    """Everything of a document in one struct, in Arrow batches; null HTML gives nulls."""
    names = DOCUMENT.fieldNames()

    @F.pandas_udf(DOCUMENT)
    def run(values: pd.Series, at: pd.Series) -> pd.DataFrame:
        parsed = [dict.fromkeys(names) if value is None else parse_document(value, url or "") for value, url in zip(values, at, strict=True)]
        return pd.DataFrame(parsed, columns=names)

    return run(html, base)
