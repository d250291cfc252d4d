"""URL, Markdown, HTML and media functions on hand-made cases."""

import struct

import pytest
from pyspark.sql import functions as F

from inkloom.functions import html as H
from inkloom.functions import markdown as M
from inkloom.functions import media as A
from inkloom.functions import urls as U
from inkloom.functions import wiki as W

URLS = [
    ("HTTPS://Docs.Example.COM/a/b%2Dc/?q=1#x", "https://docs.example.com/a/b-c"),
    ("https://h.test", "https://h.test/"),
    ("https://h.test/a b+c", "https://h.test/a%20b+c".replace("+", "%2B")),
    ("https://h.test/%D1%84/ж", "https://h.test/%D1%84/%D0%B6"),
    ("https://h.test/a;p=1?x", "https://h.test/a"),
    ("https://h.test/100%", "https://h.test/100%25"),
    ("https://h.test/x~y:z@w", "https://h.test/x~y:z@w"),
    (None, None),
]


def test_canonical_urls(spark):
    rows = spark.createDataFrame([(u,) for u, _ in URLS], "u string").select(U.canonical_url("u")).collect()
    assert [r[0] for r in rows] == [w for _, w in URLS]
    assert [U.canonical(u) for u, _ in URLS if u] == [w for u, w in URLS if u]


def test_paths_and_slugs(spark):
    df = spark.createDataFrame([("https://h.test/",), ("https://h.test/Guide/My Page.html",), ("https://h.test/a/b",), ("https://h.test/p/x.pdf",), ("https://w.test/pages/viewpage.action?pageId=7",)], "u string")
    got = [r[0] for r in df.select(U.markdown_relpath("u")).collect()]
    assert got == ["_index.md", "guide/my-page.md", "a/b/_index.md", "p/x.md", "pages/viewpage-7.md"]
    one = spark.range(1).select(
        U.slugify(F.lit(" Ёж & Co. ")), U.confluence_url(F.lit("https://w.test/pages/viewpage.action?x=1&PageId=9")), U.with_language_prefix(F.lit("https://h.test/doc/a"), F.lit("https://h.test/ru/doc")),
        U.toc_path(F.lit("https://h.test/a?TocPath=One%7CTwo%20b%7C_____3")),
    ).first()
    assert tuple(one) == ("ёж-co", "https://w.test/pages/viewpage.action?pageId=9", "https://h.test/ru/doc/a", ["One", "Two b"])


@pytest.mark.parametrize(
    ("given", "wanted"),
    [
        ("# A\n\n\n\ntext  \n", "# A\n\ntext\n"),
        ("# A\n\nSettings\n\nx\n", "# A\n\nx\n"),
        ("- [a](1)\n- [b](2)\n- [c](3)\n- [d](4)\n- [e](5)\n\n# A\n\nx\n", "# A\n\nx\n"),
        ("# A\n\n<p>one</p>\n<p>two</p>\n", "# A\n\n```html\n<p>one</p>\n<p>two</p>\n```\n"),
        ("# A\n\nCopy\n```\nSettings-1\n```\n", "# A\n\n```\nSettings-1\n```\n"),
        ("# [¶](#a) **A**\n\n# A\n\nx\n", "# A\n\nx\n"),
        ("## 🔗 # A *b*\n\nx\n", "## A *b*\n\nx\n"),
        ("# A\n\n- Все разделы\n\nx\n", "# A\n\nx\n"),
        ("# A\n\ntext\n\nПравовая информация\n© 2021 X. Все права защищены\n", "# A\n\ntext\n"),
        ("# A\n\nx\n<image src=\"i\"/>\ny\n[image:i]\nz\n", "# A\n\nx\n\n<image src=\"i\"/>\n\ny\n[image:i]\nz\n"),
        ("# A\n\ntransparent\n[a](b)\n\n# B\n\nx\n", "# B\n\nx\n"),
        ("# A\n\n```\nДалее >> x\n[](u)\n```\n", "# A\n\n```\nДалее >> x\n[](u)\n```\n"),
        ("# A\n\ntext\n\n## Support\n© 2020 X. All rights reserved.\n", "# A\n\ntext\n"),
        ("# A\n\nx\nx\n\ny [](z)  w\n", "# A\n\nx\n\ny w\n"),
        ("# A\n\n###### [Back](/up)\n\nДалее >> B\n\nx\n", "# A\n\nx\n"),
        ("", "\n"),
    ],
)
def test_normalise(given, wanted):
    assert M.normalize_markdown(given) == wanted
    assert M.normalize_markdown(wanted) == wanted


def test_contents_blocks_and_mojibake():
    text = "# A\n\n- [One](#one)\n- [Two](#two)\n\n## One\n\nx\n"
    assert M.normalize_markdown(text, anchors={"one": "One", "two": "Two"}) == "# A\n\n## One\n\nx\n"
    assert M.repair_mojibake("cafÃ© â€“ Â½") == "café – ½"
    assert M.repair_mojibake("Âé Ñ") == "Âé Ñ"


def test_html_document():
    page = (
        "<html><head><title>T &amp; U</title><meta name=description content='D d'></head><body><h1>Head<br>line</h1><p>One <b>two</b> <a href='/x'>three</a><p>four"
        "<ul><li>a<ul><li>b</ul><li>c</ul><pre>x\n  y</pre><script>no</script><table><tr><th>k<th>v<tr><td>1<td>a|b</table><img src=i.png alt=I></body></html>"
    )
    got = H.parse_document(page, "https://h.test/d/")
    assert got["title"] == "T & U" and got["description"] == "D d" and got["links"] == ["https://h.test/x"]
    assert got["assets"] == [{"source": "https://h.test/d/i.png", "kind": "images", "alt": "I"}]
    md = got["markdown"]
    assert md.startswith("# Head line\n\nOne **two** [three](https://h.test/x)\n\nfour") and "- a\n  - b\n- c" in md
    assert "```\nx\n  y\n```" in md and "| k | v |\n| --- | --- |\n| 1 | a\\|b |" in md and "no" not in md.split()


def test_html_headings_tables_and_wiki():
    root = H.parse_tree("<a name=q></a><h2 id=w>Two</h2><p>After the heading comes a paragraph that is rather long indeed, is it not</p><p class=H3>Three</p><ul class=TOC><li><a href='#w'>Two</a></ul>")
    found = H.headings(root)
    assert [(h[0], h[1], h[2]) for h in found] == [(2, "Two", ["q", "w"]), (3, "Three", [])]
    assert found[0][3] == "After the heading comes a paragraph that is rather long" and H.anchor_headings(root) == {"q": "Two", "w": "Two"} and H.toc_labels(root) == ["Two"]
    assert H.promote_headings("Two\n\n```\nTwo\n```\n#### three", found) == "## Two\n\n```\nTwo\n```\n### three"
    span = H.parse_tree("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c</td></tr></table>").children[0]
    assert '<td rowspan="2">a</td>' in H.table_markdown(span)
    assert H.column_widths([["x" * 80, "y"], ["a", "b"]]) == [512, 256]
    wiki = H.parse_tree("<div class=wiki-content>no</div><main id=main-content><div class='wiki-content x'>yes</div></main>")
    assert H.wiki_body(wiki).text() == "yes"


def test_wiki_documents(spark):
    page = (
        "<p>out</p><div id=main-content><div class='wiki-content'><h1>T</h1><p>a <a href='/pages/viewpage.action?x=1&pageId=7'>L  l</a><img src=i.png alt=I></p>"
        "<table><tr><th>k</th><th>v</th></tr><tr><td>1<br>2</td><td><b>a|b</b></td><td>x</td></tr></table><table><tr><td><ul><li>q</li></ul></td></tr></table><table><tr><td rowspan=2>s</td></tr></table><script>no</script></div></div>"
    )
    md = W.wiki_markdown(page, "https://w.test/d/")
    assert md.startswith("# T\n\na [L l](https://w.test/pages/viewpage.action?x=1&pageId=7)![I](https://w.test/d/i.png)\n\n| k | v |  |\n| --- | --- | --- |\n| 1<br>2 | **a\\|b** | x |\n")
    assert '{% table header="row" %}' in md and "   - q" in md and '<td rowspan="2">s</td>' in md and "out" not in md and "no" not in md.split()
    assert W.wiki_links(page, "https://w.test/d/") == ([("https://w.test/pages/viewpage.action?pageId=7", "L l")], [("https://w.test/d/i.png", "I")])
    rows = spark.createDataFrame([(page, "https://w.test/d/"), (None, None)], "h string, b string").select(W.wiki_column(F.col("h"), F.col("b")).alias("d")).select("d.markdown", "d.links.url").collect()
    assert rows[0].markdown == md and rows[0].url == ["https://w.test/pages/viewpage.action?pageId=7"] and rows[1].markdown is None
    assert W.wiki_markdown("") == "\n"


def test_html_column(spark):
    df = spark.createDataFrame([("<h1>A</h1><p>x",), (None,)], "h string").select(H.parse_column(F.col("h"), F.lit("https://h.test/")).alias("d")).select("d.title", "d.markdown")
    assert [tuple(r) for r in df.collect()] == [("A", "# A\n\nx\n"), (None, None)]


def test_media():
    assert A.image_size(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 4)) == (3, 4) and A.image_size(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6)
    assert A.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x07\x00\x08\x01\x00\x00") == (8, 7) and A.image_size(b"\xff\xd8\xff") is None and A.image_size(b"") is None
    assert A.render_image("i", "", 20, 30) == '<image src="i" crop="0,0,100,100" width="20px" height="30px" float="left"/>'
    assert A.render_image("i", "", 20, 90) == '\n\n<image src="i" crop="0,0,100,100" scale="100" width="20px" height="90px" float="center"/>\n\n' == A.render_image("i", "", 20, 90, None)
    assert 'scale="50" width="500px" height="2px"' in A.render_image("i", "", 1000, 5, max_width=500) and A.render_image("i", "a", 20, 30, html=False) == "![a](i)"
    assert A.render_image("i", "", None, None) == '\n\n<image src="i" float="center"/>\n\n' == A.render_image("i", "", 60, 60, sizes=False)
    assert A.is_image_target("a.TIFF#x") and not A.is_image_target("a.ico") and not A.is_image_target("a.avif")
    assert A.humanise("release_notes-3d") == "Release Notes 3D" and A.is_image_target("a/b.PNG?x")
    data = {"pages": [{"path": "a", "n": 3, "tags": [], "ok": True, "none": None, "kids": ["x", 'y"\n\\']}], "empty": {}, "s": "true"}
    assert A.from_yaml(A.to_yaml(data)) == data and A.to_yaml({"a": [{"b": 1}, "c"], "d": []}) == 'a:\n  -\n    b: 1\n  - "c"\nd:\n  []\n'
    assert A.from_yaml("a:\n  - b: 1\n    c: 2\n  - d\n") == {"a": [{"b": 1, "c": 2}, "d"]}
