"""Layout from a saved structure and an earlier catalog, and link rewriting."""

import pytest
from pyspark.sql import functions as F

from inkloom.operators import rewrite as R
from inkloom.operators import structure as S

PAGES = "url string, title string, depth int, nav_path array<string>, parent string, placeholder boolean, markdown string"
ENTRIES = "url string, title string, depth int, nav_path array<string>, parent string, fetch_url string, path string, ord long"
EARLIER = "url string, path string, nav_path array<string>, placeholder boolean, ord long"
U = "https://h.test/"


@pytest.fixture
def frames(spark):
    pages = spark.createDataFrame([(U + "a", "A", 5, [], None, False, "x"), (U + "z", "Z", 1, ["Docs", "Z"], None, None, "y")], PAGES)
    entries = [(U + "top", "Top", 0, ["Top"], None, None, "top/_index.md", 1), (U + "a", "A?", 1, ["Top", "A"], U + "top", None, "top/a.md", 2), (U + "new", "", None, ["Top", "New"], U + "top", U + "new?x", "top/new.md", 3), (U + "far", "Far", 1, ["Far"], None, None, "far/far.md", 4), (U + "no", "No", 1, [], None, None, None, 5), (None, "N", 1, ["N"], None, None, None, 6)]
    earlier = spark.createDataFrame([(U + "a", "old/a.md", ["A"], False, 1), (U + "gone", "old/gone.md", [], False, 2), (U + "z", "zed/z.md", [], False, 3), (None, None, None, None, 4), (U + "docs", "docs/_index.md", ["Docs"], False, 5)], EARLIER)
    return pages, spark.createDataFrame(entries, ENTRIES), earlier


def test_overlay(spark, frames):
    pages, entries, earlier = frames
    got = {r.url: r for r in S.overlay(pages, entries, earlier.limit(0)).collect()}
    assert set(got) == {U + x for x in ("a", "z", "top", "new", "far")}
    assert (got[U + "a"].depth, got[U + "a"].nav_path, got[U + "a"].parent, got[U + "a"].ord) == (1, ["Top", "A"], U + "top", 2) and got[U + "a"].title == "A"
    assert (got[U + "z"].depth, got[U + "z"].ord, got[U + "z"].placeholder) == (1, 7, False)
    new = got[U + "new"]
    assert new.placeholder and new.title == "New" and new.depth == 0 and new.markdown.endswith(f": {U}new?x\n")
    mirrored = earlier.limit(0).unionByName(spark.createDataFrame([(U + "far", "f.md", [], False, 1)], EARLIER))
    assert U + "far" not in {r.url for r in S.overlay(pages, entries, mirrored).collect()}
    scoped = {r.url for r in S.overlay(pages, entries, earlier.limit(0), spark.createDataFrame([("far",)], "folder string")).collect()}
    assert scoped == {U + x for x in ("a", "z", "top", "far")}  # above a page, or in the scope
    assert S.overlay(pages.limit(0), entries.limit(0), earlier.limit(0)).count() == 0


def test_ancestors_end_on_cycles(spark, frames):
    pages, _, _ = frames
    loop = spark.createDataFrame([(U + "a", U + "b", 1), (U + "b", U + "c", 2), (U + "c", U + "b", 3)], "url string, parent string, ord long")
    assert {r.url for r in S.structure_ancestors(pages, loop).collect()} == {U + "b", U + "c"}
    assert S.structure_ancestors(pages, loop.limit(0)).count() == 0


def test_paths(frames):
    pages, entries, earlier = frames
    got = {r.url: r.path for r in S.page_paths(pages, entries, earlier).collect()}
    assert got == {U + "a": "top/a.md", U + "z": "docs/z/_index.md"}  # the structure's; below the page that the way leads through
    assert {r.url: r.path for r in S.page_paths(pages, entries.limit(0), earlier).collect()}[U + "a"] == "old/a.md"
    assert {r.url: r.path for r in S.page_paths(pages, entries.limit(0), earlier.limit(0)).collect()}[U + "a"] == "a/_index.md"
    now = S.page_paths(pages, entries, earlier)
    assert {r.url for r in S.merge_paths(now, earlier).collect()} == {U + "a", U + "z", U + "docs"}
    assert sorted(r.path for r in S.relocated_paths(earlier, now).collect()) == ["old/a.md", "zed/z.md"]


def test_stale_and_scopes(spark, frames):
    _, _, earlier = frames
    now = spark.createDataFrame([(U + "a", "new/a.md"), (U + "z", "zed/z.md")], "url string, path string")
    assert [r.path for r in S.stale_paths(earlier, now).collect()] == ["old/a.md"]
    hashes = spark.createDataFrame([("old/a.md", "1"), ("zed/z.md", "2"), ("old/gone.md", "3")], "path string, content_hash string")
    scope = spark.createDataFrame([("zed",)], "folder string")
    assert [r.path for r in S.scoped_hashes(hashes, earlier, now, scope).collect()] == ["zed/z.md"] and S.scoped_hashes(hashes, earlier, now).count() == 2
    folders = spark.createDataFrame([(x,) for x in (".", "zed", "zed/y", "zeder", "old")], "folder string")
    assert sorted(r.folder for r in S.folders_to_refresh(folders, scope).collect()) == [".", "zed", "zed/y"] and S.folders_to_refresh(folders, None).count() == 5


def test_small_ones(spark, frames):
    pages, entries, _ = frames
    row = spark.range(1).select(
        S.structure_root(F.lit("https://h.test/x/Content/a/b.htm")), S.structure_root(F.lit("https://h.test/Content/Main_Page.htm")), S.structure_root(F.lit("https://h.test/a")), S.source_root_name(F.lit("https://Docs.H.test/a")),
        S.source_root_name(F.lit("/srv/My Site/")), S.same_body(F.lit("a \n\n"), F.lit("a")), S.same_body(F.lit("a"), F.lit("b")),
    ).first()
    assert tuple(row) == ("https://h.test/x/Content/main_page.htm", "https://h.test/Content/Main_Page.htm", "https://h.test/a", "docs.h.test", "my-site", True, False)
    rooted = spark.createDataFrame([("https://h.test/main_page.htm", "M", 0, [], None, None, None, 1), ("https://h.test/b", "B", 1, ["B"], "https://h.test/main_page.htm", None, None, 2)], ENTRIES)
    assert [(r.url, r.parent) for r in S.drop_synthetic_root(rooted, "https://h.test/main_page.htm").collect()] == [("https://h.test/b", None)]
    assert {r.url: r.ord for r in S.structure_order(pages, entries).collect()} == {U + "a": 2, U + "z": 7}
    assert S.mirror_source(entries).first().url == U + "top" and S.mirror_source(entries.limit(0)).first().url == "https://localhost/"
    summary = S.catalog_summary(pages, spark.createDataFrame([("internal",), ("external",)], "kind string"), spark.createDataFrame([("x",), (None,), ("",)], "local_path string"), spark.createDataFrame([("error",), (None,)], "severity string")).first()
    assert tuple(summary) == (2, 1, 0, 1, 3, 1, 1, 1)


def test_rewriting(spark):
    text = f"[a]({U}x#f%20g) ![i](i.png) [b](#top) [c](https://o.test/) [![t](t.png)]({U}x) <a href='/x'>q</a> <video path=\"v.mp4\"/>\n```\n[a]({U}x)\n```\n[d](x) ({U}x)"
    pages = spark.createDataFrame([(1, U + "mine", text), (2, U + "lost", f"[a]({U}x)"), (3, U + "x", None)], "page_id int, url string, markdown string")
    paths = spark.createDataFrame([(U + "x", "d/x.md"), (U + "mine", "e/me.md")], "url string, path string")
    assets = spark.createDataFrame([(U + "mine", U + "i.png", "e/me/i-1.png", 20, 20), (U + "mine", "v.mp4", "e/me/v-2.mp4", None, None), (U + "x", U + "t.png", "x", 1, 1)], "url string, source string, local_path string, width int, height int")
    anchors = spark.createDataFrame([(U + "x", "f g", "Head"), (U + "mine", "other", "No")], "url string, anchor string, heading string")
    got = {r.page_id: r.rewritten for r in R.rewrite_links(pages, paths, assets, anchors).collect()}
    assert got[1] == f"[a](../d/x.md#Head) ![i](./me/i-1.png) [b](#top) [c](https://o.test/) [![t](t.png)](../d/x.md) <a href='../d/x.md'>q</a> <video path=\"./me/v-2.mp4\"/>\n```\n[a]({U}x)\n```\n[d](../d/x.md) ({U}x)"
    assert got[2] == f"[a]({U}x)" and got[3] is None
    shown = R.rewrite_links(pages, paths, assets, anchors, 52).where("page_id = 1").first().rewritten
    assert '<image src="./me/i-1.png" crop="0,0,100,100" width="20px" height="20px" float="left"/>' in shown
    done = R.rewrite_links(pages, paths, assets, anchors)
    assert tuple(R.relink_counts(done).first()) == (1, 0, 2)
    entries = {tuple(r) for r in R.link_entries(done, paths).collect()}
    assert ("e/me.md", "internal", "../d/x.md#Head") in entries and ("e/me.md", "external", "https://o.test/") in entries and not any(t.startswith("#") for *_, t in entries)
    assert R.frontmatter_links("[a](b) ![c](d) [e](#f) [g](https://h.test/) [a](b)") == (["b"], ["https://h.test/"])
    assert R.rewrite_links(pages.limit(0), paths).count() == 0
