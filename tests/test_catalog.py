"""Catalog operators on small inputs and their invariants on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from inkloom.operators import catalog as C


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_links_children_and_order(spark):
    pages = spark.createDataFrame([("https://a.test/1",), ("https://a.test/2",)], "url string")
    edges = spark.createDataFrame([("https://a.test/1", "https://a.test/2"), ("https://a.test/1", "https://a.test/9"), ("https://a.test/1", "https://b.test/")], "src string, dst string")
    assert [r[2] for r in rows(C.resolve_links(edges, pages))] == ["internal", "internal_unresolved", "external"]
    tree = spark.createDataFrame([("p", "b", 1), ("p", "a", 2), ("p", "b", 3), (None, "p", 0)], "up string, id string, o int")
    assert rows(C.children_lists(tree, "up", "id", F.col("o"))) == [("p", ["b", "a"])]
    assert rows(C.sibling_order(tree, "up", "id", F.col("o"))) == [("p", "a", 2), ("p", "b", 1), (None, "p", 1)]


def test_merge_is_idempotent_and_diff_is_complete(spark):
    rng = random.Random(1)
    old = spark.createDataFrame([(f"s{rng.randrange(3)}/k{i}", str(rng.randrange(3))) for i in range(40)], "k string, h string")
    new = spark.createDataFrame([(f"s{rng.randrange(2)}/k{i}", str(rng.randrange(3))) for i in range(20, 60)], "k string, h string")
    scope = F.startswith("k", F.lit("s1/"))
    mine = new.where(scope)
    once = C.merge_catalog(old, mine, "k", scope)
    assert rows(C.merge_catalog(once, mine, "k", scope)) == rows(once) and set(rows(mine)) <= set(rows(once))
    assert set(rows(old.where(~scope))) <= set(rows(once))
    report = dict(rows(C.sync_report(old, new, "k", "h")))
    assert set(report) == {r[0] for r in old.collect()} | {r[0] for r in new.collect()}
    assert {s for _, s in rows(C.sync_report(new, new, "k", "h"))} == {"unchanged"}
    assert C.sync_report(old.limit(0), new.limit(0), "k", "h").count() == 0


def test_folders(spark):
    df = spark.createDataFrame([("a/b/x.md",), ("a/y.md",), ("z.md",)], "p string")
    assert rows(df.select(C.folder_ancestors(F.col("p")))) == sorted([(["."],), ([".", "a"],), ([".", "a", "a/b"],)], key=str)
    folders = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("c/d",)], "f string")
    assert rows(C.minimal_scopes(folders, "f")) == [("a",), ("ab",), ("c/d",)]


def test_collisions_leave_unique_paths(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, f"p{rng.randrange(8)}.md", f"f{rng.randrange(2)}") for i in range(60)] + [(100, "f1-p1.md", "f0")], "i int, path string, folder string")
    got = C.resolve_collisions(df, "path", F.col("i"), F.col("folder"), F.col("i").cast("string"))
    paths = [r.final_path for r in got.collect()]
    assert len(paths) == len(set(paths)) == 61
    first = {}
    for r in sorted(got.collect(), key=lambda r: r.i):
        first.setdefault(r.path, r)
    assert all(r.final_path == p for p, r in first.items())


def test_search(spark):
    df = spark.createDataFrame([("b", "---\nx: cat\n---\nA dog and a cat\nsat"), ("a", "cat cat"), ("c", "none"), ("d", None)], "k string, t string")
    assert [tuple(r) for r in C.search(df, "k", "t", "Cat a").collect()] == [("a", 2, "cat cat"), ("b", 2, "A dog and a cat sat")]
    assert C.search(df, "k", "t", "?").count() == 0 and C.query_terms("Ёж ёж x 12") == ["ёж", "ёж", "12"]


def test_bfs_and_scaling(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "src string, dst string")
    starts = spark.createDataFrame([("a",)], "node string")
    assert rows(C.bounded_bfs(edges, starts, 3)) == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    df = spark.createDataFrame([(1000.0, 5.0), (100.0, 3.0)], "w double, h double").select(*C.scaled(F.col("w"), F.col("h"), 500))
    assert rows(df) == [(100, 3, 100), (500, 2, 50)]


@pytest.mark.parametrize("label, key", [("Main – Site name", "main"), ("Ёлка 2!", "ёлка2"), ("a-b", "ab")])
def test_label_key(spark, label, key):
    assert spark.range(1).select(C.nav_label_key(F.lit(label))).first()[0] == key


def test_placeholders_folders_roots_and_relink(spark):
    known = spark.createDataFrame([("a", 0, None, ["A"], 1, False)], "url string, depth int, parent string, nav_path array<string>, ord long, placeholder boolean")
    wanted = spark.createDataFrame([("b", "B", "a", 5), ("b", "B2", None, 9), ("c", "C", None, 20_001), ("a", "A", None, 1)], "url string, title string, parent string, seq long")
    got = {r.url: (r.depth, r.nav_path, r.ord, r.placeholder) for r in C.insert_placeholders(known, wanted).collect()}
    assert got == {"a": (0, ["A"], 1, False), "b": (1, ["A", "B"], 2, True), "c": (1, ["C"], 3, True)}
    pages = spark.createDataFrame([("d/_index.md", "Dee doc", 1), ("d/e-f/x.md", "Xylo doc", 3), ("d/e-f/w.md", "War", 2)], "path string, title string, ord int")
    index = {r.path: r for r in C.folder_index(pages).collect()}
    assert index["d"].title == "Dee doc" and index["d"].children == ["d/e-f"] and index["d/e-f"].title == "E F" and index["."].children == ["d"] and index["."].pages is None
    assert [p.path for p in index["d/e-f"].pages] == ["d/e-f/w.md", "d/e-f/x.md"] and index["d/e-f"].keywords == ["doc", "war", "xylo"]
    roots = C.document_roots(spark.createDataFrame([("h/Content/a.md",), ("content/b.md",), ("z.md",)], "path string"))
    assert rows(roots) == [(".",), ("h",)]
    links = spark.createDataFrame([("p", "u"), ("p", "v"), ("p", "w")], "src string, dst string")
    structure = spark.createDataFrame([("u", "old"), ("v", "plan")], "url string, path string")
    real = spark.createDataFrame([("u", "new", False), ("w", "no", True)], "url string, path string, placeholder boolean")
    assert [tuple(r)[1:3] for r in rows(C.relink(links, structure, real))] == [("u", "new"), ("v", "plan"), ("w", None)]


def test_link_discovery(spark):
    u = "https://h.test/d/"
    links = [
        (u, u + "p.html", 1, False), (u, u + "a.html", 2, False), (u, u + "toc.html", 3, True), (u, u, 4, False), (u, u + "login", 5, False), (u, "https://h.test/other/x.html", 6, False), (u, "https://h.test/d/i.png", 7, False), (u, "https://o.test/y.html", 8, False),
        (u + "toc.html", u + "deep.html", 1, None), (u + "toc.html", u, 2, False), (u + "p.html", u + "deep.html", 1, True), (u + "p.html", u + "q.html", 2, False), ("https://h.test/other/x.html", u + "never.html", 1, False), (u + "deep.html", u + "end.html", 1, False),
    ]
    df = spark.createDataFrame(links + links[:2], "src string, dst string, ordinal int, from_toc boolean")
    got = [tuple(r) for r in C.discover_links(df, u, 2, 50).orderBy("ord").collect()]
    assert got == [
        (u, 0, None, 1, False), (u + "toc.html", 1, u, 2, False), (u + "p.html", 1, u, 3, False), (u + "a.html", 1, u, 4, False), ("https://h.test/other/x.html", 1, u, 5, True),
        (u + "deep.html", 2, u + "toc.html", 6, False), (u + "q.html", 2, u + "p.html", 7, False),
    ]
    capped = [r.url for r in C.discover_links(df, u, 9, 3).orderBy("ord").collect()]
    assert capped == [u, u + "toc.html", u + "p.html", "https://h.test/other/x.html"]
    assert C.discover_links(df.limit(0), u, 3, 5).count() == 1
