"""Local crawl, tables of contents, layout, export, streaming and the command line."""

import datetime as dt
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from inkloom import cli
from inkloom.functions.media import from_yaml, to_yaml
from inkloom.operators import catalog as C
from inkloom.operators import layout as Y
from inkloom.session import drop_stored, ensure_checkpoint_dir, store
from inkloom.sources import local, toc
from inkloom.sources.export import delete_pages, other_form, split_page, write_folder_indexes, write_pages, write_root_markers
from inkloom.streaming.ingest import fetched_pages, fetches_per_hour, merge_into, run_ingest


@pytest.fixture
def site(tmp_path):
    root = tmp_path / "site"
    for name, title, links in [
        ("index.html", "Home", ["a.html", "sub/b.html", "https://x.test/", "gone.html"]), ("a.html", "A", ["sub/b.html", "/c.htm"]), ("sub/b.html", "B", ["../c.htm", "d.html", "#top"]), ("c.htm", "C", []), ("sub/d.html", "D", ["e.html"]), ("sub/e.html", "E", []),
    ]:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"<title>{title}</title><h1>{title}</h1>" + "".join(f"<p><a href='{u}'>{u}</a>" for u in links))
    return root


def test_local_crawl(spark, site):
    pages, issues = local.crawl_local(spark, str(site), max_depth=2)
    got = {r.path: (r.seq, r.depth, r.parent) for r in pages.collect()}
    assert got == {"index.html": (1, 0, None), "a.html": (2, 1, "index.html"), "sub/b.html": (3, 1, "index.html"), "c.htm": (4, 2, "a.html"), "sub/d.html": (5, 2, "sub/b.html")}
    assert [(r.kind, r.message, r.path) for r in issues.collect()] == [("local_link_missing", "gone.html", "index.html")]
    assert {r.path for r in local.crawl_local(spark, str(site), max_pages=2)[0].collect()} == {"index.html", "a.html"}
    home = pages.where("path = 'index.html'").first()
    assert home.links_internal == ["a.html", "sub/b.html"] and home.links_external == ["https://x.test/"] and home.title == "Home"


def test_toc(spark):
    scripts = {"Toc.js": "define({numchunks:1,prefix:'T_',tree:{n:[{i:0,c:0,n:[{i:1,c:0}]},{i:2,c:0},{i:9,c:0}]}});", "T_0.js": "define({'/Content/a.htm':{i:[0],t:['A  a'],b:['']},'/Content/b.htm':{i:[1,2],t:['B','B2'],b:['','']}});"}
    entries, problem = toc.toc_entries(spark, "<W Toc='Data/Toc.js'/>", scripts, toc.root_url("https://h.test/Content/x.htm"))
    got = [tuple(r) for r in entries.orderBy("ord").collect()]
    assert problem is None and [(g[0], g[3], g[4], g[5]) for g in got] == [("A a", 0, 1, ["A a"]), ("B", 1, 2, ["A a", "B"]), ("B2", 0, 3, ["B2"]), ("#9", 0, 4, ["#9"])]
    assert got[1][2] == "https://h.test/Content/b.htm?TocPath=A%20a%7CB%7C_____0" and got[1][6] == "https://h.test/Content/a.htm"
    part, _ = toc.toc_entries(spark, "<W Toc='Toc.js'/>", scripts, "https://h.test/", "https://h.test/Content/a.htm")
    assert part.count() == 2
    same, _ = toc.toc_entries(spark, "<W Toc='Toc.js'/>", scripts, "https://h.test/", "HTTPS://H.test/Content/a.htm?x#y")
    assert same.count() == 2  # addresses are compared in canonical form
    assert toc.toc_entries(spark, "<W Toc='Toc.js'/>", scripts, "https://h.test/", "https://h.test/Content/main_page.htm")[0].count() == 4
    assert toc.toc_entries(spark, "<W Toc='Toc.js'/>", scripts, "https://h.test/", "https://h.test/Content/a.htm", "domain")[0].count() == 4
    assert [toc.uses_toc(*x) for x in (("madcap", "links"), ("auto", "auto"), ("auto", "links"), ("wikijs", "toc"))] == [True, True, False, False]
    with pytest.raises(ValueError, match="unknown"):
        toc.uses_toc("other")
    assert toc.toc_entries(spark, "<W/>", scripts, "")[1].startswith("madcap_toc_unavailable")


def test_layout(spark):
    pages = spark.createDataFrame([("r", ["R"], None, 1), ("a", ["R", "A"], "x", 2), ("b", ["R", "Q", "B"], "a", 3), ("s", [], "s", 4), ("t", [], "zz", 5)], "url string, nav_path array<string>, nav_parent_url string, seq int")
    parents = {r.url: r.parent for r in Y.nav_parents(pages).collect()}
    assert parents == {"r": None, "a": "r", "b": "a", "s": None, "t": None}
    rows = [("r", None, "r.md", False), ("a", "r", "x/a.md", False), ("b", "a", "y/b.md", False), ("p", "r", "p.md", True), ("c1", "c2", "c1.md", False), ("c2", "c1", "c2.md", False)]
    got = {r.url: r.path for r in Y.parent_first(spark.createDataFrame(rows, "url string, parent string, path string, placeholder boolean")).collect()}
    assert got == {"r": "r/_index.md", "a": "r/a/_index.md", "b": "r/a/b.md", "p": "r/p/_index.md", "c1": "c1/_index.md", "c2": "c2/_index.md"}
    hints = spark.createDataFrame([("u", "p1", ["a"], False, 1), ("u", "p2", ["x", "y"], True, 2), ("u", "p3", ["x", "z"], True, 3), ("v", "p4", ["q"], False, 2), ("v", "p5", ["q", "w"], False, 9)], "url string, parent string, nav_path array<string>, from_toc boolean, seq int")
    assert {tuple(r)[:2] for r in Y.merge_nav_hints(hints).collect()} == {("u", "p2"), ("v", "p4")}
    assert spark.range(1).select(Y.index_path(F.lit("a/a.md"))).first()[0] == "a/_index.md"


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a/b.md", 'T "q"', 3, "# B\n"), ("a/b/_index.md", None, None, "")], "path string, title string, n int, markdown string")
    assert write_pages(df.limit(1), str(tmp_path)) == 1
    front, body = split_page((tmp_path / "a/b.md").read_text())
    assert front == {"path": "a/b.md", "title": 'T "q"', "n": 3} and body == "# B\n"
    assert write_pages(df.where("n is null"), str(tmp_path)) == 1 and not (tmp_path / "a/b.md").exists() and (tmp_path / "a/b/_index.md").exists()


def test_stream(spark, tmp_path):
    schema = "source_url string, site_host string, markdown string, crawled_at timestamp"
    at = lambda h: dt.datetime(2025, 1, 1, h)
    spark.createDataFrame([("HTTPS://h.test/a/", "h", "x", at(1)), ("https://h.test/a", "h", "x", at(1)), ("https://h.test/b", "h", "y", at(3))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    pages = fetched_pages(spark, str(tmp_path / "in"), schema)
    run_ingest(pages, str(tmp_path / "catalog"), str(tmp_path / "cp")).awaitTermination(120)
    spark.createDataFrame([("https://h.test/a", "h", "z", at(5)), ("https://h.test/b", "h", "late", at(2))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run_ingest(pages, str(tmp_path / "catalog"), str(tmp_path / "cp")).awaitTermination(120)
    stored = lambda: sorted((r.url, r.markdown) for r in spark.read.parquet(str(tmp_path / "catalog")).collect())
    assert stored() == [("https://h.test/a", "z"), ("https://h.test/b", "y")]  # a late fetch replaces nothing newer
    batch = spark.createDataFrame([("https://h.test/b", "h", "q", at(1), "https://h.test/b", "x")], f"source_url string, site_host string, markdown string, crawled_at timestamp, url string, content_hash string")
    merge_into(str(tmp_path / "catalog"), ["url"])(batch, 0)  # and neither does a batch that comes again
    assert stored() == [("https://h.test/a", "z"), ("https://h.test/b", "y")]
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        merge_into(str(tmp_path / "broken"), ["url"])(batch, 0)
    assert fetches_per_hour(pages).isStreaming


def test_other_forms_and_deletion(spark, tmp_path):
    assert [other_form(p) for p in ("docs/v1.2/_index.md", "docs/v1.2.md", "_index.md")] == ["docs/v1.2.md", "docs/v1.2/_index.md", None]
    df = spark.createDataFrame([("docs/v1.md", "One", "x"), ("docs/v1.2/_index.md", "Two", "y"), ("a/b/c.md", "C", "z")], "path string, title string, markdown string")
    assert write_pages(df.where("title = 'One'"), str(tmp_path)) == 1 and write_pages(df.where("title <> 'One'"), str(tmp_path)) == 2
    assert (tmp_path / "docs/v1.md").exists() and (tmp_path / "docs/v1.2/_index.md").exists()
    (tmp_path.parent / "out.md").write_text("not ours")
    stale = spark.createDataFrame([("a/b/c.md",), ("../out.md",), ("docs",), ("docs/v1.md",), (None,)], "path string")
    assert delete_pages(stale, str(tmp_path)) == 2 and not (tmp_path / "a").exists() and (tmp_path.parent / "out.md").exists() and (tmp_path / "docs/v1.2/_index.md").exists()
    index = C.folder_index(df.withColumn("ord", F.lit(1)))
    assert write_folder_indexes(index, str(tmp_path)) == 5
    written = from_yaml((tmp_path / "docs/_index.yaml").read_text())
    assert written["children"] == ["docs/v1.2"] and written["pages"] == [{"path": "docs/v1.md", "title": "One"}] and from_yaml((tmp_path / "_index.yaml").read_text())["title"] == "Documentation Mirror"
    assert write_root_markers(spark.createDataFrame([("help",), (".",)], "folder string"), str(tmp_path)) == 2 and write_root_markers(spark.createDataFrame([("help",)], "folder string"), str(tmp_path)) == 0
    assert (tmp_path / "help/.doc-root.yaml").read_text().startswith("title: help\n")


def test_stored_tables_are_dropped(spark):
    drop_stored(spark)
    kept = store(spark.range(5))
    path = spark.sparkContext._inkloom_tables[0]
    assert kept.count() == 5 and drop_stored(spark) == 1 and drop_stored(spark) == 0
    assert not Path(path.removeprefix("file:")).exists()


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://h:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    session = SimpleNamespace(sparkContext=Context(), conf={})
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)


def test_start_file_among_many(spark, tmp_path):
    for n in range(1001):
        (tmp_path / f"a{n:04}.html").write_text("<p>x")
    (tmp_path / "index.html").write_text("<title>Home</title><a href='a0007.html'>x</a>")
    pages, _ = local.crawl_local(spark, str(tmp_path), max_depth=1)
    assert [r.path for r in pages.orderBy("seq").collect()] == ["index.html", "a0007.html"]


def test_deep_layout(spark):
    rows = [(f"u{n}", f"u{n - 1}" if n else None, f"p{n}.md", False) for n in range(151)]
    got = {r.url: r.path for r in Y.parent_first(spark.createDataFrame(rows, "url string, parent string, path string, placeholder boolean")).collect()}
    assert got["u0"] == "p0/_index.md" and got["u150"] == "/".join(f"p{n}" for n in range(150)) + "/p150.md"


def test_assets(spark, site, tmp_path, capsys):
    png = b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + (20).to_bytes(4, "big") + (30).to_bytes(4, "big")
    (site / "img").mkdir()
    (site / "img/i.png").write_bytes(png)
    (site / "sub/d.html").write_text("<title>D</title><h1>D</h1><p><img src='../img/i.png' alt=I> and <img src='gone.png'> and <img src='https://x.test/w.png'>")
    out = tmp_path / "out"
    assert cli.main(["mirror", str(site), str(out)]) == 0 and cli.main(["mirror", str(site), str(out)]) == 0
    assets = {r.source: r for r in spark.read.parquet(f"{out}/_catalog/assets.parquet").collect()}
    copy = assets["../img/i.png"]
    assert (copy.width, copy.height) == (20, 30) and (out / copy.local_path).read_bytes() == png and copy.local_path.startswith("sub/d/i-")
    assert assets["gone.png"].local_path is None and assets["https://x.test/w.png"].local_path is None
    assert {(r.kind, r.message) for r in spark.read.parquet(f"{out}/_catalog/issues.parquet").collect()} >= {("asset_missing", "gone.png")}
    assert f'<image src="./d/{copy.local_path[6:]}" crop="0,0,100,100" width="20px" height="30px" float="left"/>' in (out / "sub/d.md").read_text()
    summary = spark.read.parquet(f"{out}/_catalog/summary.parquet").first()
    assert (summary.assets, summary.assets_localized) == (3, 1)


def test_command_line(spark, site, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert cli.main(["mirror", str(site), out]) == 0
    assert "[a.html](a.md)" in (tmp_path / "out/index.md").read_text() and (tmp_path / "out/_index.yaml").exists()
    (site / "sub/d.html").unlink()
    (site / "sub/b.html").write_text("<title>B</title><h1>B</h1><a href='../c.htm'>c</a>")
    assert cli.main(["mirror", str(site), out, "--max-pages", "3"]) == 0
    report = {r.path: r.status for r in spark.read.parquet(f"{out}/_catalog/sync.parquet").collect()}
    assert report["index.md"] == "unchanged" and report["sub/b.md"] == "changed" and report["sub/d.md"] == "deleted"
    assert cli.main(["query", out, "home"]) == 0 and "index.md" in capsys.readouterr().out
    assert cli.main(["relink", out, "--dry-run"]) == 0 and "'unchanged': 3" in capsys.readouterr().out
    pages = spark.read.parquet(f"{out}/_catalog/pages.parquet").where("path = 'index.md'").first()
    assert pages.content_hash.startswith("sha256:") and cli.main(["relink", out, "--path-prefix", "sub"]) == 0
    assert cli.main(["structure", str(site), out]) == 0 and spark.read.parquet(f"{out}/_catalog/structure.parquet").where("placeholder").count() == 4
    assert cli.main(["catalog", out]) == 0 and "structure.parquet" in capsys.readouterr().out
    assert cli.main(["verify", out]) in (0, 1)
    assert cli.catalog_items(to_yaml({"pages": [{"path": "a", "n": 1}]}), "pages") == [{"path": "a", "n": 1}] and cli.catalog_items("", "pages") == []
