"""Predicates on URLs, paths and texts."""

from pyspark.sql import functions as F

from inkloom.functions import predicates as P


def test_url_predicates(spark):
    urls = ["https://h.test/d/a.html", "https://h.test/d/login", "https://h.test/tags", "https://h.test/x/_profile/y", "https://h.test/d/i.png", "https://o.test/d/a", "https://h.test/Content/main_page.htm", "https://h.test/Content/a/a.htm", "https://h.test/", "https://h.test/d/b"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    pick = lambda c: [r[0] for r in df.where(c).collect()]
    assert pick(P.is_service("u")) == urls[1:4]
    assert pick(~P.is_html_candidate("u")) == [urls[4]]
    assert pick(P.is_main_page("u")) == [urls[6]] and urls[7] in pick(P.is_section_landing("u")) and urls[0] not in pick(P.is_section_landing("u"))
    assert pick(P.is_allowed("u", "https://h.test/d/index.html")) == [urls[0], urls[4], urls[9]]
    assert urls[5] in pick(P.is_allowed("u", "https://h.test/d/", include_external=True)) and urls[6] in pick(P.is_allowed("u", "https://h.test/d/", "domain"))
    assert P.allowed_prefixes("https://h.test/d") == ["https://h.test/d", "https://h.test/d/"]
    assert pick(P.is_placeholder_candidate("u", "https://h.test/")) == [urls[0], urls[7]]


def test_paths_and_texts(spark, tmp_path):
    df = spark.createDataFrame([(".",), ("a",), ("a/b",), ("ab",)], "p string")
    assert [r[0] for r in df.where(P.in_scopes(F.col("p"), ["a"])).collect()] == ["a", "a/b"]
    assert [r[0] for r in df.where(P.is_above_scope(F.col("p"), ["a/b/c"])).collect()] == [".", "a", "a/b"]
    row = spark.range(1).select(
        P.markdown_images(F.lit("![a](x.png) [![b](y.JPG?q)](z) ![a](x.png) [t](u.html)")), P.breadcrumb_path(F.lit("\n[A](a) > B > C\n\nx")), P.breadcrumb_path(F.lit("x")), P.asset_path(F.lit("d/p.md"), F.lit("i/x.png?1")),
        P.asset_path(F.lit("d/_index.md"), F.lit("x")), P.is_local(F.lit("a/b")), P.is_local(F.lit("https://x")), P.is_service_href(F.lit(" #a")), P.placeholder_body(F.lit("T"), F.lit("u")),
    ).first()
    assert row[0] == ["x.png", "y.JPG?q"] and row[1] == ["A", "B", "C"] and row[2] is None and row[3].startswith("d/p/x-") and row[3].endswith(".png") and row[4].startswith("d/x-")
    assert row[5] and not row[6] and row[7] and row[8].startswith("# T\n")
    for name in ("a.md", "b.yaml", "c.txt", "_assets/d.md"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x\ny")
    assert sorted(r.path.rsplit("/", 1)[1] for r in P.searchable_files(spark, str(tmp_path)).collect()) == ["a.md", "b.yaml"]
