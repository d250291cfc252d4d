"""Queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.boilerplate import boilerplate_lines
from inkloom.llm.encoding import repair_text, train_on
from inkloom.llm.lookalikes import changed_texts, plain_texts, suspects
from inkloom.llm.repeated_lines import repeated_lines, repeated_templates, without_lines
from inkloom.llm.mixing import mix_report, mix_sources
from inkloom.llm.packing import fill_report, pack
from inkloom.llm.subjects import fit, score
from inkloom.llm.tokens import with_tokens
from inkloom.session import store, table


def _garbled(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, field_name, restored, chains`` of the garbled titles, descriptions and texts of the pages."""
    pages = table(spark, folder, "mirror_pages")
    model = train_on(pages, "markdown")
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("markdown", "title", "description")]))
    values = pages.select("page_id", fields.alias("f")).select("page_id", "f.field_name", "f.value")
    return repair_text(values, "value", model, ["page_id", "field_name"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values with at least one passage decoded with the wrong encoding."""
    return _garbled(spark, folder).select("page_id", "field_name").distinct()


def p6_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The damaged values as originally written, with the encoding chains that were undone."""
    return _garbled(spark, folder).select("page_id", "field_name", "restored", F.array_join("chains", "; ").alias("chains")).distinct()


def _visible_values(spark: SparkSession, folder: str) -> DataFrame:
    """``field_name, rec_id, value`` of titles, texts and headings."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("title", "markdown")]))
    pages = table(spark, folder, "mirror_pages").select(F.col("page_id").alias("rec_id"), fields.alias("f")).select("f.field_name", "rec_id", "f.value")
    headings = table(spark, folder, "page_headings").select(F.lit("heading_text").alias("field_name"), F.col("heading_id").alias("rec_id"), F.col("heading_text").alias("value"))
    return pages.unionByName(headings)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values with characters that look like, or hide beside, the plain spelling; garbled values aside."""
    values = _visible_values(spark, folder)
    suspect = store(suspects(values, "value", ["field_name", "rec_id"]))
    changed = changed_texts(suspect, ["field_name", "rec_id"])
    asked = suspect.join(changed, ["field_name", "rec_id"], "left_semi")
    garbled = repair_text(asked, "value", train_on(table(spark, folder, "mirror_pages"), "markdown"), ["field_name", "rec_id"])
    return changed.join(garbled, ["field_name", "rec_id"], "left_anti")


def p1_plain(spark: SparkSession, folder: str) -> DataFrame:
    """Titles, texts and headings in one consistent form, where that differs from the stored one."""
    return plain_texts(_visible_values(spark, folder), "value", ["field_name", "rec_id"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the pages that aren't part of the article."""
    pages = table(spark, folder, "mirror_pages").select("page_id", "site_host", "canonical_url", "markdown")
    owners = table(spark, folder, "mirror_sites").groupBy("site_host").agg(F.max("org_name").alias("org_name"))
    owners = F.broadcast(owners) if owners.count() <= 50_000 else owners  # a name and a host each
    return boilerplate_lines(pages.join(owners, "site_host", "left"), "markdown", "site_host", "canonical_url", "page_id", "org_name")


def p2_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its article only."""
    pages = table(spark, folder, "mirror_pages").select("page_id", "site_host", "markdown").dropDuplicates(["page_id"])
    return without_lines(pages, "markdown", "page_id", p2_found(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose wording stands in at least 12 documents of their site."""
    pages = table(spark, folder, "mirror_pages")
    return repeated_lines(pages, "markdown", "site_host", "canonical_url", "page_id")


def p3_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Templates with slots that cover lines of at least 12 documents of their site."""
    return repeated_templates(table(spark, folder, "mirror_pages"), "markdown", "site_host", "canonical_url", "page_id").withColumnRenamed("site", "site_host")


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Every page without the lines that its site repeats."""
    pages = table(spark, folder, "mirror_pages").select("page_id", "site_host", "canonical_url", "markdown").distinct()
    return without_lines(pages, "markdown", "page_id", repeated_lines(pages, "markdown", "site_host", "canonical_url", "page_id"))


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return with_tokens(table(spark, folder, "documents").select("doc_id", "source", "text"), "text").drop("text")


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_sized(spark, folder), "doc_id", "tokens", table(spark, folder, "pack_limits"), "container_kind", "capacity_tokens")


def p8_contents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents in containers of every kind, by tokens."""
    return _packed(spark, folder).select(F.col("kind").alias("container_kind"), "container", F.col("item").alias("doc_id"), F.col("piece").alias("piece_no"), F.col("size").alias("tokens"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Each container with its number of pieces, tokens and fill."""
    limits = table(spark, folder, "pack_limits").groupBy("container_kind").agg(F.max("capacity_tokens").alias("capacity"))
    filled = p8_contents(spark, folder).groupBy("container_kind", "container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"))
    return filled.join(limits, "container_kind").withColumn("fill", F.col("tokens") / F.col("capacity"))


def p8_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """Containers of every kind beside the fewest that could hold as many tokens."""
    return fill_report(_packed(spark, folder), table(spark, folder, "pack_limits"), "container_kind", "capacity_tokens").withColumnRenamed("kind", "container_kind")


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mix_targets").select(F.col("mix_name").alias("mix"), "source", F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats"))


def p9_selection(spark: SparkSession, folder: str) -> DataFrame:
    """Every use of a document in each mix, with its slot in the interleaved order."""
    used = mix_sources(_sized(spark, folder), "doc_id", "source", "tokens", _targets(spark, folder))
    return used.select(F.col("mix").alias("mix_name"), "source", F.col("item").alias("doc_id"), "use_no", F.col("size").alias("tokens"), "slot")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Actual beside target shares of every source of every mix."""
    targets = _targets(spark, folder)
    return mix_report(mix_sources(_sized(spark, folder), "doc_id", "source", "tokens", targets), targets).withColumnRenamed("mix", "mix_name")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The subjects of every document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    known = [r[0] for r in table(spark, folder, "subject_areas").select("subject").distinct().orderBy("subject").collect()]  # a closed list of ten
    model = fit(documents, table(spark, folder, "subject_labels"), known, "doc_id", "text", "subject")
    return score(documents, model, known, "doc_id", "text").distinct()


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The composition of the corpus by subject: documents, and their share of all."""
    total = table(spark, folder, "documents").agg(F.count(F.lit(1)).alias("total"))  # one row
    counts = p10_found(spark, folder).groupBy("subject").agg(F.count(F.lit(1)).alias("documents"))
    return counts.crossJoin(total).select("subject", "documents", (F.col("documents") / F.col("total")).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_plain, p2_found, p2_articles, p3_found, p3_templates, p3_clean, p6_found, p6_restored, p8_contents, p8_fill, p8_bounds, p9_selection, p9_shares, p10_found, p10_shares,
    )
}

_REPEATED = r"""
        with p as (select distinct page_id, site_host, canonical_url, markdown from mirror_pages where markdown is not null),
        l as (select page_id, site_host, canonical_url, i, string_split(markdown, chr(10))[i] line from (select *, unnest(range(1, len(string_split(markdown, chr(10))) + 1)) i from p)),
        f as (select *, regexp_matches(line, '^[ \t]*```') fence, sum(regexp_matches(line, '^[ \t]*```')::int) over (partition by page_id order by i) n from l),
        w as (select page_id, site_host, canonical_url, i, replace(replace(replace(lower(regexp_replace(regexp_replace(line, '!?\[([^\]\n]*)\]\([^)\n]*\)', '\1', 'g'), '[^\p{L}]+', '', 'g')), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl') k
          from f where not fence and n % 2 = 0 and not regexp_matches(line, '^[ \t]*[#|]')),
        o as (select site_host, k from w where k <> '' group by 1, 2 having count(distinct canonical_url) >= 12)
        select distinct page_id, i::int line_no from w join o using (site_host, k)"""

SQL = {
    "p3_found": _REPEATED,
    "p3_clean": f"""
        with found as ({_REPEATED}),
        p as (select distinct page_id, site_host, canonical_url, markdown from mirror_pages),
        l as (select page_id, i, string_split(markdown, chr(10))[i] line from (select *, unnest(range(1, len(string_split(markdown, chr(10))) + 1)) i from p where markdown is not null)),
        k as (select l.page_id, string_agg(line, chr(10) order by i) filter (line_no is null) kept from l left join found f on l.page_id = f.page_id and l.i = f.line_no group by 1)
        select page_id, site_host, canonical_url, case when markdown is not null then coalesce(kept, '') end markdown from p left join k using (page_id)""",
}
