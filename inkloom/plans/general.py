"""Queries on the general data problems: snapshot changes, orphan references, hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.functions.urls import canonical_url
from inkloom.operators.hierarchy import all_descendants, cycle_paths, resolve_hierarchy
from inkloom.operators.orphans import month_label, month_number, orphan_keys
from inkloom.operators.snapshots import snapshot_changes, text_state
from inkloom.plans import mirror
from inkloom.session import cut, table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages added, removed or changed between each catalog snapshot and the one before it."""
    rows = table(spark, folder, "page_snapshots").select(
        "snapshot_no", canonical_url("canonical_url").alias("canonical_url"), text_state(F.col("markdown")).alias("text_state"),
        F.coalesce("placeholder", F.lit(False)).alias("placeholder"), "delivered_at", "snap_row_id",
    )
    return snapshot_changes(rows, "snapshot_no", "canonical_url", ["text_state", "placeholder"], ["delivered_at", "snap_row_id"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """References to pages and fetches that were not there at the end of the reference's month."""
    pages, headings = table(spark, folder, "mirror_pages"), table(spark, folder, "page_headings")
    links = pages.select("page_id", month_number(F.col("loaded_at")).alias("period"), F.posexplode("links_internal").alias("place", "link")).select(
        F.lit("mirror_pages").alias("src_table"), F.col("page_id").alias("src_id"), (F.col("place") + 1).alias("ref_no"), F.lit("url").alias("space"), canonical_url("link").alias("key"), "period",
    )
    marks = headings.select(
        F.lit("page_headings").alias("src_table"), F.col("heading_id").alias("src_id"), F.lit(0).alias("ref_no"), F.lit("fetch").alias("space"),
        F.col("page_id").cast("string").alias("key"), month_number(F.col("extracted_at")).alias("period"),
    )
    refs = links.unionByName(marks)
    loaded = month_number(F.col("loaded_at")).alias("period")
    by_url = pages.select(
        F.lit("url").alias("space"), canonical_url("canonical_url").alias("key"), loaded, F.struct("loaded_at", "page_id").alias("seq"),
        (~F.coalesce(F.col("status_code").isin(404, 410), F.lit(False))).alias("present"),
    )
    by_fetch = pages.select(F.lit("fetch").alias("space"), F.col("page_id").cast("string").alias("key"), loaded, F.struct("loaded_at", "page_id").alias("seq"), F.lit(True).alias("present"))
    gone = orphan_keys(refs, by_url.unionByName(by_fetch))
    return refs.join(gone, ["space", "key", "period"]).select("src_table", month_label(F.col("period")).alias("ref_month"), "src_id", "ref_no").distinct()


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references per table and month."""
    return p5_found(spark, folder).groupBy("src_table", "ref_month").agg(F.count(F.lit(1)).alias("orphans"), F.countDistinct("src_id").alias("records"))


def _hierarchy(spark: SparkSession, folder: str, with_paths: bool) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "nav_entries").select("entry_id", "site_host", canonical_url("canonical_url").alias("url"), canonical_url("nav_parent_url").alias("parent_url"), "depth", "seq")
    return rows, resolve_hierarchy(rows, "entry_id", "url", "parent_url", "site_host", "seq", with_paths=with_paths)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Entries without a sound way to a root, and those whose stored depth is not the true one."""
    rows, solved = _hierarchy(spark, folder, False)
    told = rows.select("entry_id", F.coalesce("site_host", F.lit("")).alias("tree"), F.col("url").alias("key"), F.col("depth").alias("told")).distinct()
    wrong = F.col("told").isNotNull() & (F.col("told") != F.col("depth"))
    found = told.join(solved, ["tree", "key"]).select("entry_id", F.coalesce("fault", F.when(wrong, F.lit("depth"))).alias("fault")).where("fault is not null")
    return found.groupBy("entry_id").agg(F.min("fault").alias("fault"))


def p7_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry with its root, true depth and full path of entry ids; ``local_path`` is that of entries with a fault.

    It leads from the top entry of a detached chain, or from a cycle's least id.
    """
    _, solved = _hierarchy(spark, folder, True)
    solved = cut(solved)
    joined = lambda path: F.array_join(path.cast("array<string>"), "/")
    looped = cycle_paths(solved).select("id", F.col("path").alias("looped"))
    local = F.when(F.col("fault").isNotNull(), joined(F.coalesce("local_path", "looped")))
    return solved.join(looped, "id", "left").select(F.col("id").alias("entry_id"), "root_id", "depth", joined(F.col("path")).alias("path"), "fault", local.alias("local_path"))


def p7_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every entry with each of its descendants, their distance and the descendant's fault."""
    _, solved = _hierarchy(spark, folder, True)
    return all_descendants(cut(solved))


QUERIES = {f.__name__: f for f in (p4_found, p5_found, p5_report, p7_found, p7_paths, p7_descendants)}

_CANON = mirror.canon_sql("canonical_url")
_TEXT = "regexp_replace(regexp_replace(coalesce(markdown, ''), '[ \\t\\r\\x{A0}]+\\n', chr(10), 'g'), '[\\s\\x{A0}]+$', '')"
SQL = {
    "p4_found": f"""
        with v as (select snapshot_no n, {_CANON} u, arg_max(struct_pack(t := {_TEXT}, p := coalesce(placeholder, false)), (delivered_at, snap_row_id)) s from page_snapshots group by 1, 2),
        o as (select n, lag(n) over (order by n) b from (select distinct n from v)),
        pairs as (select coalesce(c.n, d.n) n, coalesce(c.u, d.u) u, c.s cs, d.s ds from (select v.* from v join o on v.n = o.n where o.b is not null) c
          full join (select o.n, v.u, v.s from v join o on v.n = o.b) d on c.n = d.n and c.u = d.u)
        select n snapshot_no, u canonical_url, case when ds is null then 'added' when cs is null then 'removed' else 'changed' end change_kind from pairs where cs is distinct from ds""",
    "p5_found": f"""
        with r as (select distinct 'mirror_pages' src_table, page_id src_id, date_trunc('month', loaded_at) m, i ref_no, {mirror.canon_sql("links_internal[i]")} k from (select page_id, loaded_at, links_internal, unnest(range(1, len(links_internal) + 1)) i from mirror_pages)),
        s as (select {_CANON} k, date_trunc('month', loaded_at) m, arg_max(coalesce(status_code, 0) not in (404, 410), (loaded_at, page_id)) ok from mirror_pages group by 1, 2),
        a as (select r.src_table, r.src_id, r.ref_no, r.m, s.ok from r asof left join s on r.k = s.k and r.m >= s.m),
        f as (select page_id, min(date_trunc('month', loaded_at)) m from mirror_pages group by 1),
        h as (select distinct 'page_headings' src_table, heading_id src_id, 0 ref_no, date_trunc('month', extracted_at) m, h.page_id from page_headings h)
        select src_table, strftime(m, '%Y-%m') ref_month, src_id, ref_no::int ref_no from a where not coalesce(ok, false)
        union all select h.src_table, strftime(h.m, '%Y-%m'), h.src_id, h.ref_no from h left join f on h.page_id = f.page_id where f.m is null or f.m > h.m""",
    "p7_found": f"""
        with recursive r as (select entry_id, coalesce(site_host, '') s, {_CANON} u, nullif({mirror.canon_sql("nav_parent_url")}, '') p, depth from nav_entries),
        n as (select s, u, (arg_min(struct_pack(p := p), entry_id)).p p from r group by 1, 2),
        a as (select s, u, p x from n where p is not null union select a.s, a.u, n.p from a join n on a.s = n.s and a.x = n.u where n.p is not null),
        c as (select distinct s, u, true hit from a where x = u), b as (select distinct a.s, a.u, true hit from a join c on a.s = c.s and a.x = c.u),
        m as (select distinct a.s, a.u, true hit from a left join n on a.s = n.s and a.x = n.u where n.u is null), k as (select s, u, count(*) d from a group by 1, 2)
        select entry_id, min(f) fault from (
          select r.entry_id, case when c.hit then 'cycle' when b.hit then 'below_cycle' when m.hit then 'detached' when r.depth <> coalesce(k.d, 0) then 'depth' end f
          from r left join c on r.s = c.s and r.u = c.u left join b on r.s = b.s and r.u = b.u left join m on r.s = m.s and r.u = m.u left join k on r.s = k.s and r.u = k.u)
        where f is not null group by 1""",
}
SQL["p5_report"] = f"select src_table, ref_month, count(*) orphans, count(distinct src_id) records from ({SQL['p5_found']}) group by 1, 2"
# Every node with each of its ancestors, itself first, the way down to it, and its fault; cycles are walked until far around.
_WALK = f"""
    with recursive r as (select entry_id, coalesce(site_host, '') s, {_CANON} u, nullif({mirror.canon_sql("nav_parent_url")}, '') p from nav_entries),
    n as (select s, u, min(entry_id) id, (arg_min(struct_pack(p := p), entry_id)).p p from r group by 1, 2),
    w as (select s, u, id, id xid, p, 0 d, [id] way from n union all select w.s, w.u, w.id, n.id, n.p, d + 1, list_prepend(n.id, way) from w join n on w.s = n.s and w.p = n.u where d < 400),
    c as (select distinct id from w where xid = id and d > 0), b as (select distinct w.id from w join c on w.xid = c.id), e as (select id, arg_max(struct_pack(p := p, d := d, way := way), d) m from w group by 1),
    low as (select w.id, min(xid) low from w join c on w.xid = c.id group by 1), lp as (select w.id, arg_min(way, d) way from w join low on w.id = low.id and w.xid = low.low group by 1),
    f as (select n.id, case when c.id is not null then 'cycle' when b.id is not null then 'below_cycle' when (e.m).p is not null then 'detached' end fault from n left join c using (id) left join b using (id) left join e using (id))"""
SQL["p7_paths"] = f"""{_WALK}
    select id entry_id, case when fault is null then ((m).way)[1] end root_id, case when fault is null then (m).d::bigint end depth, case when fault is null then array_to_string((m).way, '/') end path, fault,
      case when fault = 'detached' then array_to_string((m).way, '/') when fault is not null then array_to_string(lp.way, '/') end local_path from f join e using (id) left join lp using (id)"""
SQL["p7_descendants"] = f"{_WALK} select xid ancestor_id, w.id descendant_id, min(d)::bigint distance, fault from w join f using (id) where d > 0 group by 1, 2, fault"
