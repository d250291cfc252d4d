"""Queries of the mirror's own operators, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.functions import predicates as P
from inkloom.functions import urls as U
from inkloom.functions.html import parse_column
from inkloom.functions.markdown import NOISE_LINES, collapse_repeats, drop_noise, normalize_column, pass_column, read_lines, repair_column, squeeze_blanks
from inkloom.operators import catalog as C
from inkloom.operators import hierarchy as H
from inkloom.operators import rewrite as R
from inkloom.operators import structure as S
from inkloom.session import cut, store, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Pieces of the SQL.
_PATH = "regexp_replace(regexp_extract({0}, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', '')"
_CANON = (
    "(lower(regexp_extract({0}, '^([A-Za-z]+://[^/?#]*)', 1)) || coalesce(nullif(rtrim(url_decode(replace(" + _PATH + ", '+', '%2B')), '/'), ''), '/'))"
)
# White space as Python sees it, for patterns of the SQL.
_WS = r"[\t\x0b\x0c\r\x1c-\x1f \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_PLAIN = f"regexp_replace(trim(regexp_replace(line, '{_WS}+', ' ', 'g')), '^- ', '* ')"


def canon_sql(column: str) -> str:
    return _CANON.format(column)


def rel_sql(column: str) -> str:
    path = f"lower(regexp_extract({column}, '^[a-z]+://[^/]*/?(.*)$', 1))"
    return f"(case when {path} = '' then '_index.md' when regexp_matches({path}, '\\.(html|htm|xhtml)$') then regexp_replace({path}, '\\.(html|htm|xhtml)$', '.md') else {path} || '/_index.md' end)"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _pages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "mirror_pages").select("page_id", *columns).distinct()


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct ``src, dst`` in canonical form."""
    raw = table(spark, folder, "mirror_pages").select("canonical_url", F.explode("links_internal").alias("link"))
    return raw.select(F.col("canonical_url").alias("src"), U.canonical_url("link").alias("dst")).distinct()


_EDGES_SQL = f"(select distinct canonical_url src, {canon_sql('link')} dst from (select canonical_url, unnest(links_internal) link from mirror_pages))"


@query("select lower(regexp_extract(source_url, '^[A-Za-z]+://([^/?#]*)', 1)) host, count(distinct page_id) pages, count(distinct page_id) filter (regexp_matches(lower(source_url), '^https?:')) web, count(distinct page_id) filter (lower(regexp_extract(source_url, '^[A-Za-z]+://([^/?#]*)', 1)) = site_host) own from mirror_pages group by 1")
def page_scan_hosts(spark, folder):
    p = _pages(spark, folder, "source_url", "site_host").withColumn("host", U.url_host("source_url"))
    return p.groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(U.is_url("source_url")).alias("web"), F.count_if(F.col("host") == F.col("site_host")).alias("own"))


@query(f"select distinct page_id, {canon_sql('source_url')} url from mirror_pages")
def canonical_url(spark, folder):
    return _pages(spark, folder, "source_url").select("page_id", U.canonical_url("source_url").alias("url"))


_REL = "(with u as (select distinct canonical_url from mirror_pages), p as (select canonical_url, lower(regexp_extract(canonical_url, '^[a-z]+://[^/]*/?(.*)$', 1)) path from u) select canonical_url, case when path = '' then '_index.md' when regexp_matches(path, '\\.(html|htm|xhtml)$') then regexp_replace(path, '\\.(html|htm|xhtml)$', '.md') else path || '/_index.md' end path from p)"


def _paths(spark, folder):
    return table(spark, folder, "mirror_pages").select("canonical_url").distinct().select("canonical_url", U.markdown_relpath("canonical_url").alias("path"))


@query(_REL)
def md_relpath(spark, folder):
    return _paths(spark, folder)


@query("select distinct page_id, coalesce(nullif(trim(title), ''), nullif(trim(regexp_extract(markdown, '(?m)^#[ \\t]+([^\\n]+)', 1)), '')) title from mirror_pages")
def doc_title(spark, folder):
    return _pages(spark, folder, "title", "markdown").select("page_id", P.page_title("title", "markdown").alias("title")).distinct()


_P = "regexp_extract(canonical_url, '^[a-z]+://[^/]*(/.*)$', 1)"
_PARTS = f"list_filter(string_split(lower({_P}), '/'), lambda x: x <> '')"
_LAST = f"coalesce(list_extract({_PARTS}, -1), '')"
_SERVICE = f"({_LAST} in ('...', 'login', 'logout', 'signin', 'sign-in', 'auth', 'register') or (len({_PARTS}) = 1 and {_LAST} in ('t', 'tags')) or list_has_any({_PARTS}, ['_profile', '_settings']))"
_HTML = f"regexp_matches(lower({_P}), '\\.(html|htm|xhtml)$')"
_CANDIDATE = f"(not regexp_matches(list_extract(string_split({_P}, '/'), -1), '[^.]\\.[^.]+$') or {_HTML})"
_TAIL = f"list_slice({_PARTS}, coalesce(nullif(list_position({_PARTS}, 'content'), 0), 0) + 1, 1000)"
_STEM = f"regexp_replace(coalesce(list_extract({_TAIL}, -1), ''), '\\.[^.]+$', '')"
_SCOPE_ROOT = "https://docs.norvaned.example/guides"


@query(f"select distinct canonical_url url, {_HTML} html, {_CANDIDATE} candidate, {_SERVICE} service, regexp_matches({_LAST}, '^main_page\\.x?html?$') main, len({_TAIL}) = 1 or {_STEM} = coalesce(list_extract({_TAIL}, -2), '/') or suffix({_STEM}, '_toc') landing, starts_with(canonical_url, 'https://docs.norvaned.example/') same from mirror_pages")
def url_predicates(spark, folder):
    """What kind of address each page has."""
    u = table(spark, folder, "mirror_pages").select(F.col("canonical_url").alias("url")).distinct()
    return u.select("url", P.is_html("url").alias("html"), P.is_html_candidate("url").alias("candidate"), P.is_service("url").alias("service"), P.is_main_page("url").alias("main"), P.is_section_landing("url").alias("landing"), U.same_domain("url", F.lit(_SCOPE_ROOT)).alias("same"))


@query(f"select distinct canonical_url url, site_host from mirror_pages where not {_SERVICE} and {_CANDIDATE} and starts_with(canonical_url, 'https://docs.norvaned.example/') and (canonical_url = '{_SCOPE_ROOT}' or starts_with(canonical_url, '{_SCOPE_ROOT}/') or starts_with(canonical_url, 'https://docs.norvaned.example/install/'))")
def url_scope_filter(spark, folder):
    p = table(spark, folder, "mirror_pages").select(F.col("canonical_url").alias("url"), "site_host").distinct()
    return p.where(P.is_allowed("url", _SCOPE_ROOT, extra=("https://docs.norvaned.example/install/",)) & P.is_html_candidate("url"))


@query(f"select * from {_EDGES_SQL}")
def link_edges(spark, folder):
    return _edges(spark, folder)


_KINDS_SQL = f"(select src, dst, case when p.u is not null then 'internal' when h.h is not null then 'internal_unresolved' else 'external' end kind from {_EDGES_SQL} e left join (select distinct canonical_url u from mirror_pages) p on e.dst = p.u left join (select distinct regexp_extract(canonical_url, '^[a-z]+://([^/]*)', 1) h from mirror_pages) h on regexp_extract(e.dst, '^[a-z]+://([^/]*)', 1) = h.h)"


@query(f"select * from {_KINDS_SQL}")
def link_resolve(spark, folder):
    return C.resolve_links(_edges(spark, folder), table(spark, folder, "mirror_pages").select(F.col("canonical_url").alias("url")))


@query(f"select kind, count(*) links, count(distinct src) pages from {_KINDS_SQL} group by 1")
def link_kind_counts(spark, folder):
    return link_resolve(spark, folder).groupBy("kind").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("src").alias("pages"))


@query(f"select path, canonical_url, row_number() over (partition by path order by canonical_url) owner_rank from {_REL} qualify count(*) over (partition by path) > 1")
def path_collisions(spark, folder):
    w = Window.partitionBy("path")
    p = _paths(spark, folder)
    return p.withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1").select("path", "canonical_url", F.row_number().over(w.orderBy("canonical_url")).cast("bigint").alias("owner_rank"))


@query(f"select canonical_url, path, case when rn = 1 then path else regexp_replace(lower(regexp_extract(canonical_url, '^[a-z]+://([^/]*)', 1)), '[^a-z0-9]+', '-', 'g') || '-' || path end final_path from (select canonical_url, path, row_number() over (partition by path order by canonical_url) rn from {_REL})")
def path_layout(spark, folder):
    """Every page with a path of its own; the SQL knows the first round only."""
    host = F.regexp_replace(U.url_host("canonical_url"), r"[^a-z0-9]+", "-")
    return C.resolve_collisions(_paths(spark, folder), "path", F.col("canonical_url"), host, F.col("canonical_url"))


_FOLDER = "case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end"


@query(f"select {_FOLDER} folder, count(*) pages, min(path) first_path from (select distinct path from {_REL}) group by 1")
def folder_rollup(spark, folder):
    entries = folder_entries(spark, folder).where("kind = 'page'")
    return entries.groupBy("folder").agg(F.count(F.lit(1)).alias("pages"), F.min("path").alias("first_path"))


@query(f"with p as (select path, max(title) title from (select canonical_url, path from {_REL}) join mirror_pages using (canonical_url) group by 1), a as (select distinct array_to_string(list_slice(string_split(path, '/'), 1, i), '/') up from p, unnest(range(1, len(string_split(path, '/')))) r(i)), e as (select case when contains(up, '/') then regexp_replace(up, '/[^/]*$', '') else '.' end folder, 'folder' kind, up path, null title from a union all select {_FOLDER}, 'page', path, title from p) select folder, kind, row_number() over (partition by folder, kind order by path)::int \"position\", path, title from e")
def folder_entries(spark, folder):
    """Child folders and pages of every folder, in order."""
    titled = table(spark, folder, "mirror_pages").select(U.markdown_relpath("canonical_url").alias("path"), "title")
    return C.folder_entries(titled.groupBy("path").agg(F.max("title").alias("title")).withColumn("ord", F.lit(0)))


@query(f"with p as (select distinct path from {_REL}), s as (select path, string_split(path, '/') parts from p), a as (select path, unnest(range(0, len(parts))) i, parts from s) select case when i = 0 then '.' else array_to_string(parts[1:i], '/') end folder, count(*) pages from a group by 1")
def folder_ancestors(spark, folder):
    p = _paths(spark, folder).select("path").distinct()
    return p.select(F.explode(C.folder_ancestors(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("pages"))


@query("select site_host, string_agg(distinct k, ' ' order by k) keywords from (select site_host, unnest(regexp_extract_all(lower(title), '[a-zа-яё0-9]{3,}')) k from mirror_pages) group by 1")
def folder_keywords(spark, folder):
    words = table(spark, folder, "mirror_pages").select("site_host", F.explode(F.regexp_extract_all(F.lower("title"), F.lit(r"[a-zа-яё0-9]{3,}"), F.lit(0))).alias("k")).distinct()
    return words.groupBy("site_host").agg(F.array_join(F.array_sort(F.collect_list("k")), " ").alias("keywords"))


@query(f"with f as (select distinct {_FOLDER} folder from {_REL}) select folder from f a where not exists (select 1 from f b where b.folder <> a.folder and (b.folder = '.' or starts_with(a.folder, b.folder || '/')))")
def scope_minimal(spark, folder):
    return C.minimal_scopes(_paths(spark, folder).select(C.parent_folder(F.col("path")).alias("folder")), "folder")


_QUERY = "release page page index"
_SCORE = " + ".join(f"((length(lower(text)) - length(replace(lower(text), '{t}', ''))) / {len(t)})::bigint" for t in C.query_terms(_QUERY))
_POS = "list_filter([" + ", ".join(f"instr(lower(text), '{t}')" for t in C.query_terms(_QUERY)) + "], lambda p: p > 0)"


@query(f"select doc_id, {_SCORE} score, case when len({_POS}) = 0 then trim(replace(substr(text, 1, 220), chr(10), ' ')) else trim(regexp_replace(substr(text, greatest(list_min({_POS}) - 1 - 73, 0) + 1, 220), '[\\s\\x{{A0}}]+', ' ', 'g')) end snippet from documents where {_SCORE} > 0 order by score desc, doc_id limit 20")
def lexical_search_topk(spark, folder):
    return C.search(table(spark, folder, "documents").select("doc_id", "text"), "doc_id", "text", _QUERY, 20)


@query("select doc_id, 'sha256:' || sha256(text) content_hash, substr(sha256(text), 1, 12) short_hash from documents")
def content_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", U.content_hash("text").alias("content_hash"), U.short_hash("text").alias("short_hash"))


def _versions(spark, folder):
    """Every snapshot as the later and as the earlier one of its pair: ``pair`` is the later one's number."""
    rows = table(spark, folder, "page_snapshots").select("snapshot_no", F.col("canonical_url").alias("url"), "content_hash").distinct()
    numbers = rows.select("snapshot_no").distinct()
    pairs = numbers.select(F.col("snapshot_no").alias("pair"), F.lag("snapshot_no").over(Window.orderBy("snapshot_no")).alias("earlier")).where("earlier is not null")  # a row for every snapshot taken
    now = rows.join(pairs.select(F.col("pair").alias("snapshot_no")), "snapshot_no").withColumnRenamed("snapshot_no", "pair")
    return rows.join(pairs.withColumnRenamed("earlier", "snapshot_no"), "snapshot_no").select("pair", "url", "content_hash"), now.select("pair", "url", "content_hash")


_VERSIONS = "n as (select snapshot_no pair, lag(snapshot_no) over (order by snapshot_no) earlier from (select distinct snapshot_no from page_snapshots)), o as (select distinct pair, canonical_url url, content_hash from page_snapshots join n on snapshot_no = earlier), c as (select distinct pair, canonical_url url, content_hash from page_snapshots join n on snapshot_no = pair where earlier is not null)"


@query(f"with {_VERSIONS}, a as (select pair, url, max(content_hash) h from o where content_hash is not null group by 1, 2), b as (select pair, url, max(content_hash) h from c where content_hash is not null group by 1, 2) select coalesce(a.pair, b.pair) pair, coalesce(a.url, b.url) url, case when a.h is null then 'added' when b.h is null then 'deleted' when a.h = b.h then 'unchanged' else 'changed' end status from a full join b on a.pair = b.pair and a.url = b.url")
def sync_report(spark, folder):
    """The change report between every two consecutive catalogs."""
    before, now = _versions(spark, folder)
    return C.sync_report(before, now, ["pair", "url"], "content_hash")


@query(f"with {_VERSIONS}, w as (select * from c where contains(url, '/guides/')) select * from o where not contains(url, '/guides/') union all select * from o where contains(url, '/guides/') and not exists (select 1 from w where w.pair = o.pair and w.url = o.url) union all select * from w")
def catalog_merge(spark, folder):
    """Every catalog merged with what the next one has in one scope."""
    before, now = _versions(spark, folder)
    scope = F.contains("url", F.lit("/guides/"))
    return C.merge_catalog(before, now.where(scope), ["pair", "url"], scope)


# A saved structure, the pages of now and an earlier catalog, as the operators of the layout take them.
def _structure(spark, folder):
    n = table(spark, folder, "nav_entries").select("entry_id", "canonical_url", "link_text", "depth", "nav_parent_url", "fetch_url").distinct()
    titled = F.coalesce("link_text", F.lit("")) != ""
    return n.select(
        U.canonical_url("canonical_url").alias("url"), F.col("link_text").alias("title"), "depth", F.when(titled, F.array("link_text")).otherwise(F.array().cast("array<string>")).alias("nav_path"),
        U.canonical_url("nav_parent_url").alias("parent"), "fetch_url", F.when(F.col("entry_id") % 2 == 0, F.concat(F.lit("nav/"), "entry_id", F.lit(".md"))).alias("path"), F.col("entry_id").alias("ord"),
    )


_ST = f"st as (select {canon_sql('canonical_url')} url, link_text title, depth, case when coalesce(link_text, '') <> '' then [link_text] else [] end nav_path, {canon_sql('nav_parent_url')} parent, fetch_url, case when entry_id % 2 = 0 then 'nav/' || entry_id || '.md' end path, entry_id ord from (select distinct entry_id, canonical_url, link_text, depth, nav_parent_url, fetch_url from nav_entries))"


def _now(spark, folder):
    p = table(spark, folder, "mirror_pages").where("run_no >= 2").groupBy(F.col("canonical_url").alias("url")).agg(
        F.max("title").alias("title"), F.min("depth").alias("depth"), F.min("parent_url").alias("parent"), F.min("placeholder").alias("placeholder"), F.lit(None).cast("string").alias("markdown")
    )
    return p.withColumn("nav_path", F.when(F.col("title") != "", F.array(F.lit("Docs"), F.col("title"))).otherwise(F.array().cast("array<string>")))


_PG = "pg as (select *, case when title <> '' then ['Docs', title] else [] end nav_path from (select canonical_url url, max(title) title, min(depth) depth, min(parent_url) parent, bool_and(placeholder) placeholder from mirror_pages where run_no >= 2 group by 1))"


def _previous(spark, folder):
    s = table(spark, folder, "page_snapshots").select("snap_row_id", "snapshot_no", U.canonical_url("canonical_url").alias("url"), "title", "placeholder", "content_hash").distinct()
    natural = U.markdown_relpath("url")
    path = F.when(F.col("snapshot_no") % 2 == 0, natural).otherwise(F.concat(F.lit("old/"), natural))
    return s.select("url", path.alias("path"), F.when(F.col("title").isNotNull() & (F.col("snap_row_id") % 3 == 0), F.array("title")).otherwise(F.array().cast("array<string>")).alias("nav_path"), F.coalesce("placeholder", F.lit(False)).alias("placeholder"), "content_hash", F.col("snap_row_id").alias("ord"))


_PV = f"pv as (select url, case when snapshot_no % 2 = 0 then {rel_sql('url')} else 'old/' || {rel_sql('url')} end path, case when title is not null and snap_row_id % 3 = 0 then [title] else [] end nav_path, coalesce(placeholder, false) placeholder, content_hash, snap_row_id ord from (select distinct snap_row_id, snapshot_no, {canon_sql('canonical_url')} url, title, placeholder, content_hash from page_snapshots))"
_SCOPES = ["guides", "install", "nav", "old/guides"]
_SCOPES_SQL = "sc as (select unnest(['guides', 'install', 'nav', 'old/guides']) folder)"


def _scopes(spark):
    return spark.createDataFrame([(x,) for x in _SCOPES], "folder string")


_ANC = f"{_ST}, {_PG}, up as (select url, arg_max(parent, ord) above from st where url <> '' and parent <> '' group by 1), anc as (select above url from pg join up using (url) where not coalesce(placeholder, false) union select up.above from anc join up using (url))"


@query(f"with recursive {_ANC} select url from anc")
def structure_ancestors(spark, folder):
    """Everything in the structure above a page."""
    return S.structure_ancestors(_now(spark, folder), _structure(spark, folder))


@query(f"""with recursive {_ANC}, {_PV}, {_SCOPES_SQL},
    e as (select url, arg_max(struct_pack(d := depth, n := nav_path, p := parent), ord) s, arg_min(struct_pack(t := title, f := fetch_url, p := path), ord) f, min(ord) ord from st where url <> '' and len(nav_path) > 0 group by 1),
    o as (select e.* from e where url not in (select url from pg) and url not in (select url from pv where not placeholder and url <> '')),
    m as (select o.*, coalesce(nullif((o.f).p, ''), {rel_sql('o.url')}) path from o),
    i as (select * from m where url in (select url from anc) or exists (select 1 from sc where path = folder or starts_with(path, folder || '/')))
    select pg.url, pg.title, case when e.url is not null then coalesce((e.s).d, 0) else pg.depth end depth, case when e.url is not null then (e.s).n else pg.nav_path end nav_path, case when e.url is not null then nullif((e.s).p, '') else pg.parent end parent,
      coalesce(pg.placeholder, false) placeholder, null markdown, coalesce(e.ord, (select count(*) + 1 from st))::bigint ord from pg left join e using (url)
    union all select url, coalesce(nullif((f).t, ''), list_extract((s).n, -1)), coalesce((s).d, 0), (s).n, nullif((s).p, ''), true, '# ' || coalesce(nullif((f).t, ''), list_extract((s).n, -1)) || chr(10) || chr(10) || 'Раздел ожидает отдельного зеркалирования.' || chr(10) || chr(10) || 'Источник: ' || coalesce(nullif((f).f, ''), url) || chr(10), ord::bigint from i""")
def structure_overlay(spark, folder):
    """Pages placed by the saved structure, and placeholders for what isn't mirrored yet."""
    return S.overlay(_now(spark, folder), _structure(spark, folder), _previous(spark, folder), _scopes(spark))


_REUSE = f"(len(nav_path) > 0 or split_part({rel_sql('url')}, '/', 1) in ('index.md', '_index.md') or lower(split_part(path, '/', 1)) = lower(split_part({rel_sql('url')}, '/', 1)))"
_PATHS = f"""{_ST}, {_PG}, {_PV},
    pl as (select url, arg_min(path, ord) path from st where url <> '' and len(nav_path) > 0 and path <> '' group by 1), ea as (select url, arg_max(path, ord) path from pv where {_REUSE} group by 1),
    wa as (select nav_path above, arg_max(path, ord) path from pv where len(nav_path) > 0 group by 1),
    cu as (select pg.url, coalesce(pl.path, ea.path, case when wa.path is not null then case when contains(wa.path, '/') then regexp_replace(wa.path, '/[^/]*$', '') || '/' else '' end || case when suffix({rel_sql('pg.url')}, '_index.md') then array_to_string(list_slice(string_split({rel_sql('pg.url')}, '/'), -2, -1), '/') else list_extract(string_split({rel_sql('pg.url')}, '/'), -1) end end, {rel_sql('pg.url')}) path
      from pg left join pl using (url) left join ea using (url) left join wa on len(pg.nav_path) > 1 and wa.above = list_slice(pg.nav_path, 1, len(pg.nav_path) - 1))"""


@query(f"with {_PATHS} select url, path from cu")
def page_paths(spark, folder):
    """Where every page goes: by the structure, by the earlier catalog, by its neighbours or by its address."""
    return S.page_paths(_now(spark, folder), _structure(spark, folder), _previous(spark, folder))


@query(f"with {_PATHS}, k as (select url, arg_max(path, ord) path from pv where not placeholder and {_REUSE} group by 1) select url, path from cu union all select url, path from k where url not in (select url from cu)")
def merged_paths(spark, folder):
    return S.merge_paths(page_paths(spark, folder), _previous(spark, folder))


@query(f"with {_PATHS} select distinct pv.path from pv join cu using (url) where pv.path <> cu.path")
def relocated_paths(spark, folder):
    return S.relocated_paths(_previous(spark, folder), page_paths(spark, folder))


@query(f"with {_PATHS}, {_SCOPES_SQL}, u as (select distinct path from pv where url in (select url from cu) and path not in (select path from cu)) select path from u where exists (select 1 from sc where path = folder or starts_with(path, folder || '/')) union select pv.path from pv join cu using (url) where pv.path <> cu.path")
def stale_paths(spark, folder):
    """Files to delete: those of relocated pages, and what no page has any more."""
    return S.stale_paths(_previous(spark, folder), page_paths(spark, folder), _scopes(spark))


@query(f"with {_PATHS}, {_SCOPES_SQL}, h as (select path, max(content_hash) content_hash from pv where content_hash is not null group by 1) select h.* from h where path in (select pv.path from pv join cu using (url)) and exists (select 1 from sc where path = folder or starts_with(path, folder || '/'))")
def scoped_hashes(spark, folder):
    previous = _previous(spark, folder)
    hashes = previous.where("content_hash is not null").groupBy("path").agg(F.max("content_hash").alias("content_hash"))
    return S.scoped_hashes(hashes, previous, page_paths(spark, folder), _scopes(spark))


@query(f"with f as (select distinct folder from (select {_FOLDER} folder from {_REL}) union select '.'), {_SCOPES_SQL} select f.folder from f where exists (select 1 from sc where f.folder = sc.folder or starts_with(f.folder, sc.folder || '/') or f.folder = '.' or starts_with(sc.folder, f.folder || '/'))")
def folders_to_refresh(spark, folder):
    folders = _paths(spark, folder).select(C.parent_folder(F.col("path")).alias("folder")).unionByName(spark.createDataFrame([(".",)], "folder string"))
    return S.folders_to_refresh(folders, _scopes(spark))


@query(f"with {_ST}, {_PG}, f as (select url, min(ord) ord from st where url <> '' group by 1) select pg.url, coalesce(f.ord, (select count(*) + 1 from st))::bigint ord from pg left join f using (url)")
def structure_order(spark, folder):
    return S.structure_order(_now(spark, folder), _structure(spark, folder)).select("url", "ord")


@query("select distinct canonical_url url, case when regexp_matches(canonical_url, '(?i)/content/') and not regexp_matches(lower(canonical_url), '/main_page\\.x?html?$') then regexp_extract(canonical_url, '^(.*?/content)/', 1, 'i') || '/main_page.htm' else canonical_url end root, regexp_replace(lower(regexp_extract(canonical_url, '^[a-z]+://([^/]*)', 1)), '[^a-z0-9._-]+', '-', 'g') folder from mirror_pages")
def structure_roots(spark, folder):
    """The help system's main page for every address, and the name of the mirror's folder."""
    u = table(spark, folder, "mirror_pages").select(F.col("canonical_url").alias("url")).distinct()
    return u.select("url", S.structure_root("url").alias("root"), S.source_root_name("url").alias("folder"))


@query("select arg_min(canonical_url, page_id) url from mirror_pages where starts_with(canonical_url, 'http')")
def mirror_source(spark, folder):
    return S.mirror_source(table(spark, folder, "mirror_pages").select(F.col("canonical_url").alias("url"), F.col("page_id").alias("ord")))


@query(f"with e as (select * from {_EDGES_SQL}), r as (select distinct canonical_url src from mirror_pages where run_no >= 3) select e.src, count(*) filter (r.src is null) kept, count(*) filter (r.src is not null) renewed from e left join r on e.src = r.src group by 1")
def partial_link_merge(spark, folder):
    redone = table(spark, folder, "mirror_pages").where("run_no >= 3").select(F.col("canonical_url").alias("src"), F.lit(True).alias("redone")).distinct()
    return _edges(spark, folder).join(redone, "src", "left").groupBy("src").agg(F.count_if(F.col("redone").isNull()).alias("kept"), F.count_if("redone").alias("renewed"))


_NAVC = canon_sql("canonical_url")


@query(f"select distinct {_NAVC} url from nav_entries where placeholder and {_NAVC} not in (select canonical_url from mirror_pages where not placeholder)")
def placeholder_pages(spark, folder):
    wanted = table(spark, folder, "nav_entries").where("placeholder").select(U.canonical_url("canonical_url").alias("url"))
    return C.missing_pages(wanted, table(spark, folder, "mirror_pages").select(F.col("canonical_url").alias("url"), "placeholder"))


_TREE = "select 'r' || r_regionkey id, null parent, r_name label, r_regionkey ord from region union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey, c_name, c_custkey from customer"


def _tree(spark, folder):
    r, n, c = (table(spark, folder, t) for t in ("region", "nation", "customer"))
    node = lambda df, id_, up, label, o: df.select(id_.alias("id"), up.alias("parent"), F.col(label).alias("label"), F.col(o).cast("bigint").alias("ord"))
    name = lambda letter, col: F.concat(F.lit(letter), F.col(col))
    return (
        node(r, name("r", "r_regionkey"), F.lit(None).cast("string"), "r_name", "r_regionkey")
        .unionByName(node(n, name("n", "n_nationkey"), name("r", "n_regionkey"), "n_name", "n_nationkey"))
        .unionByName(node(c, name("c", "c_custkey"), name("n", "c_nationkey"), "c_name", "c_custkey"))
    )


_WALK = f"with recursive t as ({_TREE}), w as (select id, id root, 0 depth, [ord] way, label path from t where parent is null union all select t.id, w.root, w.depth + 1, list_append(w.way, t.ord), w.path || ' / ' || t.label from t join w on t.parent = w.id) "


def _solved(spark, folder):
    """The tree solved with paths, its nodes numbered: regions, nations, customers."""
    tree = _tree(spark, folder)
    base = F.when(F.startswith("id", F.lit("r")), 0).when(F.startswith("id", F.lit("n")), 1).otherwise(2)
    number = (F.substring("id", 2, 20).cast("bigint") * 3 + base).alias("no")
    rows = store(tree.select(number, "id", "parent", "ord", F.lit("t").alias("tree")))
    return rows, cut(H.resolve_hierarchy(rows, "no", "id", "parent", "tree", with_paths=True))


@query(_WALK + "select id, root, depth::bigint depth, row_number() over (partition by root order by way) position from w")
def nav_preorder(spark, folder):
    rows, solved = _solved(spark, folder)
    names = rows.select(F.col("no").alias("root_id"), F.col("id").alias("root"))
    placed = H.preorder(solved, rows.select(F.col("no").alias("id"), "ord"))
    return placed.join(names, "root_id").join(rows.select(F.col("no").alias("id"), F.col("id").alias("name")), "id").select(F.col("name").alias("id"), "root", "depth", "position")


@query(_WALK + ", a as (select id, id up from t union all select a.id, t.parent from a join t on a.up = t.id where t.parent is not null) select up id, count(*) - 1 descendants from a group by 1")
def nav_ancestors(spark, folder):
    _, solved = _solved(spark, folder)
    below = H.descendants(solved).groupBy(F.col("ancestor_id").alias("id")).agg(F.count(F.lit(1)).alias("descendants"))
    return solved.join(below, "id", "left").select(F.col("key").alias("id"), F.coalesce("descendants", F.lit(0)).alias("descendants"))


@query(_WALK + "select id, depth::bigint depth from w where root = 'r2'")
def subtree_select(spark, folder):
    _, solved = _solved(spark, folder)
    top = solved.where("key = 'r2'").select(F.col("id").alias("up"))
    return solved.select("key", "depth", F.explode("path").alias("up")).join(top, "up", "left_semi").select(F.col("key").alias("id"), "depth")


@query(f"select parent, id, row_number() over (partition by parent order by ord, id) \"position\" from ({_TREE})")
def sibling_order(spark, folder):
    return C.sibling_order(_tree(spark, folder), "parent", "id", F.col("ord")).withColumn("position", F.col("position").cast("bigint"))


@query(f"select parent, string_agg(id, ',' order by ord, id) children from ({_TREE}) where parent is not null group by 1")
def children_lists(spark, folder):
    return C.children_lists(_tree(spark, folder), "parent", "id", F.col("ord")).select("parent", F.array_join("children", ",").alias("children"))


@query(f"with p as (select distinct canonical_url url, regexp_extract(canonical_url, '^[a-z]+://[^/]*(/.*)$', 1) path from mirror_pages where not placeholder), s as (select {_NAVC} url, max(link_text) label from nav_entries where link_text <> '' group by 1) select coalesce(p.url, s.url) url, coalesce(p.path, s.label) target from p full join s on p.url = s.url")
def path_map_precedence(spark, folder):
    pages = table(spark, folder, "mirror_pages").select(F.col("canonical_url").alias("url"), U.url_path("canonical_url").alias("path"), "placeholder", F.lit(0).alias("ord"))
    planned = table(spark, folder, "nav_entries").select(U.canonical_url("canonical_url").alias("url"), F.col("link_text").alias("path"), F.lit(0).alias("ord"))
    return C.link_path_map(planned, pages).select("url", F.col("path").alias("target"))


@query("select l_orderkey page, l_returnflag kind, l_partkey source, min(l_linenumber)::bigint first_line from lineitem group by 1, 2, 3")
def asset_dedupe(spark, folder):
    assets = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("source"), F.col("l_linenumber").cast("bigint").alias("first_line"))
    return C.distinct_assets(assets, ["first_line"])


@query("select event_type kind, count(*) issues, count(*) filter (event_type = 'error') errors, count(*) filter (event_type <> 'error') warnings, case when count(*) filter (event_type = 'error') > 0 then 'errors' else 'ok' end status from events group by 1")
def issue_rollup(spark, folder):
    e = table(spark, folder, "events")
    error = F.col("event_type") == "error"
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("issues"), F.count_if(error).alias("errors"), F.count_if(~error).alias("warnings"), F.when(F.count_if(error) > 0, "errors").otherwise("ok").alias("status"))


@query("select site_host, page_id, case when rn <= 5 then 'fetch' else 'placeholder' end action from (select site_host, page_id, row_number() over (partition by site_host order by depth, page_id) rn from (select distinct site_host, page_id, depth from mirror_pages where depth <= 3))")
def max_pages_cap(spark, folder):
    p = _pages(spark, folder, "site_host", "depth").where("depth <= 3")
    rank = F.row_number().over(Window.partitionBy("site_host").orderBy("depth", "page_id"))
    return p.select("site_host", "page_id", F.when(rank <= 5, "fetch").otherwise("placeholder").alias("action"))


_NOISE = [*sorted(NOISE_LINES), "Dark mode", "Search", "Toggle navigation"]
_LINES = "(select page_id, i, string_split(m, chr(10))[i] line from (select page_id, max(markdown) m from mirror_pages where markdown is not null group by 1), unnest(range(1, len(string_split(m, chr(10))) + 1)) r(i))"
_LIST = ", ".join("'" + x + "'" for x in _NOISE)


def _texts(spark, folder):
    return table(spark, folder, "mirror_pages").where("markdown is not null").groupBy("page_id").agg(F.max("markdown").alias("m"))


@query(f"select page_id, md5(coalesce(string_agg(line, chr(10) order by i) filter ({_PLAIN} not in ({_LIST})), '')) digest from {_LINES} group by 1")
def noise_line_filter(spark, folder):
    return _texts(spark, folder).select("page_id", F.md5(pass_column(F.col("m"), lambda lines: drop_noise(lines, _NOISE))).alias("digest"))


@query(f"with n as (select page_id, i, line, {_PLAIN} t from {_LINES}), k as (select *, coalesce(t <> '' and t = lag(t) over (partition by page_id order by i), false) again from n) select page_id, md5(string_agg(line, chr(10) order by i) filter (not again)) digest from k group by 1")
def repeat_line_collapse(spark, folder):
    return _texts(spark, folder).select("page_id", F.md5(pass_column(F.col("m"), collapse_repeats)).alias("digest"))


@query(f"select page_id, md5(trim(regexp_replace(array_to_string(list_transform(string_split(m, chr(10)), lambda x: regexp_replace(x, '{_WS}+$', '')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))) digest from (select page_id, max(markdown) m from mirror_pages where markdown is not null group by 1)")
def blank_line_normalise(spark, folder):
    squeezed = pass_column(F.col("m"), lambda lines: read_lines(squeeze_blanks(x.raw for x in lines)))
    return _texts(spark, folder).select("page_id", F.md5(F.regexp_replace(squeezed, r"^\n+|\n+$", "")).alias("digest"))


_WIDE = "(p_size * 40)"


@query(f"select p_partkey, least({_WIDE}, 900)::bigint width, greatest(1, round_even((p_partkey % 700 + 20) * (least({_WIDE}, 900) / {_WIDE}), 0))::bigint height, greatest(1, round_even(100.0 * least({_WIDE}, 900) / {_WIDE}, 0))::bigint scale from part")
def image_scaling(spark, folder):
    width, height = F.col("p_size").cast("double") * 40, (F.col("p_partkey") % 700 + 20).cast("double")
    return table(spark, folder, "part").select("p_partkey", *C.scaled(width, height, 900))


@query("select entry_id, regexp_replace(lower(regexp_replace(max(link_text), '\\s+[-–—]\\s+.*$', '')), '[^0-9a-zа-яё]+', '', 'g') label_key from nav_entries group by 1")
def nav_label_key(spark, folder):
    return table(spark, folder, "nav_entries").groupBy("entry_id").agg(F.max("link_text").alias("t")).select("entry_id", C.nav_label_key(F.col("t")).alias("label_key"))


@query("select distinct page_id, to_json(toc_link_labels)::varchar labels, len(toc_link_labels)::bigint n from mirror_pages where toc_link_labels is not null")
def frontmatter_json(spark, folder):
    p = table(spark, folder, "mirror_pages").where("toc_link_labels is not null")
    return p.select("page_id", F.to_json("toc_link_labels").alias("labels"), F.size("toc_link_labels").cast("bigint").alias("n")).distinct()


@query(f"with recursive e as materialized (select * from {_EDGES_SQL}), b as (select distinct {canon_sql('root_url')} node, 0 depth from mirror_sites union select e.dst, b.depth + 1 from b join e on b.node = e.src where b.depth < 3) select node, min(depth)::bigint depth from b group by 1")
def bounded_bfs(spark, folder):
    starts = table(spark, folder, "mirror_sites").select(U.canonical_url("root_url").alias("node"))
    return C.bounded_bfs(_edges(spark, folder), starts, 3).select("node", F.col("depth").cast("bigint").alias("depth"))


@query("select distinct fetch_url, regexp_extract(fetch_url, '[?&]TocPath=([^&#]*)', 1) toc from nav_entries where regexp_extract(fetch_url, '[?&]TocPath=([^&#]*)', 1) <> ''")
def toc_paths(spark, folder):
    e = table(spark, folder, "nav_entries").select("fetch_url").distinct()
    return e.select("fetch_url", F.array_join(U.toc_path("fetch_url"), "|").alias("toc")).where("toc <> ''")


@query(None)
def normalize_markdown(spark, folder):
    """Every text through all clean-up passes."""
    p = table(spark, folder, "mirror_pages").where("markdown is not null").select("page_id", "markdown").distinct()
    return p.select("page_id", normalize_column(F.col("markdown")).alias("markdown"))


@query(None)
def mojibake_repair(spark, folder):
    """Texts, titles and descriptions with the simple repair, where it changes them."""
    fields = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("markdown", "title", "description")]))
    values = table(spark, folder, "mirror_pages").select("page_id", fields.alias("f")).select("page_id", "f.*").where("value is not null").distinct()
    return values.withColumn("repaired", repair_column(F.col("value"))).where("value <> repaired").select("page_id", "field_name", "repaired")


def _as_html():
    items = F.array_join(F.transform("links_internal", lambda u: F.concat(F.lit("<li><a href='"), u, F.lit("'>"), u, F.lit("</a>"))), "")
    return F.concat(F.lit("<html><head><title>"), "title", F.lit("</title></head><body><h1 id=top>"), "title", F.lit("</h1><p>"), F.coalesce("description", F.lit("")), F.lit("<ul class=TOC>"), items, F.lit("</ul></body></html>"))


@query(None)
def html_to_markdown(spark, folder):
    """Titles, texts and links of pages rendered as HTML and parsed again; the tables hold no HTML of their own."""
    p = table(spark, folder, "mirror_pages").where("title is not null").select("page_id", "canonical_url", "title", "description", "links_internal").distinct()
    return p.select("page_id", parse_column(_as_html(), F.col("canonical_url")).alias("d")).select("page_id", "d.title", "d.markdown", F.size("d.links").alias("links"), F.size("d.headings").alias("headings"))


@query("select page_id, len(list_distinct(links_internal))::int links, (coalesce(trim(title), '') <> '')::int headings from (select distinct page_id, title, links_internal from mirror_pages where title is not null)")
def html_links(spark, folder):
    """How many distinct links and headings the parser finds in that HTML."""
    p = table(spark, folder, "mirror_pages").where("title is not null").select("page_id", "canonical_url", "title", F.lit("").alias("description"), "links_internal").distinct()
    return p.select("page_id", parse_column(_as_html(), F.col("canonical_url")).alias("d")).select("page_id", F.size("d.links").alias("links"), F.size("d.headings").alias("headings")).distinct()


@query("select page_id, anchor, arg_min(heading_text, (ordinal, heading_text)) heading from (select page_id, ordinal, heading_text, unnest(anchors) anchor from page_headings) group by 1, 2")
def heading_anchors(spark, folder):
    """First heading text of every anchor of a page."""
    h = table(spark, folder, "page_headings").select("page_id", "ordinal", "heading_text", F.explode("anchors").alias("anchor"))
    return C.anchor_headings(h, "page_id", "anchor", "heading_text", "ordinal")


def _linked(spark, folder):
    """The texts by page, and all of their links with what they lead to."""
    return table(spark, folder, "mirror_pages").where("markdown is not null").select("page_id", F.col("canonical_url").alias("url"), "markdown").distinct()


_FENCED = "'(?ms)^[ \\t]*```.*?(?:^[ \\t]*```[^\\n]*$|\\z)'"
_TARGETS = (
    "tx as (select distinct page_id, canonical_url url, markdown from mirror_pages where markdown is not null), "
    "ta as (select distinct url, trim(t) target from (select url, unnest(regexp_extract_all(markdown, '\\]\\(([^()]+)\\)', 1)) t from tx) where trim(t) <> ''), "
    "tb as (select url, target, split_part(target, '#', 1) b from ta), "
    f"tc as (select url, target, case when b = '' then url when regexp_matches(b, '(?i)^https?:') then {canon_sql('b')} when starts_with(b, '/') then {canon_sql(chr(40) + 'regexp_extract(url, ' + chr(39) + '^[a-z]+://[^/]*' + chr(39) + ') || b' + chr(41))} end base from tb)"
)


@query(f"with {_TARGETS} select url, target, base from tc where base is not null")
def link_targets(spark, folder):
    """Every distinct target in the text of a page and the address it names, those relative to a folder aside."""
    pages = _linked(spark, folder).select("url", "markdown")
    base = F.regexp_replace("target", "#.*$", "")
    return R.page_targets(pages).where((base == "") | base.rlike(r"(?i)^(https?:|/)")).select("url", "target", "base").distinct()


@query(f"with {_TARGETS} select tc.url, tc.target, p.path from tc join {_REL} p on tc.base = p.canonical_url")
def mirrored_targets(spark, folder):
    """The targets that are mirrored pages, with the files they are in."""
    paths = _paths(spark, folder).withColumnRenamed("canonical_url", "base")
    return link_targets(spark, folder).join(paths, "base").select("url", "target", "path")


def _rewritten(spark, folder):
    headings = table(spark, folder, "page_headings").select("page_id", "heading_text", F.explode("anchors").alias("anchor"))
    urls = table(spark, folder, "mirror_pages").select("page_id", F.col("canonical_url").alias("url")).distinct()
    anchors = headings.join(urls, "page_id").select("url", "anchor", F.col("heading_text").alias("heading"))
    return R.rewrite_links(_linked(spark, folder), _paths(spark, folder).withColumnRenamed("canonical_url", "url"), anchors=anchors)


@query(None)
def link_rewrite(spark, folder):
    """Every text with its links to mirrored pages made relative, and its anchors those of headings."""
    return _rewritten(spark, folder).select("page_id", "path", "rewritten")


@query(None)
def link_entries(spark, folder):
    """The link catalog after rewriting."""
    return R.link_entries(_rewritten(spark, folder), _paths(spark, folder).withColumnRenamed("canonical_url", "url"))


@query(f"with {_TARGETS}, li as (select distinct tc.url, tc.target from tc join {_REL} p on tc.base = p.canonical_url where not starts_with(tc.target, '#')), tf as (select page_id, url, unnest(regexp_extract_all(regexp_replace(markdown, {_FENCED}, '', 'g'), '\\]\\(([^()]+)\\)', 1)) t from tx), ch as (select distinct page_id from tf join li on tf.url = li.url and trim(tf.t) = li.target) select (select count(*) from ch) changed, (select count(*) from tx) - (select count(*) from ch) unchanged, 0::bigint skipped")
def relink_counts(spark, folder):
    """How many texts rewriting changes; anchors are left as they are."""
    return R.relink_counts(R.rewrite_links(_linked(spark, folder), _paths(spark, folder).withColumnRenamed("canonical_url", "url")))


@query(f"""with k as {_KINDS_SQL}, l as (select count(*) filter (kind = 'internal') links_internal, count(*) filter (kind = 'internal_unresolved') links_internal_unresolved, count(*) filter (kind = 'external') links_external from k)
    select (select count(distinct canonical_url) from mirror_pages) pages, l.*, (select count(*) from part) assets, (select count(*) from part where p_size > 10) assets_localized, (select count(*) from events where event_type = 'error') errors, (select count(*) from events where event_type is distinct from 'error') warnings from l""")
def catalog_summary(spark, folder):
    """The summary row of a catalog; parts and events stand in for assets and issues."""
    pages = table(spark, folder, "mirror_pages").select("canonical_url").distinct()
    assets = table(spark, folder, "part").select(F.when(F.col("p_size") > 10, F.col("p_name")).alias("local_path"))
    issues = table(spark, folder, "events").select(F.col("event_type").alias("severity"))
    return S.catalog_summary(pages, link_resolve(spark, folder), assets, issues)


_CAP = 12
_FOUND = f"""
    x as (select canonical_url src, {canon_sql('links_internal[i]')} canonical_url, min(i) o from (select canonical_url, links_internal, unnest(range(1, len(links_internal) + 1)) i from mirror_pages) group by 1, 2),
    rt as (select src root, case when contains(regexp_extract(src, '([^/]*)$', 1), '.') then regexp_replace(src, '[^/]*$', '') else src end pre, regexp_extract(src, '^([a-z]+://[^/]*)', 1) host from x group by 1 order by count(*) desc, src limit 1),
    y as (select src, canonical_url dst, o, not (starts_with(canonical_url, host || '/') and starts_with(canonical_url, pre)) ph from x, rt
      where canonical_url <> src and canonical_url <> root and not {_SERVICE} and {_CANDIDATE} and (starts_with(canonical_url, host || '/') and (starts_with(canonical_url, pre) or ({_HTML} and not regexp_matches({_LAST}, '^main_page\\.x?html?$'))))),
    a1 as (select dst, ph, o, row_number() over (partition by ph order by o, dst) k from y, rt where src = root),
    l1 as (select dst url, 1 depth, ph placeholder, 1 + row_number() over (order by o, dst) ord from a1 where ph or k <= {_CAP} - 1),
    a2 as (select dst, ph, min((l1.ord, o, src)) m from y join l1 on y.src = l1.url and not l1.placeholder where dst not in (select url from l1) group by 1, 2),
    b2 as (select *, row_number() over (partition by ph order by m, dst) k from a2),
    l2 as (select dst url, 2 depth, (m)[3] parent, ph placeholder, (select 1 + count(*) from l1) + row_number() over (order by m, dst) ord from b2 where ph or k <= {_CAP} - 1 - (select count(*) from l1 where not placeholder))"""


@query(f"with {_FOUND} select root url, 0 depth, null parent, 1::bigint ord, false placeholder from rt union all select url, depth, root, ord, placeholder from l1, rt union all select url, depth, parent, ord, placeholder from l2")
def link_discovery(spark, folder):
    """What a crawl finds within two links of the page with the most links, twelve pages at most."""
    raw = table(spark, folder, "mirror_pages").select("canonical_url", F.posexplode("links_internal").alias("at", "link"))
    links = raw.groupBy(F.col("canonical_url").alias("src"), U.canonical_url("link").alias("dst")).agg(F.min("at").alias("ordinal")).withColumn("from_toc", F.lit(False))
    links = store(links)
    root = links.groupBy("src").count().orderBy(F.desc("count"), "src").first()
    return C.discover_links(links, root["src"] if root else "", 2, _CAP)


_EXTERNAL = f"select distinct canonical_url src, {canon_sql('link')} dst from (select canonical_url, unnest(links_external) link from mirror_pages)"
_LINKS = f"lk as (select distinct src, dst, case when u is not null then 'internal' else miss end kind from (select src, dst, 'internal_unresolved' miss from {_EDGES_SQL} union all select src, dst, 'external' from ({_EXTERNAL})) left join (select distinct canonical_url u from mirror_pages) on dst = u)"


@query(f"with {_LINKS} select * from lk")
def link_catalog(spark, folder):
    """Links of both lists, told by whether a page answers them."""
    external = table(spark, folder, "mirror_pages").select(F.col("canonical_url").alias("src"), F.explode("links_external").alias("link")).select("src", U.canonical_url("link").alias("dst"))
    return C.link_catalog(_edges(spark, folder), external, table(spark, folder, "mirror_pages").select(F.col("canonical_url").alias("url")))


@query(f"with {_LINKS} select 'warning' severity, 'link_unresolved' kind, dst message, src path from lk where kind = 'internal_unresolved'")
def link_warnings(spark, folder):
    return C.link_warnings(link_catalog(spark, folder))


@query(f"with {_PATHS}, {_SCOPES_SQL}, pp as (select pg.url, cu.path, pg.placeholder from pg join cu using (url)), fo as (select *, case when suffix(path, '_index.md') then case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end else path end fld from pp) select url, path, placeholder from fo where not coalesce(placeholder, false) or (url not in (select url from pv where not placeholder and url <> '') and exists (select 1 from sc where path = folder or starts_with(path, folder || '/') or fld = '.' or starts_with(folder, fld || '/')))")
def pages_to_write(spark, folder):
    """Pages with content, and placeholders in a scope or on the way to one."""
    pages = _now(spark, folder).select("url", "placeholder").join(page_paths(spark, folder), "url").select("url", "path", "placeholder")
    return S.pages_to_write(pages, _previous(spark, folder), _scopes(spark))
