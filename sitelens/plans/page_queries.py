"""Page lists, tabs, searches and their counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions.text import ascii_lower, status_class
from sitelens.functions.urls import normalize_url
from sitelens.operators.page_rules import is_html, is_success
from sitelens.operators.site_rules import is_indexable, url_keys
from sitelens.plans.rule_queries import sql_norm
from sitelens.sources import relations
from sitelens.sources.relations import SQL as BASE

c = F.col

#: Columns of a row in the page list.
SUMMARY = (
    "url", "status_code", "content_type", "body_size", "response_time", "crawl_depth", "title", "word_count", "error_count", "warning_count",
    "internal_link_count", "external_link_count", "image_count", "canonical_status", "noindex", "crawled_at",
)
# Sortable fields of the page list and their columns.
SORTS = {
    "url": "url", "statusCode": "status_code", "contentType": "content_type", "bodySize": "body_size", "responseTime": "response_time",
    "crawlDepth": "crawl_depth", "title": "title", "wordCount": "word_count", "h1Count": "size(h1s)", "errorCount": "error_count",
    "warningCount": "warning_count", "internalLinkCount": "internal_link_count", "externalLinkCount": "external_link_count",
    "imageCount": "image_count", "crawledAt": "crawled_at",
}


def tab(name: str) -> Column:
    """Predicate of a tab of the page list; null content types and statuses belong to no tab."""
    like_html = F.lower("content_type").contains("html")
    return {
        "all": F.lit(True),
        "internal": like_html & (c("status_code") < 300),
        "html": like_html,
        "redirects": (c("status_code") >= 300) & (c("status_code") < 400),
        "errors": c("status_code") >= 400,
        "issues": (c("error_count") > 0) | (c("warning_count") > 0),
        "noindex": c("noindex") | (c("status_code") >= 400) | (c("canonical_status") == "other"),
    }[name]


_TAB_SQL = {
    "internal": "lower(content_type) like '%html%' and status_code < 300",
    "html": "lower(content_type) like '%html%'",
    "redirects": "status_code >= 300 and status_code < 400",
    "errors": "status_code >= 400",
    "issues": "error_count > 0 or warning_count > 0",
    "noindex": "noindex or status_code >= 400 or canonical_status = 'other'",
}


def wanted(tab_name: str = "all", search: str | None = None, since=None) -> Column:
    """Predicate of a tab narrowed by a search and a time."""
    out = tab(tab_name)
    if search:
        q = f"%{search.lower()}%"
        out = out & (ascii_lower(c("url")).like(q) | ascii_lower(F.coalesce("title", F.lit(""))).like(q))
    if since is not None:
        out = out & (c("crawled_at") > F.lit(since).cast("timestamp"))
    return out


def listed_indexable() -> Column:
    return F.coalesce(c("status_code").between(200, 299) & ~c("noindex") & (c("canonical_status") != "other"), F.lit(False))


def page_list(pages: DataFrame, tab_name: str = "all", search: str | None = None, since=None) -> DataFrame:
    """Rows of the page list with ``is_indexable``; search and since narrow the tab.

    In a search ``%`` and ``_`` are wildcards and case is ignored for A-Z; a null
    title counts as empty.  ``since`` keeps rows crawled strictly later.
    """
    return pages.where(wanted(tab_name, search, since)).withColumn("is_indexable", listed_indexable())


def sort_order(sort: str, direction: str) -> list[Column]:
    key = F.expr(SORTS.get(sort, SORTS["crawledAt"]))
    return [key.desc_nulls_last() if direction == "desc" else key.asc_nulls_first(), c("id").asc()]


def sorted_pages(pages: DataFrame, sort: str = "crawledAt", direction: str = "asc", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Pages by a sortable field, unknown fields by crawl time; nulls first ascending, last descending; ties by id.

    Without a limit the offset is ignored; a negative offset counts as 0.
    """
    out = pages.orderBy(*sort_order(sort, direction))
    return out if limit is None else out.offset(max(0, offset)).limit(limit)


def scan_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their number in crawl order within the audit."""
    w = Window.partitionBy("audit_id").orderBy("crawled_at", "id")
    return relations.pages(spark, d, "url", "crawled_at").withColumn("seq", F.row_number().over(w)).select("audit_id", "id", "url", "seq")


def pages_since(spark: SparkSession, d: str) -> DataFrame:
    return relations.pages(spark, d, "url", where=wanted(since="2026-03-01 00:00:00")).select("audit_id", "id", "url")


def page_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The page behind each seed: point lookups by (audit, url) as one join."""
    seeds = relations.audits(spark, d).select(c("id").alias("audit_id"), normalize_url(c("seed_url")).alias("u"))
    return relations.pages(spark, d, "url", "status_code").withColumn("u", normalize_url(c("url"))).join(seeds, ["audit_id", "u"]).select("audit_id", "id", "url", "status_code")


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return relations.pages(spark, d, "url", "exact_hash", "sim_hash").where("exact_hash is not null").select("audit_id", "url", "exact_hash", "sim_hash")


def _list_query(name: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = relations.pages(spark, d, "url", "status_code", "title", "noindex", "canonical_status", where=wanted(name))
        return p.select("audit_id", "id", "url", "status_code", "title", listed_indexable().alias("is_indexable"))

    run.__doc__ = f"Rows of the tab {name}."
    return run


def page_search(spark: SparkSession, d: str) -> DataFrame:
    return relations.pages(spark, d, "url", where=wanted(search="kettle")).select("audit_id", "id", "url")


def indexability(spark: SparkSession, d: str) -> DataFrame:
    p = relations.pages(spark, d, "url", "canonical", "noindex", "status_code")
    return p.select("id", is_indexable().alias("indexable"))


def canonical_status(spark: SparkSession, d: str) -> DataFrame:
    """missing, self or other, from the URLs themselves."""
    p = relations.pages(spark, d, "url", "canonical")
    same = normalize_url(c("canonical")) == normalize_url(c("url"))
    return p.select("id", F.when(c("canonical").isNull(), "missing").when(same, "self").otherwise("other").alias("status"))


def status_classes(spark: SparkSession, d: str) -> DataFrame:
    p = relations.pages(spark, d, "status_code")
    kind = F.when(c("status_code").isin(301, 308), "permanent").when(c("status_code").isin(302, 303, 307), "temporary").when(c("status_code") == 410, "gone").when(c("status_code") == 429, "throttled")
    return p.groupBy(status_class(c("status_code")).alias("class"), F.coalesce(kind, F.lit("")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_if(c("status_code") >= 400).alias("broken"))


def body_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether a body of that content type would be downloaded: unknown, text, JSON or XML."""
    ct = F.lower("content_type")
    p = relations.pages(spark, d, "content_type")
    return p.select("id", (ct.isNull() | ct.contains("text/") | ct.contains("json") | ct.contains("xml")).alias("download"))


def page_detail(spark: SparkSession, d: str) -> DataFrame:
    """One row per page: response facts, link counts by kind, numbers of nested entries."""
    p = relations.pages(spark, d, "url", "status_code", "content_type", "redirect_chain", "hreflangs", "headers", "links", "canonical")
    anchors = lambda inside: F.size(F.filter("links", lambda x: (x["type"] == "anchor") & (x["internal"] == inside)))
    return p.select(
        "id", "url", "status_code", anchors(True).alias("internal"), anchors(False).alias("external"),
        F.size(F.filter("links", lambda x: x["type"] == "image")).alias("images"),
        F.coalesce(F.size("redirect_chain"), F.lit(0)).alias("hops"), F.coalesce(F.size("hreflangs"), F.lit(0)).alias("alternates"),
        F.when(c("headers").isNull(), 0).otherwise(F.size("headers")).alias("n_headers"),
    )


def page_by_url(spark: SparkSession, d: str) -> DataFrame:
    return url_keys(relations.pages(spark, d, "url", "final_url", "crawled_at"))


def tab_counts(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of pages per audit and tab, in one pass."""
    p = relations.pages(spark, d, "content_type", "status_code", "error_count", "warning_count", "noindex", "canonical_status")
    return p.groupBy("audit_id").agg(*[F.count_if(tab(t)).alias(f"n_{t}") for t in ("all", *_TAB_SQL)])


def page_counts(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each audit: all, and those a search finds among the errors."""
    p = relations.pages(spark, d, "status_code", "url", "title")
    hit = tab("errors") & (ascii_lower(c("url")).like("%blog%") | ascii_lower(F.coalesce("title", F.lit(""))).like("%blog%"))
    return p.groupBy("audit_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("found"))


def page_total(spark: SparkSession, d: str) -> DataFrame:
    """Totals beside a delta: the total leaves the delta's start out of account."""
    p = relations.pages(spark, d, "crawled_at")
    return p.groupBy("audit_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(c("crawled_at") > F.lit("2026-03-01 00:00:00").cast("timestamp")).alias("delta"))


def _sort_query(field: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        column = "h1s" if field == "h1Count" else SORTS[field]
        pages = relations.pages(spark, d, *([] if column == "id" else [column]))
        place = lambda direction: F.row_number().over(Window.partitionBy("audit_id").orderBy(*sort_order(field, direction)))
        return pages.select("audit_id", "id", place("asc").alias("ascending"), place("desc").alias("descending"))

    run.__doc__ = f"The place of every page of an audit by {field}, in either direction."
    return run


def page_paged(spark: SparkSession, d: str) -> DataFrame:
    return sorted_pages(relations.pages(spark, d, "url", "response_time"), "responseTime", "desc", limit=50, offset=100).select("id", "url")


def link_summary(spark: SparkSession, d: str) -> DataFrame:
    """Internal anchors, external anchors and images of every page."""
    anchors = lambda inside: F.size(F.filter("links", lambda x: (x["type"] == "anchor") & (x["internal"] == inside)))
    p = relations.pages(spark, d, "links").where("links is not null")
    return p.select("id", anchors(True).alias("internal"), anchors(False).alias("external"), F.size(F.filter("links", lambda x: x["type"] == "image")).alias("images"))


def link_summary_json(spark: SparkSession, d: str) -> DataFrame:
    """The same counts from links stored as JSON text: parsed, exploded, aggregated."""
    p = relations.pages(spark, d, "links").select("id", F.to_json("links").alias("doc"))
    link = F.from_json("doc", "array<struct<type string, internal boolean>>")
    rows = p.select("id", F.explode_outer(link).alias("l"))
    return rows.groupBy("id").agg(
        F.count_if((c("l.type") == "anchor") & c("l.internal")).alias("internal"),
        F.count_if((c("l.type") == "anchor") & ~c("l.internal")).alias("external"), F.count_if(c("l.type") == "image").alias("images"),
    )


def link_facts(spark: SparkSession, d: str) -> DataFrame:
    """Links by type and relation with the predicates crawling uses."""
    links = relations.pages(spark, d, "links").select(F.explode("links").alias("l")).select("l.*")
    resource = c("type").isin("image", "script", "stylesheet", "preload", "modulepreload", "video", "audio", "font", "prefetch")
    return links.groupBy("type", "rel", "internal").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(resource).alias("resources"), F.count_if((c("type") == "anchor") & (c("rel") == "follow")).alias("followable")
    )


def link_split(spark: SparkSession, d: str) -> DataFrame:
    """Three lists of link targets per page as joined text: internal, external, images."""
    p = relations.pages(spark, d, "links")
    pick = lambda cond: F.array_join(F.transform(F.filter("links", cond), lambda x: x["url"]), " ")
    return p.select(
        "id", pick(lambda x: (x["type"] == "anchor") & x["internal"]).alias("internal"),
        pick(lambda x: (x["type"] == "anchor") & ~x["internal"]).alias("external"), pick(lambda x: x["type"] == "image").alias("images"),
    )


def external_refs(spark: SparkSession, d: str) -> DataFrame:
    """External anchor targets with the pages that name them: (url, n_links, n_pages)."""
    rows = relations.pages(spark, d, "links").select("id", F.explode("links").alias("l")).where("l.type = 'anchor' and not l.internal")
    return rows.groupBy(c("l.url").alias("url")).agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("id").alias("n_pages"))


def external_links(spark: SparkSession, d: str) -> DataFrame:
    """External checks with the URL of their source page, if that page is known."""
    x = relations.external_checks(spark, d)
    p = relations.pages(spark, d, "url").select(c("id").alias("source_page_id"), c("url").alias("source_url"))
    return x.join(p, "source_page_id", "left").select("audit_id", "url", "status_code", "source_page_id", "source_url")


def pages_with_externals(spark: SparkSession, d: str) -> DataFrame:
    """Pages and external checks as one list; a check without an answer has status 0, which counts as an error."""
    p = relations.pages(spark, d, "url", "status_code").select("audit_id", "url", "status_code", F.lit(False).alias("external"))
    x = relations.external_checks(spark, d).groupBy("audit_id", "url").agg(F.coalesce(F.max("status_code"), F.lit(0)).alias("status_code"))
    x = x.select("audit_id", "url", "status_code", F.lit(True).alias("external"))
    every = p.unionByName(x)
    return every.groupBy("audit_id", "external").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(c("status_code").between(300, 399)).alias("redirects"), F.count_if((c("status_code") >= 400) | (c("status_code") == 0)).alias("errors")
    )


def ui_tab_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counters beside the tabs: 'all' adds every external check row to the pages."""
    p = relations.pages(spark, d).groupBy("audit_id").agg(F.count(F.lit(1)).alias("pages"))
    x = relations.external_checks(spark, d).groupBy("audit_id").agg(F.count(F.lit(1)).alias("checks"), F.countDistinct("url").alias("externals"))
    return p.join(x, "audit_id", "left").select("audit_id", (c("pages") + F.coalesce("checks", F.lit(0))).alias("n_all"), F.coalesce("externals", F.lit(0)).alias("n_external"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_pages": scan_pages, "pages_since": pages_since, "page_lookup": page_lookup, "fingerprints": fingerprints, "page_list": _list_query("all"),
    **{f"tab_{t}": _list_query(t) for t in _TAB_SQL}, "page_search": page_search, "indexability": indexability, "canonical_status": canonical_status,
    "status_class": status_classes, "body_gate": body_gate, "page_detail": page_detail, "page_by_url": page_by_url, "tab_counts": tab_counts,
    "page_counts": page_counts, "page_total": page_total, "page_paged": page_paged, "link_summary": link_summary, "link_summary_json": link_summary_json,
    "link_facts": link_facts, "link_split": link_split, "external_refs": external_refs, "external_links": external_links,
    "pages_with_externals": pages_with_externals, "ui_tab_counts": ui_tab_counts,
    **{f"page_sort_{f}": _sort_query(f) for f in SORTS},
}

_IDX = "coalesce(status_code between 200 and 299 and not noindex and canonical_status <> 'other', false) as is_indexable"
_ROW = f"select audit_id, id, url, status_code, title, {_IDX} from p"
_ANCHOR = "cast(len(list_filter(links, lambda x: x.type = 'anchor' and {})) as int)"
_IMAGES = "cast(len(list_filter(links, lambda x: x.type = 'image')) as int)"
_JOIN = "array_to_string(list_transform(list_filter(links, lambda x: {}), lambda x: x.url), ' ')"

SQL = {k: BASE + v for k, v in {
    "scan_pages": "select audit_id, id, url, row_number() over (partition by audit_id order by crawled_at, id) as seq from p",
    "pages_since": "select audit_id, id, url from p where crawled_at > timestamp '2026-03-01 00:00:00'",
    "page_lookup": f"select p.audit_id, p.id, p.url, p.status_code from p join a on a.id = p.audit_id and {sql_norm('p.url')} = {sql_norm('a.seed_url')}",
    "fingerprints": "select audit_id, url, exact_hash, sim_hash from p where exact_hash is not null",
    "page_list": _ROW,
    **{f"tab_{t}": f"{_ROW} where {w}" for t, w in _TAB_SQL.items()},
    "page_search": "select audit_id, id, url from p where lower(url) like '%kettle%' or lower(coalesce(title, '')) like '%kettle%'",
    "indexability": f"select id, coalesce(status_code between 200 and 299, false) and not coalesce(noindex, false) and not coalesce({sql_norm('canonical')} <> {sql_norm('url')}, false) as indexable from p",
    "canonical_status": f"select id, case when canonical is null then 'missing' when {sql_norm('canonical')} = {sql_norm('url')} then 'self' else 'other' end as status from p",
    "status_class": """select case when status_code between 100 and 599 then status_code // 100 || 'xx' end as class, case when status_code in (301, 308) then 'permanent'
        when status_code in (302, 303, 307) then 'temporary' when status_code = 410 then 'gone' when status_code = 429 then 'throttled' else '' end as kind,
        count(*) as n, count(*) filter (status_code >= 400) as broken from p group by 1, 2""",
    "body_gate": "select id, content_type is null or contains(lower(content_type), 'text/') or contains(lower(content_type), 'json') or contains(lower(content_type), 'xml') as download from p",
    "page_detail": f"select id, url, status_code, {_ANCHOR.format('x.internal')} as internal, {_ANCHOR.format('not x.internal')} as external, {_IMAGES} as images, len(redirect_chain) as hops, len(hreflangs) as alternates, case when headers is null then 0 else cardinality(headers) end as n_headers from p",
    "page_by_url": f""", n as (select audit_id, id, crawled_at, {sql_norm('url')} as key from p union all select audit_id, id, crawled_at, {sql_norm('final_url')} from p where final_url is not null)
        select audit_id, key, arg_min(id, (crawled_at, id)) as page_id from n group by all""",
    "tab_counts": "select audit_id, count(*) as n_all, " + ", ".join(f"count(*) filter ({w}) as n_{t}" for t, w in _TAB_SQL.items()) + " from p group by 1",
    "page_counts": "select audit_id, count(*) as total, count(*) filter (status_code >= 400 and (lower(url) like '%blog%' or lower(coalesce(title, '')) like '%blog%')) as found from p group by 1",
    "page_total": "select audit_id, count(*) as total, count(*) filter (crawled_at > timestamp '2026-03-01 00:00:00') as delta from p group by 1",
    "page_paged": "select id, url from p order by response_time desc nulls last, id limit 50 offset 100",
    "link_summary": f"select id, {_ANCHOR.format('x.internal')} as internal, {_ANCHOR.format('not x.internal')} as external, {_IMAGES} as images from p where links is not null",
    "link_summary_json": f"select id, coalesce({_ANCHOR.format('x.internal')}, 0) as internal, coalesce({_ANCHOR.format('not x.internal')}, 0) as external, coalesce({_IMAGES}, 0) as images from p",
    "link_facts": """, l as (select unnest(links) as l from p) select l.type, l.rel, l.internal, count(*) as n,
        count(*) filter (l.type in ('image', 'script', 'stylesheet', 'preload', 'modulepreload', 'video', 'audio', 'font', 'prefetch')) as resources,
        count(*) filter (l.type = 'anchor' and l.rel = 'follow') as followable from l group by all""",
    "link_split": f"select id, {_JOIN.format(chr(120) + '.type = ' + repr('anchor') + ' and x.internal')} as internal, {_JOIN.format('x.type = ' + repr('anchor') + ' and not x.internal')} as external, {_JOIN.format('x.type = ' + repr('image'))} as images from p",
    "external_refs": ", l as (select id, unnest(links) as l from p) select l.url as url, count(*) as n_links, count(distinct id) as n_pages from l where l.type = 'anchor' and not l.internal group by 1",
    "external_links": "select x.audit_id, x.url, x.status_code, x.source_page_id, p.url as source_url from x left join p on p.id = x.source_page_id",
    "pages_with_externals": """, e as (select audit_id, url, status_code, false as ext from p union all
        select audit_id, url, coalesce(max(status_code), 0), true from x group by audit_id, url)
        select audit_id, ext as external, count(*) as n, count(*) filter (status_code between 300 and 399) as redirects, count(*) filter (status_code >= 400 or status_code = 0) as errors from e group by all""",
    "ui_tab_counts": """, pc as (select audit_id, count(*) as n from p group by 1), xc as (select audit_id, count(*) as n, count(distinct url) as u from x group by 1)
        select pc.audit_id, pc.n + coalesce(xc.n, 0) as n_all, coalesce(xc.u, 0) as n_external from pc left join xc using (audit_id)""",
    **{
        f"page_sort_{f}": f"""select audit_id, id, row_number() over (partition by audit_id order by {col.replace('size(', 'len(')} asc nulls first, id) as ascending,
        row_number() over (partition by audit_id order by {col.replace('size(', 'len(')} desc nulls last, id) as descending from p"""
        for f, col in SORTS.items()
    },
}.items()}
