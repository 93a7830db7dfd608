"""Frontier, robots, sitemaps, redirects, parsing and URL functions over the recorded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import directives, fingerprint, urls
from sitelens.functions.robots import verdict
from sitelens.functions.text import is_blank
from sitelens.operators import frontier
from sitelens.operators.page_rules import header
from sitelens.operators.site_rules import sample_sitemap
from sitelens.plans.rule_queries import sql_decode, sql_norm
from sitelens.session import table
from sitelens.sources import html, redirects, relations, robots, sitemap
from sitelens.sources.relations import SQL as BASE

c = F.col


def _frontier(spark: SparkSession, d: str) -> DataFrame:
    pages = relations.pages(spark, d, "crawl_depth", "crawled_at", "links")
    audits = relations.audits(spark, d)
    return frontier.build(frontier.seeds(audits), frontier.from_sitemap(sample_sitemap(spark, d)), frontier.expand(pages, audits))


def frontier_expand(spark: SparkSession, d: str) -> DataFrame:
    """Links that crawling adds, per audit and depth."""
    out = frontier.expand(relations.pages(spark, d, "crawl_depth", "crawled_at", "links"), relations.audits(spark, d))
    return out.groupBy("audit_id", "depth").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("url").alias("n_urls"))


def frontier_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Every canonical URL of an audit's frontier with the source and depth of its first discovery."""
    return _frontier(spark, d).select("audit_id", "key", "source", "depth")


def frontier_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _frontier(spark, d).groupBy("audit_id", "source").agg(F.count(F.lit(1)).alias("n"))


def frontier_batch(spark: SparkSession, d: str) -> DataFrame:
    """The next five URLs of every audit that no page of it answers for."""
    visited = relations.pages(spark, d, "url").select("audit_id", urls.canonical_url(c("url")).alias("key"))
    return frontier.batch(_frontier(spark, d), visited, 5)


def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    return robots.robots_rules(robots.sample_robots(spark, d))


def robots_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Whether robots rules allow each page."""
    p = relations.pages(spark, d, "url").withColumn("host", urls.host(c("url")))
    return verdict(p, robots_rules(spark, d)).select("id", "allowed")


def robots_filter(spark: SparkSession, d: str) -> DataFrame:
    """Frontier entries per audit that robots rules let pass."""
    f = _frontier(spark, d).withColumn("host", urls.host(c("key"))).select("audit_id", "host", c("key").alias("url"))
    return verdict(f, robots_rules(spark, d)).groupBy("audit_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~c("allowed")).alias("blocked"))


def sitemap_discover(spark: SparkSession, d: str) -> DataFrame:
    return robots.sitemap_locations(robots.sample_robots(spark, d))


def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """URLs read from one sitemap document per audit and crawl depth, reached through an index."""
    p = relations.pages(spark, d, "url", "crawl_depth").where("url is not null and crawl_depth is not null")
    name = F.concat("audit_id", F.lit("/"), c("crawl_depth").cast("string"))
    loc = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc></url>"))
    files = p.groupBy("audit_id", name.alias("source")).agg(F.array_join(F.collect_list(loc), "").alias("x"))
    bodies = files.select("source", F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), "x", F.lit("</urlset>")).alias("body"))
    index = files.groupBy(c("audit_id").alias("source")).agg(F.array_join(F.collect_list(F.concat(F.lit("<sitemap><loc>"), "source", F.lit("</loc></sitemap>"))), "").alias("x"))
    index = index.select("source", F.concat(F.lit("<sitemapindex>"), "x", F.lit("</sitemapindex>")).alias("body"))
    entries = index.select(c("source").alias("site"), "source")
    return sitemap.sitemap_urls(entries, bodies.unionByName(index))


def redirect_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains rebuilt from the single redirects of all pages of an audit."""
    hops = relations.pages(spark, d, "redirect_chain").select("audit_id", F.explode("redirect_chain").alias("h")).select("audit_id", "h.*").distinct()
    return redirects.redirect_chains(hops)


def parsed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Facts read back from documents written from the recorded facts."""
    p = relations.pages(spark, d, "title", "meta_description", "h1s", "h2s", "noindex", "is_html").where("is_html")
    esc = lambda x: F.replace(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    heads = lambda name, tag: F.array_join(F.transform(name, lambda h: F.concat(F.lit(f"<{tag}>"), esc(h), F.lit(f"</{tag}>"))), "")
    doc = F.concat(
        F.lit("<!doctype html><html><head>"), F.when(c("title").isNotNull(), F.concat(F.lit("<title>"), esc(c("title")), F.lit("</title>"))).otherwise(F.lit("")),
        F.when(c("meta_description").isNotNull(), F.concat(F.lit('<meta name="description" content="'), esc(c("meta_description")), F.lit('">'))).otherwise(F.lit("")),
        F.when(c("noindex"), F.lit('<meta name=robots content="NoIndex, follow">')).otherwise(F.lit("")), F.lit("</head><body><nav>menu</nav>"),
        F.coalesce(heads("h1s", "h1"), F.lit("")), F.coalesce(heads("h2s", "h2"), F.lit("")), F.lit("<p>one two</p>"),
    )
    out = html.parse_pages(p.select(F.concat(F.lit("https://x.example/"), "id").alias("url"), doc.alias("html")))
    return out.select(
        F.substring("url", 19, 99).alias("id"), F.coalesce(F.length("title"), F.lit(0)).alias("title_length"), F.coalesce(F.length("meta_description"), F.lit(0)).alias("description_length"),
        F.size("h1s").alias("n_h1"), F.size("h2s").alias("n_h2"), "noindex",
    )


def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return relations.pages(spark, d, "url").select("id", urls.canonical_url(c("url")).alias("canonical_url"))


def url_normal(spark: SparkSession, d: str) -> DataFrame:
    return relations.pages(spark, d, "url").select("id", urls.normalize_url(c("url")).alias("normal"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    p = relations.pages(spark, d, "url")
    return p.select("id", F.lower(urls.part(c("url"), 1)).alias("scheme"), urls.host(c("url")).alias("host"), urls.part(c("url"), 3).alias("path"), urls.part(c("url"), 4).alias("query"), urls.is_strict(c("url")).alias("strict"))


def url_resolved(spark: SparkSession, d: str) -> DataFrame:
    """A sibling reference resolved against every page."""
    return relations.pages(spark, d, "url").select("id", urls.resolve(c("url"), F.lit("./next?x=1#top")).alias("next"))


def directive_merge(spark: SparkSession, d: str) -> DataFrame:
    """Directives of the header united with those of the page."""
    p = relations.pages(spark, d, "headers", *directives.FLAGS, "max_snippet", "max_image_preview", "max_video_preview", "canonical")
    tag = directives.robots_tag(header("x-robots-tag"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("max_snippet", "int"), ("max_video_preview", "int"), ("max_image_preview", "string"), ("canonical", "string"))]
    a = F.struct(*[tag[f].alias(f) for f in directives.FLAGS], *nothing)
    b = F.struct(*directives.FLAGS, "max_snippet", "max_video_preview", "max_image_preview", "canonical")
    return p.select("id", directives.merge(a, b).alias("m")).select("id", "m.*")


def exact_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", fingerprint.exact_hash(c("text")).alias("exact_hash"))


def simhash(spark: SparkSession, d: str) -> DataFrame:
    """Similarity hashes of all documents with words."""
    return fingerprint.sim_hash_table(table(spark, d, "documents"), "doc_id", c("text"))


QUERIES = {f.__name__: f for f in (
    frontier_expand, frontier_dedupe, frontier_by_source, frontier_batch, robots_rules, robots_verdict, robots_filter, sitemap_discover, sitemap_urls, redirect_chains,
    parsed_pages, url_canonical, url_normal, url_parts, url_resolved, directive_merge, exact_hashes, simhash,
)}


def sql_canonical(url: str) -> str:
    """SQL for ``canonical_url`` of URLs with scheme and host."""
    n = sql_norm(f"regexp_extract({url}, '^[^?#]*')")
    bare = f"""regexp_replace(regexp_replace({n}, '^(http://[^/]*?):(80)?(/|$)', '\\1\\3'), '^(https://[^/]*?):(443)?(/|$)', '\\1\\3')"""
    query = f"regexp_extract({url}, '^[^?#]*\\?([^#]*)', 1)"
    kept = f"""list_reduce(list_prepend('', list_filter(string_split({query}, '&'), lambda v: v <> '' and not regexp_matches(lower(v),
        '^(utm_[^=]*|fbclid|gclid|gclsrc|dclid|msclkid|yclid|mc_cid|mc_eid|_ga|_gl|igshid|mkt_tok)(=|$)'))), lambda m, n: case when m = '' then n else m || '&' || n end)"""
    return f"""({bare} || case when regexp_matches({bare}, '^[a-z]+://[^/]*$') then '/' else '' end || case when {kept} = '' then '' else '?' || {sql_decode(kept)} end)"""


_FR = f""", sm as (select audit_id, url from p where crawl_depth % 2 = 0 union all select audit_id, context from si where code = 'sitemap_orphans' and context is not null),
    lk as (select p.audit_id, p.crawl_depth + 1 as depth, p.crawled_at as ts, p.id as pid, g.pos, p.links[g.pos] as l from p join a on a.id = p.audit_id, lateral (select unnest(range(1, len(p.links) + 1)) as pos) g
        where p.crawl_depth + 1 <= a.max_depth),
    ex as (select * from lk where l.internal and l.type = 'anchor' and l.rel = 'follow'),
    ev as (select id as audit_id, seed_url as url, 0 as depth, 'seed' as source, 0 as ph, timestamp '1970-01-01' as ts, '' as pid, 0 as pos from a
        union all select audit_id, url, 0, 'sitemap', 1, timestamp '1970-01-01', url, 0 from sm union all select audit_id, l.url, depth, 'link', 2, ts, pid, pos from ex),
    ek as (select *, {sql_canonical('url')} as key from ev),
    fr as (select * from ek qualify row_number() over (partition by audit_id, key order by ph, ts, pid, pos, depth, source, url) = 1)"""
_HOST = "lower(regexp_extract({}, '^[A-Za-z]+://([^/?#:]+)', 1))"
_BLOCK = "regexp_matches({0}, '^[A-Za-z]+://[^/?#]*/archive/') and not regexp_matches({0}, '^[A-Za-z]+://[^/?#]*/archive/[^#]*\\.html$')"
_HEAD = "coalesce(lower(list_filter(map_entries(headers), lambda e: lower(e.key) = 'x-robots-tag')[1].value[1]), '')"

SQL = {k: BASE + v for k, v in {
    "frontier_expand": _FR + " select audit_id, depth, count(*) as n_links, count(distinct l.url) as n_urls from ex group by all",
    "frontier_dedupe": _FR + " select audit_id, key, source, depth from fr",
    "frontier_by_source": _FR + " select audit_id, source, count(*) as n from fr group by all",
    "frontier_batch": _FR + f""", v as (select distinct audit_id, {sql_canonical('url')} as key from p) select audit_id, key, row_number() over (partition by audit_id order by ph, ts, pid, pos, key) as position
        from fr where (audit_id, key) not in (select audit_id, key from v) qualify position <= 5""",
    "robots_rules": f", h as (select distinct {_HOST.format('url')} as host from p where url is not null) select host, 'disallow' as kind, '/archive/' as pattern from h union all select host, 'allow', '/archive/*.html$' from h",
    "robots_verdict": f"select id, not ({_BLOCK.format('url')}) as allowed from p",
    "robots_filter": _FR + f", h as (select distinct {_HOST.format('url')} as host from p), o as (select audit_id, {_BLOCK.format('key')} and {_HOST.format('key')} in (select host from h) as b from fr) select audit_id, count(*) filter (not b) as allowed, count(*) filter (b) as blocked from o group by 1",
    "sitemap_discover": f", h as (select distinct {_HOST.format('url')} as host from p where url is not null) select host, 'https://' || host || case when length(host) % 2 = 0 then '/map.xml' else '/sitemap.xml' end as sitemap from h",
    "sitemap_urls": f"select distinct audit_id as site, {sql_canonical('url')} as url from p where url is not null and crawl_depth is not null",
    "redirect_chains": """, r as (select distinct audit_id, h.from_url as f, h.to_url as t, h.status_code as s from (select audit_id, unnest(redirect_chain) as h from p)),
        st as (select audit_id, f, min(struct_pack(t := t, s := s)) as x from r group by all)""",
    "url_canonical": f"select id, {sql_canonical('url')} as canonical_url from p",
    "url_normal": f"select id, {sql_norm('url')} as normal from p",
    "url_parts": f"select id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) as scheme, {_HOST.format('url')} as host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) as query, regexp_full_match(url, '[A-Za-z0-9._~:/?#\\[\\]@!$&''()*+,;=%-]*') and not regexp_matches(url, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') as strict from p",
    "url_resolved": f"""select id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || regexp_replace(regexp_replace(case when regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*/)', 1) = ''
        then '/' else regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*/)', 1) end, '/(\\./)+', '/', 'g'), '/[^/]+/\\.\\./', '/', 'g') || 'next?x=1#top' as next from p""",
    "directive_merge": "select id, " + ", ".join(f"contains({_HEAD}, '{f}') or coalesce({f}, false) as {f}" for f in directives.FLAGS) + ", max_snippet, max_video_preview, max_image_preview, canonical from p",
    "exact_hashes": "select doc_id, case when text <> '' then sha256(text) end as exact_hash from documents",
}.items()}
SQL["redirect_chains"] = SQL["redirect_chains"].replace("\nwith p as", "\nwith recursive p as") + """, w(audit_id, start, n_hops, final, statuses) as (
    select audit_id, f, 0, f, '' from st where (audit_id, f) not in (select audit_id, x.t from st)
    union all select w.audit_id, w.start, w.n_hops + 1, st.x.t, case when w.statuses = '' then '' else w.statuses || ' ' end || st.x.s from w join st on st.audit_id = w.audit_id and st.f = w.final where w.n_hops < 10)
    select * from w qualify row_number() over (partition by audit_id, start order by n_hops desc) = 1"""
SQL["parsed_pages"] = BASE + r"""select id, coalesce(length(nullif(regexp_replace(title, '^[\s\x{A0}\x{2000}-\x{200A}\x{3000}\x{85}\x1C-\x1F\x{202F}\x{205F}\x{2028}\x{2029}]+|[\s\x{A0}\x{2000}-\x{200A}\x{3000}\x{85}\x1C-\x1F\x{202F}\x{205F}\x{2028}\x{2029}]+$', '', 'g'), '0')), 0) as title_length,
    coalesce(length(nullif(regexp_replace(meta_description, '^[\s\x{A0}\x{2000}-\x{200A}\x{3000}\x{85}\x1C-\x1F\x{202F}\x{205F}\x{2028}\x{2029}]+|[\s\x{A0}\x{2000}-\x{200A}\x{3000}\x{85}\x1C-\x1F\x{202F}\x{205F}\x{2028}\x{2029}]+$', '', 'g'), '0')), 0) as description_length,
    cast(coalesce(len(h1s), 0) as int) as n_h1, cast(coalesce(len(h2s), 0) as int) as n_h2, coalesce(noindex, false) as noindex from p where is_html"""
