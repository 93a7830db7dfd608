"""One query per rule, and all rules together, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import site_rules
from sitelens.operators.page_rules import FACTS, LANGUAGE_CODES, judged, page_issues, page_rules
from sitelens.session import table
from sitelens.sources import relations


def sql_decode(text: str) -> str:
    """SQL for ``decode_unreserved``."""
    return f"""list_reduce(list_prepend('', list_transform(string_split({text}, '%'), lambda v, i: case when i = 1 then v
        when regexp_matches(v, '^(2[dDeE]|3[0-9]|[46][1-9a-fA-F]|[57][0-9aA]|5[fF]|7[eE])')
        then chr(cast(('0x' || v[1:2]) as int)) || v[3:] else '%' || v end)), lambda m, n: m || n)"""


def sql_norm(url: str) -> str:
    """SQL for ``normalize_url``."""
    head = f"lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)?'))"
    path = sql_decode(f"regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)")
    dots = f"""case when not regexp_matches({path}, '(^|/)\\.\\.?(/|$)') then {path} else
        list_reduce(list_prepend('', string_split(({path})[2:], '/')), lambda m, n: case when n = '.' then m
        when n = '..' then regexp_replace(m, '/[^/]*$', '') else m || '/' || n end)
        || case when regexp_matches({path}, '/\\.\\.?$') then '/' else '' end end"""
    return f"""({head} || {dots} || {sql_decode(f"regexp_extract({url}, '^[^?#]*(\\?[^#]*)', 1)")})"""


def _blank(x: str) -> str:
    return f"not coalesce(regexp_matches({x}, '[^ \\t\\n\\r\\x0B\\x00]'), false)"


def _header(name: str) -> str:
    return f"list_filter(map_entries(headers), lambda e: lower(e.key) = '{name}')[1].value[1]"


_H = "coalesce(contains(lower(content_type), 'text/html'), false)"
_OK = "status_code between 200 and 299"
_EFF = "coalesce(final_url, url)"
_LANG = "'" + "', '".join(LANGUAGE_CODES) + "'"
_SCHEME = "lower(regexp_extract({}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
_FROMS = "list_transform(redirect_chain, lambda h: h.from_url)"
_LEVELS = "list_transform(heading_hierarchy, lambda h: h.level)"
_IMAGES = "list_filter(links, lambda x: x.type = 'image')"
_HCODE = "list_transform(hreflangs, lambda h: h.language || coalesce('-' || h.region, ''))"

#: Number of issues of a rule on a page, as SQL over the page row.
COUNTS = {
    "client_error": "status_code between 400 and 499",
    "server_error": "status_code between 500 and 599",
    "redirect_chain": "len(redirect_chain) >= 2",
    "redirect_loop": f"len(redirect_chain) > 0 and (len(list_distinct({_FROMS})) < len({_FROMS}) or list_contains({_FROMS}, redirect_chain[-1].to_url))",
    "mixed_protocol_redirect": f"len(list_filter(redirect_chain, lambda h: {_SCHEME.format('h.from_url')} <> {_SCHEME.format('h.to_url')})) > 0",
    "redirect_not_permanent": "len(redirect_chain) > 0 and len(list_filter(redirect_chain, lambda h: h.status_code not in (301, 308))) > 0",
    "internal_nofollow": f"{_H} and len(list_filter(links, lambda x: x.internal and x.type = 'anchor' and x.rel = 'nofollow')) > 0",
    "title_missing": f"{_H} and {_blank('title')}",
    "title_too_long": f"{_H} and not {_blank('title')} and length(title) > 60",
    "title_too_short": f"{_H} and not {_blank('title')} and length(title) < 30",
    "meta_description_missing": f"{_H} and {_blank('meta_description')}",
    "meta_description_too_long": f"{_H} and not {_blank('meta_description')} and length(meta_description) > 160",
    "h1_missing": f"{_H} and coalesce(len(h1s), 0) = 0",
    "h1_multiple": f"{_H} and len(h1s) > 1",
    "viewport_missing": f"{_H} and {_blank('viewport')}",
    "html_lang_missing": f"{_H} and {_blank('lang')}",
    "noindex": "noindex",
    "nofollow": "nofollow",
    "canonical_missing": f"{_H} and {_OK} and canonical is null",
    "canonical_non_self": f"{_H} and {_OK} and {sql_norm('canonical')} <> {sql_norm('url')}",
    "noindex_with_canonical": "noindex and canonical is not null",
    "h2_missing": f"{_H} and coalesce(len(h2s), 0) = 0",
    "h1_not_first": f"{_H} and len(heading_hierarchy) > 0 and heading_hierarchy[1].level <> 1",
    "heading_skip": f"{_H} and len(list_filter(range(2, len(heading_hierarchy) + 1), lambda k: ({_LEVELS})[k] > ({_LEVELS})[k - 1] + 1)) > 0",
    "content_empty": f"{_H} and {_OK} and word_count <= 50",
    "content_thin": f"{_H} and {_OK} and word_count between 51 and 79",
    "img_alt_missing": f"{_H} and len(list_filter({_IMAGES}, lambda x: {_blank('x.anchor')})) > 0",
    "img_alt_too_long": f"case when {_H} then len(list_filter({_IMAGES}, lambda x: length(x.anchor) > 125)) end",
    "image_missing_dimensions": f"{_H} and len(list_filter({_IMAGES}, lambda x: x.width is null or x.height is null)) > 0",
    "response_very_slow": "response_time >= 3000",
    "response_slow": "response_time >= 1000 and response_time < 3000",
    "page_too_large": f"{_H} and body_size > 524288",
    "csp_missing": f"{_H} and {_OK} and {_blank(_header('content-security-policy'))}",
    "x_frame_missing": f"{_H} and {_OK} and {_blank(_header('x-frame-options'))}",
    "x_content_type_missing": f"{_H} and {_OK} and {_blank(_header('x-content-type-options'))}",
    "referrer_policy_missing": f"{_H} and {_OK} and {_blank(_header('referrer-policy'))}",
    "referrer_policy_insecure": f"{_H} and {_OK} and not {_blank(_header('referrer-policy'))} and lower(trim({_header('referrer-policy')})) not in ('no-referrer', 'no-referrer-when-downgrade', 'strict-origin', 'strict-origin-when-cross-origin')",
    "http_insecure": f"{_SCHEME.format(_EFF)} = 'http'",
    "mixed_content": f"{_H} and {_SCHEME.format(_EFF)} = 'https' and len(list_filter(links, lambda x: x.type in ('script', 'stylesheet', 'iframe', 'image', 'video', 'audio', 'font') and {_SCHEME.format('x.url')} = 'http')) > 0",
    "open_graph_incomplete": f"{_H} and {_OK} and ({_blank('og_title')} or {_blank('og_description')} or {_blank('og_image')})",
    "twitter_card_incomplete": f"{_H} and {_OK}",
    "schema_org_missing": f"{_H} and {_OK}",
    "hreflang_invalid_language": f"case when {_H} then len(list_filter(hreflangs, lambda h: lower(h.language) <> 'x-default' and lower(h.language) not in ({_LANG}))) end",
    "hreflang_invalid_region": f"case when {_H} then len(list_filter(hreflangs, lambda h: h.region is not null and not regexp_matches(h.region, '^[A-Za-z]{{2}}$'))) end",
    "hreflang_missing_self": f"{_H} and len(hreflangs) > 0 and len(list_filter(hreflangs, lambda h: {sql_norm('h.href')} = {sql_norm('url')})) = 0",
    "hreflang_duplicate": f"{_H} and len(list_distinct({_HCODE})) < len({_HCODE})",
}


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("id", "audit_id", *FACTS)


def _rule(code: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = page_issues(_facts(spark, d), [code], repeated=True)
        return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_issues"))

    run.__doc__ = f"Issues of rule {code} by page."
    return run


def rules_all(spark: SparkSession, d: str) -> DataFrame:
    """Issues of all page rules in one pass: (code, category, severity, weight, n_issues, n_pages)."""
    pages = judged(_facts(spark, d)).select("page_id", F.transform("issues", lambda x: x["code"]).alias("codes")).where(F.size("codes") > 0)
    pages = pages.dropDuplicates(["page_id"])
    per_page = pages.select("codes", F.explode(F.array_distinct("codes")).alias("code"))
    per_page = per_page.select("code", F.size(F.filter("codes", lambda x: x == F.col("code"))).alias("n"))
    found = per_page.groupBy("code").agg(F.sum("n").alias("n_issues"), F.count(F.lit(1)).alias("n_pages"))
    return relations.catalog(spark, d).join(found, "code").select("code", "category", "severity", "weight", "n_issues", "n_pages")


def _site_sql() -> dict[str, str]:
    n, h = sql_norm, "coalesce(contains(lower(content_type), 'text/html'), false) and status_code between 200 and 299"
    norm = f""", n as (select *, {n('url')} as nu, {n('final_url')} as nf, {n('canonical')} as nc from p),
        k as (select audit_id, key, arg_min(id, (crawled_at, id)) as page_id from (select audit_id, nu as key, crawled_at, id from n
              union all select audit_id, nf, crawled_at, id from n where nf is not null) group by all)"""
    idx = "status_code between 200 and 299 and not coalesce(noindex, false) and not coalesce(nc <> nu, false)"
    sm = """, sm as (select audit_id, url from p where crawl_depth % 2 = 0 union all
        select audit_id, context from si where code = 'sitemap_orphans' and context is not null)"""
    key = "regexp_replace(regexp_replace({}, '#.*$', ''), '/+$', '')"
    return {
        "hreflang_no_return": relations.SQL + norm + f""", e as (select audit_id, id, nu, nf, h.language as l, {n('h.href')} as key from (select *, unnest(hreflangs) as h from n)
            where lower(h.language) <> 'x-default'), b as (select distinct audit_id, id, key from e)
            select e.audit_id, e.id as page_id, count(*) as n_missing from e join k on k.audit_id = e.audit_id and k.key = e.key
            where not exists (select 1 from b where b.audit_id = e.audit_id and b.id = k.page_id and (b.key = e.nu or b.key = e.nf)) group by all""",
        "canonical_broken_target": relations.SQL + norm + """ select * from (select s.audit_id, s.id as page_id,
            case when t.status_code between 400 and 599 then 'status' when len(t.redirect_chain) > 0 then 'redirects' when t.noindex then 'noindex' end as reason
            from n s join k on k.audit_id = s.audit_id and k.key = s.nc join n t on t.id = k.page_id where s.nc <> s.nu) where reason is not null""",
        "sitemap_missing": relations.SQL + norm + sm + f""" select audit_id, id as page_id from n where {idx} and audit_id in (select audit_id from sm)
            and (audit_id, {key.format('url')}) not in (select audit_id, {key.format('url')} from sm)
            and (final_url is null or (audit_id, {key.format('final_url')}) not in (select audit_id, {key.format('url')} from sm))""",
        "sitemap_orphans": relations.SQL + sm + f""", o as (select audit_id, {key.format('url')} as key, max(url) as url from sm group by 1, 2),
            cr as (select audit_id, {key.format('url')} as key from p union select audit_id, {key.format('final_url')} from p where final_url is not null)
            select o.audit_id, o.url from o left join cr using (audit_id, key) where cr.key is null""",
        "exact_duplicate": relations.SQL + f""", s as (select audit_id, exact_hash, count(distinct url) as n from p where exact_hash is not null group by all)
            select p.audit_id, p.id as page_id, s.n - 1 as n_copies from p join s using (audit_id, exact_hash) where s.n > 1 and {h}""",
        "near_duplicate": relations.SQL + f""", f as (select * from p where exact_hash is not null and sim_hash is not null)
            select f.audit_id, f.id as page_id, count(*) as n_near from f join f g on g.audit_id = f.audit_id and g.id <> f.id and g.exact_hash <> f.exact_hash
            and bit_count(xor(f.sim_hash, g.sim_hash)) <= 3 where coalesce(contains(lower(f.content_type), 'text/html'), false) and f.status_code between 200 and 299 group by all""",
        "robots_blocks_indexable": relations.SQL + norm + f""" select audit_id, id as page_id from n where {idx}
            and regexp_matches(url, '^[A-Za-z]+://[^/?#]*/archive/') and not regexp_matches(url, '^[A-Za-z]+://[^/?#]*/archive/[^#]*\\.html$')""",
    }


QUERIES = {f"rule_{code}": _rule(code) for code in COUNTS} | {"rules_all": rules_all} | {f"rule_{k}": v for k, v in site_rules.QUERIES.items()}

_EACH = {k: f"select id as page_id, cast({v} as bigint) as n_issues from p where cast({v} as bigint) > 0" for k, v in COUNTS.items()}
SQL = {f"rule_{k}": relations.SQL + v for k, v in _EACH.items()}
SQL["rules_all"] = relations.SQL + ", f as (" + " union all ".join(f"select '{k}' as code, page_id, n_issues from ({v})" for k, v in _EACH.items()) + """)
    select c.code, c.category, c.severity, c.weight, cast(sum(f.n_issues) as bigint) as n_issues, count(*) as n_pages
    from f join rule_catalog c on c.code = f.code group by all"""
SQL |= {f"rule_{k}": v for k, v in _site_sql().items()}
