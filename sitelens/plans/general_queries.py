"""Queries of the general problems: hot keys and snapshot differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import skew
from sitelens.plans.site_history import page_changes
from sitelens.session import table

HOT_SHARE = 0.05


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Keys that hold at least 5% of all rows of their table, from (key, value) weights."""
    by_code = skew.compress(table(spark, d, "issues"), F.col("code"), F.col("severity"))
    by_audit = skew.compress(table(spark, d, "pages"), F.col("audit_id"), F.col("status_code"))
    return (
        skew.heavy_keys(by_code, HOT_SHARE).select(F.lit("issues.code").alias("key_field"), F.col("key").alias("key_value"))
        .unionByName(skew.heavy_keys(by_audit, HOT_SHARE).select(F.lit("pages.audit_id").alias("key_field"), F.col("key").alias("key_value")))
    )


def p1_code_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per rule code: rows, distinct pages, and the page with most rows, each issue once."""
    issues = table(spark, d, "issues").select("id", "code", "page_id").distinct()
    return skew.key_summary(skew.compress(issues, F.col("code"), F.col("page_id"))).select(
        F.col("key").alias("code"), "n_rows", F.col("n_distinct").alias("n_pages"),
        F.col("mode").alias("top_page"), F.col("mode_rows").alias("top_page_rows"),
    )


def p1_audit_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per audit: pages, distinct status codes, commonest status, exact percentiles of word_count, each page once."""
    pages = table(spark, d, "pages").select("id", "audit_id", "status_code", "word_count").distinct()
    status = skew.key_summary(skew.compress(pages, F.col("audit_id"), F.col("status_code")))
    words = skew.weighted_percentiles(skew.compress(pages, F.col("audit_id"), F.col("word_count")), [0.5, 0.9])
    words = words.groupBy("key").agg(
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median_words"), F.max(F.when(F.col("q") == 0.9, F.col("value"))).alias("p90_words")
    )
    return status.join(words, status["key"].eqNullSafe(words["key"]), "left").select(
        status["key"].alias("audit_id"), F.col("n_rows").alias("n_pages"), F.col("n_distinct").alias("n_statuses"),
        F.col("mode").alias("top_status"), "median_words", "p90_words",
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return page_changes(table(spark, d, "audits"), table(spark, d, "pages"), table(spark, d, "issues"))


QUERIES = {"p1_found": p1_found, "p1_code_profile": p1_code_profile, "p1_audit_profile": p1_audit_profile, "p2_found": p2_found}


SQL = {
    "p1_found": """
        select 'issues.code' as key_field, code as key_value from issues where code is not null group by code
        having count(*) >= 0.05 * (select count(*) from issues)
        union all
        select 'pages.audit_id', audit_id from pages where audit_id is not null group by audit_id
        having count(*) >= 0.05 * (select count(*) from pages)""",
    "p1_code_profile": """
        with i as (select distinct id, code, page_id from issues),
        v as (select code, page_id, count(*) as w from i group by all),
        r as (select *, row_number() over (partition by code order by w desc, page_id) as k from v where page_id is not null)
        select v.code, cast(sum(v.w) as bigint) as n_rows, count(v.page_id) as n_pages,
               max(r.page_id) as top_page, max(r.w) as top_page_rows
        from v left join r on r.code is not distinct from v.code and r.k = 1 group by v.code""",
    "p1_audit_profile": """
        with p as (select distinct id, audit_id, status_code, word_count from pages),
        s as (select audit_id, status_code, count(*) as w from p where status_code is not null group by all),
        t as (select audit_id, status_code from s qualify row_number() over (partition by audit_id order by w desc, status_code) = 1),
        g as (select audit_id, count(*) as n_pages, count(distinct status_code) as n_statuses,
              cast(quantile_disc(word_count, 0.5) as double) as x,
              list_sort(list(word_count) filter (word_count is not null)) as ws from p group by audit_id)
        select g.audit_id, g.n_pages, g.n_statuses, t.status_code as top_status,
          cast(ws[cast(floor(0.5 * (len(ws) - 1)) as bigint) + 1] as double) as median_words,
          cast(ws[cast(floor(0.9 * (len(ws) - 1)) as bigint) + 1] as double) as p90_words
        from g left join t on t.audit_id is not distinct from g.audit_id""",
    "p2_found": """
        with a as (select id, max(completed_at) as ts, arg_max(seed_url, completed_at) as seed from audits
                   where status = 'completed' and completed_at is not null group by id),
        h as (select id, ts, lower(regexp_extract(seed, '^[A-Za-z]+://([^/?#:]+)', 1)) as host from a),
        pr as (select l.id as pair, arg_max(e.id, e.ts) as earlier from h l join h e on e.host = l.host and e.ts < l.ts group by l.id),
        c as (select distinct id, audit_id, url, regexp_extract(url, '^([A-Za-z]+)://([^/?#]*)([^?#]*)(\\?([^#]*))?', ['s', 'a', 'p', 'w', 'q']) as x
              from pages where url is not null),
        dec as (select id, audit_id, lower(x.s) as s,
              regexp_replace(lower(x.a), case lower(x.s) when 'http' then ':(80)?$' else ':(443)?$' end, '') as a,
              list_reduce(list_prepend('', list_transform(string_split(x.p, '%'), lambda v, i: case when i = 1 then v
                 when regexp_matches(v, '^(2[dDeE]|3[0-9]|[46][1-9a-fA-F]|[57][0-9aA]|5[fF]|7[eE])')
                 then chr(cast(('0x' || v[1:2]) as int)) || v[3:] else '%' || v end)), lambda m, n: m || n) as p,
              list_reduce(list_prepend('', list_filter(string_split(x.q, '&'), lambda v:
                 not regexp_matches(lower(v), '^(utm_[^=]*|fbclid|gclid|gclsrc|dclid|msclkid|yclid|mc_cid|mc_eid|_ga|_gl|igshid|mkt_tok)(=|$)'))),
                 lambda m, n: case when m = '' then n else m || '&' || n end) as q from c),
        dots as (select *, list_reduce(list_prepend('', string_split(p[2:], '/')), lambda m, n:
                 case when n = '.' then m when n = '..' then regexp_replace(m, '/[^/]*$', '') else m || '/' || n end) as pp from dec),
        u as (select id, audit_id, s || '://' || a || case when p = '' then '/' when regexp_matches(p, '/\\.\\.?$') then pp || '/' else pp end
              || case when q = '' or q is null then '' else '?' || q end as cu from dots),
        ic as (select page_id, code from issues where code is not null group by all),
        rec as (select u.audit_id, u.cu, min(u.id) as label, list_sort(list(distinct ic.code) filter (ic.code is not null)) as codes
                from u left join ic on ic.page_id = u.id group by all),
        n as (select pr.pair, rec.* from pr join rec on rec.audit_id = pr.pair),
        o as (select pr.pair, rec.* from pr join rec on rec.audit_id = pr.earlier)
        select coalesce(n.pair, o.pair) as audit_id, coalesce(n.label, o.label) as page_id,
          case when o.label is null then 'added' when n.label is null then 'removed' else 'changed' end as change
        from n full join o on n.pair = o.pair and n.cu = o.cu
        where o.label is null or n.label is null or n.codes is distinct from o.codes""",
}
