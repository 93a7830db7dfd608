"""Issue reports, scores, overviews and progress, per audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.operators.page_rules import is_html
from sitelens.operators.skew import salted_join
from sitelens.functions.text import is_blank
from sitelens.sources import relations
from sitelens.sources.relations import SQL as BASE

c = F.col
#: Weighted issues at which a page's score reaches 0.
FULL = 30


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "error", 0).when(severity == "warning", 1).when(severity == "notice", 2).when(severity == "info", 3).otherwise(4)


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """Page issues with their audit and URL, and site issues without a page."""
    p = relations.pages(spark, d, "url").select(c("id").alias("page_id"), "audit_id", "url")
    bound = relations.issues(spark, d, "page_id", "category", "severity", "code", "context").join(p, "page_id")
    columns = ["audit_id", "page_id", "url", "category", "severity", "code", "context"]
    free = relations.site_issues(spark, d).withColumns({"page_id": F.lit(None).cast("string"), "url": F.lit(None).cast("string")})
    return bound.select(*columns).unionByName(free.select(*columns))


def issue_rows(spark: SparkSession, d: str) -> DataFrame:
    return report_rows(spark, d).where("page_id is not null").select("audit_id", "page_id", "url", "code", "severity")


def issue_enriched(spark: SparkSession, d: str) -> DataFrame:
    """Issues with weight of their rule; an unknown code weighs 0."""
    weights = relations.catalog(spark, d).select("code", "weight")
    i = relations.issues(spark, d, "page_id", "code").join(F.broadcast(weights), "code", "left")
    return i.select("id", "page_id", "code", F.coalesce("weight", F.lit(0)).alias("weight"))


def _affected() -> Column:
    """What an issue affects: its page, or for site issues the place named in its context."""
    return F.coalesce(c("page_id"), F.concat(F.lit("site:"), F.md5(F.coalesce("context", F.lit("")))))


def report_groups(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """(audit_id, code, category, severity, weight, n_issues, n_affected): the report grouped by rule."""
    g = rows.groupBy("audit_id", "code").agg(
        F.min("category").alias("category"), F.min("severity").alias("severity"), F.count(F.lit(1)).alias("n_issues"), F.countDistinct(_affected()).alias("n_affected")
    )
    return g.join(F.broadcast(catalog.select("code", "weight")), "code", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return report_groups(report_rows(spark, d), relations.catalog(spark, d))


def issue_report_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).select("audit_id", "code", "category", "severity", "weight", "n_issues", "n_affected")


def issue_report_ranked(spark: SparkSession, d: str) -> DataFrame:
    """Rules of an audit by impact: weight times affected pages, then severity, count and code."""
    w = Window.partitionBy("audit_id").orderBy((c("weight") * c("n_affected")).desc(), severity_rank(c("severity")), c("n_issues").desc(), "code")
    return _groups(spark, d).withColumn("position", F.row_number().over(w)).select("audit_id", "position", "code")


def issue_report_preview(spark: SparkSession, d: str) -> DataFrame:
    """Per audit and rule the first ten affected pages by URL, as joined text."""
    one = report_rows(spark, d).where("page_id is not null").groupBy("audit_id", "code", "page_id").agg(F.min("url").alias("url"))
    w = Window.partitionBy("audit_id", "code").orderBy("url", "page_id")
    top = one.withColumn("k", F.row_number().over(w)).where("k <= 10")
    return top.groupBy("audit_id", "code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "url"))), lambda x: x["url"]), " ").alias("preview"))


def report_totals(spark: SparkSession, d: str) -> DataFrame:
    """Issues per audit by severity, and the number of pages that have any."""
    r = report_rows(spark, d)
    return r.groupBy("audit_id").agg(*[F.count_if(c("severity") == s).alias(f"n_{s}") for s in ("error", "warning", "notice", "info")], F.countDistinct("page_id").alias("n_pages"))


def scores(pages: DataFrame, issues: DataFrame, catalog: DataFrame) -> DataFrame:
    """(audit_id, page_id, score): 100 minus the capped share of the issues' weights; clean pages have 100."""
    weighted = issues.join(F.broadcast(catalog.select("code", "weight")), "code", "left").groupBy("page_id").agg(F.sum(F.coalesce("weight", F.lit(0))).alias("w"))
    out = pages.select("audit_id", c("id").alias("page_id")).join(weighted, "page_id", "left")
    return out.select("audit_id", "page_id", (100 * (1 - F.least(F.coalesce("w", F.lit(0)), F.lit(FULL)) / FULL)).alias("score"))


def page_scores(spark: SparkSession, d: str) -> DataFrame:
    s = scores(relations.pages(spark, d), relations.issues(spark, d, "page_id", "code"), relations.catalog(spark, d))
    return s.select("audit_id", "page_id", F.round("score", 6).alias("score"))


def site_score(spark: SparkSession, d: str) -> DataFrame:
    """Rounded mean over all pages of an audit, clean ones included; audits without pages have 100."""
    s = scores(relations.pages(spark, d), relations.issues(spark, d, "page_id", "code"), relations.catalog(spark, d)).groupBy("audit_id").agg(F.avg("score").alias("m"))
    a = relations.audits(spark, d).select(c("id").alias("audit_id"))
    return a.join(s, "audit_id", "left").select("audit_id", F.coalesce(F.round("m"), F.lit(100.0)).cast("int").alias("score"))


def overview(pages: DataFrame) -> DataFrame:
    """One pass over the pages of each audit: totals, means, status classes, latency buckets, missing texts."""
    t, sc, html = c("response_time"), c("status_code"), is_html()
    return pages.groupBy("audit_id").agg(
        F.count(F.lit(1)).alias("total"), F.round(F.avg(t)).cast("int").alias("avg_ms"), F.sum("word_count").alias("words"), F.sum("image_count").alias("images"),
        *[F.count_if(sc.between(k * 100, k * 100 + 99)).alias(f"n_{k}xx") for k in (2, 3, 4, 5)],
        F.count_if(t < 200).alias("under_200"), F.count_if((t >= 200) & (t < 500)).alias("under_500"), F.count_if((t >= 500) & (t < 1000)).alias("under_1000"),
        F.count_if((t >= 1000) & (t < 3000)).alias("under_3000"), F.count_if(t >= 3000).alias("slow"),
        F.count_if(html & is_blank(c("title"))).alias("no_title"), F.count_if(html & is_blank(c("meta_description"))).alias("no_description"),
        F.count_if(html & (F.coalesce(F.size("h1s"), F.lit(0)) <= 0)).alias("no_h1"), F.count_if(html).alias("n_html"),
    )


def audit_overview(spark: SparkSession, d: str) -> DataFrame:
    return overview(relations.pages(spark, d, "response_time", "status_code", "content_type", "word_count", "image_count", "title", "meta_description", "h1s"))


def seo_checks(spark: SparkSession, d: str) -> DataFrame:
    """Share of bad pages for five checks, in whole percent."""
    o = audit_overview(spark, d)
    pct = lambda bad, of: F.coalesce(F.round(100.0 * bad / F.nullif(of, F.lit(0))), F.lit(0.0)).cast("int")
    return o.select(
        "audit_id", pct(c("no_title"), c("n_html")).alias("title"), pct(c("no_description"), c("n_html")).alias("description"), pct(c("no_h1"), c("n_html")).alias("h1"),
        pct(c("n_4xx") + c("n_5xx"), c("total")).alias("errors"), pct(c("slow"), c("total")).alias("slow"),
    )


def depth_distribution(spark: SparkSession, d: str) -> DataFrame:
    return relations.pages(spark, d, "crawl_depth").groupBy("audit_id", "crawl_depth").agg(F.count(F.lit(1)).alias("n"))


def issue_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Page issues by category, by severity and in all, as grouping sets in one pass."""
    return relations.issues(spark, d, "category", "severity").groupingSets([["category"], ["severity"], []], "category", "severity").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n")
    )


def issue_counts(spark: SparkSession, d: str) -> DataFrame:
    """Errors and warnings of every page, 0 for clean ones."""
    n = relations.issues(spark, d, "page_id", "severity").groupBy("page_id").agg(F.count_if(c("severity") == "error").alias("errors"), F.count_if(c("severity") == "warning").alias("warnings"))
    p = relations.pages(spark, d).select("audit_id", c("id").alias("page_id"))
    return p.join(n, "page_id", "left").fillna(0, ["errors", "warnings"])


def pages_with_issues(spark: SparkSession, d: str) -> DataFrame:
    """Every page with its issue codes in order, as joined text; pages without issues have an empty text."""
    i = relations.issues(spark, d, "page_id", "code").groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list("code")), ",").alias("codes"))
    p = relations.pages(spark, d).select("audit_id", c("id").alias("page_id"))
    return p.join(i, "page_id", "left").fillna("", ["codes"])


def audit_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counters of an audit recomputed from its rows; only errors and warnings count as issues found."""
    n = relations.issues(spark, d, "page_id", "severity").groupBy("page_id").agg(F.count_if(c("severity") == "error").alias("e"), F.count_if(c("severity") == "warning").alias("w"))
    p = relations.pages(spark, d, "status_code").select(c("id").alias("page_id"), "audit_id", "status_code").join(n, "page_id", "left")
    zero = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return p.groupBy("audit_id").agg(
        F.count(F.lit(1)).alias("crawled"), F.count_if(c("status_code") >= 500).alias("failed"), zero("e").alias("errors"), zero("w").alias("warnings"), (zero("e") + zero("w")).alias("issues")
    )


def audit_duration(spark: SparkSession, d: str) -> DataFrame:
    """Whole seconds from start to completion; null if either is missing."""
    a = relations.audits(spark, d)
    return a.select("id", (F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")).alias("seconds"))


def progress(spark: SparkSession, d: str) -> DataFrame:
    """Percent crawled (one decimal, at most 100) and pages per second of every audit."""
    a = relations.audits(spark, d)
    total = F.greatest(F.when(c("status") == "running", c("pages_discovered")).otherwise(c("pages_crawled")), F.lit(1))
    s = F.unix_timestamp("completed_at") - F.unix_timestamp("started_at")
    return a.select("id", F.round(F.least(100.0 * c("pages_crawled") / total, F.lit(100.0)), 1).alias("pct"), F.when(s > 0, F.round(c("pages_crawled") / s, 1)).alias("rate"))


def audit_status(spark: SparkSession, d: str) -> DataFrame:
    a = relations.audits(spark, d)
    return a.select("id", "status", "pages_discovered", "pages_crawled", "pages_failed", F.greatest(F.lit(0), c("pages_discovered") - c("pages_crawled") - c("pages_failed")).alias("pending"))


def audit_history(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred audits."""
    return relations.audits(spark, d).orderBy(c("created_at").desc(), "id").limit(100).select("id", "seed_url", "status", "created_at")


QUERIES = {f.__name__: f for f in (
    report_rows, issue_rows, issue_enriched, issue_report_groups, issue_report_ranked, issue_report_preview, report_totals, page_scores, site_score, audit_overview,
    seo_checks, depth_distribution, issue_breakdown, issue_counts, pages_with_issues, audit_statistics, audit_duration, progress, audit_status, audit_history,
)}

_RR = """, rr as (select p.audit_id, i.page_id, p.url, i.category, i.severity, i.code, i.context from i join p on p.id = i.page_id
    union all select audit_id, null, null, category, severity, code, context from si)"""
_GR = _RR + """, g as (select audit_id, rr.code, min(rr.category) as category, min(rr.severity) as severity, max(coalesce(r.weight, 0)) as weight, count(*) as n_issues,
    count(distinct coalesce(page_id, 'site:' || md5(coalesce(context, '')))) as n_affected from rr left join rule_catalog r on r.code = rr.code group by audit_id, rr.code)"""
_SC = """, w as (select i.page_id, sum(coalesce(r.weight, 0)) as w from i left join rule_catalog r on r.code = i.code group by 1),
    s as (select p.audit_id, p.id as page_id, 100 * (1 - least(coalesce(w.w, 0), 30) / 30) as score from p left join w on w.page_id = p.id)"""
_HTML = "coalesce(contains(lower(content_type), 'text/html'), false)"
_B = "not coalesce(regexp_matches({}, '[^ \\t\\n\\r\\x0B\\x00]'), false)"
_OV = f""", o as (select audit_id, count(*) as total, cast(round(avg(response_time)) as int) as avg_ms, cast(sum(word_count) as bigint) as words, cast(sum(image_count) as bigint) as images,
    {", ".join(f"count(*) filter (status_code between {k}00 and {k}99) as n_{k}xx" for k in (2, 3, 4, 5))},
    count(*) filter (response_time < 200) as under_200, count(*) filter (response_time >= 200 and response_time < 500) as under_500,
    count(*) filter (response_time >= 500 and response_time < 1000) as under_1000, count(*) filter (response_time >= 1000 and response_time < 3000) as under_3000,
    count(*) filter (response_time >= 3000) as slow, count(*) filter ({_HTML} and {_B.format('title')}) as no_title,
    count(*) filter ({_HTML} and {_B.format('meta_description')}) as no_description, count(*) filter ({_HTML} and coalesce(len(h1s), 0) = 0) as no_h1, count(*) filter ({_HTML}) as n_html from p group by 1)"""
_PCT = "cast(coalesce(round(100.0 * ({}) / nullif({}, 0)), 0) as int)"
_N = ", n as (select page_id, count(*) filter (severity = 'error') as e, count(*) filter (severity = 'warning') as w from i group by 1)"
_SEC = "cast(floor(epoch(completed_at)) - floor(epoch(started_at)) as bigint)"

SQL = {k: BASE + v for k, v in {
    "report_rows": _RR + " select * from rr",
    "issue_rows": _RR + " select audit_id, page_id, url, code, severity from rr where page_id is not null",
    "issue_enriched": "select i.id, i.page_id, i.code, coalesce(r.weight, 0) as weight from i left join rule_catalog r on r.code = i.code",
    "issue_report_groups": _GR + " select * from g",
    "issue_report_ranked": _GR + """ select audit_id, row_number() over (partition by audit_id order by weight * n_affected desc,
        case severity when 'error' then 0 when 'warning' then 1 when 'notice' then 2 when 'info' then 3 else 4 end, n_issues desc, code) as position, code from g""",
    "issue_report_preview": _RR + """, u as (select audit_id, code, page_id, min(url) as url from rr where page_id is not null group by all),
        k as (select *, row_number() over (partition by audit_id, code order by url, page_id) as k from u) select audit_id, code, string_agg(url, ' ' order by k) as preview from k where k <= 10 group by all""",
    "report_totals": _RR + " select audit_id, " + ", ".join(f"count(*) filter (severity = '{s}') as n_{s}" for s in ("error", "warning", "notice", "info")) + ", count(distinct page_id) as n_pages from rr group by 1",
    "page_scores": _SC + " select audit_id, page_id, round(score, 6) as score from s",
    "site_score": _SC + ", m as (select audit_id, avg(score) as m from s group by 1) select a.id as audit_id, cast(coalesce(round(m.m), 100) as int) as score from a left join m on m.audit_id = a.id",
    "audit_overview": _OV + " select * from o",
    "seo_checks": _OV + f" select audit_id, {_PCT.format('no_title', 'n_html')} as title, {_PCT.format('no_description', 'n_html')} as description, {_PCT.format('no_h1', 'n_html')} as h1, {_PCT.format('n_4xx + n_5xx', 'total')} as errors, {_PCT.format('slow', 'total')} as slow from o",
    "depth_distribution": "select audit_id, crawl_depth, count(*) as n from p group by all",
    "issue_breakdown": "select category, severity, grouping_id(category, severity) as level, count(*) as n from i group by grouping sets ((category), (severity), ())",
    "issue_counts": _N + " select p.audit_id, p.id as page_id, coalesce(n.e, 0) as errors, coalesce(n.w, 0) as warnings from p left join n on n.page_id = p.id",
    "pages_with_issues": ", n as (select page_id, string_agg(code, ',' order by code) as codes from i group by 1) select p.audit_id, p.id as page_id, coalesce(n.codes, '') as codes from p left join n on n.page_id = p.id",
    "audit_statistics": _N + """ select p.audit_id, count(*) as crawled, count(*) filter (status_code >= 500) as failed, cast(coalesce(sum(n.e), 0) as bigint) as errors,
        cast(coalesce(sum(n.w), 0) as bigint) as warnings, cast(coalesce(sum(n.e), 0) + coalesce(sum(n.w), 0) as bigint) as issues from p left join n on n.page_id = p.id group by 1""",
    "audit_duration": f"select id, {_SEC} as seconds from a",
    "progress": f"""select id, round(least(100.0 * pages_crawled / greatest(case when status = 'running' then pages_discovered else pages_crawled end, 1), 100.0)::double, 1) as pct,
        case when {_SEC} > 0 then round((pages_crawled / {_SEC})::double, 1) end as rate from a""",
    "audit_status": "select id, status, pages_discovered, pages_crawled, pages_failed, greatest(0, pages_discovered - pages_crawled - pages_failed) as pending from a",
    "audit_history": "select id, seed_url, status, created_at from a order by created_at desc, id limit 100",
}.items()}
