"""Streaming read models run to the end of the recorded pages, and export layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.plans.crawl_queries import sql_canonical
from sitelens.plans.rule_queries import SQL as RULES
from sitelens.sinks import tables
from sitelens.sources import relations
from sitelens.sources.relations import SQL as BASE
from sitelens.streaming import live


def csv_pages(spark: SparkSession, d: str) -> DataFrame:
    """Exported page list of all audits."""
    names = ("url", "status_code", "content_type", "body_size", "response_time", "crawl_depth", "title", "meta_description", "word_count", "error_count", "warning_count", "canonical", "canonical_status", "noindex")
    return tables.pages_csv(relations.pages(spark, d, *names))


def csv_external_links(spark: SparkSession, d: str) -> DataFrame:
    """Exported external links of all audits."""
    x = relations.external_checks(spark, d)
    p = relations.pages(spark, d, "url").select(F.col("id").alias("source_page_id"), F.col("url").alias("source_url"))
    return tables.externals_csv(x.join(p, "source_page_id", "left"))


QUERIES = {
    "stream_statistics": live.stream_statistics, "stream_page_issues": live.stream_page_issues, "stream_discovered": live.stream_discovered, "live_buffer": live.live_buffer,
    "csv_pages": csv_pages, "csv_external_links": csv_external_links,
}

SQL = {
    "stream_statistics": BASE + "select audit_id, count(*) as crawled, count(*) filter (status_code >= 500) as failed from p group by 1",
    "stream_page_issues": f"select code, n_issues, n_pages from ({RULES['rules_all']})",
    "stream_discovered": BASE + f", l as (select audit_id, unnest(links) as l from p) select distinct audit_id, {sql_canonical('l.url')} as key from l where l.internal and l.type = 'anchor'",
    "live_buffer": BASE + "select audit_id, id, url from p qualify row_number() over (partition by audit_id order by crawled_at desc nulls last, id) <= 500",
    "csv_pages": BASE + """select url as "URL", cast(status_code as varchar) as "Status", coalesce(content_type, '') as "Content type", cast(body_size as varchar) as "Size",
        format('{:,}', cast(round_even(response_time, 0) as bigint)) as "Time", cast(crawl_depth as varchar) as "Depth", coalesce(title, '') as "Title", cast(length(title) as varchar) as "Title length",
        coalesce(meta_description, '') as "Description", cast(word_count as varchar) as "Words", cast(error_count as varchar) as "Errors", cast(warning_count as varchar) as "Warnings",
        coalesce(canonical, '') as "Canonical", canonical_status as "Canonical status",
        case when status_code between 200 and 299 and not noindex and canonical_status <> 'other' then 'Yes' else 'No' end as "Indexable" from p""",
    "csv_external_links": BASE + """select x.url as "URL", coalesce(cast(x.status_code as varchar), 'Error') as "Status", format('{:,}', cast(round_even(x.response_time, 0) as bigint)) as "Time",
        coalesce(x.error, '') as "Error", coalesce(p.url, '') as "Source", coalesce(x.anchor_text, '') as "Anchor" from x left join p on p.id = x.source_page_id""",
}
