"""What the sinks write, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.plans.report_queries import SQL as REPORTS
from sitelens.plans.report_queries import audit_overview
from sitelens.session import scratch_path, table
from sitelens.sinks import tables
from sitelens.sources import relations
from sitelens.sources.relations import SQL as BASE

c = F.col
_STORED = "overview string, generated_at timestamp, audit_id string"


def sink_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Overviews of completed audits as stored and served instead of being worked out again."""
    path, fresh = scratch_path(spark, "audit-snapshots"), audit_overview(spark, d)
    tables.snapshot(fresh, relations.audits(spark, d), path)
    stored = spark.read.schema(_STORED).parquet(path)
    return stored.select("audit_id", F.from_json("overview", fresh.drop("audit_id").schema).alias("o")).select("audit_id", "o.*")


def sink_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in each table once failed and cancelled audits are deleted with all that belongs to them."""
    audits = relations.audits(spark, d)
    rows = {
        "audits": audits, "pages": relations.pages(spark, d), "issues": relations.issues(spark, d, "page_id"),
        "site_issues": relations.site_issues(spark, d), "external_url_checks": relations.external_checks(spark, d),
    }
    left = tables.without_audits(rows, audits.where(c("status").isin("failed", "cancelled")))
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in left.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def sink_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of every page after its errors were appended, and then its other issues."""
    pages = relations.pages(spark, d).withColumns({"error_count": F.lit(0), "warning_count": F.lit(0)})
    issues = relations.issues(spark, d, "page_id", "severity")
    for part in (c("severity") == "error", c("severity") != "error"):
        pages = tables.append_issues(pages, issues.where(part))
    return pages.select("id", "error_count", "warning_count")


def new_page_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of pages below the second level, seen from a listing of the levels above."""
    pages = table(spark, d, "pages")
    return tables.new_ids(pages, pages.where("crawl_depth <= 1"))


QUERIES = {f.__name__: f for f in (sink_snapshots, sink_deleted, sink_counters, new_page_ids)}

_GONE = "(select id from a where status in ('failed', 'cancelled'))"
SQL = {
    "sink_snapshots": f"select o.* from ({REPORTS['audit_overview']}) o where audit_id in (select id from audits where status = 'completed')",
    "sink_deleted": BASE + f"""select 'audits' as relation, count(*) as n from a where id not in {_GONE}
        union all select 'pages', count(*) from p where audit_id not in {_GONE}
        union all select 'site_issues', count(*) from si where audit_id not in {_GONE}
        union all select 'external_url_checks', count(*) from x where audit_id not in {_GONE}
        union all select 'issues', count(*) from i where page_id not in (select id from p where audit_id in {_GONE})""",
    "sink_counters": BASE + """, n as (select page_id, count(*) filter (severity = 'error') as e, count(*) filter (severity = 'warning') as w from i group by 1)
        select p.id, cast(coalesce(e, 0) as int) as error_count, cast(coalesce(w, 0) as int) as warning_count from p left join n on n.page_id = p.id""",
    "new_page_ids": "select distinct id from pages where id not in (select id from pages where crawl_depth <= 1)",
}
