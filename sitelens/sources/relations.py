"""The recorded tables with repeated deliveries taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import table


def _complex(df: DataFrame) -> bool:
    return any(t.startswith(("map", "array", "struct")) for _, t in df.dtypes)


def pages(spark: SparkSession, d: str, *columns: str, where: Column | None = None) -> DataFrame:
    """Pages once per id, reduced to id, audit_id and the named columns (pruned at the scan).

    Repeated rows are equal, so ``where`` is applied before they are dropped and reaches
    the scan.  Scalar columns are deduplicated by hash, nested ones by id.
    """
    t = table(spark, d, "pages")
    t = t if where is None else t.where(where)
    t = t.select("id", "audit_id", *[c for c in columns if c not in ("id", "audit_id")])
    return t.dropDuplicates(["id"]) if _complex(t) else t.distinct()


def issues(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Issues once per id, reduced to id and the named columns; all columns if none is named."""
    t = table(spark, d, "issues")
    return t.select("id", *columns).distinct() if columns else t.distinct()


def site_issues(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "site_issues").distinct()


def audits(spark: SparkSession, d: str) -> DataFrame:
    """Audits once per id, as they stood last."""
    t = table(spark, d, "audits")
    last = t.groupBy("id").agg(F.max(F.struct(F.col("completed_at"), F.col("pages_crawled"), F.struct(*[c for c in t.columns if c not in ("id", "completed_at", "pages_crawled")]).alias("rest"))).alias("r"))
    return last.select("id", "r.completed_at", "r.pages_crawled", "r.rest.*")


def external_checks(spark: SparkSession, d: str) -> DataFrame:
    """External link checks once per audit, URL and source page."""
    return table(spark, d, "external_url_checks").dropDuplicates(["audit_id", "url", "source_page_id"])


def catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rule_catalog")


#: The same relations for SQL over the raw tables.
SQL = """
with p as (select * from pages qualify row_number() over (partition by id order by crawled_at) = 1),
i as (select * from issues qualify row_number() over (partition by id order by code) = 1),
si as (select * from site_issues qualify row_number() over (partition by id order by code) = 1),
a as (select * from audits qualify row_number() over (partition by id order by completed_at desc nulls last, pages_crawled desc) = 1),
x as (select * from external_url_checks qualify row_number() over (partition by audit_id, url, source_page_id order by checked_at) = 1)
"""
