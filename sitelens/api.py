"""The audits of a data directory as an object: one method per question, DataFrames as answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators.matching import compare
from sitelens.operators.page_rules import FACTS, page_issues
from sitelens.plans import diff_queries, page_queries, report_queries
from sitelens.sources import relations

c = F.col


class UnknownAudit(ValueError):
    pass


class Audits:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _known(self, audit_id: str) -> None:
        if relations.audits(self.spark, self.path).where(c("id") == audit_id).isEmpty():
            raise UnknownAudit(audit_id)

    def _pages(self, audit_id: str, *columns: str) -> DataFrame:
        self._known(audit_id)
        return relations.pages(self.spark, self.path, *columns, where=c("audit_id") == audit_id)

    def history(self, limit: int = 100) -> DataFrame:
        return relations.audits(self.spark, self.path).orderBy(c("created_at").desc(), "id").limit(limit)

    def status(self, audit_id: str) -> DataFrame:
        self._known(audit_id)
        return report_queries.audit_status(self.spark, self.path).where(c("id") == audit_id)

    def pages(self, audit_id: str, tab: str = "all", search: str | None = None, since=None, sort: str = "crawledAt", direction: str = "asc", limit: int | None = None, offset: int = 0) -> DataFrame:
        rows = page_queries.page_list(self._pages(audit_id, *page_queries.SUMMARY, "h1s"), tab, search, since)
        return page_queries.sorted_pages(rows, sort, direction, limit, offset)

    def page(self, page_id: str) -> DataFrame:
        return page_queries.page_detail(self.spark, self.path).where(c("id") == page_id)

    def issues(self, audit_id: str, compat: str = "intended") -> DataFrame:
        """Issues evaluated afresh from the page facts."""
        return page_issues(self._pages(audit_id, *FACTS), compat=compat)

    def report(self, audit_id: str) -> DataFrame:
        self._known(audit_id)
        return report_queries.report_groups(
            report_queries.report_rows(self.spark, self.path).where(c("audit_id") == audit_id), relations.catalog(self.spark, self.path)
        )

    def score(self, audit_id: str) -> int:
        self._known(audit_id)
        return report_queries.site_score(self.spark, self.path).where(c("audit_id") == audit_id).first()["score"]

    def overview(self, audit_id: str) -> DataFrame:
        return report_queries.overview(self._pages(audit_id, "response_time", "status_code", "content_type", "word_count", "image_count", "title", "meta_description", "h1s"))

    def compare(self, earlier: str, later: str) -> DataFrame:
        self._known(earlier)
        self._known(later)
        pair = self.spark.createDataFrame([(later, earlier)], "pair string, earlier string")
        return compare(diff_queries._pages(self.spark, self.path), pair)
