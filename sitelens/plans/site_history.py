"""The audits of a site as a series of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.urls import canonical_url, site_host
from sitelens.operators.snapshots import consecutive, content_digest, snapshot_changes


def completed_audits(audits: DataFrame) -> DataFrame:
    """(id, series, taken_at) of audits some row of which is completed; series is the site's host."""
    done = audits.where((F.col("status") == "completed") & F.col("completed_at").isNotNull())
    return done.groupBy("id").agg(
        F.max(F.struct("completed_at", "seed_url")).alias("last")
    ).select("id", site_host(F.col("last.seed_url")).alias("series"), F.col("last.completed_at").alias("taken_at"))


def page_records(pages: DataFrame, issues: DataFrame, audits: DataFrame) -> DataFrame:
    """(snapshot, rec, digest, label): one row per page record of the given audits.

    The key is the canonical URL, the content the set of distinct issue codes.  Should
    several pages of an audit share a canonical URL, their codes are united and the
    smallest page id stands for them.  Pages without an id, audit or URL are no records.
    """
    # Both sides meet hashed on the page id once; the grouping below reuses that layout.
    codes = issues.where(F.col("code").isNotNull() & F.col("page_id").isNotNull()).select(F.col("page_id").alias("id"), "code")
    codes = codes.groupBy("id").agg(F.collect_set("code").alias("codes"))
    wanted = audits.select(F.col("id").alias("audit_id")).distinct()
    known = pages.select("id", "audit_id", "url").where("id is not null and audit_id is not null and url is not null")
    known = known.join(wanted, "audit_id", "left_semi").join(codes, "id", "left")
    merged = known.select(
        F.col("audit_id").alias("snapshot"), F.xxhash64(canonical_url(F.col("url"))).alias("rec"), "id",
        F.coalesce("codes", F.array().cast("array<string>")).alias("codes"),
    ).groupBy("snapshot", "rec").agg(F.min("id").alias("label"), F.collect_set("codes").alias("codes"))
    return merged.select("snapshot", "rec", content_digest(F.flatten("codes")).alias("digest"), "label")


def page_changes(audits: DataFrame, pages: DataFrame, issues: DataFrame) -> DataFrame:
    """(audit_id, page_id, change) between each completed audit and its site's previous completed one."""
    series = completed_audits(audits)
    pairs = consecutive(series)
    involved = pairs.select(F.col("pair").alias("id")).unionByName(pairs.select(F.col("earlier").alias("id")))
    changes = snapshot_changes(page_records(pages, issues, involved), pairs)
    return changes.select(F.col("pair").alias("audit_id"), F.col("label").alias("page_id"), "change").distinct()
