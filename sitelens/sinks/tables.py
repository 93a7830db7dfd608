"""Writes: upserts, appends that ignore what is there, partition replacement, CSV layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col
#: Columns of a stored page that a later write may change; all others keep their first value.
MUTABLE = ("status_code", "body_size", "response_time", "final_url", "error_count", "warning_count", "crawl_depth", "headers", "redirect_chain")
CATALOG_VERSION = "2026-04"


def upsert(existing: DataFrame, changes: DataFrame, key: str = "id", mutable: tuple[str, ...] = MUTABLE) -> DataFrame:
    """The table after the changes: new keys are added, known keys take the mutable columns only."""
    a, b = existing.alias("a"), changes.alias("b")
    known = c(f"a.{key}").isNotNull()
    columns = []
    for name in existing.columns:
        new = c(f"b.{name}") if name in changes.columns else F.lit(None)
        if name == key:
            columns.append(F.coalesce(f"a.{name}", f"b.{name}").alias(name))
        elif name in mutable and name in changes.columns:
            columns.append(F.when(c(f"b.{key}").isNotNull(), new).otherwise(c(f"a.{name}")).alias(name))
        else:
            columns.append(F.when(known, c(f"a.{name}")).otherwise(new).alias(name))
    return a.join(b, c(f"a.{key}") == c(f"b.{key}"), "full_outer").select(*columns)


def insert_or_ignore(existing: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is new, each key once (null keys are equal to each other)."""
    fresh = rows.dropDuplicates(key)
    there = existing.select(*[c(k).alias(f"__{k}") for k in key]).distinct()
    same = F.lit(True)
    for k in key:
        same = same & c(k).eqNullSafe(c(f"__{k}"))
    return fresh.join(there, same, "left_anti")


def stamped(issues: DataFrame, version: str = CATALOG_VERSION) -> DataFrame:
    return issues.withColumn("catalog_version", F.coalesce("catalog_version", F.lit(version)))


def replace_page_issues(issues: DataFrame, pages: DataFrame, fresh: DataFrame) -> DataFrame:
    """Issues after the pages were written again: those of the written pages are replaced by ``fresh``."""
    kept = issues.join(pages.select(c("id").alias("page_id")).distinct(), "page_id", "left_anti")
    return kept.select(*issues.columns).unionByName(stamped(fresh).select(*issues.columns))


def append_issues(pages: DataFrame, fresh: DataFrame) -> DataFrame:
    """The pages with their error and warning counters raised by the new issues; null counters count as 0."""
    raised = fresh.groupBy(c("page_id").alias("id")).agg(F.count_if(c("severity") == "error").alias("__e"), F.count_if(c("severity") == "warning").alias("__w"))
    more = lambda name, by: (F.coalesce(name, F.lit(0)) + F.coalesce(by, F.lit(0))).cast("int").alias(name)
    t = pages.join(raised, "id", "left").withColumns({"error_count": more("error_count", "__e"), "warning_count": more("warning_count", "__w")})
    return t.select(*pages.columns)


#: Tables by the column that leads to their audit; issues lead there through their page.
OWNED = {"audits": "id", "pages": "audit_id", "site_issues": "audit_id", "external_url_checks": "audit_id"}


def without_audits(relations: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the audits in ``gone`` (id) and everything that belongs to them.

    Rows whose audit or page is null belong to none and stay.
    """
    ids = gone.select("id").distinct()
    out = {name: df.join(ids.withColumnRenamed("id", OWNED[name]), OWNED[name], "left_anti") for name, df in relations.items() if name in OWNED}
    pages = relations["pages"].join(ids.withColumnRenamed("id", "audit_id"), "audit_id", "left_semi").select(c("id").alias("page_id")).distinct()
    out["issues"] = relations["issues"].join(pages, "page_id", "left_anti")
    return out


def new_ids(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(id): ids that were not known the last time, each once; null ids are none."""
    return rows.select("id").where("id is not null").distinct().join(known.select("id").distinct(), "id", "left_anti")


def snapshot(overviews: DataFrame, audits: DataFrame, path: str) -> None:
    """Store the overview of every completed audit as one JSON row, partitioned by audit; other audits' rows stay."""
    done = audits.where("status = 'completed'").select(c("id").alias("audit_id"), c("completed_at").alias("generated_at"))
    rows = overviews.join(done, "audit_id").select("audit_id", F.to_json(F.struct(*[n for n in overviews.columns if n != "audit_id"])).alias("overview"), "generated_at")
    replace_audits(rows, path)


def replace_audits(rows: DataFrame, path: str) -> None:
    """Write rows partitioned by audit; only the audits that occur in them are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("audit_id").parquet(path)


def pages_csv(pages: DataFrame) -> DataFrame:
    """The 15 text columns of an exported page list."""
    yes = lambda x: F.when(x, "Yes").otherwise("No")
    indexable = c("status_code").between(200, 299) & ~c("noindex") & (c("canonical_status") != "other")
    return pages.select(
        c("url").alias("URL"), c("status_code").cast("string").alias("Status"), F.coalesce("content_type", F.lit("")).alias("Content type"),
        c("body_size").cast("string").alias("Size"), F.format_number("response_time", 0).alias("Time"), c("crawl_depth").cast("string").alias("Depth"),
        F.coalesce("title", F.lit("")).alias("Title"), F.length("title").cast("string").alias("Title length"), F.coalesce("meta_description", F.lit("")).alias("Description"),
        c("word_count").cast("string").alias("Words"), c("error_count").cast("string").alias("Errors"), c("warning_count").cast("string").alias("Warnings"),
        F.coalesce("canonical", F.lit("")).alias("Canonical"), c("canonical_status").alias("Canonical status"), yes(F.coalesce(indexable, F.lit(False))).alias("Indexable"),
    )


def externals_csv(checks: DataFrame) -> DataFrame:
    """The 6 text columns of exported external links; a check without an answer reads Error."""
    return checks.select(
        c("url").alias("URL"), F.coalesce(c("status_code").cast("string"), F.lit("Error")).alias("Status"), F.format_number("response_time", 0).alias("Time"),
        F.coalesce("error", F.lit("")).alias("Error"), F.coalesce("source_url", F.lit("")).alias("Source"), F.coalesce("anchor_text", F.lit("")).alias("Anchor"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
