"""The crawl frontier as a relation: discovery, deduplication, batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.urls import canonical_url, normalize_url, origin

c = F.col
# Link types that are fetched as resources of a page.
RESOURCE_TYPES = ("image", "script", "stylesheet", "preload", "modulepreload", "video", "audio", "font", "prefetch")


def expand(pages: DataFrame, audits: DataFrame, crawl_resources: bool = False) -> DataFrame:
    """(audit_id, url, depth, source, seq): links that a crawl of each page would add.

    Internal anchors without nofollow (and resources, if asked) one level below the
    page, while that level is within the audit's depth.
    """
    limit = audits.select(c("id").alias("audit_id"), "max_depth")
    links = pages.join(limit, "audit_id").where(c("crawl_depth") + 1 <= c("max_depth")).select(
        "audit_id", (c("crawl_depth") + 1).alias("depth"), F.struct("crawled_at", "id").alias("page"), F.posexplode("links").alias("pos", "l")
    )
    wanted = (c("l.type") == "anchor") & (c("l.rel") == "follow")
    if crawl_resources:
        wanted = wanted | c("l.type").isin(*RESOURCE_TYPES)
    links = links.where(c("l.internal") & wanted)
    return links.select("audit_id", c("l.url").alias("url"), "depth", F.lit("link").alias("source"), F.struct(F.lit(2).alias("phase"), c("page.crawled_at").alias("at"), c("page.id").alias("id"), "pos").alias("seq"))


def seeds(audits: DataFrame) -> DataFrame:
    nothing = F.struct(F.lit(0).alias("phase"), F.lit(None).cast("timestamp").alias("at"), F.lit("").alias("id"), F.lit(0).alias("pos"))
    return audits.select(c("id").alias("audit_id"), c("seed_url").alias("url"), F.lit(0).alias("depth"), F.lit("seed").alias("source"), nothing.alias("seq"))


def from_sitemap(sitemap: DataFrame) -> DataFrame:
    """Sitemap URLs enter at depth 0, of whatever host, after the seed."""
    nothing = F.struct(F.lit(1).alias("phase"), F.lit(None).cast("timestamp").alias("at"), c("url").alias("id"), F.lit(0).alias("pos"))
    return sitemap.select("audit_id", "url", F.lit(0).alias("depth"), F.lit("sitemap").alias("source"), nothing.alias("seq"))


def build(*discoveries: DataFrame) -> DataFrame:
    """(audit_id, key, url, depth, source, seq): each canonical URL once, as it was discovered first."""
    every = discoveries[0]
    for x in discoveries[1:]:
        every = every.unionByName(x)
    every = every.where("url is not null").withColumn("key", canonical_url(c("url")))
    return every.groupBy("audit_id", "key").agg(F.min(F.struct("seq", "depth", "source", "url")).alias("f")).select(
        "audit_id", "key", c("f.url").alias("url"), c("f.depth").alias("depth"), c("f.source").alias("source"), c("f.seq").alias("seq")
    )


def batch(frontier: DataFrame, visited: DataFrame, size: int) -> DataFrame:
    """The next ``size`` pending entries of every audit in order of discovery: (audit_id, key, position)."""
    pending = frontier.join(visited.select("audit_id", "key").distinct(), ["audit_id", "key"], "left_anti")
    w = Window.partitionBy("audit_id").orderBy("seq", "key")
    return pending.withColumn("position", F.row_number().over(w)).where(c("position") <= size).select("audit_id", "key", "position")
