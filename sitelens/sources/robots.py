"""robots.txt documents as tables of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions.urls import host, is_strict
from sitelens.session import table

#: The name under which rules are read where the caller names none.
AGENT = "sitelens"
_LINE = r"^\s*([^:]*?)\s*:\s*(.*?)\s*$"


def directives(documents: DataFrame) -> DataFrame:
    """(host, pos, name, value) of the directive lines of robots documents (host, body).

    Comments are cut, names are in lower case, lines without a value are skipped.
    """
    lines = documents.where(F.col("body").isNotNull()).select("host", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    bare = F.regexp_replace("line", "#.*$", "")
    return lines.select(
        "host", "pos", F.lower(F.regexp_extract(bare, _LINE, 1)).alias("name"), F.regexp_extract(bare, _LINE, 2).alias("value")
    ).where("value <> ''")


def robots_rules(documents: DataFrame, agent: str = AGENT, strict: bool = False) -> DataFrame:
    """(host, kind, pattern) of the rules that concern the agent.

    A group concerns it if one of its agents is ``*`` or part of the agent's name.  By
    default agents accumulate over the groups of a file, so every group after a
    relevant one is relevant too; ``strict`` starts each group afresh.
    """
    lines = directives(documents).where("name <> 'sitemap'")
    w = Window.partitionBy("host").orderBy("pos")
    is_agent = F.col("name") == "user-agent"
    hit = is_agent & ((F.col("value") == "*") | F.contains(F.lit(agent), F.lower("value")))
    if strict:
        starts = is_agent & ~F.coalesce(F.lag(is_agent).over(w), F.lit(False))
        lines = lines.withColumn("grp", F.sum(starts.cast("int")).over(w))
        w = Window.partitionBy("host", "grp").orderBy("pos")
    lines = lines.withColumn("relevant", F.max(hit.cast("int")).over(w))
    return lines.where("relevant = 1").where(F.col("name").isin("allow", "disallow")).select("host", F.col("name").alias("kind"), F.col("value").alias("pattern"))


def crawl_delay(documents: DataFrame, agent: str = AGENT) -> DataFrame:
    """(host, delay): the last delay among the directives that concern the agent."""
    lines = directives(documents).where("name <> 'sitemap'")
    w = Window.partitionBy("host").orderBy("pos")
    hit = (F.col("name") == "user-agent") & ((F.col("value") == "*") | F.contains(F.lit(agent), F.lower("value")))
    lines = lines.withColumn("relevant", F.max(hit.cast("int")).over(w)).where("relevant = 1 and name = 'crawl-delay'")
    return lines.groupBy("host").agg(F.max_by(F.col("value").try_cast("double"), "pos").alias("delay"))


def outcome(status: DataFrame) -> DataFrame:
    """(host, policy) from robots responses (host, status_code, body): block all, allow all, or parse."""
    code = F.col("status_code")
    return status.select(
        "host",
        F.when(code.isNull() | (code >= 500), "block").when(code >= 400, "allow").when(F.coalesce(F.length("body"), F.lit(0)) == 0, "allow").otherwise("parse").alias("policy"),
    )


def sitemap_locations(documents: DataFrame) -> DataFrame:
    """(host, sitemap): declared sitemaps of robots documents (host, origin, body), else ``<origin>/sitemap.xml``."""
    declared = directives(documents).where("name = 'sitemap'").where(is_strict(F.col("value"))).select("host", F.col("value").alias("sitemap"))
    rest = documents.join(declared, "host", "left_anti").select("host", F.concat("origin", F.lit("/sitemap.xml")).alias("sitemap"))
    return declared.unionByName(rest).distinct()


def sample_robots(spark: SparkSession, d: str) -> DataFrame:
    """(host, origin, body): one robots document per crawled host, made from the host itself."""
    hosts = table(spark, d, "pages").select(host(F.col("url")).alias("host")).where("host is not null").distinct()
    body = F.concat_ws(
        "\n", F.lit("# made up"), F.lit("User-agent: other"), F.lit("Disallow: /"), F.lit("User-agent: *"), F.lit("Disallow: /archive/  # old"),
        F.lit("Allow: /archive/*.html$"), F.lit("Crawl-delay: 2"), F.lit("Disallow:"),
        F.when(F.length("host") % 2 == 0, F.concat(F.lit("Sitemap: https://"), F.col("host"), F.lit("/map.xml"))),
    )
    return hosts.select("host", F.concat(F.lit("https://"), F.col("host")).alias("origin"), body.alias("body"))
