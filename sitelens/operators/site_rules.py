"""Rules that need other pages of the same audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions.fingerprint import bands, hamming
from sitelens.functions.robots import verdict
from sitelens.functions.urls import normalize_url, sitemap_key
from sitelens.operators.page_rules import is_html, is_success
from sitelens.sources import relations
from sitelens.sources.robots import robots_rules, sample_robots

c = F.col


def url_keys(pages: DataFrame) -> DataFrame:
    """(audit_id, key, page): the page each URL of an audit stands for.

    A page answers for its url and its final_url; where several do, the first in crawl
    order (crawled_at, then id) wins.
    """
    keyed = pages.select(
        "audit_id", F.struct("crawled_at", "id").alias("seq"),
        F.explode(F.array_distinct(F.filter(F.array(normalize_url(c("url")), normalize_url(c("final_url"))), lambda k: k.isNotNull()))).alias("key"),
    )
    return keyed.groupBy("audit_id", "key").agg(F.min("seq").alias("seq")).select("audit_id", "key", c("seq.id").alias("page_id"))


def hreflang_no_return(pages: DataFrame) -> DataFrame:
    """(audit_id, page_id, n_missing): alternates that were crawled but don't point back."""
    edges = pages.select("audit_id", c("id").alias("source"), "url", "final_url", F.explode("hreflangs").alias("h")).where(F.lower("h.language") != "x-default")
    edges = edges.select(
        "audit_id", "source", normalize_url(c("h.href")).alias("key"), normalize_url(c("url")).alias("u"), normalize_url(c("final_url")).alias("f"),
        F.concat_ws("-", "h.language", "h.region").alias("code"),
    )
    targets = edges.join(url_keys(pages), ["audit_id", "key"])
    back = edges.select("audit_id", c("source").alias("page_id"), c("key").alias("to")).distinct()
    # Two equi anti joins, one per spelling under which the source may be named.
    missing = targets.join(back.withColumnRenamed("to", "u"), ["audit_id", "page_id", "u"], "left_anti")
    missing = missing.join(back.withColumnRenamed("to", "f"), ["audit_id", "page_id", "f"], "left_anti")
    return missing.groupBy("audit_id", "source").agg(F.count(F.lit(1)).alias("n_missing")).withColumnRenamed("source", "page_id")


def canonical_broken_target(pages: DataFrame) -> DataFrame:
    """(audit_id, page_id, reason): the canonical names a crawled page that errs, redirects or is not indexed."""
    sources = pages.where(c("canonical").isNotNull() & (normalize_url(c("canonical")) != normalize_url(c("url"))))
    sources = sources.select("audit_id", c("id").alias("source"), normalize_url(c("canonical")).alias("key"))
    facts = pages.select(c("id").alias("page_id"), "status_code", F.size("redirect_chain").alias("hops"), "noindex")
    hit = sources.join(url_keys(pages), ["audit_id", "key"]).join(facts, "page_id")
    reason = F.when(c("status_code").between(400, 599), "status").when(c("hops") > 0, "redirects").when(c("noindex"), "noindex")
    return hit.select("audit_id", c("source").alias("page_id"), reason.alias("reason")).where(c("reason").isNotNull())


def is_indexable() -> Column:
    """2xx, not noindex, and no canonical to another page."""
    other = c("canonical").isNotNull() & (normalize_url(c("canonical")) != normalize_url(c("url")))
    return F.coalesce(is_success(), F.lit(False)) & ~F.coalesce(c("noindex"), F.lit(False)) & ~F.coalesce(other, F.lit(False))


def sitemap_missing(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """(audit_id, page_id): indexable pages not in the sitemap of their audit; nothing for audits without sitemap URLs.

    ``sitemap``: audit_id, url.
    """
    listed = sitemap.select("audit_id", sitemap_key(c("url")).alias("key")).distinct()
    known = pages.where(is_indexable()).join(listed.select("audit_id").distinct(), "audit_id", "left_semi")
    known = known.select("audit_id", c("id").alias("page_id"), sitemap_key(c("url")).alias("u"), sitemap_key(c("final_url")).alias("f"))
    out = known.join(listed.withColumnRenamed("key", "u"), ["audit_id", "u"], "left_anti")
    return out.join(listed.withColumnRenamed("key", "f"), ["audit_id", "f"], "left_anti").select("audit_id", "page_id")


def sitemap_orphans(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """(audit_id, url): sitemap URLs never crawled, one per key; the last spelling stands for it."""
    listed = sitemap.groupBy("audit_id", sitemap_key(c("url")).alias("key")).agg(F.max("url").alias("url"))
    crawled = pages.select("audit_id", F.explode(F.array(sitemap_key(c("url")), sitemap_key(c("final_url")))).alias("key")).where("key is not null")
    return listed.join(crawled, ["audit_id", "key"], "left_anti").select("audit_id", "url")


def exact_duplicates(pages: DataFrame) -> DataFrame:
    """(audit_id, page_id, n_copies): 2xx HTML pages whose content hash occurs under another URL of the audit."""
    known = pages.where(c("exact_hash").isNotNull())
    sizes = known.groupBy("audit_id", "exact_hash").agg(F.countDistinct("url").alias("n"))
    hit = known.where(is_html() & is_success()).join(sizes.where("n > 1"), ["audit_id", "exact_hash"])
    return hit.select("audit_id", c("id").alias("page_id"), (c("n") - 1).alias("n_copies"))


def near_duplicates(pages: DataFrame, distance: int = 3) -> DataFrame:
    """(audit_id, page_id, n_near): pages with a different page within the Hamming distance.

    Pages are first reduced to distinct hashes with their numbers of pages, so equal
    hashes never meet each other in the join.  The two halves of a hash are equal, so a
    distance of d means at most d // 2 low bits differ and one of d // 2 + 1 bands agrees.
    """
    known = pages.where(c("exact_hash").isNotNull() & c("sim_hash").isNotNull())
    kinds = known.groupBy("audit_id", "sim_hash", "exact_hash").agg(F.count(F.lit(1)).alias("n"))
    hashes = kinds.groupBy("audit_id", "sim_hash").agg(F.sum("n").alias("n"))
    keyed = hashes.withColumn("band", F.explode(bands(c("sim_hash"), distance // 2 + 1)))
    a, b = keyed.alias("a"), keyed.alias("b")
    pairs = a.join(b, (c("a.audit_id") == c("b.audit_id")) & (c("a.band") == c("b.band")) & (c("a.sim_hash") != c("b.sim_hash")))
    pairs = pairs.where(hamming(c("a.sim_hash"), c("b.sim_hash")) <= distance)
    pairs = pairs.select(c("a.audit_id").alias("audit_id"), c("a.sim_hash").alias("sim_hash"), c("b.sim_hash").alias("other"), c("b.n").alias("n")).distinct()
    across = pairs.groupBy("audit_id", "sim_hash").agg(F.sum("n").alias("across"))
    same = kinds.withColumnRenamed("n", "own").join(hashes.withColumnRenamed("n", "all"), ["audit_id", "sim_hash"]).join(across, ["audit_id", "sim_hash"], "left")
    same = same.select("audit_id", "sim_hash", "exact_hash", (c("all") - c("own") + F.coalesce("across", F.lit(0))).alias("n_near")).where("n_near > 0")
    hit = known.where(is_html() & is_success()).join(same, ["audit_id", "sim_hash", "exact_hash"])
    return hit.select("audit_id", c("id").alias("page_id"), "n_near")


def robots_blocks_indexable(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(audit_id, page_id): indexable pages that the robots rules of their host forbid."""
    from sitelens.functions.urls import host

    known = pages.where(is_indexable()).withColumn("host", host(c("url")))
    judged = verdict(known.select("audit_id", c("id").alias("page_id"), "host", "url"), rules)
    return judged.where(~c("allowed")).select("audit_id", "page_id")


_FACTS = ("url", "final_url", "canonical", "status_code", "noindex", "content_type", "exact_hash", "sim_hash", "redirect_chain", "hreflangs", "crawled_at")


def sample_sitemap(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap per audit from the recorded tables: pages at even depth and the recorded orphans."""
    p = relations.pages(spark, d, "url", "crawl_depth").where("crawl_depth % 2 = 0").select("audit_id", "url")
    return p.unionByName(relations.site_issues(spark, d).where("code = 'sitemap_orphans' and context is not null").select("audit_id", c("context").alias("url")))


def _on_pages(function, *more):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return function(relations.pages(spark, d, *_FACTS), *[m(spark, d) for m in more])

    run.__doc__ = function.__doc__
    return run


def _robots(spark: SparkSession, d: str) -> DataFrame:
    return robots_rules(sample_robots(spark, d))


QUERIES = {
    "hreflang_no_return": _on_pages(hreflang_no_return),
    "canonical_broken_target": _on_pages(canonical_broken_target),
    "sitemap_missing": _on_pages(sitemap_missing, sample_sitemap),
    "sitemap_orphans": _on_pages(sitemap_orphans, sample_sitemap),
    "exact_duplicate": _on_pages(exact_duplicates),
    "near_duplicate": _on_pages(near_duplicates),
    "robots_blocks_indexable": _on_pages(robots_blocks_indexable, _robots),
}
