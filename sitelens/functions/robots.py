"""Robots verdicts as a join of pages with the rules of their host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.urls import part


def pattern_regex(pattern: Column) -> Column:
    """Regular expression of a path pattern: ``*`` is any text, a final ``$`` the end, else a prefix."""
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.expr("substring(pattern, 1, length(pattern) - 1)")).otherwise(pattern)
    quoted = F.regexp_replace(body, r"([\\.\[\]{}()+?^$|#\-])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(anchored, F.lit("$")).otherwise(F.lit("")))


def request_path(url: Column) -> Column:
    """Path with query, as robots patterns see it; '/' where the path is empty."""
    path, query = part(url, 3), part(url, 4)
    return F.concat(F.when(path == "", F.lit("/")).otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def verdict(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """The pages with ``allowed``: the longest matching pattern decides, allow wins ties, no match allows.

    ``pages`` has host and url, ``rules`` host, kind (allow, disallow), pattern.
    Only the rules of a page's own host meet it, packed into one row per host.
    """
    packed = rules.where(F.col("pattern") != "").withColumn("regex", pattern_regex(F.col("pattern")))
    packed = packed.groupBy("host").agg(F.collect_set(F.struct("kind", "regex", F.octet_length("pattern").alias("len"))).alias("rules"))
    joined = pages.join(packed, "host", "left").withColumn("path", request_path(F.col("url")))
    longest = lambda kind: F.coalesce(
        F.array_max(F.transform(F.filter("rules", lambda r: (r["kind"] == kind) & F.regexp_like(F.col("path"), r["regex"])), lambda r: r["len"])), F.lit(0)
    )
    return joined.withColumn("allowed", longest("allow") >= longest("disallow")).drop("rules", "path")
