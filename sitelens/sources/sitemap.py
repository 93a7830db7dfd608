"""Sitemap documents as tables of URLs."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.urls import canonical_url, is_strict

#: URLs read from one file, files of one site, levels of index files.
URLS_PER_FILE, FILES, DEPTH = 50_000, 50, 2


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for t in batches:
        rows = []
        for source, body in zip(t["source"], t["body"]):
            try:
                root = ElementTree.fromstring((body or "").lstrip("﻿").strip().encode())
            except ElementTree.ParseError:
                continue
            kind = root.tag.rpartition("}")[2]
            if kind in ("urlset", "sitemapindex"):
                locs = [(e.text or "").strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc"]
                rows += [(source, kind, i, u) for i, u in enumerate(x for x in locs if x) if i < URLS_PER_FILE]
        yield pd.DataFrame(rows, columns=["source", "kind", "pos", "loc"])


def locations(documents: DataFrame) -> DataFrame:
    """(source, kind, pos, loc) of sitemap documents (source, body); unreadable documents give no rows."""
    return documents.select("source", "body").mapInPandas(_read, "source string, kind string, pos int, loc string")


def sitemap_urls(entries: DataFrame, documents: DataFrame) -> DataFrame:
    """(site, url): canonical URLs of the sitemaps of each site, each once.

    ``entries``: site, source (the sitemaps to start from); ``documents``: source, body.
    Index files are followed ``DEPTH`` levels down; of a site's files the first ``FILES``
    by level and name are read.
    """
    found = locations(documents)
    level = entries.select("site", "source", F.lit(0).alias("level"))
    files = level
    for depth in range(1, DEPTH + 1):
        level = level.join(found.where("kind = 'sitemapindex'"), "source").select("site", F.col("loc").alias("source"), F.lit(depth).alias("level"))
        files = files.unionByName(level)
    files = files.groupBy("site", "source").agg(F.min("level").alias("level"))
    first = Window.partitionBy("site").orderBy("level", "source")
    files = files.withColumn("k", F.row_number().over(first)).where(F.col("k") <= FILES)
    urls = files.join(found.where("kind = 'urlset'"), "source").where(is_strict(F.col("loc")))
    return urls.select("site", canonical_url(F.col("loc")).alias("url")).distinct()
