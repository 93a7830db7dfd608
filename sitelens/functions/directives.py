"""Indexing directives of headers and markup, and their union."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = ("noindex", "nofollow", "noarchive", "nosnippet", "noimageindex")


def robots_tag(header: Column) -> Column:
    """Flags of an X-Robots-Tag header, by substring whatever the case; no header sets none."""
    text = F.lower(F.coalesce(header, F.lit("")))
    return F.struct(*[text.contains(f).alias(f) for f in FLAGS])


def meta_robots(content: Column) -> Column:
    """Flags and limits of a robots meta element."""
    text = F.lower(F.coalesce(content, F.lit("")))
    number = lambda name: F.nullif(F.regexp_extract(text, name + r":\s*(\d+)", 1), F.lit("")).cast("int")
    return F.struct(
        *[text.contains(f).alias(f) for f in FLAGS], number("max-snippet").alias("max_snippet"), number("max-video-preview").alias("max_video_preview"),
        F.nullif(F.regexp_extract(text, r"max-image-preview:\s*([^\s,]+)", 1), F.lit("")).alias("max_image_preview"),
    )


def merge(a: Column, b: Column) -> Column:
    """Union of two directives: flags add up, limits take the smaller value, texts the first that is set."""
    return F.struct(
        *[(F.coalesce(a[f], F.lit(False)) | F.coalesce(b[f], F.lit(False))).alias(f) for f in FLAGS],
        F.least(a["max_snippet"], b["max_snippet"]).alias("max_snippet"), F.least(a["max_video_preview"], b["max_video_preview"]).alias("max_video_preview"),
        F.coalesce(a["max_image_preview"], b["max_image_preview"]).alias("max_image_preview"), F.coalesce(a["canonical"], b["canonical"]).alias("canonical"),
    )
