"""Text predicates shared by rules and read models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_blank(text: Column) -> Column:
    """Null, empty or nothing but ASCII white space."""
    return ~F.coalesce(text.rlike(r"[^ \t\n\r\x0B\x00]"), F.lit(False))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\n\r\x0B\x00]+|[ \t\n\r\x0B\x00]+$", "")


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only, as plain LIKE comparisons use."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of non-empty tokens between white space; null counts as empty."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def clean_text(html: Column) -> Column:
    """Body text without scripts, styles and page furniture; entities resolved, white space collapsed."""
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "header", "footer", "aside", "noscript", "iframe"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?(</{tag}\s*>|$)", " ")
    body = F.regexp_extract(t, r"(?is)<body[^>]*>(.*)$", 1)
    t = F.regexp_replace(F.when(body != "", body).otherwise(t), r"<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def byte_size(n: Column) -> Column:
    """One decimal of MB from a mebibyte on, whole KB below."""
    return F.when(n >= 1048576, F.format_string("%.1f MB", n / 1048576.0)).otherwise(F.format_string("%d KB", (n / 1024).cast("long")))


def score_band(score: Column) -> Column:
    return F.when(score >= 90, "good").when(score >= 50, "fair").otherwise("poor")


def status_class(code: Column) -> Column:
    """Class of an HTTP status: '1xx'..'5xx', null outside 100..599."""
    return F.when(code.between(100, 599), F.concat((F.floor(code / 100)).cast("string"), F.lit("xx")))
