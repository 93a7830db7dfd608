"""Rules that look at one page: every rule is an array of contexts, one entry per issue.

All rules are evaluated in one pass over the page facts and exploded once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import is_blank, trimmed
from sitelens.functions.urls import normalize_url, part

# Language codes that an alternate may name.
LANGUAGE_CODES = (
    "aa", "ab", "af", "ak", "am", "an", "ar", "as", "av", "ay", "az", "ba", "be", "bg", "bh", "bi", "bm", "bn", "bo", "br", "bs", "ca",
    "ce", "ch", "co", "cr", "cs", "cu", "cv", "cy", "da", "de", "dv", "dz", "ee", "el", "en", "eo", "es", "et", "eu", "fa", "ff", "fi",
    "fj", "fo", "fr", "fy", "ga", "gd", "gl", "gn", "gu", "gv", "ha", "he", "hi", "ho", "hr", "ht", "hu", "hy", "hz", "ia", "id", "ie",
    "ig", "ii", "ik", "io", "is", "it", "iu", "ja", "jv", "ka", "kg", "ki", "kj", "kk", "kl", "km", "kn", "ko", "kr", "ks", "ku", "kv",
    "kw", "ky", "la", "lb", "lg", "li", "ln", "lo", "lt", "lu", "lv", "mg", "mh", "mi", "mk", "ml", "mn", "mr", "ms", "mt", "my", "na",
    "nb", "nd", "ne", "ng", "nl", "nn", "no", "nr", "nv", "ny", "oc", "oj", "om", "or", "os", "pa", "pi", "pl", "ps", "pt", "qu", "rm",
    "rn", "ro", "ru", "rw", "sa", "sc", "sd", "se", "sg", "si", "sk", "sl", "sm", "sn", "so", "sq", "sr", "ss", "st", "su", "sv", "sw",
    "ta", "te", "tg", "th", "ti", "tk", "tl", "tn", "to", "tr", "ts", "tt", "tw", "ty", "ug", "uk", "ur", "uz", "ve", "vi", "vo", "wa",
    "wo", "xh", "yi", "yo", "za", "zh", "zu",
)
# Referrer policies that leak no path to other origins.
SAFE_REFERRER = ("no-referrer", "no-referrer-when-downgrade", "strict-origin", "strict-origin-when-cross-origin")
# Link types whose content a page loads.
LOADED_TYPES = ("script", "stylesheet", "iframe", "image", "video", "audio", "font")
#: Columns of pages that the rules read.
FACTS = (
    "url", "status_code", "content_type", "body_size", "response_time", "final_url", "headers", "title", "meta_description", "h1s", "h2s",
    "heading_hierarchy", "viewport", "lang", "og_title", "og_description", "og_image", "word_count", "noindex", "nofollow", "canonical",
    "redirect_chain", "links", "hreflangs",
)

c = F.col
Rule = Callable[[str], Column]


def _one(condition: Column, context: Column | None = None) -> Column:
    """One issue if the condition holds."""
    ctx = F.lit(None).cast("string") if context is None else context.cast("string")
    return F.when(F.coalesce(condition, F.lit(False)), F.array(ctx)).otherwise(F.array().cast("array<string>"))


def header(name: str) -> Column:
    """First value of a header, whatever the case of its name."""
    hit = F.map_filter(c("headers"), lambda k, v: F.lower(k) == name)
    return F.try_element_at(F.try_element_at(F.map_values(hit), F.lit(1)), F.lit(1))


def _list(items: Column, shown: int = 5) -> Column:
    """The first entries joined by commas, and how many more there are."""
    more = F.when(F.size(items) > shown, F.format_string(" (+%d more)", F.size(items) - shown)).otherwise(F.lit(""))
    return F.concat(F.array_join(F.slice(items, 1, shown), ", "), more)


def is_html() -> Column:
    return F.coalesce(F.lower(c("content_type")).contains("text/html"), F.lit(False))


def is_success() -> Column:
    return c("status_code").between(200, 299)


def _metadata(compat: str) -> Column:
    """Whether a page has metadata: every HTML page, or only what survives storage."""
    return is_html() if compat == "intended" else is_html() & (c("title").isNotNull() | (c("word_count") > 0))


def _scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def _images() -> Column:
    return F.filter("links", lambda x: x["type"] == "image")


def _extra(df_columns: list[str], names: tuple[str, ...]) -> Column:
    """Whether all the named facts are filled; facts that were never stored count as missing."""
    checks = [~is_blank(c(n)) if n in df_columns else F.lit(False) for n in names]
    out = checks[0]
    for x in checks[1:]:
        out = out & x
    return out


def with_parts(pages: DataFrame) -> DataFrame:
    """The pages with what several rules, or one rule for each of its links, ask for: worked out once per page."""
    return pages.withColumns({"__page_key": normalize_url(c("url")), "__policy": header("referrer-policy")})


def page_rules(columns: list[str], compat: str = "intended") -> dict[str, Column]:
    """code -> array of contexts, over page facts with the given columns, prepared by ``with_parts``."""
    html, ok, meta = is_html(), is_success(), _metadata(compat)
    effective = F.coalesce(c("final_url"), c("url"))
    hops = F.coalesce(c("redirect_chain"), F.array())
    froms = F.transform("redirect_chain", lambda h: h["from_url"])
    last_to = F.try_element_at(c("redirect_chain"), F.lit(-1))["to_url"]
    images, alts = _images(), F.coalesce(c("hreflangs"), F.array())
    nofollow = F.filter("links", lambda x: x["internal"] & (x["type"] == "anchor") & (x["rel"] == "nofollow"))
    insecure = F.filter("links", lambda x: x["type"].isin(*LOADED_TYPES) & (_scheme(x["url"]) == "http"))
    code_of = lambda h: F.when(h["region"].isNotNull(), F.concat_ws("-", h["language"], h["region"])).otherwise(h["language"])
    codes = F.transform("hreflangs", code_of)
    levels = F.transform("heading_hierarchy", lambda h: h["level"])
    skips = F.exists(F.sequence(F.lit(1), F.size(levels) - 1), lambda i: F.get(levels, i) > F.get(levels, i - 1) + 1)
    policy, page_key = c("__policy"), c("__page_key")
    secure = html & ok
    return {
        "client_error": _one(c("status_code").between(400, 499), c("status_code")),
        "server_error": _one(c("status_code").between(500, 599), c("status_code")),
        "redirect_chain": _one(F.size("redirect_chain") >= 2, F.concat_ws(" → ", froms, last_to)),
        "redirect_loop": _one((F.size("redirect_chain") > 0) & ((F.size(F.array_distinct(froms)) < F.size(froms)) | F.array_contains(froms, last_to)), last_to),
        "mixed_protocol_redirect": _one(F.exists(hops, lambda h: _scheme(h["from_url"]) != _scheme(h["to_url"]))),
        "redirect_not_permanent": _one((F.size("redirect_chain") > 0) & ~F.forall(hops, lambda h: h["status_code"].isin(301, 308))),
        "internal_nofollow": _one(html & (F.size(nofollow) > 0), _list(F.transform(nofollow, lambda x: x["url"]))),
        "title_missing": _one(html & meta & is_blank(c("title"))),
        "title_too_long": _one(html & meta & ~is_blank(c("title")) & (F.char_length("title") > 60), c("title")),
        "title_too_short": _one(html & meta & ~is_blank(c("title")) & (F.char_length("title") < 30), c("title")),
        "meta_description_missing": _one(html & meta & is_blank(c("meta_description"))),
        "meta_description_too_long": _one(html & meta & ~is_blank(c("meta_description")) & (F.char_length("meta_description") > 160)),
        "h1_missing": _one(html & meta & (F.coalesce(F.size("h1s"), F.lit(0)) <= 0)),
        "h1_multiple": _one(html & meta & (F.size("h1s") > 1), F.array_join("h1s", ", ")),
        "viewport_missing": _one(html & meta & is_blank(c("viewport"))),
        "html_lang_missing": _one(html & meta & is_blank(c("lang"))),
        "noindex": _one(c("noindex")),
        "nofollow": _one(c("nofollow")),
        "canonical_missing": _one(html & ok & c("canonical").isNull()),
        "canonical_non_self": _one(html & ok & (normalize_url(c("canonical")) != page_key), c("canonical")),
        "noindex_with_canonical": _one(c("noindex") & c("canonical").isNotNull(), c("canonical")),
        "h2_missing": _one(html & meta & (F.coalesce(F.size("h2s"), F.lit(0)) <= 0)),
        "h1_not_first": _one(html & meta & (F.size("heading_hierarchy") > 0) & (F.get(levels, F.lit(0)) != 1)),
        "heading_skip": _one(html & meta & (F.size(levels) > 1) & F.when(F.size(levels) > 1, skips).otherwise(F.lit(False))),
        "content_empty": _one(html & meta & ok & (c("word_count") <= 50), c("word_count")),
        "content_thin": _one(html & meta & ok & c("word_count").between(51, 79), c("word_count")),
        "img_alt_missing": _one(html & F.exists(images, lambda x: is_blank(x["anchor"])), _list(F.transform(F.filter(images, lambda x: is_blank(x["anchor"])), lambda x: x["url"]))),
        "img_alt_too_long": F.when(html, F.transform(F.filter(images, lambda x: F.char_length(x["anchor"]) > 125), lambda x: x["url"])).otherwise(F.array().cast("array<string>")),
        "image_missing_dimensions": _one(html & F.exists(images, lambda x: x["width"].isNull() | x["height"].isNull())),
        "response_very_slow": _one(c("response_time") >= 3000, F.format_string("%.0f ms", c("response_time"))),
        "response_slow": _one((c("response_time") >= 1000) & (c("response_time") < 3000), F.format_string("%.0f ms", c("response_time"))),
        "page_too_large": _one(html & (c("body_size") > 524288), c("body_size")),
        "csp_missing": _one(secure & is_blank(header("content-security-policy"))),
        "x_frame_missing": _one(secure & is_blank(header("x-frame-options"))),
        "x_content_type_missing": _one(secure & is_blank(header("x-content-type-options"))),
        "referrer_policy_missing": _one(secure & is_blank(policy)),
        "referrer_policy_insecure": _one(secure & ~is_blank(policy) & ~F.lower(trimmed(policy)).isin(*SAFE_REFERRER), policy),
        "http_insecure": _one(_scheme(effective) == "http", effective),
        "mixed_content": _one(html & (_scheme(effective) == "https") & (F.size(insecure) > 0), _list(F.transform(insecure, lambda x: F.format_string("%s (%s)", x["url"], x["type"])))),
        "open_graph_incomplete": _one(secure & meta & ~_extra(columns, ("og_title", "og_description", "og_image"))),
        "twitter_card_incomplete": _one(secure & meta & ~_extra(columns, ("twitter_card", "twitter_title", "twitter_description", "twitter_image"))),
        "schema_org_missing": _one(
            secure & meta
            & ~(F.size("json_ld_types") > 0 if "json_ld_types" in columns else F.lit(False))
            & ~(F.coalesce(c("has_microdata"), F.lit(False)) if "has_microdata" in columns else F.lit(False))
        ),
        "hreflang_invalid_language": F.when(html, F.transform(F.filter(alts, lambda h: (F.lower(h["language"]) != "x-default") & ~F.lower(h["language"]).isin(*LANGUAGE_CODES)), code_of)).otherwise(F.array().cast("array<string>")),
        "hreflang_invalid_region": F.when(html, F.transform(F.filter(alts, lambda h: h["region"].isNotNull() & ~h["region"].rlike("^[A-Za-z]{2}$")), code_of)).otherwise(F.array().cast("array<string>")),
        "hreflang_missing_self": _one(html & (F.size("hreflangs") > 0) & ~F.exists(alts, lambda h: F.coalesce(normalize_url(h["href"]) == page_key, F.lit(False)))),
        "hreflang_duplicate": _one(html & (F.size(F.array_distinct(codes)) < F.size(codes))),
    }


def _labelled(code: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(code).alias("code"), x.alias("context"))


def judged(pages: DataFrame, codes: list[str] | None = None, compat: str = "intended") -> DataFrame:
    """(audit_id, page_id, issues): the issues of each row as an array of (code, context)."""
    rules = page_rules(pages.columns, compat)
    if codes is not None:
        rules = {k: rules[k] for k in codes}
    names = list(rules)
    found: list[Column] = []
    for at in range(0, len(names), 8):  # several small expressions keep generated methods within the size limit
        parts = [
            F.transform(F.coalesce(rules[n], F.array().cast("array<string>")), _labelled(n))
            for n in names[at : at + 8]
        ]
        found.append(F.concat(*parts) if len(parts) > 1 else parts[0])
    every = F.concat(*found) if len(found) > 1 else found[0]
    return with_parts(pages).select("audit_id", F.col("id").alias("page_id"), every.alias("issues"))


def page_issues(pages: DataFrame, codes: list[str] | None = None, compat: str = "intended", repeated: bool = False) -> DataFrame:
    """(audit_id, page_id, code, context): one row per issue of the page rules.

    ``compat="stored"`` treats pages without title and words as pages without metadata.
    Facts that a table lacks count as missing; null flags and statuses raise nothing.
    ``repeated``: pages may occur in several equal rows; they are told apart after the
    rules, so that only ids and issues are shuffled, not the wide facts.
    """
    rows = judged(pages, codes, compat)
    if repeated:
        rows = rows.where(F.size("issues") > 0).dropDuplicates(["page_id"])
    return rows.select("audit_id", "page_id", F.inline("issues"))
