"""URL algebra as column expressions (no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track a visit (any name starting with utm_ does too).
TRACKING_PARAMS = (
    "fbclid", "gclid", "gclsrc", "dclid", "msclkid", "yclid", "mc_cid", "mc_eid", "_ga", "_gl", "igshid", "mkt_tok",
)

#: scheme, authority, path, query, fragment
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#([\s\S]*))?$"
STRICT = r"^[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%\-]*$"
_UNRESERVED_HEX = "^(2[dDeE]|3[0-9]|[46][1-9a-fA-F]|[57][0-9aA]|5[fF]|7[eE])"


def part(url: Column, group: int) -> Column:
    """One component by its group in ``PARTS``; '' where it is absent."""
    return F.regexp_extract(F.trim(url), PARTS, group)


def is_strict(url: Column) -> Column:
    """Whether the text is a URL of allowed characters with a scheme and sound percent codes."""
    u = F.trim(url)
    return u.rlike(STRICT) & ~u.rlike("%(?![0-9A-Fa-f]{2})") & u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")


def host(url: Column) -> Column:
    """Host in lower case without user info and port; null if there is none."""
    authority = part(url, 2)
    name = F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))
    return F.when(name != "", name)


def site_host(seed: Column) -> Column:
    """The host a seed names, also when the scheme is missing from the seed."""
    bare = F.lower(F.regexp_extract(F.trim(seed), r"^(?:[^/?#:@]+@)?([^/?#:@]+\.[^/?#:@]+)", 1))
    return F.coalesce(host(seed), F.when(~F.trim(seed).rlike("^[A-Za-z][A-Za-z0-9+.-]*://") & (bare != ""), bare))


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case, the port only where it is written."""
    return F.lower(F.concat(part(url, 1), F.lit("://"), F.regexp_replace(part(url, 2), "^[^@]*@", "")))


def decode_unreserved(text: Column) -> Column:
    """Percent codes of letters, digits and ``-._~`` become the characters themselves."""
    pieces = F.split(text, "%", -1)
    decoded = F.transform(
        pieces,
        lambda p, i: F.when(i == 0, p)
        .when(p.rlike(_UNRESERVED_HEX), F.concat(F.char(F.conv(F.substring(p, 1, 2), 16, 10).cast("int")), F.substring(p, 3, 1_000_000)))
        .otherwise(F.concat(F.lit("%"), p)),
    )
    return F.when(F.instr(text, "%") > 0, F.array_join(decoded, "")).otherwise(text)


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986 removal of ``.`` and ``..`` segments from an absolute path."""
    parts = F.split(path, "/", -1)
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts,
        empty,
        lambda acc, x: F.when(x == ".", acc)
        .when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(acc))
        .otherwise(F.concat(acc, F.array(x))),
    )
    closed = F.array_join(kept, "/")
    closed = F.when(path.rlike(r"/\.\.?$"), F.concat(closed, F.lit("/"))).otherwise(closed)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), closed).otherwise(path)


def resolve_path(text: Column) -> Column:
    return remove_dot_segments(decode_unreserved(text))


def normalize_url(url: Column, strip_fragment: bool = True) -> Column:
    """RFC 3986 normal form: lower scheme and host, unreserved codes decoded, dot segments gone."""
    scheme, authority = F.lower(part(url, 1)), F.lower(part(url, 2))
    path, query, fragment = resolve_path(part(url, 3)), part(url, 4), part(url, 5)
    has_authority = F.trim(url).rlike("^([A-Za-z][A-Za-z0-9+.-]*:)?//")
    out = F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(has_authority, F.concat(F.lit("//"), authority)).otherwise(F.lit("")),
        path,
        F.when(F.trim(url).rlike(r"^[^#]*\?"), F.concat(F.lit("?"), decode_unreserved(query))).otherwise(F.lit("")),
    )
    if not strip_fragment:
        out = F.concat(out, F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))
    return out


def canonical_url(url: Column, tracking: tuple[str, ...] = TRACKING_PARAMS, prefixes: tuple[str, ...] = ("utm_",)) -> Column:
    """The spelling under which a page is one record, however its URL was written.

    Scheme and host in lower case, no fragment, no default port, no tracking
    parameters, unreserved percent codes decoded, dot segments resolved, an empty path
    becomes ``/``.  Order and values of the remaining parameters, a trailing slash and
    the scheme stay.  Null stays null; text without a scheme or host is only trimmed.
    """
    scheme = F.lower(part(url, 1))
    authority = F.lower(part(url, 2))
    authority = F.when(scheme == "http", F.regexp_replace(authority, ":(80)?$", "")).when(
        scheme == "https", F.regexp_replace(authority, ":(443)?$", "")
    ).otherwise(authority)
    path = resolve_path(part(url, 3))
    path = F.when(path == "", F.lit("/")).otherwise(path)
    name = lambda p: F.lower(decode_unreserved(F.split(p, "=", 2)[0]))
    drop = lambda p: name(p).isin(*tracking) | F.when(F.lit(bool(prefixes)), name(p).rlike("^(" + "|".join(prefixes) + ")")).otherwise(F.lit(False))
    raw = part(url, 4)
    query = F.when(raw != "", F.array_join(F.filter(F.split(raw, "&", -1), lambda p: ~drop(p)), "&")).otherwise(F.lit(""))
    whole = F.concat(
        scheme, F.lit("://"), authority, path,
        F.when(query != "", F.concat(F.lit("?"), decode_unreserved(query))).otherwise(F.lit("")),
    )
    return F.when(url.isNull(), F.lit(None)).when((scheme != "") & (authority != ""), whole).otherwise(F.trim(url))


def sitemap_key(url: Column) -> Column:
    """Fragment and trailing slashes removed: the key under which pages and sitemap entries meet."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def resolve(base: Column, ref: Column) -> Column:
    """The absolute URL of a reference (RFC 3986, section 5.2); null where either is no URL of allowed characters."""
    r = F.trim(ref)
    scheme, authority, path, query = part(r, 1), part(r, 2), part(r, 3), part(r, 4)
    b_path = part(base, 3)
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    question = F.when(r.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    tail = F.when(r.contains("#"), F.concat(F.lit("#"), part(r, 5))).otherwise(F.lit(""))
    folder = F.regexp_extract(b_path, "^(.*/)", 1)
    merged = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path)
    base_question = F.when(base.rlike(r"^[^#]*\?"), F.concat(F.lit("?"), part(base, 4))).otherwise(F.lit(""))
    out = (
        F.when(scheme != "", F.concat(scheme, F.lit(":"), F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(F.lit("")), remove_dot_segments(path), question))
        .when(r.startswith("//"), F.concat(part(base, 1), F.lit("://"), authority, remove_dot_segments(path), question))
        .when(path == "", F.concat(root, b_path, F.when(question != "", question).otherwise(base_question)))
        .when(path.startswith("/"), F.concat(root, remove_dot_segments(path), question))
        .otherwise(F.concat(root, remove_dot_segments(merged), question))
    )
    allowed = r.rlike(STRICT) & ~r.rlike("%(?![0-9A-Fa-f]{2})") & is_strict(base)
    return F.when(allowed, F.concat(out, tail))
