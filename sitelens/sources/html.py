"""HTML documents to page facts: one pass of the standard library's parser per document."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame

LINK = "struct<url string, type string, anchor string, rel string, internal boolean, width int, height int>"
SCHEMA = (
    "url string, title string, meta_description string, h1s array<string>, h2s array<string>, heading_hierarchy array<struct<level int, text string>>, "
    "charset string, viewport string, lang string, og_title string, og_description string, og_image string, twitter_card string, twitter_title string, "
    "twitter_description string, twitter_image string, word_count int, noindex boolean, nofollow boolean, noarchive boolean, nosnippet boolean, noimageindex boolean, "
    "max_snippet int, max_image_preview string, max_video_preview int, canonical string, json_ld_types array<string>, has_microdata boolean, "
    f"links array<{LINK}>, hreflangs array<struct<language string, region string, href string, source string>>, clean_text string"
)
#: Elements whose text is page furniture, and elements without an end tag (fixed values of the markup language).
_FURNITURE = frozenset("script style nav header footer aside noscript iframe".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_PRELOAD = {"script": "script", "style": "stylesheet", "image": "image", "font": "font", "video": "video", "audio": "audio"}
_ALLOWED = re.compile(r"^[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]*$")
_BAD_CODE = re.compile(r"%(?![0-9A-Fa-f]{2})")


def strict_url(text: str | None, base: str) -> str | None:
    """The absolute URL of a reference, or null if its characters or percent codes are not allowed."""
    text = (text or "").strip()
    if not _ALLOWED.match(text) or _BAD_CODE.search(text):
        return None
    try:
        out = urljoin(base, text)
        return out if urlsplit(out).scheme else None
    except ValueError:
        return None


def _origin(url: str) -> tuple[str, str, int | None]:
    s = urlsplit(url)
    try:
        return s.scheme.lower(), (s.hostname or "").lower(), s.port
    except ValueError:
        return s.scheme.lower(), (s.hostname or "").lower(), None


def _text(value: str | None) -> str | None:
    """Trimmed text; empty text and "0" count as none."""
    value = (value or "").strip()
    return None if value in ("", "0") else value


class _Document(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.open: list[tuple[str, list[str], object]] = []
        self.title: str | None = None
        self.meta: dict[str, str] = {}
        self.http_equiv: dict[str, str] = {}
        self.charset: str | None = None
        self.lang: str | None = None
        self.base: str | None = None
        self.canonical: str | None = None
        self.headings: list[tuple[int, str]] = []
        self.raw_links: list[dict] = []
        self.alternates: list[tuple[str, str]] = []
        self.json_ld: list[str] = []
        self.microdata = False
        self.in_body = False
        self.body: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        self.microdata = self.microdata or "itemscope" in a
        if tag not in _VOID:
            self.stack.append(tag)
        if tag == "html" and self.lang is None:
            self.lang = a.get("lang")
        elif tag == "body":
            self.in_body = True
        elif tag == "base" and self.base is None and "href" in a:
            self.base = a["href"]
        elif tag == "meta":
            for key in ("name", "property"):
                if key in a and "content" in a:
                    self.meta.setdefault(a[key].lower(), a["content"])
            if "charset" in a and self.charset is None:
                self.charset = a["charset"]
            if "http-equiv" in a:
                self.http_equiv.setdefault(a["http-equiv"].lower(), a.get("content", ""))
        elif tag == "link":
            self._link_element(a)
        elif tag in ("title", "a", "h1", "h2", "h3", "h4", "h5", "h6") or (tag == "script" and a.get("type", "").lower() == "application/ld+json"):
            self.open.append((tag, [], a))
        if tag == "img" and a.get("src") and not a["src"].startswith("data:"):
            self._add(a["src"], "image", a.get("alt"), a)
        if tag == "script" and a.get("src"):
            self._add(a["src"], "script")
        if tag == "iframe" and a.get("src") and not a["src"].startswith("about:"):
            self._add(a["src"], "iframe")
        if tag in ("img", "source") and a.get("srcset"):
            for one in a["srcset"].split(","):
                if one.split():
                    self._add(one.split()[0], "image")
        if tag in ("video", "audio"):
            if a.get("src"):
                self._add(a["src"], tag)
            if tag == "video" and a.get("poster"):
                self._add(a["poster"], "image")
        if tag == "source" and a.get("src"):
            parent = next((t for t in reversed(self.stack) if t in ("video", "audio", "picture")), None)
            if parent:
                self._add(a["src"], "image" if parent == "picture" else parent)

    def _link_element(self, a: dict[str, str]) -> None:
        rels, href = a.get("rel", "").lower().split(), a.get("href", "")
        if not href.strip():
            return
        if a.get("rel") == "canonical" and self.canonical is None:
            self.canonical = href
        if "stylesheet" in rels:
            self._add(href, "stylesheet")
        if "preload" in rels:
            self._add(href, _PRELOAD.get(a.get("as", "").lower(), "preload"))
        if "modulepreload" in rels:
            self._add(href, "modulepreload")
        if "prefetch" in rels:
            self._add(href, "prefetch")
        if "alternate" in rels and a.get("hreflang", "").strip():
            self.alternates.append((a["hreflang"].strip(), href))

    def _add(self, href: str, kind: str, anchor: str | None = None, a: dict[str, str] | None = None, rel: str = "follow") -> None:
        size = lambda k: int(a[k]) if a and re.fullmatch(r"[1-9]\d{0,8}", a.get(k, "").strip()) else None
        self.raw_links.append({"href": href, "type": kind, "anchor": anchor, "rel": rel, "width": size("width"), "height": size("height")})

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                name, parts, a = self.open.pop(i)
                self._close(name, "".join(parts), a)
                break

    def _close(self, tag: str, text: str, a: dict[str, str]) -> None:
        if tag == "title":
            self.title = text if self.title is None else self.title
        elif tag == "script":
            self.json_ld.append(text)
        elif tag == "a":
            href = a.get("href", "")
            if href and not href.startswith(("#", "javascript:", "mailto:")):
                rels = a.get("rel", "").lower().split()
                rel = next((r for r in ("nofollow", "sponsored", "ugc") if r in rels), "follow")
                self._add(urldefrag(href.strip())[0], "anchor", text.strip() or None, rel=rel)
        else:
            self.headings.append((int(tag[1]), text.strip()))

    def handle_data(self, data: str) -> None:
        for _, parts, _ in self.open:
            parts.append(data)
        if self.in_body and not _FURNITURE.intersection(self.stack):
            self.body.append(data)

    def finish(self) -> None:
        self.close()
        while self.open:
            tag, parts, a = self.open.pop()
            self._close(tag, "".join(parts), a)


def _types(value: object) -> Iterator[str]:
    if isinstance(value, list):
        for v in value:
            yield from _types(v)
    elif isinstance(value, dict):
        t = value.get("@type")
        yield from ([t] if isinstance(t, str) else [x for x in t if isinstance(x, str)] if isinstance(t, list) else [])
        for k, v in value.items():
            if k != "@type":
                yield from _types(v)


def robots_flags(text: str | None) -> dict:
    t = (text or "").lower()
    number = lambda k: int(m.group(1)) if (m := re.search(k + r":\s*(\d+)", t)) else None
    preview = re.search(r"max-image-preview:\s*(\S+)", t)
    return {k: k in t for k in ("noindex", "nofollow", "noarchive", "nosnippet", "noimageindex")} | {
        "max_snippet": number("max-snippet"), "max_video_preview": number("max-video-preview"), "max_image_preview": preview.group(1).rstrip(",") if preview else None,
    }


def parse(url: str, html: str | None) -> dict:
    """Facts of one document; a null document gives empty facts, malformed markup what can be read of it."""
    doc = _Document()
    doc.feed(html or "")
    doc.finish()
    base = (strict_url(doc.base, url) if doc.base else None) or url
    links, seen = [], set()
    for x in doc.raw_links:
        target = strict_url(x.pop("href"), base)
        if target and (target, x["type"]) not in seen:
            seen.add((target, x["type"]))
            links.append({"url": target, **x, "internal": _origin(target) == _origin(url)})
    alternates = []
    for code, href in doc.alternates:
        target = strict_url(href, base)
        if target:
            language, _, region = (code, "", "") if code.lower() == "x-default" else code.partition("-")
            alternates.append({"language": language, "region": region or None, "href": target, "source": "html"})
    ld: list[str] = []
    for block in doc.json_ld:
        try:
            ld += _types(json.loads(block))
        except ValueError:
            continue
    charset = doc.charset
    if charset is None and (m := re.search(r"charset=([\w-]+)", doc.http_equiv.get("content-type", ""), re.I)):
        charset = m.group(1)
    clean = re.sub(r"\s+", " ", "".join(doc.body)).strip()
    get = lambda k: _text(doc.meta.get(k))
    return {
        "url": url, "title": _text(doc.title), "meta_description": get("description"), "h1s": [t for n, t in doc.headings if n == 1],
        "h2s": [t for n, t in doc.headings if n == 2], "heading_hierarchy": [{"level": n, "text": t} for n, t in doc.headings], "charset": charset,
        "viewport": get("viewport"), "lang": doc.lang, "og_title": get("og:title"), "og_description": get("og:description"), "og_image": get("og:image"),
        "twitter_card": get("twitter:card"), "twitter_title": get("twitter:title"), "twitter_description": get("twitter:description"), "twitter_image": get("twitter:image"),
        "word_count": len(clean.split()), **robots_flags(doc.meta.get("robots", doc.meta.get("googlebot"))),
        "canonical": strict_url(doc.canonical, base) if doc.canonical else None, "json_ld_types": list(dict.fromkeys(ld)), "has_microdata": doc.microdata,
        "links": links, "hreflangs": alternates, "clean_text": clean,
    }


_COLUMNS = [x.strip().split(" ")[0] for x in re.split(r",\s(?![^<]*>)", SCHEMA)]


def _parse_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for t in batches:
        yield pd.DataFrame([parse(u, h) for u, h in zip(t["url"], t["html"])], columns=_COLUMNS)


def parse_pages(documents: DataFrame) -> DataFrame:
    """Page facts of (url, html) documents; see ``SCHEMA``."""
    return documents.select("url", "html").where("url is not null").mapInPandas(_parse_all, SCHEMA)
