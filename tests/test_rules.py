from datetime import datetime

import pytest

from sitelens.operators import site_rules
from sitelens.operators.page_rules import page_issues, page_rules

SCHEMA = (
    "id string, audit_id string, url string, status_code int, content_type string, body_size bigint, response_time double, final_url string, headers map<string,array<string>>, title string, "
    "meta_description string, h1s array<string>, h2s array<string>, heading_hierarchy array<struct<level:int,text:string>>, viewport string, lang string, og_title string, og_description string, "
    "og_image string, word_count int, noindex boolean, nofollow boolean, canonical string, redirect_chain array<struct<from_url:string,to_url:string,status_code:int>>, "
    "links array<struct<url:string,type:string,anchor:string,rel:string,internal:boolean,width:int,height:int>>, hreflangs array<struct<language:string,region:string,href:string,source:string>>, "
    "exact_hash string, sim_hash bigint, crawled_at timestamp, twitter_card string, twitter_title string, twitter_description string, twitter_image string, json_ld_types array<string>, has_microdata boolean"
)
NAMES = [x.strip().split(" ")[0] for x in __import__("re").split(r",\s(?![^<]*>)", SCHEMA)]
GOOD = dict(
    id="p", audit_id="a", url="https://x.example/a", status_code=200, content_type="text/html; charset=utf-8", body_size=28, response_time=100.0, final_url=None,
    headers={"Content-Security-Policy": ["x"], "x-frame-options": ["DENY"], "x-content-type-options": ["nosniff"], "referrer-policy": ["strict-origin"]},
    title="A title that is neither short nor long", meta_description="A description.", h1s=["H"], h2s=["h"], heading_hierarchy=[(1, "H"), (2, "h")], viewport="v", lang="en",
    og_title="t", og_description="d", og_image="i", word_count=200, noindex=False, nofollow=False, canonical="https://x.example/a#top", redirect_chain=[], links=[], hreflangs=[],
    exact_hash=None, sim_hash=None, crawled_at=datetime(2026, 1, 1), twitter_card="c", twitter_title="t", twitter_description="d", twitter_image="i", json_ld_types=["Thing"], has_microdata=False,
)
LINK = ("https://x.example/i", "image", "alt", "follow", False, 1, 1)


def pages(spark, *changes):
    return spark.createDataFrame([tuple({**GOOD, "id": f"p{i}", **c}[n] for n in NAMES) for i, c in enumerate(changes)], SCHEMA)


def hop(a, b, s=301):
    return (a, b, s)


HITS = {
    "client_error": dict(status_code=404), "server_error": dict(status_code=503), "redirect_chain": dict(redirect_chain=[hop("https://x.example/1", "https://x.example/2"), hop("https://x.example/2", "https://x.example/3")]),
    "redirect_loop": dict(redirect_chain=[hop("https://x.example/1", "https://x.example/1")]), "mixed_protocol_redirect": dict(redirect_chain=[hop("http://x.example/1", "https://x.example/1")]),
    "redirect_not_permanent": dict(redirect_chain=[hop("https://x.example/1", "https://x.example/2", 302)]), "internal_nofollow": dict(links=[("https://x.example/b", "anchor", "b", "nofollow", True, None, None)]),
    "title_missing": dict(title=" \t"), "title_too_long": dict(title="x" * 61), "title_too_short": dict(title="short"), "meta_description_missing": dict(meta_description=None),
    "meta_description_too_long": dict(meta_description="x" * 161), "h1_missing": dict(h1s=[]), "h1_multiple": dict(h1s=["a", "b"]), "viewport_missing": dict(viewport=""), "html_lang_missing": dict(lang=None),
    "noindex": dict(noindex=True), "nofollow": dict(nofollow=True), "canonical_missing": dict(canonical=None), "canonical_non_self": dict(canonical="https://x.example/b"),
    "noindex_with_canonical": dict(noindex=True), "h2_missing": dict(h2s=None), "h1_not_first": dict(heading_hierarchy=[(2, "a"), (1, "b")]), "heading_skip": dict(heading_hierarchy=[(1, "a"), (3, "b")]),
    "content_empty": dict(word_count=50), "content_thin": dict(word_count=79), "img_alt_missing": dict(links=[LINK[:2] + (" ",) + LINK[3:]]), "img_alt_too_long": dict(links=[LINK[:2] + ("x" * 126,) + LINK[3:]] * 2),
    "image_missing_dimensions": dict(links=[LINK[:5] + (None, 1)]), "response_very_slow": dict(response_time=3000.0), "response_slow": dict(response_time=2999.9), "page_too_large": dict(body_size=524289),
    "csp_missing": dict(headers={}), "x_frame_missing": dict(headers=None), "x_content_type_missing": dict(headers={"x-content-type-options": [" "]}), "referrer_policy_missing": dict(headers={}),
    "referrer_policy_insecure": dict(headers={"referrer-policy": ["same-origin"]}), "http_insecure": dict(final_url="http://x.example/a"), "mixed_content": dict(links=[("http://x.example/s.js", "script", None, "follow", True, None, None)]),
    "open_graph_incomplete": dict(og_image=" "), "twitter_card_incomplete": dict(twitter_card=None), "schema_org_missing": dict(json_ld_types=[]),
    "hreflang_invalid_language": dict(hreflangs=[("xx", None, "https://x.example/a", "html"), ("x-default", None, "https://x.example/a", "html")]),
    "hreflang_invalid_region": dict(hreflangs=[("zh", "Hant", "https://x.example/a", "html")]), "hreflang_missing_self": dict(hreflangs=[("de", None, "https://x.example/b", "html")]),
    "hreflang_duplicate": dict(hreflangs=[("de", None, "https://x.example/a", "html"), ("de", None, "https://x.example/b", "html")]),
}


def test_every_page_rule_has_a_case(spark):
    assert set(HITS) == set(page_rules(NAMES))


def test_each_rule_fires_on_its_case_and_not_on_a_good_page(spark):
    codes = list(HITS)
    found = page_issues(pages(spark, {}, *HITS.values())).collect()
    by = {}
    for r in found:
        by.setdefault(r["page_id"], []).append(r["code"])
    assert "p0" not in by
    for i, code in enumerate(codes, 1):
        assert code in by[f"p{i}"], code
    assert by[f"p{codes.index('img_alt_too_long') + 1}"].count("img_alt_too_long") == 2


def test_guards_and_nulls(spark):
    binary = dict(content_type="application/pdf", title=None, word_count=0, headers=None, canonical=None, links=None, hreflangs=None, redirect_chain=None, h1s=None, heading_hierarchy=None)
    nulls = {n: None for n in NAMES if n not in ("id", "audit_id")}
    empty = dict(title=None, word_count=0)
    got = page_issues(pages(spark, binary, nulls)).collect()
    assert got == []
    assert {r["code"] for r in page_issues(pages(spark, empty)).collect()} == {"title_missing", "content_empty"}
    assert page_issues(pages(spark, empty), compat="stored").collect() == []
    assert page_issues(pages(spark)).count() == 0


def test_site_rules(spark):
    t = lambda d: datetime(2026, 1, d)
    alt = lambda lang, to: [(lang, None, to, "html")]
    p = pages(
        spark,
        dict(url="https://x.example/a", canonical="https://x.example/b", hreflangs=alt("de", "https://x.example/b"), exact_hash="h", sim_hash=0),
        dict(url="https://x.example/b", canonical=None, status_code=404, hreflangs=alt("en", "https://x.example/c"), exact_hash="h", sim_hash=0),
        dict(url="https://x.example/c", canonical=None, hreflangs=alt("x-default", "https://x.example/a"), exact_hash="k", sim_hash=(1 << 32) | 1),
        dict(url="https://x.example/archive/d", canonical=None, crawled_at=t(2), exact_hash="m", sim_hash=(0xFF << 32) | 0xFF),
    )
    ids = lambda df: sorted(r["page_id"] for r in df.collect())
    assert ids(site_rules.hreflang_no_return(p)) == ["p0", "p1"]
    assert [tuple(r) for r in site_rules.canonical_broken_target(p).collect()] == [("a", "p0", "status")]
    assert ids(site_rules.exact_duplicates(p)) == ["p0"]
    assert sorted((r["page_id"], r["n_near"]) for r in site_rules.near_duplicates(p).collect()) == [("p0", 1), ("p2", 2)]
    sm = spark.createDataFrame([("a", "https://x.example/c/"), ("a", "https://x.example/gone#x")], "audit_id string, url string")
    assert ids(site_rules.sitemap_missing(p, sm)) == ["p3"]
    assert [r["url"] for r in site_rules.sitemap_orphans(p, sm).collect()] == ["https://x.example/gone#x"]
    rules = spark.createDataFrame([("x.example", "disallow", "/archive/")], "host string, kind string, pattern string")
    assert ids(site_rules.robots_blocks_indexable(p, rules)) == ["p3"]
    assert site_rules.sitemap_missing(p, sm.limit(0)).count() == 0
    none = pages(spark)
    for f in (site_rules.hreflang_no_return, site_rules.canonical_broken_target, site_rules.exact_duplicates, site_rules.near_duplicates):
        assert f(none).count() == 0


@pytest.mark.parametrize("n", [3, 5])
def test_bands_find_all_close_hashes(spark, n):
    import random

    from pyspark.sql import functions as F

    from sitelens.functions.fingerprint import bands

    r = random.Random(n)
    low = [r.getrandbits(32) for _ in range(40)]
    low += [x ^ (1 << r.randrange(32)) for x in low] + [x ^ (1 << r.randrange(32)) ^ (1 << r.randrange(32)) for x in low]
    rows = [(i, int.from_bytes(((x << 32) | x).to_bytes(8, "big"), "big", signed=True)) for i, x in enumerate(low)]
    df = spark.createDataFrame(rows, "i int, h bigint").withColumn("b", F.explode(bands(F.col("h"), n // 2 + 1)))
    a, b = df.alias("a"), df.alias("b")
    got = {tuple(x) for x in a.join(b, F.col("a.b") == F.col("b.b")).where("a.i < b.i and bit_count(a.h ^ b.h) <= " + str(n)).select("a.i", "b.i").collect()}
    want = {(i, j) for i in range(len(low)) for j in range(i + 1, len(low)) if 2 * bin(low[i] ^ low[j]).count("1") <= n}
    assert got == want
