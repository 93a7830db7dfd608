from pyspark.sql import functions as F

from sitelens.functions.fingerprint import exact_hash, sim_hash, sim_hash_table
from sitelens.functions.robots import verdict
from sitelens.sources import redirects, robots, sitemap
from sitelens.sources.html import parse, parse_pages


def test_parser_resolves_against_base_and_document():
    doc = """<html lang=es><head><base href="https://other.test/es/"><title> A &amp; B </title><link rel="canonical" href="foo"><meta name=robots content="NOINDEX, max-snippet:20, max-image-preview:large">
    <meta property="og:title" content="0"><meta name="twitter:card" content="summary"><link rel=alternate hreflang="en-GB" href="/en"><link rel=preload as=font href="f.woff">
    <script type="application/ld+json">{"@graph":[{"@type":"A"},{"@type":["B","A"]}]}</script><script type="application/ld+json">{broken</script></head>
    <body itemscope><nav>menu</nav><h1>One <b>two</b></h1><h3>x</h3><a href="p#q" rel="ugc nofollow"> go </a><a href="p">again</a><a href="#top">t</a><a href="caf é">bad</a><a href="mailto:x">m</a>
    <img src="i.png" width="100%" height=20><img src="data:x"><picture><source srcset="a.webp 1x, b.webp 2x"></picture><video src=v.mp4 poster=p.jpg></video>text  here"""
    f = parse("https://x.example/", doc)
    assert f["title"] == "A & B" and f["canonical"] == "https://other.test/es/foo" and f["lang"] == "es" and f["og_title"] is None and f["twitter_card"] == "summary"
    assert f["noindex"] and not f["nofollow"] and f["max_snippet"] == 20 and f["max_image_preview"] == "large"
    assert f["json_ld_types"] == ["A", "B"] and f["has_microdata"] and f["h1s"] == ["One two"] and [h["level"] for h in f["heading_hierarchy"]] == [1, 3]
    anchors = [x for x in f["links"] if x["type"] == "anchor"]
    assert [(x["url"], x["rel"], x["internal"], x["anchor"]) for x in anchors] == [("https://other.test/es/p", "nofollow", False, "go")]
    image = next(x for x in f["links"] if x["url"].endswith("i.png"))
    assert image["width"] is None and image["height"] == 20 and image["anchor"] is None
    assert {x["type"] for x in f["links"]} == {"anchor", "image", "font", "video"}
    assert [(h["language"], h["region"], h["href"]) for h in f["hreflangs"]] == [("en", "GB", "https://other.test/en")]
    assert "menu" not in f["clean_text"] and f["clean_text"].endswith("text here")


def test_parser_takes_anything(spark):
    df = spark.createDataFrame([("https://x.example/1", None, 1), ("https://x.example/2", "", 1), ("https://x.example/3", "<title>x<p>" + "a " * 50000, 1), (None, "<p>", 1)], "url string, html string, links int")
    got = {r["url"][-1]: r for r in parse_pages(df).collect()}
    assert set(got) == {"1", "2", "3"} and got["1"]["title"] is None and got["1"]["links"] == []


ROBOTS = "User-agent: other\nDisallow: /\n\nUser-Agent: *  # all\nDisallow: /a\nAllow: /a/b*c$\nCrawl-delay: 1\nCrawl-Delay: 3\nDisallow:\nUser-agent: late\nDisallow: /late\nSitemap: https://x.example/m.xml\nsitemap: no url"


def docs(spark):
    return spark.createDataFrame([("x", "https://x.example", ROBOTS), ("y", "https://y.example", ""), ("z", "https://z.example", None)], "host string, origin string, body string")


def test_robots(spark):
    rules = sorted((r["kind"], r["pattern"]) for r in robots.robots_rules(docs(spark)).collect())
    assert rules == [("allow", "/a/b*c$"), ("disallow", "/a"), ("disallow", "/late")]
    strict = sorted((r["kind"], r["pattern"]) for r in robots.robots_rules(docs(spark), strict=True).collect())
    assert strict == [("allow", "/a/b*c$"), ("disallow", "/a")]
    assert [tuple(r) for r in robots.crawl_delay(docs(spark)).collect()] == [("x", 3.0)]
    assert sorted(tuple(r) for r in robots.sitemap_locations(docs(spark)).collect()) == [("x", "https://x.example/m.xml"), ("y", "https://y.example/sitemap.xml"), ("z", "https://z.example/sitemap.xml")]
    pages = spark.createDataFrame([("x", u) for u in ("https://x/", "https://x/a?q", "https://x/a/bzzc", "https://x/a/bzzcd", "https://x/later", "https://x")] + [("none", "https://n/a")], "host string, url string")
    got = {r["url"]: r["allowed"] for r in verdict(pages, robots.robots_rules(docs(spark))).collect()}
    assert got == {"https://x/": True, "https://x/a?q": False, "https://x/a/bzzc": True, "https://x/a/bzzcd": False, "https://x/later": False, "https://x": True, "https://n/a": True}
    status = spark.createDataFrame([("a", None, None), ("b", 503, "x"), ("c", 404, "x"), ("d", 200, ""), ("e", 200, "x")], "host string, status_code int, body string")
    assert [r["policy"] for r in robots.outcome(status).orderBy("host").collect()] == ["block", "block", "allow", "allow", "parse"]


def test_sitemaps(spark):
    loc = lambda *u: "".join(f"<url><loc> {x} </loc></url>" for x in u)
    files = [
        ("i", '<?xml version="1.0"?><sitemapindex xmlns="http://s"><sitemap><loc>f1</loc></sitemap><sitemap><loc>f2</loc></sitemap><sitemap><loc>i</loc></sitemap></sitemapindex>'),
        ("f1", f"<urlset>{loc('https://x.example/a?utm_source=1', 'https://x.example/a', 'no-scheme', '', 'https://x.example/é')}</urlset>"), ("f2", f"<urlset>{loc('https://o.test/b')}</urlset>"),
        ("bad", "<urlset><url>"), ("html", "<html><loc>https://x.example/z</loc></html>"), ("null", None),
    ]
    entries = spark.createDataFrame([("s", "i"), ("t", "bad"), ("t", "html"), ("t", "null"), ("t", "gone")], "site string, source string")
    got = sitemap.sitemap_urls(entries, spark.createDataFrame(files, "source string, body string")).collect()
    assert sorted(tuple(r) for r in got) == [("s", "https://o.test/b"), ("s", "https://x.example/a")]


def test_redirects(spark):
    hops = [("a", f"u{i}", f"u{i + 1}", 301) for i in range(12)] + [("a", "l1", "l2", 302), ("a", "l2", "l1", 302), ("a", "s", "l1", 307), ("b", "x", "y", 301)]
    got = {(r["audit_id"], r["start"]): (r["n_hops"], r["final"]) for r in redirects.redirect_chains(spark.createDataFrame(hops, "audit_id string, from_url string, to_url string, status_code int")).collect()}
    assert got == {("a", "u0"): (10, "u10"), ("a", "s"): (10, "l2"), ("b", "x"): (1, "y")}


def test_similarity_hash_equals_a_plain_model(spark):
    import zlib

    def model(t):
        sums = [0] * 32
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            sums = [s + (1 if h >> i & 1 else -1) for i, s in enumerate(sums)]
        low = sum(1 << i for i, s in enumerate(sums) if s > 0)
        return int.from_bytes((low << 32 | low).to_bytes(8, "big"), "big", signed=True)

    texts = ["a b c", "Grüne Äpfel und grüne Birnen", "x " * 5000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = [r[0] for r in df.orderBy("id").select(sim_hash(F.col("t"))).collect()]
    assert got == [model(t) if t is not None else None for t in texts]
    table = {r["id"]: r["sim_hash"] for r in sim_hash_table(df, "id", F.col("t")).collect()}
    assert table == {i: model(t) for i, t in enumerate(texts) if t}
    assert [r[0] is None for r in df.orderBy("id").select(exact_hash(F.col("t"))).collect()] == [False, False, False, True, True]


def test_the_package_is_shipped_to_the_workers(spark, sf):
    import zipfile

    from sitelens.session import ship, table

    table(spark, sf, "audits")
    ship(spark)
    archive = spark.sparkContext._sitelens_archive
    names = zipfile.ZipFile(archive.removeprefix("file://")).namelist()
    assert "sitelens/session.py" in names and all(n.endswith(".py") for n in names)


def test_intermediate_tables_are_deleted(spark):
    from sitelens.session import clear_scratch, materialize

    clear_scratch(spark)
    df = materialize(spark.range(3), "test")
    path = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 3 and __import__("os").path.isdir(path)
    assert clear_scratch(spark) == 1 and not __import__("os").path.isdir(path)
