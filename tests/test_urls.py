from urllib.parse import urljoin

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelens.functions import urls

# RFC 3986, section 6: scheme and host have no case, unreserved percent codes are letters, dot segments go.
CASES = {
    None: None,
    "no scheme at all ": "no scheme at all",
    "ftp://Depot.test": "ftp://depot.test/",
    "hTTp://wiki.TEST:80/Re%61d/../%7eMe": "http://wiki.test/~Me",
    "http://wiki.test:443/": "http://wiki.test:443/",
    "https://wiki.test:443?A=%5f&b=&&c#top?x=1": "https://wiki.test/?A=_&b=&&c",
    "https://wiki.test/x/./y/%2E%2e/z/": "https://wiki.test/x/z/",
    "https://wiki.test/%2f/%C3%A9": "https://wiki.test/%2f/%C3%A9",
}


def test_canonical_spellings(spark):
    df = spark.createDataFrame([(u,) for u in CASES], "u string")
    got = df.select("u", urls.canonical_url(F.col("u")).alias("k")).collect()
    assert {r["u"]: r["k"] for r in got} == CASES


def test_every_tracking_name_is_dropped_in_any_case_and_place(spark):
    names = [*urls.TRACKING_PARAMS, "utm_", "utm_term"]
    spelled = [n if i % 2 else n.upper() for i, n in enumerate(names)]
    queries = [(f"?{n}=1&k=v", "?k=v") for n in spelled] + [(f"?k=v&{n}", "?k=v") for n in spelled] + [(f"?{n}=a", "") for n in spelled]
    queries += [(f"?x{n}=1", f"?x{n}=1") for n in spelled]
    df = spark.createDataFrame([("http://depot.test/p" + a, "http://depot.test/p" + b) for a, b in queries], "u string, want string")
    for u, want, got in df.select("u", "want", urls.canonical_url(F.col("u"))).collect():
        assert got == want, u


def test_resolution_equals_the_standard_library(spark):
    bases = ["https://x.example/a/b/c?d=1", "https://x.example", "http://x.example/dir/"]
    refs = ["g", "./g", "../g", "../../g", "/g", "//other.test/z", "?y=2", "#s", "", "g;x=1?y#z", "https://o.test/b", "g/./h/../i"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for b, r, got in df.select("b", "r", urls.resolve(F.col("b"), F.col("r"))).collect():
        assert got == urljoin(b, r), (b, r)
    assert df.limit(1).select(urls.resolve(F.col("b"), F.lit("café"))).first()[0] is None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("ab./%2eE7", max_size=14), min_size=20, max_size=20))
def test_canonical_is_idempotent(spark, paths):
    df = spark.createDataFrame([("https://x.example/" + p,) for p in paths], "u string")
    once = df.select(urls.canonical_url(F.col("u")).alias("u"))
    got = [r[0] for r in once.collect()]
    assert not any("/./" in x or "/../" in x for x in got)
    assert [r[0] for r in once.select(urls.canonical_url(F.col("u"))).collect()] == got


def test_hosts(spark):
    df = spark.createDataFrame([("HTTP://User@Shop.Example:8080/x",), ("shop.example/x",), ("https://shop.example.evil/",), (None,), ("",)], "u string")
    assert [r[0] for r in df.select(urls.site_host(F.col("u"))).collect()] == ["shop.example", "shop.example", "shop.example.evil", None, None]
