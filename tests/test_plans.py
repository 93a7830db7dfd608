import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitelens.api import Audits, UnknownAudit
from sitelens.operators import frontier
from sitelens.operators.matching import compare, nearest
from sitelens.plans import page_queries, report_queries
from sitelens.plans.diff_queries import previous_audits
from sitelens.sinks import tables
from sitelens.streaming import live

T0 = datetime(2026, 1, 1)


def score(spark, n_pages, issues):
    pages = spark.createDataFrame([(f"p{i}", "a") for i in range(n_pages)], "id string, audit_id string")
    rows = spark.createDataFrame(issues, "page_id string, code string")
    catalog = spark.createDataFrame([("title_missing", 10), ("content_thin", 2), ("e1", 10), ("e2", 10), ("e3", 10), ("e4", 10)], "code string, weight int")
    m = report_queries.scores(pages, rows, catalog).groupBy("audit_id").agg(F.round(F.avg("score")).cast("int").alias("s")).first()
    return m["s"]


def test_site_scores(spark):
    assert score(spark, 3, []) == 100
    assert score(spark, 1, [("p0", "title_missing")]) == 67
    assert score(spark, 10, [("p0", "title_missing")]) == 97
    assert score(spark, 1, [("p0", c) for c in ("title_missing", "e1", "e2", "e3", "e4")]) == 0
    assert score(spark, 2, [("p0", "content_thin")]) == 97
    assert score(spark, 1, [("p0", "unknown")]) == 100


def greedy(base, target, limit):
    """base, target: lists of (url, low bits) in crawl order."""
    left, out = dict(base), []
    for url, bits in target:
        best = min(((2 * bin(bits ^ b).count("1"), i, u) for i, (u, b) in enumerate(base) if u in left), default=None)
        if best and best[0] <= limit:
            out.append((url, best[2]))
            del left[best[2]]
    return sorted(out)


def test_moved_pages_equal_the_one_after_the_other_choice(spark):
    r = random.Random(9)
    roots = [r.getrandbits(32) for _ in range(3)]
    near = lambda: r.choice(roots) ^ sum(1 << i for i in r.sample(range(32), r.choice([0, 0, 0, 1, 3])))
    base = [(f"b{i}", near()) for i in range(16)]
    target = [(f"t{i}", near()) for i in range(16)]

    def frame(rows):
        wide = lambda x: int.from_bytes((x << 32 | x).to_bytes(8, "big"), "big", signed=True)
        df = spark.createDataFrame([("p", u, T0 + timedelta(seconds=i), f"{i:05}", wide(b), []) for i, (u, b) in enumerate(rows)], "pair string, url string, at timestamp, id string, sim_hash long, codes array<string>")
        return df.select("pair", "url", F.struct(F.col("at").alias("crawled_at"), "id").alias("seq"), "sim_hash", "codes")

    got = sorted((x["target_url"], x["base_url"]) for x in nearest(frame(base), frame(target)).collect())
    assert got == greedy(base, target, 5)
    assert sorted((x["target_url"], x["base_url"]) for x in nearest(frame(base[:9]), frame(target[:9]), group_rows=0).collect()) == greedy(base[:9], target[:9], 5)
    assert nearest(frame([]), frame(target)).count() == 0
    # A thousand pages of one content on both sides: alone, and with a neighbour that asks early.
    base, target = [(f"b{i:04}", roots[0]) for i in range(1000)], [(f"t{i:04}", roots[0]) for i in range(1005)]
    got = {x["target_url"]: x["base_url"] for x in nearest(frame(base), frame(target)).collect()}
    assert got == {f"t{i:04}": f"b{i:04}" for i in range(1000)}
    base, target = [(f"b{i:04}", roots[0]) for i in range(1000)], [("n", roots[0] ^ 3)] + [(f"t{i:04}", roots[0]) for i in range(1005)]
    got = {x["target_url"]: x["base_url"] for x in nearest(frame(base), frame(target)).collect()}
    assert got == {"n": "b0000", **{f"t{i:04}": f"b{i + 1:04}" for i in range(999)}}


def test_compare_is_disjoint_and_covers(spark):
    rows = [("old", "1", "u", 0, ["title_missing", "h1_multiple", "h1_multiple"]), ("new", "2", "u", 0, ["title_missing", "thin"]), ("old", "3", "gone", None, ["x", "x"]),
            ("new", "4", "fresh", None, ["y", "y"]), ("old", "5", "was", 5, ["m"]), ("new", "6", "is", 5, ["m"])]
    pages = spark.createDataFrame([(a, i, u, T0, h, c) for a, i, u, h, c in rows], "audit_id string, id string, url string, crawled_at timestamp, sim_hash long, codes array<string>")
    got = {r["url"]: r for r in compare(pages, spark.createDataFrame([("new", "old")], "pair string, earlier string")).collect()}
    assert {u: r["kind"] for u, r in got.items()} == {"u": "unchanged_url", "gone": "removed", "fresh": "added", "is": "moved"}
    assert (got["u"]["added"], got["u"]["removed"], got["u"]["persistent"]) == (["thin"], ["h1_multiple"], ["title_missing"])
    assert got["gone"]["removed"] == ["x", "x"] and got["fresh"]["added"] == ["y", "y"] and got["is"]["moved_from"] == "was"


def test_previous_audit(spark):
    rows = [("a", "https://x.example/", "completed", 1), ("b", "http://x.example/de", "completed", 3), ("c", "https://x.example.evil/", "completed", 2), ("d", "https://y.example/", "completed", 9), ("e", "https://x.example/", "running", None)]
    df = spark.createDataFrame([(i, u, s, T0 + timedelta(days=n) if n else None) for i, u, s, n in rows], "id string, seed_url string, status string, completed_at timestamp")
    assert {r["id"]: r["previous_id"] for r in previous_audits(df).collect()} == {"a": "b", "b": "c", "e": "b"}


def test_frontier(spark):
    spellings = ["https://x.example/a", "HTTPS://X.example/a#t", "https://x.example:443/a", "https://x.example/a?utm_source=q", "https://x.example/./a"]
    nothing = F.struct(F.lit(1).alias("phase"), F.lit(None).cast("timestamp").alias("at"), F.col("url").alias("id"), F.lit(0).alias("pos"))
    df = spark.createDataFrame([("a", u, i, "sitemap") for i, u in enumerate(spellings)] + [("a", None, 0, "sitemap")], "audit_id string, url string, depth int, source string").withColumn("seq", nothing)
    audits = spark.createDataFrame([("a", spellings[0], 2)], "id string, seed_url string, max_depth int")
    got = frontier.build(frontier.seeds(audits), df).collect()
    assert [(r["key"], r["source"]) for r in got] == [("https://x.example/a", "seed")]
    seen = spark.createDataFrame([("a", "https://x.example/a")], "audit_id string, key string")
    assert frontier.batch(frontier.build(df), seen, 5).count() == 0


def test_sorting_and_paging(spark):
    df = spark.createDataFrame([("a", 3.0, T0), ("b", None, T0), ("c", 3.0, T0 + timedelta(1)), ("d", 1.0, T0)], "id string, response_time double, crawled_at timestamp")
    ids = lambda *a, **k: [r["id"] for r in page_queries.sorted_pages(df, *a, **k).collect()]
    assert ids("responseTime") == ["b", "d", "a", "c"] and ids("responseTime", "desc") == ["a", "c", "d", "b"]
    assert ids("nonsense", "sideways") == ["a", "b", "d", "c"] and ids("responseTime", limit=2, offset=1) == ["d", "a"] and ids("responseTime", offset=3) == ["b", "d", "a", "c"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("1", "t", 200), ("2", "u", 200)], "id string, title string, status_code int")
    new = spark.createDataFrame([("1", "changed", 404), ("3", "v", 500)], "id string, title string, status_code int")
    assert sorted(tuple(r) for r in tables.upsert(old, new).collect()) == [("1", "t", 404), ("2", "u", 200), ("3", "v", 500)]
    rows = spark.createDataFrame([("a", None), ("a", None), ("b", "x"), ("c", "y")], "k string, l string")
    have = spark.createDataFrame([("b", "x")], "k string, l string")
    assert sorted(map(str, (r["k"] for r in tables.insert_or_ignore(have, rows, ["k", "l"]).collect()))) == ["a", "c"]
    path = str(tmp_path / "t")
    tables.replace_audits(spark.createDataFrame([("a", 1), ("b", 1)], "audit_id string, n int"), path)
    tables.replace_audits(spark.createDataFrame([("b", 2)], "audit_id string, n int"), path)
    assert sorted((r["audit_id"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 2)]


def test_writes_of_issues_and_audits(spark, tmp_path):
    pages = spark.createDataFrame([("p", "a", 1, None), ("q", "b", 0, 2)], "id string, audit_id string, error_count int, warning_count int")
    issues = spark.createDataFrame([("1", "p", "error", "c", None), ("2", "q", "warning", "d", "v")], "id string, page_id string, severity string, code string, catalog_version string")
    fresh = spark.createDataFrame([("3", "p", "error", "x", None), ("4", "p", "warning", "y", None)], issues.schema)
    assert sorted(map(tuple, tables.append_issues(pages, fresh).collect())) == [("p", "a", 2, 1), ("q", "b", 0, 2)]
    assert sorted((r["id"], r["catalog_version"]) for r in tables.replace_page_issues(issues, pages.where("id = 'p'"), fresh).collect()) == [("2", "v"), ("3", tables.CATALOG_VERSION), ("4", tables.CATALOG_VERSION)]
    audits = spark.createDataFrame([("a", "completed", T0), ("b", "running", None)], "id string, status string, completed_at timestamp")
    other = spark.createDataFrame([("a", 1), (None, 2)], "audit_id string, n int")
    left = tables.without_audits({"audits": audits, "pages": pages, "issues": issues, "site_issues": other, "external_url_checks": other}, audits.where("id = 'a'"))
    assert {k: v.count() for k, v in left.items()} == {"audits": 1, "pages": 1, "issues": 1, "site_issues": 1, "external_url_checks": 1}
    assert [r["id"] for r in tables.new_ids(pages, pages.where("id = 'p'")).collect()] == ["q"]
    for _ in range(2):
        tables.snapshot(pages.groupBy("audit_id").count(), audits, str(tmp_path / "s"))
    assert [(r["audit_id"], r["overview"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()] == [("a", '{"count":1}')]


def test_streams(spark, tmp_path):
    schema = "id string, audit_id string, status_code int, crawled_at timestamp, sim_hash long"
    path = str(tmp_path / "in")
    def day(n):
        return T0 + timedelta(days=n)

    for n, rows in enumerate([[("1", "a", 200, day(0), 0), ("2", "a", 500, day(1), (15 << 40) | (15 << 8))], [("1", "a", 200, day(0), 0), ("3", "a", 200, day(2), (1 << 32) | 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    stream = live.arriving(spark, path, spark.read.parquet(path).schema)
    view, watch = live.Live(spark, size=2), live.DuplicateWatch(spark)
    live.run_available(stream, view.merge)
    assert sorted(r["id"] for r in view.rows().collect()) == ["2", "3"]
    live.run_available(live.once(stream), watch.check)
    assert [tuple(r) for r in watch.marks().collect()] == [("a", "3", False)]
    root, check = str(tmp_path / "view"), str(tmp_path / "view-checkpoint")
    for _ in range(2):  # started again, the view goes on; a batch that is repeated changes nothing
        again = live.Live(spark, size=2, root=root)
        live.run_available(stream, again.merge, check)
    again.merge(spark.read.parquet(path).where("id = '3'"), 1)
    assert sorted(r["id"] for r in live.Live(spark, root=root).rows().collect()) == ["2", "3"]
    hashed = lambda *rows: spark.createDataFrame([(i, "a", day(n), None, x) for i, n, x in rows], "id string, audit_id string, crawled_at timestamp, sim_hash long, exact_hash string")
    watch = live.DuplicateWatch(spark)
    watch.check(hashed(("1", 0, "h"), ("2", 1, None)), 0)
    for _ in range(2):
        watch.check(hashed(("3", 2, "h"), ("4", 3, None)), 1)
    assert [tuple(r) for r in watch.marks().collect()] == [("a", "3", True)]
    seen = []
    check = str(tmp_path / "cp")
    live.run_available(stream, lambda b, _: seen.append(b.count()), check)
    live.run_available(stream, lambda b, _: seen.append(b.count()), check)
    assert sum(seen) == 4  # nothing is read again from the checkpoint


def test_facade(spark, sf):
    a = Audits(spark, sf)
    audit = a.pages  # noqa: F841
    first = a.history(1).first()["id"]
    assert a.status(first).count() == 1 and 0 <= a.score(first) <= 100 and a.overview(first).count() <= 1
    assert a.report(first).count() > 0 or a.issues(first).count() >= 0
    with pytest.raises(UnknownAudit):
        a.pages("none")


def test_entry_and_names(spark):
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) > 120
    assert entry.entry(spark).columns == ["audit_id", "page_id", "change"]
