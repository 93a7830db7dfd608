import random

from pyspark.sql import functions as F

from sitelens.llm import log_sketch as ls

Q = {"lo": 0.0, "mid": 0.5, "p99": 0.99, "hi": 1.0}


def test_error_is_bounded_and_merging_changes_nothing(spark):
    r = random.Random(7)
    rows = [(g, r.choice([-1, 1]) * 10 ** r.uniform(-9, 12), i % 3) for g in ("a", "b") for i in range(800)]
    rows += [("z", 0.0, 0), ("z", -0.0, 1), ("t", 5.0, 2)] * 5 + [("n", None, 0), ("n", float("nan"), 0), ("n", float("inf"), 0), (None, 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, v double, n int")  # n clashes with the count
    whole = ls.sketch(df, ["g"], F.col("v"))
    parts = [ls.sketch(df.where(f"n = {i}"), ["g"], F.col("v")) for i in range(3)]
    merged = ls.merge(["g"], *parts)
    assert sorted(map(str, whole.collect())) == sorted(map(str, merged.select(whole.columns).collect()))
    got = {x["g"]: x for x in ls.percentiles(merged, ["g"], Q).collect()}
    assert "n" not in got
    for g in ("a", "b", "z", "t", None):
        vs = sorted(v for k, v, _ in rows if k == g)
        assert got[g]["n"] == len(vs)
        for name, q in Q.items():
            true = vs[int(q * (len(vs) - 1))]
            assert abs(got[g][name] - true) <= 0.0100001 * abs(true)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert ls.percentiles(ls.sketch(df, ["g"], F.col("v")), ["g"], Q).count() == 0


def test_repeated_pages_count_once(spark):
    from datetime import datetime

    t = datetime(2026, 1, 1)
    df = spark.createDataFrame([("1", "a", 5.0, 10, t), ("1", "a", 5.0, 10, t), ("2", "a", None, None, None)], "id string, audit_id string, response_time double, body_size bigint, crawled_at timestamp")
    m = ls.page_measures(df)
    got = {r["metric"]: r["n"] for r in ls.percentiles(ls.sketch(m, ["audit_id", "metric"], m["value"]), ["audit_id", "metric"], Q).collect()}
    assert got == {"response_time": 1, "body_size": 1}
