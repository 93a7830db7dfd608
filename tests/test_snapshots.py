import random
from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from sitelens.operators import snapshots as S
from sitelens.plans.site_history import page_changes


def test_item_hash_is_sparks(spark):
    xs = [(1, 2), (-5, 7), (2**62, -(2**61)), (0, 0)]
    df = spark.createDataFrame(xs, "rec long, digest long")
    want = [r[0] for r in df.select(F.xxhash64("rec", "digest", F.lit(3).cast("long"))).collect()]
    rec, dig = (np.array([x[i] for x in xs], dtype=np.int64).view(np.uint64) for i in (0, 1))
    assert S.item_hash(rec, dig, 3).view(np.int64).tolist() == want


def records(spark, snaps):
    rows = [(s, k, d, f"{s}-{k}", 1) for s, recs in snaps.items() for k, d in recs.items()]
    return spark.createDataFrame(rows, "snapshot string, rec long, digest long, label string, pair int").drop("pair")


def brute(old, new, a, b):
    out = [(b, f"{b}-{k}", "added") for k in new.keys() - old.keys()] + [(b, f"{a}-{k}", "removed") for k in old.keys() - new.keys()]
    return sorted(out + [(b, f"{b}-{k}", "changed") for k in old.keys() & new.keys() if old[k] != new[k]])


def test_changes_equal_brute_force(spark):
    r = random.Random(4)
    keys = [r.getrandbits(62) for _ in range(3000)]
    s1 = {k: r.getrandbits(60) for k in keys}
    s2 = {k: (v if r.random() < 0.9 else v + 1) for k, v in s1.items() if r.random() < 0.9} | {r.getrandbits(62): 5 for _ in range(400)}
    s3 = {r.getrandbits(62): 1 for _ in range(2500)}  # nothing in common: buckets have to be enlarged
    s4 = dict(s3)  # equal
    df = records(spark, {"s1": s1, "s2": s2, "s3": s3, "s4": s4, "alone": {1: 1}})
    pairs = spark.createDataFrame([("s2", "s1"), ("s3", "s2"), ("s4", "s3")], "pair string, earlier string")
    want = sorted(brute(s1, s2, "s1", "s2") + brute(s2, s3, "s2", "s3"))
    assert sorted(map(tuple, S.snapshot_changes(df, pairs).collect())) == want
    assert sorted(map(tuple, S.snapshot_changes(df, pairs, rounds=0).collect())) == want  # the exact way alone
    assert sorted(map(tuple, S.snapshot_changes(df, pairs, rounds=1).collect())) == want  # the exact way for what is left


def test_wrong_recoveries_are_compared_in_full(spark, monkeypatch):
    r = random.Random(6)
    old = {r.getrandbits(62): 1 for _ in range(1200)}
    new = {k: (2 if r.random() < 0.05 else v) for k, v in old.items() if r.random() < 0.97} | {r.getrandbits(62): 3 for _ in range(40)}
    df, pairs = records(spark, {"old": old, "new": new}), spark.createDataFrame([("new", "old")], "pair string, earlier string")
    peeler = S._peeler

    def spoiling(level):
        run = peeler(level)

        def spoil(batches):
            for t in run(batches):
                t["digest"] = t["digest"] + (np.arange(len(t)) % 7 == 0)
                yield t

        return spoil

    monkeypatch.setattr(S, "_peeler", spoiling)
    assert sorted(map(tuple, S.snapshot_changes(df, pairs).collect())) == brute(old, new, "old", "new")


def test_empty(spark):
    df, pairs = records(spark, {}), spark.createDataFrame([], "pair string, earlier string")
    assert S.snapshot_changes(df, pairs).count() == 0


def test_consecutive_is_strictly_earlier(spark):
    t = lambda d: datetime(2026, 1, d)
    df = spark.createDataFrame([("a", "x", t(1)), ("b", "x", t(1)), ("c", "x", t(3)), ("d", "y", t(2)), ("e", None, t(5)), ("f", "y", None)], "id string, series string, taken_at timestamp")
    assert sorted(map(tuple, S.consecutive(df).collect())) == [("c", "b")]


def test_page_changes_of_sites(spark):
    t = lambda d: datetime(2026, 1, d)
    audits = spark.createDataFrame(
        [("a1", "HTTPS://X.example:443/", "running", None), ("a1", "HTTPS://X.example:443/", "completed", t(1)), ("a2", "http://x.example/de/?q#top", "completed", t(5)),
         ("a3", "https://x.example.test/", "completed", t(4)), ("a4", "https://x.example/", "failed", t(4))],
        "id string, seed_url string, status string, completed_at timestamp",
    )
    pages = spark.createDataFrame(
        [("p1", "a1", "https://X.example/a?utm_source=z"), ("p1", "a1", "https://X.example/a?utm_source=z"), ("p2", "a1", "https://x.example/b"), ("p3", "a1", "https://x.example/c/"),
         ("q1", "a2", "https://x.example:443/./a#t"), ("q2", "a2", "https://x.example/%62"), ("q3", "a2", "https://x.example/c"), ("q4", "a2", None), ("r1", "a3", "https://x.example/zz")],
        "id string, audit_id string, url string",
    )
    issues = spark.createDataFrame([("p1", "n"), ("p1", "m"), ("q1", "m"), ("q1", "n"), ("q1", "n"), ("p2", "n"), ("q2", None)], "page_id string, code string")
    got = sorted(map(tuple, page_changes(audits, pages, issues).collect()))
    assert got == [("a2", "p3", "removed"), ("a2", "q2", "changed"), ("a2", "q3", "added")]
