import random
from collections import Counter

from pyspark.sql import functions as F

from sitelens.operators import skew

def compressed(df):
    return skew.compress(df, F.col("k"), F.col("v"))


def frame(spark, rows, schema="k string, v double, key int, value string"):
    return spark.createDataFrame([(k, v, 1, "x") for k, v in rows], schema)  # columns key and value clash on purpose


def rows_of(seed=1):
    r = random.Random(seed)
    rows = [("hot", float(r.choice([1, 1, 1, 2, 3, -5]))) for _ in range(900)] + [("wide", r.gauss(0, 1e6)) for _ in range(300)]
    rows += [("nulls", None)] * 4 + [(None, 1.0)] * 3 + [("one", 7.0), ("zeros", 0.0), ("zeros", -0.0)]
    return rows


def test_summary_equals_plain_counts(spark):
    rows = rows_of()
    got = {r["key"]: r for r in skew.key_summary(compressed(frame(spark, rows))).collect()}
    for k in {k for k, _ in rows}:
        vs = [v for kk, v in rows if kk == k and v is not None]
        n = sum(kk == k for kk, _ in rows)
        assert (got[k]["n_rows"], got[k]["n_values"], got[k]["n_distinct"]) == (n, len(vs), len(set(vs)))
        if vs:
            top = max(Counter(vs).values())
            assert got[k]["mode_rows"] == top and got[k]["mode"] == min(v for v, c in Counter(vs).items() if c == top)
        else:
            assert got[k]["mode"] is None


def test_percentiles_are_exact(spark):
    rows = rows_of(2) + [("ties", 5.0)] * 50 + [("nan", float("nan")), ("nan", 3.0)]
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["key"], r["q"]): r["value"] for r in skew.weighted_percentiles(compressed(frame(spark, rows)), qs).collect()}
    for k in {k for k, _ in rows if k is not None}:
        vs = sorted(v for kk, v in rows if kk == k and v is not None and v == v)
        for q in qs:
            assert got.get((k, q)) == (vs[int(q * (len(vs) - 1))] if vs else None)


def test_heavy_keys_ignore_null_key_but_count_its_rows(spark):
    rows = [("a", 1.0)] * 5 + [(None, 1.0)] * 90 + [("b", 1.0)] * 5
    got = skew.heavy_keys(compressed(frame(spark, rows)), 0.05).collect()
    assert sorted((r["key"], r["n_rows"], r["n_total"]) for r in got) == [("a", 5, 100), ("b", 5, 100)]


def test_empty_table(spark):
    w = compressed(frame(spark, []))
    assert skew.key_summary(w).count() == 0 and skew.heavy_keys(w, 0.05).count() == 0
    assert skew.weighted_percentiles(w, [0.5]).count() == 0


def test_salted_join_equals_join(spark):
    fact = frame(spark, rows_of(3))
    dim = spark.createDataFrame([("hot", 1), ("one", 2), ("none", 3)], "k string, w int")
    for how in ("inner", "left_semi", "left_anti", "left"):
        a = skew.salted_join(fact, dim, ["k"], 4, how)
        b = fact.join(dim, ["k"], how)
        assert a.columns == b.columns and sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
