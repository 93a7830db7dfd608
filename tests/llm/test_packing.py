import random
from collections import defaultdict

import numpy as np
import pytest

from sitelens.llm import packing


def check(rows, sizes, capacity):
    fill, parts = defaultdict(int), defaultdict(dict)
    for r in rows:
        fill[r["container_id"]] += r["n_tokens"]
        parts[r["doc_id"]][r["part"]] = r["n_tokens"]
    assert max(fill.values(), default=0) <= capacity
    assert {d: sum(p.values()) for d, p in parts.items()} == sizes
    for d, p in parts.items():
        assert sorted(p) == list(range(max(1, -(-sizes[d] // capacity)))) and all(p[i] == capacity for i in sorted(p)[:-1])
    used = [c for c, n in fill.items() if n]
    if used:
        assert set(used) == set(range(max(used) + 1))
    return len(used)


@pytest.mark.parametrize("kind", ["mixed", "equal", "halves", "small", "none"])
def test_containers(spark, kind):
    r = random.Random(kind)
    sizes = {
        "mixed": {i: int(r.lognormvariate(4.5, 1.2)) for i in range(3000)} | {3001: 0, 3002: 1025, 3003: 512 * 7, 3004: 512},
        "equal": {i: 300 for i in range(101)}, "halves": {i: r.choice([256, 255, 257]) for i in range(500)}, "small": {1: 3, 2: 0}, "none": {},
    }[kind]
    df = spark.createDataFrame([(d, n, "x") for d, n in sizes.items()], "doc_id bigint, n_tokens bigint, salt string")
    rows = packing.pack(df.drop("salt"), 512).collect()
    n = check(rows, sizes, 512)
    total = sum(sizes.values())
    if kind == "mixed":
        assert n <= 1.01 * total / 512 + 1
    if kind == "equal":
        assert n == 101
    assert rows == sorted(rows, key=lambda x: rows.index(x)) and sorted(rows) == sorted(packing.pack(df.drop("salt"), 512).collect())


def test_nnls_meets_the_optimality_conditions():
    r = np.random.default_rng(3)
    for _ in range(5):
        a, b = r.random((12, 40)), r.normal(size=12)
        x = packing.nnls(a, b)
        g = a.T @ (a @ x - b)
        assert (x >= 0).all() and (g > -1e-6).all() and np.abs(g[x > 1e-9]).max(initial=0) < 1e-6


def test_plan_size_does_not_follow_the_number_of_items():
    r = random.Random(1)
    h = {n: r.randrange(1, 50) for n in range(1, 513)}
    few, _ = packing.plan(h, 512)
    many, _ = packing.plan({k: v * 10_000 for k, v in h.items()}, 512)
    assert len(many) < 20_000 and len(many) < 6 * len(few)
