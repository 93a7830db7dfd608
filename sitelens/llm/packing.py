"""Filling containers of fixed capacity, planned on the histogram of lengths.

The plan depends on the counts per length only.  Lengths are put in windows of equal
width; combinations of a few windows that fill a container are enumerated, and
non-negative least squares finds how often each has to be repeated to use up the
histogram.  The rounded repeats are carried out on exact lengths, and what is left is
packed greedily, longest first into the tightest open space.  The plan is a list of
runs whose number depends on the capacity, not on the number of items; every item
then finds its container from its length and its rank among items of that length.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.session import materialize

CAPACITY, WINDOWS, DEPTH = 2048, 128, 3
#: Items of one length that are numbered in one task; their number gives the number of slices.
SLICE_ITEMS = 500_000


@lru_cache(maxsize=8)
def combinations(windows: int, depth: int) -> np.ndarray:
    """Counts per window (columns: combinations) of at most ``depth`` windows 1..windows that add up to ``windows``."""
    found: list[list[int]] = []

    def extend(prefix: list[int], rest: int, most: int) -> None:
        if rest == 0:
            found.append(prefix)
        elif len(prefix) < depth:
            for w in range(min(rest, most), 0, -1):
                if w * (depth - len(prefix)) < rest:
                    break
                extend([*prefix, w], rest - w, w)

    extend([], windows, windows)
    a = np.zeros((windows, len(found)))
    for j, c in enumerate(found):
        for w in c:
            a[w - 1, j] += 1
    return a


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Non-negative x that minimises |a x - b|, by growing and shrinking the set of active columns."""
    n, gram, rhs = a.shape[1], a.T @ a, a.T @ b
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    least = tolerance * max(1.0, float(np.abs(rhs).max(initial=0)))
    for _ in range(3 * a.shape[0] + 10):
        gain = rhs - gram @ x
        gain[active] = -np.inf
        j = int(np.argmax(gain))
        if gain[j] <= least:
            break
        active[j] = True
        while active.any():
            cols = np.flatnonzero(active)
            s = np.zeros(n)
            try:
                s[cols] = np.linalg.solve(gram[np.ix_(cols, cols)], rhs[cols])
            except np.linalg.LinAlgError:
                s[cols] = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            low = active & (s <= tolerance)
            if not low.any():
                x = s
                break
            step = np.min(x[low] / np.maximum(x[low] - s[low], 1e-300))
            x = np.where(active, x + step * (s - x), 0)
            shrunk = active & (x > tolerance)
            if (shrunk == active).all():
                shrunk[np.flatnonzero(low)[0]] = False
            x = np.where(shrunk, x, 0)
            active = shrunk
    return x


def plan(histogram: dict[int, int], capacity: int = CAPACITY, windows: int = WINDOWS, depth: int = DEPTH) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, items, first container, items per container), and the number of containers.

    ``histogram``: number of items by length, 1..capacity.  Items of one length are
    numbered from 0; each run takes a stretch of these numbers.
    """
    width = -(-capacity // windows)
    windows = -(-capacity // width)
    left = {length: n for length, n in sorted(histogram.items()) if n > 0}
    taken = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    space: list[tuple[int, int, int]] = []  # (free, first container, containers), sorted
    n_containers = 0

    by_window: dict[int, list[int]] = {}
    for length in left:
        by_window.setdefault(-(-length // width), []).append(length)
    b = np.array([float(sum(left[x] for x in by_window.get(w, []))) for w in range(1, windows + 1)])
    a = combinations(windows, depth)
    weight = np.arange(1, windows + 1, dtype=float)
    repeats = nnls(a * weight[:, None], b * weight)
    stock = {w: int(b[w - 1]) for w in by_window}
    for j in np.argsort(-repeats, kind="stable"):
        times = int(round(repeats[j]))
        need = {int(w) + 1: int(a[w, j]) for w in np.flatnonzero(a[:, j])}
        times = min([times, *(stock.get(w, 0) // k for w, k in need.items())])
        if times <= 0:
            continue
        used = {(n_containers, times): 0}
        for w, k in need.items():
            stock[w] -= k * times
            for _ in range(k):
                parts: dict[tuple[int, int], int] = {}
                for (start, n), filled in used.items():
                    while n:
                        length = by_window[w][-1]
                        m = min(n, left[length])
                        runs.append((length, taken[length], m, start, 1))
                        parts[start, m] = filled + length
                        taken[length] += m
                        left[length] -= m
                        start, n = start + m, n - m
                        if not left[length]:
                            by_window[w].pop()
                used = parts
        n_containers += times
        space += [(capacity - filled, start, n) for (start, n), filled in used.items()]
    space.sort()

    for length in sorted((x for x in left if left[x]), reverse=True):
        while left[length]:
            i = bisect.bisect_left(space, (length, -1, -1))
            if i < len(space):
                free, start, n = space.pop(i)
                per = min(free // length, left[length])
                m = min(n, left[length] // per)
            else:
                free, start = capacity, n_containers
                per = min(capacity // length, left[length])
                m = n = left[length] // per
                n_containers += m
            runs.append((length, taken[length], m * per, start, per))
            taken[length] += m * per
            left[length] -= m * per
            for part in ((free - per * length, start, m), (free, start + m, n - m)):
                if part[0] and part[2]:
                    bisect.insort(space, part)
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), n_containers


def _placer(runs: np.ndarray):
    key = runs[:, 0] * (1 << 40) + runs[:, 1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            size, rank = t["size"].to_numpy(np.int64), t["rank"].to_numpy(np.int64)
            out = np.zeros(len(t), dtype=np.int64)
            some = size > 0
            i = np.searchsorted(key, size[some] * (1 << 40) + rank[some], side="right") - 1
            out[some] = runs[i, 3] + (rank[some] - runs[i, 1]) // runs[i, 4]
            yield pd.DataFrame({"doc_id": t["doc_id"], "part": t["part"], "n_tokens": size, "container_id": out})

    return run


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, n_tokens, container_id): every item in a container of ``capacity``.

    ``sizes``: doc_id, n_tokens.  An item longer than a container is split into full
    containers and a rest (parts 0, 1, ...); no other item is split.  Items without
    tokens take no space and are put in container 0.  Containers are numbered from 0
    without gaps; the result is the same for the same input.
    """
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    parts = sizes.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part"))
    parts = parts.select("doc_id", "part", F.least(F.lit(capacity), F.col("n_tokens") - F.col("part") * capacity).cast("int").alias("size"))
    items = materialize(parts, "pack-items")
    # At most one row per length up to the capacity.
    counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = 1 + max(counts.values(), default=0) // SLICE_ITEMS
    items = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int"))
    slices = items.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    runs, _ = plan({size: n for size, n in counts.items() if size > 0}, capacity)
    within = Window.partitionBy("size", "salt").orderBy("doc_id", "part")
    ranked = items.withColumn("k", F.row_number().over(within)).join(slices.select("size", "salt", "base"), ["size", "salt"])
    ranked = ranked.select("doc_id", "part", "size", (F.col("base") + F.col("k") - 1).alias("rank"))
    return ranked.mapInPandas(_placer(runs), "doc_id bigint, part int, n_tokens int, container_id bigint")
