import random
import re

import numpy as np

from sitelens.llm import near_duplicates as nd

SCHEMA = "id string, audit_id string, title string, meta_description string, toks int, rid string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA)


def words(t):
    return {w for w in re.split(r"[^\w]|_", t.lower()) if w}


def brute(rows, t):
    once = {r[0]: r for r in rows if r[0] and r[1] and r[2] and r[2].strip() and r[3] is not None and len(words(r[3])) >= 15}
    out = set()
    for a in once.values():
        for b in once.values():
            if a[0] < b[0] and a[1] == b[1]:
                x, y = words(a[2]) | words(a[3]), words(b[2]) | words(b[3])
                if len(x & y) >= t * len(x | y) - 1e-9:
                    out.add((a[0], b[0]))
    return sorted(out)


def corpus(seed, n=260):
    r = random.Random(seed)
    common, rare = [f"w{i}" for i in range(12)], [f"name{i}" for i in range(400)]
    rows = []
    for i in range(n):
        audit = r.choice(["big", "big", "big", "small"])
        if rows and r.random() < 0.6:
            base = r.choice(rows)
            audit, ws = base[1], base[3].split()
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                ws[r.randrange(len(ws))] = r.choice(rare + common)
            r.shuffle(ws)
            if r.random() < 0.3:
                ws = ws[: max(15, len(ws) - r.randrange(9))]
        else:
            ws = r.sample(common, 10) + r.sample(rare, r.randrange(8, 25))
        rows.append((f"p{i:04}", audit, "Title " + r.choice(rare), " ".join(ws)))
    return rows


def test_pairs_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        rows += [rows[0], ("x1", "small", None, rows[0][3]), ("x2", "small", "  ", rows[0][3]), ("x3", "small", "t", None), ("x4", None, "t", rows[0][3]), (None, "small", "t", rows[0][3])]
        rows += [("y1", "small", "Long", " ".join(f"v{i}" for i in range(3000))), ("y2", "small", "Long", " ".join(f"v{i}" for i in range(3000, 0, -1)))]
        for t in (0.7, 0.85):
            got = nd.similar_pages(pages(spark, rows), t).collect()
            assert len(got) == len(set(got)) and sorted(map(tuple, got)) == brute(rows, t)


def test_frequent_words_are_extended(spark, monkeypatch):
    monkeypatch.setattr(nd, "RARE", 0)  # every n-gram grows to its full length
    rows = corpus(3, 120)
    assert sorted(map(tuple, nd.similar_pages(pages(spark, rows)).collect())) == brute(rows, 0.7)


def test_hot_keys_are_split(spark, monkeypatch):
    rows = corpus(7, 160)
    want = brute(rows, 0.7)
    monkeypatch.setattr(nd, "BLOCK", 3)
    got = sorted((x["page_id_a"], x["page_id_b"]) for x in nd.similar_pages(pages(spark, rows)).collect())
    assert got == want


def test_classes(spark):
    rows = corpus(4)
    want = brute(rows, 0.7)
    got = {r["page_id"]: r for r in nd.similarity_classes(pages(spark, rows)).collect()}
    texts = {r[0]: (r[1], frozenset(words(r[2]) | words(r[3]))) for r in rows}
    for p, r in got.items():
        same = [q for q in got if texts[q] == texts[p]]
        assert r["class_id"] == min(same)
        assert r["n_links"] == sum(p in pair for pair in want) - (len(same) - 1)


def test_empty(spark):
    assert nd.similar_pages(pages(spark, [])).count() == 0 and nd.similarity_classes(pages(spark, [])).count() == 0


def test_every_similar_pair_meets_at_a_key():
    """Sets of 1 to 120 words, all frequent: brute force finds no pair without a common key, and keys stay bounded."""
    r = np.random.default_rng(4)
    for t in (0.7, 0.8):
        for longest in (4, 8, 30, 120):
            sets: list[frozenset] = []
            for _ in range(150 if longest < 10 else 25):
                root = r.choice(longest * 2, size=r.integers(1, longest + 1), replace=False)
                sets.append(frozenset(root.tolist()))
                for _ in range(3):
                    kept = [x for x in root.tolist() if r.random() > 0.12] or root.tolist()[:1]
                    sets.append(frozenset(kept + r.choice(longest * 2, size=r.integers(0, len(kept) // 6 + 1)).tolist()))
            sets = list(dict.fromkeys(sets))
            size = 1_500 if longest == 120 else 100_000  # the latter splits every key in blocks
            flat = np.concatenate([np.array(sorted(x), dtype=np.int32) for x in sets])
            offsets = np.r_[0, np.cumsum([len(x) for x in sets])]
            rid = np.arange(len(sets))
            key, owner, info, _ = nd.prefix_keys(rid, np.zeros(len(sets), np.int64), offsets, flat, np.full(nd.BUCKETS, 0.9, np.float32), np.full(nd.BUCKETS, size), t)
            own: dict[int, set] = {i: set() for i in rid}
            for k, o, side in zip(key.tolist(), owner.tolist(), (info >> 24 & 3).tolist()):
                own[o].add((k, side))
            assert max(np.bincount(owner)) <= 3 * nd.MOST_KEYS * (nd.MOST_BLOCKS if size > nd.BLOCK else 1)
            found = 0
            for i in range(len(sets)):
                for j in range(i):
                    if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-9:
                        found += 1
                        assert any((k, (0, 2, 1)[side]) in own[j] for k, side in own[i]), (t, sets[i], sets[j])
            assert found > 3 or longest == 4  # distinct sets of so few words are never that similar
