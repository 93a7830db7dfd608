import math
import random
from collections import Counter

import numpy as np

from sitelens.llm import spam
from sitelens.llm.spam_features import FEATURES, measure

PROSE = [
    "The finish is quiet, almost silent, and takes oil well.", "After the repair, the workshop kept the bag in daily use and reported no fault.", "You can return unused goods within thirty days; we only ask you to keep the box.",
    "It arrives with a linen cover and a printed card that explains how to pack the heater.", "Opening hours differ between the two towns, so please call ahead before you travel.", "Should the lamp wobble, tighten the lower screws and wait a day for the glue to set.",
]
SPAM = [
    "buy cheap kettle, kettle sale, cheap kettle online, best kettle, kettle discount, kettle near me, " * 4, "#cheapkettle #kettlesale #buykettle #bestkettle #kettleonline #kettlediscount", "kettle kettle buy best kettle cheap top kettle sale buy kettle best " * 8,
    "\n".join(f"https://shop{i}.example/oak/kettle-{i}" for i in range(9)), "Keywords=kettle, size 4, oak, walnut, round, steel, size 9, felt, lamp, tall, brass, size 12, wool", "Our kettle is the best kettle for kettle fans. Buy kettle here because kettle and more kettle make kettle. " * 6,
    "c h e a p k e t t l e\nk​e​t​t​l​e​ sale\nkettle-sale\nk3ttl3 sal3\n" * 5,
]
FINE = [
    "2015-04-10 00:10:00 GET /hemp/bench-1 301 857 ms\n" * 6, "User-agent: *\nDisallow: /archive/\nAllow: /\nSitemap: https://x.example/s.xml\nCrawl-delay: 4\nDisallow: /tmp/\nDisallow: /old/\n",
    "Tool box, article DD-1\nWidth: 81 mm\nHeight: 330 mm\nWeight: 151 g\nBody: velvet and rattan\nUse: bakers", "1. Open the box and take out the lamp.\n2. Tighten the screws with the key.\n3. Wait for a day before you use it.",
    "Q: How long does the delivery take?\nA: It takes about nine working days.\nQ: Can I return the lamp?\nA: You can return it within thirty days.", "<p>" + "</p><p>".join(PROSE) + "</p>", " ".join(PROSE) + "\nSee also: https://a.example https://b.example\nTags: oak, lamp, kettle",
    "The kettle is easy to clean. The kettle is made of steel, and the kettle has a lid that fits. We like the kettle because it is quiet, and so do our readers.",
]


def test_cases(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.sample(PROSE, r.randrange(2, 6))), r.choice(["en", "EN", "en-GB", None, "und"]), 1.0) for i in range(300)]
    rows += [(1000 + i, t, "en", 1.0) for i, t in enumerate(SPAM)] + [(1000, SPAM[0], "en", 1.0), (2000, SPAM[0], None, 1.0)]
    rows += [(3000 + i, t, "en", 1.0) for i, t in enumerate(FINE)] + [(4000, None, "en", 1.0), (4001, "", "en", 1.0), (4002, " \r\n", None, 1.0), (4003, "kettle sale", "en", 1.0), (4004, "word. " * 1 + " ".join(PROSE) * 300, "en", 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, sentence double")
    got = sorted(x["doc_id"] for x in spam.spam_documents(df).collect())
    assert got == [1000 + i for i in range(len(SPAM))] + [2000]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert spam.spam_documents(df).count() == 0


def _table(spark):
    r = random.Random(5)
    rows = [(i, " ".join(r.sample(PROSE, r.randrange(2, 6))), "en") for i in range(300)]
    return spark.createDataFrame(rows + [(1000 + i, t, "en") for i, t in enumerate(SPAM)] + [(3000 + i, t, "en") for i, t in enumerate(FINE)], "doc_id bigint, text string, lang string")


def test_measures_are_shares(spark):
    rows = [(i, t, None) for i, t in enumerate((*PROSE, *SPAM, *FINE, "", "x", "お茶は静かです。よく使います。"))]
    df = measure(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    for r in df.collect():
        assert all(0 <= r[f] <= 1.0000001 for f in FEATURES if f not in ("breaks", "keyed", "stops")), r


def test_entropy_and_repetition_equal_a_plain_count(spark):
    texts = {1: "aa bb aa cc aa bb", 2: "the lamp and the lamp and the lamp", 3: "x1"}
    got = {r["doc_id"]: r for r in measure(spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id bigint, text string, lang string")).collect()}
    for i, text in texts.items():
        words = text.split()
        counts, pairs, n = Counter(words), Counter(zip(words, words[1:])), len(words)
        entropy = -sum(k / n * math.log(k / n) for k in counts.values()) / math.log(n) if n > 1 else 1.0
        assert abs(got[i]["entropy"] - entropy) < 1e-9
        assert abs(got[i]["repeat"] - sum(k for k in pairs.values() if k >= 3) / max(1, n - 1)) < 1e-9
    assert got[1]["top"] == 2 / 6 and got[2]["function"] == 5 / 8 and got[2]["top"] == 2 / 8


def test_distance_and_direction_both_decide(spark):
    """With the distance taken away real texts are reported; with the direction taken away, texts that serve a reader."""
    measured = spam.materialize(measure(_table(spark)), "t")
    rows = spam.judge(measured, spam.fit(measured)).collect()
    cases = {r["doc_id"] for r in rows if r["case"]}
    assert cases == {1000 + i for i in range(len(SPAM))}
    limit = spam.chi2_quantile(spam.OUTLIER, spam.K)
    undirected = {r["doc_id"] for r in rows if r["distance"] > limit and r["units"] >= spam.LEAST_WORDS}
    near = {r["doc_id"] for r in rows if r["spam"] >= spam.ALIGNED and r["spam"] > r["serving"]}
    assert undirected - cases and near - cases


def test_chi_square():
    assert abs(spam.chi2_quantile(0.999, 8) - 26.124) < 1e-3 and abs(spam.chi2_quantile(0.9, 11) - 17.275) < 1e-3
    assert spam.chi2_cdf(0, 3) == 0


def test_few_documents_lean_on_the_pooled_model(spark):
    rows = [(i, " ".join(PROSE[: 2 + i % 4]), "en") for i in range(80)] + [(900, "Der Kessel ist leise und er steht auf dem Herd in der Küche.", "de")]
    measured = spam.materialize(measure(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")), "t")
    model = spam.fit(measured)
    assert np.allclose(model["fr"][0], model["und"][0]) and np.abs(model["de"][0] - model["fr"][0]).max() < 0.1
    assert all(np.linalg.eigvalsh(c).min() > 0 for _, c in model.values())
