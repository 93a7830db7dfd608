"""Keyword-stuffed and link-list texts as robust outliers in the directions of spam.

Per language, centre and scatter of the features are estimated over all documents:
they start from the language's own medians and quartiles and are refined by
concentration steps in which documents far from the current centre don't count, so
that spam doesn't widen its own tolerance.  A text is reported if its squared
Mahalanobis distance lies beyond the ``OUTLIER`` quantile and its deviation, measured
in the same metric, points nearer to a direction of spam than to one of the texts
that serve a reader though they are no prose.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.spam_features import FEATURES, LANGUAGES, measure
from sitelens.session import materialize

NAMES = tuple(FEATURES)
K = len(NAMES)
FLOOR = np.array(list(FEATURES.values()))
#: Quantiles of the documents that count in a step and of outliers; concentration steps; fewest words of a case.
CORE, OUTLIER, STEPS, LEAST_WORDS = 0.9, 0.999, 4, 8
#: Documents by which a language's model is drawn towards the pooled one: n of its own count n / (n + SHRINK).
SHRINK = 100
#: Least cosine between the deviation and a direction of spam.
ALIGNED = 0.5

_BARE = {"function": 0.0, "stops": 0.0, "dry": 1.0}
#: Directions lead from a language's centre to these points; features that are not named stay at the centre.
SPAM = (
    {**_BARE, "breaks": 0.5, "entropy": 0.9},  # a run of tags or titles
    {**_BARE, "digits": 0.12, "entropy": 0.9},  # a run of article lines
    {**_BARE, "repeat": 0.4, "entropy": 0.65, "top": 0.15},  # search words over and over
    {"repeat": 0.6, "entropy": 0.55, "top": 0.2},  # sentences stuffed with one phrase
    {**_BARE, "stops": 0.25, "repeat": 0.9, "entropy": 0.35, "top": 0.25},  # cries of one phrase
    {**_BARE, "link": 0.95},
    {**_BARE, "tag": 1.0},
)
SERVING = (
    {**_BARE, "digits": 0.35, "keyed": 0.4},  # logs
    {"function": 0.06, "stops": 0.01, "dry": 0.8, "digits": 0.08, "breaks": 0.3, "keyed": 0.25},  # specifications
    {"function": 0.2, "stops": 0.03, "dry": 0.55, "breaks": 0.35, "keyed": 0.2},  # rule files
    {"stops": 0.0, "repeat": 0.45, "entropy": 0.8, "breaks": 0.15, "dry": 0.3},  # lists of steps and changes
    {"link": 0.5},  # prose with references
    {"repeat": 0.6, "entropy": 0.75},  # sentences said twice
)
Model = dict[str, tuple[np.ndarray, np.ndarray]]


def chi2_cdf(x: float, k: int) -> float:
    """Probability that a sum of k squared standard normals is at most x (series of the incomplete gamma function)."""
    if x <= 0:
        return 0.0
    a, h = k / 2, x / 2
    term = total = 1 / a
    while term > total * 1e-16:
        a += 1
        term *= h / a
        total += term
    return total * math.exp(-h + k / 2 * math.log(h) - math.lgamma(k / 2))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1.0
    while chi2_cdf(high, k) < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return high


def directions(mean: np.ndarray, precision: np.ndarray) -> np.ndarray:
    """Rows that give, for a deviation z, its distance covered along each direction (spam first)."""
    rows = []
    for point in (*SPAM, *SERVING):
        v = np.array([point.get(f, m) - m for f, m in zip(NAMES, mean)])
        rows.append(precision @ v / math.sqrt(max(v @ precision @ v, 1e-300)))
    return np.array(rows)


def _with_model(spark: SparkSession, measured: DataFrame, model: Model, more: bool = False) -> DataFrame:
    """Documents with their squared distance, and with ``along`` (the distance covered along each direction) if asked."""
    rows = []
    for lg, (mean, cov) in model.items():
        p = np.linalg.inv(cov)
        twice = p * (2 - np.eye(K))
        rows.append((lg, mean.tolist(), twice[np.triu_indices(K)].tolist(), directions(mean, p).ravel().tolist()))
    table = spark.createDataFrame(rows, "lg string, mean array<double>, twice array<double>, directions array<double>")
    # One row per language the package knows: a constant number.
    t = measured.join(F.broadcast(table), "lg").withColumns({f"z{i}": F.expr(f"{f} - get(mean, {i})") for i, f in enumerate(NAMES)})
    t = t.withColumn("distance", F.expr(" + ".join(f"get(twice, {at}) * z{i} * z{j}" for at, (i, j) in enumerate(zip(*np.triu_indices(K))))))
    if more:
        along = [" + ".join(f"get(directions, {d * K + i}) * z{i}" for i in range(K)) for d in range(len(SPAM) + len(SERVING))]
        t = t.withColumn("along", F.expr(f"array({', '.join(along)})"))
    return t.select(*measured.columns, "distance", *(["along"] if more else []))


def _towards(own: tuple[np.ndarray, np.ndarray], pooled: tuple[np.ndarray, np.ndarray], n: float) -> tuple[np.ndarray, np.ndarray]:
    w = n / (n + SHRINK)
    return w * own[0] + (1 - w) * pooled[0], w * own[1] + (1 - w) * pooled[1]


def fit(measured: DataFrame, steps: int = STEPS) -> Model:
    """Centre and scatter per language of written features (``materialize``); one with few documents leans on the pooled ones.

    The driver gets, per language, three quartiles a feature and 1 + K + K(K+1)/2 sums a step.
    """
    spark = measured.sparkSession
    enough = measured.where(F.col("units") >= LEAST_WORDS)
    known = (*LANGUAGES, "und")
    start = {
        r["lg"] or "": r
        for r in enough.rollup("lg").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f) for f in NAMES]).collect()
    }
    if not start or start[""]["n"] == 0:
        return {lg: (np.zeros(K), np.eye(K)) for lg in known}

    def quartiles(r) -> tuple[np.ndarray, np.ndarray]:
        q = np.array([r[f] for f in NAMES])
        return q[:, 1], np.diag(np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR) ** 2)

    pooled = quartiles(start[""])
    model = {lg: _towards(quartiles(start[lg]), pooled, start[lg]["n"]) if lg in start else pooled for lg in known}
    core = chi2_quantile(CORE, K)
    # The scatter of the documents within the core is smaller than that of all by this factor.
    consistency = chi2_cdf(core, K) / chi2_cdf(core, K + 2)
    upper = np.triu_indices(K)
    sums = [F.count(F.lit(1)).cast("double").alias("s0"), *[F.sum(f).alias(f"s{i + 1}") for i, f in enumerate(NAMES)]]
    sums += [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s{1 + K + at}") for at, (i, j) in enumerate(zip(*upper))]
    for _ in range(steps):
        near = _with_model(spark, enough, model).where(F.col("distance") <= core).groupBy("lg").agg(*sums).collect()
        found = {r["lg"]: np.array([r[f"s{k}"] for k in range(1 + K + len(upper[0]))]) for r in near}
        if not found:
            break
        own = {lg: _moments(v, consistency) for lg, v in found.items()}
        pooled = _moments(sum(found.values()), consistency)
        model = {lg: _towards(own[lg], pooled, found[lg][0]) if lg in own else pooled for lg in known}
    return model


def _moments(v: np.ndarray, consistency: float) -> tuple[np.ndarray, np.ndarray]:
    mean = v[1 : 1 + K] / v[0]
    cov = np.zeros((K, K))
    cov[np.triu_indices(K)] = v[1 + K :] / v[0]
    cov = cov + np.triu(cov, 1).T - np.outer(mean, mean)
    return mean, cov * consistency + np.diag(FLOOR**2)


def judge(measured: DataFrame, model: Model) -> DataFrame:
    """``measured`` with distance, spam and serving (cosines with the nearest directions) and case."""
    t = _with_model(measured.sparkSession, measured, model, more=True)
    length = F.sqrt(F.greatest("distance", F.lit(1e-12)))
    t = t.withColumn("spam", F.array_max(F.slice("along", 1, len(SPAM))) / length)
    t = t.withColumn("serving", F.array_max(F.slice("along", len(SPAM) + 1, len(SERVING))) / length)
    far = (F.col("distance") > chi2_quantile(OUTLIER, K)) & (F.col("units") >= LEAST_WORDS)
    return t.withColumn("case", far & (F.col("spam") >= ALIGNED) & (F.col("spam") > F.col("serving")))


def spam_documents(documents: DataFrame) -> DataFrame:
    """(doc_id): documents most of whose text is keywords, links or tags.

    Null, blank and very short texts (fewer than ``LEAST_WORDS`` words, links and tags)
    are none; copies of a case are cases.  Further columns are ignored; an empty table
    gives no rows; a null doc_id is a document like others.
    """
    measured = materialize(measure(documents), "spam-features")
    return judge(measured, fit(measured)).where("case").select("doc_id").distinct()
