"""Mergeable percentile sketches: counts in signed logarithmic buckets.

Bucket i of sign s holds the values x with gamma^(i-1) < s*x <= gamma^i, where
gamma = (1+e)/(1-e).  Reporting 2*gamma^i/(gamma+1) for any of them is wrong by at
most the factor e, whatever the level or spread of the values.  Buckets of separate
slices are merged by adding the counts of equal buckets, so the sketch of a union is
the union of the sketches.  A group never has more buckets than doubles have orders
of magnitude allow (about 71,000 at e = 1%), however many rows it has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR = 0.01


def gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def sketch(df: DataFrame, keys: list[str], value: Column, error: float = ERROR) -> DataFrame:
    """(keys, sign, bucket, n).  Nulls, NaN and infinities are no values; zero has sign and bucket 0."""
    x = value.cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    size = F.when(x != 0, F.ceil(F.log(F.abs(x)) / math.log(gamma(error)))).otherwise(F.lit(0))
    rows = df.where(ok).select(*keys, F.signum(x).cast("int").alias("sign"), size.cast("int").alias("bucket"))
    return rows.groupBy(*keys, "sign", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(keys: list[str], *sketches: DataFrame) -> DataFrame:
    """One sketch from sketches of disjoint slices; extra key columns (day, slice) are summed away."""
    parts = [s.select(*keys, "sign", "bucket", "n") for s in sketches]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(*keys, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sk: DataFrame, keys: list[str], quantiles: dict[str, float], error: float = ERROR) -> DataFrame:
    """(keys, n, one column per quantile).

    Quantile q of n values estimates the value at position floor(q*(n-1)) in ascending
    order within the relative error.  Groups without values have no row.
    """
    g = gamma(error)
    place = Window.partitionBy(*keys).orderBy("sign", F.col("sign") * F.col("bucket"))
    at = sk.withColumn("cum", F.sum("n").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    at = at.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    value = F.when(F.col("sign") == 0, F.lit(0.0)).otherwise(F.col("sign") * 2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1))
    wanted = []
    for name, q in quantiles.items():
        pos = F.floor(F.lit(q) * (F.col("total") - 1))
        wanted.append(F.max(F.when((pos >= F.col("cum") - F.col("n")) & (pos < F.col("cum")), value)).alias(name))
    return at.groupBy(*keys).agg(F.sum("n").alias("n"), *wanted)


def page_measures(pages: DataFrame) -> DataFrame:
    """(audit_id, metric, value, day): response_time and body_size of every page once."""
    once = pages.select("id", "audit_id", "response_time", "body_size", F.to_date("crawled_at").alias("day")).distinct()
    return once.select(
        "audit_id", "day",
        F.inline(F.array(
            F.struct(F.lit("response_time").alias("metric"), F.col("response_time").alias("value")),
            F.struct(F.lit("body_size").alias("metric"), F.col("body_size").cast("double").alias("value")),
        )),
    )
