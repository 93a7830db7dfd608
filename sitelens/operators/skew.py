"""Operators for keys that hold a large share of all rows.

``compress`` groups by key *and* value before anything is grouped by key, so the
rows of a hot key are already merged into one weighted row per distinct value when
they meet.  Everything else here works on those weighted values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per octave of the first refinement of ``weighted_percentiles`` and slices of the second.
PER_OCTAVE, SLICES = 16, 1024


def compress(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """(key, value, weight): every distinct value of a key once, with its number of rows.

    Both groupings below start from this table.  The shuffle is hashed on the pair, so
    a key that owns a third of all rows is spread over as many tasks as it has values,
    and map-side partial counts shrink repeated values before the shuffle.
    Null keys and null values are kept as values of their own.
    """
    return df.select(key.alias("key"), value.alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("weight"))


def key_summary(weighted: DataFrame) -> DataFrame:
    """Per key, exactly: rows, rows with a value, distinct values, mode and the mode's rows.

    Result (key, n_rows, n_values, n_distinct, mode, mode_rows).  Nulls are no value:
    they count in ``n_rows`` only, and a key with nothing but nulls has a null mode.
    Ties of the mode go to the smallest value.  An empty table gives no rows.
    """
    known = F.col("value").isNotNull()
    seen = weighted.groupBy("key").agg(
        F.sum("weight").alias("n_rows"),
        F.coalesce(F.sum(F.when(known, F.col("weight"))), F.lit(0)).alias("n_values"),
        F.count(F.when(known, 1)).alias("n_distinct"),
        F.min(F.when(known, F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v")))).alias("top"),
    )
    return seen.select(
        "key", "n_rows", "n_values", "n_distinct",
        F.col("top.v").alias("mode"), (-F.col("top.w")).alias("mode_rows"),
    )


def heavy_keys(weighted: DataFrame, share: float) -> DataFrame:
    """(key, n_rows, n_total): keys that hold at least ``share`` of all rows.

    The total counts every row, those with a null key too; a null key is never reported.
    """
    per_key = weighted.groupBy("key").agg(F.sum("weight").alias("n_rows"))
    total = weighted.agg(F.sum("weight").alias("n_total"))
    # One row on the right: the cross product with it is a broadcast of a single row.
    return per_key.crossJoin(F.broadcast(total)).where(
        F.col("key").isNotNull() & (F.col("n_rows") >= F.lit(share) * F.col("n_total"))
    )


def _coarse(x: Column) -> Column:
    """A bucket number that never decreases as x increases."""
    size = F.floor(F.log2(F.abs(x)) * PER_OCTAVE)
    return F.when(x > 0, size + 20_000).when(x < 0, -size - 20_000).otherwise(F.lit(0)).cast("long")


def weighted_percentiles(weighted: DataFrame, quantiles: list[float]) -> DataFrame:
    """Exact percentiles per key from weighted values: (key, q, value).

    The percentile q of n values is the one at position floor(q*(n-1)) in ascending
    order.  No task sees all values of a key: weights are added up in coarse
    order-preserving buckets, the bucket that holds each wanted position is cut into
    ``SLICES`` equal slices, and only the values inside the one slice that holds the
    position are put in order.  Nulls and NaN are left out; a key without values has no rows.
    """
    values = weighted.where(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    values = values.select("key", F.col("value").cast("double").alias("value"), "weight")
    values = values.withColumn("b", _coarse(F.col("value")))
    coarse = values.groupBy("key", "b").agg(F.sum("weight").alias("w"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    upto = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("key")
    placed = coarse.withColumn("cum", F.sum("w").over(upto)).withColumn("n", F.sum("w").over(whole))
    wanted = placed.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles])))
    wanted = wanted.withColumn("pos", F.floor(F.col("q") * (F.col("n") - 1)))
    wanted = wanted.where((F.col("pos") >= F.col("cum") - F.col("w")) & (F.col("pos") < F.col("cum")))
    wanted = wanted.select("key", "q", "b", "lo", "hi", (F.col("pos") - (F.col("cum") - F.col("w"))).alias("pos"))

    inside = values.join(wanted, ["key", "b"]).withColumn(
        "s",
        F.when(F.col("hi") > F.col("lo"), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * SLICES))
        .otherwise(F.lit(0)).cast("long"),
    )
    slices = inside.groupBy("key", "q", "s", "pos").agg(F.sum("weight").alias("w"))
    upto = Window.partitionBy("key", "q").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    slices = slices.withColumn("cum", F.sum("w").over(upto))
    slices = slices.where((F.col("pos") >= F.col("cum") - F.col("w")) & (F.col("pos") < F.col("cum")))
    slices = slices.select("key", "q", "s", (F.col("pos") - (F.col("cum") - F.col("w"))).alias("rest"))

    last = inside.join(slices, ["key", "q", "s"])
    upto = Window.partitionBy("key", "q").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("cum", F.sum("weight").over(upto))
    last = last.where((F.col("rest") >= F.col("cum") - F.col("weight")) & (F.col("rest") < F.col("cum")))
    return last.select("key", "q", "value")


def salted_join(fact: DataFrame, dim: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join of a large skewed ``fact`` with a smaller ``dim``.

    Each row of ``dim`` is repeated once per salt and each row of ``fact`` draws one salt
    from its own content, so the rows of a hot key meet in ``salts`` tasks instead of one.
    ``how`` may be inner, left, left_semi or left_anti (fact on the left).
    """
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in fact.columns if not _is_map(fact, c)]), F.lit(salts)).cast("int")
    left = fact.withColumn("__salt", spread)
    right = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # Sizes are estimated before the rows are repeated, so a broadcast is ruled out here.
    right = right.hint("merge")
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def _is_map(df: DataFrame, name: str) -> bool:
    return "map<" in df.schema[name].dataType.simpleString()
