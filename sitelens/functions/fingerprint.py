"""Content fingerprints: exact hash and a similarity hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_hash(text: Column) -> Column:
    """SHA-256 in hex; null for null or empty text."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.sha2(text, 256))


def sim_hash(text: Column) -> Column:
    """64-bit similarity hash of the words in lower case.

    Each word votes on 32 bits by its CRC-32; the high half repeats the low half, so
    distances are even.  Null gives null, text without words 0.
    """
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    sums = F.aggregate(
        F.transform(words, lambda w: F.crc32(w)),
        F.array_repeat(F.lit(0), 32),
        lambda acc, h: F.transform(acc, lambda v, i: v + F.when(F.getbit(h, i) == 1, 1).otherwise(-1)),
    )
    low = F.aggregate(
        F.transform(sums, lambda v, i: F.when(v > 0, F.pow(F.lit(2), i).cast("long")).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"), lambda a, b: a + b,
    )
    return F.when(text.isNotNull(), F.shiftleft(low, 32).bitwiseOR(low))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(value: Column, parts: int) -> Column:
    """(part, bits) of the low 32 bits cut in ``parts``: hashes within parts - 1 low bits agree in one part."""
    width = -(-32 // parts)
    return F.array(*[
        F.struct(F.lit(i).alias("part"), F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit((1 << width) - 1 if (i + 1) * width <= 32 else (1 << (32 - i * width)) - 1)).alias("bits"))
        for i in range(parts)
    ])


def sim_hash_table(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, sim_hash) for large tables: words are counted per key, and 32 sums are added up map-side.

    Same values as ``sim_hash``; rows whose text is null or has no words are left out.
    """
    words = df.select(key, F.explode(F.split(F.lower(text), r"\s+")).alias("w")).where("w <> ''").select(key, F.crc32("w").alias("h"))
    bits = words.groupBy(key).agg(*[F.sum(F.when(F.getbit("h", F.lit(i)) == 1, 1).otherwise(-1)).alias(f"b{i}") for i in range(32)])
    low = F.lit(0).cast("long")
    for i in range(32):
        low = low + F.when(F.col(f"b{i}") > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return bits.select(key, F.shiftleft(low, 32).bitwiseOR(low).alias("sim_hash"))
