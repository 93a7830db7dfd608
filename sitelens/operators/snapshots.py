"""What changed between consecutive full snapshots, by subtracting sketches.

Every snapshot is a set of (record, content) pairs.  Records are spread over hash
buckets; each bucket of a snapshot becomes an invertible Bloom lookup table whose
cells hold a signed count and XORs of record hash, content hash and a check hash.
Because cells are linear, adding the later snapshot with sign +1 and the earlier one
with sign -1 *is* the subtraction: equal pairs vanish, and only cells touched by a
difference remain.  Peeling recovers the differing pairs; buckets that do not empty
are built again with more cells; what is recovered is checked against the records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.operators.skew import salted_join
from sitelens.session import materialize

#: Records of both sides per bucket, cells per record of the first table, growth per retry, retries, fewest cells.
BUCKET_RECORDS, CELL_SHARE, ENLARGE, ROUNDS, LEAST_CELLS = 512, 0.4, 4, 6, 24
HASHES = 3
_PEELED = "pair string, bucket int, rec bigint, digest bigint, sign int, failed boolean"


def consecutive(snapshots: DataFrame) -> DataFrame:
    """(pair, earlier): each snapshot and the latest strictly earlier one of its series.

    ``snapshots`` has id, series, taken_at; rows with a null in any of them are no
    snapshots.  Of several snapshots taken at one moment the one with the largest id
    is the predecessor of what follows.
    """
    w = Window.partitionBy("series").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    t = snapshots.where(F.col("id").isNotNull() & F.col("series").isNotNull() & F.col("taken_at").isNotNull())
    t = t.withColumn("at", F.unix_micros(F.col("taken_at").cast("timestamp")))
    t = t.withColumn("prev", F.max(F.struct("at", "id")).over(w))
    return t.where(F.col("prev").isNotNull()).select(F.col("id").alias("pair"), F.col("prev.id").alias("earlier"))


def _cells(items: DataFrame, level: int) -> DataFrame:
    """Cells that are not empty after subtraction: (pair, bucket, third, cell, n, rx, dx, hx).

    Items are shuffled once by (pair, bucket); the three cell rows of an item are added
    up where they arise, and cells that cancel never leave the task.
    """
    third = F.ceil(F.greatest(F.lit(LEAST_CELLS), F.ceil(F.col("per_bucket") * CELL_SHARE * ENLARGE**level)) / HASHES)
    placed = items.repartition("pair", "bucket").withColumn("third", third.cast("int"))
    placed = placed.withColumn("h", F.xxhash64("rec", "digest", F.lit(level).cast("long")))
    spots = F.array(*[
        (F.pmod(F.shiftrightunsigned("h", 21 * i).bitwiseAND(F.lit(0x1FFFFF)), F.col("third")) + i * F.col("third")).cast("int")
        for i in range(HASHES)
    ])
    spread = placed.select("pair", "bucket", "third", F.explode(spots).alias("cell"), "rec", "digest", "h", "sign")
    cells = spread.groupBy("pair", "bucket", "third", "cell").agg(
        F.sum("sign").alias("n"), F.bit_xor("rec").alias("rx"), F.bit_xor("digest").alias("dx"), F.bit_xor("h").alias("hx")
    )
    return cells.where((F.col("n") != 0) | (F.col("rx") != 0) | (F.col("dx") != 0) | (F.col("hx") != 0))


_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _xx(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of one long under a seed, for arrays of uint64."""
    h = seed + _P5 + np.uint64(8)
    h = h ^ (_rotl(value * _P2, 31) * _P1)
    h = _rotl(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def item_hash(rec: np.ndarray, digest: np.ndarray, level: int) -> np.ndarray:
    seed = np.full(len(rec), 42, dtype=np.uint64)
    h = _xx(digest.astype(np.uint64), _xx(rec.astype(np.uint64), seed))
    return _xx(np.full(len(rec), level, dtype=np.uint64), h)


def peel(cells: pd.DataFrame, level: int) -> pd.DataFrame:
    """Empty the tables of many (pair, bucket) groups at once.

    One row for each recovered pair of a group that empties, one row with ``failed``
    for a group that doesn't.
    """
    first = np.flatnonzero(np.r_[True, (cells["pair"].to_numpy()[1:] != cells["pair"].to_numpy()[:-1])
                                 | (cells["bucket"].to_numpy()[1:] != cells["bucket"].to_numpy()[:-1])])
    group = np.zeros(len(cells), dtype=np.int64)
    group[first[1:]] = 1
    group = np.cumsum(group)
    third = cells["third"].to_numpy()[first].astype(np.int64)
    start = np.r_[0, np.cumsum(third * HASHES)]
    at = start[group] + cells["cell"].to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(first)), third * HASHES)
    n, rx, dx, hx = np.zeros(start[-1], np.int64), *(np.zeros(start[-1], np.uint64) for _ in range(3))
    n[at] = cells["n"].to_numpy()
    for into, name in ((rx, "rx"), (dx, "dx"), (hx, "hx")):
        into[at] = cells[name].to_numpy().astype(np.int64).view(np.uint64)
    found: list[tuple[np.ndarray, ...]] = []
    look = at
    while len(look):
        look = look[np.abs(n[look]) == 1]
        look = look[item_hash(rx[look], dx[look], level) == hx[look]]
        if not len(look):
            break
        _, one = np.unique(np.stack([owner[look].astype(np.uint64), hx[look]]), axis=1, return_index=True)
        look = look[one]
        g, sign, r, d, h = owner[look], n[look].copy(), rx[look].copy(), dx[look].copy(), hx[look].copy()
        found.append((g, sign, r, d))
        touched = []
        for i in range(HASHES):
            spot = start[g] + i * third[g] + ((h >> np.uint64(21 * i)) & np.uint64(0x1FFFFF)).astype(np.int64) % third[g]
            np.subtract.at(n, spot, sign)
            for into, x in ((rx, r), (dx, d), (hx, h)):
                np.bitwise_xor.at(into, spot, x)
            touched.append(spot)
        look = np.unique(np.concatenate(touched))
    failed = np.zeros(len(first), dtype=bool)
    failed[owner[np.flatnonzero((n != 0) | (rx != 0) | (dx != 0) | (hx != 0))]] = True
    pair, bucket = cells["pair"].to_numpy()[first], cells["bucket"].to_numpy()[first]
    g, sign, r, d = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    ok = ~failed[g]
    g, sign, r, d = g[ok], sign[ok], r[ok], d[ok]
    bad = np.flatnonzero(failed)
    return pd.DataFrame({
        "pair": np.r_[pair[g], pair[bad]],
        "bucket": np.r_[bucket[g], bucket[bad]].astype(np.int32),
        "rec": np.r_[r.astype(np.uint64).view(np.int64), np.zeros(len(bad), np.int64)],
        "digest": np.r_[d.astype(np.uint64).view(np.int64), np.zeros(len(bad), np.int64)],
        "sign": np.r_[sign, np.zeros(len(bad))].astype(np.int32),
        "failed": np.r_[np.zeros(len(g), bool), np.ones(len(bad), bool)],
    })


def _peeler(level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            t = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = (t["pair"].to_numpy() == t["pair"].iloc[-1]) & (t["bucket"].to_numpy() == t["bucket"].iloc[-1])
            held = t[last].reset_index(drop=True)  # a group may go on in the next batch; it has at most its cells
            if not last.all():
                yield peel(t[~last].reset_index(drop=True), level)
        if held is not None:
            yield peel(held, level)

    return run


def _by_full_join(items: DataFrame) -> DataFrame:
    """The exact difference of buckets that no table size emptied."""
    sides = items.groupBy("pair", "bucket", "rec", "digest").agg(F.sum("sign").alias("sign")).where("sign != 0")
    return sides.select("pair", "bucket", "rec", "digest", F.col("sign").cast("int").alias("sign"), F.lit(False).alias("failed"))


def snapshot_changes(records: DataFrame, pairs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pair, label, change) for every record that differs between the two snapshots of a pair.

    ``records``: snapshot string, rec bigint (hash of the record's key), digest bigint
    (hash of its content), label string; one row per snapshot and rec.
    ``pairs``: pair (the later snapshot), earlier.
    change is ``added`` (label of the later snapshot), ``removed`` (label of the earlier
    one) or ``changed`` (label of the later one); a null label comes out as ''.  A snapshot without an earlier one
    gives no rows, and so does an empty table.
    """
    records = materialize(records, "snapshot-records")
    size = records.groupBy("snapshot").agg(F.count(F.lit(1)).alias("n"))
    roles = pairs.select("pair", F.col("pair").alias("snapshot"), F.lit(1).alias("sign")).unionByName(
        pairs.select("pair", F.col("earlier").alias("snapshot"), F.lit(-1).alias("sign"))
    )
    roles = roles.join(size, "snapshot", "left").fillna({"n": 0})
    roles = roles.withColumn("n", F.sum("n").over(Window.partitionBy("pair")))
    roles = roles.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET_RECORDS)).cast("int"))
    roles = materialize(roles, "snapshot-roles")
    items = salted_join(records.select("snapshot", "rec", "digest"), roles, ["snapshot"]).select(
        "pair", F.pmod(F.xxhash64("rec", F.lit(5)), F.col("buckets")).cast("int").alias("bucket"),
        (F.col("n") / F.col("buckets")).alias("per_bucket"), "rec", "digest", "sign",
    )
    found: list[DataFrame] = []
    todo = items
    for level in range(rounds + 1):
        if level < rounds:
            out = _cells(todo, level).sortWithinPartitions("pair", "bucket").mapInPandas(_peeler(level), _PEELED)
        else:
            out = _by_full_join(todo)
        out = materialize(out, "snapshot-difference")
        found.append(out.where(~F.col("failed")))
        failed = out.where("failed").select("pair", "bucket")
        if failed.isEmpty():
            break
        todo = items.join(failed, ["pair", "bucket"], "left_semi")

    differing = found[0]
    for more in found[1:]:
        differing = differing.unionByName(more)
    checked = materialize(_verified(differing, pairs, records), "snapshot-checked")
    # A recovered pair that no record has tells of a wrong recovery: its bucket is compared in full.
    wrong = materialize(checked.where("label is null").select("pair", "bucket").distinct(), "snapshot-wrong")
    if not wrong.isEmpty():
        exact = _by_full_join(items.join(wrong, ["pair", "bucket"], "left_semi"))
        again = _verified(exact, pairs, records)
        checked = materialize(checked.join(wrong, ["pair", "bucket"], "left_anti").unionByName(again), "snapshot-checked")
        if not checked.where("label is null").isEmpty():
            raise AssertionError("a difference of full snapshots has no record")
    return checked.select("pair", "label", "change")


def _verified(differing: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(pair, bucket, change, label): the changed records; label is null where no record of the snapshot has the key hash and digest."""
    both = differing.groupBy("pair", "bucket", "rec").agg(
        F.max(F.when(F.col("sign") > 0, F.col("digest"))).alias("new"), F.max(F.when(F.col("sign") < 0, F.col("digest"))).alias("old")
    )
    both = both.join(pairs, "pair").select(
        "pair", "bucket", "rec",
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("change"),
        F.when(F.col("new").isNull(), F.col("earlier")).otherwise(F.col("pair")).alias("snapshot"),
        F.coalesce("new", "old").alias("digest"),
    )
    known = records.select("snapshot", "rec", "digest", F.coalesce("label", F.lit("")).alias("label"))
    return both.join(known, ["snapshot", "rec", "digest"], "left").select("pair", "bucket", "change", "label")


def content_digest(codes: Column) -> Column:
    """Hash of a set of strings given as an array, whatever its order or repetitions; null is the empty set."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(F.coalesce(codes, F.array().cast("array<string>")))), "\u0001"))
