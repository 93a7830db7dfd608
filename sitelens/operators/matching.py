"""Comparison of two audits of a site: pages by URL, then moved pages by fingerprint."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.fingerprint import bands, hamming
from sitelens.session import materialize

c = F.col
#: Largest Hamming distance of a moved page; rows of one pair that are settled in one task.
MOVED, GROUP_ROWS = 5, 500_000


def side(pages: DataFrame, pairs: DataFrame, role: str) -> DataFrame:
    """Pages of one side of each pair, one per URL (the first crawled): pair, url, seq, fingerprint, codes."""
    own = pairs.select("pair", c("pair" if role == "target" else "earlier").alias("audit_id"))
    rows = pages.join(own, "audit_id")
    return rows.groupBy("pair", "url").agg(F.min(F.struct("crawled_at", "id", "sim_hash", "codes")).alias("p")).select(
        "pair", "url", F.struct("p.crawled_at", "p.id").alias("seq"), c("p.sim_hash").alias("sim_hash"), c("p.codes").alias("codes")
    )


def numbered(df: DataFrame, keys: list[str], coarse: Column, order: list[str], name: str) -> DataFrame:
    """``df`` with its place 1, 2, ... among the rows of its keys.

    ``coarse`` never decreases along ``order``.  Rows are counted per key and coarse value
    first, so a hot key is numbered by as many tasks as it has coarse values.
    """
    t = df.withColumn("__c", coarse)
    before = Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    start = t.groupBy(*keys, "__c").agg(F.count(F.lit(1)).alias("__n")).withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    t = t.join(start.drop("__n"), [*keys, "__c"])
    within = F.row_number().over(Window.partitionBy(*keys, "__c").orderBy(*order))
    return t.withColumn(name, F.col("__start") + within).drop("__c", "__start")


def _moment(seq: str) -> Column:
    """Whole minutes of a place in the crawl order; places without a moment come first, as they do in the order."""
    return F.coalesce(F.floor(F.unix_micros(c(f"{seq}.crawled_at").cast("timestamp")) / 60_000_000), F.lit(-(1 << 40)))


def _in_turn(rows: pd.DataFrame) -> pd.DataFrame:
    """One pair: every target page, in crawl order, takes the first base of its hash's list that is not taken."""
    rows = rows.sort_values(["d", "at", "id"], kind="stable")
    lists: dict[int, list[str]] = {h: x["url"].tolist() for h, x in rows[rows["d"] >= 0].groupby("h")}
    at, taken, found = dict.fromkeys(lists, 0), set(), []
    asking = rows[rows["d"] < 0]
    for h, url in zip(asking["h"], asking["url"]):
        bases, i = lists[h], at[h]
        while i < len(bases) and bases[i] in taken:
            i += 1
        if i < len(bases):
            taken.add(bases[i])
            found.append((url, bases[i]))
        at[h] = i
    return pd.DataFrame({"pair": rows["pair"].iloc[0], "target_url": [t for t, _ in found], "base_url": [b for _, b in found]}, columns=["pair", "target_url", "base_url"])


def nearest(base: DataFrame, target: DataFrame, distance: int = MOVED, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(pair, target_url, base_url): each target page, in crawl order, takes the nearest base page that is left.

    Of equally near bases the first crawled is taken; null hashes match nothing.  Equal
    hashes share one list of bases, found by joining distinct hashes on their bands, so
    pages of one content cost as many rows as there are pages, not their square.

    * A target hash whose bases no other target hash wants is settled by rank: its r-th
      page takes the r-th base of its list.  Any number of equal pages, no loop.
    * What several hashes want is settled pair by pair, in turn, in memory that
      ``group_rows`` bounds; pairs beyond it are settled by ``_by_rounds``.
    """
    pages_t = materialize(target.where("sim_hash is not null").select("pair", c("sim_hash").alias("h"), c("seq").alias("tseq"), c("url").alias("target_url")), "moved-target")
    pages_b = base.where("sim_hash is not null").select("pair", c("sim_hash").alias("g"), c("seq").alias("bseq"), c("url").alias("base_url"))
    banded = lambda df, name: df.select("pair", name).distinct().withColumn("band", F.explode(bands(c(name), distance // 2 + 1)))
    near = banded(pages_t, "h").join(banded(pages_b, "g"), ["pair", "band"]).withColumn("d", hamming(c("h"), c("g"))).where(c("d") <= distance)
    near = materialize(near.select("pair", "h", "g", "d").distinct(), "moved-hashes")
    wanted = near.groupBy("pair", "g").agg(F.count(F.lit(1)).alias("n"))
    alone = near.join(wanted, ["pair", "g"]).groupBy("pair", "h").agg((F.max("n") == 1).alias("alone"))
    lists = near.join(pages_b, ["pair", "g"]).join(alone, ["pair", "h"]).select("pair", "h", "d", "bseq", "base_url", "alone")
    lists = materialize(lists, "moved-lists")
    asking = materialize(pages_t.join(alone, ["pair", "h"]), "moved-asking")

    bases = numbered(lists.where("alone"), ["pair", "h"], F.struct("d", _moment("bseq").alias("m")), ["d", "bseq", "base_url"], "place")
    ranked = numbered(asking.where("alone"), ["pair", "h"], _moment("tseq"), ["tseq", "target_url"], "place")
    settled = ranked.join(bases.select("pair", "h", "place", "base_url"), ["pair", "h", "place"]).select("pair", "target_url", "base_url")

    micros = lambda seq: F.coalesce(F.unix_micros(c(f"{seq}.crawled_at").cast("timestamp")), F.lit(-(1 << 62)))
    rows = lists.where("not alone").select("pair", "h", "d", micros("bseq").alias("at"), c("bseq.id").alias("id"), c("base_url").alias("url")).unionByName(
        asking.where("not alone").select("pair", "h", F.lit(-1).alias("d"), micros("tseq").alias("at"), c("tseq.id").alias("id"), c("target_url").alias("url"))
    )
    sizes = materialize(rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "moved-sizes")
    small = rows.join(sizes.where(c("n") <= group_rows).select("pair"), "pair", "left_semi")
    settled = settled.unionByName(small.groupBy("pair").applyInPandas(_in_turn, "pair string, target_url string, base_url string"))
    large = sizes.where(c("n") > group_rows).select("pair")
    if not large.isEmpty():
        settled = settled.unionByName(_by_rounds(lists.where("not alone").join(large, "pair", "left_semi"), asking.where("not alone").join(large, "pair", "left_semi")))
    return settled


def _by_rounds(lists: DataFrame, asking: DataFrame) -> DataFrame:
    """The same choice without holding a pair in one task.

    It is the only stable matching in which targets prefer the nearest base (then the
    first crawled) and every base the earliest target.  In each round the r-th waiting
    target of a hash asks the r-th base of the list that may still accept it: a better
    one goes to an earlier page of the same hash.  A base keeps the earliest target that
    asked.  Every round moves at least one base to an earlier target, so the rounds end.
    """
    held = lists.sparkSession.createDataFrame([], lists.select("pair", "base_url").schema).withColumns({"tseq": F.lit(None), "target_url": F.lit(None)})
    held = held.select("pair", "base_url", c("tseq").cast(asking.schema["tseq"].dataType), c("target_url").cast("string"))
    while True:
        waiting = asking.join(held.select("pair", "target_url"), ["pair", "target_url"], "left_anti")
        first = waiting.groupBy("pair", "h").agg(F.min("tseq").alias("first"))
        left = lists.join(first, ["pair", "h"]).join(held.select("pair", "base_url", c("tseq").alias("hseq")), ["pair", "base_url"], "left")
        left = materialize(left.where("hseq is null or hseq > first").select("pair", "h", "d", "bseq", "base_url"), "moved-left")
        if left.isEmpty():
            return held.select("pair", "target_url", "base_url")
        asked = numbered(left, ["pair", "h"], F.struct("d", _moment("bseq").alias("m")), ["d", "bseq", "base_url"], "place")
        turn = numbered(waiting, ["pair", "h"], _moment("tseq"), ["tseq", "target_url"], "place")
        calls = turn.join(asked, ["pair", "h", "place"]).select("pair", "base_url", "tseq", "target_url")
        best = held.unionByName(calls).groupBy("pair", "base_url").agg(F.min(F.struct("tseq", "target_url")).alias("x"))
        held = materialize(best.select("pair", "base_url", "x.tseq", "x.target_url"), "moved-held")


def compare(pages: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, kind, url, moved_from, added, removed, persistent): every page of the two audits once.

    ``pages``: audit_id, id, url, crawled_at, sim_hash, codes (array).  Codes of pages
    on both sides are sets; added and removed pages list theirs with repetitions.
    """
    base, target = side(pages, pairs, "base"), side(pages, pairs, "target")
    b = base.select("pair", "url", c("codes").alias("old"))
    t = target.select("pair", "url", c("codes").alias("new"))
    matched = t.join(b, ["pair", "url"]).withColumns({"kind": F.lit("unchanged_url"), "moved_from": F.lit(None).cast("string")})
    rest_t = materialize(target.join(base, ["pair", "url"], "left_anti"), "diff-target")
    rest_b = materialize(base.join(target, ["pair", "url"], "left_anti"), "diff-base")
    moves = materialize(nearest(rest_b, rest_t), "moves")
    moved = moves.join(rest_t.select("pair", c("url").alias("target_url"), c("codes").alias("new")), ["pair", "target_url"]).join(
        rest_b.select("pair", c("url").alias("base_url"), c("codes").alias("old")), ["pair", "base_url"]
    ).select("pair", c("target_url").alias("url"), "new", "old", F.lit("moved").alias("kind"), c("base_url").alias("moved_from"))
    both = matched.select("pair", "url", "new", "old", "kind", "moved_from").unionByName(moved)
    new, old = F.array_distinct("new"), F.array_distinct("old")
    both = both.select("pair", "kind", "url", "moved_from", F.array_except(new, old).alias("added"), F.array_except(old, new).alias("removed"), F.array_intersect(new, old).alias("persistent"))
    none = F.array().cast("array<string>")
    added = rest_t.join(moves.select("pair", c("target_url").alias("url")), ["pair", "url"], "left_anti").select(
        "pair", F.lit("added").alias("kind"), "url", F.lit(None).cast("string").alias("moved_from"), c("codes").alias("added"), none.alias("removed"), none.alias("persistent")
    )
    removed = rest_b.join(moves.select("pair", c("base_url").alias("url")), ["pair", "url"], "left_anti").select(
        "pair", F.lit("removed").alias("kind"), "url", F.lit(None).cast("string").alias("moved_from"), none.alias("added"), c("codes").alias("removed"), none.alias("persistent")
    )
    return both.unionByName(added).unionByName(removed)
