"""Near-duplicate word sets inside a group, joined exactly.

Prefix filtering: with the words of every set put in one order, rare words first, two
sets of similarity t share a word among the first ``len - ceil(t*len) + 1`` of each.
A word that is still frequent in its group makes a poor join key, so it is extended
by the next shared words to an n-gram until the n-gram is expected to be rare; a pair
that shares the n-gram's first word in that way also shares the n-gram.  The number of
n-grams of a set is bounded (``MOST_KEYS``): long sets stop at a smaller n.  Joined pairs
pass a length filter, a positional filter and a bit-parallel suffix filter before the
distinct survivors are verified, once each, on their whole word sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.session import materialize

#: Buckets of the word and group frequency tables: their size, not the corpus, bounds what is sent around.
BUCKETS = 1 << 16
#: An n-gram expected in more sets of its group than this is extended, up to MAX_N words.
RARE, MAX_N = 24, 4
#: n stays so small that a set has at most this many n-grams of frequent words at its largest n.
MOST_KEYS = 2_000
#: A key expected in more than BLOCK sets is split in up to MOST_BLOCKS blocks that meet two by two.
BLOCK, MOST_BLOCKS = 2_000, 64
_KEYS = "key bigint, rid bigint, info bigint, sig bigint"


def word_set(text: Column) -> Column:
    """Distinct maximal runs of letters or digits in lower case; null gives an empty array."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+")
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _levels(t: float, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(cap, least): by length of a set, its largest n and the smallest largest n of a set that may be similar to it.

    Similar sets share at least ceil(t * length) words, so n never exceeds that.  Where
    two caps differ, the set with the larger one also emits the n-grams at which the
    other stops, so a similar pair always meets.
    """
    length = np.arange(longest + 1)
    need = np.ceil(t * length - 1e-9).astype(np.int64)
    cap = np.ones(longest + 1, dtype=np.int64)
    for n in range(2, MAX_N + 1):
        grams = np.array([math.comb(int(x), n) for x in length - need + n])
        cap[(need >= n) & (grams <= MOST_KEYS) & (cap == n - 1)] = n
    last = np.minimum(np.floor(length / t + 1e-9).astype(np.int64), longest)
    least = np.array([cap[need[x] : max(last[x], need[x]) + 1].min() for x in length])
    return cap, least


def prefix_keys(rid: np.ndarray, group: np.ndarray, offsets: np.ndarray, words: np.ndarray, share: np.ndarray, sizes: np.ndarray, t: float):
    """Join keys of a batch of sets: (key, rid, info, sig).

    info packs length, side, last position and n.  A key expected in many sets is split:
    each set belongs to one block of it and emits one key per block, for the cell in
    which the two blocks meet; side tells the lower block (1) from the higher (2), and
    0 marks the cell in which a block meets itself.  How often a key is expected follows
    from its words and group alone, so all sets agree on the blocks.
    """
    lens = np.diff(offsets).astype(np.int64)
    rec = np.repeat(np.arange(len(rid)), lens)
    w = words.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF)
    freq = share[(w & np.uint64(BUCKETS - 1)).astype(np.int64)]
    order = np.lexsort((w, freq, rec))
    w, freq = w[order], freq[order]
    start = np.r_[0, np.cumsum(lens)][:-1]
    sig = np.zeros(len(rid), dtype=np.uint64)
    np.bitwise_or.at(sig, rec, np.uint64(1) << ((w >> np.uint64(20)) & np.uint64(63)))
    size = sizes[(group.astype(np.int64) & (BUCKETS - 1))].astype(np.float64)
    spare = lens - np.ceil(t * lens - 1e-9).astype(np.int64)  # words of a set that need not be shared
    # n = 1: every word of the prefix
    reach = np.minimum(spare + 1, lens)
    r = np.repeat(np.arange(len(rid)), reach)
    pos = np.arange(len(r)) - np.repeat(np.cumsum(reach) - reach, reach)
    h = _mix(group.astype(np.int64).view(np.uint64)[r] ^ _mix(w[start[r] + pos]))
    est = size[r] * freq[start[r] + pos]
    out = []
    # A power of two above the longest possible partner, so that few tables are made.
    cap, least = _levels(t, 1 << max(8, int(lens.max(initial=1) / t + 2).bit_length()))
    for n in range(1, MAX_N + 1):
        done = (est <= RARE) | (n >= cap[lens[r]])
        met = done | (n >= least[lens[r]])
        out.append((h[met], r[met], pos[met], np.full(int(met.sum()), n), est[met]))
        r, pos, h, est = r[~done], pos[~done], h[~done], est[~done]
        if not len(r):
            break
        more = np.maximum(np.minimum(spare[r] + n + 1, lens[r]) - pos - 1, 0)
        base = np.repeat(np.cumsum(more) - more, more)
        nxt = np.repeat(pos, more) + 1 + np.arange(int(more.sum())) - base
        r, h, est = (np.repeat(x, more) for x in (r, h, est))
        pos = nxt
        h = _mix(h * np.uint64(31) ^ _mix(w[start[r] + pos]))
        est = est * freq[start[r] + pos]
    h, r, pos, n, est = (np.concatenate(x) for x in zip(*out))
    blocks = np.clip(np.ceil(est / BLOCK), 1, MOST_BLOCKS).astype(np.int64)
    again = np.repeat(np.arange(len(h)), blocks)
    other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    h, r, pos, n, blocks = (x[again] for x in (h, r, pos, n, blocks))
    own = (_mix(rid.astype(np.int64).view(np.uint64)[r]) % blocks.astype(np.uint64)).astype(np.int64)
    side = np.where(own == other, 0, np.where(own < other, 1, 2))
    cell = np.minimum(own, other) * MOST_BLOCKS + np.maximum(own, other)
    h = np.where(blocks > 1, _mix(h ^ _mix(cell.astype(np.uint64) + np.uint64(1))), h)
    info = (lens[r] << 26) | (side << 24) | (pos << 4) | n
    return h.view(np.int64), rid[r], info, sig.view(np.int64)[r]


def _key_maker(share: np.ndarray, sizes: np.ndarray, t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(2)
            off = lists.offsets.to_numpy()
            k, rid, info, sig = prefix_keys(
                b.column(0).to_numpy(), b.column(1).to_numpy(), off - off[0], lists.flatten().to_numpy(zero_copy_only=False), share, sizes, t
            )
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, rid, info, sig)], names=["key", "rid", "info", "sig"])

    return run


def _bucket_counts(column: DataFrame) -> np.ndarray:
    """Counts of the bucket numbers in a one-column table; at most BUCKETS rows reach the driver."""
    counts = np.zeros(BUCKETS)
    for b, n in column.groupBy("b").count().collect():
        counts[b] = n
    return counts


def similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """(rid_a, rid_b) with rid_a < rid_b: all pairs of one group with Jaccard similarity >= threshold.

    ``sets``: rid bigint (unique), grp bigint, toks array<int> (32-bit word hashes,
    distinct).  Empty sets are similar to nothing.  Two different words of one pair
    share a hash with a chance below one in a million, which alone can move a
    similarity by one word.
    """
    sets = sets.where(F.size("toks") > 0).select("rid", "grp", "toks")
    n = max(1, sets.count())
    share = _bucket_counts(sets.select(F.explode("toks").alias("x")).select(F.col("x").bitwiseAND(F.lit(BUCKETS - 1)).alias("b"))) / n
    sizes = _bucket_counts(sets.select(F.col("grp").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")))
    keys = sets.mapInArrow(_key_maker(share.astype(np.float32), sizes, threshold), _KEYS)
    # No fixed number of partitions: adaptive execution may then split a partition that correlated words made large.
    a, b = keys.alias("a"), keys.alias("b")
    length = lambda s: F.shiftright(F.col(f"{s}.info"), 26)
    after = lambda s: length(s) - 1 - F.shiftright(F.col(f"{s}.info"), 4).bitwiseAND(F.lit(0xFFFFF))
    need = F.ceil((length("a") + length("b")) * (threshold / (1 + threshold)) - 1e-9)
    side = lambda s: F.shiftright(F.col(f"{s}.info"), 24).bitwiseAND(F.lit(3))
    meet = ((side("a") == 0) & (side("b") == 0)) | (side("a") + side("b") == 3)
    ngram = F.col("a.info").bitwiseAND(F.lit(15))
    pairs = a.join(
        b,
        (F.col("a.key") == F.col("b.key")) & (F.col("a.rid") < F.col("b.rid")) & meet
        & (F.least(length("a"), length("b")) >= threshold * F.greatest(length("a"), length("b")) - 1e-9)
        & (ngram + F.least(after("a"), after("b")) >= need)
        & (F.bit_count(F.col("a.sig").bitwiseXOR(F.col("b.sig"))) <= length("a") + length("b") - 2 * need),
    ).select(F.col("a.rid").alias("rid_a"), F.col("b.rid").alias("rid_b")).distinct()
    left = sets.select(F.col("rid").alias("rid_a"), F.col("grp").alias("ga"), F.col("toks").alias("ta"))
    right = sets.select(F.col("rid").alias("rid_b"), F.col("grp").alias("gb"), F.col("toks").alias("tb"))
    both = pairs.join(left, "rid_a").join(right, "rid_b")
    common = F.size(F.array_intersect("ta", "tb"))
    enough = F.ceil((F.size("ta") + F.size("tb")) * (threshold / (1 + threshold)) - 1e-9)
    return both.where((F.col("ga") == F.col("gb")) & (common >= enough)).select("rid_a", "rid_b")


def page_sets(pages: DataFrame, least_words: int = 15) -> DataFrame:
    """(id, audit_id, rid, grp, toks) of pages with a non-blank title and enough distinct description words.

    ``rid`` names the class of pages of one audit with the same word set.
    Pages with a null id or audit, a null or blank title or a short description are left out.
    """
    known = pages.select("id", "audit_id", "title", "meta_description").where(
        F.col("id").isNotNull() & F.col("audit_id").isNotNull() & F.col("title").rlike(r"(?U)\S") & F.col("meta_description").isNotNull()
    )
    described = known.withColumn("d", word_set(F.col("meta_description"))).where(F.size("d") >= least_words)
    words = F.array_union(F.col("d"), word_set(F.col("title")))
    hashed = F.array_sort(F.array_distinct(F.transform(words, lambda w: F.hash(w))))
    return described.select("id", "audit_id", F.xxhash64("audit_id").alias("grp"), hashed.alias("toks")).select(
        "id", "audit_id", F.xxhash64("audit_id", "toks").alias("rid"), "grp", "toks"
    )


def page_classes(pages: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members, links): pages by class of equal word sets, and the similar pairs of classes."""
    every = materialize(page_sets(pages), "word-sets")
    members = every.select("id", "audit_id", "rid").distinct()
    classes = materialize(every.select("rid", "grp", "toks").dropDuplicates(["rid"]), "word-set-classes")
    return members, similar_sets(classes, threshold)


def similar_pages(pages: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(page_id_a, page_id_b), the smaller first: all similar pages of one audit."""
    members, links = page_classes(pages, threshold)
    a = members.select(F.col("id").alias("ia"), F.col("audit_id").alias("aa"), F.col("rid").alias("rid_a"))
    b = members.select(F.col("id").alias("ib"), F.col("audit_id").alias("ab"), F.col("rid").alias("rid_b"))
    across = links.join(a, "rid_a").join(b, "rid_b").where("aa = ab")
    same = a.join(b, (F.col("rid_a") == F.col("rid_b")) & (F.col("aa") == F.col("ab")) & (F.col("ia") < F.col("ib")))
    both = across.select("ia", "ib").unionByName(same.select("ia", "ib")).where("ia <> ib")
    return both.select(F.least("ia", "ib").alias("page_id_a"), F.greatest("ia", "ib").alias("page_id_b"))


def similarity_classes(pages: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(page_id, class_id, n_links): one row per page; n_links counts the pages of other classes it is similar to."""
    members, links = page_classes(pages, threshold)
    sizes = materialize(members.groupBy("rid").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")), "class-sizes")
    both = links.select(F.col("rid_a").alias("rid"), F.col("rid_b").alias("other")).unionByName(
        links.select(F.col("rid_b").alias("rid"), F.col("rid_a").alias("other"))
    )
    linked = both.join(sizes.select(F.col("rid").alias("other"), "n"), "other").groupBy("rid").agg(F.sum("n").alias("n_links"))
    known = sizes.select("rid", "class_id").join(linked, "rid", "left")
    return members.join(known, "rid").select(F.col("id").alias("page_id"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
