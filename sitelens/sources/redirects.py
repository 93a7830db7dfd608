"""Redirect chains from single recorded redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.session import materialize

#: Fixed value: hops followed at the most.
MAX_HOPS = 10


def redirect_chains(redirects: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(audit_id, start, n_hops, final, statuses): the way from every URL that nothing redirects to.

    ``redirects``: audit_id, from_url, to_url, status_code; of several redirects of a
    URL the smallest target counts.  A chain ends at a URL without a redirect or after
    ``max_hops``; loops without an outside start have no chain.
    """
    step = redirects.groupBy("audit_id", "from_url").agg(F.min(F.struct("to_url", "status_code")).alias("r")).select(
        "audit_id", F.col("from_url").alias("at"), F.col("r.to_url").alias("to_url"), F.col("r.status_code").alias("status")
    )
    step = materialize(step, "redirect-steps")
    starts = step.join(step.select("audit_id", F.col("to_url").alias("at")), ["audit_id", "at"], "left_anti").select("audit_id", "at")
    open_ = starts.select("audit_id", F.col("at").alias("start"), "at", F.lit(0).alias("n_hops"), F.lit("").alias("statuses"))
    done = None
    for hop in range(max_hops):
        moved = open_.join(step, ["audit_id", "at"], "left")
        moved = materialize(moved, "redirect-walk")
        ended = moved.where("to_url is null").select("audit_id", "start", "at", "n_hops", "statuses")
        done = ended if done is None else done.unionByName(ended)
        open_ = moved.where("to_url is not null").select(
            "audit_id", "start", F.col("to_url").alias("at"), (F.col("n_hops") + 1).alias("n_hops"), F.concat_ws(" ", F.nullif("statuses", F.lit("")), F.col("status").cast("string")).alias("statuses")
        )
        if open_.isEmpty():
            break
    every = done.unionByName(open_) if done is not None else open_
    return every.select("audit_id", "start", "n_hops", F.col("at").alias("final"), "statuses")
