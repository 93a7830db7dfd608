"""Audits of a site against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.urls import host, part
from sitelens.operators.matching import compare, nearest, side
from sitelens.operators.snapshots import consecutive
from sitelens.plans.site_history import completed_audits
from sitelens.sources import relations
from sitelens.sources.relations import SQL as BASE

c = F.col


def previous_audits(audits: DataFrame) -> DataFrame:
    """(id, previous_id): the newest other completed audit whose seed begins with this audit's host.

    The comparison is by prefix, so a longer host that begins alike counts too; the
    prefixes of each seed's authority are joined by equality, and each keeps its two
    newest audits only.
    """
    authority = F.lower(part(c("seed_url"), 2))
    done = audits.where((c("status") == "completed") & part(c("seed_url"), 1).rlike("^(?i:https?)$") & (authority != ""))
    done = done.select(c("id").alias("other"), "completed_at", F.explode(F.transform(F.sequence(F.lit(1), F.length(authority)), lambda i: F.substring(authority, F.lit(1), i))).alias("host"))
    newest = done.groupBy("host").agg(F.max(F.struct("completed_at", "other")).alias("first"))
    second = done.join(newest, "host").where(c("other") != c("first.other")).groupBy("host").agg(F.max(F.struct("completed_at", "other")).alias("second"))
    top = newest.join(second, "host", "left")
    own = audits.select("id", host(c("seed_url")).alias("host"))
    hit = own.join(top, "host").select("id", F.when(c("first.other") != c("id"), c("first.other")).otherwise(c("second.other")).alias("previous_id"))
    return hit.where("previous_id is not null")


def previous_audit(spark: SparkSession, d: str) -> DataFrame:
    return previous_audits(relations.audits(spark, d))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    codes = relations.issues(spark, d, "page_id", "code").groupBy(c("page_id").alias("id")).agg(F.array_sort(F.collect_list("code")).alias("codes"))
    p = relations.pages(spark, d, "url", "crawled_at", "sim_hash").join(codes, "id", "left")
    return p.withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return consecutive(completed_audits(relations.audits(spark, d)))


def _text(name: str):
    return F.array_join(F.array_sort(name), ",").alias(name)


def diff_by_url(spark: SparkSession, d: str) -> DataFrame:
    """Pages on both sides under one URL, with their added, removed and persistent codes."""
    pages, pairs = _pages(spark, d), _pairs(spark, d)
    b = side(pages, pairs, "base").select("pair", "url", F.array_distinct("codes").alias("old"))
    t = side(pages, pairs, "target").select("pair", "url", F.array_distinct("codes").alias("new"))
    both = t.join(b, ["pair", "url"])
    return both.select("pair", "url", F.array_except("new", "old").alias("added"), F.array_except("old", "new").alias("removed"), F.array_intersect("new", "old").alias("persistent")).select(
        "pair", "url", _text("added"), _text("removed"), _text("persistent")
    )


def diff_moved(spark: SparkSession, d: str) -> DataFrame:
    """Pages that moved to another URL with nearly the same content."""
    out = compare(_pages(spark, d), _pairs(spark, d)).where("kind = 'moved'")
    return out.select("pair", "url", "moved_from", _text("added"), _text("removed"), _text("persistent"))


def diff_issue_changes(spark: SparkSession, d: str) -> DataFrame:
    """Per pair and code, on how many pages it came, went or stayed; moved pages included."""
    out = compare(_pages(spark, d), _pairs(spark, d))
    rows = [out.select("pair", F.lit(k).alias("change"), F.explode(k).alias("code")) for k in ("added", "removed", "persistent")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy("pair", "code", "change").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (previous_audit, diff_by_url, diff_moved, diff_issue_changes)}

_PAIRS = """, h as (select id, completed_at as ts, lower(regexp_extract(seed_url, '^[A-Za-z]+://([^/?#:]+)', 1)) as host from a where status = 'completed' and completed_at is not null),
    pr as (select l.id as pair, arg_max(e.id, e.ts) as earlier from h l join h e on e.host = l.host and e.ts < l.ts group by l.id),
    cd as (select page_id, list(code order by code) as codes from i group by 1),
    pg as (select p.audit_id, p.url, arg_min(coalesce(cd.codes, []), (p.crawled_at, p.id)) as codes from p left join cd on cd.page_id = p.id group by all)"""
_LISTS = """array_to_string(list_sort(list_filter({x}.codes, lambda v: not list_contains({y}.codes, v))), ',')"""
# The one-after-the-other choice: each step takes the next target page of a pair and appends the first of its bases that is not taken.
_MOVED = BASE.replace("with p as", "with recursive p as", 1) + _PAIRS.replace("as codes from p left join", "as codes, arg_min((p.crawled_at, p.id, p.sim_hash), (p.crawled_at, p.id)) as s from p left join") + """,
    nt as (select pr.pair, t.url, t.codes, t.s[1] as ts, t.s[2] as id, t.s[3] as h from pr join pg t on t.audit_id = pr.pair
           where not exists (from pg b where b.audit_id = pr.earlier and b.url = t.url)),
    nb as (select pr.pair, b.url, b.codes, b.s[1] as ts, b.s[2] as id, b.s[3] as h from pr join pg b on b.audit_id = pr.earlier
           where not exists (from pg t where t.audit_id = pr.pair and t.url = b.url)),
    wish as (select nt.pair, nt.url, any_value(nt.ts) as ts, any_value(nt.id) as id, list(nb.url order by bit_count(xor(nt.h, nb.h)), nb.ts, nb.id) as bases
             from nt join nb on nb.pair = nt.pair and bit_count(xor(nt.h, nb.h)) <= 5 group by nt.pair, nt.url),
    turn as (select *, row_number() over (partition by pair order by ts, id) as k from wish),
    step as (select pair, 0::bigint as k, []::varchar[] as taken, null::varchar as url, null::varchar as base from (select distinct pair from turn)
             union all select t.pair, t.k, case when x.b is null then s.taken else list_append(s.taken, x.b) end, t.url, x.b from step s join turn t on t.pair = s.pair and t.k = s.k + 1,
             lateral (select list_filter(t.bases, lambda v: not list_contains(s.taken, v))[1] as b) x),
    mv as (select pair, url, base from step where base is not null)"""
_ADDED, _REMOVED = _LISTS.format(x="t", y="b"), _LISTS.format(x="b", y="t")
SQL = {
    "diff_moved": _MOVED + f""" select mv.pair, mv.url, mv.base as moved_from, {_ADDED.replace('t.codes', 'list_distinct(t.codes)', 1)} as added, {_REMOVED.replace('b.codes', 'list_distinct(b.codes)', 1)} as removed,
        {_ADDED.replace('t.codes', 'list_distinct(t.codes)', 1).replace('not ', '')} as persistent
        from mv join nt t on t.pair = mv.pair and t.url = mv.url join nb b on b.pair = mv.pair and b.url = mv.base""",
    "diff_issue_changes": _MOVED + """, pv as (select pr.pair, t.codes as n, b.codes as o from pr join pg t on t.audit_id = pr.pair join pg b on b.audit_id = pr.earlier and b.url = t.url
        union all select mv.pair, t.codes, b.codes from mv join nt t on t.pair = mv.pair and t.url = mv.url join nb b on b.pair = mv.pair and b.url = mv.base),
        rows as (select pair, 'added' as change, unnest(list_filter(list_distinct(n), lambda v: not list_contains(o, v))) as code from pv
        union all select pair, 'removed', unnest(list_filter(list_distinct(o), lambda v: not list_contains(n, v))) from pv
        union all select pair, 'persistent', unnest(list_filter(list_distinct(n), lambda v: list_contains(o, v))) from pv
        union all select pair, 'added', unnest(codes) from nt where not exists (from mv where mv.pair = nt.pair and mv.url = nt.url)
        union all select pair, 'removed', unnest(codes) from nb where not exists (from mv where mv.pair = nb.pair and mv.base = nb.url))
        select pair, code, change, count(*) as n from rows group by all""",
    "previous_audit": BASE + """, n as (select id, lower(regexp_extract(seed_url, '^[A-Za-z]+://([^/?#:]+)', 1)) as host from a),
        o as (select id as oid, lower(seed_url) as s, completed_at from a where status = 'completed')
        select n.id, arg_max(o.oid, (o.completed_at, o.oid)) as previous_id from n join o on o.oid <> n.id
        and (starts_with(o.s, 'http://' || n.host) or starts_with(o.s, 'https://' || n.host)) group by n.id""",
    "diff_by_url": BASE + _PAIRS + """ select pr.pair, t.url,
        array_to_string(list_sort(list_filter(list_distinct(t.codes), lambda v: not list_contains(b.codes, v))), ',') as added,
        array_to_string(list_sort(list_filter(list_distinct(b.codes), lambda v: not list_contains(t.codes, v))), ',') as removed,
        array_to_string(list_sort(list_filter(list_distinct(t.codes), lambda v: list_contains(b.codes, v))), ',') as persistent
        from pr join pg t on t.audit_id = pr.pair join pg b on b.audit_id = pr.earlier and b.url = t.url""",
}
