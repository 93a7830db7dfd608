"""Queries of the text and measurement problems, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm import log_sketch, mojibake, near_duplicates, packing, residue, spam, tokens
from sitelens.session import table

QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similar_pages(table(spark, d, "pages"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.similarity_classes(table(spark, d, "pages"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of response_time and body_size per audit."""
    keys = ["audit_id", "metric"]
    m = log_sketch.page_measures(table(spark, d, "pages"))
    return log_sketch.percentiles(log_sketch.sketch(m, keys, m["value"]), keys, QUANTILES)


def p4_merged_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from one sketch per day of crawling, merged."""
    keys = ["audit_id", "metric"]
    m = log_sketch.page_measures(table(spark, d, "pages"))
    daily = log_sketch.sketch(m, [*keys, "day"], m["value"])
    return log_sketch.percentiles(log_sketch.merge(keys, daily), keys, QUANTILES)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_fields(table(spark, d, "pages"))


def p5_real_texts(spark: SparkSession, d: str) -> DataFrame:
    """Titles and descriptions that are no residue."""
    return residue.real_texts(table(spark, d, "pages"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled_fields(table(spark, d, "pages"))


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """Garbled fields with their original text, null where it is lost."""
    return mojibake.restored_fields(table(spark, d, "pages"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from their ids."""
    return tokens.decode(tokens.encode(table(spark, d, "documents")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document in a container of 2,048 tokens."""
    return packing.pack(tokens.token_counts(table(spark, d, "documents")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_documents(table(spark, d, "documents"))


QUERIES = {
    "p3_found": p3_found, "p3_classes": p3_classes, "p4_percentiles": p4_percentiles, "p4_merged_days": p4_merged_days,
    "p5_found": p5_found, "p5_real_texts": p5_real_texts, "p6_found": p6_found, "p6_restored": p6_restored,
    "p7_ids": p7_ids, "p7_decoded": p7_decoded, "p8_containers": p8_containers, "p9_found": p9_found,
}

_P3 = """
with p as (select distinct id, audit_id, title, meta_description from pages
           where id is not null and audit_id is not null and regexp_matches(title, '[^\\s\\p{Z}]') and meta_description is not null),
w as (select id, audit_id, list_distinct(list_filter(regexp_split_to_array(lower(meta_description), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '')) as d,
             list_filter(regexp_split_to_array(lower(title), '[^\\p{L}\\p{Nd}]+'), lambda x: x <> '') as t from p),
s as (select id, audit_id, list_distinct(d || t) as ws from w where len(d) >= 15),
tok as (select id, audit_id, unnest(ws) as x from s),
common as (select a.id as ia, b.id as ib, count(*) as c from tok a join tok b on a.audit_id = b.audit_id and a.x = b.x and a.id < b.id group by all),
pairs as (select ia, ib from common join s sa on sa.id = ia join s sb on sb.id = ib where c / (len(sa.ws) + len(sb.ws) - c) >= 0.7 - 1e-9)
"""
_P4 = """
with p as (select distinct id, audit_id, response_time, body_size from pages),
m as (select audit_id, 'response_time' as metric, response_time as v from p union all select audit_id, 'body_size', cast(body_size as double) from p),
b as (select audit_id, metric, sign(v) as s, case when v = 0 then 0 else ceil(ln(abs(v)) / ln(1.01 / 0.99)) end as i
      from m where v is not null and not isnan(v) and not isinf(v)),
g as (select audit_id, metric, s, i, count(*) as n from b group by all),
c as (select *, sum(n) over (partition by audit_id, metric order by s, s * i rows unbounded preceding) as cum,
             sum(n) over (partition by audit_id, metric) as total,
             case when s = 0 then 0 else s * 2 * pow(1.01 / 0.99, i) / (1.01 / 0.99 + 1) end as est from g)
select audit_id, metric, cast(sum(n) as bigint) as n,
  max(case when floor(0.5 * (total - 1)) >= cum - n and floor(0.5 * (total - 1)) < cum then est end) as p50,
  max(case when floor(0.9 * (total - 1)) >= cum - n and floor(0.9 * (total - 1)) < cum then est end) as p90,
  max(case when floor(0.95 * (total - 1)) >= cum - n and floor(0.95 * (total - 1)) < cum then est end) as p95,
  max(case when floor(0.99 * (total - 1)) >= cum - n and floor(0.99 * (total - 1)) < cum then est end) as p99
from c group by audit_id, metric"""

SQL = {
    "p3_found": _P3 + "select ia as page_id_a, ib as page_id_b from pairs",
    "p3_classes": _P3 + """, cls as (select id, min(id) over (partition by audit_id, list_sort(ws)) as class_id from s),
        bi as (select ia, ib from pairs union all select ib, ia from pairs)
        select c.id as page_id, c.class_id, count(o.id) as n_links from cls c left join bi on bi.ia = c.id
        left join cls o on o.id = bi.ib and o.class_id <> c.class_id group by all""",
    "p4_percentiles": _P4,
    "p4_merged_days": _P4,
    "p7_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
