"""Tenants, users, access decisions and diagnostics, on tables made from nations, customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tenancy as G
from ..registry import query, table


def tenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 1, "deleted").otherwise("active").alias("status"), F.lit(100).alias("quota"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    until = F.when(F.col("c_custkey") % 10 == 0, F.lit("2020-01-01").cast("date"))
    return c.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("tenant_id"), F.when(F.col("c_mktsegment") == "BUILDING", "admin").otherwise("user").alias("role"), F.concat(F.lit("key"), F.col("c_custkey").cast("string")).alias("api_key"), until.alias("expires_at"))


@query("""
with r as (select o_orderkey, case when o_orderkey % 11 = 0 then '/static/app.js' when o_orderkey % 13 = 0 then '/api/v1/health' else '/api/v1/query' end as path, case when o_orderkey % 7 = 0 then null when o_orderkey % 17 = 0 then 'Bearer ' when o_orderkey % 19 = 0 then 'Bearer nokey' else 'Bearer key' || o_custkey end as auth, case when o_orderkey % 5 = 0 then 3 end as tenant, o_custkey from orders),
j as (select r.*, c_nationkey as own, c_mktsegment = 'BUILDING' as admin, coalesce(tenant, c_nationkey) as t, c_custkey from r left join customer on auth = 'Bearer key' || c_custkey), k as (select j.*, n_regionkey from j left join nation on n_nationkey = t),
d as (select *, case when o_orderkey % 11 = 0 or o_orderkey % 13 = 0 then 'open' when auth is null then 'no sign-in' when auth = 'Bearer ' then 'empty key' when c_custkey is null then 'unknown key' when c_custkey % 10 = 0 then 'expired key' when t <> own and not admin then 'other tenant' when coalesce(n_regionkey, 1) = 1 then 'inactive tenant' else 'granted' end as reason from k)
select o_orderkey as request_id, case when reason <> 'open' then t end::bigint as tenant_id, case when reason in ('open', 'granted') then 200 when reason in ('other tenant', 'inactive tenant') then 403 else 401 end::int as status, reason from d
""")
def access_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-04, G-09: what the gate before every route decides."""
    k = F.col("o_orderkey")
    path = F.when(k % 11 == 0, "/static/app.js").when(k % 13 == 0, "/api/v1/health").otherwise("/api/v1/query")
    auth = F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 17 == 0, "Bearer ").when(k % 19 == 0, "Bearer nokey").otherwise(F.concat(F.lit("Bearer key"), F.col("o_custkey").cast("string")))
    asked = table(spark, sf_dir, "orders").select(k.alias("request_id"), path.alias("path"), auth.alias("authorization"), F.when(k % 5 == 0, "3").alias("tenant"))
    as_text = lambda df: df.withColumn("tenant_id", F.col("tenant_id").cast("string"))
    judged = G.access(asked, as_text(users(spark, sf_dir)), as_text(tenants(spark, sf_dir)), F.lit("2024-01-01").cast("date"))
    return judged.withColumn("tenant_id", F.col("tenant_id").cast("long"))


@query("""
with t as (select n_nationkey, n_regionkey, case when n_nationkey = 2 then 'renamed' else n_name end as name, case when n_regionkey = 2 then 'deleted' when n_regionkey = 1 and n_nationkey % 2 = 1 then 'active' when n_regionkey = 1 then 'deleted' else 'active' end as status from nation), u as (select c_nationkey, count(*) as n from customer join nation on c_nationkey = n_nationkey where n_regionkey <> 2 group by c_nationkey)
select n_nationkey as tenant_id, name, status, coalesce(n, 0) as users from t left join u on c_nationkey = n_nationkey where n_regionkey <> 3
""")
def tenant_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-01: tenants marked, taken out, made active again and renamed, and their users."""
    all_tenants, all_users = tenants(spark, sf_dir), users(spark, sf_dir)
    regions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tenant_id"), "n_regionkey")
    soft, rest = G.delete_tenants(all_tenants, all_users, regions.where("n_regionkey = 2"))
    hard, rest = G.delete_tenants(soft, rest, regions.where("n_regionkey = 3"), hard=True)
    again = G.reactivate(hard, regions.where("n_regionkey = 1 and tenant_id % 2 = 1"))
    changes = spark.createDataFrame([(2, "name", "renamed"), (2, "tenant_id", "99"), (4, "secret", "x")], "tenant_id long, field string, value string")
    named = G.update(again.withColumn("tenant_id", F.col("tenant_id").cast("long")), "tenant_id", changes, G.TENANT_FIELDS)
    count = rest.groupBy(F.col("tenant_id").cast("long").alias("tenant_id")).agg(F.count("*").alias("users"))
    return named.join(count, "tenant_id", "left").select("tenant_id", "name", "status", F.coalesce("users", F.lit(0)).alias("users"))


@query("""
with w as (select s_suppkey, 'name' || (s_suppkey % 40) as name from supplier), f as (select name, min(s_suppkey) as k from w group by name)
select s_suppkey as user_id, name, s_suppkey = k and name not in (select 'name' || n_nationkey from nation) as accepted from w join f using (name)
""")
def user_creation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-02: names are unique over all tenants."""
    wanted = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("user_id"), F.concat(F.lit("name"), (F.col("s_suppkey") % 40).cast("string")).alias("name"))
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("name"), F.col("n_nationkey").cast("string")).alias("name"))
    return G.create_users(known, wanted)


@query("""
with u as (select n_nationkey, 'user' || (n_nationkey % 20) as name, 'pass' || (n_nationkey % 10) as password from nation), a as (select s_suppkey, 'user' || (s_suppkey % 30) as name, 'pass' || (s_suppkey % 3) as password from supplier), m as (select s_suppkey, count(n_nationkey) as n, min(n_nationkey) as k from a left join u using (name, password) group by s_suppkey)
select s_suppkey as attempt_id, case when n = 1 then k end as user_id, case when n = 1 then 'ok' when n > 1 then 'ambiguous' else 'refused' end as outcome from m
""")
def sign_in_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-03, F-69: sign-in by salted hashes; what fits several users is refused."""
    text = lambda lead, c, n: F.concat(F.lit(lead), (F.col(c) % n).cast("string"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("user_id"), text("user", "n_nationkey", 20).alias("name"), text("pass", "n_nationkey", 10).alias("password"), F.md5("n_name").alias("salt"))
    known = n.withColumn("hash", G.password_hash(F.col("password"), F.col("salt"), 20)).drop("password")
    tried = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("attempt_id"), text("user", "s_suppkey", 30).alias("name"), text("pass", "s_suppkey", 3).alias("password"))
    return G.sign_in(tried, known, 20)


@query("""
with u as (select c_custkey, c_nationkey = 4 as new from customer), s as (select o_custkey, count(*) as n from orders group by o_custkey)
select c_custkey as user_id, case when new then 'sk-' || substr(sha256('secret' || c_custkey), 1, 48) else 'key' || c_custkey end as api_key, case when new then 0 else coalesce(n, 0) end::bigint as sessions from u left join s on o_custkey = c_custkey
""")
def key_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-03, F-69: new keys, and the sessions that end with the old ones."""
    everyone = users(spark, sf_dir)
    sessions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey")
    changed, left = G.rotate_keys(everyone, sessions, everyone.where("tenant_id = 4"), F.concat(F.lit("secret"), F.col("user_id").cast("string")))
    return changed.join(left.groupBy("user_id").agg(F.count("*").alias("sessions")), "user_id", "left").select("user_id", "api_key", F.coalesce("sessions", F.lit(0)).alias("sessions"))


@query("""
with d as (select doc_id from documents), p as (select conv_id, count(*) as pages, count(*) filter (trim(coalesce(text, '')) = '') as empty_pages, count(distinct role) as sections from conversations group by conv_id), c as (select conv_id, count(*) as chunks, count(distinct turn) as covered from conversations where length(text) > 100 group by conv_id)
select doc_id, coalesce(pages, 0) as pages, coalesce(empty_pages, 0) as empty_pages, coalesce(sections, 0) as sections, coalesce(chunks, 0) as chunks, greatest(coalesce(pages, 0) - coalesce(covered, 0), 0) as uncovered,
  case when coalesce(pages, 0) = 0 then 'no pages' when coalesce(chunks, 0) = 0 then 'not indexed' when empty_pages * 2 > pages then 'mostly empty' when sections = 0 then 'no structure' else 'fine' end as state
from d left join p on p.conv_id = doc_id left join c on c.conv_id = doc_id
""")
def document_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G-06: what a knowledge base holds of each document, and what is amiss."""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_num"), F.col("role").alias("section_path"), F.col("text").alias("raw_text"))
    return G.diagnose(table(spark, sf_dir, "documents").select("doc_id"), pages, pages.where(F.length("raw_text") > 100))
