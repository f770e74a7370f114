"""Stateful operators, sessions, windows and capacity rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import admin as A
from ..registry import query, table
from ..streaming import admission, states


@query("""
with recursive r as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events),
a as (select user_id, k, event_id, [ts] as times, true as admitted from r where k = 1
  union all select r.user_id, r.k, r.event_id, case when len(list_filter(a.times, lambda t: r.ts - t < interval 1 hour)) < 2 then list_append(list_filter(a.times, lambda t: r.ts - t < interval 1 hour), r.ts) else list_filter(a.times, lambda t: r.ts - t < interval 1 hour) end, len(list_filter(a.times, lambda t: r.ts - t < interval 1 hour)) < 2 from a join r on r.user_id = a.user_id and r.k = a.k + 1)
select user_id::varchar as key, event_id as id, admitted from a
""")
def rate_window_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-01: requests admitted two an hour by user; refused ones don't count."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("id"))
    return admission.batch(events, 2, 3600.0).select("key", "id", "admitted")


@query("""
select user_id, max_by(event_type, (ts, event_id)) as status, max_by(value, (ts, event_id)) as value, max(ts) as updated_at, count(*) as n from events group by user_id
""")
def latest_task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-02, ST-04: each task's last state."""
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "status")
    return states.latest_state(events, "user_id", "ts", "event_id", ["status", "value"])


@query("""
with s as (select user_id, max_by(event_type, (ts, event_id)) as status, max(ts) as updated_at from events group by user_id), m as (select max(ts) as now from events)
select user_id, case when status in ('view', 'click') then 'failed' else status end as status from s, m where updated_at >= now - interval 2 hour
""")
def task_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-02, F-67: interrupted tasks failed, old ones dropped."""
    events = table(spark, sf_dir, "events").withColumnRenamed("event_type", "status")
    last = states.recovered(states.latest_state(events, "user_id", "ts", "event_id", ["status"]), "status", ("view", "click"))
    now = events.agg(F.max("ts").alias("now"))
    return states.alive(last.join(F.broadcast(now)), "updated_at", F.col("now"), 2).select("user_id", "status")


@query("""
with i as (select event_id, user_id, case when event_id % 4 = 0 then null else ts + interval 3 day end as expires_at from events where event_type = 'signup'), m as (select max(ts) as now from events)
select event_id, user_id from i, m where event_id not in (select event_id from events where event_id % 10 = 0) and (expires_at is null or expires_at > now)
""")
def active_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-05, G-03, P-14: sessions neither revoked nor expired."""
    events = table(spark, sf_dir, "events")
    issued = events.where("event_type = 'signup'").select("event_id", "user_id", F.when(F.col("event_id") % 4 != 0, F.col("ts") + F.expr("interval 3 days")).alias("expires_at"))
    now = events.agg(F.max("ts").alias("now"))
    return states.active_sessions(issued.join(F.broadcast(now)), events.where("event_id % 10 = 0").select("event_id"), "event_id", F.col("now")).select("event_id", "user_id")


@query("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-06: events by hour and type."""
    return states.tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"]).withColumn("total", F.round("total", 6))


@query("""
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as b from events), s as (select user_id, ts, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, max(ts) as last, count(*) as n from s group by user_id, k
""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST-06: sessions of events less than two hours apart."""
    return states.sessions(table(spark, sf_dir, "events"), "ts", "2 hours", "user_id")


@query("""
select c_custkey, c_custkey * 17 as vram, case when c_custkey * 17 >= 24000 then 262144 when c_custkey * 17 >= 16000 then 131072 when c_custkey * 17 >= 12000 then 65536 when c_custkey * 17 >= 8000 then 32768 end::int as context,
  greatest(least(floor((c_custkey * 40 - 4096) / 800.0), floor((c_custkey * 200 - 51200) / 1024.0)), 1)::int as tenants,
  case when greatest(least(floor((c_custkey * 40 - 4096) / 800.0), floor((c_custkey * 200 - 51200) / 1024.0)), 1) >= 50 then 15 when greatest(least(floor((c_custkey * 40 - 4096) / 800.0), floor((c_custkey * 200 - 51200) / 1024.0)), 1) >= 20 then 10 when greatest(least(floor((c_custkey * 40 - 4096) / 800.0), floor((c_custkey * 200 - 51200) / 1024.0)), 1) >= 10 then 6 else 4 end::int as qpm
from customer
""")
def capacity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F-65, F-66, G-05, G-07: recommendations by hardware, tenants and rates by capacity."""
    n = A.max_tenants(F.col("c_custkey") * 40, F.col("c_custkey") * 200)
    return table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") * 17).alias("vram"), A.recommended_context(F.col("c_custkey") * 17).alias("context"), n.alias("tenants"), A.rate(n).alias("qpm"))
