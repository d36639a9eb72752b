"""Streaming rules run over the events table as a stream."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import rules
from .aggregates import rounded
from .registry import query


def stream(t):
    return rules.table_stream(t.spark, t.folder, "events").withColumn("at", F.col("ts").cast("timestamp"))


def ntz(d, *cols):
    return d.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


LATE_US = 7_200_000_000     # how long rows wait for earlier ones
WM = "wm as (select max(ts) - interval 2 hours as wm from events)"


@query("r1_tumbling_complete", f"""with {WM}, g as (select event_type, time_bucket(interval '6 hours', ts) + interval 6 hours as e, avg(value) as m, count(distinct time_bucket(interval '1 hour', ts)) as n from events group by 1, 2)
select event_type, e as "end", n, case when n = 4 then round(m, 6) end as mean from g, wm where e <= wm""")
def tumbling_complete(t):
    d = rules.run_available(rules.tumbling(stream(t), ["event_type"], "at", "value", "6 hours", 3600, 4, "2 hours"), "r1")
    return rounded(ntz(d, "end"), ["mean"])


@query("r2_late_revisions", """
select user_id, event_type, max(ts) as ts, max_by(value, (ts, event_id)) as value, max_by(event_id, (ts, event_id)) as event_id from events group by 1, 2""")
def late_revisions(t):
    d = rules.table_stream(t.spark, t.folder, "events").select("user_id", "event_type", "ts", "value", "event_id")
    return rules.upserted(d, ["user_id", "event_type"], ["ts", "event_id"], "r2")


@query("r3_snapshot_changes", """
with sn as (select distinct user_id as row_id, date_diff('day', timestamp '2024-01-01', date_trunc('day', ts)) as i from events where event_type = 'purchase'), nx as (select *, lag(i) over w as p, lead(i) over w as n from sn window w as (partition by row_id order by i))
select row_id, i, 1 as present from nx where p is null or p < i - 1 union all select row_id, i + 1, 0 from nx where n > i + 1""")
def snapshot_changes(t):
    d = rules.table_stream(t.spark, t.folder, "events").filter("event_type = 'purchase'").select(
        F.col("user_id").alias("row_id"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("i"))
    return rules.in_order(d, "i", 1, rules.presence_changes("row_id", "i"), "row_id long, last long", "r3", keys=["row_id"])


@query("r4_refractory_alarms", """with recursive cd as (select distinct event_type as key, time_bucket(interval '30 minutes', ts) as t from events where value > 20),
nx as (select key, t, min(t) over (partition by key order by t range between interval '120 minutes' following and unbounded following) as nt from cd),
al as (select key, min(t) as t from cd group by 1 union all select al.key, nx.nt from al join nx on nx.key = al.key and nx.t = al.t where nx.nt is not null) select key, t from al""")
def refractory_alarms(t):
    half = F.floor(F.unix_micros("at") / 1_800_000_000) * 1_800_000_000
    d = stream(t).filter("value > 20").select(F.col("event_type").alias("key"), half.alias("us"))
    out = rules.in_order(d, "us", LATE_US, rules.refractory("key", "us", 7_200_000_000), "key string, last long", "r4", keys=["key"])
    return out.select("key", F.timestamp_micros("us").cast("timestamp_ntz").alias("t"))


@query("r5_session_episodes", f"""with {WM}, d as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as p from events), i as (select *, sum((p is null or ts >= p + interval 6 hours)::int) over (partition by user_id order by ts) as g from d),
s as (select user_id, g, min(ts) as start, max(ts) + interval 6 hours as e, count(*) as n from i group by 1, 2) select user_id, start, e as "end", n from s, wm where e <= wm""")
def session_episodes(t):
    return ntz(rules.run_available(rules.sessions(stream(t), ["user_id"], "at", "6 hours", "2 hours"), "r5"), "start", "end")


@query("r6_first_receipts", """
with d as (select user_id, event_type, event_id, ts, case when event_id % 7 = 0 then ts - interval 1 minute when value > 60 then ts + interval 3 hours else ts + to_minutes(floor(value)::int) end as received
  from events where value is not null), ok as (select * from d where ts <= received and ts >= received - interval 1 hour)
select user_id, event_type, event_id, received from ok qualify row_number() over (partition by user_id, event_type order by received, event_id) = 1""")
def first_receipts(t):
    """Which receipt stands is part of the result."""
    minute = 60_000_000
    received = (F.when(F.col("event_id") % 7 == 0, F.col("us") - minute).when(F.col("value") > 60, F.col("us") + 180 * minute)
                .otherwise(F.col("us") + F.floor("value") * minute))
    d = stream(t).filter("value is not null").withColumn("us", F.unix_micros("at")).withColumn("received", received).select("user_id", "event_type", "event_id", "us", "received")
    out = rules.in_order(d, "received", LATE_US, rules.first_receipts(["user_id", "event_type"], "us", "received", 60 * minute, "event_id"), "user_id long, event_type string", "r6", keys=["user_id", "event_type"], append=True)
    return out.select("user_id", "event_type", "event_id", F.timestamp_micros("received").cast("timestamp_ntz").alias("received"))


@query("r7_freshness_join", """
select a.event_id, (b.ts is not null and b.ts >= a.ts - interval 90 minutes)::int as fresh from events a asof left join (select distinct ts from events where event_type = 'signup') b on a.ts >= b.ts""")
def freshness_join(t):
    d = rules.table_stream(t.spark, t.folder, "events").select("event_id", "ts")
    reports = t.events.filter("event_type = 'signup'").select(F.col("ts").alias("report"))
    return rules.fresh_only(d, reports, "ts", "report", 5_400_000_000, "r7").select("event_id", "fresh")


@query("r8_setter_age", """
with d as (select distinct event_type as key, ts, user_id % 4 as setter from events), c as (select *, coalesce(setter <> lag(setter) over w, true) as sw from d window w as (partition by key order by ts, setter)),
s as (select *, last_value(case when sw then ts end ignore nulls) over (partition by key order by ts, setter rows unbounded preceding) as since from c) select key, ts as t, setter, date_diff('microsecond', since, ts) as age_us from s""")
def setter_age(t):
    d = stream(t).select(F.col("event_type").alias("key"), F.unix_micros("at").alias("us"), (F.col("user_id") % 4).alias("setter"))
    out = rules.in_order(d, "us", LATE_US, rules.switch_age("key", "us", "setter"), "key string, setter long, since long", "r8", keys=["key"])
    return out.select("key", F.timestamp_micros("us").cast("timestamp_ntz").alias("t"), "setter", "age_us")


@query("r9_sliding_mean", f"""with {WM}, w as (select event_type, e, value from (select event_type, ts, value, time_bucket(interval '30 minutes', ts) + to_minutes(30 * unnest([1, 2])) as e from events) where ts >= e - interval 1 hour and ts < e)
select event_type, e as "end", count(value) as n, round(avg(value), 6) as mean from w, wm where e <= wm group by 1, 2""")
def sliding_mean(t):
    return rounded(ntz(rules.run_available(rules.sliding(stream(t), ["event_type"], "at", "value", "1 hour", "30 minutes", "2 hours"), "r9"), "end"), ["mean"])
