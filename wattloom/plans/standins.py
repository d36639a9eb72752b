"""Market-shaped views of the driver tables shared by several queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import sequence as seq


def r6(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# Added before rounding where means fall exactly between two last digits, so that a tie
# goes the same way in both engines whatever the order of their sums.
OFF = 3.1415926e-8


def steady(d, cols):
    return d.withColumns({c: F.round(F.col(c) + OFF, 6) for c in cols})


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


# Hourly interval-ending panel per event type; k is the payload number, setter a code.
HOURLY = """hourly as (select event_type as key, time_bucket(interval '1 hour', ts - interval 1 microsecond) + interval 1 hour as time,
  round(sum(value), 2) as v, count(*) as n, max(user_id % 4) as setter, sum(json_extract(props, '$.k')::bigint)::bigint as k
  from events group by 1, 2)"""
GRID = HOURLY + """, span as (select key, unnest(generate_series(min(time), max(time), interval 1 hour)) as time from hourly group by key),
grid as (select span.key, span.time, v, n, setter, k from span left join hourly on hourly.key = span.key and hourly.time = span.time)"""


def hourly(t):
    return t.events.groupBy(F.col("event_type").alias("key"), cal.interval_ceiling(F.col("ts"), 3600).alias("time")).agg(
        F.round(F.sum("value"), 2).alias("v"), F.count(F.lit(1)).alias("n"), F.max(F.col("user_id") % 4).alias("setter"),
        F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


def grid(t):
    return seq.dense_grid(hourly(t), ["key"], "time", "1 hour")


# Dated spells per supplier: [shipment, shipment + quantity days].
SPELLS = """spells as (select l_suppkey as key, l_shipdate as s, l_shipdate + to_days(l_quantity::int) as e, l_orderkey,
  l_linenumber, l_partkey from lineitem)"""


def spells(t):
    return t.lineitem.select(F.col("l_suppkey").alias("key"), F.col("l_shipdate").alias("s"),
                             (F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_quantity").cast("int"))).alias("e"),
                             "l_orderkey", "l_linenumber", "l_partkey")

# Price-like panel: the hourly grid as prices of five regions, with origin/destination pairs.
PAIRS = GRID + """, pr as (select * from (values ('view', 'click'), ('view', 'purchase'), ('signup', 'error'), ('purchase', 'error')) x(o, d)),
pp as (select o, d, a.time, date_trunc('week', a.time - interval 1 microsecond) as week, a.v as po, b.v as pd, a.k as ko, b.k as kd, a.setter as so
  from pr join grid a on a.key = o join grid b on b.key = d and b.time = a.time)"""


def week(t="time"):
    return F.date_trunc("week", F.col(t) - F.expr("interval 1 microsecond")).cast("timestamp_ntz")


def pair_panel(t):
    g = grid(t).select("key", "time", "v", "k", "setter")
    pr = t.spark.createDataFrame([("view", "click"), ("view", "purchase"), ("signup", "error"), ("purchase", "error")], "o string, d string")
    a = g.select(F.col("key").alias("o"), "time", F.col("v").alias("po"), F.col("k").alias("ko"), F.col("setter").alias("so"))
    b = g.select(F.col("key").alias("d"), "time", F.col("v").alias("pd"), F.col("k").alias("kd"))
    return pr.join(a, "o").join(b, ["d", "time"]).withColumn("week", week())


# Equation solutions: one row per (interval, equation), factor a, side from its sign.
EQ = """eq as (select l_orderkey, l_linenumber, l_partkey as eq, l_suppkey as unit, l_shipdate as time, round(l_discount - l_tax, 2) as a,
  l_quantity as flow, l_extendedprice as rhs, l_quantity * 100 as lhs, l_tax as mv, l_returnflag as flag, l_linestatus as status from lineitem),
st as (select *, case when a > 0 then 'upper' when a < 0 then 'lower' end as side, case when a <> 0 then round(flow + (rhs - lhs) / a, 6) end as bound from eq)"""


def equations(t):
    a = F.round(F.col("l_discount") - F.col("l_tax"), 2)
    d = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("eq"), F.col("l_suppkey").alias("unit"),
                          F.col("l_shipdate").alias("time"), a.alias("a"), F.col("l_quantity").alias("flow"),
                          F.col("l_extendedprice").alias("rhs"), (F.col("l_quantity") * 100).alias("lhs"), F.col("l_tax").alias("mv"),
                          F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))
    return d


# Forecast rows on the hourly grid: origin x lead with actual, persistence, seasonal and a blend.
FC = GRID + """, pub as (select *, time + to_hours(coalesce(n, 1)::int) as published from grid), ends as (select key, max(time) as last from grid group by 1),
oo as (select g.key, g.time as origin, lead, g.time + to_hours(lead::int) as time from grid g join ends using (key), (select unnest([1, 3, 6, 24, 48, 170]) as lead) where g.time + to_hours(lead::int) <= last),
fc as (select oo.*, a.v as actual, case when p1.published > origin then p2.v else p1.v end as persistence, s.v as seasonal from oo
  left join pub a on a.key = oo.key and a.time = oo.time left join pub p1 on p1.key = oo.key and p1.time = origin - interval 1 hour left join pub p2 on p2.key = oo.key and p2.time = origin - interval 2 hours
  left join pub s on s.key = oo.key and s.time = oo.time - to_hours(case when lead >= 168 then 336 else 168 end)),
fb as (select *, persistence * 0.5 + seasonal * 0.5 as blend, case when lead <= 3 then 'short' when lead <= 24 then 'day' else 'long' end as band from fc)"""


def published_grid(t):
    return grid(t).withColumn("published", F.col("time") + F.make_dt_interval(hours=F.coalesce("n", F.lit(1)).cast("int")))


def forecast_rows_grid(t):
    from ..operators import forecast as fo
    g = published_grid(t)
    last = g.groupBy("key").agg(F.max("time").alias("last"))
    o = g.select("key", F.col("time").alias("origin")).join(last, "key")
    rows = fo.origin_lead_grid(o, "origin", [1, 3, 6, 24, 48, 170], "1 hour", F.col("last")).drop("last")
    rows = fo.at_offset(rows, g, ["key"], F.col("time"), {"actual": "v"})
    return fo.naive_forecasts(rows, g, ["key"], "v", "published", "1 hour", 168).select("key", "origin", "lead", "time", "actual", "persistence", "seasonal")


def blended(t):
    lead = F.col("lead")
    return forecast_rows_grid(t).withColumns({"blend": F.col("persistence") * 0.5 + F.col("seasonal") * 0.5,
                                              "band": F.when(lead <= 3, "short").when(lead <= 24, "day").otherwise("long")})
