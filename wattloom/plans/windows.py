"""Window and sequence operators on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranks
from ..operators import sequence as seq
from ..operators import windows as op
from .registry import query
from .standins import GRID, SPELLS, grid, r6, spells


@query("w1_densify_grid", f"with {GRID} select key, time, v, n from grid")
def densify(t):
    return grid(t).select("key", "time", "v", "n")


@query("w2_lag_diff", f"""with {GRID} select key, time, round(v - lag(v, 1) over w, 4) as ramp_1h, round(v - lag(v, 3) over w, 4) as ramp_3h,
  lag(v, 1) over w as lag_1, lag(v, 24) over w as lag_24, lag(v, 168) over w as lag_168 from grid window w as (partition by key order by time)""")
def lag_diff(t):
    d = op.lag_features(grid(t), ["key"], "time", "v", {"lag_1": 1, "lag_24": 24, "lag_168": 168},
                        {"ramp_1h": 1, "ramp_3h": 3}, "168 hours")
    return d.select("key", "time", r6("ramp_1h", 4).alias("ramp_1h"), r6("ramp_3h", 4).alias("ramp_3h"), "lag_1", "lag_24", "lag_168")


@query("w3_rolling_complete", f"""with {GRID} select key, time,
  (count(v) over (partition by key order by time rows 6 preceding) = 7)::int as complete,
  case when count(v) over p = 12 then round(quantile_cont(v, 0.5) over p, 6) end as median_12
from grid window p as (partition by key order by time rows between 12 preceding and 1 preceding)""")
def rolling_complete(t):
    def cols(w):
        p = w.rowsBetween(-12, -1)
        return {"complete": (F.count("v").over(w.rowsBetween(-6, 0)) == 7).cast("int"),
                "median_12": F.when(F.count("v").over(p) == 12, F.percentile("v", F.lit(0.5)).over(p))}
    return seq.windowed(grid(t), ["key"], "time", cols, before="12 hours").select("key", "time", "complete", r6("median_12").alias("median_12"))


@query("w4_onset", f"""with {GRID}, f as (select *, coalesce(v < 20, false) as low from grid)
select key, time from (select *, lag(low, 1, false) over (partition by key order by time) as was from f) where low and not was""")
def onset(t):
    return op.onset(grid(t), ["key"], "time", F.col("v") < 20, "onset", "1 hour").filter("onset").select("key", "time")


@query("w5_islands", """
with d as (select *, lag(ts) over w as p from events window w as (partition by user_id order by ts, event_id)),
i as (select *, sum((p is null or ts > p + interval 6 hours)::int) over (partition by user_id order by ts, event_id) as island from d)
select user_id, island::bigint as island, min(ts) as start, max(ts) as "end", count(*) as n from i group by 1, 2""")
def islands(t):
    return op.islands_summary(t.events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"], "6 hours")


@query("w6_merge_intervals", f"""
with {SPELLS}, d as (select *, max(e) over (partition by key order by s, e rows between unbounded preceding and 1 preceding) as reach
  from (select distinct key, s, e from spells)),
i as (select *, sum((reach is null or s > reach + interval 5 minutes)::int) over (partition by key order by s, e) as g from d)
select key, min(s) as s, max(e) as e, count(*) as n from i group by key, g""")
def merge_intervals(t):
    return seq.merge_intervals(spells(t).select("key", "s", "e").distinct(), ["key"], "s", "e", gap="5 minutes",
                               aggs=[F.count(F.lit(1)).alias("n")], hours=24 * 90)


@query("w7_merge_windows_payload", """
with x as (select l_partkey as key, l_shipdate as s, l_shipdate + to_days(l_quantity::int) as e, l_discount as p, l_returnflag as kind, l_orderkey, l_linenumber, l_suppkey from lineitem),
d as (select *, max(e) over (partition by key order by s, e, l_orderkey, l_linenumber, l_suppkey rows between unbounded preceding and 1 preceding) as reach from x),
i as (select *, sum((reach is null or s > reach + interval 10 days)::int) over (partition by key order by s, e, l_orderkey, l_linenumber, l_suppkey rows unbounded preceding) as g from d)
select key, min(s) as s, max(e) as e, max(p) as probability, string_agg(distinct kind, '|' order by kind) as kinds from i group by key, g""")
def merge_windows_payload(t):
    d = t.lineitem.select(F.col("l_partkey").alias("key"), F.col("l_shipdate").alias("s"),
                          (F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_quantity").cast("int"))).alias("e"),
                          F.col("l_discount").alias("p"), F.col("l_returnflag").alias("kind"), "l_orderkey", "l_linenumber", "l_suppkey")
    return seq.merge_intervals(d, ["key"], "s", "e", ["l_orderkey", "l_linenumber", "l_suppkey"], gap="10 days", aggs=[
        F.max("p").alias("probability"), F.array_join(F.sort_array(F.collect_set("kind")), "|").alias("kinds")], hours=24 * 365)


@query("w8_forward_fill_sign", """
with d as (select *, case when json_extract(props, '$.k')::int % 3 = 0 then 0 else value - 10 end as x from events),
s as (select *, last_value(nullif(sign(x), 0) ignore nulls) over (partition by user_id order by ts, event_id) as held from d)
select event_id, held::double as held_sign, coalesce(held <> lag(held) over (partition by user_id order by ts, event_id), false)::int as reversal from s""")
def forward_fill_sign(t):
    k = F.get_json_object("props", "$.k").cast("int")
    d = t.events.select("event_id", "user_id", "ts", F.when(k % 3 == 0, 0.0).otherwise(F.col("value") - 10).alias("x"))
    return op.sign_reversals(d, ["user_id"], ["ts", "event_id"], "x").select("event_id", "held_sign", "reversal")


@query("w9_rank_corr", """
with d as (select event_type, value, json_extract(props, '$.k')::int as k from events),
r as (select event_type, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2 as a,
  rank() over (partition by event_type order by k) + (count(*) over (partition by event_type, k) - 1) / 2 as b from d)
select event_type, count(*) as n_pairs, round(corr(a, b), 6) as rho from r group by 1""")
def rank_corr(t):
    d = t.events.select("event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return ranks.rank_correlation(d, ["event_type"], "value", "k").select("event_type", "n_pairs", r6("rho").alias("rho"))


@query("w10_setter_age", f"""with {GRID},
d as (select *, (not coalesce(setter = lag(setter) over w, false))::int as sw from grid window w as (partition by key order by time)),
a as (select *, last_value(case when sw = 1 then time end ignore nulls) over w as since, sum(sw) over (partition by key order by time rows 5 preceding) as r,
  count(*) over (partition by key order by time rows 5 preceding) as c from d window w as (partition by key order by time))
select key, time, setter, date_diff('minute', since, time) as setter_age, case when c = 6 then r::bigint end as switch_recent from a""")
def setter_age(t):
    return op.setter_age(grid(t), ["key"], "time", "setter", "1 hour", 6, "6 hours").select(
        "key", "time", "setter", "setter_age", "switch_recent")


@query("w11_percentile_bins", f"""with {GRID}, q as (select key, quantile_cont(v, 0.2) as lo, quantile_cont(v, 0.8) as hi from grid group by 1)
select grid.key, time, v, case when v is null then -1 when v <= lo then 0 when v <= hi then 1 else 2 end as bin from grid join q using (key)""")
def percentile_bins(t):
    return op.percentile_bins(grid(t).select("key", "time", "v"), ["key"], "v", 0.2, 0.8, "bin")


@query("w12_cumulative_curve", """
with d as (select l_returnflag, l_extendedprice, l_orderkey, l_linenumber, l_partkey, sum(l_quantity) as l_quantity from lineitem group by 1, 2, 3, 4, 5)
select *, sum(l_quantity) over (partition by l_returnflag order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey rows unbounded preceding) as cum_units from d""")
def cumulative_curve(t):
    return op.cumulative_curve(t.lineitem, ["l_returnflag"], "l_extendedprice", "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("w13_version_supersede", """
with v as (select l_partkey, l_shipdate as s, max_by(l_shipdate + to_days(l_quantity::int), (l_orderkey, l_linenumber, l_suppkey, l_quantity)) as e from lineitem group by 1, 2),
n as (select *, lead(s) over (partition by l_partkey order by s) as nx from v)
select l_partkey, s, least(e, coalesce(nx, e)) as e from n where s < least(e, coalesce(nx, e))""")
def version_supersede(t):
    d = t.lineitem.select("l_partkey", F.col("l_shipdate").alias("s"),
                          (F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_quantity").cast("int"))).alias("e"),
                          "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return op.supersede(d, "l_partkey", "s", "e", ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]).select("l_partkey", "s", "e")


@query("w14_interval_split", """
with b as (select s_suppkey as key, timestamp '1995-06-01' + to_days((s_suppkey % 50)::int) as bs, timestamp '2000-06-01' + to_days((s_suppkey % 50)::int) as be from supplier),
d1 as (select o_custkey as key, o_orderdate as c, max(o_orderkey) as v1 from orders group by 1, 2),
d2 as (select l_suppkey as key, l_shipdate as c, max(l_orderkey) as v2 from lineitem group by 1, 2),
c as (select key, bs, be, unnest([bs, be]) as c from b union select b.key, bs, be, c from b join d1 on b.key = d1.key and c between bs and be
  union select b.key, bs, be, c from b join d2 on b.key = d2.key and c between bs and be),
p as (select key, c as valid_from, lead(c) over (partition by key, bs order by c) as valid_to from c)
select p.key, valid_from, valid_to, v1, v2 from (select * from p where valid_to is not null) p
  asof left join d1 on p.key = d1.key and p.valid_from >= d1.c asof left join d2 on p.key = d2.key and p.valid_from >= d2.c""")
def interval_split(t):
    at = lambda s: F.lit(s).cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("s_suppkey") % 50).cast("int"))
    b = t.supplier.select(F.col("s_suppkey").alias("key"), at("1995-06-01").alias("bs"), at("2000-06-01").alias("be"))
    d1 = t.orders.groupBy(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("c1")).agg(F.max("o_orderkey").alias("v1"))
    d2 = t.lineitem.groupBy(F.col("l_suppkey").alias("key"), F.col("l_shipdate").alias("c2")).agg(F.max("l_orderkey").alias("v2"))
    return op.split_validity(b, [(d1, "c1", "v1"), (d2, "c2", "v2")], "key", "bs", "be")


@query("w15_forward_label", f"""with {GRID}, f as (select key, time, (v < 20)::int as flag from grid)
select key, time, case when count(flag) over a = 4 then max(flag) over a end as label from f
window a as (partition by key order by time rows between 2 following and 5 following)""")
def forward_label(t):
    d = grid(t).select("key", "time", (F.col("v") < 20).cast("int").alias("flag"))
    return op.forward_label(d, ["key"], "time", "flag", 2, 5, "5 hours").select("key", "time", "label")


@query("w16_extremogram", f"""with {GRID}, l as (select unnest([0, 1, 3, 6, 12, 24]) as lag),
f as (select key, time, coalesce(v > 60, false)::int as hit from grid)
select a.key as conditioning, b.key as response, lag, round(avg(b.hit), 6) as probability, count(*) as events
from f a, l join f b on b.time = a.time + to_hours(lag::int) where a.hit = 1 group by 1, 2, 3""")
def extremogram(t):
    return op.extremogram(grid(t), "key", "time", "v", 60.0, [0, 1, 3, 6, 12, 24], "1 hour").withColumn("probability", r6("probability"))


@query("w17_interpolate_limit", f"""with {GRID} select key, time, round(coalesce(v, (lag(v) over w + lead(v) over w) / 2), 4) as linear,
  coalesce(v, lead(v) over w) as stepped from grid window w as (partition by key order by time)""")
def interpolate_limit(t):
    return op.interpolate_one_gap(grid(t), ["key"], "time", "v", "1 hour").select("key", "time", r6("linear", 4).alias("linear"), "stepped")


@query("w18_causal_median_profile", f"""with {GRID}, f as (select *, coalesce(v > 60, false) as hi, (setter is distinct from 3)::int as off from grid),
a as (select key, time as anchor from (select *, lag(hi, 1, false) over (partition by key order by time) as was from f) where hi and not was),
g as (select key, anchor, o as "offset", anchor + to_hours(o::int) as att from a, (select unnest(range(-6, 7)) as o)),
b as (select g.key, anchor, "offset", quantile_cont(v, 0.5) as base from g, (select unnest(range(1, 8)) as kk) join f on f.key = g.key and f.time = att - to_days(kk::int)
  where off = 1 and v is not null group by 1, 2, 3)
select g.key, g.anchor, g."offset", round(f.v - base, 6) as relative from g left join f on f.key = g.key and f.time = g.att
  left join b on b.key = g.key and b.anchor = g.anchor and b."offset" = g."offset" """)
def causal_median_profile(t):
    g = grid(t).withColumn("off", (~F.col("setter").eqNullSafe(3)).cast("int"))
    a = op.onset(g, ["key"], "time", F.col("v") > 60, "onset", "1 hour").filter("onset").select("key", F.col("time").alias("anchor"))
    return op.causal_baseline(a, g, ["key"], "time", "v", "off", (-6, 6), "1 hour", "1 day").select(
        "key", "anchor", "offset", r6("relative").alias("relative"))


@query("w19_run_start_value", f"""with {GRID}, f as (select *, coalesce(v > 40, false) as onn from grid)
select key, time as run_start, p as before, setter as first_during, (p <> setter)::int as changed from (
  select *, lag(onn, 1, false) over w as was, lag(setter) over w as p from f window w as (partition by key order by time)) where onn and not was""")
def run_start_value(t):
    return op.run_starts(grid(t), ["key"], "time", F.col("v") > 40, "setter", "1 hour")


@query("w20_coverage_share", """
with s as (select event_type as key, ts as s, ts + to_minutes(floor(value)::int) as e from events),
d as (select distinct key, unnest(generate_series(time_bucket(interval '5 minutes', s - interval 1 microsecond) + interval 5 minutes, e, interval 5 minutes)) as p from s)
select key, time_bucket(interval '30 minutes', p - interval 1 microsecond) + interval 30 minutes as time, count(*) as covered from d group by 1, 2""")
def coverage_share(t):
    s = t.events.select(F.col("event_type").alias("key"), F.col("ts").alias("s"),
                        (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("e"))
    return op.covered_intervals(s, ["key"], "s", "e", gap="0 seconds")
