"""Aggregations on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text
from ..operators import aggregates as op
from ..operators import revisions as rev
from ..operators import sequence as seq
from ..operators import windows as win
from .registry import query
from .standins import EQ, GRID, OFF, PAIRS, equations, grid, hourly, pair_panel, r6, steady, ts, week


def rounded(d, cols, n=6):
    return d.withColumns({c: r6(c, n) for c in cols})


MONTHLY = """m as (select l_suppkey as key, date_trunc('month', l_shipdate) as month, count(distinct l_shipdate) as n, avg(l_quantity) as q,
  min(l_extendedprice) as lo, max(l_extendedprice) as hi, max_by(nullif(l_returnflag, 'R'), (l_shipdate, l_orderkey, l_linenumber)) filter (l_returnflag <> 'R') as setter
  from lineitem group by 1, 2)"""


def monthly(t):
    d = t.lineitem.select(F.col("l_suppkey").alias("key"), cal.month_start(F.col("l_shipdate")).alias("month"), "l_shipdate", "l_orderkey",
                          "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"),
                          F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("setter"))
    return op.interval_targets(d, ["key"], "month", "l_shipdate", 6, ["q"], ["price"], ["price"], ["setter"], ["l_orderkey", "l_linenumber"])


@query("a1_halfhour_targets", f"""with {MONTHLY} select key, month, n, case when n = 6 then round(q, 6) end as q, case when n = 6 then lo end as price_min,
  case when n = 6 then hi end as price_max, setter as setter_last from m""")
def halfhour_targets(t):
    return rounded(monthly(t), ["q"])


@query("a2_regional_halfhour", f"""
select n_regionkey as region, date_trunc('month', l_shipdate) as month, case when count(distinct l_shipdate) >= 20 then round(avg(l_quantity) + {OFF}, 6) end as demand,
  case when count(distinct l_shipdate) >= 20 then round(avg(l_extendedprice) + {OFF}, 6) end as wind
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1, 2""")
def regional_halfhour(t):
    place = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_regionkey").alias("region"))
    d = t.lineitem.select("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice").join(place, "l_suppkey")
    g = d.groupBy("region", cal.month_start(F.col("l_shipdate")).alias("month")).agg(
        F.countDistinct("l_shipdate").alias("n"), F.avg("l_quantity").alias("demand"), F.avg("l_extendedprice").alias("wind"))
    whole = F.col("n") >= 20
    g = steady(g, ["demand", "wind"])
    return g.select("region", "month", F.when(whole, F.col("demand")).alias("demand"), F.when(whole, F.col("wind")).alias("wind"))


@query("a3_seasonal_reference", f"""with {MONTHLY}, p as (select key, month, floor(month(month) % 12 / 3)::int as season, case when n = 6 then hi - 20000 end as cap from m),
r as (select key, season, quantile_cont(cap, 0.5) as ref from p where month <= '1999-12-31' and cap > 0 group by 1, 2)
select p.key, month, p.season, round(ref, 4) as reference, (cap < 0.5 * ref)::int as event from p left join r on p.key = r.key and p.season = r.season""")
def seasonal_reference(t):
    p = monthly(t).select("key", "month", cal.season(F.col("month")).alias("season"), (F.col("price_max") - 20000).alias("cap"))
    return op.seasonal_reference(p, ["key", "season"], "cap", F.col("month") <= ts("1999-12-31")).select(
        "key", "month", "season", r6("reference", 4).alias("reference"), "event")


@query("a4_coverage_audit", f"""with {GRID.split(', span as')[0]} select key, count(*) as rows, count(v) as known, min(time) as first, max(time) as last,
  date_diff('hour', min(time), max(time)) + 1 as expected, round(1 - count(distinct time) / (date_diff('hour', min(time), max(time)) + 1), 6) as missing_share from hourly group by 1""")
def coverage_audit(t):
    return rounded(op.coverage_audit(hourly(t), ["key"], "time", "v", 3600), ["missing_share"])


@query("a5_constraint_population", f"""with {EQ}, s as (select *, (rhs - lhs) / abs(nullif(a, 0)) as slack from st),
l as (select *, case when side = 'upper' then min(bound) over w when side = 'lower' then max(bound) over w end as lead from s window w as (partition by time, side)),
g as (select *, case when side = 'upper' then bound - lead when side = 'lower' then lead - bound end as gap from l)
select unit, side, count(*) as applicable, count(*) filter (abs(mv) > 1e-9) as binding, count(*) filter (slack between 0 and 100000) as near_binding,
  count(*) filter (gap between 0 and 50000) as near_setting, count(*) filter (gap = 0) as leading, round(avg(abs(mv)), 6) as mean_abs_mv,
  round(min(slack), 4) as min_slack, round(quantile_cont(slack, 0.5), 4) as median_slack from g group by 1, 2""")
def constraint_population(t):
    from ..operators.constraints import solution_state
    st = solution_state(equations(t)).withColumn("slack", (F.col("rhs") - F.col("lhs")) / F.abs(F.nullif(F.col("a"), F.lit(0.0))))
    d = op.equation_population(st, ["unit", "side"], 100000, 50000)
    return rounded(rounded(d, ["mean_abs_mv"]), ["min_slack", "median_slack"], 4)


@query("a6_unit_diurnal", """with d as (select event_type, hour(ts) as slot, value - 10 as x from events)
select event_type, slot, count(*) as rows, round(sum(abs(x)), 2) as total_abs, round(avg(abs(x)), 6) as mean_abs, round(quantile_cont(abs(x), 0.95), 6) as p95_abs,
  round(sum(greatest(x, 0)), 2) as tightening, round(sum(greatest(-x, 0)), 2) as relief from d group by 1, 2""")
def unit_diurnal(t):
    d = t.events.select("event_type", F.hour("ts").alias("slot"), (F.col("value") - 10).alias("x"))
    return rounded(rounded(op.unit_profile(d, ["event_type", "slot"], "x"), ["mean_abs", "p95_abs"]), ["total_abs", "tightening", "relief"], 2)


@query("a7_regional_price_summary", f"""with {GRID}, f as (select *, date_trunc('week', time - interval 1 microsecond) as week, date_trunc('day', time - interval 1 microsecond) as day,
    time_bucket(interval '2 hours', time - interval 1 microsecond) as block, coalesce(v > 40, false) as hi from grid),
p as (select *, (hi and not lag(hi, 1, false) over (partition by key order by time))::int as onset from f),
b as (select week, key, avg(greatest(m - 40, 0)) as eb from (select week, key, block, avg(v) as m from p group by 1, 2, 3) group by 1, 2),
dd as (select week, key, day, sum(greatest(v - 40, 0)) as s from p group by 1, 2, 3),
tp as (select week, key, sum(s) as tot, sum(s) filter (rn <= 2) as top from (select *, row_number() over (partition by week, key order by s desc nulls last, day) as rn from dd) group by 1, 2)
select p.week, p.key, count(v) as intervals, round(avg(v), 6) as mean_price, round(avg(least(v, 40)), 6) as capped, round(avg(greatest(v - 40, 0)), 6) as excess,
  count(*) filter (v > 40) * 1.0::double as hours_above, sum(onset)::bigint as episodes, round(avg(v - 40) filter (v > 40), 6) as excess_when_above,
  round(avg(coalesce(v < 0, false)::int), 6) as negative_share, round(any_value(eb), 6) as excess_from_blocks,
  round(coalesce(any_value(top) / nullif(any_value(tot), 0), 0), 6) as top_days_share
from p join b using (week, key) join tp using (week, key) group by 1, 2""")
def regional_price_summary(t):
    back = F.col("time") - F.expr("interval 1 microsecond")
    p = grid(t).withColumns({"week": week(), "day": cal.floor_time(back, 86400), "block": cal.floor_time(back, 7200)})
    p = win.onset(p, ["key"], "time", F.col("v") > 40, "on", "1 hour").withColumn("on", F.col("on").cast("int"))
    p = p.withColumn("v", F.col("v"))
    d = op.price_summary(p, "week", "key", "time", "day", "block", "v", "on", 40.0, 1.0, 2)
    return rounded(d, ["mean_price", "capped", "excess", "excess_when_above", "negative_share", "excess_from_blocks", "top_days_share"])


TERMS = """sp as (select *, pd - po as spread, least(pd, 40) - least(po, 40) as energy, greatest(pd - 40, 0) - greatest(po - 40, 0) as scarcity,
  case when po <= 40 and pd <= 40 then 'neither' when po <= 40 and pd > 40 then 'destination_only' when po > 40 and pd <= 40 then 'origin_only' else 'both' end as state
  from pp where po is not null and pd is not null)"""


def known_pairs(t):
    return pair_panel(t).filter("po is not null and pd is not null")


@query("a8_spread_states", f"""with {PAIRS}, {TERMS}, n as (select o, d, week, count(*) as n from sp group by 1, 2, 3)
select o, d, week, state, count(*) as intervals, round(count(*) / any_value(n), 6) as frequency, round(sum(spread) / any_value(n), 6) as spread,
  round(sum(energy) / any_value(n), 6) as energy, round(sum(scarcity) / any_value(n), 6) as scarcity from sp join n using (o, d, week) group by 1, 2, 3, 4""")
def spread_states(t):
    return rounded(op.spread_states(known_pairs(t), ["o", "d", "week"], "po", "pd", 40), ["frequency", "spread", "energy", "scarcity"])


@query("a9_flow_diagnostics", f"""with {PAIRS}, x as (select o, d, pd - po as s, greatest(kd - ko, 0) as f, greatest(pd, po) > 60 as tail from pp where po is not null and pd is not null),
g as (select *, rank() over (partition by o, d order by f) + (count(*) over (partition by o, d, f) - 1) / 2 as rf,
  rank() over (partition by o, d order by s) + (count(*) over (partition by o, d, s) - 1) / 2 as rs from x where s > 0),
c as (select o, d, corr(f, s) as pearson, corr(rf, rs) as spearman from g group by 1, 2)
select o, d, count(*) as intervals, round(avg(case when s > 0 then f else 0 end), 6) as mean_flow, round(avg(greatest(s, 0)), 6) as mean_spread,
  round(avg(case when s > 0 then f * s else 0 end), 6) as mean_product,
  round(avg(case when s > 0 then f * s else 0 end) - avg(case when s > 0 then f else 0 end) * avg(greatest(s, 0)), 5) as covariance,
  round(sum(case when s > 0 and tail then f * s else 0 end) / sum(case when s > 0 then f * s else 0 end), 6) as tail_share,
  round(avg((s > 0)::int), 6) as gate_probability, round(any_value(pearson), 6) as pearson, round(any_value(spearman), 6) as spearman from x join c using (o, d) group by 1, 2""")
def flow_diagnostics(t):
    p = known_pairs(t).withColumns({"s": F.col("pd") - F.col("po"), "f": (F.col("kd") - F.col("ko")).cast("double")})
    d = op.flow_diagnostics(p, ["o", "d"], "s", "f", F.greatest("pd", "po") > 60)
    return rounded(rounded(d, ["covariance"], 5), ["mean_flow", "mean_spread", "mean_product", "tail_share", "gate_probability", "pearson", "spearman"])


@query("a10_loss_congestion", f"""with {PAIRS}, x as (select o, d, week, po, pd, po * (1 + so * 0.02::double) as st from pp where po is not null and pd is not null)
select o, d, week, count(*) as n, round(avg(pd - po), 6) as spread, round(avg(st - po), 6) as loss, round(avg(pd - st), 6) as congestion,
  round(avg(least(st, 40) - least(po, 40)), 6) as energy_loss, round(avg(st - po - (least(st, 40) - least(po, 40))), 6) as scarcity_loss,
  round(avg(least(pd, 40) - least(st, 40)), 6) as energy_congestion, round(avg(pd - st - (least(pd, 40) - least(st, 40))), 6) as scarcity_congestion,
  round(avg(case when abs(pd - st) <= greatest(0.01, 1e-4 * abs(po)) then 100 else 0 end), 6) as coupled_pct from x group by 1, 2, 3""")
def loss_congestion(t):
    p = known_pairs(t).withColumn("mlf", 1 + F.col("so") * 0.02)
    d = op.loss_congestion(p, ["o", "d", "week"], "po", "pd", "mlf", 40)
    return rounded(d, ["spread", "loss", "congestion", "energy_loss", "scarcity_loss", "energy_congestion", "scarcity_congestion", "coupled_pct"])


@query("a11_loss_curve_fit", """with d as (select l_returnflag, 'FY' || (year(l_shipdate) + (month(l_shipdate) >= 7)::int) as fy, l_extendedprice as y, l_quantity as x from lineitem)
select l_returnflag, fy, round(regr_slope(y, x), 4) as slope, round(regr_intercept(y, x), 3) as intercept, round(regr_r2(y, x), 6) as r2, count(*) as n from d group by 1, 2""")
def loss_curve_fit(t):
    d = t.lineitem.select("l_returnflag", cal.financial_year(F.col("l_shipdate")).alias("fy"), "l_extendedprice", "l_quantity")
    d = op.line_fit(d, ["l_returnflag", "fy"], "l_extendedprice", "l_quantity")
    return d.select("l_returnflag", "fy", r6("slope", 4).alias("slope"), r6("intercept", 3).alias("intercept"), r6("r2").alias("r2"), "n")


@query("a12_season_hour_profile", f"""with {PAIRS} select o, d, hour(time - interval 1 microsecond) as hour, round(avg(pd - po), 6) as spread,
  round(avg(100 * (kd > ko)::int), 6) as toward_dest_pct, round(avg(100 * (pd > 40)::int), 6) as dest_above_pct from pp where po is not null and pd is not null group by 1, 2, 3""")
def season_hour_profile(t):
    p = known_pairs(t)
    return p.groupBy("o", "d", F.hour(F.col("time") - F.expr("interval 1 microsecond")).alias("hour")).agg(
        r6(F.avg(F.col("pd") - F.col("po"))).alias("spread"), r6(F.avg(F.when(F.col("kd") > F.col("ko"), 100.0).otherwise(0.0))).alias("toward_dest_pct"),
        r6(F.avg(F.when(F.col("pd") > 40, 100.0).otherwise(0.0))).alias("dest_above_pct"))


@query("a13_diurnal_profile", """
with r as (select *, row_number() over (partition by event_type, time_bucket(interval '5 minutes', ts), user_id order by ts desc, event_id desc) as rn from events),
p as (select event_type as key, time_bucket(interval '1 hour', ts - interval 1 microsecond) + interval 1 hour as time, round(sum(value), 2) as v, count(*) as n from r where rn = 1 group by 1, 2),
m as (select key, quantile_cont(v, 0.5) as ref from p where v > 0 and time <= '2024-01-20' group by 1),
f as (select p.*, (v < 0.5 * ref)::int as restricted, hour(time) as slot, unnest(['pooled', 'week']) as scheme from p left join m using (key)),
g as (select *, case when scheme = 'pooled' then 'all' else strftime(date_trunc('week', time - interval 1 microsecond), '%Y-%m-%d') end as block from f)
select scheme, block, key, slot, count(*) as n, round(avg(v), 6) as flow_mean, round(avg(restricted), 6) as restricted_rate, round(quantile_cont(v, 0.05), 6) as p05,
  round(quantile_cont(v, 0.5), 6) as p50, round(quantile_cont(v, 0.95), 6) as p95 from g group by 1, 2, 3, 4""")
def diurnal_profile(t):
    """Flagship: revision choice, hourly panel, frozen reference, restriction flag, profile by two schemes."""
    obs = rev.latest(t.events.withColumn("step", cal.floor_time(F.col("ts"), 300)), ["event_type", "step", "user_id"], ["ts", "event_id"])
    p = obs.groupBy(F.col("event_type").alias("key"), cal.interval_ceiling(F.col("ts"), 3600).alias("time")).agg(F.round(F.sum("value"), 2).alias("v"))
    p = op.seasonal_reference(p, ["key"], "v", F.col("time") <= ts("2024-01-20")).withColumn("slot", F.hour("time"))
    d = op.quantile_profile(p, {"pooled": F.lit("all"), "week": F.date_format(week(), "yyyy-MM-dd")}, ["key", "slot"],
                            {"v": {"p05": 0.05, "p50": 0.5, "p95": 0.95}}, {"flow_mean": "v", "restricted_rate": "event"})
    return rounded(d, ["flow_mean", "restricted_rate", "p05", "p50", "p95"])


@query("a14_regime_table", f"""with {GRID}, q as (select key, quantile_cont(k, 0.2) as p20, quantile_cont(k, 0.8) as p80, count(k) as c from grid group by 1 having count(k) >= 30),
l as (select grid.*, p20, p80, case when k <= p20 then 'low' when k <= p80 then 'normal' else 'high' end as regime from grid join q using (key) where k is not null and p20 < p80)
select key, regime, count(*) as n, round(max(p20), 6) as p20, round(max(p80), 6) as p80, round(quantile_cont(v, 0.5), 6) as v_median, round(quantile_cont(n, 0.5), 6) as n_median from l group by 1, 2""")
def regime_table(t):
    d = op.regime_table(grid(t).withColumn("n", F.col("n").cast("double")).withColumn("k", F.col("k").cast("double")), ["key"], "k", {"v_median": "v", "n_median": "n"}, 30)
    return rounded(d, ["p20", "p80", "v_median", "n_median"])


@query("a15_spell_count_index", """
with m as (select date_trunc('month', o_orderdate) as month, case when avg(o_totalprice) > 255000 then 1 when avg(o_totalprice) < 245000 then -1 else 0 end as s from orders group by 1),
i as (select *, sum((s is distinct from p)::int) over (order by month) as g from (select *, lag(s) over (order by month) as p from m)),
st as (select month, case when s = 1 and c >= 2 then 'El Niño' when s = -1 and c >= 2 then 'La Niña' else 'Neutral' end as state from (select *, count(*) over (partition by g) as c from i))
select state, count(*) as n, count(distinct month) as months, round(avg(o_totalprice), 6) as mean from orders join st on date_trunc('month', o_orderdate) = month group by 1""")
def spell_count_index(t):
    month = cal.month_start(F.col("o_orderdate"))
    o = t.orders.withColumn("month", month)
    avg = F.avg("o_totalprice")
    m = o.groupBy("month").agg(F.when(avg > 255000, 1).when(avg < 245000, -1).otherwise(0).alias("s")).withColumn("all", F.lit(0))
    m = seq.previous(m, ["all"], ["month"], {"p": "s"}, hours=24 * 366)
    m = seq.islands(m, ["all"], ["month"], ~F.col("s").eqNullSafe(F.col("p")), "g", hours=24 * 366)
    size = m.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    st = m.join(size, "g").select("month", F.when((F.col("s") == 1) & (F.col("c") >= 2), "El Niño").when(
        (F.col("s") == -1) & (F.col("c") >= 2), "La Niña").otherwise("Neutral").alias("state"))
    return o.join(st, "month").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("month").alias("months"), r6(avg).alias("mean"))


@query("a16_counterprice", """with d as (select event_type as key, strftime(ts - interval 1 microsecond, '%Y-%m-%d') as day, (value - 20) * (json_extract(props, '$.k')::int - 50) as r,
  user_id % 3 = 0 as forced, value > 40 as above from events)
select key, day, round(sum(least(r, 0)), 2) as negative, round(sum(greatest(r, 0)), 2) as positive, round(sum(case when forced then least(r, 0) else 0 end), 2) as forced,
  round(sum(case when above then least(r, 0) else 0 end), 2) as exporter_above, count(*) filter (r < 0) as n_negative from d group by 1, 2 having round(sum(least(r, 0)), 2) < -500""")
def counterprice(t):
    k = F.get_json_object("props", "$.k").cast("int")
    d = t.events.select(F.col("event_type").alias("key"), F.date_format(F.col("ts") - F.expr("interval 1 microsecond"), "yyyy-MM-dd").alias("day"),
                        ((F.col("value") - 20) * (k - 50)).alias("r"), (F.col("user_id") % 3 == 0).alias("forced"), (F.col("value") > 40).alias("above"))
    neg = F.least(F.col("r"), F.lit(0.0))
    return d.groupBy("key", "day").agg(
        r6(F.sum(neg), 2).alias("negative"), r6(F.sum(F.greatest(F.col("r"), F.lit(0.0))), 2).alias("positive"), r6(F.sum(F.when(F.col("forced"), neg).otherwise(0.0)), 2).alias("forced"),
        r6(F.sum(F.when(F.col("above"), neg).otherwise(0.0)), 2).alias("exporter_above"), F.count(F.when(F.col("r") < 0, 1)).alias("n_negative")).filter("negative < -500")


@query("a17_setter_attribution", f"""with {PAIRS}, ids as (select *, case when so is null or abs(pd - po) < 5 then null else ['V>>NIL_A', 'N^^V_OUT', '#RAMP', 'V::S_NIL'][so + 1] end as cid from pp where po is not null and pd is not null),
l as (select *, case when cid is null then 'coupled/none' when cid = '#RAMP' then 'manual/ramp' when cid = 'V>>NIL_A' then 'thermal' when cid = 'N^^V_OUT' then 'voltage stability' else 'transient stability' end as family,
  case when cid is null then 'coupled/none' when cid = '#RAMP' then 'other' when cid = 'N^^V_OUT' then 'outage/other' else 'system normal' end as state from ids),
n as (select o, d, week, count(*) as n from l group by 1, 2, 3)
select o, d, week, family, state, round(sum(pd - po) / any_value(n), 6) as contribution, count(*) as intervals from l join n using (o, d, week) group by 1, 2, 3, 4, 5""")
def setter_attribution(t):
    ids = F.array(*[F.lit(s) for s in ("V>>NIL_A", "N^^V_OUT", "#RAMP", "V::S_NIL")])
    p = known_pairs(t).withColumn("cid", F.when(F.abs(F.col("pd") - F.col("po")) >= 5, F.try_element_at(ids, (F.col("so") + 1).cast("int"))))
    none = F.col("cid").isNull()
    p = p.withColumns({"family": F.when(none, "coupled/none").otherwise(text.equation_family(F.col("cid"))),
                       "state": F.when(none, "coupled/none").otherwise(text.network_state(F.col("cid")))})
    n = p.groupBy("o", "d", "week").agg(F.count(F.lit(1)).alias("_n"))
    g = p.groupBy("o", "d", "week", "family", "state").agg(F.sum(F.col("pd") - F.col("po")).alias("s"), F.count(F.lit(1)).alias("intervals"))
    return g.join(n, ["o", "d", "week"]).select("o", "d", "week", "family", "state", r6(F.col("s") / F.col("_n")).alias("contribution"), "intervals")


@query("a18_setter_ranking", """with d as (select event_type, case when hour(ts) < 6 or hour(ts) >= 21 then 'overnight' when hour(ts) < 10 then 'morning' when hour(ts) < 16 then 'midday' else 'evening' end as period, user_id % 17 as setter from events),
c as (select event_type, period, setter, count(*) as n from d group by 1, 2, 3), r as (select *, row_number() over (partition by event_type, period order by n desc, setter) as rank, sum(n) over (partition by event_type, period) as tot from c)
select event_type, period, setter, n, rank, round(n / tot, 6) as share from r where rank <= 3""")
def setter_ranking(t):
    d = t.events.select("event_type", cal.day_period(F.col("ts")).alias("period"), (F.col("user_id") % 17).alias("setter"))
    return rounded(op.ranked_shares(d, ["event_type", "period"], "setter", 3), ["share"])


@query("a19_marginal_value_stats", """with d as (select l_linestatus, l_suppkey, l_extendedprice as x, (l_returnflag = 'R')::int as treated from lineitem),
p as (select l_linestatus, l_suppkey, quantile_cont(x, 0.9) as p90 from d where treated = 0 group by 1, 2)
select d.l_linestatus, treated, count(*) as n, round(avg((x > 50000)::int), 6) as share_gt_50000, round(avg((x > 90000)::int), 6) as share_gt_90000,
  round(avg(coalesce(x > p90, false)::int), 6) as share_gt_own_p90, round(quantile_cont(x, 0.5), 4) as median_abs from d left join p using (l_linestatus, l_suppkey) group by 1, 2""")
def marginal_value_stats(t):
    d = t.lineitem.select("l_linestatus", "l_suppkey", F.col("l_extendedprice").alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("treated"))
    d = op.exceedance_stats(d, ["l_linestatus"], "l_suppkey", "x", "treated", [50000, 90000]).withColumnRenamed("share_gt_9e+04", "share_gt_90000")
    return rounded(rounded(d, ["share_gt_50000", "share_gt_90000", "share_gt_own_p90"]), ["median_abs"], 4)


@query("a20_booking_reliability", """with a as (select o_orderkey, year(o_orderdate) as yr, o_orderstatus = 'P' as withdrawn, o_orderdate as sched, min(l_shipdate) as act, count(l_orderkey) > 0 as invoked
  from orders left join lineitem on o_orderkey = l_orderkey group by all)
select yr, count(*) as episodes, round(avg(withdrawn::int), 6) as withdrawn_share, round(avg(invoked::int) filter (not withdrawn), 6) as invoked_share,
  round(quantile_cont(date_diff('second', sched, act) / 3600, 0.5) filter (not withdrawn and act is not null), 6) as start_shift_h_p50,
  round(avg((act < sched + interval 10 days)::int) filter (not withdrawn and act is not null), 6) as early_share from a group by 1""")
def booking_reliability(t):
    from ..operators.ranks import quantiles
    first = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("act"))
    a = t.orders.join(first, "o_orderkey", "left").select(
        F.year("o_orderdate").alias("yr"), (F.col("o_orderstatus") == "P").alias("w"), F.col("act").isNotNull().alias("invoked"),
        ((cal.micros(F.col("act")) - cal.micros(F.col("o_orderdate"))) / 3_600_000_000.0).alias("shift"))
    live = ~F.col("w")
    s = a.groupBy("yr").agg(F.count(F.lit(1)).alias("episodes"), r6(F.avg(F.col("w").cast("int"))).alias("withdrawn_share"),
                            r6(F.avg(F.when(live, F.col("invoked").cast("int")))).alias("invoked_share"),
                            r6(F.avg(F.when(live & F.col("invoked"), (F.col("shift") < 240).cast("int")))).alias("early_share"))
    q = quantiles(a.filter(live & F.col("invoked")), ["yr"], "shift", {"start_shift_h_p50": 0.5}).drop("n_values")
    return rounded(s.join(q, "yr", "left"), ["start_shift_h_p50"])


@query("a21_effect_ranking", """with e as (select l_suppkey, l_returnflag, l_orderkey, avg(l_discount * l_quantity) as v from lineitem group by 1, 2, 3)
select l_suppkey, l_returnflag, count(*) as n, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as sd, round(stddev_samp(v) / sqrt(count(*)), 6) as se,
  case when count(*) < 200 then 'exploratory association' else 'supported association; not causal' end as evidence from e group by 1, 2""")
def effect_ranking(t):
    d = t.lineitem.withColumn("v", F.col("l_discount") * F.col("l_quantity"))
    return rounded(op.effect_ranking(d, ["l_suppkey", "l_returnflag"], "l_orderkey", "v", 200), ["mean", "sd", "se"])


@query("a22_hourly_rollup", """with h as (select event_type as target, time_bucket(interval '30 minutes', ts - interval 1 microsecond) + interval 30 minutes as half, round(sum(value), 2) as mw, max(user_id % 10 <> 0) as ok from events group by 1, 2)
select target, time_bucket(interval '1 hour', half - interval 1 microsecond) + interval 1 hour as delivery, case when count(*) = 2 and bool_and(ok) then round(case when target = 'view' then min(mw) else avg(mw) end, 6) end as mw,
  case when count(*) = 2 and bool_and(ok) then 'complete' else 'unavailable' end as status from h group by 1, 2""")
def hourly_rollup(t):
    h = t.events.groupBy(F.col("event_type").alias("target"), cal.interval_ceiling(F.col("ts")).alias("half")).agg(
        F.round(F.sum("value"), 2).alias("mw"), F.max(F.col("user_id") % 10 != 0).alias("ok"))
    h = h.withColumn("delivery", cal.interval_ceiling(F.col("half"), 3600))
    return rounded(op.complete_rollup(h, ["target"], "delivery", "mw", F.col("target") == "view", F.col("ok"), 2), ["mw"])


@query("a23_unit_influence", """with d as (select l_suppkey as unit, l_shipdate as time, l_orderkey, l_linenumber, l_partkey, l_quantity - 25 as x, l_discount - 0.05 as m, l_returnflag = 'R' as con from lineitem),
top as (select unit, count(*) as c from (select unit, row_number() over (partition by time order by abs(x) desc, l_orderkey, l_linenumber, l_partkey, unit) as rn from d where abs(x) > 1e-9) where rn = 1 group by 1),
r as (select unit, rank() over (partition by unit order by x) + (count(*) over (partition by unit, x) - 1) / 2 as a, rank() over (partition by unit order by round(m, 2)) + (count(*) over (partition by unit, round(m, 2)) - 1) / 2 as b from d),
c as (select unit, case when count(*) >= 20 then corr(a, b) end as rho from r group by 1),
s as (select unit, count(*) as rows, count(distinct time) as intervals, sum(abs(x)) as total_abs, avg(abs(x)) as mean_abs, quantile_cont(abs(x), 0.95) as p95, sum(greatest(x, 0)) as tightening,
  count(*) filter (con) as con_rows, avg(x) filter (con) as con_mean from d group by 1)
select s.unit, rows, intervals, total_abs, round(mean_abs, 6) as mean_abs, round(p95, 6) as p95, tightening, coalesce(c, 0) as top_intervals, round(rho, 6) as rho, con_rows, round(con_mean, 6) as con_mean,
  rank() over (order by total_abs desc) as overall_rank, case when con_rows >= 20 then rank() over (order by case when con_rows >= 20 then round(con_mean, 6) end desc nulls last) end as con_rank
from s left join top using (unit) left join c on c.unit = s.unit""")
def unit_influence(t):
    from ..operators.ranks import quantiles, rank_correlation
    d = t.lineitem.select(F.col("l_suppkey").alias("unit"), F.col("l_shipdate").alias("time"), "l_orderkey", "l_linenumber", "l_partkey",
                          (F.col("l_quantity") - 25).alias("x"), r6(F.col("l_discount") - 0.05, 2).alias("m"), (F.col("l_returnflag") == "R").alias("con"))
    x = F.col("x")
    s = d.groupBy("unit").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("time").alias("intervals"), F.sum(F.abs(x)).alias("total_abs"), F.avg(F.abs(x)).alias("mean_abs"),
                              F.sum(F.greatest(x, F.lit(0.0))).alias("tightening"), F.count(F.when(F.col("con"), 1)).alias("con_rows"), F.avg(F.when(F.col("con"), x)).alias("con_mean"))
    q = quantiles(d.withColumn("ax", F.abs(x)), ["unit"], "ax", {"p95": 0.95}).drop("n_values")
    top = rev.top_k(d.filter(F.abs(x) > 1e-9), ["time"], [F.desc(F.abs(x)), "l_orderkey", "l_linenumber", "l_partkey", "unit"], 1).groupBy("unit").agg(F.count(F.lit(1)).alias("top_intervals"))
    rho = rank_correlation(d, ["unit"], "x", "m").drop("n_pairs")
    out = s.join(q, "unit").join(top, "unit", "left").join(rho, "unit", "left").withColumn("top_intervals", F.coalesce("top_intervals", F.lit(0)))
    out = rounded(out, ["mean_abs", "p95", "rho", "con_mean"])
    gated = out.withColumn("_g", F.when(F.col("con_rows") >= 20, F.col("con_mean")))
    return op.min_rank(op.min_rank(gated, "total_abs", "overall_rank"), "_g", "con_rank").drop("_g")


@query("a24_weekly_outlook", """with d as (select date_trunc('week', l_shipdate) as week, l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, l_quantity from lineitem)
select week, l_returnflag, count(distinct l_orderkey) as outages, count(*) filter (l_discount > 0.05) as supported_rows, min(-l_quantity) as largest_reduction, max(l_linenumber) as overlap_max,
  arg_max(l_partkey, (l_discount, l_partkey)) as top_eq, max(l_discount) as top_p from d group by 1, 2""")
def weekly_outlook(t):
    return t.lineitem.groupBy(F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("week"), "l_returnflag").agg(
        F.countDistinct("l_orderkey").alias("outages"), F.count(F.when(F.col("l_discount") > 0.05, 1)).alias("supported_rows"), F.min(-F.col("l_quantity")).alias("largest_reduction"),
        F.max("l_linenumber").alias("overlap_max"), F.max_by("l_partkey", F.struct("l_discount", "l_partkey")).alias("top_eq"), F.max("l_discount").alias("top_p"))


@query("a25_conditional_catalogue", """with d as (select event_type as key, hour(ts) as slot, value, date_trunc('day', ts) as day, ['u' || (user_id % 40), 'g' || (user_id % 7)] as toks, json_extract(props, '$.k')::int as k, user_id from events),
r as (select *, 'all' as regime from d union all select *, 'high k' from d where k >= 60 union all select *, 'set 3' from d where list_contains(toks, 'g3')),
e as (select key, slot, regime, count(distinct tok) as episodes from (select key, slot, regime, unnest(toks) as tok from r) group by 1, 2, 3)
select key, slot, regime, count(*) as n, count(distinct day) as days, round(avg((value < 10)::int), 6) as restricted_share, any_value(episodes) as episodes, round(quantile_cont(value, 0.1), 6) as p10,
  round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.9), 6) as p90, case when count(distinct day) >= 5 and any_value(episodes) >= 6 then 'supported' else 'indicative' end as status from r join e using (key, slot, regime) group by 1, 2, 3""")
def conditional_catalogue(t):
    u = F.col("user_id")
    d = t.events.select(F.col("event_type").alias("key"), F.hour("ts").alias("slot"), "value", cal.floor_time(F.col("ts"), 86400).alias("day"),
                        F.array(F.concat(F.lit("u"), (u % 40).cast("string")), F.concat(F.lit("g"), (u % 7).cast("string"))).alias("toks"),
                        F.get_json_object("props", "$.k").cast("int").alias("k"))
    d = op.condition_catalogue(d, {"all": F.lit(True), "high k": F.col("k") >= 60, "set 3": F.array_contains("toks", "g3")}, ["key", "slot"], "value", "toks", "day", 10, 5, 6)
    return rounded(d, ["restricted_share", "p10", "p50", "p90"])


@query("a26_flow_response", """with e as (select l_suppkey, l_returnflag, avg(l_quantity) - 25 as cap, avg(l_discount) * 100 - 5 as flow from lineitem group by 1, 2)
select l_suppkey, l_returnflag, round(cap, 6) as cap, case when abs(cap) > 0.2 then round(flow / cap, 5) end as pass_through, case when abs(cap) > 0.2 then round((cap - flow) / cap, 5) end as headroom_absorbed from e""")
def flow_response(t):
    e = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg((F.avg("l_quantity") - 25).alias("cap"), (F.avg("l_discount") * 100 - 5).alias("flow"))
    big = F.abs("cap") > 0.2
    return e.select("l_suppkey", "l_returnflag", r6("cap").alias("cap"), F.when(big, r6(F.col("flow") / F.col("cap"), 5)).alias("pass_through"),
                    F.when(big, r6((F.col("cap") - F.col("flow")) / F.col("cap"), 5)).alias("headroom_absorbed"))


@query("a27_weighted_pool", """with s as (select l_suppkey, l_returnflag, count(*) as n, avg(abs(l_quantity - 25)) as mae, sqrt(avg((l_quantity - 25) * (l_quantity - 25))) as rmse from lineitem group by 1, 2)
select l_returnflag, sum(n)::bigint as n, round(sum(n * mae) / sum(n), 6) as mae, round(sqrt(sum(n * rmse * rmse) / sum(n)), 6) as rmse from s group by 1""")
def weighted_pool(t):
    e = F.col("l_quantity") - 25
    s = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    return rounded(op.weighted_pool(s, ["l_returnflag"], "n", ["mae"], ["rmse"]), ["mae", "rmse"])
