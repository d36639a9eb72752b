"""Event detection and attribution on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import events as op
from ..operators import revisions as rev
from ..operators import sequence as seq
from .aggregates import rounded
from .registry import query
from .standins import GRID, PAIRS, grid, pair_panel, r6, ts, week

# A fall over three hours; the period is the week.
FALL = GRID + """, fl as (select *, date_trunc('week', time - interval 1 microsecond) as week, lag(v, 3) over w - v as fall, count(v) over (partition by key order by time rows 3 preceding) = 4 as complete
  from grid window w as (partition by key order by time))"""
DET = FALL + """, th as (select key, week, case when count(*) >= 3 then quantile_cont(fall, 0.8) end as threshold from fl where fall > 0 group by 1, 2),
sh as (select fl.*, threshold, coalesce(complete and fall > 0 and fall >= threshold, false) as sharp from fl left join th using (key, week)),
dt as (select *, sharp and not lag(sharp, 1, false) over (partition by key order by time) as onset from sh)"""


def detector(t):
    g = grid(t).select("key", "time", "v", "k", "setter").withColumn("week", week())
    return op.contractions(g, ["key"], "time", "v", "week", lag=3, reach="3 hours", p=0.8, minimum=3)


@query("e1_contraction_detector", f"with {DET} select key, time, round(fall, 4) as fall, round(threshold, 6) as threshold, sharp::int as sharp, onset::int as onset from dt")
def contraction_detector(t):
    d = detector(t)
    return d.select("key", "time", r6("drop", 4).alias("fall"), r6("threshold").alias("threshold"), F.col("sharp").cast("int").alias("sharp"),
                    F.col("onset").cast("int").alias("onset"))


@query("e2_frozen_detector", f"""with {FALL}, h as (select * from fl where time < '2024-01-20' and complete and fall > 0),
o as (select key, hour(time) as part, case when count(*) >= 3 then quantile_cont(fall, 0.8) end as q from h group by 1, 2), a as (select key, case when count(*) >= 3 then quantile_cont(fall, 0.8) end as q from h group by 1),
s as (select fl.key, time, fall, complete, coalesce(o.q, a.q) as threshold from fl left join o on o.key = fl.key and o.part = hour(time) left join a on a.key = fl.key),
x as (select *, coalesce(complete and fall > 0 and fall >= threshold, false) as sharp from s)
select key, time, round(threshold, 6) as threshold, sharp::int as sharp, (sharp and not lag(sharp, 1, false) over w and coalesce(lag(complete, 1, false) over w, false))::int as onset from x window w as (partition by key order by time)""")
def frozen_detector(t):
    g = grid(t).select("key", "time", "v").withColumn("part", F.hour("time"))
    d = op.frozen_contractions(g, ["key"], "time", "v", "part", F.col("time") < ts("2024-01-20"), lag=3, reach="3 hours", p=0.8, minimum=3)
    return d.select("key", "time", r6("threshold").alias("threshold"), F.col("sharp").cast("int").alias("sharp"), F.col("onset").cast("int").alias("onset"))


PATH = """ev as (select key, time as att from dt where onset), bs as (select ev.key, att, max(v) as base from ev join grid on grid.key = ev.key and time between att - interval 3 hours and att group by 1, 2)"""


@query("e3_event_landmarks", f"""with recursive {DET}, {PATH},
p as (select bs.key, att, base, o, att + to_hours(o::int) as time from bs, (select unnest(range(0, 9)) as o)),
s as (select p.*, v from p left join grid on grid.key = p.key and grid.time = p.time),
walk as (select key, att, -1::bigint as o, null::double as trough, null::timestamp as tt, 0 as streak, null::timestamp as since, null::timestamp as rec, false as done from bs
  union all
  select w.key, w.att, s.o, case when w.done or s.v is null then w.trough when w.trough is null or s.v < w.trough then s.v else w.trough end,
    case when w.done or s.v is null then w.tt when w.trough is null or s.v < w.trough then s.time else w.tt end,
    case when w.done or s.v is null then w.streak when s.base > least(coalesce(w.trough, s.v), s.v) and s.v >= least(coalesce(w.trough, s.v), s.v) + 0.9 * (s.base - least(coalesce(w.trough, s.v), s.v))
      then case when w.trough is null or s.v < w.trough then 0 else w.streak end + 1 else 0 end,
    case when w.done or s.v is null then w.since when s.base > least(coalesce(w.trough, s.v), s.v) and s.v >= least(coalesce(w.trough, s.v), s.v) + 0.9 * (s.base - least(coalesce(w.trough, s.v), s.v))
      then case when w.trough is null or s.v < w.trough or w.streak = 0 then s.time else w.since end end,
    case when w.done or s.v is null then w.rec when s.base > least(coalesce(w.trough, s.v), s.v) and s.v >= least(coalesce(w.trough, s.v), s.v) + 0.9 * (s.base - least(coalesce(w.trough, s.v), s.v)) and w.streak + 1 >= 3 then w.since end,
    w.done or s.v is null or (s.base > least(coalesce(w.trough, s.v), s.v) and s.v >= least(coalesce(w.trough, s.v), s.v) + 0.9 * (s.base - least(coalesce(w.trough, s.v), s.v)) and w.streak + 1 >= 3)
  from walk w join s on s.key = w.key and s.att = w.att and s.o = w.o + 1)
select key, att as event_time, trough, tt as trough_time, rec as recovery from walk where o = 8""")
def event_landmarks(t):
    d = detector(t)
    ev = d.filter("onset").select("key", F.col("time").alias("event_time"))
    s = grid(t).select("key", "time", "v")
    base = op.around(ev, s, ["key"], "event_time", "time", -3, 0, "1 hour").groupBy("key", "event_time").agg(F.max("v").alias("base"))
    path = op.around(base, s, ["key"], "event_time", "time", 0, 8, "1 hour")
    return op.landmarks(path, ["key", "event_time"], "base", "time", "v")


@query("e4_event_catalogue", f"""with {DET}, ev as (select key, time as att, fall, v as cap from dt where onset),
w as (select ev.key, att, any_value(fall) as fall, any_value(cap) as cap, max(v) filter (time <= att and time >= att - interval 3 hours) as baseline, max(k) filter (time >= att) as peak, quantile_cont(k, 0.5) filter (time < att) as before,
  count(*) filter (time >= att and k > 150) as high_intervals, (count(k) filter (time >= att) = 7)::int as complete from ev join grid on grid.key = ev.key and time between att - interval 6 hours and att + interval 6 hours group by 1, 2)
select key, att as event_time, round(fall, 4) as fall, cap, baseline, peak, round(before, 4) as before, round(peak - before, 4) as jump, high_intervals, complete from w""")
def event_catalogue(t):
    ev = detector(t).filter("onset").select("key", F.col("time").alias("event_time"), F.col("drop").alias("fall"), F.col("v").alias("cap"))
    s = grid(t).select("key", "time", "v", "k")
    w = op.around(ev, s, ["key"], "event_time", "time", -6, 6, "1 hour")
    o = F.col("offset")
    d = w.groupBy("key", "event_time").agg(
        F.max("fall").alias("fall"), F.max("cap").alias("cap"), F.max(F.when((o <= 0) & (o >= -3), F.col("v"))).alias("baseline"), F.max(F.when(o >= 0, F.col("k"))).alias("peak"),
        F.percentile(F.when(o < 0, F.col("k")), F.lit(0.5)).alias("before"),   # at most six rows per event
        F.count(F.when((o >= 0) & (F.col("k") > 150), 1)).alias("high_intervals"), (F.count(F.when(o >= 0, F.col("k"))) == 7).cast("int").alias("complete"))
    return rounded(d.withColumn("jump", F.col("peak") - F.col("before")), ["fall", "before", "jump"], 4)


@query("e5_price_episode_link", f"""with {DET}, ep as (select key, time from (select *, coalesce(k > 60, false) as hi, lag(coalesce(k > 60, false), 1, false) over (partition by key order by time) as was from grid) where hi and not was),
ev as (select key, time, strftime(time, '%Y%m%dT%H') as id from dt where onset)
select ep.key, ep.time, nullif(string_agg(id, ';' order by id), '') as linked, count(id) as n_linked from ep left join ev on ev.key = ep.key and ev.time between ep.time - interval 6 hours and ep.time + interval 6 hours group by 1, 2""")
def price_episode_link(t):
    from ..operators.windows import onset
    ep = onset(grid(t).select("key", "time", "k"), ["key"], "time", F.col("k") > 60, "on", "1 hour").filter("on").select("key", "time")
    ev = detector(t).filter("onset").select("key", "time", F.date_format("time", "yyyyMMdd'T'HH").alias("id"))
    return op.linked_events(ep, ev, ["key"], "time", "time", "id", 6, "1 hour")


# Seven monthly equations (line number), three units (return flag).
EQ7 = """q as (select date_trunc('month', l_shipdate) as month, l_linenumber as eq, any_value(l_linenumber - 4) as a, sum(l_quantity) as flow, round(sum(l_extendedprice), 2) as rhs, sum(l_quantity) * 2000 as lhs from lineitem where l_linenumber <> 4 group by 1, 2),
b as (select *, case when a > 0 then 'upper' else 'lower' end as side, round(flow + (rhs - lhs) / a, 4) as bound from q),
ld as (select * from (select *, row_number() over (partition by month, side order by case when side = 'upper' then bound else -bound end, eq) as rn from b) where rn = 1),
st as (select *, lag(month) over w as pm, lag(eq) over w as oeq, lag(bound) over w as obound, lag(rhs) over w as orhs, lag(lhs) over w as olhs, lag(flow) over w as oflow from ld window w as (partition by side order by month)),
un as (select date_trunc('month', l_shipdate) as month, l_returnflag as unit, sum(l_quantity) as mw from lineitem group by 1, 2),
tm as (select distinct l_linenumber as eq, l_returnflag as unit, l_linenumber * 0.5::double + ascii(l_returnflag) - 70 as f from lineitem)"""


def monthly_equations(t):
    li = t.lineitem.withColumn("month", cal.month_start(F.col("l_shipdate")))
    b = li.filter("l_linenumber <> 4").groupBy("month", F.col("l_linenumber").alias("eq")).agg(
        F.sum("l_quantity").alias("flow"), F.round(F.sum("l_extendedprice"), 2).alias("rhs"), (F.sum("l_quantity") * 2000).alias("lhs"))
    b = b.withColumn("a", (F.col("eq") - 4).cast("double")).withColumn("side", F.when(F.col("a") > 0, "upper").otherwise("lower"))
    b = b.withColumn("bound", F.round(F.col("flow") + (F.col("rhs") - F.col("lhs")) / F.col("a"), 4))
    toward = F.when(F.col("side") == "upper", F.col("bound")).otherwise(-F.col("bound"))
    lead = rev.top_k(b, ["month", "side"], [toward, F.col("eq")], 1)
    st = seq.previous(lead, ["side"], ["month"], {"pm": "month", "old_eq": "eq", "old_bound": "bound", "old_rhs": "rhs", "old_lhs": "lhs", "old_flow": "flow"}, hours=24 * 3660)
    units = li.groupBy("month", F.col("l_returnflag").alias("unit")).agg(F.sum("l_quantity").alias("mw"))
    terms = li.select(F.col("l_linenumber").alias("eq"), F.col("l_returnflag").alias("unit")).distinct().withColumn(
        "f", F.col("eq") * 0.5 + F.ascii("unit") - 70)
    return st.filter("pm is not null"), units, terms


@query("e6_step_attribution", f"""with {EQ7}, g as (select st.month, st.side, sum(f * (u1.mw - u0.mw)) as gd from st join tm on tm.eq = st.eq join un u1 on u1.month = st.month and u1.unit = tm.unit join un u0 on u0.month = st.pm and u0.unit = tm.unit group by 1, 2),
s as (select st.*, coalesce(gd, 0) as gd, case when side = 'upper' then 1 else -1 end as sg, rhs - orhs as observed from st left join g using (month, side) where pm is not null)
select month, side, eq, oeq as old_eq, round(case when eq = oeq then sg * gd / a else 0 end, 3) as generator, round(case when eq = oeq then -sg * (rhs - orhs) / a else 0 end, 3) as rhs,
  round(case when eq = oeq then sg * ((lhs - olhs) - a * (flow - oflow) - gd) / a else 0 end, 3) as other_lhs, round(case when eq <> oeq then -sg * (bound - obound) else 0 end, 3) as switch,
  round(observed + sg * (bound - obound), 3) as unresolved from s""")
def step_attribution(t):
    st, units, terms = monthly_equations(t)
    gen = (st.select("month", "side", "eq", "pm").join(terms, "eq").join(units, ["month", "unit"])
           .join(units.select(F.col("month").alias("pm"), "unit", F.col("mw").alias("mw0")), ["pm", "unit"]).groupBy("month", "side").agg(
        F.sum(F.col("f") * (F.col("mw") - F.col("mw0"))).alias("gen_delta")))
    d = st.select("month", "side", "eq", "a", F.col("eq").alias("new_eq"), F.col("bound").alias("new_bound"), F.col("rhs").alias("new_rhs"), F.col("lhs").alias("new_lhs"),
                  F.col("flow").alias("new_flow"), "old_eq", "old_bound", "old_rhs", "old_lhs", "old_flow", F.when(F.col("side") == "upper", 1.0).otherwise(-1.0).alias("sign"),
                  (F.col("rhs") - F.col("old_rhs")).alias("observed"))
    d = op.step_attribution(d, gen, ["month", "side"])
    return rounded(d.select("month", "side", "eq", "old_eq", "generator", "rhs", "other_lhs", "switch", "unresolved"), ["generator", "rhs", "other_lhs", "switch", "unresolved"], 3)


@query("e7_equation_render", """
with f as (select l_partkey as eq, 'S' || l_suppkey as unit, round(max(l_tax) * 100) - 4.5 as f, any_value(round(0.5 + l_partkey % 7, 1)) as a from lineitem group by 1, 2)
select eq, regexp_replace(printf('%.4f', max(a)), '\\.?0+$', '') || ' * F_LINK ' || string_agg(case when f < 0 then '' else '+' end || regexp_replace(printf('%.4f', f), '\\.?0+$', '') || ' * P[' || unit || ']', ' ' order by unit) || ' + Z <= RHS(t)' as equation from f group by 1""")
def equation_render(t):
    f = t.lineitem.groupBy(F.col("l_partkey").alias("eq"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("unit")).agg((F.round(F.max("l_tax") * 100) - 4.5).alias("f"))
    f = f.withColumns({"a": 0.5 + F.col("eq") % 7, "rel": F.lit("<=")})
    return op.rendered_equations(f, ["eq"], "a", "rel", "unit", "f", "F_LINK")


@query("e8_evidence_windows", """
select distinct unnest(generate_series(date_trunc('hour', ts) - interval 2 hours, date_trunc('hour', ts) + interval 2 hours, interval 5 minutes)) as time from events where event_type = 'purchase' and value > 60""")
def evidence_windows(t):
    d = t.events.filter("event_type = 'purchase' and value > 60").select(cal.floor_time(F.col("ts"), 3600).alias("at"))
    return op.evidence_stamps(d, "at", "2 hours", "2 hours", "5 minutes")


@query("e9_leave_one_day_out", f"""with {PAIRS}, dd as (select o, d, week, strftime(time - interval 1 microsecond, '%Y-%m-%d') as day, round(sum(pd - po), 2) as s, count(*) as n from pp where po is not null and pd is not null group by 1, 2, 3, 4),
r as (select *, row_number() over (partition by o, d, week order by abs(s) desc, day) as rk from dd)
select o, d, week, round(sum(s) / sum(n), 6) as spread, round(sum(s) filter (rk > 1) / sum(n) filter (rk > 1), 6) as without_top_day, round(sum(s) filter (rk > 3) / sum(n) filter (rk > 3), 6) as without_top3_days,
  max(day) filter (rk = 1) as top_day, round(100 * max(s) filter (rk = 1) / nullif(round(sum(s), 2), 0), 6) as top_day_share, (sign(sum(s) / sum(n)) <> sign(sum(s) filter (rk > 1) / sum(n) filter (rk > 1)))::int as sign_flip from r group by 1, 2, 3""")
def leave_one_day_out(t):
    p = pair_panel(t).filter("po is not null and pd is not null").withColumn("day", F.date_format(F.col("time") - F.expr("interval 1 microsecond"), "yyyy-MM-dd"))
    days = p.groupBy("o", "d", "week", "day").agg(F.round(F.sum(F.col("pd") - F.col("po")), 2).alias("s"), F.count(F.lit(1)).alias("n"))
    return rounded(op.without_top_days(days, ["o", "d", "week"], "day", "s", "n"), ["spread", "without_top_day", "without_top3_days", "top_day_share"])


@query("j14_nearest_control", f"""with {DET}, ev as (select key || '-' || strftime(time, '%Y%m%dT%H') as event_id, key, time, v, n, isodow(time) < 6 as wd from dt where onset),
c as (select event_id, c.time as control_time, e.v, e.n, c.v as cv, c.n as cn from ev e join grid c on c.key = e.key and c.v is not null and abs(hour(c.time) - hour(e.time)) <= 1 and (isodow(c.time) < 6) = e.wd and date_trunc('month', c.time) = date_trunc('month', e.time)
  and abs(date_diff('second', c.time, e.time)) > 86400),
s as (select event_id, count(*) as pool, coalesce(nullif(stddev_samp(cv), 0), 1) as sv, coalesce(nullif(stddev_samp(cn), 0), 1) as sn from c group by 1 having count(*) >= 5),
d as (select event_id, control_time, pool, round(sqrt(((v - cv) / sv) ^ 2 + ((n - cn) / sn) ^ 2), 9) as distance from c join s using (event_id)),
r as (select *, row_number() over (partition by event_id order by distance, control_time) as rn from d)
select event_id, control_time, pool, round(distance, 6) as distance from r where rn = 1 and distance <= 5""")
def nearest_control(t):
    g = grid(t).select("key", "time", "v", "n").withColumns({"month": cal.month_start(F.col("time")), "wd": (F.weekday("time") < 5)})
    from ..operators.sequence import micros
    d = detector(t).filter("onset").select("key", "time").join(g, ["key", "time"])
    near = F.explode(F.array(*[F.hour("time") + k for k in (-1, 0, 1)]))
    ev = d.withColumns({"event_id": F.concat("key", F.lit("-"), F.date_format("time", "yyyyMMdd'T'HH")), "hour": near}).filter("hour between 0 and 23")
    pool = g.filter("v is not null").withColumn("hour", F.hour("time"))
    apart = F.abs(micros(F.col("control_time")) - micros(F.col("time"))) > 86_400_000_000
    return rounded(op.nearest_control(ev, pool, "event_id", ["key", "month", "hour", "wd"], ["v", "n"], apart, 5.0), ["distance"])


@query("x16_event_rate", f"""with {DET} select key, week, count(*) filter (complete) as valid_hours, count(*) filter (onset) as events, round(1000 * (count(*) filter (onset)) / (count(*) filter (complete)), 6) as per_1000_hours from dt group by 1, 2 having count(*) filter (complete) > 0""")
def event_rate(t):
    from ..session import cut
    d = cut(detector(t), "detector")
    return rounded(op.event_rate(d.filter("onset"), d.filter("complete"), ["key", "week"], 1.0), ["per_1000_hours"]).withColumn("valid_hours", F.col("valid_hours").cast("long"))


@query("x17_preceding_flag", f"with {GRID} select key, time, coalesce(max((v > 60)::int) over (partition by key order by time rows between 6 preceding and 1 preceding), 0) as preceded from grid")
def preceding_flag(t):
    f = F.coalesce((F.col("v") > 60).cast("int"), F.lit(0))
    d = seq.windowed(grid(t).select("key", "time", "v").withColumn("f", f), ["key"], "time", lambda w: {"preceded": F.coalesce(F.max("f").over(w.rowsBetween(-6, -1)), F.lit(0))}, before="6 hours")
    return d.select("key", "time", "preceded")
