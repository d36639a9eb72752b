"""Smaller table operators on the driver tables."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text
from ..operators import forecast as fo
from ..operators import lookups as lk
from ..operators import models as ml
from ..operators import outages as ou
from ..operators import ranks
from ..operators import regimes as rg
from ..operators import resample as rs
from ..operators import revisions as rev
from ..operators import sequence as seq
from ..operators import tables as op
from ..session import cut
from . import constraints as con
from . import outages as po
from .aggregates import rounded
from .cleaning import BOOK, bookings
from .joins import CHAIN, chain
from .registry import query
from .resampling import DAYS, boot_sql, days, draws, effect
from .standins import FC, GRID, SPELLS, blended, grid, published_grid, r6, spells, ts


@query("x1_lagged_state_frame", f"""with {GRID} select key, time, lag(v, 1) over w as v_lag1, lag(v, 24) over w as v_lag24, round(lag(v, 1) over w - lag(v, 2) over w, 4) as v_delta, lag(k, 1) over w as k_late, lag(setter, 1) over w as setter_late from grid window w as (partition by key order by time)""")
def lagged_state_frame(t):
    return rounded(op.delayed_state(grid(t), ["key"], "time", ["v"], ["k", "setter"], [1, 24], "24 hours"), ["v_delta"], 4)


@query("x2_harmonic_expansion", """with d as (select event_id, value, 2 * pi() * (hour(ts) + minute(ts) / 60) / 24 as ph, hour(ts) between 6 and 9 as am, hour(ts) between 16 and 20 as pm from events)
select event_id, round(sin(2 * ph), 6) as sin_2, round(cos(2 * ph), 6) as cos_2, round(sin(3 * ph), 6) as sin_3, round(cos(3 * ph), 6) as cos_3, am::int as gate_am, pm::int as gate_pm, case when am then value else 0 end as value_am, case when pm then value else 0 end as value_pm from d""")
def harmonic_expansion(t):
    h = F.hour("ts")
    terms = op.harmonics((h + F.minute("ts") / 60) * (2 * math.pi / 24), 3, {"am": h.between(6, 9), "pm": h.between(16, 20)}, {"value": F.col("value")})
    return rounded(t.events.select("event_id", *[c.alias(n) for n, c in terms.items()]), ["sin_2", "cos_2", "sin_3", "cos_3"])


@query("x3_capacity_reference", f"""with {GRID}, q as (select key, quantile_cont(abs(v), 0.1) as f, quantile_cont(abs(v), 0.5) as m from grid where time < '2024-01-15' and abs(v) > 0 group by 1) select grid.key, time, round(greatest(coalesce(abs(v), m), f), 6) as reference from grid join q using (key)""")
def capacity_reference(t):
    g = grid(t).select("key", "time", "v")
    return rounded(op.capacity_reference(g.filter(F.col("time") < ts("2024-01-15")), g, ["key"], "v").select("key", "time", "reference"), ["reference"])


@query("x4_boundary_jumps", f"""with {FC} select key, origin, lead, round(fj, 4) as forecast_jump, round(aj, 4) as actual_jump from (select *, lag(band) over w as b, persistence - lag(persistence) over w as fj, actual - lag(actual) over w as aj from fb window w as (partition by key, origin order by lead)) where b is not null and b <> band""")
def boundary_jumps(t):
    return rounded(op.boundary_jumps(blended(t), ["key", "origin"], "lead", "band", "persistence", "actual").select("key", "origin", "lead", "forecast_jump", "actual_jump"), ["forecast_jump", "actual_jump"], 4)


@query("x5_freshness_gate", """with o as (select unnest(generate_series(timestamp '2024-01-02', timestamp '2024-01-27', interval 30 minutes)) as origin), r as (select distinct ts from events where event_type = 'view'), j as (select origin, r.ts >= origin - interval 90 minutes as fresh from o asof left join r on origin >= r.ts)
select case when origin < '2024-01-15' then 'train' else 'test' end as part, count(*) as n, round(avg(coalesce(fresh, false)::int), 6) as fresh_share from j group by 1""")
def freshness_gate(t):
    o = t.spark.range(1).select(F.explode(F.sequence(ts("2024-01-02"), ts("2024-01-27"), F.expr("interval 30 minutes"))).alias("origin"))
    r = t.events.filter("event_type = 'view'").select(F.col("ts").alias("report"))
    d = lk.recently(o, r, "origin", "report", 5_400_000_000, "fresh")
    return d.groupBy(F.when(F.col("origin") < ts("2024-01-15"), "train").otherwise("test").alias("part")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("fresh").cast("int"))).alias("fresh_share"))


@query("x6_incident_support", """with i as (select event_type as key, event_id, ts from events where value > 40), o as (select event_type as key, ts as origin from events where value > 15)
select i.key, case when ts < '2024-01-15' then 'train' else 'test' end as part, count(*) as incidents, count(*) filter (exists (select 1 from o where o.key = i.key and o.origin between i.ts - interval 120 minutes and i.ts - interval 30 minutes)) as eligible from i group by 1, 2""")
def incident_support(t):
    i = t.events.filter("value > 40").select(F.col("event_type").alias("key"), "event_id", F.col("ts").alias("at"))
    o = t.events.filter("value > 15").select(F.col("event_type").alias("key"), F.col("ts").alias("origin"))
    ok = op.supported_incidents(o, i, ["key"], "origin", "at", "30 minutes", "120 minutes", ["event_id"]).select("event_id", F.lit(1).alias("ok"))
    return i.join(ok, "event_id", "left").groupBy("key", F.when(F.col("at") < ts("2024-01-15"), "train").otherwise("test").alias("part")).agg(F.count(F.lit(1)).alias("incidents"), F.count("ok").alias("eligible"))


@query("x7_paired_power", """with e as (select event_type as key, count(*) as n, round(0.2 + 0.5 * avg((user_id % 3 > 0)::int), 6) as b from events where value > 45 group by 1), g as (select *, unnest([0.1, 0.25]::double[]) as gain from e), p as (select *, least(b + gain, 0.99) as c from g), q as (select *, b * c + 0.3 * (least(b, c) - b * c) as bo from p),
d as (select key, gain, r, ('0x' || left(md5(concat_ws('|', key, gain, r, i, 741)), 8))::bigint / 4294967296 as u, c - bo as p10, b - bo as p01 from q, range(0, 50) a(r), (select unnest(range(1, (select max(n) from q) + 1)) as i) z where i <= n), s as (select key, gain, r, count(*) filter (u < p10) as w, count(*) filter (u >= p10 and u < p10 + p01) as l from d group by 1, 2, 3)
select key, gain, round(avg(coalesce((w - l) / sqrt(nullif(w + l, 0)) > 1.96, false)::int), 6) as power from s group by 1, 2""")
def paired_power(t):
    e = t.events.filter("value > 45").groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("user_id") % 3 > 0).cast("int")) * 0.5 + 0.2, 6).alias("b"))
    return rounded(op.paired_power(e, ["key"], "n", "b", [0.1, 0.25], 0.3, 50, 741), ["power"])


@query("x8_common_rows", f"""with {FC}, l as (select key, origin, lead, unnest(['persistence', 'seasonal', 'blend']) as method, unnest([persistence, seasonal, blend]) as f from fb where actual is not null), ok as (select key, origin, lead from l group by 1, 2, 3 having count(f) = 3)
select key, method, count(*) as n from l join ok using (key, origin, lead) group by 1, 2""")
def common_rows(t):
    m = ["persistence", "seasonal", "blend"]
    d = blended(t).filter("actual is not null").select("key", "origin", "lead", *m).unpivot(["key", "origin", "lead"], m, "method", "f")
    return op.common_rows(d, ["key", "origin", "lead"], "method", "f", 3).groupBy("key", "method").agg(F.count(F.lit(1)).alias("n"))


@query("x9_row_policy_score", """with d as (select l_linestatus as k, l_discount * 9 as p, l_tax * 10 as c, l_quantity > 25 as y, l_shipdate as day from lineitem), s as (select k, count(*) filter (p >= c and y) as tp, count(*) filter (p >= c and not y) as fp, count(*) filter (not p >= c and y) as fn, count(distinct day) as days, count(distinct case when y then day end) as event_days from d group by 1)
select *, round(tp / (tp + fn), 6) as recall, round(tp / (tp + fp), 6) as precision, round(fp / days, 6) as false_per_day from s""")
def row_policy_score(t):
    d = t.lineitem.select(F.col("l_linestatus").alias("k"), (F.col("l_discount") * 9).alias("p"), (F.col("l_tax") * 10).alias("c"), (F.col("l_quantity") > 25).alias("y"), F.col("l_shipdate").alias("day"))
    return rounded(op.policy_score(d, ["k"], "p", "c", F.col("y"), "day"), ["recall", "precision", "false_per_day"])


@query("x10_method_gates", """with s as (select l_suppkey, avg(abs(l_quantity - 25)) as mae, avg((l_discount < 0.08)::int) as cov, count(distinct l_shipdate) as days from lineitem group by 1)
select l_suppkey, array_to_string(list_filter([case when mae > 12.5 then 'point error not improved' end, case when abs(cov - 0.8) > 0.05 then 'coverage outside convention' end, case when days < 300 then 'too few days' end], lambda x: x is not null), '; ') as reasons,
  (mae <= 12.5 and abs(cov - 0.8) <= 0.05 and days >= 300)::int as passed from s""")
def method_gates(t):
    s = t.lineitem.groupBy("l_suppkey").agg(F.avg(F.abs(F.col("l_quantity") - 25)).alias("mae"), F.avg((F.col("l_discount") < 0.08).cast("int")).alias("cov"), F.countDistinct("l_shipdate").alias("days"))
    return op.gates(s, {"point error not improved": F.col("mae") > 12.5, "coverage outside convention": F.abs(F.col("cov") - 0.8) > 0.05, "too few days": F.col("days") < 300}).select("l_suppkey", "reasons", "passed")


@query("x11_equal_origin_pick", """with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) - 1 as i, count(*) over (partition by l_orderkey) as n from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey from r where i = (l_orderkey * 7 + 741) % n""")
def equal_origin_pick(t):
    return op.one_lead_per_origin(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"], F.col("l_orderkey") * 7, ["l_linenumber", "l_partkey", "l_suppkey"], 741)


@query("x12_version_exposure", """with e as (select date_trunc('month', l_shipdate) as m, arg_max(l_partkey, (l_discount, l_partkey)) as upper, arg_max(l_partkey, (l_tax, l_partkey)) as lower from lineitem group by 1)
select side, version, count(*) as intervals from (select unnest(['upper', 'lower']) as side, unnest([upper, lower]) as version from e) group by 1, 2""")
def version_exposure(t):
    e = t.lineitem.groupBy(cal.month_start(F.col("l_shipdate")).alias("m")).agg(F.max_by("l_partkey", F.struct("l_discount", "l_partkey")).alias("upper"), F.max_by("l_partkey", F.struct("l_tax", "l_partkey")).alias("lower"))
    return e.unpivot(["m"], ["upper", "lower"], "side", "version").groupBy("side", "version").agg(F.count(F.lit(1)).alias("intervals"))


@query("x13_equation_catalogue", """select l_partkey as eq, count(distinct l_linenumber) as versions, min(l_discount) as low, max(l_discount) as high, string_agg(distinct case when l_returnflag = 'R' then 's' || (l_suppkey % 20) || '*' else 's' || (l_suppkey % 20) end, '|' order by case when l_returnflag = 'R' then 's' || (l_suppkey % 20) || '*' else 's' || (l_suppkey % 20) end) as sets from lineitem group by 1""")
def equation_catalogue(t):
    s = F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string"), F.when(F.col("l_returnflag") == "R", "*").otherwise(""))
    return t.lineitem.groupBy(F.col("l_partkey").alias("eq")).agg(F.countDistinct("l_linenumber").alias("versions"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"), text.joined(F.collect_set(s)).alias("sets"))


@query("x14_dominant_terms", f"""with {con.UNITS}, ex as (select l_partkey as eq, l_returnflag as link, count(*) as exposure from lineitem group by 1, 2), te as (select * from (select *, row_number() over (partition by link order by exposure desc, eq) as rn from ex) where rn <= 10),
d as (select link, te.eq, unit, abs(s) * exposure as score, row_number() over (partition by link, te.eq order by abs(s) * exposure desc, unit) as rk from te join sens on sens.eq = te.eq where s is not null) select link, eq, unit, round(score, 6) as score, rk as rank from d where rk <= 5""")
def dominant_terms(t):
    ex = t.lineitem.groupBy(F.col("l_partkey").alias("eq"), F.col("l_returnflag").alias("link")).agg(F.count(F.lit(1)).alias("exposure"))
    te = rev.top_k(ex, ["link"], [F.desc("exposure"), F.col("eq")], 10)
    d = te.join(con.sens(t).filter("sensitivity is not null"), "eq").withColumn("score", F.abs("sensitivity") * F.col("exposure"))
    return rounded(rev.top_k(d, ["link", "eq"], [F.desc("score"), F.col("unit")], 5, rank="rank").select("link", "eq", "unit", "score", "rank"), ["score"])


@query("x15_fleet_context", """with m as (select unnest(generate_series(timestamp '1996-01-01', timestamp '2001-01-01', interval 1 month)) as time), st as (select l_suppkey as unit, l_shipdate as att, max(l_quantity - 5) as mw from lineitem group by 1, 2),
j as (select s_nationkey as grp, m.time, s_suppkey as unit from supplier, m), k as (select j.*, case when att >= j.time - interval 15 days then mw end as mw from j asof left join st on st.unit = j.unit and j.time >= st.att)
select grp, time, count(*) as units, count(mw) as known, case when count(*) = count(mw) then sum(mw) end as total, count(*) filter (mw > 0) as online from k group by 1, 2""")
def fleet_context(t):
    u = t.supplier.select(F.col("s_nationkey").alias("grp"), F.col("s_suppkey").alias("unit"))
    rows = u.select("grp").distinct().withColumn("time", F.explode(F.sequence(ts("1996-01-01"), ts("2001-01-01"), F.expr("interval 1 month"))))
    st = t.lineitem.groupBy(F.col("l_suppkey").alias("unit"), F.col("l_shipdate").alias("att")).agg((F.max("l_quantity") - 5).alias("mw"))
    return op.fleet_context(rows, u, st, "unit", "time", "att", "mw", ["grp"], "15 days", 24 * 365)


@query("x18_joint_configurations", f"""with {po.PANEL}, c as (select season, fams, count(*) as n from pn where contains(fams, '|') group by 1, 2), r as (select *, row_number() over (partition by season order by n desc, fams) as rank from c) select season, fams, n, rank from r where rank <= 3""")
def joint_configurations(t):
    return rg.joint_configurations(po.panel(t).filter("fams <> ''"), ["season"], "fams", 3)


@query("x19_canonical_episode_links", f"""with recursive {CHAIN}, walk as (select id, id as fin, nxt from link union all select walk.id, link.id, link.nxt from walk join link on walk.nxt = link.id), fi as (select id, fin from walk where nxt is null)
select fi.id, fin as canonical_id, string_agg(distinct 's' || (l_suppkey % 20), '|' order by 's' || (l_suppkey % 20)) as sets, count(distinct l_partkey) as assets from fi join lineitem on l_orderkey = fi.id group by 1, 2""")
def canonical_episode_links(t):
    fin = lk.final_of_chain(chain(t), "id", "nxt").select("id", F.col("final_id").alias("canonical_id"))
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(text.joined(F.collect_set(F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string")))).alias("sets"), F.countDistinct("l_partkey").alias("assets"))
    return fin.join(s, "id")


@query("x20_bias_correction", """with b as (select l_suppkey, avg(l_quantity - 25) filter (l_shipdate < '1999-01-01') as bias from lineitem group by 1) select l_suppkey, count(*) as n, round(avg(abs(l_quantity - 25)), 6) as raw, round(avg(abs(l_quantity - 25 - bias)), 6) as corrected from lineitem join b using (l_suppkey) where l_shipdate >= '1999-01-01' group by 1""")
def bias_correction(t):
    e, early = F.col("l_quantity") - 25, F.col("l_shipdate") < ts("1999-01-01")
    b = t.lineitem.groupBy("l_suppkey").agg(F.avg(F.when(early, e)).alias("bias"))
    return t.lineitem.filter(~early).join(b, "l_suppkey").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(e))).alias("raw"), r6(F.avg(F.abs(e - F.col("bias")))).alias("corrected"))


@query("x21_pooled_normalised_fit_input", """with s as (select l_suppkey, stddev_pop(l_extendedprice) as sd from lineitem where l_shipdate < '1999-01-01' group by 1) select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / sd, 6) as y from lineitem join s using (l_suppkey) where sd > 0""")
def pooled_fit_input(t):
    s = t.lineitem.filter(F.col("l_shipdate") < ts("1999-01-01")).groupBy("l_suppkey").agg(F.stddev_pop("l_extendedprice").alias("sd")).filter("sd > 0")
    return t.lineitem.join(s, "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.col("l_extendedprice") / F.col("sd")).alias("y"))


@query("x22_winsor_impute_scale", """with d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice as a, case when l_returnflag <> 'R' then l_quantity end as b from lineitem), q as (select quantile_cont(a, 0.05) as al, quantile_cont(a, 0.5) as am, quantile_cont(a, 0.95) as ah, quantile_cont(b, 0.05) as bl, quantile_cont(b, 0.5) as bm, quantile_cont(b, 0.95) as bh from d where l_shipdate < '1999-01-01')
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(coalesce(least(greatest(a, al), ah), am), 4) as a, round(coalesce(case when b is not null then least(greatest(b, bl), bh) end, bm), 4) as b, (a is null)::int as a_missing, (b is null)::int as b_missing from d, q""")
def winsor_impute(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("l_extendedprice").alias("a"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("b"))
    return rounded(ml.winsorised(d, d.filter(F.col("l_shipdate") < ts("1999-01-01")), ["a", "b"], 0.05, 0.95).drop("l_shipdate"), ["a", "b"], 4)


@query("x23_outage_state_interactions", f"""with {GRID} select key, time, round(n * v, 4) as count_flow, round(n * k, 4) as count_load, (setter is null)::int as unknown_source, case when setter is null then null else setter * 30 end as source_age from grid where v is not null""")
def outage_state_interactions(t):
    g = grid(t).filter("v is not null")
    return g.select("key", "time", r6(F.col("n") * F.col("v"), 4).alias("count_flow"), (F.col("n") * F.col("k")).cast("double").alias("count_load"), F.col("setter").isNull().cast("int").alias("unknown_source"), (F.col("setter") * 30).alias("source_age"))


@query("x24_support_flags", """select l_suppkey, l_returnflag, count(distinct l_shipdate) as days, count(*) as incidents, (count(distinct l_shipdate) < 150 or count(*) < 200)::int as limited from lineitem group by 1, 2""")
def support_flags(t):
    d = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.countDistinct("l_shipdate").alias("days"), F.count(F.lit(1)).alias("incidents"))
    return d.withColumn("limited", ((F.col("days") < 150) | (F.col("incidents") < 200)).cast("int"))


@query("x25_day_block_resample", f"""with {DAYS}, {draws(7, 20, 5)} select key, r as rep, count(*) as days, sum(n)::bigint as rows, round(sum(a), 2) as total from dr join dd using (key, idx) group by 1, 2""")
def day_block_resample(t):
    d = days(t)
    n = d.groupBy("key").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    return rs.block_draws(n, ["key"], "_n", 7, 20, 5).join(d, ["key", "idx"]).groupBy("key", "rep").agg(F.count(F.lit(1)).alias("days"), F.sum("n").alias("rows"), r6(F.sum("a"), 2).alias("total"))


@query("x26_episodes_touching", f"""with {SPELLS} select key, count(distinct spells.l_orderkey) as episodes from spells join orders on o_custkey = key and o_orderdate between s and e + interval 1 day group by 1""")
def episodes_touching(t):
    p = t.orders.select(F.col("o_custkey").alias("key"), "o_orderdate")
    s = spells(t).withColumn("until", F.col("e") + F.expr("interval 1 day"))
    return lk.points_in_intervals(p, s, ["key"], "o_orderdate", "s", "until", hours=24 * 30).groupBy("key").agg(F.countDistinct("l_orderkey").alias("episodes"))


@query("x27_event_curve_summary", f"""with {po.LAY}, a as (select o_custkey as link, o_orderdate as att, o_orderstatus as fam from orders), o as (select a.*, "offset", att + to_days("offset"::int) as time from a, (select unnest(range(-3, 4)) as "offset")), d as (select fam, "offset", share from o join ly using (link, time)), u as (select * from d union all select 'pooled', "offset", share from d)
select fam, "offset", count(*) as n, round(quantile_cont(share, 0.25), 6) as p25, round(quantile_cont(share, 0.5), 6) as median, round(quantile_cont(share, 0.75), 6) as p75 from u group by 1, 2""")
def event_curve_summary(t):
    a = t.orders.select(F.col("o_custkey").alias("link"), F.col("o_orderdate").alias("att"), F.explode(F.array(F.col("o_orderstatus"), F.lit("pooled"))).alias("fam")).withColumn("offset", F.explode(F.sequence(F.lit(-3), F.lit(3))))
    d = a.withColumn("time", F.col("att") + F.make_dt_interval(days=F.col("offset"))).hint("merge").join(po.share_layer(t), ["link", "time"])   # sized without its offsets
    return rounded(ranks.quantiles(d, ["fam", "offset"], "share", {"p25": 0.25, "median": 0.5, "p75": 0.75}).withColumnRenamed("n_values", "n"), ["p25", "median", "p75"])


@query("x28_pressure_halfhour", """select event_type, time_bucket(interval '30 minutes', ts - interval 1 microsecond) + interval 30 minutes as time, round(sum(case when user_id % 4 > 0 then value end), 2) as pressure from events group by 1, 2""")
def pressure_halfhour(t):
    return t.events.groupBy("event_type", cal.interval_ceiling(F.col("ts")).alias("time")).agg(r6(F.sum(F.when(F.col("user_id") % 4 > 0, F.col("value"))), 2).alias("pressure"))


@query("x29_diurnal_effect_48", f"""with {po.MATCH}, l as (select un.*, pn.slot, unnest([pn.season::varchar, 'All']) as season from un join pn using (link, time)) select season, slot, count(*) as units_n, quantile_cont(treated, 0.5) as treated, quantile_cont(control, 0.5) as control, quantile_cont(effect, 0.5) as effect from l group by 1, 2""")
def diurnal_effect(t):
    u = po.units(t).join(po.panel(t).select("link", "time", "season", "slot"), ["link", "time"])
    u = cut(u.withColumn("season", F.explode(F.array(F.col("season").cast("string"), F.lit("All")))), "diurnal")
    by = ["season", "slot"]
    n = u.groupBy(*by).agg(F.count(F.lit(1)).alias("units_n"))
    return n.join(ranks.quantile_table(u, by, {c: {c: 0.5} for c in ("treated", "control", "effect")}), by)


@query("x30_any_binding_footprint", f"""with {po.MATCH}, ly as (select l_suppkey as link, l_shipdate as time, max(l_tax) > 0.05 as anyb from lineitem group by 1, 2), nc as (select f, link, time, count(*) as nc from pr group by 1, 2, 3), tr2 as (select f, avg(anyb::int) as tb, count(*) as u from nc join ly using (link, time) group by 1),
cb as (select pr.f, sum(anyb::int / nc) as c from pr join nc on nc.f = pr.f and nc.link = pr.link and nc.time = pr.time join ly on ly.link = pr.link and ly.time = control_time group by 1)
select f, u as n_units, round(tb, 6) as any_treated, round(c / u, 6) as any_control, case when f <= 3 then 'relevant' else 'spillover' end as relation from tr2 join cb using (f)""")
def any_binding_footprint(t):
    pr = po.pairs(t)
    b = t.lineitem.groupBy(F.col("l_suppkey").alias("link"), F.col("l_shipdate").alias("time")).agg((F.max("l_tax") > 0.05).cast("double").alias("s")).withColumn("eq", F.lit(1))
    d = ou.family_shares(pr, b, ["f", "link", "time"], ["f"], "link", "time", "eq", "s", 1)
    n = pr.select("f", "link", "time").distinct().groupBy("f").agg(F.count(F.lit(1)).alias("n_units"))
    return d.join(n, "f").select("f", "n_units", r6("treated_share").alias("any_treated"), r6("control_share").alias("any_control"), F.when(F.col("f") <= 3, "relevant").otherwise("spillover").alias("relation"))


@query("x31_lead_count_gate", f"""with {po.FAM}, rc as (select l_suppkey as family, count(*)::double as n from lineitem where exists (select 1 from fs where family = l_suppkey and l_shipdate between s and e) group by 1), sd as (select l_suppkey as family, count(*) filter (l_linenumber <= 7)::double as n from lineitem group by 1)
select case when rc.n is null then 'right only' when sd.n is null then 'left only' when rc.n = sd.n then 'equal' else 'different' end as status, count(*) as cells from rc full join sd using (family) group by 1""")
def lead_count_gate(t):
    leads = t.lineitem.select(F.col("l_suppkey").alias("family"), F.col("l_shipdate").alias("time"), "l_orderkey", "l_linenumber", "l_partkey")
    again = lk.covered(leads, po.family_spells(t), ["family"], "time", "s", "e", gap="0 seconds", name="on", hours=24 * 365).filter("on = 1").groupBy("family").agg(F.count(F.lit(1)).cast("double").alias("n"))
    stored = t.lineitem.groupBy(F.col("l_suppkey").alias("family")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return lk.reconcile(again, stored, ["family"], ["n"], 0.0).groupBy("status").agg(F.count(F.lit(1)).alias("cells"))


@query("x32_regime_breakdown", f"""with {po.PANEL}, l as (select link, fams, v, unnest(['season', 'daytype', 'slot']) as dim, unnest([season::varchar, daytype::varchar, slot::varchar]) as level from pn) select dim, level, count(*) as n, round(avg((fams <> '')::int), 6) as own_share, round(avg(v), 6) as mean_v from l group by 1, 2""")
def regime_breakdown(t):
    p = po.panel(t).select("link", "fams", "v", *[F.col(c).cast("string").alias(c) for c in ("season", "daytype", "slot")])
    return p.unpivot(["link", "fams", "v"], ["season", "daytype", "slot"], "dim", "level").groupBy("dim", "level").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("fams") != "").cast("int"))).alias("own_share"), r6(F.avg("v")).alias("mean_v"))


@query("x33_equation_scope", """with l as (select l_partkey as eq, string_agg(distinct l_returnflag, '|' order by l_returnflag) as links from lineitem where l_discount > 0.08 group by 1) select p_partkey as eq, coalesce(links, '') as links, (links is null)::int as gen_only, (p_partkey not in (select l_partkey from lineitem))::int as undefined from part left join l on eq = p_partkey""")
def equation_scope(t):
    l = t.lineitem.filter("l_discount > 0.08").groupBy(F.col("l_partkey").alias("eq")).agg(text.joined(F.collect_set("l_returnflag")).alias("links"))  # noqa: E741
    seen = t.lineitem.select(F.col("l_partkey").alias("eq")).distinct().withColumn("seen", F.lit(1))
    return t.part.select(F.col("p_partkey").alias("eq")).join(l, "eq", "left").join(seen, "eq", "left").select(
        "eq", F.coalesce("links", F.lit("")).alias("links"), F.col("links").isNull().cast("int").alias("gen_only"), F.col("seen").isNull().cast("int").alias("undefined"))


@query("x33_backfill_months", """select distinct l_partkey as eq, unnest(generate_series(date_trunc('month', l_shipdate), date_trunc('month', l_shipdate + to_days(l_quantity::int)), interval 1 month)) as month from lineitem where l_partkey not in (select l_partkey from lineitem where l_discount > 0.08)""")
def backfill_months(t):
    known = t.lineitem.filter("l_discount > 0.08").select("l_partkey").distinct()
    end = F.col("l_shipdate") + F.make_dt_interval(days=F.col("l_quantity").cast("int"))
    d = t.lineitem.select("l_partkey", "l_shipdate", "l_quantity").join(known, "l_partkey", "left_anti")
    return d.select(F.col("l_partkey").alias("eq"), F.explode(F.sequence(cal.month_start(F.col("l_shipdate")), cal.month_start(end), F.expr("interval 1 month"))).alias("month")).distinct()


@query("x34_modal_attribute", """with c as (select l_partkey as eq, l_suppkey % 9 as kind, count(*) as n from lineitem group by 1, 2) select eq, kind, n from (select *, row_number() over (partition by eq order by n desc, kind) as rn from c) where rn = 1""")
def modal_attribute(t):
    return op.modal(t.lineitem.select(F.col("l_partkey").alias("eq"), (F.col("l_suppkey") % 9).alias("kind")), ["eq"], "kind")


@query("x35_pair_effects", f"""with {po.MATCH}, w as (select f, season, daytype, count(*) as n from tr group by 1, 2, 3) select f, season, daytype, round(n / sum(n) over (partition by f), 6) as weight, (select count(*) from un where un.f = w.f) as pairs from w""")
def pair_effects(t):
    u = po.units(t).groupBy("f").agg(F.count(F.lit(1)).alias("pairs"))
    c = po.treated_rows(t).groupBy("f", "season", "daytype").agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy("f").agg(F.sum("n").alias("_t"))
    return c.join(tot, "f").join(u, "f", "left").select("f", "season", "daytype", r6(F.col("n") / F.col("_t")).alias("weight"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


@query("x36_embargo_confirmation", f"""with {po.PANEL}, t1 as (select * from tt where time <= timestamp '1999-01-01' - interval 21 days), {po.matched_sql('tt', 'a')}, {po.matched_sql('t1', 'b')}
select a.f, quantile_cont(a.effect, 0.5) as full_effect, (select quantile_cont(effect, 0.5) from unb where unb.f = a.f) as embargoed, (select count(*) from unb where unb.f = a.f) as n_embargoed from una a group by 1""")
def embargo_confirmation(t):
    a = po.units(t)
    b = a.filter(F.col("time") <= ts("1999-01-01") - F.expr("interval 21 days"))   # a unit is matched by itself, so early units keep their controls
    x = ranks.quantiles(a, ["f"], "effect", {"full_effect": 0.5}).drop("n_values")
    y = ranks.quantiles(b, ["f"], "effect", {"embargoed": 0.5}).withColumnRenamed("n_values", "n_embargoed")
    return x.join(y, "f", "left").withColumn("n_embargoed", F.coalesce("n_embargoed", F.lit(0)))


@query("x37_seasonal_anchor_frame", f"""with {FC} select oo.key, origin, lead, an.v as anchor, coalesce(d.v, an.v) as daily, coalesce(w.v, an.v) as weekly from oo left join grid an on an.key = oo.key and an.time = origin - interval 1 hour
  left join grid d on d.key = oo.key and d.time = oo.time - to_hours((ceil((lead + 1) / 24) * 24)::int) left join grid w on w.key = oo.key and w.time = oo.time - to_hours((ceil((lead + 1) / 168) * 168)::int)""")
def seasonal_anchor_frame(t):
    g = published_grid(t)
    last = g.groupBy("key").agg(F.max("time").alias("last"))
    rows = fo.origin_lead_grid(g.select("key", F.col("time").alias("origin")).join(last, "key"), "origin", [1, 3, 6, 24, 48, 170], "1 hour", F.col("last")).drop("last")
    return op.anchor_frame(rows, g, ["key"], "v", "1 hour", {"daily": 24, "weekly": 168}).select("key", "origin", "lead", "anchor", "daily", "weekly")


@query("x38_harmonic_count", f"""with {GRID}, p as (select hour(time) as slot, avg(v) as c from grid where v is not null group by 1), m as (select slot, c - (select avg(c) from p) as c from p), e as (select h, sum(c * cos(2 * pi() * h * slot / 24)) ^ 2 + sum(c * sin(2 * pi() * h * slot / 24)) ^ 2 as e from m, range(1, 12) t(h) group by 1),
s as (select h, sum(e) over (order by h) as cum, sum(e) over () as tot from e) select greatest(least(coalesce(min(h) filter (cum >= 0.95 * tot), 2), 11), 2)::int as harmonics from s""")
def harmonic_count(t):
    p = grid(t).filter("v is not null").groupBy(F.hour("time").alias("slot")).agg(F.avg("v").alias("c"))     # 24 rows
    mean = p.agg(F.avg("c").alias("_m"))
    e = op.harmonic_energy(p.join(F.broadcast(mean)).withColumn("c", F.col("c") - F.col("_m")), "slot", "c", 24)
    return op.harmonics_needed(e, 0.95, 2, 11)


@query("x39_literal_horizon_score", f"""with {FC}, w as (select distinct key, unnest([24, 48, 96]) as lead from fb), s as (select key, lead, count(*) as n, avg(abs(persistence - actual)) as mae from fb where actual is not null and persistence is not null group by 1, 2)
select w.key, w.lead, coalesce(n, 0) as n, round(mae, 6) as mae, case when n is null then 'unsupported' else 'scored' end as status from w left join s on s.key = w.key and s.lead = w.lead""")
def literal_horizon_score(t):
    b = blended(t)
    want = b.select("key").distinct().withColumn("lead", F.explode(F.array(F.lit(24), F.lit(48), F.lit(96))))
    s = fo.point_metrics(b, ["key", "lead"], "actual", "persistence", tails=False).select("key", "lead", "n", "mae")
    return want.join(s, ["key", "lead"], "left").select("key", "lead", F.coalesce("n", F.lit(0)).alias("n"), r6("mae").alias("mae"), F.when(F.col("n").isNull(), "unsupported").otherwise("scored").alias("status"))


@query("x40_band_weighted_selection", f"""with {FC}, l as (select key, band, unnest(['persistence', 'seasonal']) as method, abs(unnest([persistence, seasonal]) - actual) as e from fb where actual is not null), b as (select key, method, 0.7 * avg(e) filter (band = 'short') + 0.3 * avg(e) filter (band = 'day') as score from l group by 1, 2)
select key, arg_min(method, (round(score, 9), method)) as method, round(min(score), 6) as score from b where score is not null group by 1""")
def band_weighted_selection(t):
    m = ["persistence", "seasonal"]
    l = blended(t).filter("actual is not null").select("key", "band", "actual", *m).unpivot(["key", "band", "actual"], m, "method", "f").withColumn("e", F.abs(F.col("f") - F.col("actual")))  # noqa: E741
    b = l.groupBy("key", "method").agg((F.avg(F.when(F.col("band") == "short", F.col("e"))) * 0.7 + F.avg(F.when(F.col("band") == "day", F.col("e"))) * 0.3).alias("score")).filter("score is not null")
    return b.groupBy("key").agg(F.min_by("method", F.struct(F.round("score", 9), F.col("method"))).alias("method"), r6(F.min("score")).alias("score"))


@query("x41_article_event_statistics", f"""with {GRID}, a as (select event_id, event_type as key, ts - interval 3 hours as s, ts + interval 3 hours as e, user_id % 4 as want from events where value > 55)
select event_id, count(v) as n, round(avg(v), 6) as mean, max(v) as peak, max((setter = want)::int) as named_active from a join grid on grid.key = a.key and time between s and e group by 1""")
def article_event_statistics(t):
    h = F.expr("interval 3 hours")
    a = t.events.filter("value > 55").select("event_id", F.col("event_type").alias("key"), (F.col("ts") - h).alias("s"), (F.col("ts") + h).alias("e"), (F.col("user_id") % 4).alias("want"))
    d = lk.points_in_intervals(grid(t).select("key", "time", "v", "setter"), a, ["key"], "time", "s", "e", hours=6)
    return d.groupBy("event_id").agg(F.count("v").alias("n"), r6(F.avg("v")).alias("mean"), F.max("v").alias("peak"), F.max((F.col("setter") == F.col("want")).cast("int")).alias("named_active"))


@query("x42_largest_regime_delta", """with d as (select l_returnflag as key, floor(month(l_shipdate) % 12 / 3)::int as season, case when l_discount <= 0.02 then 'low' when l_discount >= 0.08 then 'high' end as regime, l_extendedprice as x from lineitem),
p as (select key, season, avg(x) filter (regime = 'low') as low, avg(x) filter (regime = 'high') as high from d group by 1, 2), r as (select *, high - low as delta, row_number() over (partition by key order by round(abs(high - low), 9) desc, season) as rn from p where low is not null and high is not null) select key, season, round(low, 6) as low, round(high, 6) as high, round(delta, 6) as delta from r where rn = 1""")
def largest_regime_delta(t):
    x = F.col("l_discount")
    d = t.lineitem.select(F.col("l_returnflag").alias("key"), cal.season(F.col("l_shipdate")).alias("season"), F.when(x <= 0.02, "low").when(x >= 0.08, "high").alias("regime"), "l_extendedprice")
    m = d.filter("regime is not null").groupBy("key", "season", "regime").agg(F.avg("l_extendedprice").alias("x"))
    return rounded(op.largest_delta(m, ["key"], "season", "regime", "x"), ["low", "high", "delta"])


@query("x43_recorded_forecast_score", """with a as (select o_custkey as key, o_orderdate as delivery, arg_max(o_totalprice / 10000, (o_orderkey)) as actual from orders group by 1, 2) select l_returnflag, count(*) as recorded, count(actual) as scored, round(avg(abs(l_quantity - actual)), 6) as mae from lineitem left join a on key = l_suppkey and delivery = l_shipdate group by 1""")
def recorded_forecast_score(t):
    a = t.orders.groupBy(F.col("o_custkey").alias("l_suppkey"), F.col("o_orderdate").alias("l_shipdate")).agg(F.max_by(F.col("o_totalprice") / 10000, "o_orderkey").alias("actual"))
    d = t.lineitem.join(a, ["l_suppkey", "l_shipdate"], "left")
    return d.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("recorded"), F.count("actual").alias("scored"), r6(F.avg(F.abs(F.col("l_quantity") - F.col("actual")))).alias("mae"))


@query("x44_build_regression", """select l_suppkey, round(sum(l_quantity), 6) as q, round(sum(l_discount), 6) as d, 'equal' as status from lineitem group by 1""")
def build_regression(t):
    """Rebuild a table, read a stored copy back and count cells that agree."""
    from ..session import shared_folder
    from ..sources.files import write_csv
    build = t.lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("d"))
    path = shared_folder(t.spark, "stored")
    write_csv(build, path, 9)
    stored = t.spark.read.option("header", "true").schema("l_suppkey long, q double, d double").csv(path)
    r = lk.reconcile(build, stored, ["l_suppkey"], ["q", "d"], 1e-8)
    return r.select("l_suppkey", r6(F.col("b_q")).alias("q"), r6(F.col("b_d")).alias("d"), "status")


@query("x45_row_conditions", f"""with {GRID} select key, time, coalesce(setter::varchar, 'any') as state, (setter is not null)::int as exact_sets, unnest(['full', 'no_network', 'no_weather']) as method, unnest([k, k, null]) as q_k, unnest([coalesce(setter::varchar, 'any'), 'any', coalesce(setter::varchar, 'any')]) as q_state from grid""")
def row_conditions(t):
    state = F.coalesce(F.col("setter").cast("string"), F.lit("any"))
    none = F.lit(None).cast("long")
    kinds = F.array(F.struct(F.lit("full").alias("method"), F.col("k").alias("q_k"), state.alias("q_state")), F.struct(F.lit("no_network").alias("method"), F.col("k").alias("q_k"), F.lit("any").alias("q_state")),
                    F.struct(F.lit("no_weather").alias("method"), none.alias("q_k"), state.alias("q_state")))
    return grid(t).select("key", "time", state.alias("state"), F.col("setter").isNotNull().cast("int").alias("exact_sets"), F.explode(kinds).alias("_m")).select("key", "time", "state", "exact_sets", "_m.*")


@query("x46_pilot_lagged_forecast", f"""with {GRID}, l as (select key, time, v, lag(v) over w as p, lag(k) over w as pk from grid window w as (partition by key order by time)), d as (select * from l where v is not null and p is not null and pk is not null), tr as (select * from d where time < '2024-01-19'),
f as (select key, covar_pop(pk, v) * count(*) / (var_pop(pk) * count(*) + 1) as b, avg(pk) as mx, avg(v) as my from tr group by 1) select d.key, count(*) as n, round(avg(abs(v - p)), 6) as naive_mae, round(avg(abs(v - (my + b * (pk - mx)))), 6) as model_mae from d join f using (key) where time >= '2024-01-19' group by 1""")
def pilot_lagged_forecast(t):
    d = seq.windowed(grid(t), ["key"], "time", lambda w: {"p": F.lag("v").over(w), "pk": F.lag("k").over(w).cast("double")}, before="1 hour").filter("v is not null and p is not null and pk is not null")
    fit = ml.group_line(d.filter(F.col("time") < ts("2024-01-19")), ["key"], "pk", "v", 1.0)
    e = d.filter(F.col("time") >= ts("2024-01-19")).join(fit.drop("n"), "key")
    return e.groupBy("key").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(F.col("v") - F.col("p")))).alias("naive_mae"), r6(F.avg(F.abs(F.col("v") - (F.col("intercept") + F.col("slope") * F.col("pk"))))).alias("model_mae"))


@query("x47_outages_asof", f"""with b as (select equipment as outage_id, issue, start, "end", status, outage_id as rev from {BOOK}) select outage_id, issue, start, "end", status, rev from (select *, row_number() over (partition by outage_id order by issue desc, rev desc) as rn from b where issue <= '1999-06-30') where rn = 1""")
def outages_asof(t):
    b = bookings(t).select(F.col("equipment").alias("outage_id"), "issue", "received", "start", "end", "status", F.col("outage_id").alias("rev"))
    return lk.asof_revision(b, ["outage_id"], ts("1999-06-30"), ["issue", "received"], ["issue", "rev"]).drop("received")


@query("x51_joined_state_view", f"""with {GRID}, u as (select event_type as key, time_bucket(interval '1 hour', ts - interval 1 microsecond) + interval 1 hour as time, count(distinct user_id) as users from events group by 1, 2) select grid.key, grid.time, v, setter, users, hour(grid.time) as slot from grid left join u on u.key = grid.key and u.time = grid.time""")
def joined_state_view(t):
    u = t.events.groupBy(F.col("event_type").alias("key"), cal.interval_ceiling(F.col("ts"), 3600).alias("time")).agg(F.countDistinct("user_id").alias("users"))
    return grid(t).select("key", "time", "v", "setter").join(u, ["key", "time"], "left").withColumn("slot", F.hour("time"))


@query("x52_paired_sensitivity", f"select 7 as block, * from ({boot_sql(7, 100, 741)}) union all select 14 as block, * from ({boot_sql(14, 100, 741)})")
def paired_sensitivity(t):
    d = cut(days(t), "days")
    out = [rounded(rs.block_bootstrap(d, ["key"], ["a", "b", "n"], effect(), b, 100, 741), ["estimate", "ci_low", "ci_high"]).withColumn("block", F.lit(b)) for b in (7, 14)]
    return out[0].unionByName(out[1])


