"""Forecast tables, scoring and alerts on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import forecast as op
from ..operators import lookups as lk
from ..operators import ranks
from .aggregates import rounded
from .cleaning import BOOK, FORECAST, bookings, forecast_rows
from .joins import ORIGINS, VINTAGE, origins, vintage
from .registry import query
from .standins import FC, GRID, OFF, blended, forecast_rows_grid, grid, published_grid, r6, steady, ts


@query("f1_origin_lead_grid", f"with {FC} select key, origin, lead, time from oo")
def origin_lead_grid(t):
    return forecast_rows_grid(t).select("key", "origin", "lead", "time")


@query("f1_training_leads", """
select o_orderkey, b as band, (floor(('0x' || left(md5(concat_ws('|', o_orderkey, b, 741)), 8))::bigint / 4294967296 * (hi - lo + 1)) + lo)::int as lead
from orders, (values (0, 1, 12), (1, 13, 48), (2, 49, 144), (3, 145, 336)) x(b, lo, hi)""")
def training_leads(t):
    return op.training_leads(t.orders.select("o_orderkey"), "o_orderkey", [(1, 12), (13, 48), (49, 144), (145, 336)], 741)


@query("f2_censored_lags", f"""with {FC} select oo.key, origin, lead, case when a.published <= origin then a.v end as lag_1, case when b.published <= origin then b.v end as lag_24 from oo
left join pub a on a.key = oo.key and a.time = origin - interval 1 hour left join pub b on b.key = oo.key and b.time = origin - interval 24 hours""")
def censored_lags(t):
    g = published_grid(t)
    d = forecast_rows_grid(t).select("key", "origin", "lead")
    for n, h in (("1", 1), ("24", 24)):
        d = op.at_offset(d, g, ["key"], F.col("origin") - F.expr(f"interval {h} hours"), {f"_v{n}": "v", f"_p{n}": "published"})
        d = d.withColumn(f"lag_{n}", op.censored(F.col(f"_v{n}"), F.col(f"_p{n}"), F.col("origin"))).drop(f"_v{n}", f"_p{n}")
    return d


@query("f3_naive_forecasts", f"with {FC} select key, origin, lead, actual, persistence, seasonal from fc")
def naive_forecasts(t):
    return forecast_rows_grid(t).drop("time")


@query("f4_feature_asof", f"""
with f as (select * from {FORECAST}), runs as (select region, issue, max(received) as completed from f group by 1, 2),
best as (select origin, region, max(issue) as issue from {ORIGINS} join runs on completed <= origin group by 1, 2),
a as (select origin, region, issue, avg(value) as mean, stddev_pop(value) as spread, count(*) as members from best join f using (region, issue) where issue >= origin - interval 72 hours group by 1, 2, 3),
b as (select origin, count(*) as outages from {ORIGINS} join {BOOK} bk on bk.issue <= origin and status <> 'cancelled' and start <= origin + interval 12 hours and "end" > origin + interval 12 hours group by 1)
select a.origin, region, round(mean, 6) as mean, round(spread, 6) as spread, members, date_diff('hour', issue, a.origin) as age_hours, isodow(a.origin + interval 12 hours) - 1 as weekday, coalesce(outages, 0) as outages
from a left join b using (origin)""")
def feature_asof(t):
    f = forecast_rows(t)
    o = origins(t)
    req = o.withColumn("region", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))))
    best = lk.coherent_run_asof(req, lk.run_index(f, ["region"], [], "issue", "received"), ["region"], "origin", "issue", [], "72 hours", hours=24 * 90)
    a = best.join(f.select("region", "issue", "value"), ["region", "issue"]).groupBy("origin", "region", "issue").agg(
        r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("spread"), F.count(F.lit(1)).alias("members"))
    half = F.expr("interval 12 hours")
    live = bookings(t).filter("status <> 'cancelled'").select(F.col("issue").alias("known"), "start", F.col("end").alias("finish"))
    hit = lk.points_in_intervals(o.withColumn("delivery", F.col("origin") + half), live, [], "delivery", "start", "finish", hours=24 * 15, right_open=True)
    n = hit.filter(F.col("known") <= F.col("origin")).groupBy("origin").agg(F.count(F.lit(1)).alias("outages"))
    age = ((cal.micros(F.col("origin")) - cal.micros(F.col("issue"))) / 3_600_000_000).cast("long")
    return a.join(n, "origin", "left").select("origin", "region", "mean", "spread", "members", age.alias("age_hours"), F.weekday(F.col("origin") + half).alias("weekday"),
                                              F.coalesce("outages", F.lit(0)).alias("outages"))


@query("f5_long_horizon_table", f"""
with av as (select l_suppkey as unit, l_shipdate as known, max_by(l_quantity, (l_orderkey, l_linenumber, l_quantity)) as mw from lineitem group by 1, 2),
q as (select s_suppkey as unit, origin, lead from supplier, (select unnest(generate_series(timestamp '1996-01-01', timestamp '2001-01-01', interval 30 days)) as origin), (select unnest([7, 30, 90]) as lead))
select q.unit, origin, lead, origin + to_days(lead::int) as delivery, mw, date_diff('day', known, origin) as age_days from q asof left join av on av.unit = q.unit and q.origin >= av.known""")
def long_horizon_table(t):
    from ..operators import revisions as rev
    av = rev.latest(t.lineitem.select(F.col("l_suppkey").alias("unit"), F.col("l_shipdate").alias("known"), F.col("l_quantity").alias("mw"), "l_orderkey", "l_linenumber"),
                    ["unit", "known"], ["l_orderkey", "l_linenumber", "mw"])
    o = t.supplier.select(F.col("s_suppkey").alias("unit"), F.explode(F.sequence(ts("1996-01-01"), ts("2001-01-01"), F.expr("interval 30 days"))).alias("origin"))
    hit = lk.asof_backward(o, av, ["unit"], "origin", "known", ["mw"], hours=24 * 365)
    d = hit.withColumn("lead", F.explode(F.array(F.lit(7), F.lit(30), F.lit(90))))
    return d.select("unit", "origin", "lead", (F.col("origin") + F.make_dt_interval(days=F.col("lead"))).alias("delivery"), "mw",
                    F.datediff(F.col("origin").cast("date"), F.col("known").cast("date")).alias("age_days"))


@query("f6_pair_features", f"""with {GRID}, l as (select time, key, 'v' as variable, v as x from grid union all select time, key, 'k', k from grid)
select a.time, a.variable, a.key as a, b.key as b, round(a.x + b.x, 4) as sum, round(a.x - b.x, 4) as difference, round(abs(a.x - b.x), 4) as abs_difference, round((a.x - b.x) / greatest(abs(a.x) + abs(b.x), 25), 6) as normalized
from l a join l b on a.time = b.time and a.variable = b.variable and a.key < b.key""")
def pair_features(t):
    g = grid(t).select("time", "key", "v", F.col("k").cast("double").alias("k"))
    d = op.pair_features(g, ["time"], "key", ["v", "k"], 25)
    return rounded(rounded(d, ["sum", "difference", "abs_difference"], 4), ["normalized"])


@query("f7_run_ramps", f"""with {GRID}, r as (select *, date_trunc('day', time) as run from grid where v is not null)
select a.key, a.run, a.time, a.v, round(a.v - b.v, 4) as ramp_0, round(a.v - c.v, 4) as ramp_1 from r a left join r b on b.key = a.key and b.run = a.run and b.time = a.time - interval 1 hour
  left join r c on c.key = a.key and c.run = a.run and c.time = a.time - interval 3 hours""")
def run_ramps(t):
    r = grid(t).filter("v is not null").select("key", cal.floor_time(F.col("time"), 86400).alias("run"), "time", "v")
    return rounded(op.run_ramps(r, ["run"], ["key"], "time", "v", ["1 hour", "3 hours"]), ["ramp_0", "ramp_1"], 4)


@query("f8_feature_screen", """
select * from (values ('qty', 0.0::double, 1, 'kept'), ('price', 0.0, 1, 'kept'), ('twin', 0.0, 0, 'same as price'), ('fixed', 0.0, 0, 'constant'), ('disc', 0.0, 1, 'kept'), ('rare', null, 1, 'restored parent')) x(feature, s, kept, reason)
""".replace("select * from", "select feature, round(coalesce(s, (select avg((l_quantity <> 50)::int) from lineitem)), 6) as null_share, kept, reason from"))
def feature_screen(t):
    d = t.lineitem.select(F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * 2 + 1).alias("twin"),
                          F.lit(1.0).alias("fixed"), F.col("l_discount").alias("disc"), F.when(F.col("l_quantity") == 50, F.col("l_tax")).alias("rare"))
    return rounded(op.feature_screen(d, ["qty", "price", "twin", "fixed", "disc", "rare"], {"disc": ["rare"]}), ["null_share"])


@query("f9_chrono_partitions", """
with d as (select o_orderkey, o_orderdate as origin, o_orderdate + to_days((o_orderkey % 30)::int) as delivery from orders),
f as (select i as fold, timestamp '1995-01-01' as s, timestamp '1995-01-01' + to_days((730 + 365 * i)::int) as e from range(0, 4) t(i)),
w as (select fold, 'train' as partition, s as a, e as b from f union all select fold, 'select', e, e + interval 60 days from f union all select fold, 'calibrate', e + interval 60 days, e + interval 120 days from f
  union all select fold, 'evaluate', e + interval 120 days, e + interval 300 days from f)
select fold::int as fold, partition, count(*) as n, min(o_orderkey) as first, max(o_orderkey) as last from d join w on origin >= a and delivery + interval 30 minutes < b where fold in (select fold from f where e + interval 300 days <= timestamp '2001-08-01') group by 1, 2""")
def chrono_partitions(t):
    folds = op.expanding_folds("1995-01-01", "2001-08-01", 730, [("select", 60), ("calibrate", 60), ("evaluate", 180)], 365)
    d = t.orders.select("o_orderkey", F.col("o_orderdate").alias("origin"), (F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 30).cast("int"))).alias("delivery"))
    return op.assign_partitions(d, folds, "origin", "delivery", "30 minutes").groupBy("fold", "partition").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("f10_incident_purge", """
with d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, ['o' || l_orderkey, 's' || l_suppkey || '-' || year(l_shipdate)] as ids from lineitem),
e as (select *, unnest(ids) as e from d), c as (select e from e group by 1 having min(l_shipdate) < '1998-06-01' and max(l_shipdate) >= '1998-06-01')
select l_orderkey, l_linenumber, l_partkey, l_suppkey from d where (l_orderkey, l_linenumber, l_partkey, l_suppkey) not in (select (l_orderkey, l_linenumber, l_partkey, l_suppkey) from e where e in (select e from c))""")
def incident_purge(t):
    rid = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    ids = F.array(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit("-"), F.year("l_shipdate").cast("string")))
    d = t.lineitem.select(*rid, "l_shipdate", ids.alias("ids"))
    return op.purge_incidents(d, rid, "l_shipdate", "ids", ts("1998-06-01")).select(*rid)


@query("f11_origin_weights", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1.0::double / count(*) over (partition by l_orderkey), 9) as weight from lineitem")
def origin_weights(t):
    return rounded(op.origin_weights(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey"]), ["weight"], 9)


@query("f12_point_metrics", f"""with {FC}, s as (select *, unnest(['all', band, 'p' || (hour(time) // 6)]) as slice from fb where actual is not null and persistence is not null), e as (select *, persistence - actual as e from s)
select key, slice, count(*) as n, round(avg(abs(e)) + {OFF}, 6) as mae, round(sqrt(avg(e * e)) + {OFF}, 6) as rmse, round(avg(e) + {OFF}, 6) as bias, round(avg(greatest(e, 0)) + {OFF}, 6) as overstatement, round(avg(abs(e) / greatest(abs(actual), 50)) + {OFF}, 6) as mape,
  round(quantile_cont(abs(e), 0.95) + {OFF}, 6) as p95, round(quantile_cont(abs(e), 0.99) + {OFF}, 6) as p99 from e group by 1, 2""")
def point_metrics(t):
    d = blended(t).withColumn("slice", F.explode(F.array(F.lit("all"), F.col("band"), F.concat(F.lit("p"), F.floor(F.hour("time") / 6).cast("string")))))
    return steady(op.point_metrics(d, ["key", "slice"], "actual", "persistence"), ["mae", "rmse", "bias", "overstatement", "mape", "p95", "p99"])


@query("f13_interval_metrics", """
with d as (select l_returnflag, l_linestatus, l_quantity as y, 10 + l_discount * 300 as m, 2 + l_discount * 200 as a, 20 + l_discount * 320 as b, l_tax * 100 as c, 30 + l_discount * 330 as d from lineitem),
s as (select *, b - a + 10 * greatest(a - y, 0) + 10 * greatest(y - b, 0) as s80, d - c + 40 * greatest(c - y, 0) + 40 * greatest(y - d, 0) as s95 from d)
select l_returnflag, l_linestatus, count(*) as n, round(avg((y between a and b)::int), 6) as coverage_80, round(avg(b - a), 6) as width_80, round(avg(s80), 5) as score_80, round(avg((y between c and d)::int), 6) as coverage_95,
  round(avg(d - c), 6) as width_95, round(avg(s95), 5) as score_95, round(avg((c > a or a > m or m > b or b > d)::int), 6) as crossing_rate, round(avg((abs(y - m) * 0.5 + s80 * 0.1 + s95 * 0.025) / 2.5), 6) as wis,
  round(avg((greatest(0.1 * (y - a), -0.9 * (y - a)) + 0.5 * abs(y - m) + greatest(0.9 * (y - b), -0.1 * (y - b))) / 3), 6) as pinball from s group by 1, 2""")
def interval_metrics(t):
    x, z = F.col("l_discount"), F.col("l_tax")
    d = t.lineitem.select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("y"), (10 + x * 300).alias("m"), (2 + x * 200).alias("a"), (20 + x * 320).alias("b"),
                          (z * 100).alias("c"), (30 + x * 330).alias("d"))
    d = op.interval_metrics(d, ["l_returnflag", "l_linestatus"], "y", "m", "a", "b", "c", "d")
    return rounded(rounded(d, ["score_80", "score_95"], 5), ["coverage_80", "width_80", "coverage_95", "width_95", "crossing_rate", "wis", "pinball"])


@query("f14_residual_calibration", f"""with {FC}, tr as (select *, actual - persistence as r from fb where origin < '2024-01-18' and actual is not null and persistence is not null),
c as (select key, band, quantile_cont(r, 0.1) as a, quantile_cont(r, 0.5) as b, quantile_cont(r, 0.9) as c from tr group by 1, 2 having count(*) >= 60),
g as (select quantile_cont(r, 0.1) as a, quantile_cont(r, 0.5) as b, quantile_cont(r, 0.9) as c from tr)
select f.key, origin, lead, round(persistence + coalesce(c.a, g.a), 6) as p10, round(persistence + coalesce(c.b, g.b), 6) as p50, round(persistence + coalesce(c.c, g.c), 6) as p90
from fb f left join c on c.key = f.key and c.band = f.band, g where origin >= '2024-01-18' and persistence is not null""")
def residual_calibration(t):
    d = blended(t).filter("persistence is not null")
    own, pooled = op.residual_adjustments(d.filter(F.col("origin") < ts("2024-01-18")), ["key", "band"], "actual", "persistence", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, 60)
    out = op.calibrated(d.filter(F.col("origin") >= ts("2024-01-18")), own, pooled, ["key", "band"], "persistence", ["p10", "p50", "p90"])
    return rounded(out.select("key", "origin", "lead", "p10", "p50", "p90"), ["p10", "p50", "p90"])


@query("f15_exceed_probability", f"""with {FC}, k as (select key, quantile_cont(actual - persistence, list_transform(range(501), lambda i: i / 500)) as k from fb where origin < '2024-01-18' and actual is not null and persistence is not null group by 1),
x as (select fb.key, origin, lead, k, 30.0 - persistence as x, len(list_filter(k, lambda q: q <= 30.0 - persistence)) as i from fb left join k using (key) where persistence is not null and origin >= '2024-01-18')
select key, origin, lead, round(case when k is null then null when i = 0 then 0 when i > 500 then 1 else (i - 1 + (x - k[i]) / (k[i + 1] - k[i])) / 500 end, 6) as probability from x""")
def exceed_probability(t):
    """Interpolated residual CDF; the tests also compare it with numpy on a small fixture."""
    d = blended(t).filter("persistence is not null").withColumn("threshold", F.lit(30.0))
    return op.exceedance_probability(d.filter(F.col("origin") >= ts("2024-01-18")), d.filter((F.col("origin") < ts("2024-01-18")) & F.col("actual").isNotNull()), ["key"], "actual", "persistence",
                                     "threshold").select("key", "origin", "lead", r6("probability").alias("probability"))


@query("f15_quantile_grid", """
with q as (select l_returnflag, quantile_cont(l_extendedprice, [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1]) as qs from lineitem group by 1)
select l_returnflag, k as knot, round(qs[k + 1], 4) as price from q, range(0, 21) r(k)""")
def quantile_grid(t):
    d = ranks.quantile_grid(t.lineitem, ["l_returnflag"], "l_extendedprice", 20)
    return d.select("l_returnflag", "knot", r6("l_extendedprice", 4).alias("price"))


WARN = """wn as (select l_suppkey % 3 as cell, case when l_linestatus = 'O' then 'forward' else 'reverse' end as direction, round(l_discount * 8 + l_tax * 2, 4) as p, (l_returnflag = 'R' and l_quantity > 25)::int as y from lineitem),
cf as (select cell, direction, c as cutoff, count(*) filter (p >= c and y = 1) as tp, count(*) filter (p >= c and y = 0) as fp, count(*) filter (p < c and y = 1) as fn from wn, (select unnest([0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 2.0]::double[]) as c) group by 1, 2, 3)"""
CUTS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 2.0]


def confusion(t):
    d = t.lineitem.select((F.col("l_suppkey") % 3).alias("cell"), F.when(F.col("l_linestatus") == "O", "forward").otherwise("reverse").alias("direction"),
                          F.round(F.col("l_discount") * 8 + F.col("l_tax") * 2, 4).alias("p"), ((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25)).cast("int").alias("y"))
    return op.confusion_by_cutoff(d, ["cell", "direction"], "p", "y", CUTS)


@query("f16_threshold_tuning", f"""with {WARN}, f as (select *, 5 * tp / greatest(5 * tp + 4 * fn + fp, 1) as f2 from cf)
select cell, direction, round(max(f2), 6) as f2, arg_max(cutoff, (f2, cutoff)) as cutoff from f group by 1, 2""")
def threshold_tuning(t):
    return rounded(op.best_f2(confusion(t), ["cell", "direction"]), ["f2"])


@query("f16_joint_budget", f"""with {WARN}, d as (select a.cell, a.cutoff as forward, b.cutoff as reverse, a.tp + b.tp as tp, a.fp / 2500 + b.fp / 2500 as burden from cf a join cf b using (cell) where a.direction = 'forward' and b.direction = 'reverse'),
r as (select *, row_number() over (partition by cell order by tp desc, burden, forward + reverse desc, forward desc) as rn from d where burden <= 0.3)
select cell, forward, reverse, tp, round(burden, 6) as burden from r where rn = 1""")
def joint_budget(t):
    return rounded(op.joint_budget(confusion(t), ["cell"], "direction", 2500.0, 0.3), ["burden"])


@query("f17_model_choice", f"""with {FC}, l as (select key, band, unnest(['persistence', 'seasonal', 'blend']) as method, abs(unnest([persistence, seasonal, blend]) - actual) as e from fb where actual is not null),
m as (select key, band, method, avg(e) as mae from l group by 1, 2, 3)
select key, band, arg_min(method, (round(mae, 9), method)) as method, round(min(mae), 6) as mae from m group by 1, 2""")
def model_choice(t):
    return rounded(op.model_choice(blended(t).filter("actual is not null"), ["key", "band"], "actual", ["persistence", "seasonal", "blend"]), ["mae"])


ALARM = """with recursive cd as (select distinct event_type as key, time_bucket(interval '30 minutes', ts) as t from events where value > 20),
nx as (select key, t, min(t) over (partition by key order by t range between interval '120 minutes' following and unbounded following) as nt from cd),
al as (select key, min(t) as t from cd group by 1 union all select al.key, nx.nt from al join nx on nx.key = al.key and nx.t = al.t where nx.nt is not null)"""


def alarms(t):
    c = t.events.filter("value > 20").select(F.col("event_type").alias("key"), cal.floor_time(F.col("ts"), 1800).alias("t"))
    return op.refractory_alarms(c, ["key"], "t", "120 minutes")


@query("f18_refractory_alarms", f"{ALARM} select key, t from al")
def refractory_alarms(t):
    return alarms(t)


@query("f18_alarm_match", f"""{ALARM}, inc as (select event_type as key, ts as att from events where value > 40)
select al.key, t, min(att) as matched from al left join inc on inc.key = al.key and att between t + interval 30 minutes and t + interval 120 minutes group by 1, 2""")
def alarm_match(t):
    inc = t.events.filter("value > 40").select(F.col("event_type").alias("key"), F.col("ts").alias("att"))
    return op.match_alarms(alarms(t), inc, ["key"], "t", "att", "30 minutes", "120 minutes")


@query("f19_reliability_table", """with w as (select least(l_discount * 8 + l_tax * 2, 1) as p, (l_returnflag = 'R')::int as y from lineitem), r as (select round(p, 4) as p, y from w)
select least(floor(p * 10), 9)::int as bin, count(*) as n, round(avg(p), 6) as predicted, round(avg(y), 6) as observed from r group by 1""")
def reliability_table(t):
    d = t.lineitem.select(F.round(F.least(F.col("l_discount") * 8 + F.col("l_tax") * 2, F.lit(1.0)), 4).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(op.reliability(d, "p", "y"), ["predicted", "observed"])


@query("f19_probability_scores", """with r as (select l_linestatus as cell, greatest(least(round(l_discount * 8 + l_tax * 2, 4), 1 - 1e-6), 1e-6) as p, (l_returnflag = 'R')::int as y from lineitem),
d as (select cell, p, sum(y) as w, count(*) as n from r group by 1, 2), c as (select *, sum(w) over (partition by cell order by p desc) as h, sum(n) over (partition by cell order by p desc) as a, sum(w) over (partition by cell) as tot from d),
ap as (select cell, sum(w * h / a) / max(tot) as ap from c group by 1)
select r.cell, count(*) as n, sum(y)::bigint as positives, round(avg((p - y) * (p - y)), 6) as brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) as log_loss, round(any_value(ap), 6) as average_precision from r join ap using (cell) group by 1""")
def probability_scores(t):
    d = t.lineitem.select(F.col("l_linestatus").alias("cell"), F.round(F.col("l_discount") * 8 + F.col("l_tax") * 2, 4).alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(op.probability_scores(d, ["cell"], "p", "y"), ["brier", "log_loss", "average_precision"])


@query("f20_benchmark_compare", f"""with {VINTAGE}, m as (select ours.*, ext.value as theirs from ours join ext using (key, origin, time) where rn = 1),
b as (select key, avg(theirs - own) as bias from m where time < '2024-01-15' group by 1)
select key, count(*) as n, round(avg(abs(theirs - own)), 6) as mae_raw, round(avg(abs(theirs - bias - own)), 6) as mae_corrected, round(any_value(bias), 6) as bias from m join b using (key) where time >= '2024-01-15' group by 1""")
def benchmark_compare(t):
    m = vintage(t)
    b = m.filter(F.col("time") < ts("2024-01-15")).groupBy("key").agg(F.avg(F.col("theirs") - F.col("own")).alias("bias"))
    e = F.col("theirs") - F.col("own")
    return m.filter(F.col("time") >= ts("2024-01-15")).join(b, "key").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(F.abs(e))).alias("mae_raw"), r6(F.avg(F.abs(e - F.col("bias")))).alias("mae_corrected"), r6(F.max("bias")).alias("bias"))


@query("f21_scorecard", f"""with {FC}, d as (select *, case when extract(day from time) % 9 = 0 then 'unavailable' else 'complete' end as status from fb)
select key, band, count(*) as requested, count(*) filter (not coalesce(status = 'complete' and actual is not null and blend is not null, false)) as unscored, round(avg(abs(blend - actual)) filter (status = 'complete'), 6) as mae,
  round(avg(abs(persistence - actual)) filter (status = 'complete' and blend is not null), 6) as baseline_mae, round(avg((actual between blend - 20 and blend + 20)::int) filter (status = 'complete'), 6) as coverage_80,
  round(avg((actual between blend - 50 and blend + 50)::int) filter (status = 'complete'), 6) as coverage_95,
  round(1 - avg(abs(blend - actual)) filter (status = 'complete' and persistence is not null) / avg(abs(persistence - actual)) filter (status = 'complete' and blend is not null), 6) as skill,
  case when avg((actual between blend - 20 and blend + 20)::int) filter (status = 'complete') >= 0.77 and avg((actual between blend - 50 and blend + 50)::int) filter (status = 'complete') >= 0.92 then 'calibrated' else 'experimental' end as calibration
from d group by 1, 2""")
def scorecard(t):
    b = F.col("blend")
    d = blended(t).withColumns({"status": F.when(F.dayofmonth("time") % 9 == 0, "unavailable").otherwise("complete"), "forecast_mw": b, "baseline_mw": F.col("persistence"),
                                "p10": b - 20, "p90": b + 20, "p02": b - 50, "p97": b + 50})
    return rounded(op.scorecard(d, ["key", "band"]), ["mae", "baseline_mae", "coverage_80", "coverage_95", "skill"])


@query("f22_target_unpivot", f"""with {GRID} select key, time as delivery, unnest(['flow', 'count']) as target, unnest([v, n]) as actual, md5(concat_ws('|', key, strftime(time, '%Y-%m-%d %H:%M:%S'))) as revision_id from grid where v is not null""")
def target_unpivot(t):
    g = grid(t).filter("v is not null").select("key", F.col("time").alias("delivery"), F.col("v").alias("flow"), F.col("n").cast("double").alias("count"),
                                               F.md5(F.concat_ws("|", "key", F.date_format("time", "yyyy-MM-dd HH:mm:ss"))).alias("revision_id"))
    return g.unpivot(["key", "delivery", "revision_id"], ["flow", "count"], "target", "actual")


@query("f23_route_fallback", """
with r as (select o_orderkey, o_orderstatus as target, o_orderdate as origin, (o_orderkey % 120)::int as lead from orders),
m as (select * from (values ('P', 1, 'boosted', 'approved', timestamp '1999-01-01', 48), ('P', 2, 'ridge', 'approved', timestamp '1996-01-01', 96), ('O', 1, 'boosted', 'draft', timestamp '1995-01-01', 400), ('O', 2, 'seasonal', 'approved', timestamp '1990-01-01', 400),
  ('F', 1, 'ridge', 'approved', timestamp '1997-01-01', 100)) x(target, rank, model, status, cutoff, max_lead)),
c as (select *, case when status <> 'approved' then 'not approved' when cutoff > origin then 'trained after origin' when lead > max_lead then 'lead not served' end as why from r join m using (target))
select o_orderkey, arg_min(model, rank) filter (why is null) as model, coalesce(string_agg(model || ': ' || why, '; ' order by rank) filter (why is not null), '') as failures,
  case when arg_min(model, rank) filter (why is null) is null then 'unavailable' else 'routed' end as status from c group by 1""")
def route_fallback(t):
    m = t.spark.createDataFrame([("P", 1, "boosted", "approved", "1999-01-01", 48), ("P", 2, "ridge", "approved", "1996-01-01", 96), ("O", 1, "boosted", "draft", "1995-01-01", 400),
                                 ("O", 2, "seasonal", "approved", "1990-01-01", 400), ("F", 1, "ridge", "approved", "1997-01-01", 100)],
                                "target string, rank int, model string, status string, cutoff string, max_lead int").withColumn("cutoff", F.col("cutoff").cast("timestamp_ntz"))
    r = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("target"), F.col("o_orderdate").alias("origin"), (F.col("o_orderkey") % 120).cast("int").alias("lead"))
    return op.routed(r, m, ["target"], ["o_orderkey"])


@query("f24_scenario_input_check", f"""with {GRID}, d as (select key, time, v - 5 as v, k from grid where v is not null), n as (select key, x as time from (select distinct key from d), (select unnest(generate_series(timestamp '2024-01-08', timestamp '2024-01-08' + interval 335 hours, interval 1 hour)) as x))
select d.key, count(*) as rows, count(*) filter (v is null or v < 0 or k is null) as bad_values, (select count(*) from n where n.key = d.key and n.time not in (select time from d d2 where d2.key = d.key)) as missing from d group by 1""")
def scenario_input_check(t):
    d = grid(t).filter("v is not null").select("key", "time", (F.col("v") - 5).alias("v"), F.col("k").cast("double").alias("k"))
    return op.input_check(d, ["key"], "time", ts("2024-01-08"), 336, "1 hour", ["v", "k"])


@query("f25_seasonal_lookup_model", f"""with {GRID}, tr as (select * from grid where time < '2024-01-12' and v is not null), m as (select key, hour(time) as slot, quantile_cont(v, 0.5) as q from tr group by 1, 2), g as (select quantile_cont(v, 0.5) as q from tr)
select grid.key, time, round(coalesce(m.q, g.q), 6) as forecast from grid left join m on m.key = grid.key and m.slot = hour(time), g""")
def seasonal_lookup_model(t):
    g = grid(t).select("key", "time", "v", F.hour("time").alias("slot"))
    return rounded(op.seasonal_lookup(g.filter((F.col("time") < ts("2024-01-12")) & F.col("v").isNotNull()), g, ["key", "slot"], "v").select("key", "time", "forecast"), ["forecast"])


