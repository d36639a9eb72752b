"""Outage bookings and matched comparison on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import lookups as lk
from ..operators import outages as op
from ..operators import resample
from ..operators import windows as win
from ..session import cut
from .aggregates import rounded
from .cleaning import BOOK, bookings
from .joins import CHAIN, chain
from .registry import query
from .resampling import draws
from .standins import r6, ts

# Daily snapshots of active users.
SNAP = """sn as (select distinct user_id as row_id, date_diff('day', timestamp '2024-01-01', date_trunc('day', ts)) as i from events where event_type = 'purchase'), sb as (select min(i) as lo, max(i) as hi from sn),
ch as (select row_id, i, 1 as present from sn a where not exists (select 1 from sn b where b.row_id = a.row_id and b.i = a.i - 1) union all select row_id, i + 1, 0 from sn a, sb where i < hi and not exists (select 1 from sn b where b.row_id = a.row_id and b.i = a.i + 1))"""


def presence(t):
    return t.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("row_id"), F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("i")).distinct()


def changes(t):
    p = presence(t)
    b = p.agg(F.min("i").alias("lo"), F.max("i").alias("hi"))   # one row
    d = p.join(F.broadcast(b))
    return op.snapshot_changes(d.drop("lo", "hi"), "row_id", "i", F.lit(-1), F.lit(10**9)).join(F.broadcast(b)).filter("present = 1 or i <= hi").drop("lo", "hi")


@query("o1_snapshot_diff", f"with {SNAP} select row_id, i, present from ch")
def snapshot_diff(t):
    return changes(t)


@query("o2_snapshot_at", f"""with {SNAP}, l as (select row_id, arg_max(present, i) as present, max(i) as since from ch where i <= 20 group by 1) select row_id, since from l where present = 1""")
def snapshot_at(t):
    return op.snapshot_at(changes(t), "row_id", "i", F.lit(20))


@query("o3_episode_build", """
with a as (select l_orderkey, l_suppkey as asset, l_returnflag, l_extendedprice, o_orderdate + interval 5 days as ss, o_orderdate + interval 35 days as se, case when l_linestatus = 'O' then l_shipdate end as s1,
  case when l_linestatus = 'O' then l_shipdate + to_days((l_quantity - 10)::int) end as e1 from lineitem join orders on l_orderkey = o_orderkey),
d as (select *, coalesce(e1 > s1, false) as ok from a), e as (select *, case when ok then s1 else ss end as s, case when ok then e1 else se end as e from d),
p as (select l_orderkey, asset, row_number() over (partition by l_orderkey order by case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end, l_extendedprice desc, asset) as rn from e)
select e.l_orderkey, min(s) as start, max(e) as "end", min(case when ok then 'actual' else 'scheduled' end) as window_source, count(distinct e.asset) as n_assets, max(p.asset) as primary_asset from e join p on p.l_orderkey = e.l_orderkey and rn = 1 group by 1""")
def episode_build(t):
    open_ = F.col("l_linestatus") == "O"
    a = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", F.col("l_suppkey").alias("asset"), "l_returnflag", "l_extendedprice", (F.col("o_orderdate") + F.expr("interval 5 days")).alias("sched_start"), (F.col("o_orderdate") + F.expr("interval 35 days")).alias("sched_end"),
        F.when(open_, F.col("l_shipdate")).alias("actual_start"), F.when(open_, F.col("l_shipdate") + F.make_dt_interval(days=(F.col("l_quantity") - 10).cast("int"))).alias("actual_end"))
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return op.episodes(a, "l_orderkey", [kind, F.desc("l_extendedprice"), F.col("asset")])


@query("o4_invocation_spells", """
select o_orderkey as inv, o_custkey as family, greatest(o_orderdate, timestamp '1996-01-01') as s, least(coalesce(case when o_orderstatus <> 'P' then o_orderdate + to_days((o_orderkey % 200)::int) end, timestamp '2000-01-01'), timestamp '2000-01-01') as e from orders
where coalesce(case when o_orderstatus <> 'P' then o_orderdate + to_days((o_orderkey % 200)::int) end, timestamp '2000-01-01') >= o_orderdate and coalesce(case when o_orderstatus <> 'P' then o_orderdate + to_days((o_orderkey % 200)::int) end, timestamp '2000-01-01') > timestamp '1996-01-01' and o_orderdate <= timestamp '2000-01-01'""")
def invocation_spells(t):
    e = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 200).cast("int")))
    d = t.orders.select(F.col("o_orderkey").alias("inv"), F.col("o_custkey").alias("family"), F.col("o_orderdate").alias("s"), e.alias("e"))
    return op.invocation_spells(d, "inv", "s", "e", ts("1996-01-01"), ts("2000-01-01"))


FAM = "fs as (select o_custkey as family, o_orderdate as s, o_orderdate + interval 120 days as e from orders)"


def family_spells(t):
    return t.orders.select(F.col("o_custkey").alias("family"), F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("interval 120 days")).alias("e"))


@query("o5_family_relevance", f"""with {FAM}, hit as (select l_suppkey as family, l_linestatus as dir from lineitem where exists (select 1 from fs where family = l_suppkey and l_shipdate between s and e)), n as (select family, max(c) as max_leads, sum(c)::bigint as leads from (select family, dir, count(*) as c from hit group by 1, 2) group by 1),
d as (select *, max(e) over (partition by family order by s, e rows between unbounded preceding and 1 preceding) as reach from fs), g as (select *, sum((reach is null or s > reach)::int) over (partition by family order by s, e rows unbounded preceding) as g from d),
m as (select family, g, min(s) as s, max(e) as e from g group by 1, 2), sh as (select family, sum(date_diff('microsecond', s, e)) / 3600000000 / 60000 as share from m group by 1)
select family, max_leads, leads, round(share, 6) as invoked_share, case when share > 0.95 then 'always invoked' when max_leads < 100 then 'led too seldom' else '' end as reason from n join sh using (family)""")
def family_relevance(t):
    leads = t.lineitem.select(F.col("l_suppkey").alias("family"), F.col("l_linestatus").alias("dir"), F.col("l_shipdate").alias("time"), "l_orderkey", "l_linenumber", "l_partkey")
    return rounded(op.family_relevance(leads, family_spells(t), "family", "dir", "time", "s", "e", F.lit(60000), minimum=100, hours=24 * 365), ["invoked_share"])


@query("o6_exposure_features", f"""
with b as (select equipment as oid, equipment % 25 as eq, issue, start, "end", status, outage_id as rev from {BOOK}), o as (select unnest(generate_series(timestamp '1995-03-01', timestamp '2001-07-01', interval 30 days)) as origin),
k as (select origin, b.*, row_number() over (partition by origin, oid order by issue desc, rev desc) as rn from o join b on issue <= origin), l as (select k.*, lead, origin + to_days(lead::int) as delivery from k, (select unnest([7, 21]) as lead) where rn = 1 and status <> 'cancelled')
select origin, lead, count(*) filter (start <= delivery and "end" > delivery) as active, count(distinct eq) filter (start <= delivery and "end" > delivery) as equipment, count(*) filter (start > delivery - interval 7 days and start <= delivery) as starts,
  count(*) filter ("end" > delivery - interval 7 days and "end" <= delivery) as ends, max(date_diff('day', issue, origin)) filter (start <= delivery and "end" > delivery) as oldest_revision_days from l
where start <= delivery and "end" > delivery - interval 7 days group by 1, 2""")
def exposure_features(t):
    b = bookings(t).select(F.col("equipment").alias("oid"), (F.col("equipment") % 25).alias("eq"), "issue", "start", F.col("end").alias("finish"), "status", F.col("outage_id").alias("rev"))
    known = lk.known_intervals(b, "oid", ["issue"], ["issue", "rev"], ["eq", "start", "finish", "status", "issue"], hours=24 * 365).filter("status <> 'cancelled'")
    week = F.expr("interval 7 days")
    req = t.spark.range(1).select(F.explode(F.sequence(ts("1995-03-01"), ts("2001-07-01"), F.expr("interval 30 days"))).alias("origin")).withColumn("lead", F.explode(F.array(F.lit(7), F.lit(21))))
    req = req.withColumn("delivery", F.col("origin") + F.make_dt_interval(days=F.col("lead")))
    hit = lk.points_in_intervals(req, known.withColumn("_until", F.col("finish") + week), [], "delivery", "start", "_until", hours=24 * 15, right_open=True)
    hit = hit.filter((F.col("known_from") <= F.col("origin")) & (F.col("known_to").isNull() | (F.col("known_to") > F.col("origin"))))
    on = F.col("finish") > F.col("delivery")
    n = lambda c: F.count(F.when(c, 1))
    return hit.groupBy("origin", "lead").agg(
        n(on).alias("active"), F.countDistinct(F.when(on, F.col("eq"))).alias("equipment"), n(F.col("start") > F.col("delivery") - week).alias("starts"),
        n((F.col("finish") > F.col("delivery") - week) & (F.col("finish") <= F.col("delivery"))).alias("ends"),
        F.max(F.when(on, F.datediff(F.col("origin").cast("date"), F.col("issue").cast("date")))).cast("long").alias("oldest_revision_days"))


COVER = """sv as (select event_type as family, ts as s, ts + to_minutes(floor(value)::int) as e from events), sp5 as (select distinct family, unnest(generate_series(time_bucket(interval '5 minutes', s - interval 1 microsecond) + interval 5 minutes, e, interval 5 minutes)) as p from sv),
cv as (select family, time_bucket(interval '30 minutes', p - interval 1 microsecond) + interval 30 minutes as time, count(*) as covered from sp5 group by 1, 2)"""


@query("o7_active_sets_panel", f"""with {COVER}, g as (select unnest(generate_series(timestamp '2024-01-01 00:30:00', timestamp '2024-02-10', interval 30 minutes)) as time),
a as (select time, coalesce(string_agg(family, '|' order by family) filter (covered = 6), '') as active, coalesce(string_agg(family, '|' order by family) filter (covered < 6), '') as partial from cv group by 1)
select g.time, coalesce(active, '') as active, coalesce(partial, '') as partial, case when g.time > timestamp '2024-02-08' then 'unknown' when coalesce(active, '') <> '' then 'invoked' when coalesce(partial, '') <> '' then 'partial' else 'clear' end as state from g left join a using (time)""")
def active_sets_panel(t):
    s = t.events.select(F.col("event_type").alias("family"), F.col("ts").alias("s"), (F.col("ts") + F.make_dt_interval(mins=F.floor("value").cast("int"))).alias("e"))
    cov = win.covered_intervals(s, ["family"], "s", "e", gap="0 seconds")
    g = t.spark.range(1).select(F.explode(F.sequence(ts("2024-01-01 00:30:00"), ts("2024-02-10"), F.expr("interval 30 minutes"))).alias("time"))
    return op.active_sets(g, cov, [], "time", "family", 6, ts("2024-02-08"))


# Matched comparison: one row per supplier and shipping day; family f is active when its
# line number carries a return; f is compared with days on which only the others were.
PANEL = """pn as (select l_suppkey as link, l_shipdate as time, sum(l_quantity) as v, avg(l_extendedprice) as x, coalesce(string_agg(distinct l_linenumber::varchar, '|' order by l_linenumber::varchar) filter (l_returnflag = 'R'), '') as fams,
  floor(month(l_shipdate) % 12 / 3)::int as season, (isodow(l_shipdate) < 6)::int as daytype, isodow(l_shipdate) - 1 as slot from lineitem group by l_suppkey, l_shipdate),
fl as (select l_suppkey as link, l_shipdate as time, l_linenumber as f from lineitem where l_returnflag = 'R' group by 1, 2, 3),
tr as (select f, pn.*, array_to_string(list_filter(string_split(fams, '|'), lambda y: y <> f::varchar), '|') as others from fl join pn using (link, time)),
ct as (select *, case when fams = '' then 0 else len(string_split(fams, '|')) end as cnt from pn),
tt as (select *, case when others = '' then 0 else len(string_split(others, '|')) end as ocnt from tr)"""


def matched_sql(treated="tt", tag=""):
    base = f"""abs(date_diff('day', t.time, c.time)) <= 60 and c.link = t.link and (c.slot = t.slot or c.slot = (t.slot + 6) % 7 or c.slot = (t.slot + 1) % 7)"""
    order = "case when c.slot = t.slot then 0 else 1 end, md5(concat_ws('|', t.f, t.link, strftime(t.time, '%Y-%m-%d %H:%M:%S'), strftime(c.time, '%Y-%m-%d %H:%M:%S'), 17)), c.time"
    cols = "t.f, t.link, t.time, c.time as control_time"
    return f"""e1{tag} as (select * from (select {cols}, row_number() over (partition by t.f, t.link, t.time order by {order}) as rn from {treated} t join ct c on {base} and c.season = t.season and c.daytype = t.daytype and c.fams = t.others) where rn <= 5),
r1{tag} as (select * from {treated} t where not exists (select 1 from e1{tag} e where e.f = t.f and e.link = t.link and e.time = t.time)),
e2{tag} as (select * from (select {cols}, row_number() over (partition by t.f, t.link, t.time order by {order}) as rn from r1{tag} t join ct c on {base} and c.daytype = t.daytype and c.cnt = t.ocnt where not list_contains(string_split(c.fams, '|'), t.f::varchar)) where rn <= 5),
pr{tag} as (select f, link, time, control_time, 'exact' as match_type from e1{tag} union all select f, link, time, control_time, 'coarse' from e2{tag}),
md{tag} as (select pr{tag}.f, pr{tag}.link, pr{tag}.time, quantile_cont(c.v, 0.5) as control, avg(c.x) as control_x, count(*) as n_controls, max(match_type) as match_type from pr{tag} join pn c on c.link = pr{tag}.link and c.time = control_time group by 1, 2, 3),
un{tag} as (select md{tag}.*, pn.v as treated, pn.v - control as effect, pn.x from md{tag} join pn using (link, time))"""


MATCH = PANEL + ", " + matched_sql()


def panel(t):
    """The supplier-day panel; it feeds treated rows, controls and values, so it is written once."""
    return t.once("panel", _panel)


def _panel(t):
    # The families are line numbers, a handful.  Each is a flag of a plain sum, for sets of text are collected by sorting all rows.
    n = F.col("l_linenumber")
    on = sorted((r[0] for r in t.lineitem.filter((F.col("l_returnflag") == "R") & n.isNotNull()).select(n).distinct().collect()), key=str)
    flags = [F.max(F.when((F.col("l_returnflag") == "R") & (n == f), 1)).alias(f"_f{i}") for i, f in enumerate(on)]
    time = F.col("time")
    d = t.lineitem.groupBy(F.col("l_suppkey").alias("link"), F.col("l_shipdate").alias("time")).agg(F.sum("l_quantity").alias("v"), F.avg("l_extendedprice").alias("x"), *flags)
    return d.select("link", "time", "v", "x", F.concat_ws("|", *[F.when(F.col(f"_f{i}") == 1, str(f)) for i, f in enumerate(on)]).alias("fams"),
                    cal.season(time).alias("season"), (F.weekday(time) < 5).cast("int").alias("daytype"), F.weekday(time).alias("slot"))


def _count(c):
    return F.when(F.col(c) == "", 0).otherwise(F.length(c) - F.length(F.translate(c, "|", "")) + 1)


def treated_rows(t):
    p = panel(t)
    d = p.filter("fams <> ''").withColumn("f", F.explode(F.split("fams", r"\|")))
    d = d.withColumn("others", F.array_join(F.array_remove(F.split("fams", r"\|"), F.col("f")), "|"))     # in order and distinct already
    return d.withColumns({"ocnt": _count("others"), "sig": F.col("others"), "cnt": _count("others"), "f": F.col("f").cast("int")})


def control_rows(t):
    p = panel(t)
    return p.withColumns({"sig": F.col("fams"), "cnt": _count("fams"), "control_time": F.col("time")})


# Equal signatures have equal counts; naming the count in both levels makes it part of their join.
LEVELS = {"exact": ["season", "daytype", "sig", "cnt"], "coarse": ["daytype", "cnt"]}


def pairs(t):
    """Matched pairs of all treated rows; they feed units and counts, so they are written once."""
    return t.once("pairs", lambda t: op.matched_pairs(*_matching(t, treated_rows(t))))


def _matching(t, tr):
    """The arguments of the matching of treated rows with all panel rows."""
    free = (F.col("_c_fams") == "") | ~F.array_contains(F.split("_c_fams", r"\|"), F.col("f").cast("string"))
    tr = tr.select("f", "link", "time", "v", "slot", *dict.fromkeys(c for on in LEVELS.values() for c in on))
    return tr, control_rows(t), ["f", "link", "time"], "link", "time", 60, LEVELS, "slot", 7, 5, 17, free


def effects(t, tr):
    return op.matched_effects(*_matching(t, tr), "v")


def units(t):
    """Effects of all treated rows, written once."""
    return t.once("units", lambda t: effects(t, treated_rows(t)))


@query("o8_matched_effect", f"with {MATCH} select f, link, time, control, n_controls, match_type, treated, effect from un")
def matched_effect(t):
    return units(t).select("f", "link", "time", "control", "n_controls", "match_type", "treated", "effect")


@query("o9_effect_summary", f"""with {MATCH}, n as (select f, count(*) as n_treated from tr group by 1)
select n.f, n_treated, count(un.f) as n_matched, round(count(un.f) / n_treated, 6) as match_rate, round(avg((match_type = 'exact')::int), 6) as exact_share, quantile_cont(effect, 0.5) as effect,
  case when count(distinct un.link) >= 5 and count(un.f) >= 24 and count(un.f) / n_treated >= 0.6 then 'supported' when count(distinct un.link) >= 5 and count(un.f) / n_treated >= 0.6 then 'indicative' else 'unsupported' end as tier
from n left join un using (f) group by 1, 2""")
def effect_summary(t):
    u = units(t)
    d = op.effect_summary(u, treated_rows(t), ["f"]).join(u.groupBy("f").agg(F.countDistinct("link").alias("_e")), "f", "left")
    tier = op.evidence_tier(F.coalesce("_e", F.lit(0)), F.col("n_matched"), F.col("match_rate"), F.lit(True), F.lit(0))
    return rounded(d.withColumn("tier", tier).drop("_e"), ["match_rate", "exact_share"])


@query("o9_balance", f"""with {MATCH}, a as (select f, avg(x) as a, var_pop(x) as v from tr group by 1), b as (select f, avg(pn.x) as a, var_pop(pn.x) as v from (select distinct f from tr) fs, pn where not list_contains(string_split(fams, '|'), f::varchar) group by 1), m as (select f, avg(x - control_x) as d from un group by 1)
select a.f, round((a.a - b.a) / sqrt((a.v + b.v) / 2), 6) as smd_before, round(m.d / sqrt((a.v + b.v) / 2), 6) as smd_after from a join b using (f) left join m using (f)""")
def balance(t):
    p = panel(t)
    pool = p.withColumn("f", F.explode(F.sequence(F.lit(1), F.lit(7)))).filter(~F.array_contains(F.split("fams", r"\|"), F.col("f").cast("string")))
    pr = pairs(t)
    cx = pr.join(p.select("link", F.col("time").alias("control_time"), F.col("x").alias("cx")), ["link", "control_time"]).groupBy("f", "link", "time").agg(F.avg("cx").alias("control_x"))
    m = cx.join(p.select("link", "time", "x"), ["link", "time"])
    return rounded(op.balance(treated_rows(t), pool, m, ["f"], "x"), ["smd_before", "smd_after"])


PLACEBO = PANEL + """, ps as (select distinct tt.f, pn.*, pn.fams as others, case when pn.fams = '' then 0 else len(string_split(pn.fams, '|')) end as ocnt from tt join pn on pn.link = tt.link and (pn.time = tt.time + interval 7 days or pn.time = tt.time - interval 7 days)
  where not list_contains(string_split(pn.fams, '|'), tt.f::varchar)), """ + matched_sql("ps", "p")


@query("o10_placebo", f"""with {PLACEBO} select f, count(*) as placebo_n, quantile_cont(effect, 0.5) as placebo_effect from unp group by 1""")
def placebo(t):
    from ..operators.ranks import quantiles
    p = panel(t)
    sh = treated_rows(t).select("f", "link", F.explode(F.array(F.col("time") + F.expr("interval 7 days"), F.col("time") - F.expr("interval 7 days"))).alias("time")).distinct()
    ps = sh.join(p, ["link", "time"]).filter(~F.array_contains(F.split("fams", r"\|"), F.col("f").cast("string")))
    ps = ps.withColumns({"others": F.col("fams"), "ocnt": _count("fams"), "sig": F.col("fams"), "cnt": _count("fams")})
    u = cut(effects(t, ps), "placebo")      # its quantiles read it more than once
    q = quantiles(u, ["f"], "effect", {"placebo_effect": 0.5})
    return q.select("f", F.col("n_values").alias("placebo_n"), "placebo_effect")


@query("o10_placebo_interval", f"""with {PANEL}, {matched_sql()}, u as (select f as key, time as day, effect as v from un), dx as (select key, day, row_number() over (partition by key order by day) - 1 as idx from (select distinct key, day from u)), nn as (select key, count(*) as nd from dx group by 1), {draws(1, 60, 7)},
w as (select key, r, idx, count(*) as w from dr group by 1, 2, 3), x as (select u.key, r, v, sum(w) as w from u join dx using (key, day) join w using (key, idx) group by 1, 2, 3), c as (select *, sum(w) over (partition by key, r order by v) as cum, sum(w) over (partition by key, r) as tot from x),
m as (select key, r, min(v) as m from c where cum >= tot / 2 group by 1, 2) select key, round(quantile_cont(m, 0.025), 6) as ci_low, round(quantile_cont(m, 0.975), 6) as ci_high, (quantile_cont(m, 0.025) <= 0 and quantile_cont(m, 0.975) >= 0)::int as contains_zero from m group by 1""".replace("range(0, 1000) b(s)", "range(0, 5000) b(s)"))
def placebo_interval(t):
    u = units(t).select(F.col("f").alias("key"), F.col("time").alias("day"), F.col("effect").alias("v"))
    d = resample.weighted_median_ci(u, ["key"], "day", "v", 60, 7)
    return rounded(d.withColumn("contains_zero", ((F.col("ci_low") <= 0) & (F.col("ci_high") >= 0)).cast("int")), ["ci_low", "ci_high"])


@query("o11_key_levels", f"""with {MATCH}, l as (select un.*, s_nationkey as nation, unnest(['asset', 'asset_family', 'nation', 'all']) as level from un join supplier on s_suppkey = link),
k as (select *, case level when 'asset' then link::varchar when 'asset_family' then link || '/' || f when 'nation' then nation::varchar else 'all' end as key from l)
select level, key, count(*) as units, count(distinct time) as episodes, quantile_cont(effect, 0.5) as effect, case when count(distinct time) >= 3 then 'estimated' else 'unsupported' end as tier from k group by 1, 2""")
def key_levels(t):
    u = units(t).join(t.supplier.select(F.col("s_suppkey").alias("link"), F.col("s_nationkey").alias("nation")), "link")
    return op.key_levels(u, {"asset": F.col("link"), "asset_family": F.concat_ws("/", "link", "f"), "nation": F.col("nation"), "all": F.lit("all")}, "time", 3)


@query("o12_state_coverage", f"""with {PANEL} select case when v < 5 then 'unknown' when len(fams) > 1 then 'invoked_leading' when fams <> '' then 'invoked' when x > 60000 then 'booked_only' else 'clear' end as state, season, count(*) as n, round(avg(v), 6) as mean_v from pn group by 1, 2""")
def state_coverage(t):
    s = F.when(F.col("v") < 5, "unknown").when(F.length("fams") > 1, "invoked_leading").when(F.col("fams") != "", "invoked").when(F.col("x") > 60000, "booked_only").otherwise("clear")
    return panel(t).groupBy(s.alias("state"), "season").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("v")).alias("mean_v"))


LAY = """ly as (select l_suppkey as link, l_shipdate as time, l_partkey % 10 as eq, count(*) / any_value(n) as share from lineitem join (select l_suppkey as k, l_shipdate as d, count(*) as n from lineitem group by 1, 2) on k = l_suppkey and d = l_shipdate group by 1, 2, 3)"""


def share_layer(t):
    n = t.lineitem.groupBy(F.col("l_suppkey").alias("link"), F.col("l_shipdate").alias("time")).agg(F.count(F.lit(1)).alias("n"))
    c = t.lineitem.groupBy(F.col("l_suppkey").alias("link"), F.col("l_shipdate").alias("time"), (F.col("l_partkey") % 10).alias("eq")).agg(F.count(F.lit(1)).alias("c"))
    return c.join(n, ["link", "time"]).withColumn("share", F.col("c") / F.col("n")).drop("c", "n")


@query("o13_family_stats", f"""with {MATCH}, {LAY}, nc as (select f, link, time, count(*) as nc from pr group by 1, 2, 3), nu as (select f, count(*) as u from nc group by 1), ta as (select f, eq, sum(share) as s from nc join ly using (link, time) group by 1, 2),
ca as (select pr.f, eq, sum(share / nc) as s from pr join nc on nc.f = pr.f and nc.link = pr.link and nc.time = pr.time join ly on ly.link = pr.link and ly.time = control_time group by 1, 2),
d as (select coalesce(ta.f, ca.f) as f, coalesce(ta.eq, ca.eq) as eq, coalesce(ta.s, 0) / u as ts, coalesce(ca.s, 0) / u as cs from ta full join ca on ta.f = ca.f and ta.eq = ca.eq join nu on nu.f = coalesce(ta.f, ca.f)),
r as (select *, row_number() over (partition by f order by round(abs((ts - cs) * 100), 7) desc, eq) as rn from d)
select f, eq, round(ts, 6) as treated_share, round(cs, 6) as control_share, round((ts - cs) * 100, 5) as diff_pp from r where rn <= 5""")
def family_stats(t):
    pr = pairs(t)
    d = op.family_shares(pr, share_layer(t), ["f", "link", "time"], ["f"], "link", "time", "eq", "share", 5)
    return rounded(rounded(d, ["treated_share", "control_share"]), ["diff_pp"], 5)


@query("o14_event_profile", f"""with {LAY}, a as (select o_custkey as link, unnest(['start', 'end']) as anchor, unnest([o_orderdate, o_orderdate + interval 20 days]) as att from orders), o as (select a.*, "offset", att + to_days("offset"::int) as time from a, (select unnest(range(-5, 6)) as "offset"))
select anchor, "offset", round(avg(share), 6) as share, count(*) as n from o join ly using (link, time) where eq < 3 group by 1, 2""")
def event_profile(t):
    d = F.col("o_orderdate")
    a = t.orders.select(F.col("o_custkey").alias("link"), F.explode(F.array(F.struct(F.lit("start").alias("anchor"), d.alias("anchor_time")), F.struct(F.lit("end").alias("anchor"), (d + F.expr("interval 20 days")).alias("anchor_time")))).alias("_a")).select("link", "_a.*")
    return rounded(op.offset_profile(a, share_layer(t).filter("eq < 3"), ["link"], "time", "share", -5, 5, "1 day", ["anchor"]), ["share"])


@query("o15_booked_in_advance", f"""with recursive {CHAIN}, walk as (select id, id as fin, nxt from link union all select walk.id, link.id, link.nxt from walk join link on walk.nxt = link.id),
fi as (select id, fin from walk where nxt is null), fs as (select fin, min(o_orderdate) as seen from fi join orders on o_orderkey = id group by 1)
select (seen <= l_shipdate - interval 14 days)::int as booked, count(*) as n, round(avg(l_quantity), 6) as mean from lineitem join fi on fi.id = l_orderkey join fs using (fin) group by 1""")
def booked_in_advance(t):
    fi = lk.final_of_chain(chain(t), "id", "nxt").select("id", "final_id")
    seen = fi.join(t.orders.select(F.col("o_orderkey").alias("id"), "o_orderdate"), "id").groupBy("final_id").agg(F.min("o_orderdate").alias("seen"))
    d = t.lineitem.select(F.col("l_orderkey").alias("id"), "l_shipdate", "l_quantity").join(fi, "id").join(seen, "final_id")
    flag = (F.col("seen") <= F.col("l_shipdate") - F.expr("interval 14 days")).cast("int")
    return d.groupBy(flag.alias("booked")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("l_quantity")).alias("mean"))


@query("o16_isolated_before_after", """
with b as (select o_orderkey as id, o_custkey as key, o_orderdate as s, o_orderdate + interval 30 days as e from orders), lone as (select * from b where not exists (select 1 from b x where x.key = b.key and x.id <> b.id and b.s - interval 20 days < x.e and x.s < b.s + interval 20 days)),
sr as (select l_suppkey as key, l_shipdate as time, sum(l_quantity) as v from lineitem group by 1, 2), d as (select id, lone.key, lag, o, s - to_days((lag * 60)::int) + to_days(o::int) as time from lone, (select unnest(range(0, 7)) as lag), (select unnest(range(-20, 20)) as o)),
w as (select id, lag, avg(v) filter (o < 0) as a, avg(v) filter (o >= 0) as b from d join sr using (key, time) group by 1, 2), ok as (select *, b - a as c from w where a is not null and b is not null),
c as (select id, avg(c) as cc, count(*) as n from ok where lag > 0 group by 1 having count(*) >= 3)
select id, round(ok.c, 6) as change, round(cc, 6) as control_change, n as controls, round(ok.c - cc, 6) as effect from ok join c using (id) where lag = 0""")
def isolated_before_after(t):
    b = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("e"))
    sr = t.lineitem.groupBy(F.col("l_suppkey").alias("key"), F.col("l_shipdate").alias("time")).agg(F.sum("l_quantity").alias("v"))
    # bookings meet only those of their own key, so keys without a series go first; what is left is read three times
    b = cut(b.join(t.lineitem.select(F.col("l_suppkey").alias("key")).distinct(), "key", "left_semi"), "bookings")
    d = op.isolated_effects(b, sr, "id", ["key"], "s", "e", "time", "v", "1 day", 20, 20, "60 days", 6, 3)
    return rounded(d, ["change", "control_change", "effect"])


@query("o17_infer_family", """
with h as (select l_partkey as asset, p_brand as area, p_type as kind, l_orderkey as ep, l_suppkey % 10 as fam from lineitem join part on p_partkey = l_partkey where l_shipdate < '1999-01-01'), b as (select p_partkey, p_partkey as asset, p_brand as area, p_type as kind from part),
n1 as (select asset, kind, count(distinct ep) as n from h group by 1, 2 having count(distinct ep) >= 17), f1 as (select asset, kind, fam, count(distinct ep) as c from h group by 1, 2, 3), t1 as (select *, row_number() over (partition by asset, kind order by c desc, fam) as rn from f1 join n1 using (asset, kind)),
n2 as (select area, kind, count(distinct ep) as n from h group by 1, 2 having count(distinct ep) >= 17), f2 as (select area, kind, fam, count(distinct ep) as c from h group by 1, 2, 3), t2 as (select *, row_number() over (partition by area, kind order by c desc, fam) as rn from f2 join n2 using (area, kind)),
a as (select p_partkey, 'asset' as level, fam, c / n as probability, n as episodes from b join t1 using (asset, kind) where rn <= 3), z as (select p_partkey, 'area' as level, fam, c / n as probability, n as episodes from b join t2 using (area, kind) where rn <= 3 and p_partkey not in (select p_partkey from a))
select p_partkey, level, fam, round(probability, 6) as probability, episodes from a union all select p_partkey, level, fam, round(probability, 6), episodes from z""")
def infer_family(t):
    part = t.part.select("p_partkey", F.col("p_partkey").alias("asset"), F.col("p_brand").alias("area"), F.col("p_type").alias("kind"))
    h = t.lineitem.filter(F.col("l_shipdate") < ts("1999-01-01")).select(F.col("l_partkey").alias("asset"), F.col("l_orderkey").alias("ep"), (F.col("l_suppkey") % 10).alias("fam")).join(part.drop("p_partkey"), "asset")
    return rounded(op.inferred_families(part, h, "p_partkey", {"asset": ["asset", "kind"], "area": ["area", "kind"]}, "ep", "fam", 17, 3), ["probability"])


@query("o18_as_of_evidence", f"""with {MATCH}, o as (select unnest([timestamp '1997-01-01', timestamp '1999-01-01', timestamp '2001-01-01']) as as_of)
select as_of, f, count(*) as n_matched, quantile_cont(effect, 0.5) as effect, count(distinct link) as links from o join un on time <= as_of - interval 21 days group by 1, 2""")
def as_of_evidence(t):
    from ..operators.ranks import quantiles
    cuts = [ts(s) for s in ("1997-01-01", "1999-01-01", "2001-01-01")]
    u = units(t)
    known = F.array_compact(F.array(*[F.when(F.col("time") <= c - F.expr("interval 21 days"), c) for c in cuts]))
    u = u.withColumn("as_of", F.explode(known))
    s = u.groupBy("as_of", "f").agg(F.count(F.lit(1)).alias("n_matched"), F.countDistinct("link").alias("links"))
    return s.join(quantiles(u, ["as_of", "f"], "effect", {"effect": 0.5}).drop("n_values"), ["as_of", "f"])


@query("o19_outlook_build", f"""with {PANEL}, {LAY}, ef as (select f, avg(v) - (select avg(v) from pn) as eff, count(*) as n from tr group by 1), wr as (select l_linenumber as f, avg((l_linestatus = 'F')::int) as w from lineitem group by 1),
cell as (select f, season, avg(v) as own from tr group by 1, 2), b as (select o_orderkey as id, (o_orderkey % 7 + 1)::int as f, o_orderdate as s, floor(month(o_orderdate) % 12 / 3)::int as season from orders)
select id, b.f, round((1 - w), 6) as occurrence_weight, round(eff, 6) as limit_change, round((1 - w) * eff, 6) as expected_change, round(own, 6) as timing_rate from b join ef using (f) join wr using (f) left join cell on cell.f = b.f and cell.season = b.season""")
def outlook_build(t):
    tr = treated_rows(t)
    base = panel(t).agg(F.avg("v").alias("_all"))    # one row
    ef = tr.groupBy("f").agg(F.avg("v").alias("_m")).join(F.broadcast(base)).select("f", (F.col("_m") - F.col("_all")).alias("eff"))
    wr = t.lineitem.groupBy(F.col("l_linenumber").alias("f")).agg((1 - F.avg((F.col("l_linestatus") == "F").cast("int"))).alias("q"))
    cell = tr.groupBy("f", "season").agg(F.avg("v").alias("own"))
    b = t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7 + 1).cast("int").alias("f"), cal.season(F.col("o_orderdate")).alias("season"))
    d = b.join(ef, "f").join(wr, "f").join(cell, ["f", "season"], "left")
    return d.select("id", "f", r6("q").alias("occurrence_weight"), r6("eff").alias("limit_change"), r6(F.col("q") * F.col("eff")).alias("expected_change"), r6("own").alias("timing_rate"))


@query("o20_normal_rate", f"""with {LAY} select link, eq, floor(month(time) % 12 / 3)::int as season, isodow(time) - 1 as slot, round(avg(share), 6) as rate, count(*) as n from ly where time <= '2000-01-01' group by 1, 2, 3, 4""")
def normal_rate(t):
    d = share_layer(t).filter(F.col("time") <= ts("2000-01-01"))
    return d.groupBy("link", "eq", cal.season(F.col("time")).alias("season"), F.weekday("time").alias("slot")).agg(r6(F.avg("share")).alias("rate"), F.count(F.lit(1)).alias("n"))


@query("o21_outlook_score", """
with d as (select l_returnflag, case when l_linenumber <= 2 then '0-7 d' when l_linenumber <= 5 then '8-30 d' else 'later' end as band, l_discount * 9 as p, 0.4 as normal, l_tax * 10 as last, (l_quantity > 25)::int as y from lineitem)
select l_returnflag, band, count(*) as rows, round(avg((p - y) ^ 2), 6) as brier, round(avg((normal - y) ^ 2), 6) as brier_normal, round(avg((last - y) ^ 2), 6) as brier_last, round(1 - avg((p - y) ^ 2) / avg((normal - y) ^ 2), 6) as skill_normal, round(1 - avg((p - y) ^ 2) / avg((last - y) ^ 2), 6) as skill_last from d group by 1, 2""")
def outlook_score(t):
    d = t.lineitem.select("l_returnflag", cal.lead_band(F.col("l_linenumber"), [2, 5], ["0-7 d", "8-30 d", "later"]).alias("band"), (F.col("l_discount") * 9).alias("p"), F.lit(0.4).alias("normal"),
                          (F.col("l_tax") * 10).alias("last"), (F.col("l_quantity") > 25).cast("int").alias("y"))
    return rounded(op.brier_skill(d, ["l_returnflag", "band"], "y", "p", ["normal", "last"]), ["brier", "brier_normal", "brier_last", "skill_normal", "skill_last"])


@query("o22_network_flags", """
with v as (select eq, min(f) as first, max(f) as last from (select l_partkey as eq, l_linenumber as ver, min(l_shipdate) as f from lineitem group by 1, 2) group by 1)
select p_partkey as eq, coalesce(first > timestamp '1996-01-01' - interval 300 days, false)::int as is_new, coalesce(last > first and last > timestamp '2000-01-01' - interval 365 days, false)::int as late from part left join v on eq = p_partkey""")
def network_flags(t):
    v = t.lineitem.select(F.col("l_partkey").alias("eq"), F.col("l_linenumber").alias("ver"), F.col("l_shipdate").alias("time"))
    rows = t.part.select(F.col("p_partkey").alias("eq"))
    a = op.network_flags(rows, v, "eq", "ver", ts("1996-01-01"), 300, 30).select("eq", "is_new")
    b = op.network_flags(rows, v, "eq", "ver", ts("2000-01-01"), 180, 365).select("eq", F.col("reversioned").alias("late"))
    return a.join(b, "eq")


@query("o23_planned_set_hours", """
with s as (select o_custkey % 5 as pair, o_orderdate as known, o_orderdate + interval 60 days as s, o_orderdate + to_days((60 + o_orderkey % 90)::int) as e from orders), q as (select unnest(generate_series(timestamp '1995-01-01', timestamp '2001-10-01', interval 3 months)) as period)
select pair, period, round(sum(date_diff('second', greatest(s, period), least(e, period + interval 3 months)) / 3600), 6) as hours, count(*) as sets from s join q on known <= period - interval 30 days and e > period and s < period + interval 3 months group by 1, 2""")
def planned_set_hours(t):
    d = F.col("o_orderdate")
    s = t.orders.select((F.col("o_custkey") % 5).alias("pair"), d.alias("known"), (d + F.expr("interval 60 days")).alias("s"), (d + F.make_dt_interval(days=(F.col("o_orderkey") % 90 + 60).cast("int"))).alias("e"))
    q = t.spark.range(1).select(F.explode(F.sequence(ts("1995-01-01"), ts("2001-10-01"), F.expr("interval 3 months"))).alias("period"))
    q = q.withColumns({"cutoff": F.col("period") - F.expr("interval 30 days"), "p_start": F.col("period"), "p_end": F.add_months(F.col("period").cast("date"), 3).cast("timestamp_ntz")})
    return rounded(op.planned_hours(s, q, ["pair"], "known", "s", "e"), ["hours"])
