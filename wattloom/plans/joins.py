"""As-of, bitemporal, interval, version and matching joins on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import lookups as lk
from ..operators import revisions as rev
from .cleaning import BOOK, FORECAST, bookings, forecast_rows
from .registry import query
from .standins import SPELLS, r6, spells, ts


@query("j1_asof_backward", """
with f as (select o_custkey as key, o_orderdate as eff, max_by(o_totalprice, o_orderkey) as price from orders group by 1, 2)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, f.eff, f.price
from lineitem asof left join f on l_suppkey = f.key and l_shipdate >= f.eff""")
def asof_backward(t):
    facts = t.orders.select(F.col("o_custkey").alias("l_suppkey"), F.col("o_orderdate").alias("eff"),
                            F.col("o_totalprice").alias("price"), "o_orderkey")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return lk.asof_backward(rows, facts, ["l_suppkey"], "l_shipdate", "eff", ["price"], tie=["o_orderkey"],
                            hours=24 * 365).drop("l_shipdate")


@query("j1_asof_tolerance", """
select a.event_id, b.event_id as purchase_id from events a asof left join
  (select user_id, ts, event_id from events where event_type = 'purchase') b on a.user_id = b.user_id and a.ts > b.ts
where b.ts >= a.ts - interval 6 hours""")
def asof_tolerance(t):
    b = t.events.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("purchase_id"))
    return lk.asof_backward(t.events.select("event_id", "user_id", "ts"), b, ["user_id"], "ts", "at", ["purchase_id"],
                            strict=True, tolerance="6 hours").filter("purchase_id is not null").select("event_id", "purchase_id")


ORIGINS = """(select unnest(generate_series(date_trunc('day', min(o_orderdate)), max(o_orderdate), interval 7 days)) as origin from orders)"""


def origins(t, step="7 days"):
    return t.orders.agg(F.date_trunc("day", F.min("o_orderdate")).cast("timestamp_ntz").alias("a"),
                        F.max("o_orderdate").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr(f"interval {step}"))).alias("origin"))


@query("j2_asof_run", f"""
with f as (select * from {FORECAST}), runs as (select region, issue, max(received) as completed from f group by 1, 2),
best as (select origin, region, max(issue) as issue from {ORIGINS} join runs on completed <= origin group by 1, 2)
select origin, region, issue, count(*) as n_rows, round(sum(value), 2) as total
from best join f using (region, issue) where issue >= origin - interval 48 hours group by 1, 2, 3""")
def asof_run(t):
    f = forecast_rows(t)
    runs = lk.run_index(f, ["region"], [], "issue", "received")
    req = origins(t).withColumn("region", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))))
    best = lk.coherent_run_asof(req, runs, ["region"], "origin", "issue", [], "48 hours", hours=24 * 90)
    return best.join(f.select("region", "issue", "value"), ["region", "issue"]).groupBy("origin", "region", "issue").agg(
        F.count(F.lit(1)).alias("n_rows"), r6(F.sum("value"), 2).alias("total"))


@query("j3_product_preference", """
with runs as (select l_linestatus as product, l_orderkey as run, date_trunc('month', l_shipdate) as delivery,
    min(o_orderdate) as available from lineitem join orders on l_orderkey = o_orderkey
    group by 1, 2, 3 having count(distinct l_returnflag) = 2),
req as (select distinct date_trunc('month', l_shipdate) as delivery, lead, date_trunc('month', l_shipdate) - to_days(lead::int) as origin
  from lineitem, (select unnest([-10, 5, 20, 40]) as lead)),
c as (select req.*, product, run, available, row_number() over (partition by req.delivery, lead
  order by (product = 'F')::int, available desc, run desc) as rn from req join runs on runs.delivery = req.delivery and available <= origin)
select delivery, lead, origin, product, run, available from c where rn = 1""")
def product_preference(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_linestatus").alias("product"), F.col("l_orderkey").alias("run"),
        cal.month_start(F.col("l_shipdate")).alias("delivery"), F.col("o_orderdate").alias("available"), "l_returnflag")
    runs = lk.complete_runs(rows, ["product", "run", "delivery", "available"], "l_returnflag", 2)
    req = rows.select("delivery").distinct().withColumn("lead", F.explode(F.array(*[F.lit(x) for x in (-10, 5, 20, 40)])))
    req = req.withColumn("origin", F.col("delivery") - F.make_dt_interval(days=F.col("lead")))
    return lk.preferred_product(req, runs, ["delivery"], "product", ["O", "F"], "origin", "available", ["run"],
                                hours=24 * 365)


@query("j4_weather_at", """
with f as (select date_trunc('day', ts) as run, date_trunc('day', ts) + interval 1 day as available, event_type as variable,
    ts + interval 1 day as att, value from events),
ff as (select run, available, variable, att, max(value) as value from f group by all),
req as (select distinct date_trunc('hour', ts) + interval 1 day as origin from events),
r as (select origin, origin + interval 3 hours as delivery, max(available) - interval 1 day as run from req
  join (select distinct available from ff) a on available <= origin group by 1, 2),
v as (select r.*, variable from r join (select distinct run, variable from ff) x using (run)),
b as (select v.*, max_by(value, att) as v0, max(att) as t0 from v join ff using (run, variable) where att <= delivery group by all),
a as (select v.*, min_by(value, att) as v1, min(att) as t1 from v join ff using (run, variable) where att > delivery group by all)
select b.origin, b.delivery, b.variable, round(case when t0 = b.delivery then v0 when b.variable = 'view' then v1
  else v0 + (v1 - v0) * date_diff('microsecond', t0, b.delivery) / date_diff('microsecond', t0, t1) end, 6) as value
from b join a using (origin, delivery, run, variable)""")
def weather_at(t):
    day = cal.floor_time(F.col("ts"), 86400)
    f = t.events.groupBy(day.alias("run"), F.col("event_type").alias("variable"), (F.col("ts") + F.expr("interval 1 day")).alias("at")
                         ).agg(F.max("value").alias("value"))
    runs = f.select("run").distinct().select((F.col("run") + F.expr("interval 1 day")).alias("available"), "run",
                                             F.lit("all").alias("provider"))
    req = t.events.select((cal.floor_time(F.col("ts"), 3600) + F.expr("interval 1 day")).alias("origin"),
                          F.lit("all").alias("provider")).distinct()
    hit = lk.asof_backward(req, runs, ["provider"], "origin", "available", ["run"], hours=24 * 7).filter("run is not null")
    req2 = hit.join(f.select("run", "variable").distinct(), "run").select(
        "origin", (F.col("origin") + F.expr("interval 3 hours")).alias("delivery"), "run", "variable")
    b = lk.bracket(req2, f, ["run", "variable"], "delivery", "at", "value", hours=24)
    t0, t1 = cal.micros(F.col("before.at")), cal.micros(F.col("after.at"))
    v0, v1 = F.col("before.value"), F.col("after.value")
    value = (F.when(F.col("before.at") == F.col("delivery"), v0).when(F.col("variable") == "view", v1)
             .otherwise(v0 + (v1 - v0) * (cal.micros(F.col("delivery")) - t0) / (t1 - t0)))
    return b.filter(F.col("before").isNotNull() & F.col("after").isNotNull()).select(
        "origin", "delivery", "variable", r6(value).alias("value"))


UNITS = """units as (select s_suppkey as unit, s_nationkey % 5 as region, s_nationkey as station, s_acctbal as registered,
  timestamp '1995-01-01' + to_days((s_suppkey % 10 * 100)::int) as vf, timestamp '2000-01-01' + to_days((s_suppkey % 10 * 100)::int) as vt from supplier)"""


def units(t):
    at = lambda s: ts(s) + F.make_dt_interval(days=(F.col("s_suppkey") % 10 * 100).cast("int"))
    return t.supplier.select(F.col("s_suppkey").alias("unit"), (F.col("s_nationkey") % 5).alias("region"),
                             F.col("s_nationkey").alias("station"), F.col("s_acctbal").alias("registered"),
                             at("1995-01-01").alias("vf"), at("2000-01-01").alias("vt"))


@query("j5_unit_state_at", f"""
with {UNITS}, req as (select distinct date_trunc('month', l_shipdate) as delivery, date_trunc('month', l_shipdate) - interval 2 days as origin from lineitem),
av as (select l_suppkey as unit, l_shipdate as att, max_by(l_quantity, (l_orderkey, l_linenumber, l_quantity)) as mw from lineitem group by 1, 2),
j as (select delivery, origin, u.unit, region, station, registered from req join units u on vf <= delivery and vt > delivery),
k as (select j.*, mw from j asof left join av on av.unit = j.unit and j.origin >= av.att),
k2 as (select k.* replace (case when av2.att >= k.origin - interval 20 days then k.mw end as mw) from k asof left join av av2 on av2.unit = k.unit and k.origin >= av2.att),
s as (select delivery, region, station, sum(mw) as sm, count(*) as n, count(mw) as nk, sum(greatest(registered - mw, 0)) as un from k2 group by 1, 2, 3)
select delivery, region, sum(n)::bigint as units, round(sum(nk) / sum(n), 6) as coverage,
  case when sum(nk) = sum(n) then round(sum(sm), 2) end as available, round(sum(sm), 2) as known,
  case when sum(nk) = sum(n) then round(sum(un), 2) end as unavailable,
  case when sum(nk) = sum(n) and sum(sm) > 0 then round(sum(sm * sm) / (sum(sm) * sum(sm)), 9) end as station_hhi
from s group by 1, 2""")
def unit_state_at(t):
    month = cal.month_start(F.col("l_shipdate"))
    req = t.lineitem.select(month.alias("delivery")).distinct().withColumn("origin", F.col("delivery") - F.expr("interval 2 days"))
    live = lk.points_in_intervals(req, units(t), [], "delivery", "vf", "vt", hours=24 * 365, right_open=True)
    av = rev.latest(t.lineitem.select(F.col("l_suppkey").alias("unit"), F.col("l_shipdate").alias("at"),
                                      F.col("l_quantity").alias("mw"), "l_orderkey", "l_linenumber"),
                    ["unit", "at"], ["l_orderkey", "l_linenumber", "mw"])
    k = lk.asof_backward(live, av, ["unit"], "origin", "at", ["mw"], tolerance="20 days", hours=24 * 365)
    gap = F.greatest(F.col("registered") - F.col("mw"), F.lit(0.0))
    s = k.groupBy("delivery", "region", "station").agg(F.sum("mw").alias("sm"), F.count(F.lit(1)).alias("n"),
                                                      F.count("mw").alias("nk"), F.sum(gap).alias("un"))
    whole = F.sum("nk") == F.sum("n")
    total = F.sum("sm")
    return s.groupBy("delivery", "region").agg(
        F.sum("n").alias("units"), r6(F.sum("nk") / F.sum("n")).alias("coverage"), F.when(whole, r6(total, 2)).alias("available"),
        r6(total, 2).alias("known"), F.when(whole, r6(F.sum("un"), 2)).alias("unavailable"),
        F.when(whole & (total > 0), r6(F.sum(F.col("sm") * F.col("sm")) / (total * total), 9)).alias("station_hhi"))


@query("j6_version_exact", """
with f as (select l_partkey, l_suppkey, l_linenumber, max(l_discount) as factor from lineitem where l_returnflag <> 'R' group by 1, 2, 3)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, factor, (factor is null)::int as missing
from lineitem left join f using (l_partkey, l_suppkey, l_linenumber)""")
def version_exact(t):
    version = ["l_partkey", "l_suppkey", "l_linenumber"]
    f = t.lineitem.filter("l_returnflag <> 'R'").groupBy(*version).agg(F.max("l_discount").alias("factor"))
    return t.lineitem.select("l_orderkey", *version, "l_extendedprice").join(f, version, "left").withColumn(
        "missing", F.col("factor").isNull().cast("int"))


@query("j6_many_to_one_check", """
select l_partkey, l_suppkey, count(*) as copies from lineitem group by 1, 2 having count(*) > 1""")
def many_to_one_check(t):
    return lk.many_to_one_violations(t.lineitem, ["l_partkey", "l_suppkey"])


@query("j7_latest_version", """
select l_partkey, l_shipdate, l_linenumber, l_orderkey, l_suppkey from (select *, rank() over (partition by l_partkey
  order by l_shipdate desc, l_linenumber desc) as r from lineitem where l_shipdate <= '2000-06-30') where r = 1""")
def latest_version(t):
    return rev.latest_version(t.lineitem.filter(F.col("l_shipdate") <= ts("2000-06-30")), ["l_partkey"],
                              ["l_shipdate", "l_linenumber"]).select("l_partkey", "l_shipdate", "l_linenumber", "l_orderkey", "l_suppkey")


@query("j8_explicit_or_latest", """
with h as (select o_custkey as key, o_orderkey as version, o_totalprice as price, o_orderdate from orders),
req as (select l_orderkey, l_linenumber, l_partkey, l_suppkey as key, case when l_returnflag = 'A' then l_orderkey end as version from lineitem),
n as (select key, max_by(version, (o_orderdate, version)) as v, max_by(price, (o_orderdate, version)) as price from h group by 1)
select l_orderkey, l_linenumber, l_partkey, req.key, req.version, h.price, 'explicit' as branch from req left join h using (key, version)
  where req.version is not null
union all select l_orderkey, l_linenumber, l_partkey, req.key, n.v, n.price, 'latest' from req left join n using (key) where req.version is null""")
def explicit_or_latest(t):
    h = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"),
                        F.col("o_totalprice").alias("price"), "o_orderdate")
    req = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("key"),
                            F.when(F.col("l_returnflag") == "A", F.col("l_orderkey")).alias("version"))
    return rev.explicit_or_latest(req, h, "key", "version", ["o_orderdate", "version"], ["price"])


@query("j9_dependency_closure", """
with link as (select s_suppkey from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'),
eq as (select distinct l_partkey from lineitem where l_suppkey in (select s_suppkey from link)
  union select distinct l_partkey from lineitem where l_returnflag = 'R' and l_quantity = 50),
u as (select distinct l_orderkey from lineitem where l_partkey in (select l_partkey from eq))
select 'equation' as level, count(*) as n from eq union all select 'unit', count(*) from u
union all select 'connection point', count(distinct o_custkey) from orders where o_orderkey in (select l_orderkey from u)
union all select 'not needed', count(*) from part where p_partkey not in (select l_partkey from eq)""")
def dependency_closure(t):
    li = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    link = t.supplier.join(t.nation.join(t.region.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")),
                           F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select(F.col("s_suppkey").alias("l_suppkey"))
    seen = li.filter("l_returnflag = 'R' and l_quantity = 50").select("l_partkey")
    eq = li.join(link, "l_suppkey", "left_semi").select("l_partkey").union(seen).distinct()
    unit = li.join(eq, "l_partkey", "left_semi").select("l_orderkey").distinct()
    cp = t.orders.join(unit, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_custkey").distinct()
    rest = t.part.join(eq, F.col("p_partkey") == F.col("l_partkey"), "left_anti")

    def level(name, d):
        return d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("level"), "n")
    return level("equation", eq).union(level("unit", unit)).union(level("connection point", cp)).union(level("not needed", rest))


@query("j10_interval_overlap", f"""
with {SPELLS} select l_orderkey, l_linenumber, l_partkey, key, count(*) as episodes, min(o_orderkey) as first_episode
from spells join orders on o_custkey = key and s < o_orderdate + interval 4 days and e > o_orderdate - interval 1 day
group by 1, 2, 3, 4""")
def interval_overlap(t):
    day = F.expr("interval 1 day")
    ep = t.orders.select(F.col("o_custkey").alias("key"), "o_orderkey", (F.col("o_orderdate") - day).alias("a"),
                         (F.col("o_orderdate") + F.expr("interval 4 days")).alias("b"))
    return lk.overlapping(spells(t), ep, ["key"], ("s", "e"), ("a", "b"), hours=24 * 30).groupBy(
        "l_orderkey", "l_linenumber", "l_partkey", "key").agg(F.count(F.lit(1)).alias("episodes"), F.min("o_orderkey").alias("first_episode"))


@query("j11_point_in_interval", f"""
with {SPELLS} select o_orderkey, o_custkey as key, (exists (select 1 from spells where spells.key = o_custkey
  and o_orderdate between s and e))::int as covered from orders""")
def point_in_interval(t):
    points = t.orders.select("o_orderkey", F.col("o_custkey").alias("key"), "o_orderdate")
    return lk.covered(points, spells(t), ["key"], "o_orderdate", "s", "e", gap="0 seconds", hours=24 * 365).drop("o_orderdate")


@query("j12_booking_candidates", f"""
with b as (select equipment as outage_id, equipment % 25 as equipment, issue, received, start, "end", status, outage_id as rev from {BOOK}),
req as (select unnest(generate_series(timestamp '1995-02-01', timestamp '2001-07-01', interval 30 days)) as origin),
k as (select origin, b.*, row_number() over (partition by origin, outage_id order by issue desc, rev desc) as rn
  from req join b on issue <= origin and received <= origin),
c as (select * from k where rn = 1 and status <> 'cancelled' and start < origin + interval 15 days and "end" > origin + interval 15 days - interval 30 minutes),
l as (select s_suppkey as cid, s_nationkey as equipment, timestamp '1995-01-01' + to_days((s_suppkey * 20 % 2000)::int) as ef from supplier)
select origin, cid, count(*) as outages, min(outage_id) as first_outage from c join l using (equipment)
where ef - interval 30 days <= origin and ef <= origin + interval 15 days and ef + interval 1500 days > origin + interval 15 days group by 1, 2""")
def booking_candidates(t):
    b = bookings(t).select(F.col("equipment").alias("outage_id"), (F.col("equipment") % 25).alias("equipment"), "issue",
                           "received", "start", F.col("end").alias("finish"), "status", F.col("outage_id").alias("rev"))
    known = lk.known_intervals(b, "outage_id", ["issue", "received"], ["issue", "rev"],
                               ["equipment", "start", "finish", "status"], hours=24 * 365)
    req = t.spark.range(1).select(F.explode(F.sequence(ts("1995-02-01"), ts("2001-07-01"), F.expr("interval 30 days"))).alias("origin")
                                  ).withColumn("delivery", F.col("origin") + F.expr("interval 15 days"))
    live = known.filter("status <> 'cancelled'").withColumn("until", F.col("finish") + F.expr("interval 30 minutes"))
    hit = lk.points_in_intervals(req, live, [], "delivery", "start", "until", hours=24 * 15, right_open=True)
    hit = hit.filter((F.col("start") < F.col("delivery")) & (F.col("known_from") <= F.col("origin")) & (
        F.col("known_to").isNull() | (F.col("known_to") > F.col("origin"))))
    ef = ts("1995-01-01") + F.make_dt_interval(days=(F.col("s_suppkey") * 20 % 2000).cast("int"))
    links = t.supplier.select(F.col("s_suppkey").alias("cid"), F.col("s_nationkey").alias("equipment"), ef.alias("ef"))
    ok = ((F.col("ef") - F.expr("interval 30 days") <= F.col("origin")) & (F.col("ef") <= F.col("delivery"))
          & (F.col("ef") + F.expr("interval 1500 days") > F.col("delivery")))
    per = hit.groupBy("origin", "delivery", "equipment").agg(F.count(F.lit(1)).alias("n"), F.min("outage_id").alias("first"))
    return per.join(links, "equipment").filter(ok).groupBy("origin", "cid").agg(
        F.sum("n").alias("outages"), F.min("first").alias("first_outage"))


@query("j13_pairwise_overlap", """
with b as (select o_orderkey as id, o_custkey as key, o_orderdate as s, o_orderdate + interval 60 days as e from orders)
select a.id, count(*) as overlaps, string_agg(b.id::varchar, '|' order by b.id) as with_ids
from b a join b on a.key = b.key and a.s < b.e and a.e > b.s and a.id <> b.id group by 1""")
def pairwise_overlap(t):
    s = F.col("o_orderdate")
    b = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"), s.alias("s"),
                        (s + F.expr("interval 60 days")).alias("e"))
    other = b.select(F.col("id").alias("other"), "key", F.col("s").alias("s2"), F.col("e").alias("e2"))
    d = lk.overlapping(b, other, ["key"], ("s", "e"), ("s2", "e2"), hours=24 * 60, extra=F.col("id") != F.col("other"))
    return d.groupBy("id").agg(F.count(F.lit(1)).alias("overlaps"),
                               F.array_join(F.array_sort(F.collect_list("other")), "|").alias("with_ids"))


@query("j15_spatial_nearest", """
with p as (select c_custkey, -44 + (c_acctbal * 37 % 2000) / 100 as lat, 130 + (c_custkey * 7.3::double) % 20 as lon from customer),
s as (select s_suppkey, -44 + (s_acctbal * 53 % 2000) / 100 as slat, 130 + (s_suppkey * 3.7::double) % 20 as slon from supplier),
d as (select c_custkey, s_suppkey, 12742 * asin(sqrt(sin(radians(slat - lat) / 2) * sin(radians(slat - lat) / 2) +
   cos(radians(lat)) * cos(radians(slat)) * sin(radians(slon - lon) / 2) * sin(radians(slon - lon) / 2))) as km from p, s)
select c_custkey, count(*) as sites, round(min(km), 4) as nearest_km, min_by(s_suppkey, km) as nearest from d where km <= 50 group by 1""")
def spatial_nearest(t):
    p = t.customer.select("c_custkey", ((F.col("c_acctbal") * 37 % 2000) / 100 - 44).alias("lat"),
                          (F.col("c_custkey") * F.lit(7.3) % 20 + 130).alias("lon"))
    s = t.supplier.select("s_suppkey", ((F.col("s_acctbal") * 53 % 2000) / 100 - 44).alias("slat"),
                          (F.col("s_suppkey") * F.lit(3.7) % 20 + 130).alias("slon"))
    return lk.nearest_within(p, s, "lat", "lon", "slat", "slon", 50.0).groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("sites"), r6(F.min("km"), 4).alias("nearest_km"), F.min_by("s_suppkey", F.struct("km", "s_suppkey")).alias("nearest"))


@query("j15_nearest_place", """
with p as (select c_custkey, -44 + (c_acctbal * 37 % 2000) / 100 as lat, 130 + (c_custkey * 7.3::double) % 20 as lon from customer),
s as (select s_name, 'area ' || s_nationkey % 4 as r, -44 + (s_acctbal * 53 % 2000) / 100 as slat, 130 + (s_suppkey * 3.7::double) % 20 as slon from supplier),
d as (select p.*, s.*, 12742 * asin(sqrt(least(1, sin(radians(slat - lat) / 2) * sin(radians(slat - lat) / 2) + cos(radians(lat)) * cos(radians(slat)) * sin(radians(slon - lon) / 2) * sin(radians(slon - lon) / 2)))) as km from p, s),
b as (select *, floor(((degrees(atan2((lon - slon) * cos(radians(slat)), lat - slat)) + 360 + 22.5) % 360) / 45)::int + 1 as o from d qualify row_number() over (partition by c_custkey order by km, s_name) = 1),
n as (select *, ['north', 'north-east', 'east', 'south-east', 'south', 'south-west', 'west', 'north-west'][o] as w from b)
select c_custkey, s_name as place, round(km, 4) as km, case when km >= 15 then r || ':' || w || ' ' || s_name else r || ':' || s_name end as area from n""")
def nearest_place(t):
    p = t.customer.select("c_custkey", ((F.col("c_acctbal") * 37 % 2000) / 100 - 44).alias("lat"), (F.col("c_custkey") * F.lit(7.3) % 20 + 130).alias("lon"))
    s = t.supplier.select("s_name", F.concat(F.lit("area "), F.col("s_nationkey") % 4).alias("r"), ((F.col("s_acctbal") * 53 % 2000) / 100 - 44).alias("slat"), (F.col("s_suppkey") * F.lit(3.7) % 20 + 130).alias("slon"))
    return lk.nearest_place(p, s, "c_custkey", "lat", "lon", "s_name", "slat", "slon", "r").select("c_custkey", "place", r6("km", 4).alias("km"), "area")


@query("j16_name_crosswalk", """
with pts as (select p_partkey as id, p_name as norm, p_size % 5 as region, p_brand, -30 + (p_retailprice % 7) / 10 as lat, 150.0::double as lon from part),
best as (select norm, region, min_by(id, (p_brand, id)) as bid, min_by(lat, (p_brand, id)) as blat from pts group by 1, 2),
sp as (select norm, region, any_value(bid) as bid, any_value(blat) as blat, max(12742 * asin(sqrt(sin(radians(lat - blat) / 2) * sin(radians(lat - blat) / 2)))) as spread
  from pts join best using (norm, region) group by 1, 2)
select s.p_partkey, case when spread <= 10 then 'name_match' else 'unmatched' end as method, case when spread <= 10 then bid end as match_id,
  case when spread <= 10 then round(blat, 6) end as match_lat
from (select p_partkey, split_part(p_name, ' ', 1) || ' ' || split_part(p_name, ' ', 2) as norm, p_partkey % 5 as region from part) s left join sp using (norm, region)""")
def name_crosswalk(t):
    pts = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("norm"), (F.col("p_size") % 5).alias("region"),
                        "p_brand", ((F.col("p_retailprice") % 7) / 10 - 30).alias("lat"), F.lit(150.0).alias("lon"))
    left = t.part.select("p_partkey", F.col("p_name").alias("norm"), (F.col("p_partkey") % 5).alias("region"))
    return lk.name_match(left, pts, ["norm", "region"], ["p_brand", "id"], "lat", "lon", "id", 10.0).select(
        "p_partkey", "method", "match_id", r6("match_lat").alias("match_lat"))


@query("j17_attach_actuals", """
with a as (select o_custkey as key, o_orderdate as delivery, o_totalprice as actual, o_orderkey as revision_id,
    o_orderdate + to_days((o_orderkey % 30)::int) as received from orders),
n as (select *, row_number() over (partition by key, delivery order by received desc, revision_id desc) as rn from a where received <= '2000-01-01')
select l_orderkey, l_linenumber, l_partkey, l_suppkey as key, l_quantity as forecast, actual, revision_id
from lineitem left join (select * from n where rn = 1) n on n.key = l_suppkey and n.delivery = l_shipdate""")
def attach_actuals(t):
    a = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("delivery"), F.col("o_totalprice").alias("actual"),
                        F.col("o_orderkey").alias("revision_id"),
                        (F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 30).cast("int"))).alias("received"))
    n = lk.asof_revision(a, ["key", "delivery"], ts("2000-01-01"), ["received"], ["received", "revision_id"]).drop("received")
    f = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("key"),
                          F.col("l_shipdate").alias("delivery"), F.col("l_quantity").alias("forecast"))
    return f.join(n, ["key", "delivery"], "left").drop("delivery")


VINTAGE = """ext as (select *, row_number() over (partition by key, origin, time order by issue desc, event_id desc) as rn from (
  select event_id, event_type as key, ts as issue, value, time_bucket(interval '30 minutes', ts + interval 1 minute - interval 1 microsecond) + interval 30 minutes as origin,
    time_bucket(interval '30 minutes', ts - interval 1 microsecond) + to_minutes((30 * (user_id % 5))::int) as time from events) where time > origin),
ours as (select event_type as key, time_bucket(interval '30 minutes', ts - interval 1 microsecond) + interval 30 minutes as origin,
    time_bucket(interval '30 minutes', ts - interval 1 microsecond) + to_minutes((30 + 30 * (user_id % 5))::int) as time, round(sum(value), 2) as own from events group by 1, 2, 3)"""


def vintage(t):
    half = F.expr("interval 30 minutes")
    end = cal.interval_ceiling(F.col("ts"))
    ext = t.events.select(
        "event_id", F.col("event_type").alias("key"), F.col("ts").alias("issue"), F.col("value").alias("theirs"),
        cal.interval_ceiling(F.col("ts") + F.expr("interval 1 minute")).alias("origin"),
        (end - half + F.make_dt_interval(mins=(F.col("user_id") % 5 * 30).cast("int"))).alias("time")).filter("time > origin")
    ext = rev.latest(ext, ["key", "origin", "time"], ["issue", "event_id"]).drop("event_id", "issue")
    ours = t.events.groupBy(F.col("event_type").alias("key"), end.alias("origin"),
                            (end + F.make_dt_interval(mins=(F.col("user_id") % 5 * 30).cast("int"))).alias("time")).agg(
        r6(F.sum("value"), 2).alias("own"))
    return ours.join(ext, ["key", "origin", "time"])


@query("j18_benchmark_vintage_match", f"""with {VINTAGE}
select key, origin, time, own, ext.value as theirs from ours join ext using (key, origin, time) where rn = 1""")
def benchmark_vintage_match(t):
    return vintage(t)


@query("j19_outer_reconcile", """
with a as (select l_suppkey as k, date_trunc('month', l_shipdate) as m, sum(l_quantity) as q, count(*) as n from lineitem where l_returnflag <> 'A' group by 1, 2),
b as (select l_suppkey as k, date_trunc('month', l_shipdate) as m, sum(l_quantity) as q, count(*) as n from lineitem where l_linestatus = 'O' group by 1, 2)
select case when b.k is null then 'left only' when a.k is null then 'right only' when abs(a.q - b.q) <= 1 and a.n = b.n then 'equal' else 'different' end as status,
  count(*) as cells, round(sum(coalesce(a.q, 0) - coalesce(b.q, 0)), 2) as gap from a full join b on a.k = b.k and a.m = b.m group by 1""")
def outer_reconcile(t):
    def build(cond):
        return t.lineitem.filter(cond).groupBy("l_suppkey", cal.month_start(F.col("l_shipdate")).alias("m")).agg(
            F.sum("l_quantity").alias("q"), F.count(F.lit(1)).cast("double").alias("n"))
    d = lk.reconcile(build("l_returnflag <> 'A'").withColumn("n", F.col("n") * 10),
                     build("l_linestatus = 'O'").withColumn("n", F.col("n") * 10), ["l_suppkey", "m"], ["q", "n"], 1.0)
    return d.groupBy("status").agg(F.count(F.lit(1)).alias("cells"), r6(F.sum(
        F.coalesce("a_q", F.lit(0.0)) - F.coalesce("b_q", F.lit(0.0))), 2).alias("gap"))


@query("j20_validity_at_start", """
with v as (select o_custkey as key, o_orderdate as vs, o_orderdate + interval 100 days as ve, o_orderkey as version from orders),
h as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, max_by(version, (vs, version)) as version
  from lineitem join v on key = l_suppkey and vs <= l_shipdate and ve > l_shipdate group by 1, 2, 3, 4),
n as (select key, max_by(version, (vs, version)) as version from v group by 1)
select distinct l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey as key, case when h.version is not null then 'valid' when n.version is not null then 'latest' end as method,
  coalesce(h.version, n.version) as version from lineitem l left join h using (l_orderkey, l_linenumber, l_partkey, l_suppkey) left join n on n.key = l.l_suppkey""")
def validity_at_start(t):
    v = t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("vs"),
                        (F.col("o_orderdate") + F.expr("interval 100 days")).alias("ve"), F.col("o_orderkey").alias("version"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("key"), "l_shipdate")
    return lk.valid_else_latest(rows, v, "key", "l_shipdate", "vs", "ve", ["l_orderkey", "l_linenumber", "l_partkey", "key"],
                                ["version"]).drop("l_shipdate").distinct()


CHAIN = """link as (select o_orderkey as id, case when o_orderkey > 0 and o_orderkey % 3 = 0 and o_orderkey * 2 in (select o_orderkey from orders)
  then o_orderkey * 2 end as nxt from orders)"""


def chain(t):
    o = t.orders.select(F.col("o_orderkey").alias("id"))
    ids = o.select(F.col("id").alias("nxt"))
    want = F.when((F.col("id") > 0) & (F.col("id") % 3 == 0), F.col("id") * 2)
    return o.withColumn("nxt", want).join(ids.withColumn("there", F.lit(1)), "nxt", "left").select(
        "id", F.when(F.col("there").isNotNull(), F.col("nxt")).alias("nxt"))


@query("j21_successor_chain", f"""
with recursive {CHAIN}, walk as (select id, id as fin, nxt from link union all
  select walk.id, link.id, link.nxt from walk join link on walk.nxt = link.id)
select id, fin as final_id from walk where nxt is null""")
def successor_chain(t):
    return lk.final_of_chain(chain(t), "id", "nxt").select("id", "final_id")
