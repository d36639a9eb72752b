"""Projection, filter, cleaning and normalisation on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import cleaning as op
from ..operators import revisions as rev
from .registry import query


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


@query("p1_safe_numeric", """
select p_partkey, try_cast(replace(p_brand, 'Brand#', '') as double) as brand_no,
       try_cast(p_type as double) as type_no from part""")
def safe_numeric(t):
    d = t.part.select("p_partkey", F.regexp_replace("p_brand", "Brand#", "").alias("brand_no"),
                      F.col("p_type").alias("type_no"))
    return op.safe_numeric(d, ["brand_no", "type_no"])


RUN = "cast(l_returnflag = 'R' as int)"


@query("p2_run_selection", f"""
select l_partkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice from (
  select *, row_number() over (partition by l_partkey, l_shipdate order by {RUN} desc, l_linenumber desc,
    l_orderkey desc, l_extendedprice desc, l_suppkey desc) rn from lineitem) where rn = 1""")
def run_selection(t):
    d = t.lineitem.withColumns({"intervention": (F.col("l_returnflag") == "R").cast("int"),
                                "tie": F.struct("l_extendedprice", "l_suppkey")})
    return op_latest(d)


def op_latest(d):
    return rev.run_selection(d, ["l_partkey", "l_shipdate"], "intervention", "l_linenumber", "l_orderkey", "tie"
                             ).select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("p2_pricing_run", f"""
select l_partkey, l_shipdate, l_orderkey, l_linenumber, l_extendedprice from (
  select *, row_number() over (partition by l_partkey, l_shipdate order by l_linenumber desc,
    l_orderkey desc, l_extendedprice desc, l_suppkey desc) rn from lineitem where {RUN} = 0) where rn = 1""")
def pricing_run(t):
    d = t.lineitem.withColumns({"intervention": (F.col("l_returnflag") == "R").cast("int"),
                                "tie": F.struct("l_extendedprice", "l_suppkey")})
    return rev.run_selection(d, ["l_partkey", "l_shipdate"], "intervention", "l_linenumber", "l_orderkey", "tie",
                             pricing=True).select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber",
                                                  "l_extendedprice")


@query("p3_ranked_source_dedup", """
select user_id, hour, event_id, event_type from (
  select *, date_trunc('hour', ts) as hour, row_number() over (partition by user_id, date_trunc('hour', ts)
    order by (event_type = 'purchase')::int desc, ts desc, event_id desc) rn from events) where rn = 1""")
def ranked_source_dedup(t):
    d = t.events.withColumn("hour", cal.floor_time(F.col("ts"), 3600))
    return rev.latest(d, ["user_id", "hour"], [(F.col("event_type") == "purchase").cast("int"), "ts", "event_id"]
                      ).select("user_id", "hour", "event_id", "event_type")


@query("p4_conflict_count", """
select l_partkey, l_shipdate, count(*) as n_rows from lineitem group by 1, 2
having count(distinct l_extendedprice) > 1 or count(distinct l_discount) > 1""")
def conflict_count(t):
    return rev.conflict_count(t.lineitem, ["l_partkey", "l_shipdate"], ["l_extendedprice", "l_discount"])


LINK = """(select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity * 10 - 250 as mwflow,
  l_extendedprice / 100 as exportlimit, -(l_extendedprice / 100 - l_quantity * 20 + 100) as importlimit from lineitem)"""


def link_rows(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        (F.col("l_quantity") * 10 - 250).alias("mwflow"), (F.col("l_extendedprice") / 100).alias("exportlimit"),
        (-(F.col("l_extendedprice") / 100 - F.col("l_quantity") * 20 + 100)).alias("importlimit"))


@query("p5_signed_directional", f"""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, mwflow as flow, round(exportlimit, 4) as export,
  round(-importlimit, 4) as "import" from {LINK}""")
def signed_directional(t):
    return op.signed_directional(link_rows(t), "mwflow", "exportlimit", "importlimit").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "flow", _r("export", 4).alias("export"),
        _r("import", 4).alias("import"))


@query("p6_directional_explode", f"""
with b as (select *, exportlimit as export, -importlimit as imp from {LINK}),
d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'forward' direction, mwflow as f, export as c,
        l_suppkey % 5 as source, l_partkey % 5 as sink from b
      union all select l_orderkey, l_linenumber, l_partkey, l_suppkey, 'reverse', -mwflow, imp, l_partkey % 5, l_suppkey % 5 from b)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, direction, f as directional_flow, round(c, 4) as capacity,
  round(c - f, 4) as headroom, case when c > 0 and f > 0 then round(f / c, 6) end as utilization,
  (c < 0)::int as forced_direction, source, sink from d""")
def directional_explode(t):
    d = op.signed_directional(link_rows(t), "mwflow", "exportlimit", "importlimit").withColumns(
        {"export_tight": F.col("export"), "import_tight": F.col("import"), "a": F.col("l_suppkey") % 5,
         "b": F.col("l_partkey") % 5})
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    d = op.directional_rows(d, "a", "b", keep)
    return d.select(*keep, "direction", "directional_flow", _r("capacity", 4).alias("capacity"),
                    _r("headroom", 4).alias("headroom"), _r("utilization").alias("utilization"),
                    "forced_direction", "source", "sink")


@query("p7_interval_ceiling", """
select event_id, time_bucket(interval '30 minutes', ts - interval 1 microsecond) + interval 30 minutes as time30
from events""")
def interval_ceiling(t):
    return t.events.select("event_id", cal.interval_ceiling(F.col("ts")).alias("time30"))


@query("p8_interval_label_shift", """
select event_id, time_bucket(interval '5 minutes', ts) + interval 5 minutes as delivery from events""")
def interval_label_shift(t):
    return t.events.select("event_id", (cal.floor_time(F.col("ts"), 300) + F.expr("interval 5 minutes")).alias("delivery"))


FORECAST = """(select l_orderkey, o_orderdate as issue, o_orderdate + to_hours(l_linenumber::int) as received,
  l_shipdate as delivery, l_returnflag as region, l_linestatus as variable, l_linenumber as member,
  l_suppkey, l_partkey, l_quantity as value
  from lineitem join orders on l_orderkey = o_orderkey)"""


def forecast_rows(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", F.col("o_orderdate").alias("issue"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=F.col("l_linenumber"))).alias("received"),
        F.col("l_shipdate").alias("delivery"), F.col("l_returnflag").alias("region"),
        F.col("l_linestatus").alias("variable"), F.col("l_linenumber").alias("member"), "l_suppkey", "l_partkey",
        F.col("l_quantity").alias("value"))


@query("p9_provider_normalise", f"""
with f as (select * from {FORECAST}), d as (select issue, max(received) as done from f group by 1)
select l_orderkey, l_partkey, l_suppkey, member, f.issue, received, done as receipt_completed,
  delivery + interval 30 minutes as delivery,
  case region when 'A' then 'NSW1' when 'N' then 'VIC1' else region end as region,
  case variable when 'O' then 'demand' else 'temperature' end as variable,
  round(case variable when 'O' then value * 1000 else value - 273.15 end, 4) as value, 'provider' as source
from f join d using (issue)""")
def provider_normalise(t):
    units = t.spark.createDataFrame([("demand", 1000.0, 0.0), ("temperature", 1.0, -273.15)],
                                    "variable string, factor double, offset double")
    d = op.provider_normalise(forecast_rows(t), {"A": "NSW1", "N": "VIC1"}, {"O": "demand", "F": "temperature"},
                              units, source="provider", label="start")
    return d.select("l_orderkey", "l_partkey", "l_suppkey", "member", "issue", "received", "receipt_completed",
                    "delivery", "region", "variable", _r("value", 4).alias("value"), "source")


@query("p9_duplicate_check", """
select o_custkey, o_orderdate, count(*) as copies from orders group by 1, 2 having count(*) > 1""")
def duplicate_check(t):
    return op.duplicate_keys(t.orders, ["o_custkey", "o_orderdate"])


@query("p10_scenario_override", """
select o_orderkey, o_custkey, coalesce(c_acctbal, o_totalprice) as value,
  case when c_acctbal is not null then 'drought' end as assumption
from orders left join (select * from customer where c_mktsegment = 'MACHINERY') on o_custkey = c_custkey""")
def scenario_override(t):
    base = t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("value"))
    over = t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"),
                                                                 F.col("c_acctbal").alias("value"))
    return op.scenario_override(base, over, ["o_custkey"], "value", "drought")


@query("p10_unmatched_override", """
select c_custkey as o_custkey, c_acctbal from customer where c_custkey not in (
  select o_custkey from orders where o_orderstatus = 'P')""")
def unmatched_override(t):
    over = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return op.unmatched_overrides(t.orders.filter("o_orderstatus = 'P'"), over, ["o_custkey"])


BOOK = """(select o_orderkey as outage_id, o_custkey as equipment, o_orderdate as issue, o_orderdate as received,
  o_orderdate + to_days(10) as start, o_orderdate + to_days((10 + o_orderkey % 20)::int) as "end",
  case o_orderstatus when 'P' then 'planned' when 'F' then 'completed' else 'cancelled' end as status from orders)"""


def bookings(t):
    d = F.col("o_orderdate")
    return t.orders.select(
        F.col("o_orderkey").alias("outage_id"), F.col("o_custkey").alias("equipment"), d.alias("issue"),
        d.alias("received"), (d + F.expr("interval 10 days")).alias("start"),
        (d + F.make_dt_interval(days=(F.lit(10) + F.col("o_orderkey") % 20).cast("int"))).alias("end"),
        F.when(F.col("o_orderstatus") == "P", "planned").when(F.col("o_orderstatus") == "F", "completed")
        .otherwise("cancelled").alias("status"))


@query("p11_outage_edits", f"""
with b as (select * from {BOOK}), m as (select max(outage_id) + 1 as nx from b)
select outage_id, equipment, issue, received, start,
  case when outage_id % 7 = 1 then "end" + interval 2 days else "end" end as "end",
  case when outage_id % 7 = 1 then 'extended' else status end as status, 'local' as scenario
from b where outage_id % 7 <> 0
union all
select outage_id + nx, equipment, timestamp '2002-01-01', timestamp '2002-01-01', start, "end", status, 'local'
from b, m where outage_id % 7 = 2""")
def outage_edits(t):
    b = bookings(t)
    nx = b.agg((F.max("outage_id") + 1).alias("nx"))
    cancel = b.filter("outage_id % 7 = 0").select(F.lit("cancel").alias("action"), "outage_id")
    change = b.filter("outage_id % 7 = 1").select(
        F.lit("update").alias("action"), "outage_id", F.lit(None).cast("timestamp_ntz").alias("start"),
        (F.col("end") + F.expr("interval 2 days")).alias("end"), F.lit("extended").alias("status"))
    add = (b.filter("outage_id % 7 = 2").join(F.broadcast(nx)).select(
        F.lit("add").alias("action"), (F.col("outage_id") + F.col("nx")).alias("outage_id"), "equipment", "start",
        "end", "status"))
    edits = cancel.unionByName(change, True).unionByName(add, True)
    return op.outage_edits(b, edits, F.lit("2002-01-01").cast("timestamp_ntz"), "local").select(
        "outage_id", "equipment", "issue", "received", "start", "end", "status", "scenario")


@query("p12_outage_scenarios", f"""
with b as (select * from {BOOK} where status <> 'cancelled')
select outage_id, 'baseline' as scenario, status, "end" from b
union all select outage_id, 'no_planned_outages', status, "end" from b where status <> 'planned'
union all select outage_id, 'planned_extended_24h', status,
  case when status = 'planned' then "end" + interval 24 hours else "end" end from b""")
def outage_scenarios(t):
    return op.outage_scenarios(bookings(t), 24).select("outage_id", "scenario", "status", "end")


@query("p13_canonical_inequality", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, '<=' as kind,
  case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end as rhs,
  round(case when l_returnflag = 'R' then -(l_discount - l_tax) else l_discount - l_tax end, 6) as factor
from lineitem""")
def canonical_inequality(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                          F.when(F.col("l_returnflag") == "R", ">=").otherwise("<=").alias("kind"),
                          F.col("l_extendedprice").alias("rhs"), (F.col("l_discount") - F.col("l_tax")).alias("factor"))
    d = op.canonical_inequality(d, "kind", "rhs", "factor")
    return d.withColumn("factor", _r("factor") + F.lit(0.0))


FLAG = "case when event_type = 'error' then null else json_extract(props, '$.k')::int % 32 end"


def flags(t):
    k = F.get_json_object("props", "$.k").cast("int") % 32
    return t.events.select("event_id", "value", F.when(F.col("event_type") != "error", k).alias("flags"),
                           (F.col("event_type") == "view").cast("int").alias("suspended"))


@query("p14_price_regime_flag", f"""
select event_id, (f is not null and (f & 11) = 0 and not s)::int as ordinary from (
  select event_id, {FLAG} as f, event_type = 'view' as s from events)""")
def price_regime_flag(t):
    return flags(t).select("event_id", op.ordinary_price(F.col("flags"), F.col("suspended")).cast("int").alias("ordinary"))


@query("p15_flag_bits", f"""
select event_id, (f & 1) as b0, ((f >> 1) & 1) as b1, ((f >> 2) & 1) as b2, ((f >> 3) & 1) as b3,
  ((f >> 4) & 1) as b4 from (select event_id, {FLAG} as f from events)""")
def flag_bits(t):
    return op.flag_bits(flags(t).select("event_id", "flags"), "flags", ["b0", "b1", "b2", "b3", "b4"]).drop("flags")


@query("p16_dated_step_value", """
select o_orderkey, case when o_orderdate >= '1999-07-01' then 23200.0::double when o_orderdate >= '1997-07-01'
  then 20300.0 else 17500.0 end as cap from orders""")
def dated_step_value(t):
    steps = [("1990-01-01", 17500), ("1997-07-01", 20300), ("1999-07-01", 23200)]
    return t.orders.select("o_orderkey", op.dated_step(F.col("o_orderdate"), steps).alias("cap"))


@query("p17_structural_era", """
select o_orderkey, coalesce(case when o_orderpriority = '1-URGENT' and o_orderdate < '1998-01-01' then 'before upgrade'
  when o_orderpriority = '1-URGENT' then 'after upgrade'
  when o_orderpriority = '2-HIGH' and o_orderdate >= '1997-01-01' and o_orderdate < '1999-01-01' then 'commissioning' end,
  'all') as era from orders""")
def structural_era(t):
    eras = t.spark.createDataFrame(
        [("1-URGENT", "before upgrade", "1900-01-01", "1998-01-01"), ("1-URGENT", "after upgrade", "1998-01-01", None),
         ("2-HIGH", "commissioning", "1997-01-01", "1999-01-01")],
        "o_orderpriority string, era string, era_from string, era_to string").withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("era_from", "era_to")})
    return op.era_label(t.orders, eras, "o_orderpriority", "o_orderdate").select("o_orderkey", "era")


@query("p18_status_exclusion", """
with b as (select o_orderkey as id, case when o_orderkey % 3 = 0 then o_orderkey * 2 end as nxt,
  case o_orderstatus when 'P' then 'wdrawn ' else 'OK' end as status from orders)
select id, status from b where upper(trim(status)) <> 'WDRAWN' and (nxt is null or nxt not in (select id from b))""")
def status_exclusion(t):
    b = t.orders.select(F.col("o_orderkey").alias("id"),
                        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") * 2).alias("nxt"),
                        F.when(F.col("o_orderstatus") == "P", "wdrawn ").otherwise("OK").alias("status"))
    return op.live_bookings(b, "id", "status", "nxt", ["WDRAWN", "WD REQ", "CANCELLED", "CANCEL"]).select("id", "status")


@query("p19_residual_demand", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(l_extendedprice - l_extendedprice * l_discount - l_extendedprice * l_tax, 4) as residual_demand from lineitem""")
def residual_demand(t):
    p = F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r(op.residual_demand(
        p, p * F.col("l_discount"), p * F.col("l_tax")), 4).alias("residual_demand"))
