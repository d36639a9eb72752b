"""Scalar functions on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import maths, text
from .registry import normal_cdf_sql, query


def _r(c, n=6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


SEASON = "cast(floor((month(o_orderdate) % 12) / 3) as int)"
NAMES = "['Summer','Autumn','Winter','Spring']"


@query("q1_season", f"""
select o_orderkey, {SEASON} as season, {NAMES}[{SEASON} + 1] as season_name,
  case when {SEASON} = 0 then 'Summer ' || (year(o_orderdate) + (month(o_orderdate) = 12)::int - 1) || '–' ||
    right(cast(year(o_orderdate) + (month(o_orderdate) = 12)::int as varchar), 2)
  else {NAMES}[{SEASON} + 1] || ' ' || year(o_orderdate) end as block,
  year(o_orderdate) || ' Q' || quarter(o_orderdate) as cq,
  (date_trunc('quarter', o_orderdate) >= timestamp '1995-02-01' and
   date_trunc('quarter', o_orderdate) + interval 3 months - interval 5 minutes <= timestamp '2001-05-31')::int as complete
from orders""")
def season(t):
    d = F.col("o_orderdate")
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return t.orders.select("o_orderkey", cal.season(d).alias("season"), cal.season_name(d).alias("season_name"),
                           cal.season_block(d).alias("block"), cal.calendar_quarter(d).alias("cq"),
                           cal.complete_quarter(d, at("1995-02-01"), at("2001-05-31")).cast("int").alias("complete"))


@query("q2_quarter_of", """
select o_orderkey, year(b) || 'Q' || quarter(b) as q,
  date_diff('day', date_trunc('quarter', b), date_trunc('quarter', b) + interval 3 months) * 288 as intervals,
  'FY' || (year(o_orderdate) + (month(o_orderdate) >= 7)::int) as fy
from (select *, o_orderdate - interval 1 microsecond as b from orders)""")
def quarter_of(t):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", cal.quarter_of(d).alias("q"), cal.quarter_intervals(d).alias("intervals"),
                           cal.financial_year(d).alias("fy"))


@query("q3_cyclic_terms", """
select event_id, round(sin(2*pi()*(hour(ts)+minute(ts)/60)/24), 6) as hour_sin,
  round(cos(2*pi()*(hour(ts)+minute(ts)/60)/24), 6) as hour_cos, round(sin(2*pi()*dayofyear(ts)/365.25), 6) as year_sin,
  round(cos(2*pi()*dayofyear(ts)/365.25), 6) as year_cos, isodow(ts) - 1 as weekday,
  round(date_diff('microsecond', timestamp '2024-01-01', ts) / 86400000000, 6) as trend_days from events""")
def cyclic_terms(t):
    terms = cal.cyclic_terms(F.col("ts"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return t.events.select("event_id", *[(c if n == "weekday" else _r(c)).alias(n) for n, c in terms.items()])


@query("q4_day_period", """
select event_id, case when hour(ts) < 6 or hour(ts) >= 21 then 'overnight' when hour(ts) < 10 then 'morning'
  when hour(ts) < 16 then 'midday' else 'evening' end as period,
  case when hour(ts) < 6 or hour(ts) >= 21 then 'night' when hour(ts) < 9 then 'early' when hour(ts) < 16 then 'day'
  else 'peak' end as report_period from events""")
def day_period(t):
    return t.events.select("event_id", cal.day_period(F.col("ts")).alias("period"), cal.day_period(
        F.col("ts"), (6, 9, 16, 21), ("night", "early", "day", "peak")).alias("report_period"))


@query("q5_slot_distance", """
with s as (select event_id, hour(ts) * 2 + (minute(ts) >= 30)::int as slot, user_id % 48 as wanted from events)
select event_id, slot, least(abs(slot - wanted), 48 - abs(slot - wanted)) as distance from s""")
def slot_distance(t):
    s = cal.slot(F.col("ts"))
    return t.events.select("event_id", s.alias("slot"), cal.slot_distance(s, F.col("user_id") % 48).alias("distance"))


@query("q6_parse_time", """
select o_orderkey, case when o_orderkey % 5 = 0 then timestamp '9999-12-31' when o_orderkey % 5 = 1 then null
  else o_orderdate end as parsed from orders""")
def parse_time(t):
    raw = (F.when(F.col("o_orderkey") % 5 == 0, F.lit("2999/01/01 00:00:00"))
           .when(F.col("o_orderkey") % 5 == 1, F.lit("not a time"))
           .otherwise(F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss")))
    return t.orders.select("o_orderkey", cal.parse_time(raw).alias("parsed"))


WORDS = "substation|sub|terminal|station|switching|switchyard|zone|bulk|supply|point|ts|zs|ss|s/s|kv|power|the|transmission|and"


@query("q7_station_name", rf"""
select p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(n),
  '\([^)]*\)', ' ', 'g'), '[0-9]+(\.[0-9]+)?\s*kv', ' ', 'g'), '\b({WORDS})\b', ' ', 'g'), '[^a-z ]', ' ', 'g'),
  ' +', ' ', 'g')) as norm
from (select p_partkey, p_name || ' ' || (p_size * 11) || ' kV Substation (' || p_brand || ')' as n from part)""")
def station_name(t):
    n = F.concat("p_name", F.lit(" "), (F.col("p_size") * 11).cast("string"), F.lit(" kV Substation ("), "p_brand", F.lit(")"))
    return t.part.select("p_partkey", text.station_name(n).alias("norm"))


@query("q8_equipment_type", """
select p_partkey, case p_partkey % 7 when 0 then 'LINE' when 1 then 'CB' when 2 then 'BUS' when 3 then 'TRANS'
  when 4 then 'REAC' when 5 then 'TRANS' else 'OTHER' end as kind from part""")
def equipment_type(t):
    tails = F.array(*[F.lit(s) for s in ("330kV line", "bus-breaker", "line BUSBAR", "No1 TFMR", "svc yard",
                                         "Line Cb tx", "")])
    d = F.concat("p_name", F.lit(" "), F.element_at(tails, (F.col("p_partkey") % 7 + 1).cast("int")))
    return t.part.select("p_partkey", text.equipment_type(d).alias("kind"))


IDS = "['V>>NIL_A', 'N^^V_OUT', 'NRM_SA1', '#RAMP-1', 'F_I+BIP', 'V::S_NIL', 'N<<Q', 'V-SML_NIL', 'q_lower', '']"


def equation_ids(t):
    ids = F.array(*[F.lit(s) for s in ("V>>NIL_A", "N^^V_OUT", "NRM_SA1", "#RAMP-1", "F_I+BIP", "V::S_NIL", "N<<Q",
                                      "V-SML_NIL", "q_lower", "")])
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount",
                             F.element_at(ids, (F.col("l_partkey") % 10 + 1).cast("int")).alias("cid"))


@query("q9_equation_family", f"""
select cid, family, state, count(*) as n from (select cid,
  case when cid = '' then 'unreported' when starts_with(cid, 'NRM') then 'negative residue management'
    when starts_with(cid, '#') then 'manual/ramp' when contains(cid, '>>') then 'thermal'
    when contains(cid, '^^') then 'voltage stability' when contains(cid, '::') then 'transient stability'
    when contains(cid, '<<') then 'oscillatory' when cid in ('F_I+BIP', 'V-SML_NIL') then 'interconnector limit'
    else 'other' end as family,
  case when cid = '' then 'unreported' when starts_with(cid, 'NRM') then 'system normal'
    when starts_with(cid, '#') then 'other' when contains(cid, 'NIL') then 'system normal' else 'outage/other' end as state
  from (select {IDS}[l_partkey % 10 + 1] as cid from lineitem)) group by 1, 2, 3""")
def equation_family(t):
    return equation_ids(t).select("cid", text.equation_family(F.col("cid")).alias("family"),
                                  text.network_state(F.col("cid")).alias("state")).groupBy(
        "cid", "family", "state").agg(F.count(F.lit(1)).alias("n"))


@query("q10_contract_parse", """
select o_orderkey, year(o_orderdate) || 'Q' || quarter(o_orderdate) as delivery_quarter,
  cast(o_orderkey % 12 + 1 as int) as tranche, '20' || lpad(cast(o_orderkey % 30 + 10 as varchar), 2, '0') || 'Q' || quarter(o_orderdate) as q1,
  year(o_orderdate) + 10 || 'Q' || quarter(o_orderdate) as q2,
  ['NSW1','VIC1','SA1','QLD1', NULL][o_custkey % 5 + 1] as region from orders""")
def contract_parse(t):
    q = F.quarter("o_orderdate").cast("string")
    y = F.year("o_orderdate")
    cid = F.concat(F.lit("IC-C"), y.cast("string"), F.lit("Q"), q, F.lit("T"),
                   F.lpad((F.col("o_orderkey") % 12 + 1).cast("string"), 2, "0"))
    short = F.concat(F.lit("Base q"), q, F.lit(" - "), (F.col("o_orderkey") % 30 + 10).cast("string"))
    long = F.concat((y + 10).cast("string"), F.lit(" Q"), q, F.lit(" flat"))
    names = F.array(*[F.lit(s) for s in ("nsw base", "Victoria futures", "South Australia cap", "price QLD", "Tasman")])
    return t.orders.select(
        "o_orderkey", text.contract_quarter(cid).alias("delivery_quarter"), text.contract_tranche(cid).alias("tranche"),
        text.quarter_in_text(short).alias("q1"),
        text.quarter_in_text(F.when(y < 2010, long).otherwise(long)).alias("q2"),
        text.region_in_text(F.element_at(names, (F.col("o_custkey") % 5 + 1).cast("int"))).alias("region"))


@query("q11_setter_class", f"""
select class, count(*) as n from (select case when l_suppkey % 10 = 0 then 'own_set' when starts_with(cid, '#')
  then 'ramp_discretionary' when starts_with(cid, 'F_') then 'fcas' when l_suppkey % 10 < 4 then 'other_outage_set'
  else 'system_normal_other' end as class from (select {IDS}[l_partkey % 10 + 1] as cid, l_suppkey from lineitem)) group by 1""")
def setter_class(t):
    s = F.col("l_suppkey") % 10
    return equation_ids(t).select(text.setter_class(F.col("cid"), s == 0, s < 4).alias("class")).groupBy(
        "class").agg(F.count(F.lit(1)).alias("n"))


@query("q12_leading_place", """
select p_partkey, p_name as place, cast(p_size * 11 as varchar) as kv from part""")
def leading_place(t):
    d = F.concat(F.lit(" "), "p_name", F.lit(" substation "), (F.col("p_size") * 11).cast("string"), F.lit("kV - bay"))
    return t.part.select("p_partkey", text.leading_place(d).alias("place"), text.named_voltage(d).alias("kv"))


@query("q13_bounds", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when abs(a) > 1e-9 then
  round(l_quantity + (l_extendedprice - l_extendedprice * 0.9) / a, 4) end as bound
from (select *, round(l_discount - l_tax, 2) as a from lineitem)""")
def bounds(t):
    a = _r(F.col("l_discount") - F.col("l_tax"), 2)
    b = maths.bound_from_solution(F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_extendedprice") * 0.9,
                                  F.when(F.abs(a) > 1e-9, a))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r(b, 4).alias("bound"))


@query("q14_bachelier", f"""with d as (select *, l_quantity - 25 as mu, l_extendedprice / 1000 as sd, (l_quantity - 25) / nullif(l_extendedprice / 1000, 0) as z from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when sd > 0 then sd * exp(-z * z / 2) / sqrt(2 * pi()) + mu * {normal_cdf_sql('z')} else greatest(mu, 0) end, 6) as value from d""")
def bachelier(t):
    """Expected positive part of a normal payoff; the tests also hold the fit against math.erf."""
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r(maths.bachelier_call(
        F.col("l_quantity") - 25, F.col("l_extendedprice") / 1000)).alias("value"))


@query("q15_haversine", """
with p as (select c_custkey, (c_acctbal % 20) - 40 as lat, 130 + c_custkey % 25 as lon from customer)
select c_custkey, round(12742 * asin(sqrt(sin(radians(-33.87 - lat) / 2) * sin(radians(-33.87 - lat) / 2) +
   cos(radians(lat)) * cos(radians(-33.87)) * sin(radians(151.21 - lon) / 2) * sin(radians(151.21 - lon) / 2))), 4) as km,
  ['north','north-east','east','south-east','south','south-west','west','north-west'][
   (floor((((degrees(atan2((lon - 151.21) * cos(radians(-33.87)), lat + 33.87)) + 360 + 22.5) % 360)) / 45)::int) + 1] as octant
from p""")
def haversine(t):
    lat, lon = F.col("c_acctbal") % 20 - 40, (F.col("c_custkey") % 25 + 130).cast("double")
    plat, plon = F.lit(-33.87), F.lit(151.21)
    return t.customer.select("c_custkey", _r(maths.great_circle_km(lat, lon, plat, plon), 4).alias("km"),
                             maths.octant(maths.bearing(lat, lon, plat, plon)).alias("octant"))


@query("q16_pinball_wis", """
with d as (select *, l_quantity as y, l_tax * 200 as lo, l_tax * 200 + l_discount * 300 as hi,
  l_tax * 200 + l_discount * 150 as md from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0.1 * (y - lo), -0.9 * (y - lo)), 4) as pinball,
  round(hi - lo + 10 * greatest(lo - y, 0) + 10 * greatest(y - hi, 0), 4) as interval_score,
  round((0.5 * abs(y - md) + 0.1 * (hi - lo + 10 * greatest(lo - y, 0) + 10 * greatest(y - hi, 0))) / 1.5, 4) as wis
from d""")
def pinball_wis(t):
    y, lo = F.col("l_quantity"), F.col("l_tax") * 200
    hi, md = lo + F.col("l_discount") * 300, lo + F.col("l_discount") * 150
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _r(maths.pinball(y, lo, 0.1), 4).alias("pinball"),
        _r(maths.interval_score(y, lo, hi, 0.2), 4).alias("interval_score"),
        _r(maths.weighted_interval_score(y, md, lo, hi, 0.2), 4).alias("wis"))


@query("q17_crps", """
with m as (select vec_id, unnest(embedding)::double as x from embeddings),
n as (select vec_id, row_number() over (partition by vec_id order by x) - 1 as i, x, count(*) over (partition by vec_id) as k from m)
select vec_id, round(avg(abs(x - label * 0.05)) - sum(x * (2 * i - k + 1)) / max(k * k), 6) as crps
from n join embeddings using (vec_id) group by vec_id, label""")
def crps(t):
    m = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", _r(maths.crps(m, F.col("label") * 0.05)).alias("crps"))


@query("q18_lead_band", """
select o_orderkey, case when h <= 12 then '0-6 h' when h <= 48 then '6-24 h' when h <= 144 then 'days 2-3'
  else 'days 4-7' end as band from (select o_orderkey, o_orderkey % 337 as h from orders)""")
def lead_band(t):
    return t.orders.select("o_orderkey", cal.lead_band(F.col("o_orderkey") % 337, [12, 48, 144],
                                                       ["0-6 h", "6-24 h", "days 2-3", "days 4-7"]).alias("band"))


@query("q19_smd", """
select l_returnflag, round((avg(l_quantity) filter (l_linestatus = 'O') - avg(l_quantity) filter (l_linestatus = 'F')) /
  sqrt((var_pop(l_quantity) filter (l_linestatus = 'O') + var_pop(l_quantity) filter (l_linestatus = 'F')) / 2), 6) as smd
from lineitem group by 1""")
def smd(t):
    a, b = F.when(F.col("l_linestatus") == "O", F.col("l_quantity")), F.when(F.col("l_linestatus") == "F", F.col("l_quantity"))
    scale = F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)
    return t.lineitem.groupBy("l_returnflag").agg(_r((F.avg(a) - F.avg(b)) / F.nullif(scale, F.lit(0.0))).alias("smd"))


@query("q20_token_sets", """
with k as (select p_partkey, list_sort(list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> ''))) as toks from part)
select p_partkey, array_to_string(toks, '|') as tokens, list_contains(toks, 'red')::int as has_red,
  array_to_string(list_sort(list_intersect(toks, ['red', 'ring', 'bolt'])), '|') as common from k""")
def token_sets(t):
    k = text.tokens(F.lower("p_name"), " ")
    want = F.array(F.lit("red"), F.lit("ring"), F.lit("bolt"))
    return t.part.select("p_partkey", text.joined(k).alias("tokens"), F.array_contains(k, "red").cast("int").alias("has_red"),
                         text.joined(F.array_intersect(k, want)).alias("common"))


@query("q21_fingerprint", """
select event_id, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') as fp,
  json_extract(props, '$.k')::int as k from events""")
def fingerprint(t):
    return t.events.select("event_id", F.sha2(F.to_json(F.struct("event_id", "event_type", "user_id")), 256).alias("fp"),
                           F.from_json("props", "k int")["k"].alias("k"))


@query("q22_null_safe_export", """
select event_id, case when event_type = 'error' then null else '{"value":' || (value * 100)::bigint || '}' end as payload
from events""")
def null_safe_export(t):
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(_r(F.col("value") * 100, 0))
    clean = maths.finite(v).cast("long")
    return t.events.select("event_id", F.when(clean.isNotNull(), F.to_json(F.struct(clean.alias("value")))).alias("payload"))
