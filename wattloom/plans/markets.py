"""Settlement, auction and valuation on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import text
from ..operators import lookups as lk
from ..operators import market as op
from ..operators import ranks
from ..operators import revisions as rev
from .aggregates import rounded
from .registry import normal_cdf_sql, query
from .standins import OFF, PAIRS, pair_panel, r6, steady

# One asset interval per line: signed flow, losses, two prices.
ASSET = """asset as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate as time, l_suppkey % 5 as pair, l_returnflag as dir, l_quantity - 25 as f, l_tax * 10 as l,
  l_extendedprice / 1000 as pf, l_extendedprice * (0.75 + l_discount * 5) / 1000 as pt from lineitem)"""
SHARED = ASSET + """, sh as (select o_custkey as l_suppkey, o_orderdate as eff, max_by((o_orderkey % 10) / 10, o_orderkey) as s from orders group by 1, 2),
rs as (select asset.*, coalesce(s, 0.5) as s, (pt * (f - (1 - coalesce(s, 0.5)) * l) - pf * (f + coalesce(s, 0.5) * l)) / 12 as r from asset asof left join sh on sh.l_suppkey = asset.l_suppkey and asset.time >= sh.eff)"""


def assets(t):
    p = F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("time"), (F.col("l_suppkey") % 5).alias("pair"), F.col("l_returnflag").alias("dir"),
                             (F.col("l_quantity") - 25).alias("f"), (F.col("l_tax") * 10).alias("l"), (p / 1000).alias("pf"), (p * (F.col("l_discount") * 5 + 0.75) / 1000).alias("pt"))


def residues(t):
    sh = rev.latest(t.orders.select(F.col("o_custkey").alias("l_suppkey"), F.col("o_orderdate").alias("eff"), (F.col("o_orderkey") % 10 / 10).alias("s"), "o_orderkey"), ["l_suppkey", "eff"], ["o_orderkey"])
    d = lk.asof_backward(assets(t), sh, ["l_suppkey"], "time", "eff", ["s"], hours=24 * 365).drop("eff").withColumn("s", F.coalesce("s", F.lit(0.5)))
    return d.withColumn("r", op.residue(F.col("pf"), F.col("pt"), F.col("f"), F.col("l"), F.col("s")))


@query("m1_asset_residue", f"with {SHARED} select l_orderkey, l_linenumber, l_partkey, l_suppkey, s, round(r * 12, 9) as hourly from rs")
def asset_residue(t):
    return residues(t).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "s", r6(F.col("r") * 12, 9).alias("hourly"))


@query("m2_directional_pool", f"""with {SHARED}, p as (select time, pair, sum(r) as r, sum(f) as n from rs group by 1, 2)
select time, pair, n as net_flow, round(case when n > 0 then greatest(r, 0) else 0 end, 5) as ab_pos, round(case when n > 0 then least(r, 0) else 0 end, 5) as ab_neg,
  round(case when n < 0 then greatest(r, 0) else 0 end, 5) as ba_pos, round(case when n < 0 then least(r, 0) else 0 end, 5) as ba_neg from p""")
def directional_pool(t):
    return rounded(op.directional_pool(residues(t), ["time", "pair"], "r", "f"), ["ab_pos", "ab_neg", "ba_pos", "ba_neg"], 5)


@query("m3_settled_latest_run", """
with x as (select *, max(l_linenumber) over (partition by l_shipdate) as last from lineitem), d as (select *, row_number() over (partition by l_shipdate, l_partkey % 288, l_suppkey, l_returnflag order by l_orderkey desc, l_partkey desc, l_extendedprice desc) as rn from x where l_linenumber = last)
select l_shipdate + to_minutes((l_partkey % 288 * 5)::int) as time, l_suppkey, round(coalesce(sum(l_extendedprice) filter (l_returnflag = 'A'), 0), 2) as side_a, round(coalesce(sum(l_extendedprice) filter (l_returnflag = 'N'), 0), 2) as side_n from d where rn = 1 group by 1, 2""")
def settled_latest_run(t):
    d = t.lineitem.withColumn("period", F.col("l_partkey") % 288)
    d = op.settled_rows(d, "l_shipdate", "l_linenumber", ["period", "l_suppkey", "l_returnflag"], ["l_orderkey", "l_partkey", "l_extendedprice"])
    side = lambda s: r6(F.coalesce(F.sum(F.when(F.col("l_returnflag") == s, F.col("l_extendedprice"))), F.lit(0.0)), 2)
    return d.groupBy((F.col("l_shipdate") + F.make_dt_interval(mins=(F.col("period") * 5).cast("int"))).alias("time"), "l_suppkey").agg(side("A").alias("side_a"), side("N").alias("side_n"))


REG = """ureg as (select quarter, dir, max_by(prop, o_orderkey) as prop, max_by(mu, o_orderkey) as mu, max_by(fee, o_orderkey) as fee from (select year(o_orderdate) || 'Q' || quarter(o_orderdate) as quarter,
  case o_orderstatus when 'O' then 'A' when 'F' then 'N' else 'X' end as dir, o_orderkey, (o_orderkey % 50 + 1) / 10 as prop, o_custkey % 400 + 100 as mu, o_totalprice / 100000 as fee from orders) group by 1, 2)"""


def registry(t):
    q = F.concat(F.year("o_orderdate").cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string"))
    d = t.orders.select(q.alias("quarter"), F.when(F.col("o_orderstatus") == "O", "A").when(F.col("o_orderstatus") == "F", "N").otherwise("X").alias("dir"), "o_orderkey",
                        ((F.col("o_orderkey") % 50 + 1) / 10).alias("proportion"), (F.col("o_custkey") % 400 + 100).cast("double").alias("max_units"), (F.col("o_totalprice") / 100000).alias("fee"))
    return rev.latest(d, ["quarter", "dir"], ["o_orderkey"]).drop("o_orderkey")


@query("m5_unit_registry", f"with {REG} select quarter, dir, prop as proportion, mu::double as max_units, round(fee, 7) as fee from ureg")
def unit_registry(t):
    return rounded(registry(t), ["fee"], 7)


@query("m4_quarterly_ledger", f"""with {SHARED}, {REG}, v as (select *, unnest(['dated', 'share_0', 'share_1', 'lossless']) as variant from rs),
x as (select year(time - interval 1 microsecond) || 'Q' || quarter(time - interval 1 microsecond) as quarter, dir, variant, case variant when 'dated' then r when 'share_0' then (pt * (f - l) - pf * f) / 12 when 'share_1' then (pt * f - pf * (f + l)) / 12 else (pt - pf) * f / 12 end as r from v),
g as (select quarter, dir, variant, sum(greatest(r, 0)) as p, sum(least(r, 0)) as n, count(*) as c from x group by 1, 2, 3)
select quarter, dir, variant, round(p, 4) as residue_pos, round(n, 4) as residue_neg, c as intervals, coalesce(prop / 100, 1 / 500) as proportion, coalesce(mu::double, 500) as max_units, case when prop is null then 'fallback' else 'registry' end as units_source,
  round(p * coalesce(prop / 100, 1 / 500) + {OFF}, 6) as per_unit, round(p * coalesce(prop / 100, 1 / 500) - coalesce(fee, 0) + {OFF}, 6) as per_unit_net_fee from g left join ureg using (quarter, dir)""")
def quarterly_ledger(t):
    pf, pt, f, l = F.col("pf"), F.col("pt"), F.col("f"), F.col("l")  # noqa: E741
    def v(n, r):
        return F.struct(F.lit(n).alias("variant"), r.alias("r"))
    kinds = F.array(v("dated", F.col("r")), v("share_0", op.residue(pf, pt, f, l, F.lit(0.0))), v("share_1", op.residue(pf, pt, f, l, F.lit(1.0))), v("lossless", op.residue(pf, pt, f, l * 0, F.lit(0.0))))
    d = residues(t).withColumn("_v", F.explode(kinds)).select(cal.quarter_of(F.col("time")).alias("quarter"), "dir", "_v.variant", F.greatest("_v.r", F.lit(0.0)).alias("p"), F.least("_v.r", F.lit(0.0)).alias("n"))
    d = op.quarterly_ledger(d, registry(t), ["quarter", "dir", "variant"], "p", "n", 500.0).drop("fee")
    return steady(rounded(d, ["residue_pos", "residue_neg"], 4), ["per_unit", "per_unit_net_fee"])


@query("m6_reconcile", f"""with {SHARED}, x as (select pair, case when f > 0 then 'from' when f < 0 then 'to' end as side, year(time - interval 1 microsecond) || 'Q' || quarter(time - interval 1 microsecond) as quarter, r, case when l_linenumber <> 7 then (pt - pf) * f / 12 end as settled from rs where f <> 0)
select pair, side, quarter, round(sum(greatest(r, 0)), 4) as computed_pos, round(sum(r), 4) as computed_signed, round(sum(coalesce(settled, 0)), 4) as settled, round(avg((settled is not null)::int), 6) as coverage, round(100 * (sum(r) - sum(coalesce(settled, 0))) / abs(sum(coalesce(settled, 0))), 4) as bias_pct from x group by 1, 2, 3""")
def reconcile(t):
    f = F.col("f")
    d = residues(t).filter("f <> 0").select("pair", F.when(f > 0, "from").otherwise("to").alias("side"), cal.quarter_of(F.col("time")).alias("quarter"), "r",
                                            F.when(F.col("l_linenumber") != 7, (F.col("pt") - F.col("pf")) * f / 12).alias("s"))
    return rounded(rounded(op.settlement_reconcile(d, ["pair", "side", "quarter"], "r", "s"), ["computed_pos", "computed_signed", "settled", "bias_pct"], 4), ["coverage"])


LOOP = """lp as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 1000 as pn, l_quantity as pv, l_discount * 500 as ps, l_quantity - 25 as fvn, (l_partkey % 41) - 20.0 as fvs, (l_suppkey % 31) - 15.0 as fns,
  (l_quantity - 20) * 10 as avn, (l_partkey % 37) * 10.0 - 100 as avs, (l_suppkey % 29) * 10.0 - 60 as ans from lineitem)"""
ARM_SQL = """e as (select *, fns - fvn as en, fvn + fvs as ev, -fvs - fns as es, avn + avs + ans as nl from lp), n as (select *, (en >= 0)::int + (ev >= 0)::int + (es >= 0)::int as k from e),
d as (select *, case when k = 3 then sign(fvn) when ev >= 0 and en < 0 then 1 when en >= 0 and ev < 0 then -1 else 0 end as d1, case when k = 3 then sign(fvs) when ev >= 0 and es < 0 then 1 when es >= 0 and ev < 0 then -1 else 0 end as d2,
  case when k = 3 then sign(fns) when en >= 0 and es < 0 then 1 when es >= 0 and en < 0 then -1 else 0 end as d3 from n),
q as (select *, case when d1 = 0 then 0 when k = 1 then -(case when d1 > 0 then en else ev end) else (case when d1 > 0 then ev else en end) end as q1, case when d2 = 0 then 0 when k = 1 then -(case when d2 > 0 then es else ev end) else (case when d2 > 0 then ev else es end) end as q2,
  case when d3 = 0 then 0 when k = 1 then -(case when d3 > 0 then es else en end) else (case when d3 > 0 then en else es end) end as q3 from d),
m as (select *, q1 * d1 * (pn - pv) as m1, q2 * d2 * (ps - pv) as m2, q3 * d3 * (ps - pn) as m3 from q), s as (select *, m1 + m2 + m3 as tot, greatest(m1, 0) + greatest(m2, 0) + greatest(m3, 0) as gain from m),
v as (select *, case when (abs(tot) <= 1e-9 or sign(tot) <> sign(nl)) and gain > 0 then nl * greatest(m1, 0) / gain when abs(tot) > 1e-9 then nl * m1 / tot else 0 end as v1, case when (abs(tot) <= 1e-9 or sign(tot) <> sign(nl)) and gain > 0 then nl * greatest(m2, 0) / gain when abs(tot) > 1e-9 then nl * m2 / tot else 0 end as v2,
  case when (abs(tot) <= 1e-9 or sign(tot) <> sign(nl)) and gain > 0 then nl * greatest(m3, 0) / gain when abs(tot) > 1e-9 then nl * m3 / tot else 0 end as v3 from s),
w as (select *, greatest(v1, 0) + greatest(v2, 0) + greatest(v3, 0) as tw from v), f as (select *, case when nl > 0 and tw > 0 then nl * greatest(v1, 0) / tw else 0 end as s1, case when nl > 0 and tw > 0 then nl * greatest(v2, 0) / tw else 0 end as s2, case when nl > 0 and tw > 0 then nl * greatest(v3, 0) / tw else 0 end as s3 from w)"""


@query("m7_net_trade", f"""with {LOOP}, {ARM_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, k as n_exporting, nl as net_loop, round(case when d1 > 0 then s1 else 0 end, 4) as vic_nsw, round(case when d1 < 0 then s1 else 0 end, 4) as nsw_vic,
  round(case when d2 > 0 then s2 else 0 end, 4) as vic_sa, round(case when d2 < 0 then s2 else 0 end, 4) as sa_vic, round(case when d3 > 0 then s3 else 0 end, 4) as nsw_sa, round(case when d3 < 0 then s3 else 0 end, 4) as sa_nsw,
  case when fvn > 0 then greatest(avn, 0) else 0 end as sq_vic_nsw from f""")
def net_trade(t):
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 1000).alias("p_NSW"), F.col("l_quantity").alias("p_VIC"), (F.col("l_discount") * 500).alias("p_SA"),
                          (F.col("l_quantity") - 25).alias("f_VN"), (p % 41 - 20.0).alias("f_VS"), (s % 31 - 15.0).alias("f_NS"), ((F.col("l_quantity") - 20) * 10).alias("a_VN"), (p % 37 * 10.0 - 100).alias("a_VS"), (s % 29 * 10.0 - 60).alias("a_NS"))
    d = op.net_trade(d)
    names = {"vic_nsw": "loop_VICNSW", "nsw_vic": "loop_NSWVIC", "vic_sa": "loop_VICSA", "sa_vic": "loop_SAVIC", "nsw_sa": "loop_NSWSA", "sa_nsw": "loop_SANSW"}
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "n_exporting", "net_loop", *[r6(c, 4).alias(n) for n, c in names.items()], F.col("sq_VICNSW").alias("sq_vic_nsw"))


AUC = """au as (select o_orderkey as id, o_custkey, 'C' || (year(o_orderdate) + 1) || 'Q' || quarter(o_orderdate) || 'T' || lpad((o_orderkey % 12 + 1)::varchar, 2, '0') as cid, o_orderstatus as dir, o_totalprice / 1000 as price, o_orderkey % 90 as sold, o_orderdate as d1 from orders),
ap as (select *, substr(cid, 2, 6) as quarter, substr(cid, 9, 2)::int as tranche, 13 - substr(cid, 9, 2)::int as ahead, case when o_custkey % 4 = 0 then null else d1 end as rc, make_timestamp(substr(cid, 2, 4)::bigint, (substr(cid, 7, 1)::bigint - 1) * 3 + 1, 1, 0, 0, 0.0) as ds from au),
pn as (select *, coalesce(rc, d1 - interval 5 days) as auction_date, case when ahead <= 2 then '1-2 quarters' when ahead <= 4 then '3-4 quarters' when ahead <= 8 then '5-8 quarters' else '9-12 quarters' end as horizon from ap)"""


def auctions(t):
    d = F.col("o_orderdate")
    cid = F.concat(F.lit("C"), (F.year(d) + 1).cast("string"), F.lit("Q"), F.quarter(d).cast("string"), F.lit("T"), F.lpad((F.col("o_orderkey") % 12 + 1).cast("string"), 2, "0"))
    a = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey", cid.alias("cid"), F.col("o_orderstatus").alias("dir"), (F.col("o_totalprice") / 1000).alias("price"), (F.col("o_orderkey") % 90).alias("sold"), d.alias("d1"))
    dated = t.orders.filter("o_custkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), d.alias("rc"))
    fallback = t.orders.select(F.col("o_orderkey").alias("id"), (d - F.expr("interval 5 days")).alias("at_tranche"))
    a = a.join(dated, "id", "left").join(fallback, "id", "left").withColumns({"quarter": text.contract_quarter(F.col("cid")), "tranche": text.contract_tranche(F.col("cid"))})
    first = F.make_timestamp_ntz(F.left("quarter", F.lit(4)).cast("int"), (F.right("quarter", F.lit(1)).cast("int") - 1) * 3 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    ahead = F.lit(13) - F.col("tranche")
    return a.withColumns({"auction_date": F.coalesce("rc", "at_tranche"), "ds": first, "ahead": ahead,
                          "horizon": cal.lead_band(ahead, [2, 4, 8, 12], ["1-2 quarters", "3-4 quarters", "5-8 quarters", "9-12 quarters"])})


@query("m8_auction_panel", f"with {AUC} select id, cid, quarter, tranche, ahead, horizon, auction_date, date_diff('day', auction_date, ds) as days_ahead, dir from pn")
def auction_panel(t):
    return auctions(t).select("id", "cid", "quarter", "tranche", "ahead", "horizon", "auction_date", F.datediff(F.col("ds").cast("date"), F.col("auction_date").cast("date")).cast("long").alias("days_ahead"), "dir")


REAL = AUC + """, rl as (select year(l_shipdate) || 'Q' || quarter(l_shipdate) as quarter, case l_returnflag when 'A' then 'O' when 'N' then 'F' else 'P' end as dir, round(avg(l_extendedprice) / 200, 6) as per_unit from lineitem group by 1, 2),
jn as (select pn.*, per_unit, per_unit / price as ratio from pn join rl using (quarter, dir) where sold > 0 and price > 0)"""


def realised(t):
    q = F.concat(F.year("l_shipdate").cast("string"), F.lit("Q"), F.quarter("l_shipdate").cast("string"))
    d = F.when(F.col("l_returnflag") == "A", "O").when(F.col("l_returnflag") == "N", "F").otherwise("P")
    return t.lineitem.groupBy(q.alias("quarter"), d.alias("dir")).agg(r6(F.avg("l_extendedprice") / 200).alias("per_unit"))


@query("m9_auction_premium", f"""with {REAL}, l as (select jn.*, a, b from jn, (select unnest([0, 0, 1, 1]) as a, unnest([0, 1, 0, 1]) as b)), g as (select * replace (case when a = 1 then 'all' else dir end as dir, case when b = 1 then 'all' else horizon end as horizon) from l)
select dir, horizon, count(*) as tranches, count(distinct quarter) as quarters, round(sum(per_unit * sold) / sum(price * sold), 6) as value_ratio, round(avg((ratio > 1)::int), 6) as share_above, round(avg(per_unit - price), 6) as mean_premium, round(quantile_cont(ratio, 0.5), 6) as median_ratio from g group by 1, 2""")
def auction_premium(t):
    d = auctions(t).join(realised(t), ["quarter", "dir"]).select("dir", "horizon", "quarter", "price", F.col("sold").alias("units"), "per_unit")
    return rounded(op.premium_table(d, "dir", "horizon"), ["value_ratio", "share_above", "mean_premium", "median_ratio"])


@query("m9_proceeds_vs_residue", f"""with {REAL} select quarter, dir, round(sum(price * sold), 5) as proceeds, sum(sold)::bigint as units_sold, round(any_value(per_unit) * sum(sold), 4) as distributed from jn group by 1, 2""")
def proceeds_vs_residue(t):
    d = auctions(t).filter("sold > 0 and price > 0").groupBy("quarter", "dir").agg(F.sum(F.col("price") * F.col("sold")).alias("proceeds"), F.sum("sold").alias("units_sold"))
    d = d.join(realised(t), ["quarter", "dir"])
    return d.select("quarter", "dir", r6("proceeds", 5).alias("proceeds"), "units_sold", r6(F.col("per_unit") * F.col("units_sold"), 4).alias("distributed"))


@query("m10_bid_depth", """
with b as (select distinct l_partkey as contract, l_returnflag as dir, l_quantity as units, l_extendedprice as bid from lineitem)
select contract, dir, count(*) as bid_steps, sum(units) as units_bid, max(bid) as max_bid, round(quantile_cont(bid, 0.5), 4) as median_bid, round(sum(units) / p_size, 6) as bid_to_offer from b join part on contract = p_partkey group by 1, 2, p_size""")
def bid_depth(t):
    b = t.lineitem.select(F.col("l_partkey").alias("contract"), F.col("l_returnflag").alias("dir"), F.col("l_quantity").alias("units"), F.col("l_extendedprice").alias("bid")).distinct()
    k = ["contract", "dir"]
    a = b.groupBy(*k).agg(F.count(F.lit(1)).alias("bid_steps"), F.sum("units").alias("units_bid"), F.max("bid").alias("max_bid"))
    a = a.join(ranks.quantiles(b, k, "bid", {"median_bid": 0.5}).drop("n_values"), k).join(t.part.select(F.col("p_partkey").alias("contract"), "p_size"), "contract")
    return rounded(rounded(a.withColumn("bid_to_offer", F.col("units_bid") / F.col("p_size")).drop("p_size"), ["median_bid"], 4), ["bid_to_offer"])


@query("m11_tranche_returns", f"""with {AUC}, w as (select substr(year(l_shipdate)::varchar, 1, 4) || 'Q' || quarter(l_shipdate) as quarter, case l_returnflag when 'A' then 'O' when 'N' then 'F' else 'P' end as dir, date_trunc('week', l_shipdate) as week, sum(l_extendedprice) / 2000 as v from lineitem group by 1, 2, 3),
c as (select id, w.quarter, w.dir, any_value(price) as price, sum(v) as realised, sum(v * date_diff('day', auction_date, week + interval 21 days)) / sum(v) as mean_days from pn join w using (quarter, dir) where sold > 80 and price > 0 group by 1, 2, 3)
select id, quarter, dir, round(realised, 7) as realised, round(mean_days, 4) as mean_days, round(realised / price - 1, 6) as holding_return, round(case when realised / price - 1 > -1 then pow(realised / price, 365 / greatest(mean_days, 1)) - 1 else -1 end, 5) as annualised from c""")
def tranche_returns(t):
    q = F.concat(F.year("l_shipdate").cast("string"), F.lit("Q"), F.quarter("l_shipdate").cast("string"))
    d = F.when(F.col("l_returnflag") == "A", "O").when(F.col("l_returnflag") == "N", "F").otherwise("P")
    w = t.lineitem.groupBy(q.alias("quarter"), d.alias("dir"), F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("week")).agg((F.sum("l_extendedprice") / 2000).alias("v"))
    a = auctions(t).filter("sold > 80 and price > 0").select("id", "quarter", "dir", "price", "auction_date")
    c = op.weekly_cash(a.join(w, ["quarter", "dir"]), ["id", "quarter", "dir", "price", "auction_date"], "week", "v", F.col("auction_date"), 21)
    return c.select("id", "quarter", "dir", r6("realised", 7).alias("realised"), r6("mean_days", 4).alias("mean_days"), r6(F.col("realised") / F.col("price") - 1).alias("holding_return"),
                    r6(op.annualised(F.col("realised"), F.col("price"), F.col("mean_days")), 5).alias("annualised"))


WEEKS = """wk as (select l_returnflag as dir, date_trunc('week', l_shipdate) as week, sum(l_quantity) as u, round(sum(l_extendedprice) / 1000, 5) as s, count(distinct l_shipdate) as n from lineitem group by 1, 2), fw as (select * from wk where n >= 3)"""


def weeks(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("dir"), F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("week")).agg(
        F.sum("l_quantity").alias("u"), F.round(F.sum("l_extendedprice") / 1000, 5).alias("s"), F.countDistinct("l_shipdate").alias("n")).filter("n >= 3")


@query("m12_hedge_effectiveness", f"""with {WEEKS}, r as (select *, row_number() over (partition by dir order by s desc, u desc, week) as rk, rank() over (partition by dir order by u) + (count(*) over (partition by dir, u) - 1) / 2 as ru, rank() over (partition by dir order by s) + (count(*) over (partition by dir, s) - 1) / 2 as rs from fw)
select dir, count(*) as weeks, round(covar_samp(u, s) / var_samp(s), 6) as beta, round(corr(u, s) ^ 2, 6) as r2, round(sum(u) / sum(s), 6) as ratio_all, round(sum(u) filter (rk <= 12) / sum(s) filter (rk <= 12), 6) as ratio_top, round(covar_samp(u, s) / var_samp(u), 6) as units_min_var,
  round(corr(u, s) ^ 2, 6) as variance_reduction, round(corr(ru, rs), 6) as spearman from r group by 1""")
def hedge_effectiveness(t):
    w = weeks(t)
    d = op.hedge_stats(w, ["dir"], "u", "s", 12).join(ranks.rank_correlation(w, ["dir"], "u", "s", minimum=3, name="spearman").drop("n_pairs"), "dir")
    return rounded(d, ["beta", "r2", "ratio_all", "ratio_top", "units_min_var", "variance_reduction", "spearman"])


@query("m13_cvar_frontier", f"""with {WEEKS}, l as (select dir, units, round(s - units * (u - 60), 9) as loss from fw, (select unnest([0, 0.5, 1, 2, 4]::double[]) as units)), q as (select dir, units, quantile_cont(loss, 0.95) as var from l group by 1, 2)
select dir, units, round(avg(-loss), 6) as mean_pnl, round(any_value(var), 6) as var, round(avg(loss) filter (loss >= var), 6) as cvar, round(stddev_samp(loss), 6) as sd from l join q using (dir, units) group by 1, 2""")
def cvar_frontier(t):
    d = op.tail_frontier(weeks(t).withColumn("cost", F.lit(60.0)), ["dir"], "u", "s", "cost", [0, 0.5, 1, 2, 4], 0.95)
    return rounded(d, ["mean_pnl", "var", "cvar", "sd"])


@query("m14_futures_premia", """
with f as (select o_orderpriority as region, year(o_orderdate + interval 100 days) || 'Q' || quarter(o_orderdate + interval 100 days) as cq, o_orderdate as d, o_orderkey, o_totalprice / 1000 as price from orders),
p as (select region, cq, max_by(price, (d, o_orderkey)) as last_price, max(d) as last_date from f where d < make_timestamp(left(cq, 4)::bigint, (right(cq, 1)::bigint - 1) * 3 + 1, 1, 0, 0, 0.0) group by 1, 2),
r as (select o_orderpriority as region, year(o_orderdate) || 'Q' || quarter(o_orderdate) as cq, avg(o_totalprice) / 1000 as mean_price from orders group by 1, 2), j as (select * from p join r using (region, cq))
select a.cq, a.region || '>' || b.region as pair, round(a.last_price - a.mean_price, 6) as premium, round(b.last_price - a.last_price, 6) as futures_spread, round(b.mean_price - a.mean_price, 6) as realised_spread
from j a join j b on a.cq = b.cq and a.region < b.region""")
def futures_premia(t):
    d = F.col("o_orderdate")
    later = d + F.expr("interval 100 days")
    cq = lambda x: F.concat(F.year(x).cast("string"), F.lit("Q"), F.quarter(x).cast("string"))
    f = t.orders.select(F.col("o_orderpriority").alias("region"), cq(later).alias("cq"), cal.quarter_start(later).alias("ds"), d.alias("d"), "o_orderkey", (F.col("o_totalprice") / 1000).alias("price"))
    p = f.filter("d < ds").groupBy("region", "cq").agg(F.max_by("price", F.struct("d", "o_orderkey")).alias("last_price"))
    r = t.orders.groupBy(F.col("o_orderpriority").alias("region"), cq(d).alias("cq")).agg((F.avg("o_totalprice") / 1000).alias("mean_price"))
    j = p.join(r, ["region", "cq"])
    # a few regions a quarter
    a = j.select("cq", F.col("region").alias("ra"), F.col("last_price").alias("la"), F.col("mean_price").alias("ma"))
    b = j.select("cq", F.col("region").alias("rb"), F.col("last_price").alias("lb"), F.col("mean_price").alias("mb"))
    return a.join(b, "cq").filter("ra < rb").select("cq", F.concat("ra", F.lit(">"), "rb").alias("pair"), r6(F.col("la") - F.col("ma")).alias("premium"), r6(F.col("lb") - F.col("la")).alias("futures_spread"), r6(F.col("mb") - F.col("ma")).alias("realised_spread"))


@query("m15_cap_normalised", """
with c as (select o_orderpriority, year(o_orderdate) as y, o_totalprice as p, case when o_orderdate >= '1999-07-01' then 450000 when o_orderdate >= '1997-07-01' then 430000 else 400000 end as cap from orders),
n as (select *, case when p >= cap * 0.999 then p * 450000.0 / cap else p end as pn from c)
select o_orderpriority, y, round(avg(greatest(p - 300, 0)), 6) as raw, round(avg(greatest(pn - 300, 0)), 6) as normalised, count(*) filter (p >= cap * 0.999) as at_cap from n group by 1, 2""")
def cap_normalised(t):
    from ..operators.cleaning import dated_step
    p, cap = F.col("o_totalprice"), dated_step(F.col("o_orderdate"), [("1990-01-01", 400000), ("1997-07-01", 430000), ("1999-07-01", 450000)])
    at = p >= cap * 0.999
    pn = F.when(at, p * 450000.0 / cap).otherwise(p)
    zero = F.lit(0.0)
    return t.orders.groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(
        r6(F.avg(F.greatest(p - 300, zero))).alias("raw"), r6(F.avg(F.greatest(pn - 300, zero))).alias("normalised"), F.count(F.when(at, 1)).alias("at_cap"))


@query("m16_tail_dependence", """
with d as (select l_returnflag as dir, l_quantity * greatest(l_discount - 0.02, 0) as x from lineitem), r as (select *, row_number() over (partition by dir order by x desc) as rn, count(*) over (partition by dir) as n from d)
select dir, round(sum(x) filter (rn <= greatest(1, floor(n * 0.01))) / sum(x), 6) as top_share from r group by 1""")
def tail_dependence(t):
    d = t.lineitem.select(F.col("l_returnflag").alias("dir"), (F.col("l_quantity") * F.greatest(F.col("l_discount") - 0.02, F.lit(0.0))).alias("x"))
    return rounded(op.top_share(d, ["dir"], "x", 0.01), ["top_share"])


@query("m17_walk_forward", f"""with {REAL}, h as (select dir, quarter, per_unit, quarter as q2, right(quarter, 1)::int as season, make_timestamp(left(quarter, 4)::bigint, (right(quarter, 1)::bigint - 1) * 3 + 1, 1, 0, 0, 0.0) + interval 3 months as qe from rl),
a as (select id, dir, quarter, per_unit as actual, auction_date, right(quarter, 1)::int as season from jn), x as (select a.*, h.per_unit as v, h.season as hs, row_number() over (partition by id order by qe desc) as rk, row_number() over (partition by id, h.season order by qe desc) as rs from a join h on h.dir = a.dir and qe + interval 28 days < auction_date)
select id, dir, quarter, count(*) as history, max(v) filter (rk = 1) as last_quarter, round(avg(v) filter (rk <= 4), 9) as trailing_4q, round(avg(v) filter (rk <= 8), 9) as trailing_8q, round(avg(v) filter (rk <= 12), 9) as trailing_12q, round(avg(v) filter (hs = season and rs <= 3), 9) as same_season,
  round(avg(v) filter (rk <= 4) - any_value(actual), 9) as error_4q from x group by 1, 2, 3 having count(*) >= 4""")
def walk_forward(t):
    r = realised(t)
    first = F.make_timestamp_ntz(F.left("quarter", F.lit(4)).cast("int"), (F.right("quarter", F.lit(1)).cast("int") - 1) * 3 + 1, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    h = r.withColumns({"season": F.right("quarter", F.lit(1)).cast("int"), "quarter_end": F.add_months(first.cast("date"), 3).cast("timestamp_ntz")}).drop("quarter")
    a = auctions(t).filter("sold > 0 and price > 0").join(r.withColumnRenamed("per_unit", "actual"), ["quarter", "dir"]).select(
        F.col("id").alias("auction_id"), "dir", "quarter", "actual", "auction_date", F.right("quarter", F.lit(1)).cast("int").alias("season"))
    d = op.walk_forward(a, h, ["dir"], "28 days").withColumn("error_4q", F.col("trailing_4q") - F.col("actual"))
    return rounded(d, ["trailing_4q", "trailing_8q", "trailing_12q", "same_season", "error_4q"], 9).select(
        F.col("auction_id").alias("id"), "dir", "quarter", "history", "last_quarter", "trailing_4q", "trailing_8q", "trailing_12q", "same_season", "error_4q")


@query("m18_regime_option", f"""with b as (select l_returnflag as dir, (floor((month(l_shipdate) % 12) / 3) * 10 + floor(l_quantity / 17))::bigint as regime, year(l_shipdate) * 4 + quarter(l_shipdate) as period, l_discount * 100 - 4 as x, greatest(l_quantity - 10, 0) as f from lineitem),
m as (select dir, regime, period, count(*) as n, sum(x) as s, sum(x * x) as ss, sum(f) as f from b group by 1, 2, 3),
p as (select dir, regime, q as period, sum(n) as n, sum(s) as s, sum(ss) as ss, sum(f) as f from (select *, unnest(range(period + 1, period + 5)) as q from m) group by 1, 2, 3),
v as (select m.dir, m.period, m.n, coalesce(p.f / p.n, 0) as flow, coalesce(p.s / p.n, 0) as mu, coalesce(case when p.n > 1 then sqrt(greatest((p.ss - p.s * p.s / p.n) / (p.n - 1), 0)) end, 1) as sd from m left join p using (dir, regime, period)),
z as (select *, mu / nullif(sd, 0) as z from v),
c as (select *, case when sd > 0 then sd * exp(-z * z / 2) / sqrt(2 * pi()) + mu * {normal_cdf_sql('z')} else greatest(mu, 0) end as call from z)
select dir, period, round(sum(n * flow * call) / 12, 4) as option_value, sum(n)::bigint as intervals from c group by 1, 2""")
def regime_option(t):
    """The tests also rebuild it with numpy on a small fixture."""
    d = t.lineitem.select(F.col("l_returnflag").alias("dir"), (cal.season(F.col("l_shipdate")) * 10 + F.floor(F.col("l_quantity") / 17)).alias("regime"),
                          (F.year("l_shipdate") * 4 + F.quarter("l_shipdate")).alias("period"), (F.col("l_discount") * 100 - 4).alias("x"), (F.col("l_quantity") - 10).alias("f"))
    return rounded(op.regime_option(d, ["dir"], "regime", "period", "x", "f", 4), ["option_value"], 4)


@query("m19_offer_steepness", """
with b as (select l_suppkey as region, date_trunc('month', l_shipdate) as month, l_extendedprice as p, l_quantity as q, 30000.0 as rrp from lineitem), d as (select region, month, p, sum(q) as q from b group by 1, 2, 3),
c as (select region, month, coalesce(sum(q) filter (p <= 30000), 0) as cleared from b group by 1, 2), s as (select *, sum(q) over (partition by region, month order by p) as cum from d)
select c.region, c.month, cleared, min(p) filter (cum >= cleared + 60) as next_price, round((min(p) filter (cum >= cleared + 60) - 30000) / 60, 6) as steepness from c join s on s.region = c.region and s.month = c.month group by 1, 2, 3""")
def offer_steepness(t):
    b = t.lineitem.select(F.col("l_suppkey").alias("region"), cal.month_start(F.col("l_shipdate")).alias("month"), F.col("l_extendedprice").alias("p"), F.col("l_quantity").alias("q"), F.lit(30000.0).alias("rrp"))
    return rounded(op.offer_steepness(b, ["region", "month"], "p", "q", "rrp", 60.0), ["steepness"]).drop("rrp")


@query("m20_structural_changes", f"""with {REG} select dir, quarter, mu::double as max_units, prev::double as previous from (select *, lag(mu) over (partition by dir order by quarter) as prev from ureg) where prev is not null and prev <> mu""")
def structural_changes(t):
    return op.change_points(registry(t).select("dir", "quarter", "max_units"), ["dir"], "quarter", "max_units")


@query("m21_suspension_sensitivity", f"""with {PAIRS} select o, d, week, round(avg(pd - po) + {OFF}, 6) as every, round(avg(pd - po) filter (not coalesce(so = 3, false)) + {OFF}, 6) as without_flagged, count(*) filter (so = 3) as flagged from pp where po is not null and pd is not null group by 1, 2, 3""")
def suspension_sensitivity(t):
    x, flag = F.col("pd") - F.col("po"), F.coalesce(F.col("so") == 3, F.lit(False))
    return steady(pair_panel(t).filter("po is not null and pd is not null").groupBy("o", "d", "week").agg(
        F.avg(x).alias("every"), F.avg(F.when(~flag, x)).alias("without_flagged"), F.count(F.when(flag, 1)).alias("flagged")), ["every", "without_flagged"])


@query("x48_management_flag_latest", """
select event_type, time_bucket(interval '1 hour', ts) as time, arg_max((user_id % 5 = 0)::int, (ts, event_id)) as active from events group by 1, 2""")
def management_flag_latest(t):
    return t.events.groupBy("event_type", cal.floor_time(F.col("ts"), 3600).alias("time")).agg(
        F.max_by((F.col("user_id") % 5 == 0).cast("int"), F.struct("ts", "event_id")).alias("active"))


