"""Bootstraps and multiple-test rules on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import resample as op
from .aggregates import rounded
from .registry import query
from .standins import PAIRS, pair_panel

U = "('0x' || left(md5(concat_ws('|', {0})), 8))::bigint / 4294967296"

# Daily paired losses per return flag: challenger error and control error sums with counts.
DAYS = """dl as (select l_returnflag as key, l_shipdate as day, sum(abs(l_quantity - 25)) as a, sum(abs(l_quantity - l_discount * 500)) as b, count(*) as n from lineitem group by 1, 2),
sp as (select key, min(day) as lo, unnest(generate_series(min(day), max(day), interval 1 day)) as day from dl group by 1),
dd as (select sp.key, date_diff('day', lo, sp.day) as idx, coalesce(a, 0) as a, coalesce(b, 0) as b, coalesce(n, 0) as n from sp left join dl on dl.key = sp.key and dl.day = sp.day),
nn as (select key, count(*) as nd from dd group by 1)"""


def days(t):
    d = t.lineitem
    q = F.col("l_quantity")
    d = d.groupBy(F.col("l_returnflag").alias("key"), F.col("l_shipdate").alias("day")).agg(
        F.sum(F.abs(q - 25)).alias("a"), F.sum(F.abs(q - F.col("l_discount") * 500)).alias("b"), F.count(F.lit(1)).alias("n"))
    return op.day_index(d, ["key"], "day", ["a", "b", "n"])


def draws(block, reps, seed, circular=False):
    start = U.format(f"r, s, {seed}")
    return f"""dr as (select key, r, (floor({start} * ({'nd' if circular else f'nd - {block} + 1'}))::int + o) {'% nd' if circular else ''} as idx from nn, range(0, {reps}) a(r), (select unnest(range((select max(nd) from nn))) as s) b, range(0, {block}) c(o)
  where s < ceil(nd / {block}) and s * {block} + o < nd and nd >= {block})"""


EFFECT = "round(sum(b) / sum(n) - sum(a) / sum(n), 9)"


def effect():
    return F.round(F.col("b") / F.col("n") - F.col("a") / F.col("n"), 9)


def boot_sql(block, reps, seed, circular=False):
    return f"""with {DAYS}, {draws(block, reps, seed, circular)}, rp as (select key, r, {EFFECT} as s from dr join dd using (key, idx) group by 1, 2),
ci as (select key, round(quantile_cont(s, 0.025), 6) as ci_low, round(quantile_cont(s, 0.975), 6) as ci_high, count(s) as replicates from rp group by 1), e as (select key, count(*)::int as n_days, round({EFFECT}, 6) as estimate from dd group by 1)
select e.*, ci_low, ci_high, replicates from e join ci using (key)"""


@query("b1_moving_block", boot_sql(7, 200, 741))
def moving_block(t):
    return rounded(op.block_bootstrap(days(t), ["key"], ["a", "b", "n"], effect(), 7, 200, 741), ["estimate", "ci_low", "ci_high"])


@query("b2_circular_block", boot_sql(7, 200, 17, True))
def circular_block(t):
    return rounded(op.block_bootstrap(days(t), ["key"], ["a", "b", "n"], effect(), 7, 200, 17, circular=True), ["estimate", "ci_low", "ci_high"])


@query("b3_cluster_bootstrap", f"""with c as (select l_returnflag as key, date_trunc('quarter', l_shipdate) as q, sum(l_extendedprice * l_quantity) as a, sum(l_quantity * 40000) as b from lineitem group by 1, 2),
i as (select *, row_number() over (partition by key order by q) - 1 as idx from c), nn as (select key, count(*) as nd from i group by 1), {draws(1, 300, 5)},
rp as (select key, r, sum(a) / sum(b) as s from dr join i using (key, idx) group by 1, 2)
select e.key, e.n_days, e.estimate, round(quantile_cont(s, 0.025), 6) as ci_low, round(quantile_cont(s, 0.975), 6) as ci_high, count(s) as replicates
from rp join (select key, count(*)::int as n_days, round(sum(a) / sum(b), 6) as estimate from i group by 1) e using (key) group by 1, 2, 3""")
def cluster_bootstrap(t):
    p, q = F.col("l_extendedprice"), F.col("l_quantity")
    c = t.lineitem.groupBy(F.col("l_returnflag").alias("key"), cal.quarter_start(F.col("l_shipdate")).alias("q")).agg(F.sum(p * q).alias("a"), F.sum(q * 40000).alias("b"))
    return rounded(op.cluster_bootstrap(c, ["key"], "q", ["a", "b"], F.col("a") / F.col("b"), 300, 5), ["estimate", "ci_low", "ci_high"])


@query("b4_day_multinomial", f"""with u as (select l_returnflag as key, date_trunc('month', l_shipdate) as day, l_quantity as v from lineitem), dx as (select key, day, row_number() over (partition by key order by day) - 1 as idx from (select distinct key, day from u)),
nn as (select key, count(*) as nd from dx group by 1), {draws(1, 100, 31)}, w as (select key, r, idx, count(*) as w from dr group by 1, 2, 3),
x as (select u.key, r, v, sum(w) as w from u join dx using (key, day) join w using (key, idx) group by 1, 2, 3), c as (select *, sum(w) over (partition by key, r order by v) as cum, sum(w) over (partition by key, r) as tot from x),
m as (select key, r, min(v) as m from c where cum >= tot / 2 group by 1, 2)
select key, round(quantile_cont(m, 0.025), 6) as ci_low, round(quantile_cont(m, 0.975), 6) as ci_high from m group by 1""")
def day_multinomial(t):
    u = t.lineitem.select(F.col("l_returnflag").alias("key"), cal.month_start(F.col("l_shipdate")).alias("day"), F.col("l_quantity").alias("v"))
    return rounded(op.weighted_median_ci(u, ["key"], "day", "v", 100, 31), ["ci_low", "ci_high"])


@query("b5_incident_bootstrap", f"""with e as (select event_type as key, count(*) as n, count(*) filter (user_id % 3 > 0) as hits from events where value > 45 group by 1),
u as (select key, r, avg(({U.format('key, r, i, 741')} < hits / n)::int) as s from e, range(0, 200) a(r), (select unnest(range(1, (select max(n) from e) + 1)) as i) b where i <= n group by 1, 2)
select e.key, n, hits, round(hits / n, 6) as recall, round(quantile_cont(s, 0.025), 6) as ci_low, round(quantile_cont(s, 0.975), 6) as ci_high from e join u using (key) group by 1, 2, 3, 4""")
def incident_bootstrap(t):
    e = t.events.filter("value > 45").groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("user_id") % 3 > 0, 1)).alias("hits"))
    return rounded(op.binomial_interval(e, ["key"], "n", "hits", 200, 741), ["recall", "ci_low", "ci_high"])


@query("b6_holm", """with p as (select l_returnflag as family, l_suppkey as cell, case when l_suppkey % 9 = 0 then null else round(avg(l_discount) * avg(l_tax) * 2, 9) end as p from lineitem group by 1, 2),
s as (select *, (count(p) over (partition by family) - row_number() over w + 1) * p as s from p window w as (partition by family order by p nulls last, cell))
select family, cell, round(p, 6) as p, case when p is not null then round(least(max(s) over (partition by family order by p nulls last, cell rows unbounded preceding), 1), 6) end as adjusted from s""")
def holm(t):
    v = F.round(F.avg("l_discount") * F.avg("l_tax") * 2, 9)
    p = t.lineitem.groupBy(F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("cell")).agg(v.alias("p"))
    p = p.withColumn("p", F.when(F.col("cell") % 9 != 0, F.col("p")))
    return rounded(op.holm(p, ["family"], "p", ["cell"]), ["p", "adjusted"])


@query("b7_block_evidence", f"""with o as (select l_returnflag as key, l_shipdate as day, l_orderkey, avg(abs(l_quantity - 25) - abs(l_quantity - l_discount * 500)) as x, avg(greatest(l_discount * 500 - l_quantity, 0) - 12) as z from lineitem group by 1, 2, 3),
d as (select key, day, avg(x) as x, avg(z) as z from o group by 1, 2), f as (select key, min(day) as lo from d group by 1), b as (select key, date_diff('day', lo, day) // 14 as b, avg(x) as x, avg(z) as z from d join f using (key) group by 1, 2),
i as (select *, row_number() over (partition by key order by b) - 1 as idx from b), nn as (select key, count(*) as nd, avg(x) as mx, avg(z) as mz from i group by 1 having count(*) >= 4), {draws(1, 200, 741)},
rp as (select key, r, avg(x) as x, avg(z) as z from dr join i using (key, idx) group by 1, 2)
select key, max(nd)::int as blocks, round((count(*) filter (round(rp.x - mx - mx, 12) <= 0) + 1) / (count(*) + 1), 6) as pvalue, round(max(mx), 6) as x, round(max(mz), 6) as z, round(quantile_cont(rp.x, 0.95), 6) as x_upper, round(quantile_cont(rp.z, 0.95), 6) as z_upper
from rp join nn using (key) group by 1""")
def block_evidence(t):
    q, f = F.col("l_quantity"), F.col("l_discount") * 500
    o = t.lineitem.groupBy(
        F.col("l_returnflag").alias("key"), F.col("l_shipdate").alias("day"), "l_orderkey").agg(F.avg(F.abs(q - 25) - F.abs(q - f)).alias("x"), F.avg(F.greatest(f - q, F.lit(0.0)) - 12).alias("z"))
    d = o.groupBy("key", "day").agg(F.avg("x").alias("x"), F.avg("z").alias("z"))
    lo = d.groupBy("key").agg(F.min("day").alias("lo"))
    d = d.join(lo, "key").withColumn("i", F.datediff(F.col("day").cast("date"), F.col("lo").cast("date")))
    return rounded(op.block_evidence(d, ["key"], "i", ["x", "z"], 14, 200, 741), ["pvalue", "x", "z", "x_upper", "z_upper"])


@query("b8_quarter_bootstrap", f"""with {PAIRS}, x as (select o || '>' || d || '|' || strftime(week, '%Y%m%d') as key, strftime(time - interval 1 microsecond, '%Y-%m-%d') as day, pd - po as s, least(pd, 40) - least(po, 40) as e from pp where po is not null and pd is not null),
dy as (select key, day, avg(s) as s, avg(e) as e, 1 as n from x group by 1, 2), i as (select *, row_number() over (partition by key order by day) - 1 as idx from dy), nn as (select key, count(*) as nd from i group by 1), {draws(2, 100, 741)},
rp as (select key, r, sum(s) / sum(n) as a, sum(e) / sum(n) as b from dr join i using (key, idx) group by 1, 2)
select key, round(quantile_cont(a, 0.025), 6) as spread_low, round(quantile_cont(a, 0.975), 6) as spread_high, round(quantile_cont(b, 0.025), 6) as energy_low, round(quantile_cont(b, 0.975), 6) as energy_high from rp group by 1""")
def quarter_bootstrap(t):
    from pyspark.sql import Window
    p = pair_panel(t).filter("po is not null and pd is not null")
    key = F.concat("o", F.lit(">"), "d", F.lit("|"), F.date_format("week", "yyyyMMdd"))
    dy = p.groupBy(key.alias("key"), F.date_format(F.col("time") - F.expr("interval 1 microsecond"), "yyyy-MM-dd").alias("day")).agg(
        F.avg(F.col("pd") - F.col("po")).alias("s"), F.avg(F.least("pd", F.lit(40.0)) - F.least("po", F.lit(40.0))).alias("e"), F.lit(1).alias("n"))
    dy = dy.withColumn("idx", F.row_number().over(Window.partitionBy("key").orderBy("day")) - 1)   # a few days per quarter
    out = {}
    for c, name in (("s", "spread"), ("e", "energy")):
        d = op.block_bootstrap(dy, ["key"], [c, "n"], F.col(c) / F.col("n"), 2, 100, 741)
        out[name] = d.filter("ci_low is not null").select("key", F.col("ci_low").alias(f"{name}_low"), F.col("ci_high").alias(f"{name}_high"))
    return rounded(out["spread"].join(out["energy"], "key"), ["spread_low", "spread_high", "energy_low", "energy_high"])


@query("b9_confidence_set")
def confidence_set(t):
    """Sequential elimination over bootstrap means; the loop itself has no SQL form."""
    q = F.col("l_quantity")
    d = t.lineitem.groupBy(F.col("l_shipdate").alias("day")).agg(
        F.avg(F.abs(q - 25)).alias("mean"), F.avg(F.abs(q - 20)).alias("low"), F.avg(F.abs(q - F.col("l_discount") * 500)).alias("scaled"))
    d = op.day_index(d.withColumn("k", F.lit(0)), ["k"], "day", ["mean", "low", "scaled"])
    return op.confidence_set(d, ["mean", "low", "scaled"], 7, 200, 741)
