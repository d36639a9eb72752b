"""Constraint and limit analytics on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import constraints as op
from ..operators import revisions as rev
from ..operators import sequence as seq
from .aggregates import rounded
from .registry import query
from .standins import EQ, equations, r6

# Equation versions (part) with a link factor, unit factors (supplier), monthly unit output.
UNITS = """fac as (select l_partkey as eq, round(max(l_discount) - 0.03, 2) as a from lineitem group by 1),
terms as (select l_partkey as eq, l_suppkey as unit, l_linenumber as cp, round(max(l_tax) * 100) - 4 as f from lineitem group by 1, 2, 3),
sens as (select t.eq, unit, -sum(f) / nullif(any_value(a), 0) as s from terms t join fac using (eq) group by 1, 2),
mw as (select l_suppkey as unit, date_trunc('month', l_shipdate) as month, sum(l_quantity) as mw, avg(l_discount) as ramp, sum(l_linenumber) * 20 as avail from lineitem group by 1, 2),
sp as (select unit, unnest(generate_series(min(month), max(month), interval 1 month)) as month from mw group by 1),
mg as (select sp.unit, sp.month, mw, mw - lag(mw) over (partition by sp.unit order by sp.month) as delta from sp left join mw on mw.unit = sp.unit and mw.month = sp.month),
pres as (select distinct l_partkey as eq, date_trunc('month', l_shipdate) as month from lineitem)"""


def factors(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("eq")).agg(F.round(F.max("l_discount") - 0.03, 2).alias("a"))


def terms(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("eq"), F.col("l_suppkey").alias("unit"), F.col("l_linenumber").alias("cp")).agg(
        (F.round(F.max("l_tax") * 100) - 4).alias("f"))


def sens(t):
    return op.unit_sensitivity(terms(t), factors(t), ["eq"], "unit", "f", "a")


def output(t):
    return t.lineitem.groupBy(F.col("l_suppkey").alias("unit"), cal.month_start(F.col("l_shipdate")).alias("month")).agg(
        F.sum("l_quantity").alias("mw"), F.avg("l_discount").alias("ramp"), (F.sum("l_linenumber") * 20).cast("double").alias("avail"))


def moves(t):
    g = seq.dense_grid(output(t).select("unit", "month", "mw"), ["unit"], "month", "1 month")
    return seq.windowed(g, ["unit"], "month", lambda w: {"delta": F.col("mw") - F.lag("mw").over(w)}, before="31 days", hours=24 * 3660)


def present(t):
    return t.lineitem.select(F.col("l_partkey").alias("eq"), cal.month_start(F.col("l_shipdate")).alias("month")).distinct()


@query("c1_equation_state", f"""with {EQ}, r as (select *, row_number() over (partition by eq, time order by (flag = 'R')::int desc, l_linenumber desc, l_orderkey desc, unit desc) as rn from st),
f as (select l_partkey as eq, l_linenumber as ver, round(max(l_discount) - 0.03, 2) as a2 from lineitem where l_linestatus = 'O' group by 1, 2)
select r.eq, time, l_orderkey, a2 as a, case when a2 > 0 then 'upper' when a2 < 0 then 'lower' end as side, case when a2 <> 0 then round(flow + (rhs - lhs) / a2, 6) end as bound,
  (a2 is not null and abs(a2) > 1e-8)::int as complete from r left join f on f.eq = r.eq and ver = l_linenumber where rn = 1""")
def equation_state(t):
    d = equations(t).drop("a").withColumn("iv", (F.col("flag") == "R").cast("int"))
    d = rev.run_selection(d, ["eq", "time"], "iv", "l_linenumber", "l_orderkey", "unit")
    f = t.lineitem.filter("l_linestatus = 'O'").groupBy(F.col("l_partkey").alias("eq"), "l_linenumber").agg(F.round(F.max("l_discount") - 0.03, 2).alias("a"))
    d = op.solution_state(d.join(f, ["eq", "l_linenumber"], "left"))
    ok = F.col("a").isNotNull() & (F.abs("a") > 1e-8)
    return d.select("eq", "time", "l_orderkey", "a", "side", "bound", ok.cast("int").alias("complete"))


@query("c2_limit_envelope", f"""with {EQ}, r as (select *, row_number() over (partition by time, side order by case when side = 'upper' then bound else -bound end, eq, l_orderkey, l_linenumber, unit) as rn from st where bound is not null),
e as (select time, max(bound) filter (side = 'upper' and rn = 1) as upper, max(bound) filter (side = 'lower' and rn = 1) as lower, max(bound) filter (side = 'upper' and rn = 2) as u2, max(bound) filter (side = 'lower' and rn = 2) as l2,
  max(eq) filter (side = 'upper' and rn = 1) as upper_setter, max(eq) filter (side = 'lower' and rn = 1) as lower_setter from r group by 1),
n as (select time, count(*) as n_rows, count(*) filter (side = 'upper') as n_upper, count(*) filter (side = 'lower') as n_lower from st group by 1)
select n.*, upper, lower, round(u2 - upper, 4) as upper_gap, round(lower - l2, 4) as lower_gap, upper_setter, lower_setter, coalesce(lower > upper, false)::int as inconsistent from n left join e using (time)""")
def limit_envelope(t):
    d = op.envelope(op.solution_state(equations(t)), "time", "eq", ["l_orderkey", "l_linenumber", "unit"])
    return rounded(d, ["upper_gap", "lower_gap"], 4)


@query("c3_unit_sensitivity", f"with {UNITS} select eq, unit, round(s, 6) as sensitivity from sens")
def unit_sensitivity(t):
    return rounded(sens(t), ["sensitivity"])


@query("c4_generator_pressure", f"""with {UNITS} select month, eq, round(sum(s * delta), 4) as bound_move, round(sum(greatest(-s * delta, 0)) filter (s * delta is not null), 4) as upper_tightening,
  round(sum(greatest(s * delta, 0)) filter (s * delta is not null), 4) as upper_relief, (count(*) filter (delta is null and s <> 0) = 0)::int as complete
from pres join sens using (eq) left join mg using (unit, month) group by 1, 2""")
def generator_pressure(t):
    d = op.pressure(present(t), sens(t), moves(t), ["eq"], "unit", "month", "delta")
    s = "bound_move is not null"
    d = d.withColumns({c: F.when(F.expr(s), F.col(c)) for c in ("upper_tightening", "upper_relief")})
    return rounded(d, ["bound_move", "upper_tightening", "upper_relief"], 4)


@query("c4_available_relief", f"""with {UNITS}, u as (select unit, month, least(greatest(avail - mw, 0), ramp * 30) as up, least(mw, ramp * 30) as dn from mw)
select month, eq, round(sum(up * greatest(s, 0) + dn * greatest(-s, 0)), 7) as upper_relief_mw, round(sum(up * greatest(-s, 0) + dn * greatest(s, 0)), 7) as lower_relief_mw
from pres join (select * from sens where s is not null) using (eq) join u using (unit, month) group by 1, 2""")
def available_relief(t):
    u = output(t).select("unit", "month", "mw", F.col("avail").alias("availability"), F.col("ramp").alias("ramp_up"), F.col("ramp").alias("ramp_down"))
    d = op.available_relief(present(t), sens(t).filter("sensitivity is not null"), u, ["eq"], "unit", "month")
    return rounded(d, ["upper_relief_mw", "lower_relief_mw"], 7)


@query("c5_structural_zero", """
with m as (select l_suppkey as unit, date_trunc('month', l_shipdate) as month, sum(l_quantity) as mw from lineitem where l_returnflag = 'A' and l_linestatus = 'O' and l_quantity > 30 group by 1, 2),
g as (select unit, month from (select distinct unit from m), (select unnest(generate_series(timestamp '1995-01-01', timestamp '2001-12-01', interval 1 month)) as month)),
s as (select unit, min(month) as a, max(month) as b from m group by 1)
select g.unit, g.month, case when g.month < a or g.month > b then 0 else mw end as mw from g join s using (unit) left join m on m.unit = g.unit and m.month = g.month""")
def structural_zero(t):
    m = t.lineitem.filter("l_returnflag = 'A' and l_linestatus = 'O' and l_quantity > 30").groupBy(
        F.col("l_suppkey").alias("unit"), cal.month_start(F.col("l_shipdate")).alias("month")).agg(F.sum("l_quantity").alias("mw"))
    months = F.sequence(F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("2001-12-01").cast("timestamp_ntz"), F.expr("interval 1 month"))
    g = m.select("unit").distinct().withColumn("month", F.explode(months)).join(m, ["unit", "month"], "left")
    return op.structural_zero(g, "unit", "month", "mw")


@query("c6_influence_discovery", f"""with {UNITS}, fr as (select eq, count(*) as f from pres group by 1), w as (select unit, sum(abs(s) * f) as w from sens join fr using (eq) group by 1), m as (select unit, avg(abs(delta)) as m from mg group by 1)
select unit, round(m, 6) as movement, round(w * m, 3) as influence_score from w join m using (unit)""")
def influence_discovery(t):
    d = op.influence_scores(present(t), sens(t), moves(t), ["eq"], "unit", "delta")
    return rounded(rounded(d, ["movement"]), ["influence_score"], 3)


LEAD = """lead as (select month, side, eq, bound, bound - lag(bound) over (partition by side order by month) as lc from (
  select date_trunc('month', time) as month, side, eq, bound, row_number() over (partition by date_trunc('month', time), side order by case when side = 'upper' then bound else -bound end, eq, l_orderkey) as rn from st where bound is not null) where rn = 1)"""


def leaders(t):
    st = op.solution_state(equations(t)).filter("bound is not null").withColumn("month", cal.month_start(F.col("time")))
    toward = F.when(F.col("side") == "upper", F.col("bound")).otherwise(-F.col("bound"))
    d = rev.top_k(st, ["month", "side"], [toward, F.col("eq"), F.col("l_orderkey")], 1)
    d = seq.previous(d.select("month", "side", "eq", "bound"), ["side"], ["month"], {"_b": "bound"}, hours=24 * 3660)
    return d.withColumn("limit_change", F.col("bound") - F.col("_b")).drop("_b", "bound")


@query("c7_unit_contribution", f"""with {EQ}, {UNITS}, {LEAD} select month, side, lead.eq, unit, round(s * delta, 4) as bound_impact, round(case when side = 'upper' then s * delta else -s * delta end, 4) as capacity_impact,
  coalesce(sign(case when side = 'upper' then s * delta else -s * delta end) = sign(lc), false)::int as aligned from lead join sens on sens.eq = lead.eq left join mg using (unit, month)""")
def unit_contribution(t):
    d = op.leader_contributions(leaders(t), sens(t), moves(t), ["eq"], "unit", "month", "delta")
    return rounded(d.select("month", "side", "eq", "unit", "bound_impact", "capacity_impact", "aligned"), ["bound_impact", "capacity_impact"], 4)


@query("c8_binding_panel", """
with f as (select l_partkey as eq, l_returnflag as link, round(max(l_discount) - 0.03, 2) as factor from lineitem group by 1, 2),
j as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax, (l_extendedprice - l_quantity * 1000) / abs(nullif(factor, 0)) as s, factor from lineitem left join f on eq = l_partkey)
select l_orderkey, l_linenumber, l_partkey as eq, l_suppkey, max((abs(l_tax) > 1e-9)::int) as binding, max(coalesce(s between 0 and 100000, false)::int) as near, count(factor) as links from j group by 1, 2, 3, 4
having max((abs(l_tax) > 1e-9)::int) = 1 or max(coalesce(s between 0 and 100000, false)::int) = 1""")
def binding_panel(t):
    sol = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("eq"), "l_suppkey", F.col("l_extendedprice").alias("rhs"),
                            (F.col("l_quantity") * 1000).alias("lhs"), F.col("l_tax").alias("mv"))
    f = t.lineitem.groupBy(F.col("l_partkey").alias("eq"), "l_returnflag").agg(F.round(F.max("l_discount") - 0.03, 2).alias("factor")).drop("l_returnflag")
    return op.binding_panel(sol, f, ["eq"], ["l_orderkey", "l_linenumber", "eq", "l_suppkey"], 100000)


@query("c9_generator_only_pressure", f"""with {UNITS}, lk as (select distinct l_partkey as eq from lineitem where l_discount >= 0.10),
g as (select * from terms where eq not in (select eq from lk)), tr as (select eq, unit, sum(f) as f from g group by 1, 2),
x as (select eq, unit, month, case when eq % 3 = 0 then -1 else 1 end * f * delta as u from tr join mg using (unit) where delta is not null),
m as (select eq, unit, avg(greatest(u, 0)) filter (month(month) <= 3) as tt, avg(greatest(u, 0)) filter (month(month) between 7 and 9) as tb, avg(greatest(-u, 0)) filter (month(month) <= 3) as rt, avg(greatest(-u, 0)) filter (month(month) between 7 and 9) as rb from x group by 1, 2)
select eq, unit, round(tt, 5) as tight_treated, round(tb, 5) as tight_base, round(tt - tb, 5) as excess_tightening, round(rt - rb, 5) as excess_relief from m""")
def generator_only_pressure(t):
    link = t.lineitem.filter("l_discount >= 0.10").select(F.col("l_partkey").alias("eq")).distinct()
    tr = terms(t).join(link, "eq", "left_anti").groupBy("eq", "unit").agg(F.sum("f").alias("f"))
    sign = F.when(F.col("eq") % 3 == 0, -1.0).otherwise(1.0)
    x = tr.join(moves(t).filter("delta is not null").select("unit", "month", "delta"), "unit").withColumn("u", sign * F.col("f") * F.col("delta"))
    m = F.month("month")
    on, off, u = m <= 3, m.between(7, 9), F.col("u")
    zero = F.lit(0.0)
    d = x.groupBy("eq", "unit").agg(F.avg(F.when(on, F.greatest(u, zero))).alias("tight_treated"), F.avg(F.when(off, F.greatest(u, zero))).alias("tight_base"),
                                    F.avg(F.when(on, F.greatest(-u, zero))).alias("_rt"), F.avg(F.when(off, F.greatest(-u, zero))).alias("_rb"))
    d = d.select("eq", "unit", "tight_treated", "tight_base", (F.col("tight_treated") - F.col("tight_base")).alias("excess_tightening"), (F.col("_rt") - F.col("_rb")).alias("excess_relief"))
    return rounded(d, ["tight_treated", "tight_base", "excess_tightening", "excess_relief"], 5)


LAYER = """ac as (select l_returnflag as side, date_trunc('month', l_shipdate) as month, l_shipdate as time, l_suppkey as eq, l_discount > 0.05 as active from lineitem),
av as (select side, month, count(distinct time) as n from ac group by 1, 2)"""


def layer(t):
    d = t.lineitem.select(F.col("l_returnflag").alias("side"), cal.month_start(F.col("l_shipdate")).alias("month"), F.col("l_shipdate").alias("time"),
                          F.col("l_suppkey").alias("eq"), "l_discount")
    return d.drop("l_discount"), d.filter("l_discount > 0.05").drop("l_discount")


@query("c10_activity_layer", f"with {LAYER} select side, month, eq, any_value(n) as available, round(count(distinct time) / any_value(n), 6) as share from ac join av using (side, month) where active group by 1, 2, 3")
def activity_layer(t):
    every, active = layer(t)
    return rounded(op.activity_layer(active, every, ["side"], "month", "time", "eq"), ["share"])


@query("c10_any_active", f"""with {LAYER}, a as (select side, month, count(distinct time) as c, max_by(eq, (time, eq)) as last_active from ac where active group by 1, 2)
select av.side, av.month, n as available, last_active, round(coalesce(c, 0) / n, 6) as any_share from av left join a on a.side = av.side and a.month = av.month""")
def any_active(t):
    every, active = layer(t)
    return rounded(op.any_active(active, every, ["side"], "month", "time", "eq"), ["any_share"])


@query("c11_own_share", f"""with {LAYER}, mem as (select s_suppkey from supplier where s_acctbal > 4000), a as (select side, month, count(distinct time) as c from ac where active and eq in (select s_suppkey from mem) group by 1, 2)
select av.side, av.month, round(coalesce(c, 0) / n, 6) as own_share from av left join a on a.side = av.side and a.month = av.month""")
def own_share(t):
    every, active = layer(t)
    own = active.join(t.supplier.filter("s_acctbal > 4000").select(F.col("s_suppkey").alias("eq")), "eq", "left_semi")
    return op.any_active(own, every, ["side"], "month", "time", "eq").select("side", "month", r6("any_share").alias("own_share"))


@query("c12_binds_sets_agreement", """
with i as (select distinct l_returnflag as side, l_shipdate as time, case when month(l_shipdate) <= 3 then 'treated' else 'control' end as arm from lineitem),
s as (select distinct l_returnflag as side, l_shipdate as time from lineitem where l_discount > 0.06), b as (select distinct l_returnflag as side, l_shipdate as time from lineitem where l_tax > 0.04)
select i.side, arm, count(*) as intervals, round(avg((s.time is not null and b.time is not null)::int), 6) as binds_and_sets, round(avg((s.time is null and b.time is not null)::int), 6) as binds_only,
  round(avg((s.time is not null and b.time is null)::int), 6) as sets_only, round(avg((s.time is null and b.time is null)::int), 6) as neither
from i left join s on s.side = i.side and s.time = i.time left join b on b.side = i.side and b.time = i.time group by 1, 2""")
def binds_sets_agreement(t):
    d = t.lineitem.select(F.col("l_returnflag").alias("side"), F.col("l_shipdate").alias("time"), "l_discount", "l_tax")
    i = d.select("side", "time", F.when(F.month("time") <= 3, "treated").otherwise("control").alias("arm")).distinct()
    out = op.agreement(i, d.filter("l_discount > 0.06"), d.filter("l_tax > 0.04"), ["side"], "time", "arm")
    return rounded(out, ["binds_and_sets", "binds_only", "sets_only", "neither"])


@query("c13_electrical_neighbours", f"""with {UNITS}, fm as (select p_partkey as eq, p_brand as family from part),
d as (select family, unit, s, sens.eq from sens join fm on fm.eq = sens.eq where abs(s) >= 0.05),
u as (select family, unit, max_by(s, (abs(s), s, eq)) as s, max_by(eq, (abs(s), s, eq)) as eq from d group by 1, 2),
r as (select *, row_number() over (partition by family order by abs(s) desc, unit) as rn from u)
select family, unit, round(s, 6) as sensitivity, eq from r where rn <= 10""")
def electrical_neighbours(t):
    fam = t.part.select(F.col("p_partkey").alias("eq"), F.col("p_brand").alias("family"))
    d = op.strongest_units(sens(t).join(fam, "eq"), ["family"], "unit", "eq", 0.05, 10)
    return rounded(d.select("family", "unit", "sensitivity", "eq"), ["sensitivity"])


GROUPS = """gm as (select l.l_returnflag as link, unit, quantile_cont(s, 0.5) as s from sens join (select distinct l_partkey, l_returnflag from lineitem) l on l_partkey = eq where s is not null group by 1, 2),
gr as (select *, case when s > 0 then 'positive' else 'negative' end as grp from gm where s <> 0),
gt as (select *, row_number() over (partition by link, grp order by abs(s) desc, unit) as rn from gr),
gw as (select link, grp, unit, s, abs(s) / sum(abs(s)) over (partition by link, grp) as w from gt where rn <= 3)"""


def groups(t):
    link = t.lineitem.select(F.col("l_partkey").alias("eq"), F.col("l_returnflag").alias("link")).distinct()
    return op.electrical_groups(sens(t).filter("sensitivity is not null").join(link, "eq"), "link", "unit", 3)


@query("c14_electrical_groups", f"""with {UNITS}, {GROUPS} select link, grp as "group", unit, round(s, 6) as sensitivity, round(w, 6) as weight from gw""")
def electrical_groups(t):
    return rounded(groups(t).select("link", "group", "unit", "sensitivity", "weight"), ["sensitivity", "weight"])


@query("c14_weighted_output", f"""with {UNITS}, {GROUPS}, n as (select link, grp, count(*) as need from gw group by 1, 2)
select gw.link, gw.grp as "group", month, case when count(*) = any_value(need) then round(sum(mw * w), 4) end as weighted_mw from gw join mw using (unit) join n on n.link = gw.link and n.grp = gw.grp group by 1, 2, 3""")
def weighted_output(t):
    from ..session import cut
    g = cut(groups(t), "groups")   # used twice: keep one evaluation
    return rounded(op.weighted_output(g, output(t), "link", "unit", "month", "mw"), ["weighted_mw"], 4)


@query("c15_sensitivity_matrix_audit", """
with r as (select l_partkey as version, case when l_linenumber = 7 then l_discount else 0.05 end - case when l_partkey % 11 = 0 then 0.05 else 0 end as a, l_tax as f, -l_tax / nullif(0.05, 0) * case when l_partkey % 13 = 0 and l_linenumber = 3 then 2 else 1 end as s from lineitem),
g as (select *, abs(a) >= 1e-8 as strong, coalesce(abs(a) >= 1e-8 and abs(s + f / nullif(a, 0)) <= 1e-7 * abs(f / nullif(a, 0)) + 1e-10 and abs(s) <= 100, false) as good from r)
select version, count(*) as rows, count(*) filter (not good) as bad_rows, case when count(*) filter (strong) = 0 then 'weak link factor'
  when max(a) filter (strong) - min(a) filter (strong) > 1e-7 * abs(min(a) filter (strong)) + 1e-10 then 'conflicting link factor' when count(*) filter (not good) > 0 then 'corrupt coefficient' else 'available' end as status from g group by 1""")
def sensitivity_matrix_audit(t):
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    a = F.when(line == 7, F.col("l_discount")).otherwise(0.05) - F.when(part % 11 == 0, 0.05).otherwise(0.0)
    s = -F.col("l_tax") / 0.05 * F.when((part % 13 == 0) & (line == 3), 2.0).otherwise(1.0)
    d = t.lineitem.select(part.alias("version"), F.when(a == 0, 0.0).otherwise(a).alias("a"), F.col("l_tax").alias("f"), s.alias("s"))
    d = d.withColumn("a", F.when(F.abs("a") < 1e-12, 0.0).otherwise(F.col("a")))
    return op.coefficient_audit(d.withColumn("a", F.nullif("a", F.lit(0.0))), "version", "a", "f", "s", weak=1e-8, extreme=100)


@query("c16_excess_pressure", """
with r as (select l_returnflag as family, l_suppkey as unit, case when month(l_shipdate) <= 2 then 'treated' when month(l_shipdate) <= 6 then 'base' end as arm, l_shipdate, l_quantity - 25 as x from lineitem),
n as (select family, count(distinct l_shipdate) filter (arm = 'treated') as tn, count(distinct l_shipdate) filter (arm = 'base') as bn from r group by 1),
s as (select r.family, unit, coalesce(sum(greatest(x, 0)) filter (arm = 'treated'), 0) / any_value(tn) - coalesce(sum(greatest(x, 0)) filter (arm = 'base'), 0) / any_value(bn) as et,
  coalesce(sum(greatest(-x, 0)) filter (arm = 'treated'), 0) / any_value(tn) - coalesce(sum(greatest(-x, 0)) filter (arm = 'base'), 0) / any_value(bn) as er from r join n using (family) group by 1, 2)
select family, unit, round(et, 6) as excess_tight, round(er, 6) as excess_relief from (select *, row_number() over (partition by family order by round(abs(et) + abs(er), 9) desc, unit) as rn from s) where rn <= 10""")
def excess_pressure(t):
    x, m = F.col("l_quantity") - 25, F.month("l_shipdate")
    r = t.lineitem.select(F.col("l_returnflag").alias("family"), F.col("l_suppkey").alias("unit"), "l_shipdate",
                          F.when(m <= 2, "treated").when(m <= 6, "base").alias("arm"), F.greatest(x, F.lit(0.0)).alias("tight"), F.greatest(-x, F.lit(0.0)).alias("relief"))
    n = r.groupBy("family").agg(F.countDistinct(F.when(F.col("arm") == "treated", F.col("l_shipdate"))).alias("treated_n"),
                                F.countDistinct(F.when(F.col("arm") == "base", F.col("l_shipdate"))).alias("base_n"))
    return rounded(op.excess_pressure(r, ["family"], "unit", "arm", n, 10), ["excess_tight", "excess_relief"])
