"""Conditional selection, clusters and model fits on the driver tables."""
from __future__ import annotations

import math

import numpy as np

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import boosting as bo
from ..operators import clusters as cl
from ..operators import forecast as fo
from ..operators import mixtures as mx
from ..operators import models as ml
from ..operators import ranks
from ..operators import regimes as op
from ..operators import spectral as sp
from ..session import cut
from . import constraints as con
from .aggregates import rounded
from .joins import CHAIN, chain
from .registry import query
from .standins import FC, GRID, blended, grid, r6, ts

HIST = GRID + """, hs as (select key, time, v, k, coalesce(setter::varchar, 'none') as state, hour(time) as slot, strftime(time, '%Y-%m-%d') as day from grid),
cn as (select key || '|' || strftime(time, '%Y%m%d%H') as cid, key, state, slot as q_slot, k as q_k from hs where time >= '2024-01-26' and time < '2024-01-28')"""


def history(t):
    return grid(t).select("key", "time", "v", F.col("k").cast("double").alias("k"), F.coalesce(F.col("setter").cast("string"), F.lit("none")).alias("state"), F.hour("time").alias("slot"),
                          F.date_format("time", "yyyy-MM-dd").alias("day"))


def conditions(t):
    h = history(t).filter((F.col("time") >= ts("2024-01-26")) & (F.col("time") < ts("2024-01-28")))
    return h.select(F.concat("key", F.lit("|"), F.date_format("time", "yyyyMMddHH")).alias("cid"), "key", "state", F.col("slot").alias("q_slot"), F.col("k").alias("q_k"))


def wq(rows, name, cid="cid", ties=False):
    """SQL of the mid-point weighted quantile over rows(cid, v, rid, w).  With ties, rows whose weight is lost in the sum share a mid-point
    and are told apart as in the query: the largest value at or below a probability, the smallest at or above it."""
    mid = "(mid, v)" if ties else "mid"
    ps = (0.1, 0.5, 0.9)
    cols = ", ".join(f"case when max(mid) filter (mid <= {p}) is null then min(v) when min(mid) filter (mid >= {p}) is null then max(v) when max(mid) filter (mid <= {p}) = min(mid) filter (mid >= {p}) then arg_min(v, {mid}) filter (mid >= {p}) "
                     f"else arg_max(v, {mid}) filter (mid <= {p}) + (arg_min(v, {mid}) filter (mid >= {p}) - arg_max(v, {mid}) filter (mid <= {p})) * ({p} - max(mid) filter (mid <= {p})) / (min(mid) filter (mid >= {p}) - max(mid) filter (mid <= {p})) end as p{int(p * 100)}" for p in ps)
    return f"""{name}m as (select {cid}, v, (sum(w) over (partition by {cid} order by v, rid) - w / 2) / sum(w) over (partition by {cid}) as mid from {rows}), {name} as (select {cid}, {cols} from {name}m group by 1)"""


ANALOGUE = """h2 as (select * from hs where time < '2024-01-26' and v is not null), cd as (select cn.*, h2.v, h2.k, h2.day, h2.time as rid, least(abs(h2.slot - q_slot), 24 - abs(h2.slot - q_slot)) as sd from {cn} cn join h2 on h2.key = cn.key and h2.state = cn.state and least(abs(h2.slot - q_slot), 24 - abs(h2.slot - q_slot)) <= 2),
dd as (select *, ((sd / 2) ^ 2 + case when q_k is null then 0 else coalesce(((k - q_k) / 30) ^ 2, 16) end) / (1 + (q_k is not null)::int) as d2, q_k is null or coalesce(abs(k - q_k) <= 30, false) as x from cd),
ed as (select cid, count(distinct day) filter (x) as exact_days from dd group by 1), fd as (select dd.*, exact_days from dd join ed using (cid) where x or exact_days < 3),
nr as (select cid, day, row_number() over (partition by cid order by round(min(d2), 9), day) as rn from fd group by 1, 2), sl as (select fd.*, exp(-0.5 * least(sqrt(d2), 20) ^ 2) as w0 from fd join nr using (cid, day) where rn <= 8),
wt as (select *, w0 / sum(w0) over (partition by cid, day) as w from sl), sm as (select cid, max(exact_days) as exact_days, count(distinct day) as analogue_days, sum(case when v < 20 then w else 0 end) / sum(w) as restricted_share, count(*) as rows from wt group by 1)"""
PICK = """select {c}.cid, exact_days, analogue_days, round(restricted_share, 6) as restricted_share, rows, round(p10, 5) as p10, round(p50, 5) as p50, round(p90, 5) as p90,
  case when rows is null then 'unavailable' when exact_days >= 3 then 'supported_analogue' else 'broader_analogue' end as status from {c} left join sm using (cid) left join q using (cid)"""
PROBS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def analogues(t, cond):
    h = history(t).filter((F.col("time") < ts("2024-01-26")) & F.col("v").isNotNull()).withColumn("rid", F.col("time"))
    d = op.select_analogues(cond, h, "cid", ["key", "state"], "slot", 24, 2, {"k": 30.0}, "v", "day", "rid", neighbour_days=8, min_days=3, threshold=20.0, probs=PROBS)
    return rounded(rounded(d, ["restricted_share"]), ["p10", "p50", "p90"], 5)


@query("g1_analogue_select", f"with {HIST}, {ANALOGUE.format(cn='cn')}, {wq('wt', 'q', ties=True)} {PICK.format(c='cn')}")
def analogue_select(t):
    return analogues(t, conditions(t))


@query("g2_conditional_table", f"""with {HIST}, d as (select cid, v, day from cn join hs h on h.key = cn.key and h.state = cn.state and h.slot = q_slot where h.time < '2024-01-26' and h.v is not null and (q_k is null or abs(h.k - q_k) <= 60)),
s as (select cid, count(distinct day) as days, count(*) as rows, quantile_cont(v, 0.1) as p10, quantile_cont(v, 0.5) as p50, quantile_cont(v, 0.9) as p90 from d group by 1)
select cn.cid, days, rows, round(p10, 5) as p10, round(p50, 5) as p50, round(p90, 5) as p90, case when rows is null then 'unavailable' when days >= 3 then 'supported_table' else 'indicative_table' end as status from cn left join s using (cid)""")
def conditional_table(t):
    h = history(t).filter((F.col("time") < ts("2024-01-26")) & F.col("v").isNotNull())
    return rounded(op.conditional_table(conditions(t), h, "cid", ["key", "state"], "slot", 24, {"k": 60.0}, "v", "day", 3, PROBS), ["p10", "p50", "p90"], 5)


@query("g3_weighted_quantile", f"""with wt as (select l_returnflag as cid, l_extendedprice as v, l_orderkey * 10 + l_linenumber as rid, sum(l_quantity) as w from lineitem group by 1, 2, 3), {wq('wt', 'q')} select cid as l_returnflag, round(p10, 4) as p10, round(p50, 4) as p50, round(p90, 4) as p90 from q""")
def weighted_quantile(t):
    d = t.lineitem.withColumn("rid", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return rounded(ranks.weighted_quantiles(d, ["l_returnflag"], "l_extendedprice", "l_quantity", "rid", PROBS), ["p10", "p50", "p90"], 4)


@query("g4_repeat_count", f"""with recursive {CHAIN}, walk as (select id, id as fin, nxt from link union all select walk.id, link.id, link.nxt from walk join link on walk.nxt = link.id), fi as (select id, fin from walk where nxt is null)
select l_returnflag, 's' || (l_suppkey % 20) as token, count(distinct fin) as repeats from lineitem join fi on id = l_orderkey group by 1, 2""")
def repeat_count(t):
    from ..operators.lookups import final_of_chain
    fin = final_of_chain(chain(t), "id", "nxt").select(F.col("id").alias("episode"), F.col("final_id").alias("canonical_id"))
    token = F.concat(F.lit("s"), (F.col("l_suppkey") % 20).cast("string"))
    toks = t.lineitem.groupBy(F.col("l_orderkey").alias("episode")).agg(F.collect_set(token).alias("tokens"))
    rows = t.lineitem.select("l_returnflag", token.alias("token"), F.array("l_orderkey").alias("episodes"))
    return op.repeat_counts(rows, fin.join(toks, "episode"), ["l_returnflag"], "episodes", "token")


@query("g5_profile48", f"""with {HIST}, cp as (select key || '|' || s as cid, key, state, s as q_slot, null::double as q_k from (select distinct key, '0' as state from hs) x, range(0, 24) r(s)), {ANALOGUE.format(cn='cp')}, {wq('wt', 'q')} {PICK.format(c='cp')}""")
def profile48(t):
    c = history(t).select("key").distinct().withColumns({"state": F.lit("0"), "q_slot": F.explode(F.sequence(F.lit(0), F.lit(23)))})
    c = c.withColumns({"cid": F.concat_ws("|", "key", "q_slot"), "q_k": F.lit(None).cast("double")})
    return analogues(t, c)


@query("g6_condition_settings", f"""with {HIST}, tr as (select key, v, k::double as k, hour(time)::double as h from hs where time < '2024-01-20'), l as (select key, unnest(['v', 'k', 'h']) as feature, unnest([v, k, h]) as x from tr), th as (select key, 0.5 * quantile_cont(v, 0.5) as threshold from tr where v > 0 group by 1)
select key, feature, round(quantile_cont(x, 0.5), 6) as median, round(greatest(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 1e-3), 6) as scale, min(x) as low, max(x) as high, round(quantile_cont(x, 0.2), 6) as p20, round(quantile_cont(x, 0.8), 6) as p80, round(any_value(threshold), 6) as threshold
from l join th using (key) where x is not null group by 1, 2 having max(x) > min(x)""")
def condition_settings(t):
    tr = history(t).filter(F.col("time") < ts("2024-01-20")).select("key", "v", "k", F.hour("time").cast("double").alias("h"))
    return rounded(op.condition_settings(tr, ["key"], ["v", "k", "h"], "v"), ["median", "scale", "p20", "p80", "threshold"])


@query("g7_input_eligibility", """with d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(l_shipdate >= timestamp '1996-01-01', false) as a, l_quantity <= 48 as b, l_returnflag in ('A', 'N') as c from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([case when not a then 'too old' end, case when not b then 'out of range' end, case when not c then 'unknown region' end], lambda x: x is not null), ';') as rejected_for, (a and b and c)::int as eligible from d""")
def input_eligibility(t):
    d = op.input_eligibility(t.lineitem, {"too old": F.col("l_shipdate") >= ts("1996-01-01"), "out of range": F.col("l_quantity") <= 48, "unknown region": F.col("l_returnflag").isin("A", "N")})
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rejected_for", "eligible")


@query("g8_state_clusters")
def state_clusters(t):
    """k-means states of supplier-months; iterative, so rows only here and bounds in the tests."""
    d = t.lineitem.groupBy("l_suppkey", cal.month_start(F.col("l_shipdate")).alias("month")).agg(F.sum("l_quantity").alias("mw"), F.avg("l_discount").alias("disc"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))).alias("tax"))
    return cl.state_clusters(d.filter(F.col("month") < ts("1999-01-01")), d, ["mw", "disc", "tax"], 4)


STATES = """d as (select l_suppkey, date_trunc('month', l_shipdate) as month, sum(l_quantity) as mw, avg(l_discount) as disc, avg(case when l_returnflag = 'R' then l_tax end) as tax from lineitem group by 1, 2),
tr as (select * from d where month < '1999-01-01'), md as (select median(mw) as m1, median(disc) as m2, median(tax) as m3 from tr),
im as (select l_suppkey, month, coalesce(mw, m1) as x1, coalesce(disc, m2) as x2, coalesce(tax, m3) as x3 from d, md),
sc as (select quantile_cont(x1, 0.5) as c1, quantile_cont(x1, 0.75) - quantile_cont(x1, 0.25) as s1, quantile_cont(x2, 0.5) as c2, quantile_cont(x2, 0.75) - quantile_cont(x2, 0.25) as s2,
  quantile_cont(x3, 0.5) as c3, quantile_cont(x3, 0.75) - quantile_cont(x3, 0.25) as s3 from im where month < '1999-01-01'),
z as (select l_suppkey, month, greatest(least((x1 - c1) / s1, 10), -10) as z1, greatest(least((x2 - c2) / s2, 10), -10) / sqrt(2) as z2, greatest(least((x3 - c3) / s3, 10), -10) / sqrt(2) as z3 from im, sc)"""
MIX = ((-1.0, -0.3, 0.2), (1.0, 0.4, -0.2), (0.0, 0.0, 1.0))
LOGS = "ln(p) - 0.5 * (" + " + ".join(f"ln(2 * pi() * v{c}) + (z{c} - m{c}) ^ 2 / v{c}" for c in (1, 2, 3)) + ") as l"
EM = ", ".join(f"""l{r} as (select l_suppkey, month, z1, z2, z3, k, {LOGS} from z, p{r} where month < '1999-01-01'), r{r} as (select *, exp(l - max(l) over w) / sum(exp(l)) over w * exp(max(l) over w) as r from l{r} window w as (partition by l_suppkey, month)),
p{r + 1} as (select k, sum(r) / (select count(*) from z where month < '1999-01-01') as p, """ + ", ".join(f"sum(r * z{c}) / sum(r) as m{c}, sum(r * z{c} * z{c}) / sum(r) - (sum(r * z{c}) / sum(r)) ^ 2 + 1e-6 as v{c}" for c in (1, 2, 3)) + f" from r{r} group by k)" for r in range(2))


def months(t):
    """Training rows and all rows of the supplier months; a fit reads them many times, so they are written once."""
    d = t.once("months", _months)
    return d.filter(F.col("month") < ts("1999-01-01")), d


def _months(t):
    return t.lineitem.groupBy("l_suppkey", cal.month_start(F.col("l_shipdate")).alias("month")).agg(F.sum("l_quantity").alias("mw"), F.avg("l_discount").alias("disc"), F.avg(F.when(F.col("l_returnflag") == "R", F.col("l_tax"))).alias("tax"))


GROUPS = {"volume": ["mw"], "rates": ["disc", "tax"]}


@query("g8_state_mixture", f"""with {STATES}, p0 as (select * from (values {", ".join(f"({k}, {1 / 3!r}, {a}, {b}, {c}, 1.0, 1.0, 1.0)" for k, (a, b, c) in enumerate(MIX))}) x(k, p, m1, m2, m3, v1, v2, v3)), {EM},
f as (select l_suppkey, month, k, {LOGS}, (z1 - m1) ^ 2 / v1 + (z2 - m2) ^ 2 / v2 + (z3 - m3) ^ 2 / v3 as d2 from z, p2), g as (select *, exp(l - max(l) over w) / sum(exp(l - (select max(l) from f))) over w * exp(max(l) over w - (select max(l) from f)) as q from f window w as (partition by l_suppkey, month))
select l_suppkey, month, round(max(q) filter (k = 0), 5) as p0, round(max(q) filter (k = 1), 5) as p1, round(max(q) filter (k = 2), 5) as p2, round(sqrt(arg_max(d2, l)), 5) as distance from g group by 1, 2""")
def state_mixture(t):
    """Two rounds of the diagonal mixture from stated centres, on exact medians and quartiles and equal weight of both feature groups."""
    train, every = months(t)
    model = mx.prepare(train, GROUPS)
    model.means, model.variances, model.shares = np.array(MIX), np.ones((3, 3)), np.full(3, 1 / 3)
    model, _ = mx.em_steps(cut(train.select(mx.scaled(model).alias("z")), "states"), model, 2)
    d = mx.assign(every, model)
    return d.select("l_suppkey", "month", *[F.round(F.get("probabilities", k), 5).alias(f"p{k}") for k in range(3)], F.round("distance", 5).alias("distance"))


@query("g8_fitted_states")
def fitted_states(t):
    """The mixture fitted to its end from the best of three k-means starts; tests hold it against bounds."""
    train, every = months(t)
    d = mx.assign(every, mx.fit_states(train, GROUPS, 3, "mixture", steps=20))
    return d.select("l_suppkey", "month", "cluster", F.round("distance", 4).alias("distance"), "out_of_range")


@query("g9_cluster_stability")
def cluster_stability(t):
    """Agreement of supplier-month states over seeds and over refits on drawn months."""
    train, _ = months(t)
    return rounded(mx.stability(train, GROUPS, 3, "month", steps=15), ["ari"], 4)


@query("g9_adjusted_rand", """with c as (select l_returnflag as a, (l_quantity > 25)::int + (l_discount > 0.05)::int as b, count(*)::double as n from lineitem group by 1, 2), s as (select sum(n * (n - 1) / 2) as ab, sum(n) as n from c),
a as (select sum(n * (n - 1) / 2) as x from (select sum(n) as n from c group by a)), b as (select sum(n * (n - 1) / 2) as y from (select sum(n) as n from c group by b))
select round((ab - x * y / (s.n * (s.n - 1) / 2)) / ((x + y) / 2 - x * y / (s.n * (s.n - 1) / 2)), 9) as ari from s, a, b""")
def adjusted_rand(t):
    d = t.lineitem.select(F.col("l_returnflag").alias("a"), ((F.col("l_quantity") > 25).cast("int") + (F.col("l_discount") > 0.05).cast("int")).alias("b"))
    return rounded(cl.adjusted_rand(d, "a", "b"), ["ari"], 9)


@query("g10_cluster_support", """with x as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings), c as (select label, i, avg(v) as m from x group by 1, 2), d as (select vec_id, label, sqrt(sum((v - m) ^ 2)) as dist from x join c using (label, i) group by 1, 2)
select label, count(*) as rows, count(distinct vec_id % 28) as days, round(avg((round(dist, 6) > 0.9)::int), 6) as ood_share, round(quantile_cont(dist, 0.5), 6) as median_distance, round(quantile_cont(dist, 0.95), 6) as p95_distance, round(count(*) / (select count(*) from d), 6) as row_share from d group by 1""")
def cluster_support(t):
    d = cl.centroid_distance(t.embeddings, "vec_id", "embedding", "label").withColumns({"day": F.col("vec_id") % 28, "flag": (F.round("distance", 6) > 0.9).cast("int")})
    return rounded(cl.cluster_support(d, "label", "day", "distance", "flag"), ["ood_share", "median_distance", "p95_distance", "row_share"])


@query("g11_unit_groups")
def unit_groups(t):
    """k-means over exposure-weighted sensitivities; iterative, rows only."""
    w = con.present(t).groupBy("eq").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return cl.unit_groups(con.sens(t).filter("sensitivity is not null"), w, "unit", "eq", 16, 3)


@query("g11_unit_components")
def unit_components(t):
    """Signed components of units over exposure-weighted sensitivities; tests hold them against a dense decomposition."""
    w = con.present(t).groupBy("eq").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    d = con.sens(t).filter("sensitivity is not null").join(w, "eq").withColumn("x", F.col("sensitivity") * F.col("weight"))
    return rounded(sp.signed_components(d, "unit", "eq", "x", 3, rounds=8), ["loading", "singular_value"], 3)


@query("g11_signed_pressure", f"""with {con.UNITS}, su as (select unit, avg(s) as s from sens group by 1) select unit % 3 as "group", month, round(sum(greatest(delta * s, 0)), 5) as relief, round(sum(greatest(-delta * s, 0)), 5) as tightening from mg join su using (unit) where delta is not null group by 1, 2""")
def signed_pressure(t):
    g = t.supplier.select(F.col("s_suppkey").alias("unit"), (F.col("s_suppkey") % 3).alias("group"))
    return rounded(cl.signed_pressure(g, con.moves(t), con.sens(t), "unit", "month", "delta"), ["relief", "tightening"], 5)


# ----- fits

def fit_rows(t):
    d = blended(t).filter("actual is not null and persistence is not null and seasonal is not null")
    return d.withColumns({"hour": F.hour("time").cast("double"), "lead_h": F.col("lead").cast("double")})


CUT = "2024-01-22"


@query("l1_limit_regressor")
def limit_regressor(t):
    """Boosted trees with absolute loss on lag features; quality is bounded in the tests."""
    d = cut(fit_rows(t), "fit")
    return ml.boosted_regressor(d.filter(F.col("time") < ts(CUT)), d.filter(F.col("origin") >= ts(CUT)), ["persistence", "seasonal", "hour", "lead_h"], "actual", trees=8, depth=3).select(
        "key", "origin", "lead", "actual", r6("prediction", 3).alias("prediction"))


@query("l1_limit_targets")
def limit_targets(t):
    """Three targets on each key's own scale, in the same jobs; 12 trees of up to 23 leaves here."""
    g = grid(t).select("key", "time", F.col("n").cast("double").alias("count_"), F.col("k").cast("double").alias("load"))
    d = cut(fit_rows(t).join(g, ["key", "time"], "left"), "fit")
    train = F.col("time") < ts(CUT)
    names = {"p_actual": "actual", "p_count": "count_", "p_load": "load"}
    scale = d.filter(train).groupBy("key").agg(*[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"_s_{c}") for c in names.values()])
    d = d.join(scale, "key").withColumns({f"_y_{c}": F.col(c) / F.col(f"_s_{c}") for c in names.values()})
    model = bo.fit(d.filter(train), ["persistence", "seasonal", "hour", "lead_h"], [bo.Target(n, f"_y_{c}") for n, c in names.items()], trees=12, rate=0.2, depth=5, leaves=23, leaf_rows=40, penalty=5.0)
    out = bo.predict(d.filter(F.col("origin") >= ts(CUT)), model)
    return out.select("key", "origin", "lead", "actual", *[F.round(F.col(n) * F.col(f"_s_{c}"), 3).alias(n) for n, c in names.items()])


@query("l2_ridge_correction")
def ridge_correction(t):
    d = cut(fit_rows(t), "fit")
    return ml.anchored_ridge(d.filter(F.col("time") < ts(CUT)), d.filter(F.col("origin") >= ts(CUT)), ["seasonal", "hour", "lead_h"], "actual", "persistence", 0.1).select(
        "key", "origin", "lead", "actual", r6("prediction", 3).alias("prediction"))


@query("l3_local_experts", f"""with tr as (select l_suppkey as c, l_quantity as x, l_extendedprice / 1000 as y, l_shipdate from lineitem), f as (select * from tr where l_shipdate < '1999-01-01'),
o as (select c, count(*) as n, avg(x) as mx, avg(y) as my, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 5) as s from f group by 1), p as (select avg(x) as mx, avg(y) as my, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 5) as s from f),
w as (select o.*, my - s * mx as i, case when n >= 200 then n / (n + 100) else 0 end as w from o)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((coalesce(w.w * w.s, 0) + (1 - coalesce(w.w, 0)) * p.s) * l_quantity + coalesce(w.w * w.i, 0) + (1 - coalesce(w.w, 0)) * (p.my - p.s * p.mx), 6) as prediction from lineitem left join w on w.c = l_suppkey, p where l_shipdate >= '1999-01-01'""")
def local_experts(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    early = F.col("l_shipdate") < ts("1999-01-01")
    return ml.shrunk_experts(d.filter(early), d.filter(~early), "l_suppkey", "x", "y", 5.0, 200, 100.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("prediction").alias("prediction"))


def _ridge_sql(name, rows, xs, y, alpha):
    """Slopes b1.. and intercept a of a ridge on one or two features by the closed form."""
    n = len(xs)
    s = lambda i, j: f"covar_pop({i}, {j}) * count(*)"      # noqa: E731
    if n == 1:
        return f"{name}_s as (select avg({xs[0]}) as m1, avg({y}) as my, {s(xs[0], xs[0])} + {alpha} as s11, {s(xs[0], y)} as t1 from {rows}), {name} as (select t1 / s11 as b1, my - t1 / s11 * m1 as a from {name}_s)"
    return (f"{name}_s as (select avg({xs[0]}) as m1, avg({xs[1]}) as m2, avg({y}) as my, {s(xs[0], xs[0])} + {alpha} as s11, {s(xs[1], xs[1])} + {alpha} as s22, {s(xs[0], xs[1])} as s12, {s(xs[0], y)} as t1, {s(xs[1], y)} as t2 from {rows}), "
            f"{name}_b as (select *, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) as b1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) as b2 from {name}_s), {name} as (select b1, b2, my - b1 * m1 - b2 * m2 as a from {name}_b)")


@query("l3_residual_stage", f"""with {FC}, rw as (select *, sin(hour(time) * pi() / 12) as hs, cos(hour(time) * pi() / 12) as hc from fb where actual is not null and blend is not null), tr as (select * from rw where time < '{CUT}'),
og as (select origin, row_number() over (order by origin) - 1 as i from (select distinct origin from tr)), sp as (select origin as split from og where i = floor((select count(*) from og) * 0.75)),
ea as (select tr.* from tr, sp where origin < split - interval 8 days), {_ridge_sql("fa", "ea", ["blend"], "actual", 0.5)}, la as (select tr.*, actual - (a + b1 * blend) as rest from tr, sp, fa where origin >= split), {_ridge_sql("fb2", "la", ["hs", "hc"], "rest", 0.5)}, {_ridge_sql("fc2", "tr", ["blend"], "actual", 0.5)}
select key, origin, lead, actual, round(fc2.a + fc2.b1 * blend + fb2.a + fb2.b1 * hs + fb2.b2 * hc, 5) as prediction from rw, fb2, fc2 where origin >= '{CUT}'""")
def residual_stage(t):
    d = blended(t).filter("actual is not null and blend is not null").withColumns({"hs": F.sin(F.hour("time") * (math.pi / 12)), "hc": F.cos(F.hour("time") * (math.pi / 12))})
    d = cut(d, "fit")
    out = ml.residual_stage(d.filter(F.col("time") < ts(CUT)), d.filter(F.col("origin") >= ts(CUT)), "origin", ["blend"], ["hs", "hc"], "actual", 0.5)
    return out.select("key", "origin", "lead", "actual", r6("prediction", 5).alias("prediction"))


def warn_rows(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_discount", "l_tax", ((F.col("l_extendedprice") > 60000) & (F.col("l_quantity") > 10)).cast("double").alias("y"))


@query("l4_event_probability")
def event_probability(t):
    d = warn_rows(t)
    s = F.col("l_shipdate")
    return ml.event_probability(d.filter(s < ts("1998-01-01")), d.filter((s >= ts("1998-01-01")) & (s < ts("1999-01-01"))), d.filter(s >= ts("1999-01-01")), ["l_quantity", "l_discount", "l_tax"], "y").select(
        "l_orderkey", "l_linenumber", "y", r6("probability", 5).alias("probability"))


@query("l5_setter_ranker")
def setter_ranker(t):
    s = F.col("l_shipdate")
    folds = [(s < ts(f"{y}-01-01"), (s >= ts(f"{y}-01-01")) & (s < ts(f"{y + 1}-01-01"))) for y in (1998, 2000)]
    return ml.cross_fitted(warn_rows(t), folds, ["l_quantity", "l_discount"], "y").select("l_orderkey", "l_linenumber", "y", r6("probability", 5).alias("probability"))


@query("l6_pressure_forecast", """
with d as (select l_returnflag as g, date_trunc('month', l_shipdate) as m, l_quantity as x, l_extendedprice / 1000 as y, l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem), s as (select g, m, count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * x) as sxx, sum(x * y) as sxy from d group by 1, 2),
c as (select g, m, sum(n) over w as n, sum(sx) over w as sx, sum(sy) over w as sy, sum(sxx) over w as sxx, sum(sxy) over w as sxy from s window w as (partition by g order by m rows between unbounded preceding and 1 preceding)),
f as (select g, m, n, sx, sy, (sxy - sx * sy / n) / (sxx - sx * sx / n + 2) as b from c)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((sy - b * sx) / n + b * x, 5) as prediction from d join f using (g, m)""")
def pressure_forecast(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("g"), cal.month_start(F.col("l_shipdate")).alias("m"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return ml.expanding_lines(d, ["g"], "m", "x", "y", 2.0).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("prediction", 5).alias("prediction"))


@query("l7_block_permutation", f"""with {GRID}, j as (select a.key, a.v, 5 + 0.5 * a.k + 2 * a.n as base, 5 + 0.5 * b.k + 2 * a.n as alt from grid a join grid b on b.key = a.key and b.time = a.time - interval 7 days where a.v is not null and a.k is not null and b.k is not null and a.n is not null)
select key, count(*) as n, round(avg(abs(v - base)), 6) as base_mae, round(avg(abs(v - alt)), 6) as moved_mae, round(avg(abs(v - alt)) - avg(abs(v - base)), 6) as increase from j group by 1""")
def block_permutation(t):
    g = grid(t).select("key", "time", "v", F.col("k").cast("double").alias("k"), F.col("n").cast("double").alias("cnt"))
    return rounded(ml.block_permutation(g, ["key"], "time", {"k": 0.5, "cnt": 2.0}, 5.0, "v", ["k"], 7), ["base_mae", "moved_mae", "increase"])


@query("l8_chronological_train")
def chronological_train(t):
    d = cut(fit_rows(t), "fit")
    return ml.chronological_search(d.filter(F.col("time") < ts("2024-01-18")), d.filter((F.col("origin") >= ts("2024-01-18")) & (F.col("time") < ts(CUT))), ["persistence", "seasonal", "hour"], "actual", [0.0, 0.1, 1.0])


@query("l9_pooled_transfer")
def pooled_transfer(t):
    d = cut(fit_rows(t), "fit")
    return ml.pooled_transfer(d, "key", F.col("time") < ts(CUT), ["persistence", "seasonal", "hour"], "actual", 0.1).filter(F.col("origin") >= ts(CUT)).select("key", "origin", "lead", "actual", r6("prediction", 3).alias("prediction"))


@query("l10_conditional_quantiles", f"""with {FC}, b as (select *, actual - blend as r, (hour(time) // 6) as part from fb), tr as (select key, part, r from b where origin < '{CUT}' and time < '{CUT}' and r is not null), q as (select key, part, quantile_cont(r, 0.1) as a, quantile_cont(r, 0.9) as z from tr group by 1, 2 having count(*) >= 20), g as (select quantile_cont(r, 0.1) as a, quantile_cont(r, 0.9) as z from tr)
select b.key, origin, lead, round(blend + coalesce(q.a, g.a), 6) as p10, round(blend + coalesce(q.z, g.z), 6) as p90 from b left join q on q.key = b.key and q.part = b.part, g where origin >= '{CUT}' and blend is not null""")
def conditional_quantiles(t):
    d = blended(t).filter("blend is not null").withColumn("part", F.floor(F.hour("time") / 6))
    train = d.filter((F.col("origin") < ts(CUT)) & (F.col("time") < ts(CUT)) & F.col("actual").isNotNull())
    own, pooled = fo.residual_adjustments(train, ["key", "part"], "actual", "blend", {"p10": 0.1, "p90": 0.9}, 20)
    out = fo.calibrated(d.filter(F.col("origin") >= ts(CUT)), own, pooled, ["key", "part"], "blend", ["p10", "p90"])
    return rounded(out.select("key", "origin", "lead", "p10", "p90"), ["p10", "p90"])


@query("l10_boosted_quantiles")
def boosted_quantiles(t):
    """p10, p50 and p90 from conditions and the keys that stood high two hours before the origin, calibrated on the last days before the cut."""
    g = grid(t).filter("v is not null")
    mean = g.filter(F.col("time") < ts(CUT)).groupBy("key").agg(F.avg("v").alias("_m"))
    high = g.join(mean, "key").filter("v > 1.25 * _m").groupBy((F.col("time") + F.expr("interval 2 hours")).alias("origin")).agg(F.array_sort(F.collect_set("key")).alias("high"))
    d = blended(t).filter("blend is not null").join(high, "origin", "left").withColumns({"lead_h": F.col("lead").cast("double"), "high": F.coalesce("high", F.array().cast("array<string>")),
        **{f"is_{k}": (F.col("key") == k).cast("int") for k in ("click", "error", "purchase", "signup", "view")}, "hour_sin": F.sin(F.hour("time") * (math.pi / 12)), "hour_cos": F.cos(F.hour("time") * (math.pi / 12))})
    d = cut(d, "conditions")
    known = F.col("actual").isNotNull() & (F.col("origin") < ts(CUT)) & (F.col("time") < ts(CUT))
    late = F.col("origin") >= ts("2024-01-19")
    found = bo.token_flags(d.filter(known & ~late), "high")
    d, flags = bo.with_flags(d, "high", found)
    shares = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    features = ["persistence", "seasonal", "blend", "lead_h", "hour_sin", "hour_cos", "is_click", "is_error", "is_purchase", "is_signup", "is_view", *flags]
    model = bo.fit(d.filter(known & (F.col("time") < ts("2024-01-19"))), features, [bo.Target(n, "actual", s) for n, s in shares.items()], trees=12, rate=0.2)
    every = cut(bo.predict(d, model), "predicted")
    out = bo.calibrated(every.filter(F.col("origin") >= ts(CUT)), every.filter(known & late), "actual", shares)
    return rounded(out.select("key", "origin", "lead", "p10", "p50", "p90"), ["p10", "p50", "p90"])
