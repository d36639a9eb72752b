"""Contraction events: detection, landmarks, catalogue and attribution."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import null_safe_join, quantiles
from .revisions import top_k
from .sequence import windowed


def falls(df: DataFrame, keys: list[str], t: str, value: str, lag: int, reach: str) -> DataFrame:
    """Fall over ``lag`` steps and whether every step of that window is known."""
    def cols(w):
        return {"drop": F.lag(value, lag).over(w) - F.col(value), "complete": F.count(value).over(w.rowsBetween(-lag, 0)) == lag + 1}
    return windowed(df, keys, t, cols, before=reach)


def sharp_onsets(d: DataFrame, keys: list[str], t: str, reach: str, need_known_before: bool = False) -> DataFrame:
    """Flag sharp rows (complete, positive, at or over threshold) and their first row."""
    sharp = F.coalesce(F.col("complete") & (F.col("drop") > 0) & (F.col("drop") >= F.col("threshold")), F.lit(False))
    d = d.withColumn("sharp", sharp)

    def cols(w):
        first = F.col("sharp") & ~F.coalesce(F.lag("sharp").over(w), F.lit(False))
        if need_known_before:
            first = first & F.coalesce(F.lag("complete").over(w), F.lit(False))
        return {"onset": first}
    return windowed(d, keys, t, cols, before=reach)


def contractions(df: DataFrame, keys: list[str], t: str, value: str, period: str, *, lag: int, reach: str, p: float = 0.9,
                 minimum: int = 100) -> DataFrame:
    """Sharp falls against the period's own upper quantile of positive falls."""
    d = falls(df, keys, t, value, lag, reach)
    th = quantiles(d.filter("drop > 0"), [*keys, period], "drop", {"threshold": p})
    th = th.withColumn("threshold", F.when(F.col("n_values") >= minimum, F.col("threshold"))).drop("n_values")
    return sharp_onsets(d.join(th, [*keys, period], "left"), keys, t, reach)


def frozen_contractions(df: DataFrame, keys: list[str], t: str, value: str, month: str, train: Column, *, lag: int, reach: str,
                        p: float = 0.9, minimum: int = 100, absolute: float | None = None) -> DataFrame:
    """Thresholds from training rows only: per calendar month, else pooled, or absolute."""
    d = falls(df, keys, t, value, lag, reach)
    if absolute is not None:
        return sharp_onsets(d.withColumn("threshold", F.lit(float(absolute))), keys, t, reach, True)
    h = d.filter(train & F.col("complete") & (F.col("drop") > 0))
    gate = F.when(F.col("n_values") >= minimum, F.col("_q"))
    own = quantiles(h, [*keys, month], "drop", {"_q": p}).select(*keys, month, gate.alias("_own"))
    pooled = quantiles(h, keys, "drop", {"_q": p}).select(*keys, gate.alias("_all"))
    d = d.join(own, [*keys, month], "left").join(pooled, keys, "left")
    return sharp_onsets(d.withColumn("threshold", F.coalesce("_own", "_all")).drop("_own", "_all"), keys, t, reach, True)


def around(events: DataFrame, series: DataFrame, keys: list[str], at: str, t: str, lo: int, hi: int, step: str) -> DataFrame:
    """Series rows at every step offset around an event: a fixed number of equi-join rows per event."""
    e = events.withColumn("offset", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn(
        t, F.col(at) + F.col("offset") * F.expr(f"interval {step}"))
    return e.join(series, [*keys, t], "left")


def landmarks(path: DataFrame, event: list[str], baseline: str, t: str, value: str, share: float = 0.9, hold: int = 3) -> DataFrame:
    """Trough and first sustained recovery per event, stopped at the first unknown step.

    ``path`` holds the few ordered steps after each onset; they fold as one short
    array inside the JVM."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct("offset", t, value))), lambda s: s)
    g = path.groupBy(*event).agg(F.max(baseline).alias("_base"), steps.alias("_steps"))
    none_t = F.lit(None).cast("timestamp_ntz")
    start = F.struct(F.lit(None).cast("double").alias("trough"), none_t.alias("trough_time"), F.lit(0).alias("streak"),
                     none_t.alias("since"), none_t.alias("recovery"), F.lit(False).alias("done"))

    def step(a, s):
        v, at = s[value], s[t]
        lower = a["trough"].isNull() | (v < a["trough"])
        trough = F.when(lower, v).otherwise(a["trough"])
        trough_t = F.when(lower, at).otherwise(a["trough_time"])
        back = (F.col("_base") > trough) & (v >= trough + share * (F.col("_base") - trough))
        streak = F.when(back, F.when(lower, 0).otherwise(a["streak"]) + 1).otherwise(0)
        since = F.when(back, F.when(streak == 1, at).otherwise(a["since"]))
        full = streak >= hold
        nxt = F.struct(trough.alias("trough"), trough_t.alias("trough_time"), streak.cast("int").alias("streak"), since.alias("since"),
                       F.when(full, since).alias("recovery"), full.alias("done"))
        stop = F.struct(a["trough"].alias("trough"), a["trough_time"].alias("trough_time"), a["streak"].alias("streak"),
                        a["since"].alias("since"), a["recovery"].alias("recovery"), F.lit(True).alias("done"))
        return F.when(a["done"], a).when(v.isNull(), stop).otherwise(nxt)
    r = F.aggregate("_steps", start, step)
    return g.select(*event, r.alias("_r")).select(*event, "_r.trough", "_r.trough_time", "_r.recovery")


def linked_events(anchors: DataFrame, events: DataFrame, keys: list[str], at: str, t: str, eid: str, reach: int, step: str) -> DataFrame:
    """Ids of events within +-reach steps of each anchor (both on the grid)."""
    e = events.select(*keys, F.col(t).alias("_t"), F.col(eid).alias("_id"))
    a = anchors.withColumn("_t", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda k: F.col(at) + k * F.expr(f"interval {step}"))))
    hit = a.join(e, [*keys, "_t"]).groupBy(*keys, at).agg(F.array_join(F.array_sort(F.collect_list("_id")), ";").alias("linked"), F.count(F.lit(1)).alias("n_linked"))
    return anchors.join(hit, [*keys, at], "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0)))


def step_attribution(steps: DataFrame, gen: DataFrame, sid: list[str]) -> DataFrame:
    """Split each step's tightening exactly into units, right-hand side, other terms,
    equation switch and unresolved.  steps: old_/new_ eq, bound, rhs, lhs, flow plus a,
    sign, observed (tightening); gen: sid, gen_delta (sum of factor times movement)."""
    d = steps.join(gen, sid, "left").withColumn("gen_delta", F.coalesce("gen_delta", F.lit(0.0)))
    sgn, a = F.col("sign"), F.col("a")
    known = F.col("old_bound").isNotNull() & F.col("new_bound").isNotNull()
    same = known & (F.col("old_eq") == F.col("new_eq"))
    move = sgn * (F.col("new_bound") - F.col("old_bound"))
    zero = F.lit(0.0)
    other = (F.col("new_lhs") - F.col("old_lhs")) - a * (F.col("new_flow") - F.col("old_flow")) - F.col("gen_delta")
    return d.withColumns({
        "generator": F.when(same, sgn * F.col("gen_delta") / a).otherwise(zero),
        "rhs": F.when(same, -sgn * (F.col("new_rhs") - F.col("old_rhs")) / a).otherwise(zero),
        "other_lhs": F.when(same, sgn * other / a).otherwise(zero),
        "switch": F.when(known & ~same, -move).otherwise(zero),
        "unresolved": F.when(known, F.col("observed") + move).otherwise(F.col("observed"))})


def rendered_equations(terms: DataFrame, eq: list[str], link_factor: str, relation: str, symbol: str, factor: str, link: str) -> DataFrame:
    """Text form of each equation version: link term, unit terms in name order, relation."""
    def num(c):
        # 4 significant decimals with trailing zeros dropped
        return F.regexp_replace(F.regexp_replace(F.format_number(c, 4), ",", ""), r"\.?0+$", "")
    f = F.col(factor)
    parts = F.array_sort(F.collect_list(F.struct(F.col(symbol).alias("s"), f.alias("f"))))
    text = F.transform(parts, lambda p: F.concat(F.when(p["f"] < 0, "").otherwise("+"), num(p["f"]), F.lit(" * P["), p["s"], F.lit("]")))
    d = terms.groupBy(*eq).agg(F.max(link_factor).alias("_a"), F.max(relation).alias("_rel"), F.array_join(text, " ").alias("_t"))
    return d.select(*eq, F.concat(num(F.col("_a")), F.lit(f" * {link} "), F.col("_t"), F.lit(" + Z "), F.col("_rel"), F.lit(" RHS(t)")).alias("equation"))


def evidence_stamps(cases: DataFrame, at: str, before: str, after: str, step: str) -> DataFrame:
    return cases.select(F.explode(F.sequence(F.col(at) - F.expr(f"interval {before}"), F.col(at) + F.expr(f"interval {after}"),
                                             F.expr(f"interval {step}"))).alias("time")).distinct()


def without_top_days(days: DataFrame, keys: list[str], day: str, total: str, n: str) -> DataFrame:
    """Mean per period with and without its one and three largest days, and sign flips."""
    top = top_k(days, keys, [F.desc(F.abs(F.col(total))), F.col(day)], 3, rank="_rk").select(*keys, day, "_rk")
    d = days.join(top, [*keys, day], "left")

    def mean(k):
        keep = F.when(F.col("_rk").isNull() | (F.col("_rk") > k), 1)
        return F.sum(keep * F.col(total)) / F.sum(keep * F.col(n))
    s = d.groupBy(*keys).agg(mean(0).alias("spread"), mean(1).alias("without_top_day"), mean(3).alias("without_top3_days"),
                             F.max(F.when(F.col("_rk") == 1, F.col(day))).alias("top_day"), F.sum(total).alias("_s"),
                             F.max(F.when(F.col("_rk") == 1, F.col(total))).alias("_t"))
    return s.withColumns({"top_day_share": 100 * F.try_divide("_t", "_s"), "sign_flip": (F.signum("spread") != F.signum("without_top_day")).cast("int")}).drop("_s", "_t")


def nearest_control(events: DataFrame, pool: DataFrame, eid: str, strata: list[str], covariates: list[str], apart: Column, limit: float,
                    minimum: int = 5) -> DataFrame:
    """Nearest control per event in the same stratum by distance scaled with the event's
    own pool.  A stratum (key, month, hour, day type) of a regular grid holds a bounded
    number of intervals, so the candidate rows per event are bounded too."""
    c = pool.select(*strata, F.col("time").alias("control_time"), *[F.col(x).alias(f"c_{x}") for x in covariates])
    pairs = events.join(c, strata).filter(apart)
    scale = pairs.groupBy(eid).agg(F.count(F.lit(1)).alias("pool"), *[F.stddev_samp(f"c_{x}").alias(f"_s_{x}") for x in covariates])
    d = pairs.join(scale, eid).filter(F.col("pool") >= minimum)
    one = F.lit(1.0)
    terms = [(F.col(x) - F.col(f"c_{x}")) / F.coalesce(F.nullif(F.col(f"_s_{x}"), F.lit(0.0)), one) for x in covariates]
    dist = F.sqrt(sum((z * z for z in terms[1:]), terms[0] * terms[0]))
    best = top_k(d.withColumn("distance", F.round(dist, 9)), [eid], [F.col("distance"), F.col("control_time")], 1)
    return best.filter(F.col("distance") <= limit).select(eid, "control_time", "pool", "distance")


def event_rate(events: DataFrame, valid: DataFrame, keys: list[str], hours: float) -> DataFrame:
    a = valid.groupBy(*keys).agg((F.count(F.lit(1)) * hours).alias("valid_hours"))
    b = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"))
    return null_safe_join(a, b, keys, "left").withColumn("events", F.coalesce("events", F.lit(0))).withColumn(
        "per_1000_hours", 1000 * F.col("events") / F.col("valid_hours"))
