"""Smaller table operators used around forecasting, constraint and outage studies."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .forecast import draw_below
from .lookups import asof_backward, points_in_intervals
from .ranks import null_safe_join, prefix_weights, quantiles
from .resample import numbered_draws
from .revisions import top_k
from .sequence import windowed


def delayed_state(df: DataFrame, keys: list[str], t: str, targets: list[str], states: list[str], lags: list[int], reach: str) -> DataFrame:
    """Lags and last change of targets, and every state column one step late."""
    def cols(w):
        out = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in targets for k in lags}
        out |= {f"{c}_delta": F.lag(c, 1).over(w) - F.lag(c, 2).over(w) for c in targets}
        return out | {f"{c}_late": F.lag(c, 1).over(w) for c in states}
    return windowed(df, keys, t, cols, before=reach).select(*keys, t, *[f"{c}_lag{k}" for c in targets for k in lags], *[f"{c}_delta" for c in targets], *[f"{c}_late" for c in states])


def harmonics(phase: Column, n: int, gates: dict[str, Column], drivers: dict[str, Column]) -> dict[str, Column]:
    """Daily harmonics 2..n, day-period gates and driver-by-period products."""
    out = {f"{f}_{k}": fn(phase * k) for k in range(2, n + 1) for f, fn in (("sin", F.sin), ("cos", F.cos))}
    out |= {f"gate_{g}": c.cast("int") for g, c in gates.items()}
    return out | {f"{d}_{g}": F.when(c, x).otherwise(0.0) for d, x in drivers.items() for g, c in gates.items()}


def capacity_reference(train: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Normaliser: absolute value, training median where unknown, never below the training P10."""
    q = quantiles(train.withColumn("_a", F.abs(value)).filter("_a > 0"), keys, "_a", {"_floor": 0.1, "_mid": 0.5}).drop("n_values")
    d = null_safe_join(rows, q, keys)
    return d.withColumn("reference", F.greatest(F.coalesce(F.abs(F.col(value)), F.col("_mid")), F.col("_floor"))).drop("_floor", "_mid")


def boundary_jumps(df: DataFrame, origin: list[str], lead: str, band: str, forecast: str, actual: str) -> DataFrame:
    """Forecast and actual change where the band changes; an origin has a fixed number of leads."""
    w = Window.partitionBy(*origin).orderBy(lead)
    d = df.withColumns({"_b": F.lag(band).over(w), "forecast_jump": F.col(forecast) - F.lag(forecast).over(w), "actual_jump": F.col(actual) - F.lag(actual).over(w)})
    return d.filter(F.col("_b").isNotNull() & (F.col("_b") != F.col(band))).drop("_b")


def supported_incidents(origins: DataFrame, incidents: DataFrame, keys: list[str], origin: str, at: str, lo: str, hi: str, iid: list[str]) -> DataFrame:
    """Incidents with at least one origin lo..hi ahead of them: the last origin at or before the near edge is
    looked up, and no pair beside it is formed."""
    near = incidents.withColumn("_b", F.col(at) - F.expr(f"interval {lo}"))
    d = asof_backward(near, origins.select(*keys, F.col(origin).alias("_o")).distinct(), keys, "_b", "_o", [])
    return d.filter(F.col("_o") >= F.col(at) - F.expr(f"interval {hi}")).select(*keys, *iid)


def paired_power(df: DataFrame, keys: list[str], n: str, base: str, gains: list[float], correlation: float, reps: int, seed: int) -> DataFrame:
    """Simulated power of the paired (discordant) test for a recall gain."""
    g = df.withColumn("gain", F.explode(F.array(*[F.lit(x) for x in gains])))
    b, cand = F.col(base), F.least(F.col(base) + F.col("gain"), F.lit(0.99))
    both = b * cand + correlation * (F.least(b, cand) - b * cand)
    g = g.withColumns({"_p10": cand - both, "_p01": b - both})
    by = [*keys, "gain"]
    won = draw_below(F.col("_text"), F.col("_p10"))
    lost = ~won & draw_below(F.col("_text"), F.col("_p10") + F.col("_p01"))
    r = numbered_draws(g, by, n, reps, seed).groupBy(*by, "rep").agg(F.count(F.when(won, 1)).alias("_w"), F.count(F.when(lost, 1)).alias("_l"))
    z = (F.col("_w") - F.col("_l")) / F.sqrt(F.col("_w") + F.col("_l"))
    return r.groupBy(*by).agg(F.avg(F.coalesce((z > 1.96).cast("double"), F.lit(0.0))).alias("power"))


def common_rows(df: DataFrame, keys: list[str], method: str, forecast: str, methods: int) -> DataFrame:
    """Rows at keys where every method has a forecast."""
    ok = df.groupBy(*keys).agg(F.countDistinct(F.when(F.col(forecast).isNotNull(), F.col(method))).alias("_n")).filter(F.col("_n") == methods).select(*keys)
    return df.join(ok, keys, "left_semi")


def policy_score(df: DataFrame, keys: list[str], probability: str, cutoff: str, outcome: Column, day: str) -> DataFrame:
    """Alerts by each row's own cutoff, with independent days."""
    alert = F.col(probability) >= F.col(cutoff)
    n = lambda c: F.count(F.when(c, 1))
    d = df.groupBy(*keys).agg(n(alert & outcome).alias("tp"), n(alert & ~outcome).alias("fp"), n(~alert & outcome).alias("fn"), F.countDistinct(day).alias("days"), F.countDistinct(F.when(outcome, F.col(day))).alias("event_days"))
    return d.withColumns({"recall": F.try_divide("tp", F.col("tp") + F.col("fn")), "precision": F.try_divide("tp", F.col("tp") + F.col("fp")), "false_per_day": F.col("fp") / F.col("days")})


def gates(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Reasons a row fails, in rule order, and whether none does."""
    r = F.array_compact(F.array(*[F.when(bad, F.lit(n)) for n, bad in rules.items()]))
    return df.withColumns({"reasons": F.array_join(r, "; "), "passed": (F.size(r) == 0).cast("int")})


def one_lead_per_origin(df: DataFrame, origin: list[str], stamp: Column, order: list[str], seed: int) -> DataFrame:
    """The row at position (stamp + seed) mod count of each origin's ordered leads."""
    w = Window.partitionBy(*origin).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*origin))
    return df.withColumns({"_i": F.row_number().over(w) - 1, "_n": n}).filter(F.col("_i") == F.pmod(stamp + seed, F.col("_n"))).drop("_i", "_n")


def modal(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value per key; ties go to the smallest."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return top_k(c, keys, [F.desc("n"), F.col(value)], 1)


def fleet_context(rows: DataFrame, units: DataFrame, states: DataFrame, unit: str, t: str, at: str, mw: str, by: list[str], stale: str, hours: int) -> DataFrame:
    """Output and online count per group at each stamp; sums are null if any unit is unknown."""
    d = asof_backward(rows.join(units, by), states, [unit], t, at, [mw], tie=[mw], tolerance=stale, hours=hours)
    whole = F.count(F.lit(1)) == F.count(mw)
    return d.groupBy(*by, t).agg(F.count(F.lit(1)).alias("units"), F.count(mw).alias("known"), F.when(whole, F.sum(mw)).alias("total"), F.count(F.when(F.col(mw) > 0, 1)).alias("online"))


def harmonic_energy(profile: DataFrame, slot: str, value: str, slots: int) -> DataFrame:
    """Energy of each daily harmonic of a slot profile: sums of value times sine and cosine."""
    top = slots // 2 - 1
    d = profile.withColumn("harmonic", F.explode(F.sequence(F.lit(1), F.lit(top))))
    a = F.col("harmonic") * F.col(slot) * (2 * math.pi / slots)
    return d.groupBy("harmonic").agg((F.sum(F.col(value) * F.cos(a)) ** 2 + F.sum(F.col(value) * F.sin(a)) ** 2).alias("energy"))


def harmonics_needed(energy: DataFrame, share: float, low: int, high: int) -> DataFrame:
    """Fewest leading harmonics that reach the share of the energy (at most slots / 2 rows)."""
    c = prefix_weights(energy, [], ["harmonic"], F.col("energy"))
    n = F.min(F.when(F.col("below") + F.col("weight") >= share * F.col("total"), F.col("harmonic")))
    return c.agg(F.greatest(F.least(F.coalesce(n, F.lit(low)), F.lit(high)), F.lit(low)).alias("harmonics"))


def largest_delta(df: DataFrame, keys: list[str], stratum: str, regime: str, value: str) -> DataFrame:
    """Stratum with the largest absolute high-minus-low difference."""
    p = df.groupBy(*keys, stratum).pivot(regime, ["low", "high"]).agg(F.max(value)).filter("low is not null and high is not null").withColumn("delta", F.col("high") - F.col("low"))
    return top_k(p, keys, [F.desc(F.round(F.abs("delta"), 9)), F.col(stratum)], 1)


def anchor_frame(rows: DataFrame, series: DataFrame, keys: list[str], value: str, step: str, cycles: dict[str, int]) -> DataFrame:
    """Anchor (last value before the origin) and the newest same-slot value one or more
    cycles back that is older than the origin."""
    one = F.expr(f"interval {step}")
    s = series.select(*keys, F.col("time").alias("_at"), F.col(value).alias("_v"))
    d = rows.withColumn("_at", F.col("origin") - one).join(s.withColumnRenamed("_v", "anchor"), [*keys, "_at"], "left").drop("_at")
    for name, n in cycles.items():
        back = F.ceil((F.col("lead") + 1) / n) * n
        d = d.withColumn("_at", F.col("time") - back * one).join(s.withColumnRenamed("_v", name), [*keys, "_at"], "left").drop("_at").withColumn(name, F.coalesce(name, "anchor"))
    return d


