"""Sequence rules of the study, built on the chunked primitives in ``sequence``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .lookups import asof_backward, points_in_intervals
from .ranks import null_safe_join, prefix_weights, quantiles
from .revisions import latest
from .sequence import gap_islands, last_known, merge_intervals, micros, previous, windowed


def onset(df: DataFrame, keys: list[str], t: str, flag: Column, name: str, step: str) -> DataFrame:
    """Rising edge of a flag on a dense grid; unknown counts as false."""
    d = df.withColumn("_f", F.coalesce(flag, F.lit(False)))
    return windowed(d, keys, t, lambda w: {name: F.col("_f") & ~F.coalesce(F.lag("_f").over(w), F.lit(False))},
                    before=step).drop("_f")


def lag_features(df: DataFrame, keys: list[str], t: str, value: str, lags: dict[str, int], diffs: dict[str, int],
                 reach: str) -> DataFrame:
    """Positional lags and differences on a dense grid."""
    def cols(w):
        out = {n: F.lag(value, k).over(w) for n, k in lags.items()}
        out.update({n: F.col(value) - F.lag(value, k).over(w) for n, k in diffs.items()})
        return out
    return windowed(df, keys, t, cols, before=reach)


def islands_summary(df: DataFrame, keys: list[str], order: list[str], gap: str) -> DataFrame:
    d = gap_islands(df, keys, order, gap)
    return d.groupBy(*keys, "island").agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("end"),
                                          F.count(F.lit(1)).alias("n"))


def sign_reversals(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """A reversal is one change of the last non-zero sign."""
    d = df.withColumn("_s", F.nullif(F.signum(F.col(value)), F.lit(0.0)))
    d = last_known(d, keys, order, {"held_sign": F.col("_s")}).drop("_s")
    d = previous(d, keys, order, {"_prev": "held_sign"})
    return d.withColumn("reversal", F.coalesce(F.col("held_sign") != F.col("_prev"), F.lit(False)).cast("int")).drop("_prev")


def setter_age(df: DataFrame, keys: list[str], t: str, setter: str, step: str, recent: int, reach: str) -> DataFrame:
    """Minutes since the setter last changed and number of changes in the last ``recent`` rows.
    An unknown setter differs from everything, itself included."""
    d = windowed(df, keys, t, lambda w: {"_p": F.lag(setter).over(w)}, before=step)
    d = d.withColumn("_switch", (~F.coalesce(F.col(setter) == F.col("_p"), F.lit(False))).cast("int")).drop("_p")
    d = last_known(d, keys, [t], {"_since": F.when(F.col("_switch") == 1, F.col(t))})
    d = d.withColumn("setter_age", ((micros(F.col(t)) - micros(F.col("_since"))) / 60_000_000).cast("long"))
    return windowed(d, keys, t, lambda w: {"switch_recent": F.when(
        F.count(F.lit(1)).over(w.rowsBetween(1 - recent, 0)) == recent,
        F.sum("_switch").over(w.rowsBetween(1 - recent, 0)))}, before=reach).drop("_switch", "_since")


def percentile_bins(df: DataFrame, strata: list[str], value: str, low: float, high: float, name: str) -> DataFrame:
    """0 / 1 / 2 below, between and above two stratum quantiles; -1 where unknown."""
    q = quantiles(df, strata, value, {"_lo": low, "_hi": high}).drop("n_values")
    d = null_safe_join(df, q, strata, "left")
    return d.withColumn(name, F.when(F.col(value).isNull() | F.col("_lo").isNull(), -1).when(F.col(value) <= F.col("_lo"), 0)
                        .when(F.col(value) <= F.col("_hi"), 1).otherwise(2)).drop("_lo", "_hi")


def cumulative_curve(df: DataFrame, keys: list[str], price: str, units: str, ties: list[str]) -> DataFrame:
    """Bid curve: units offered at this price or better, best price first."""
    d = df.withColumn("_neg", -F.col(price))
    c = prefix_weights(d, keys, ["_neg", *ties], F.col(units))
    return c.select(*keys, (-F.col("_neg")).alias(price), *ties, F.col("weight").alias(units),
                    (F.col("below") + F.col("weight")).alias("cum_units"))


def supersede(df: DataFrame, key: str, start: str, end: str, newest: list[str]) -> DataFrame:
    """A newer effective record closes the earlier interval."""
    d = latest(df, [key, start], newest)
    d = previous(d, [key], [start], {"_next": start}, forward=True)
    return d.withColumn(end, F.least(F.col(end), F.col("_next"))).filter(F.col(start) < F.col(end)).drop("_next")


def split_validity(base: DataFrame, dims: list[tuple[DataFrame, str, str]], key: str, start: str, end: str, *,
                   hours: int = 24 * 365) -> DataFrame:
    """Cut each base interval at every change date inside it and attach the value of
    every dimension in force at the start of the piece.  dims: (rows, date, value)."""
    b = base.select(key, F.col(start).alias("_bs"), F.col(end).alias("_be"))
    cuts = b.select(key, "_bs", "_be", F.explode(F.array("_bs", "_be")).alias("_c"))
    for rows, at, _ in dims:
        inside = points_in_intervals(rows.select(key, F.col(at).alias("_c")), b, [key], "_c", "_bs", "_be", hours=hours)
        cuts = cuts.unionByName(inside)
    cuts = cuts.distinct()
    cuts = previous(cuts, [key, "_bs"], ["_c"], {"_n": "_c"}, forward=True, hours=hours).filter(F.col("_n").isNotNull())
    out = cuts.select(key, F.col("_c").alias("valid_from"), F.col("_n").alias("valid_to"))
    for rows, at, value in dims:
        out = asof_backward(out, rows.select(key, F.col(at).alias("_at"), value), [key], "valid_from", "_at", [value],
                            tie=[value], hours=hours).drop("_at")
    return out


def forward_label(df: DataFrame, keys: list[str], t: str, flag: str, lo: int, hi: int, reach: str) -> DataFrame:
    """1 when the flag is up lo..hi steps ahead, null when any of those steps is unknown."""
    def cols(w):
        ahead = w.rowsBetween(lo, hi)
        whole = F.count(flag).over(ahead) == hi - lo + 1
        return {"label": F.when(whole, F.max(flag).over(ahead))}
    return windowed(df, keys, t, cols, after=reach)


def extremogram(df: DataFrame, key: str, t: str, value: str, threshold: float, lags: list[int], step: str) -> DataFrame:
    """P(response above u at t + h | conditioning key above u at t) for every key pair.
    Only exceedances are fanned out over lags; the response side joins by time."""
    flags = df.select(F.col(key).alias("response"), F.col(t).alias("_at"),
                      F.coalesce(F.col(value) > threshold, F.lit(False)).cast("int").alias("_hit"))
    hot = df.filter(F.col(value) > threshold).select(F.col(key).alias("conditioning"), F.col(t).alias("_t"))
    ahead = hot.withColumn("lag", F.explode(F.array(*[F.lit(x) for x in lags]))).withColumn(
        "_at", F.col("_t") + F.col("lag") * F.expr(f"interval {step}"))
    return ahead.join(flags, "_at").groupBy("conditioning", "response", "lag").agg(
        F.avg("_hit").alias("probability"), F.count(F.lit(1)).alias("events"))


def interpolate_one_gap(df: DataFrame, keys: list[str], t: str, value: str, step: str) -> DataFrame:
    """Fill a single missing step: linear (``linear``) and next value (``stepped``)."""
    def cols(w):
        p, n = F.lag(value).over(w), F.lead(value).over(w)
        return {"linear": F.coalesce(F.col(value), (p + n) / 2), "stepped": F.coalesce(F.col(value), n)}
    return windowed(df, keys, t, cols, before=step, after=step)


def causal_baseline(anchors: DataFrame, series: DataFrame, keys: list[str], t: str, value: str, off: str,
                    offsets: tuple[int, int], step: str, cycle: str, cycles: int = 7) -> DataFrame:
    """Value at each offset around an anchor less the median of the same slot in the
    previous ``cycles`` cycles where ``off`` holds.  Medians are over at most ``cycles`` rows."""
    grid = anchors.withColumn("offset", F.explode(F.sequence(F.lit(offsets[0]), F.lit(offsets[1])))).withColumn(
        "_at", F.col("anchor") + F.col("offset") * F.expr(f"interval {step}"))
    s = series.select(*keys, F.col(t).alias("_at"), F.col(value).alias("_v"), F.col(off).alias("_off"))
    now = grid.join(s, [*keys, "_at"], "left").drop("_off")
    back = grid.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(cycles)))).withColumn(
        "_at", F.col("_at") - F.col("_k") * F.expr(f"interval {cycle}"))
    base = back.join(s.filter("_off = 1 and _v is not null"), [*keys, "_at"]).groupBy(*keys, "anchor", "offset").agg(
        F.percentile("_v", F.lit(0.5)).alias("baseline"))
    return now.drop("_at").join(base, [*keys, "anchor", "offset"], "left").withColumn(
        "relative", F.col("_v") - F.col("baseline")).withColumnRenamed("_v", "value")


def run_starts(df: DataFrame, keys: list[str], t: str, treated: Column, setter: str, step: str) -> DataFrame:
    """Setter just before each treated run against the setter of its first interval."""
    d = df.withColumn("_on", F.coalesce(treated, F.lit(False)))
    d = windowed(d, keys, t, lambda w: {"_was": F.coalesce(F.lag("_on").over(w), F.lit(False)),
                                        "before": F.lag(setter).over(w)}, before=step)
    d = d.filter(F.col("_on") & ~F.col("_was"))
    return d.select(*keys, F.col(t).alias("run_start"), "before", F.col(setter).alias("first_during"),
                    (F.col("before") != F.col(setter)).cast("int").alias("changed"))


def covered_intervals(spells: DataFrame, keys: list[str], start: str, end: str, *, small: int = 300,
                      big: int = 1800, gap: str = "5 minutes") -> DataFrame:
    """Number of small interval-ending stamps of each big interval that lie inside merged
    spells (ends inclusive), by arithmetic on the spell ends."""
    m = merge_intervals(spells.select(*keys, start, end), keys, start, end, gap=gap)
    us = 1_000_000
    s, e = micros(F.col(start)), micros(F.col(end))
    first, last = F.ceil(s / (small * us)), F.floor(e / (small * us))       # stamp numbers covered
    per = big // small
    d = m.withColumns({"_a": first, "_z": last}).filter("_a <= _z")
    d = d.withColumn("_h", F.explode(F.sequence(F.ceil(F.col("_a") / per), F.ceil(F.col("_z") / per))))
    n = F.least(F.col("_z"), F.col("_h") * per) - F.greatest(F.col("_a"), F.col("_h") * per - per + 1) + 1
    return d.groupBy(*keys, F.timestamp_micros(F.col("_h") * (big * us)).cast("timestamp_ntz").alias("time")).agg(
        F.sum(n).alias("covered"))


