"""Aggregations.  Means, counts, extremes and sums combine on the map side; exact
quantiles and rank correlations go through ``ranks`` so a hot group is split."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranks import null_safe_join, quantile_table, quantiles, rank_correlation
from .revisions import top_k


def interval_targets(df: DataFrame, keys: list[str], bucket: str, t: str, expected: int, means: list[str], lows: list[str],
                     highs: list[str], lasts: list[str], tie: list[str] = ()) -> DataFrame:
    """Mean, min, max and last non-null value per bucket; numbers are null unless exactly
    ``expected`` distinct stamps are present."""
    order = F.struct(t, *tie)
    aggs = [F.countDistinct(t).alias("n")]
    aggs += [F.avg(c).alias(c) for c in means] + [F.min(c).alias(f"{c}_min") for c in lows]
    aggs += [F.max(c).alias(f"{c}_max") for c in highs]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"{c}_last") for c in lasts]
    d = df.groupBy(*keys, bucket).agg(*aggs)
    nums = [*means, *[f"{c}_min" for c in lows], *[f"{c}_max" for c in highs]]
    return d.withColumns({c: F.when(F.col("n") == expected, F.col(c)) for c in nums})


def seasonal_reference(panel: DataFrame, keys: list[str], value: str, train: Column, share: float = 0.5) -> DataFrame:
    """Train-only median of positive values per stratum, threshold and tri-state event."""
    ref = quantiles(panel.filter(train & (F.col(value) > 0)), keys, value, {"reference": 0.5}).drop("n_values")
    d = null_safe_join(panel, ref, keys, "left").withColumn("threshold", F.when(F.col("reference") > 0, share * F.col("reference")))
    return d.withColumn("event", (F.col(value) < F.col("threshold")).cast("int"))


def coverage_audit(df: DataFrame, keys: list[str], t: str, value: str, step_seconds: int) -> DataFrame:
    """Rows, first and last stamp, grid size between them and missing share."""
    a, b = F.min(t), F.max(t)
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("known"), a.alias("first"), b.alias("last"),
                              F.countDistinct(t).alias("_d"))
    size = F.floor((F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp")))
                   / (step_seconds * 1_000_000)) + 1
    return d.withColumn("expected", size).withColumn("missing_share", 1 - F.col("_d") / F.col("expected")).drop("_d")


def equation_population(st: DataFrame, keys: list[str], near_binding: float, near_setting: float) -> DataFrame:
    """Per equation and side: applicable, binding, near-binding, near-setting and leading
    counts, mean absolute value, lowest and median slack.  ``st`` carries time, side,
    bound, slack, mv; null sides stay a group of their own."""
    lead = st.groupBy("time", "side").agg(F.min("bound").alias("_lo"), F.max("bound").alias("_hi"))
    best = F.when(F.col("side") == "upper", F.col("_lo")).otherwise(F.col("_hi"))
    d = st.join(lead, ["time", "side"], "left").withColumn("_lead", best)
    gap = F.when(F.col("side") == "upper", F.col("bound") - F.col("_lead")).otherwise(F.col("_lead") - F.col("bound"))

    def n(cond):
        return F.count(F.when(cond, 1))
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("applicable"), n(F.abs("mv") > 1e-9).alias("binding"),
        n(F.col("slack").between(0, near_binding)).alias("near_binding"), n(gap.between(0, near_setting)).alias("near_setting"),
        n(gap == 0).alias("leading"), F.avg(F.abs("mv")).alias("mean_abs_mv"), F.min("slack").alias("min_slack"))
    med = quantiles(st, keys, "slack", {"median_slack": 0.5}).drop("n_values")
    return null_safe_join(out, med, keys, "left")


def unit_profile(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Absolute impact sum, mean and P95, tightening and relief."""
    x = F.col(value)
    sums = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.abs(x)).alias("total_abs"), F.avg(F.abs(x)).alias("mean_abs"),
                                 F.sum(F.greatest(x, F.lit(0.0))).alias("tightening"), F.sum(F.greatest(-x, F.lit(0.0))).alias("relief"))
    p = quantiles(df.withColumn("_abs", F.abs(x)), keys, "_abs", {"p95_abs": 0.95}).drop("n_values")
    return null_safe_join(sums, p, keys)


def price_summary(p: DataFrame, period: str, region: str, t: str, day: str, block: str, price: str, onset: str, k: float,
                  hours: float, top_days: int) -> DataFrame:
    """Price statistics per period and region; day and block (e.g. half-hour) are label
    columns for the nested aggregates, onset marks the first interval of a high run."""
    x = F.col(price)
    over = F.greatest(x - k, F.lit(0.0))
    base = p.groupBy(period, region).agg(
        F.count(x).alias("intervals"), F.avg(x).alias("mean_price"), F.avg(F.least(x, F.lit(k))).alias("capped"),
        F.avg(over).alias("excess"), (F.count(F.when(x > k, 1)) * hours).alias("hours_above"), F.sum(onset).alias("episodes"),
        F.avg(F.when(x > k, over)).alias("excess_when_above"), F.avg(F.when(x < 0, 1.0).otherwise(0.0)).alias("negative_share"))
    blocks = p.groupBy(period, region, block).agg(F.avg(x).alias("_m")).groupBy(period, region).agg(
        F.avg(F.greatest(F.col("_m") - k, F.lit(0.0))).alias("excess_from_blocks"))
    days = p.groupBy(period, region, day).agg(F.sum(over).alias("_s"))
    top = top_k(days, [period, region], [F.desc_nulls_last("_s"), F.col(day)], top_days).groupBy(period, region).agg(F.sum("_s").alias("_t"))
    total = days.groupBy(period, region).agg(F.sum("_s").alias("_a"))
    return (base.join(blocks, [period, region]).join(top, [period, region]).join(total, [period, region])
            .withColumn("top_days_share", F.when(F.col("_a") > 0, F.col("_t") / F.col("_a")).otherwise(0.0)).drop("_t", "_a"))


def spread_terms(origin: Column, dest: Column, k: float) -> dict[str, Column]:
    """Spread split exactly into an energy part (capped at k) and a scarcity part."""
    cap = F.lit(float(k))
    return {"spread": dest - origin, "energy": F.least(dest, cap) - F.least(origin, cap),
            "scarcity": F.greatest(dest - cap, F.lit(0.0)) - F.greatest(origin - cap, F.lit(0.0)),
            "state": F.when((origin <= cap) & (dest <= cap), "neither").when((origin <= cap) & (dest > cap), "destination_only")
            .when((origin > cap) & (dest <= cap), "origin_only").otherwise("both")}


def spread_states(p: DataFrame, keys: list[str], origin: str, dest: str, k: float) -> DataFrame:
    """Share and contribution of each joint state to the period's mean spread."""
    d = p.withColumns(spread_terms(F.col(origin), F.col(dest), k))
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    s = d.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("intervals"), *[F.sum(c).alias(f"_{c}") for c in ("spread", "energy", "scarcity")])
    return s.join(n, keys).select(*keys, "state", "intervals", (F.col("intervals") / F.col("_n")).alias("frequency"),
                                  *[(F.col(f"_{c}") / F.col("_n")).alias(c) for c in ("spread", "energy", "scarcity")])


def flow_diagnostics(p: DataFrame, keys: list[str], spread: str, flow: str, tail: Column) -> DataFrame:
    """Mean of flow times spread against the product of means, gated on a positive spread."""
    d, f = F.col(spread), F.greatest(F.col(flow), F.lit(0.0))
    gate = d > 0
    eff, pos = F.when(gate, f).otherwise(0.0), F.greatest(d, F.lit(0.0))
    s = p.filter(d.isNotNull() & F.col(flow).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("intervals"), F.avg(eff).alias("mean_flow"), F.avg(pos).alias("mean_spread"),
        F.avg(eff * pos).alias("mean_product"), F.sum(eff * pos).alias("_all"), F.sum(F.when(tail, eff * pos).otherwise(0.0)).alias("_tail"),
        F.avg(F.when(gate, 1.0).otherwise(0.0)).alias("gate_probability"), F.corr(F.when(gate, f), F.when(gate, d)).alias("pearson"))
    s = s.withColumns({"covariance": F.col("mean_product") - F.col("mean_flow") * F.col("mean_spread"),
                       "tail_share": F.try_divide("_tail", "_all")}).drop("_all", "_tail")
    rho = rank_correlation(p.filter(gate).withColumn("_f", f), keys, "_f", spread, minimum=3, name="spearman").drop("n_pairs")
    return s.join(rho, keys, "left")


def loss_congestion(p: DataFrame, keys: list[str], origin: str, dest: str, mlf: str, k: float) -> DataFrame:
    """Spread = loss + congestion, each split into energy and scarcity; means add up exactly."""
    o, d, cap = F.col(origin), F.col(dest), F.lit(float(k))
    star = o * F.col(mlf)
    loss, cong = star - o, d - star
    e_loss = F.least(star, cap) - F.least(o, cap)
    e_cong = F.least(d, cap) - F.least(star, cap)
    coupled = F.abs(cong) <= F.greatest(F.lit(0.01), F.abs(o) * 1e-4)
    return p.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(d - o).alias("spread"), F.avg(loss).alias("loss"), F.avg(cong).alias("congestion"),
        F.avg(e_loss).alias("energy_loss"), F.avg(loss - e_loss).alias("scarcity_loss"), F.avg(e_cong).alias("energy_congestion"),
        F.avg(cong - e_cong).alias("scarcity_congestion"), F.avg(F.when(coupled, 100.0).otherwise(0.0)).alias("coupled_pct"))


def line_fit(df: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
                                 F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def quantile_profile(df: DataFrame, schemes: dict[str, Column], keys: list[str], measures: dict[str, dict[str, float]],
                     means: dict[str, str]) -> DataFrame:
    """Several grouping schemes in one pass: every row is tagged with each scheme's block
    label, then quantiles and means are taken per (scheme, block, keys)."""
    tags = F.array(*[F.struct(F.lit(n).alias("scheme"), c.cast("string").alias("block")) for n, c in schemes.items()])
    d = df.withColumn("_s", F.explode(tags)).select(*df.columns, "_s.*")
    by = ["scheme", "block", *keys]
    out = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(a) for a, c in means.items()])
    return null_safe_join(out, quantile_table(d, by, measures), by, "left")


def regime_table(df: DataFrame, strata: list[str], variable: str, response: dict[str, str], minimum: int) -> DataFrame:
    """Low / normal / high thirds of a driver per stratum with response medians."""
    q = quantiles(df, strata, variable, {"p20": 0.2, "p80": 0.8}).filter((F.col("n_values") >= minimum) & (F.col("p20") < F.col("p80"))).drop("n_values")
    x = F.col(variable)
    d = null_safe_join(df.filter(x.isNotNull()), q, strata).withColumn(
        "regime", F.when(x <= F.col("p20"), "low").when(x <= F.col("p80"), "normal").otherwise("high"))
    by = [*strata, "regime"]
    out = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max("p20").alias("p20"), F.max("p80").alias("p80"))
    return null_safe_join(out, quantile_table(d, by, {c: {name: 0.5} for name, c in response.items()}), by, "left")


def ranked_shares(df: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """Top k items per stratum with their share, ties by name."""
    c = df.groupBy(*keys, item).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return top_k(c, keys, [F.desc("n"), F.col(item)], k, rank="rank").join(total, keys).withColumn(
        "share", F.col("n") / F.col("_t")).drop("_t")


def exceedance_stats(df: DataFrame, keys: list[str], unit: str, value: str, treated: str, levels: list[float]) -> DataFrame:
    """Median and exceedance shares of absolute values by arm, and the share above the
    unit's own untreated P90."""
    x = df.withColumn("_x", F.abs(value))
    p90 = quantiles(x.filter(F.col(treated) == 0), [*keys, unit], "_x", {"_p90": 0.9}).drop("n_values")
    x = x.join(p90, [*keys, unit], "left")
    by = [*keys, treated]
    out = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.when(F.col("_x") > v, 1.0).otherwise(0.0)).alias(f"share_gt_{v:g}") for v in levels],
                             F.avg(F.when(F.col("_x") > F.col("_p90"), 1.0).otherwise(0.0)).alias("share_gt_own_p90"))
    return out.join(quantiles(x, by, "_x", {"median_abs": 0.5}).drop("n_values"), by)


def effect_ranking(df: DataFrame, keys: list[str], event: str, value: str, minimum: int = 30) -> DataFrame:
    """Mean per event first, then mean, spread and standard error per key."""
    d = df.groupBy(*keys, event).agg(F.avg(value).alias("_v")).groupBy(*keys).agg(
        F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"))
    return d.withColumns({"se": F.col("sd") / F.sqrt("n"), "evidence": F.when(F.col("n") < minimum, "exploratory association")
                          .otherwise("supported association; not causal")})


def complete_rollup(df: DataFrame, keys: list[str], t: str, value: str, tight: Column, ok: Column, expected: int) -> DataFrame:
    """Coarser interval from exactly ``expected`` complete parts: mean, or min for tight targets."""
    whole = (F.count(F.lit(1)) == expected) & (F.count(F.when(ok, 1)) == expected)
    return df.groupBy(*keys, t).agg(
        F.when(whole, F.when(F.max(tight.cast("int")) == 1, F.min(value)).otherwise(F.avg(value))).alias(value),
        F.when(whole, "complete").otherwise("unavailable").alias("status"))


def weighted_pool(df: DataFrame, keys: list[str], weight: str, means: list[str], rms: list[str]) -> DataFrame:
    """Sample-weighted means; root-mean-square metrics pool their squares."""
    def pooled(c, power):
        w = F.when(F.col(c).isNotNull() & (F.col(weight) > 0), F.col(weight))
        return F.sum(w * F.col(c) ** power) / F.sum(w)
    return df.groupBy(*keys).agg(F.sum(weight).alias(weight), *[pooled(c, 1).alias(c) for c in means],
                                 *[F.sqrt(pooled(c, 2)).alias(c) for c in rms])


def condition_catalogue(panel: DataFrame, regimes: dict[str, Column], keys: list[str], value: str, tokens: str, day: str,
                        threshold: float, min_days: int, min_episodes: int) -> DataFrame:
    """Quantiles, shares and support per key for every named condition a row meets."""
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in regimes.items()]), lambda x: x.isNotNull())
    d = panel.withColumn("regime", F.explode(names))
    by = [*keys, "regime"]
    out = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(day).alias("days"),
                             F.avg((F.col(value) < threshold).cast("double")).alias("restricted_share"))
    eps = d.select(*by, F.explode(tokens).alias("_e")).groupBy(*by).agg(F.countDistinct("_e").alias("episodes"))
    q = quantiles(d, by, value, {"p10": 0.1, "p50": 0.5, "p90": 0.9}).drop("n_values")
    out = out.join(eps, by, "left").join(q, by, "left").withColumn("episodes", F.coalesce("episodes", F.lit(0)))
    ok = (F.col("days") >= min_days) & (F.col("episodes") >= min_episodes)
    return out.withColumn("status", F.when(ok, "supported").otherwise("indicative"))


def min_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """1 + number of larger values, null for null: a join on distinct values, no global window."""
    from .ranks import prefix_weights
    d = prefix_weights(df.withColumn("_neg", -F.col(value)), [], ["_neg"]).select((-F.col("_neg")).alias(value), (F.col("below") + 1).alias(name))
    return df.join(d, value, "left")


