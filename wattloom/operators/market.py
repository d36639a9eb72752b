"""Settlement residue, auction and valuation rules."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.maths import bachelier_call
from .ranks import null_safe_join, prefix_weights, quantiles
from .revisions import latest, top_k


# The three arms of the loop and the regions they join.
ARMS = {"VN": ("VIC", "NSW"), "VS": ("VIC", "SA"), "NS": ("NSW", "SA")}


def residue(price_from: Column, price_to: Column, flow: Column, losses: Column, share: Column) -> Column:
    """Five-minute settlement residue of a link; the exporting side carries ``share`` of losses."""
    return (price_to * (flow - (1 - share) * losses) - price_from * (flow + share * losses)) / 12


def directional_pool(df: DataFrame, keys: list[str], residue_col: str, flow: str) -> DataFrame:
    """Pool assets per interval and pair, then book the residue to the direction of net flow."""
    d = df.groupBy(*keys).agg(F.sum(residue_col).alias("_r"), F.sum(flow).alias("net_flow"))
    zero = F.lit(0.0)
    ab, ba = F.when(F.col("net_flow") > 0, F.col("_r")).otherwise(zero), F.when(F.col("net_flow") < 0, F.col("_r")).otherwise(zero)
    return d.select(*keys, "net_flow", F.greatest(ab, zero).alias("ab_pos"), F.least(ab, zero).alias("ab_neg"),
                    F.greatest(ba, zero).alias("ba_pos"), F.least(ba, zero).alias("ba_neg"))


def settled_rows(df: DataFrame, date: str, run: str, keys: list[str], newest: list[str]) -> DataFrame:
    """Rows of the last settlement run of each date, then the newest per period and side.
    The run choice joins back a table with one row per date."""
    last = df.groupBy(date).agg(F.max(run).alias("_run"))
    d = df.join(last, date).filter(F.col(run) == F.col("_run")).drop("_run")
    return latest(d, [date, *keys], newest)


def quarterly_ledger(series: DataFrame, units: DataFrame, keys: list[str], pos: str, neg: str, fallback_units: float) -> DataFrame:
    """Residue per unit: proportion from the registry, else 1 / fallback; fee zero when unknown.
    ``keys`` start with quarter and direction; units: quarter, direction, proportion, max_units, fee."""
    g = series.groupBy(*keys).agg(F.sum(pos).alias("residue_pos"), F.sum(neg).alias("residue_neg"), F.count(F.lit(1)).alias("intervals"))
    d = g.join(units, keys[:2], "left")
    prop = F.coalesce(F.col("proportion") / 100, F.lit(1 / fallback_units))
    d = d.withColumns({"units_source": F.when(F.col("proportion").isNotNull(), "registry").otherwise("fallback"),
                       "max_units": F.coalesce("max_units", F.lit(float(fallback_units))), "proportion": prop, "fee": F.coalesce("fee", F.lit(0.0))})
    return d.withColumns({"per_unit": F.col("residue_pos") * F.col("proportion"),
                          "per_unit_net_fee": F.col("residue_pos") * F.col("proportion") - F.col("fee")})


def settlement_reconcile(rows: DataFrame, keys: list[str], computed: str, settled: str) -> DataFrame:
    zero = F.lit(0.0)
    c, s = F.col(computed), F.col(settled)
    d = rows.groupBy(*keys).agg(F.sum(F.greatest(c, zero)).alias("computed_pos"), F.sum(c).alias("computed_signed"), F.sum(F.coalesce(s, zero)).alias("settled"),
                                F.avg(s.isNotNull().cast("double")).alias("coverage"))
    return d.withColumn("bias_pct", 100 * F.try_divide(F.col("computed_signed") - F.col("settled"), F.abs("settled")))


def net_trade(df: DataFrame) -> DataFrame:
    """Loop payout under net trade, one row at a time without a shuffle.

    Columns: p_NSW p_VIC p_SA, f_VN f_VS f_NS, a_VN a_VS a_NS.  Each arm that joins an
    exporter to an importer trades the net export (or import) of the region that stands
    alone; with three exporters the arm's own flow decides.  The net loop residue is shared
    on trade value, negative shares are netted off, and nothing is paid when it is not
    positive."""
    f, a, p = (lambda k: F.coalesce(F.col(f"f_{k}"), F.lit(0.0))), (lambda k: F.coalesce(F.col(f"a_{k}"), F.lit(0.0))), (lambda k: F.col(f"p_{k}"))
    d = df.withColumns({"e_NSW": f("NS") - f("VN"), "e_VIC": f("VN") + f("VS"), "e_SA": -f("VS") - f("NS"), "net_loop": a("VN") + a("VS") + a("NS")})
    d = d.withColumn("n_exporting", sum(((F.col(f"e_{r}") >= 0).cast("int") for r in ("NSW", "VIC", "SA")), F.lit(0)))
    # one step per withColumns, so that shared terms are computed once and not inlined
    sent = {}
    for arm, (x, y) in ARMS.items():
        ex, ey = F.col(f"e_{x}"), F.col(f"e_{y}")
        sent[f"dir_{arm}"] = F.when(F.col("n_exporting") == 3, F.signum(f(arm))).when((ex >= 0) & (ey < 0), 1.0).when((ey >= 0) & (ex < 0), -1.0).otherwise(0.0)
    d = d.withColumns(sent)
    qty = {}
    for arm, (x, y) in ARMS.items():
        to_y = F.col(f"dir_{arm}") > 0
        from_e, to_e = F.when(to_y, F.col(f"e_{x}")).otherwise(F.col(f"e_{y}")), F.when(to_y, F.col(f"e_{y}")).otherwise(F.col(f"e_{x}"))
        qty[f"net_trade_{arm}"] = F.col(f"dir_{arm}") * F.when(F.col("n_exporting") == 1, -to_e).otherwise(from_e)
    d = d.withColumns(qty)
    d = d.withColumns({f"amount_{arm}": F.col(f"net_trade_{arm}") * (p(y) - p(x)) for arm, (x, y) in ARMS.items()})
    amt = [F.col(f"amount_{k}") for k in ARMS]
    d = d.withColumns({"_total": sum(amt[1:], amt[0]), "_gain": sum((F.greatest(x, F.lit(0.0)) for x in amt), F.lit(0.0))})
    total, gain, nl = F.col("_total"), F.col("_gain"), F.col("net_loop")
    d = d.withColumn("_bad", (F.abs(total) <= 1e-9) | (F.signum(total) != F.signum(nl)))
    d = d.withColumns({f"provisional_{k}": F.when(F.col("_bad") & (gain > 0), nl * F.greatest(F.col(f"amount_{k}"), F.lit(0.0)) / gain)
                       .when(F.abs(total) > 1e-9, nl * F.col(f"amount_{k}") / F.nullif(total, F.lit(0.0))).otherwise(0.0) for k in ARMS})
    d = d.withColumn("_kept", sum((F.greatest(F.col(f"provisional_{k}"), F.lit(0.0)) for k in ARMS), F.lit(0.0)))
    whole = F.col("_kept")
    d = d.withColumns({f"_share_{k}": F.when((nl > 0) & (whole > 0), nl * F.greatest(F.col(f"provisional_{k}"), F.lit(0.0)) / F.nullif(whole, F.lit(0.0))).otherwise(0.0) for k in ARMS})
    pay = {}
    for arm, (x, y) in ARMS.items():
        share = F.col(f"_share_{arm}")
        flow = f(arm)
        pay.update({f"loop_{x}{y}": F.when(F.col(f"dir_{arm}") > 0, share).otherwise(0.0), f"loop_{y}{x}": F.when(F.col(f"dir_{arm}") < 0, share).otherwise(0.0),
                    f"sq_{x}{y}": F.when(flow > 0, F.greatest(a(arm), F.lit(0.0))).otherwise(0.0), f"sq_{y}{x}": F.when(flow < 0, F.greatest(a(arm), F.lit(0.0))).otherwise(0.0)})
    return d.withColumns(pay).drop("_total", "_gain", "_bad", "_kept", *[f"_share_{k}" for k in ARMS])


def margins(df: DataFrame, a: str, b: str) -> DataFrame:
    """Every row four times: (a, b), (a, all), (all, b), (all, all)."""
    def lab(x, y):
        return F.struct(x.alias("_a"), y.alias("_b"))
    every = F.lit("all")
    return df.withColumn("_m", F.explode(F.array(lab(F.col(a), F.col(b)), lab(F.col(a), every), lab(every, F.col(b)), lab(every, every)))).withColumns(
        {a: F.col("_m._a"), b: F.col("_m._b")}).drop("_m")


def premium_table(tranches: DataFrame, direction: str, horizon: str) -> DataFrame:
    """Value-weighted realised-to-paid ratio with margins.  Columns: price, units, per_unit, quarter."""
    d = margins(tranches.filter("units > 0 and price > 0").withColumn("ratio", F.col("per_unit") / F.col("price")), direction, horizon)
    by = [direction, horizon]
    s = d.groupBy(*by).agg(F.count(F.lit(1)).alias("tranches"), F.countDistinct("quarter").alias("quarters"),
                           (F.sum(F.col("per_unit") * F.col("units")) / F.sum(F.col("price") * F.col("units"))).alias("value_ratio"),
                           F.avg((F.col("ratio") > 1).cast("double")).alias("share_above"), F.avg(F.col("per_unit") - F.col("price")).alias("mean_premium"))
    return s.join(quantiles(d, by, "ratio", {"median_ratio": 0.5}).drop("n_values"), by)


def weekly_cash(series: DataFrame, keys: list[str], week: str, value: str, paid: Column, lag_days: int) -> DataFrame:
    """Total and value-weighted mean days from payment to the weekly receipts."""
    w = series.groupBy(*keys, week).agg(F.sum(value).alias("_v"))
    days = F.datediff((F.col(week) + F.expr(f"interval {lag_days} days")).cast("date"), paid.cast("date"))
    d = w.groupBy(*keys).agg(F.sum("_v").alias("realised"), F.sum(F.col("_v") * days).alias("_d"), F.avg(days).alias("_m"))
    return d.withColumn("mean_days", F.when(F.col("realised") > 0, F.col("_d") / F.col("realised")).otherwise(F.col("_m"))).drop("_d", "_m")


def annualised(total: Column, price: Column, days: Column) -> Column:
    r = total / price - 1
    return F.when(r > -1, F.pow(1 + r, 365 / F.greatest(days, F.lit(1.0))) - 1).otherwise(-1.0)


def hedge_stats(weeks: DataFrame, keys: list[str], payoff: str, spread: str, top: int) -> DataFrame:
    """Beta, R2, ratio overall and in the widest-spread weeks, minimum-variance units."""
    u, s = F.col(payoff), F.col(spread)
    d = weeks.groupBy(*keys).agg(F.count(F.lit(1)).alias("weeks"), F.covar_samp(u, s).alias("_c"), F.var_samp(s).alias("_vs"), F.var_samp(u).alias("_vu"),
                                 F.corr(u, s).alias("_r"), F.sum(u).alias("_u"), F.sum(s).alias("_s"))
    t = top_k(weeks, keys, [F.desc(spread), F.desc(payoff), F.col("week")], top).groupBy(*keys).agg((F.sum(u) / F.sum(s)).alias("ratio_top"))
    d = d.join(t, keys).withColumns({"beta": F.col("_c") / F.col("_vs"), "r2": F.col("_r") ** 2, "ratio_all": F.col("_u") / F.col("_s"), "units_min_var": F.col("_c") / F.col("_vu")})
    return d.withColumn("variance_reduction", 1 - (F.col("_vs") - 2 * F.col("units_min_var") * F.col("_c") + F.col("units_min_var") ** 2 * F.col("_vu")) / F.col("_vs")).drop(
        "_c", "_vs", "_vu", "_r", "_u", "_s")


def tail_frontier(weeks: DataFrame, keys: list[str], payoff: str, spread: str, cost: str, grid: list[float], alpha: float) -> DataFrame:
    """Loss quantile and tail mean of short spread plus n units, for each n of a short grid."""
    d = weeks.withColumn("units", F.explode(F.array(*[F.lit(float(x)) for x in grid]))).withColumn(
        "_loss", F.round(F.col(spread) - F.col("units") * (F.col(payoff) - F.col(cost)), 9))
    by = [*keys, "units"]
    q = quantiles(d, by, "_loss", {"var": alpha}).drop("n_values")
    d = d.join(q, by)
    return d.groupBy(*by).agg(F.avg(-F.col("_loss")).alias("mean_pnl"), F.max("var").alias("var"), F.avg(F.when(F.col("_loss") >= F.col("var"), F.col("_loss"))).alias("cvar"),
                              F.stddev_samp("_loss").alias("sd"))


def top_share(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """Share of the total held by the largest ``share`` of rows, without ordering a group in one task."""
    d = prefix_weights(df.withColumn("_neg", -F.col(value)), keys, ["_neg"])
    n = F.greatest(F.lit(1), F.floor(F.col("total") * share))
    take = F.greatest(F.least(F.col("weight"), n - F.col("below")), F.lit(0))
    return d.groupBy(*keys).agg(F.try_divide(F.sum(take * -F.col("_neg")), F.sum(F.col("weight") * -F.col("_neg"))).alias("top_share"))


def walk_forward(auctions: DataFrame, history: DataFrame, keys: list[str], wait: str) -> DataFrame:
    """Naive forecasts from quarters settled ``wait`` before each auction.  history has one
    row per key and quarter (a calendar-sized table): quarter_end, season, per_unit.  Auctions of
    one key, date and season share their forecasts, which are made once for them."""
    h = history.select(*keys, F.col("quarter_end").alias("_e"), F.col("season").alias("_s"), F.col("per_unit").alias("_v"))
    by = [*keys, "auction_date", "season"]
    j = auctions.select(*by).distinct().join(h, keys).filter(F.col("_e") + F.expr(f"interval {wait}") < F.col("auction_date"))
    w = Window.partitionBy(*by).orderBy(F.desc("_e"))
    ws = Window.partitionBy(*by, "_s").orderBy(F.desc("_e"))
    j = j.withColumns({"_rk": F.row_number().over(w), "_rs": F.row_number().over(ws)})

    def mean(n):
        return F.avg(F.when(F.col("_rk") <= n, F.col("_v")))
    d = j.groupBy(*by).agg(
        F.count(F.lit(1)).alias("history"), F.max(F.when(F.col("_rk") == 1, F.col("_v"))).alias("last_quarter"), mean(4).alias("trailing_4q"), mean(8).alias("trailing_8q"),
        mean(12).alias("trailing_12q"), F.avg(F.when((F.col("_s") == F.col("season")) & (F.col("_rs") <= 3), F.col("_v"))).alias("same_season"),
        F.collect_list(F.when(F.col("_rk") <= 8, F.col("_v"))).alias("members"))
    return null_safe_join(auctions, d.filter("history >= 4"), by)


def regime_option(df: DataFrame, keys: list[str], regime: str, period: str, spread: str, flow: str, back: int, sd_scale: float = 1.0) -> DataFrame:
    """Value of the spread option: regime mean and deviation over the previous ``back``
    periods (integer numbered), applied to the regimes seen in the period."""
    m = df.groupBy(*keys, regime, period).agg(F.count(spread).alias("n"), F.sum(spread).alias("s"), F.sum(F.col(spread) * F.col(spread)).alias("ss"), F.sum(F.greatest(F.col(flow), F.lit(0.0))).alias("f"))
    past = m.withColumn("_q", F.explode(F.sequence(F.col(period) + 1, F.col(period) + back))).groupBy(*keys, regime, "_q").agg(
        F.countDistinct(period).alias("_p"), *[F.sum(c).alias(c) for c in ("n", "s", "ss", "f")])
    n, s = F.col("n"), F.col("s")
    past = past.select(*keys, regime, F.col("_q").alias(period), (s / n).alias("mu"), F.when(n > 1, F.sqrt(F.greatest((F.col("ss") - s * s / n) / (n - 1), F.lit(0.0)))).alias("sd"), (F.col("f") / n).alias("flow_mean"))
    now = m.select(*keys, regime, period, F.col("n").alias("_n"))
    j = now.join(past, [*keys, regime, period], "left")
    call = bachelier_call(F.coalesce("mu", F.lit(0.0)), F.coalesce("sd", F.lit(1.0)) * sd_scale)
    return j.groupBy(*keys, period).agg((F.sum(F.col("_n") * F.coalesce("flow_mean", F.lit(0.0)) * call) / 12).alias("option_value"), F.sum("_n").alias("intervals"))


def offer_steepness(bands: DataFrame, keys: list[str], price: str, mw: str, clearing: str, step: float) -> DataFrame:
    """Price that must be paid to call ``step`` MW more than is offered at or below clearing."""
    cleared = bands.filter(F.col(price) <= F.col(clearing)).groupBy(*keys).agg(F.sum(mw).alias("cleared"))
    d = prefix_weights(bands.filter(F.col(mw) > 0), keys, [price], F.col(mw)).withColumn("_cum", F.col("below") + F.col("weight"))
    base = bands.groupBy(*keys).agg(F.max(clearing).alias(clearing)).join(cleared, keys, "left").withColumn("cleared", F.coalesce("cleared", F.lit(0.0)))
    nxt = d.join(base, keys).filter(F.col("_cum") >= F.col("cleared") + step).groupBy(*keys).agg(F.min(price).alias("next_price"))
    return base.join(nxt, keys, "left").withColumn("steepness", (F.col("next_price") - F.col(clearing)) / step)


def change_points(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Periods in which a slowly changing setting differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(period)
    d = df.filter(F.col(value).isNotNull()).withColumn("previous", F.lag(value).over(w))
    return d.filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


