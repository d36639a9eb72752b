"""Forecast tables, scoring, calibration and alerts."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.maths import interval_score, pinball
from .lookups import bracket
from .ranks import interpolated_cdf, null_safe_join, prefix_weights, quantile_grid, quantiles
from .revisions import top_k
from .sequence import islands, micros, previous


def uniform(*parts: Column) -> Column:
    """Repeatable uniform number in [0, 1) from a text hash of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / 4294967296.0


def draw_below(text: Column, p: Column) -> Column:
    """``uniform(...) < p`` for the joined parts, without turning the hash into a number: the first eight hex digits
    are compared with those of p * 2 ** 32, rounded up, as text."""
    bound = F.ceil(p * 4294967296.0)
    return F.md5(text) < F.when(bound > 4294967295, "g").when(bound <= 0, "").otherwise(F.lpad(F.lower(F.hex(bound)), 8, "0"))


def origin_lead_grid(origins: DataFrame, origin: str, leads: list[int], step: str, end: Column) -> DataFrame:
    """Every origin with every lead whose delivery lies inside the split."""
    d = origins.withColumn("lead", F.explode(F.array(*[F.lit(x) for x in leads])))
    return d.withColumn("time", F.col(origin) + F.col("lead") * F.expr(f"interval {step}")).filter(F.col("time") <= end)


def training_leads(origins: DataFrame, origin: str, bands: list[tuple[int, int]], seed: int) -> DataFrame:
    """One seeded lead per band and origin."""
    pick = [F.struct(F.lit(i).alias("band"), (F.floor(uniform(F.col(origin), F.lit(i), F.lit(seed)) * (b - a + 1)) + a).cast("int").alias("lead"))
            for i, (a, b) in enumerate(bands)]
    return origins.withColumn("_l", F.explode(F.array(*pick))).select(*origins.columns, "_l.*")


def at_offset(rows: DataFrame, series: DataFrame, keys: list[str], stamp: Column, columns: dict[str, str], t: str = "time") -> DataFrame:
    """Series values at a computed stamp by equi-join; columns maps new name -> source."""
    s = series.select(*keys, F.col(t).alias("_at"), *[F.col(c).alias(n) for n, c in columns.items()])
    return rows.withColumn("_at", stamp).join(s, [*keys, "_at"], "left").drop("_at")


def censored(value: Column, published: Column, origin: Column) -> Column:
    """Null where the value was not yet published at the origin."""
    return F.when(published <= origin, value)


def naive_forecasts(rows: DataFrame, series: DataFrame, keys: list[str], value: str, published: str, step: str, cycle: int) -> DataFrame:
    """Persistence (one step back, two when the last is late) and same slot one cycle ago
    (two cycles when that slot is not older than the origin)."""
    one = F.expr(f"interval {step}")
    d = at_offset(rows, series, keys, F.col("origin") - one, {"_p1": value, "_pub": published})
    d = at_offset(d, series, keys, F.col("origin") - one - one, {"_p2": value})
    late = F.col("_pub") > F.col("origin")
    back = F.when(F.col("lead") - cycle >= 0, F.lit(2 * cycle)).otherwise(F.lit(cycle))
    d = at_offset(d.withColumn("_back", back), series, keys, F.col("time") - F.col("_back") * one, {"seasonal": value})
    return d.withColumn("persistence", F.when(late, F.col("_p2")).otherwise(F.col("_p1"))).drop("_p1", "_p2", "_pub", "_back")


def pair_features(df: DataFrame, t: list[str], region: str, values: list[str], floor: float) -> DataFrame:
    """Sum, difference, absolute and normalised difference for every region pair a < b."""
    long = df.unpivot([*t, region], values, "variable", "x")
    a = long.select(*t, "variable", F.col(region).alias("a"), F.col("x").alias("_x"))
    b = long.select(*t, "variable", F.col(region).alias("b"), F.col("x").alias("_y"))
    x, y = F.col("_x"), F.col("_y")
    return a.join(b, [*t, "variable"]).filter("a < b").select(
        *t, "variable", "a", "b", (x + y).alias("sum"), (x - y).alias("difference"), F.abs(x - y).alias("abs_difference"),
        ((x - y) / F.greatest(F.abs(x) + F.abs(y), F.lit(float(floor)))).alias("normalized"))


def run_ramps(df: DataFrame, run: list[str], keys: list[str], t: str, value: str, steps: list[str]) -> DataFrame:
    """Change over each span inside one run; null where the earlier stamp is not in the run."""
    out = df
    for i, s in enumerate(steps):
        prev = df.select(*run, *keys, (F.col(t) + F.expr(f"interval {s}")).alias(t), F.col(value).alias("_v"))
        out = out.join(prev, [*run, *keys, t], "left").withColumn(f"ramp_{i}", F.col(value) - F.col("_v")).drop("_v")
    return out


def feature_screen(df: DataFrame, features: list[str], parents: dict[str, list[str]], *, null_share: float = 0.8, same: float = 0.98) -> DataFrame:
    """Drop mostly null, constant and near-duplicate features, then restore parents of
    what is kept.  The rank correlations are Spark jobs; the keep rule runs on the driver
    over one number per feature pair."""
    from ..session import cut
    from .ranks import average_ranks, rank_correlation
    one = df.agg(*[F.avg(F.when(F.col(f).isNull(), 1.0).otherwise(0.0)).alias(f"n_{f}") for f in features],
                 *[(F.min(f) == F.max(f)).alias(f"c_{f}") for f in features]).first()
    usable = [f for f in features if one[f"n_{f}"] <= null_share and not one[f"c_{f}"]]
    keep: list[str] = []
    reason = {f: ("null" if one[f"n_{f}"] > null_share else "constant") for f in features if f not in usable}
    rho = {}
    whole = [f for f in usable if one[f"n_{f}"] == 0]
    if len(whole) > 1:
        # features without nulls are ranked once: a row becomes a row a feature and comes back with its ranks
        d = cut(df.select(*[F.col(f).cast("double").alias(f) for f in whole]).withColumn("_row", F.monotonically_increasing_id()), "screened")
        long = d.unpivot(["_row"], whole, "_f", "_x")
        ranked = long.join(average_ranks(long, ["_f"], "_x", "_rank"), ["_f", "_x"]).groupBy("_row").pivot("_f", whole).agg(F.first("_rank"))
        both = [(a, b) for i, b in enumerate(whole) for a in whole[:i]]
        got = ranked.agg(F.count("*").alias("n"), *[F.corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"r{k}") for k, (a, b) in enumerate(both)]).first()
        rho = {p: abs(got[f"r{k}"] or 0.0) if got["n"] >= 20 else 0.0 for k, p in enumerate(both)}
    pairs = [(a, b) for i, b in enumerate(usable) for a in usable[:i] if (a, b) not in rho]
    if pairs:
        # ranks of the others are over the rows that a pair has in common: one long table keyed by pair
        cells = F.array(*[F.struct(F.lit(k).alias("_pair"), F.col(a).cast("double").alias("_x"), F.col(b).cast("double").alias("_y")) for k, (a, b) in enumerate(pairs)])
        long = df.select(F.explode(cells).alias("_s")).select("_s.*").filter("_x is not null and _y is not null")
        rho |= {pairs[r["_pair"]]: abs(r["rho"] or 0.0) for r in rank_correlation(long, ["_pair"], "_x", "_y").collect()}      # one number a pair
    for f in usable:
        twin = next((a for a in keep if rho.get((a, f), 0.0) > same), None)
        if twin is None:
            keep.append(f)
        else:
            reason[f] = f"same as {twin}"
    for f in list(keep):
        for p in parents.get(f, []):
            if p not in keep:
                keep.append(p)
                reason[p] = "restored parent"
    rows = [(f, float(one[f"n_{f}"]), int(f in keep), reason.get(f, "kept")) for f in features]
    return df.sparkSession.createDataFrame(rows, "feature string, null_share double, kept int, reason string")


def expanding_folds(start: str, end: str, train_days: int, parts: list[tuple[str, int]], advance: int) -> list[dict]:
    """Fold table as plain dates: training from start, then consecutive parts."""
    import datetime as dt
    s, e, day = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end), dt.timedelta(days=1)
    folds, cut = [], s + train_days * day
    while True:
        edges, at = [("train", s, cut)], cut
        for name, n in parts:
            edges.append((name, at, at + n * day))
            at += n * day
        if at > e:
            return folds
        folds.append({"fold": len(folds), "windows": edges})
        cut += advance * day


def assign_partitions(df: DataFrame, folds: list[dict], origin: str, delivery: str, delay: str) -> DataFrame:
    """Rows with every (fold, partition) they may enter: origin inside the window and
    delivery matured strictly before its end.  Folds are a short list of literals, so the
    assignment is one projection and no join."""
    at = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
    ripe = F.col(delivery) + F.expr(f"interval {delay}")
    hits = [F.when((F.col(origin) >= at(a)) & (ripe < at(b)), F.struct(F.lit(f["fold"]).alias("fold"), F.lit(n).alias("partition")))
            for f in folds for n, a, b in f["windows"]]
    return df.withColumn("_p", F.explode(F.array_compact(F.array(*hits)))).select(*df.columns, "_p.*")


def purge_incidents(df: DataFrame, rid: list[str], t: str, ids: str, boundary: Column) -> DataFrame:
    """Drop rows of any episode that has rows on both sides of the boundary."""
    d = df.select(*rid, t, F.explode(ids).alias("_e"))
    cross = d.groupBy("_e").agg(F.min(t).alias("_a"), F.max(t).alias("_b")).filter((F.col("_a") < boundary) & (F.col("_b") >= boundary))
    return df.join(d.join(cross, "_e", "left_semi").select(*rid).distinct(), rid, "left_anti")


def origin_weights(df: DataFrame, origin: list[str]) -> DataFrame:
    return df.join(df.groupBy(*origin).agg((1 / F.count(F.lit(1))).alias("weight")), origin)


def point_metrics(df: DataFrame, keys: list[str], actual: str, forecast: str, floor: float = 50.0, tails: bool = True) -> DataFrame:
    """n, MAE, RMSE, bias, mean overstatement, floored MAPE and absolute-error tails."""
    d = df.filter(F.col(actual).isNotNull() & F.col(forecast).isNotNull()).withColumn("_e", F.col(forecast) - F.col(actual))
    e = F.col("_e")
    out = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.avg(F.greatest(e, F.lit(0.0))).alias("overstatement"), F.avg(F.abs(e) / F.greatest(F.abs(F.col(actual)), F.lit(floor))).alias("mape"))
    if tails:
        q = quantiles(d.withColumn("_ae", F.abs(e)), keys, "_ae", {"p95": 0.95, "p99": 0.99}).drop("n_values")
        out = null_safe_join(out, q, keys)
    return out


def interval_metrics(df: DataFrame, keys: list[str], actual: str, median: str, lo80: str, hi80: str, lo95: str, hi95: str) -> DataFrame:
    y, m, a, b, c, d = (F.col(x) for x in (actual, median, lo80, hi80, lo95, hi95))
    s80, s95 = interval_score(y, a, b, 0.2), interval_score(y, c, d, 0.05)
    hit = lambda lo, hi: F.avg(F.when((y >= lo) & (y <= hi), 1.0).otherwise(0.0))
    cross = (c > a) | (a > m) | (m > b) | (b > d)
    return df.filter(y.isNotNull() & m.isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), hit(a, b).alias("coverage_80"), F.avg(b - a).alias("width_80"), F.avg(s80).alias("score_80"),
        hit(c, d).alias("coverage_95"), F.avg(d - c).alias("width_95"), F.avg(s95).alias("score_95"),
        F.avg(F.when(cross, 1.0).otherwise(0.0)).alias("crossing_rate"),
        F.avg((F.abs(y - m) * 0.5 + s80 * 0.1 + s95 * 0.025) / 2.5).alias("wis"),
        F.avg((pinball(y, a, 0.1) + pinball(y, m, 0.5) + pinball(y, b, 0.9)) / 3).alias("pinball"))


def residual_adjustments(train: DataFrame, cell: list[str], actual: str, forecast: str, probs: dict[str, float], minimum: int) -> tuple[DataFrame, DataFrame]:
    """Residual quantiles per cell with at least ``minimum`` rows, and pooled ones."""
    d = train.withColumn("_r", F.col(actual) - F.col(forecast)).filter(F.col("_r").isNotNull())
    own = quantiles(d, cell, "_r", {f"c_{n}": p for n, p in probs.items()}).filter(F.col("n_values") >= minimum).drop("n_values")
    pooled = quantiles(d.withColumn("_g", F.lit(1)), ["_g"], "_r", {f"g_{n}": p for n, p in probs.items()}).drop("n_values")
    return own, pooled


def calibrated(df: DataFrame, own: DataFrame, pooled: DataFrame, cell: list[str], forecast: str, names: list[str]) -> DataFrame:
    """Forecast plus the cell's residual quantile, or the pooled one.  The pooled table
    is a single row, hence the broadcast."""
    d = null_safe_join(df, own, cell, "left").withColumn("_g", F.lit(1)).join(F.broadcast(pooled), "_g", "left")
    d = d.withColumns({n: F.col(forecast) + F.coalesce(f"c_{n}", f"g_{n}") for n in names})
    return d.drop("_g", *[f"{p}_{n}" for p in "cg" for n in names])


def exceedance_probability(df: DataFrame, train: DataFrame, cell: list[str], actual: str, forecast: str, threshold: str, cells: int = 500) -> DataFrame:
    """P(actual < threshold) from the interpolated residual distribution of the cell."""
    knots = quantile_grid(train.withColumn("_r", F.col(actual) - F.col(forecast)), cell, "_r", cells)
    arr = knots.groupBy(*cell).agg(F.transform(F.array_sort(F.collect_list(F.struct("knot", "_r"))), lambda s: s["_r"]).alias("_k"))
    return df.join(arr, cell, "left").withColumn("probability", interpolated_cdf(F.col("_k"), F.col(threshold) - F.col(forecast), cells)).drop("_k")


def confusion_by_cutoff(df: DataFrame, cell: list[str], probability: str, outcome: str, cutoffs: list[float]) -> DataFrame:
    """tp, fp, fn at every cutoff.  Rows collapse to (cell, number of cutoffs reached)
    first; the cutoffs multiply only that small table."""
    reached = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cutoffs]), lambda c: c <= F.col(probability)))
    h = df.filter(F.col(probability).isNotNull() & F.col(outcome).isNotNull()).groupBy(*cell, reached.alias("_b")).agg(
        F.sum(F.col(outcome).cast("long")).alias("_y"), F.count(F.lit(1)).alias("_n"))
    grid = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(c)).alias("cutoff")) for i, c in enumerate(cutoffs)])
    d = h.withColumn("_c", F.explode(grid)).select(*cell, "_b", "_y", "_n", "_c.*")
    on = F.col("_b") > F.col("_i")
    return d.groupBy(*cell, "cutoff").agg(F.sum(F.when(on, F.col("_y")).otherwise(0)).alias("tp"), F.sum(F.when(on, F.col("_n") - F.col("_y")).otherwise(0)).alias("fp"),
                                          F.sum(F.when(on, 0).otherwise(F.col("_y"))).alias("fn"))


def best_f2(conf: DataFrame, cell: list[str]) -> DataFrame:
    f2 = 5 * F.col("tp") / F.greatest(5 * F.col("tp") + 4 * F.col("fn") + F.col("fp"), F.lit(1))
    return conf.withColumn("f2", f2).groupBy(*cell).agg(F.max(F.struct("f2", "cutoff")).alias("_m")).select(*cell, "_m.*")


def joint_budget(conf: DataFrame, cell: list[str], direction: str, days: float, budget: float) -> DataFrame:
    """Cutoff pair over two directions with most hits whose joint false alarms per day
    stay within budget; among equals the lower burden, then the higher cutoffs."""
    rate = (F.col("fp") / days).alias("rate")
    a = conf.filter(F.col(direction) == "forward").select(*cell, F.col("cutoff").alias("forward"), F.col("tp").alias("_a"), rate)
    b = conf.filter(F.col(direction) == "reverse").select(*cell, F.col("cutoff").alias("reverse"), F.col("tp").alias("_b"), rate.alias("_rb"))
    d = a.join(b, cell).withColumn("burden", F.col("rate") + F.col("_rb")).filter(F.col("burden") <= budget)
    return top_k(d, cell, [F.desc(F.col("_a") + F.col("_b")), F.col("burden"), F.desc(F.col("forward") + F.col("reverse")), F.desc("forward")], 1).select(
        *cell, "forward", "reverse", (F.col("_a") + F.col("_b")).alias("tp"), "burden")


def model_choice(df: DataFrame, cell: list[str], actual: str, methods: list[str]) -> DataFrame:
    d = df.select(*cell, actual, *methods).unpivot([*cell, actual], methods, "method", "_f").groupBy(*cell, "method").agg(
        F.avg(F.abs(F.col("_f") - F.col(actual))).alias("mae"))
    return d.withColumn("_m", F.round("mae", 9)).groupBy(*cell).agg(F.min_by(F.struct("method", "mae"), F.struct("_m", "method")).alias("_b")).select(*cell, "_b.*")


def refractory_alarms(df: DataFrame, keys: list[str], t: str, wait: str) -> DataFrame:
    """Alarms at least ``wait`` apart, taken greedily in time order.

    A silence of ``wait`` or more resets the rule, so candidates are cut into islands at
    such gaps; islands are spread over tasks, which pass once over sorted rows keeping only
    the last alarm in memory."""
    step = F.expr(f"interval {wait}")
    d = df.select(*keys, t).distinct()
    d = previous(d, keys, [t], {"_p": t})
    d = islands(d, keys, [t], F.col("_p").isNull() | (F.col(t) >= F.col("_p") + step), "_i")
    wait_us = int(pd.Timedelta(wait).total_seconds() * 1_000_000)
    d = d.withColumn("_us", micros(F.col(t)))

    by = [*keys, "_i"]

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last = None, None
        for b in batches:
            keep = []
            for *group, us in b.itertuples(index=False, name=None):
                if group != now:
                    now, last = group, None
                keep.append(last is None or us - last >= wait_us)
                last = us if keep[-1] else last
            yield b.loc[keep, [*keys, "_us"]]
    d = d.select(*by, "_us").repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by, "_us")
    out = d.mapInPandas(greedy, d.select(*keys, "_us").schema)
    return out.select(*keys, F.timestamp_micros("_us").cast("timestamp_ntz").alias(t))


def match_alarms(alarms: DataFrame, incidents: DataFrame, keys: list[str], t: str, at: str, lo: str, hi: str) -> DataFrame:
    """First incident lo..hi ahead of each alarm.  With alarms at least hi apart the
    windows are disjoint, so the match is one to one without further bookkeeping."""
    a = alarms.withColumn("_q", F.col(t) + F.expr(f"interval {lo}"))
    f = incidents.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_one"))
    b = bracket(a, f, keys, "_q", "_at", "_one")
    hit = F.when(F.col("before.at") == F.col("_q"), F.col("before.at")).otherwise(F.col("after.at"))
    return b.withColumn("_hit", hit).select(*keys, t, F.when(F.col("_hit") <= F.col(t) + F.expr(f"interval {hi}"), F.col("_hit")).alias("matched"))


def reliability(df: DataFrame, probability: str, outcome: str, bins: int = 10) -> DataFrame:
    p = F.col(probability)
    return df.filter(p.isNotNull() & F.col(outcome).isNotNull()).groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(outcome).cast("double")).alias("observed"))


def probability_scores(df: DataFrame, keys: list[str], probability: str, outcome: str) -> DataFrame:
    """Brier score, log loss and average precision (recall steps times precision over
    distinct scores; running counts come from the split rank tables)."""
    eps = 1e-6
    p, y = F.col("_p"), F.col("_y")
    d = df.select(*keys, F.greatest(F.least(F.col(probability), F.lit(1 - eps)), F.lit(eps)).alias("_p"), F.col(outcome).cast("double").alias("_y"))
    s = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("positives"), F.avg((p - y) * (p - y)).alias("brier"),
                             F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))
    neg = d.withColumn("_neg", -p)
    n = prefix_weights(neg, keys, ["_neg"]).select(*keys, "_neg", (F.col("below") + F.col("weight")).alias("_all"))
    h = prefix_weights(neg, keys, ["_neg"], y).select(*keys, "_neg", F.col("weight").alias("_w"), (F.col("below") + F.col("weight")).alias("_hits"), "total")
    ap = null_safe_join(n, h, [*keys, "_neg"]).groupBy(*keys).agg(F.try_divide(F.sum(F.col("_w") * F.col("_hits") / F.col("_all")), F.max("total")).alias("average_precision"))
    return null_safe_join(s, ap, keys, "left") if keys else s.join(F.broadcast(ap))


def scorecard(df: DataFrame, keys: list[str]) -> DataFrame:
    """Requested and unscored rows, error, skill over the baseline, coverage and status.
    Columns: status, actual, forecast_mw, baseline_mw, p10, p90, p02, p97."""
    ok = (F.col("status") == "complete") & F.col("actual").isNotNull() & F.col("forecast_mw").isNotNull()
    e = F.abs(F.col("forecast_mw") - F.col("actual"))
    pair = ok & F.col("baseline_mw").isNotNull()
    inside = lambda a, b: F.avg(F.when(ok, ((F.col("actual") >= F.col(a)) & (F.col("actual") <= F.col(b))).cast("double")))
    d = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("requested"), F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("unscored"), F.avg(F.when(ok, e)).alias("mae"),
        F.avg(F.when(pair, e)).alias("_m"), F.avg(F.when(pair, F.abs(F.col("baseline_mw") - F.col("actual")))).alias("baseline_mae"),
        inside("p10", "p90").alias("coverage_80"), inside("p02", "p97").alias("coverage_95"))
    good = (F.col("coverage_80") >= 0.77) & (F.col("coverage_95") >= 0.92)
    return d.withColumns({"skill": 1 - F.try_divide("_m", "baseline_mae"), "calibration": F.when(good, "calibrated").otherwise("experimental")}).drop("_m")


def routed(requests: DataFrame, models: DataFrame, keys: list[str], rid: list[str]) -> DataFrame:
    """First eligible model of the ranked list, with the reasons the others failed.
    models: keys, rank, model, status, cutoff, max_lead."""
    c = requests.join(models, keys)
    why = (F.when(F.col("status") != "approved", "not approved").when(F.col("cutoff") > F.col("origin"), "trained after origin")
           .when(F.col("lead") > F.col("max_lead"), "lead not served"))
    c = c.withColumn("_why", why)
    best = c.groupBy(*rid).agg(F.min_by("model", F.when(F.col("_why").isNull(), F.col("rank"))).alias("model"),
                               F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_why").isNotNull(), F.struct("rank", "model", "_why")))),
                                                        lambda s: F.concat(s["model"], F.lit(": "), s["_why"])), "; ").alias("failures"))
    return best.withColumn("status", F.when(F.col("model").isNull(), "unavailable").otherwise("routed"))


def input_check(df: DataFrame, keys: list[str], t: str, start: Column, steps: int, step: str, values: list[str]) -> DataFrame:
    """Per key: missing stamps of the required run of steps, and bad values."""
    need = df.select(*keys).distinct().withColumn(t, F.explode(F.sequence(start, start + F.expr(f"interval {step}") * (steps - 1), F.expr(f"interval {step}"))))
    miss = need.join(df.select(*keys, t), [*keys, t], "left_anti").groupBy(*keys).agg(F.count(F.lit(1)).alias("missing"))
    bad = reduce(lambda a, b: a | b, [F.col(v).isNull() | F.isnan(v) | (F.col(v) < 0) for v in values])
    b = df.groupBy(*keys).agg(F.count(F.when(bad, 1)).alias("bad_values"), F.count(F.lit(1)).alias("rows"))
    return b.join(miss, keys, "left").withColumn("missing", F.coalesce("missing", F.lit(0)))


def seasonal_lookup(train: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median per slot, global median for slots never seen in training."""
    q = quantiles(train, keys, value, {"_own": 0.5}).drop("n_values")
    g = quantiles(train.withColumn("_g", F.lit(1)), ["_g"], value, {"_all": 0.5}).drop("n_values")
    d = null_safe_join(rows, q, keys, "left").withColumn("_g", F.lit(1)).join(F.broadcast(g), "_g", "left")
    return d.withColumn("forecast", F.coalesce("_own", "_all")).drop("_g", "_own", "_all")
