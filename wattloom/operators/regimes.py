"""Conditional selection: analogues, tables, settings and input rules."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calendar import slot_distance
from ..session import cut
from .ranks import quantiles, weighted_quantiles
from .revisions import top_k


def _candidates(conditions: DataFrame, panel: DataFrame, cid: str, keys: list[str], slot: str, slots: int, radius: int) -> DataFrame:
    """Equi-join of conditions and history on keys and each slot within the radius; a
    condition meets a calendar-bounded number of rows (days x slots)."""
    around = F.array(*[F.pmod(F.col(f"q_{slot}") + o, F.lit(slots)) for o in range(-radius, radius + 1)])
    q = conditions.withColumn(slot, F.explode(around))
    return q.join(panel, [*keys, slot]).withColumn("_sd", slot_distance(F.col(slot), F.col(f"q_{slot}"), slots))


def select_analogues(conditions: DataFrame, panel: DataFrame, cid: str, keys: list[str], slot: str, slots: int, radius: int, features: dict[str, float], target: str, day: str,
                     rid: str, *, neighbour_days: int, min_days: int, threshold: float, probs: dict[str, float]) -> DataFrame:
    """Day-equal weighted quantiles of the target over the nearest analogue days.

    conditions: cid, keys, q_slot and q_<feature>; panel: keys, slot, features, target, day,
    rid.  Keys carry link, direction, era and outage state, which are never relaxed; the
    numeric conditions are dropped, with a label, when too few exact days remain."""
    d = _candidates(conditions, panel, cid, keys, slot, slots, radius)
    terms, exact = [(F.col("_sd") / 2) ** 2], F.lit(True)
    for f, scale in features.items():
        delta = F.col(f) - F.col(f"q_{f}")
        asked = F.col(f"q_{f}").isNotNull()
        terms.append(F.when(~asked, 0.0).otherwise(F.coalesce((delta / scale) ** 2, F.lit(16.0))))
        exact = exact & (~asked | F.coalesce(F.abs(delta) <= scale, F.lit(False)))
    n = reduce(lambda a, b: a + b, [F.col(f"q_{f}").isNotNull().cast("int") for f in features], F.lit(1))
    d = d.filter(F.col(target).isNotNull()).withColumns({"_d2": reduce(lambda a, b: a + b, terms) / n, "_x": exact})
    d = cut(d.select(cid, day, target, rid, "_d2", "_x"), "candidates")      # read four times below
    days = d.groupBy(cid).agg(F.countDistinct(F.when(F.col("_x"), F.col(day))).alias("exact_days"))
    d = d.join(days, cid).filter(F.col("_x") | (F.col("exact_days") < min_days))
    near = d.groupBy(cid, day).agg(F.min("_d2").alias("_m"))
    d = d.join(top_k(near, [cid], [F.round("_m", 9), F.col(day)], neighbour_days).select(cid, day), [cid, day], "left_semi")
    d = d.withColumn("_w", F.exp(-0.5 * F.least(F.sqrt("_d2"), F.lit(20.0)) ** 2))
    # a day holds as many rows as slots in reach; in a fixed order their sum has the same last digits in every run
    of_day = Window.partitionBy(cid, day).orderBy(rid, target).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = cut(d.withColumn("_w", F.col("_w") / F.sum("_w").over(of_day)), "analogues")
    s = d.groupBy(cid).agg(F.max("exact_days").alias("exact_days"), F.countDistinct(day).alias("analogue_days"),
                           (F.sum(F.when(F.col(target) < threshold, F.col("_w")).otherwise(0.0)) / F.sum("_w")).alias("restricted_share"), F.count(F.lit(1)).alias("rows"))
    q = weighted_quantiles(d, [cid], target, "_w", rid, probs, steady=True)
    ok = F.col("exact_days") >= min_days
    return conditions.select(cid).join(s.join(q, cid), cid, "left").withColumn(
        "status", F.when(F.col("rows").isNull(), "unavailable").when(ok, "supported_analogue").otherwise("broader_analogue"))


def conditional_table(conditions: DataFrame, panel: DataFrame, cid: str, keys: list[str], slot: str, slots: int, features: dict[str, float], target: str, day: str, min_days: int,
                      probs: dict[str, float]) -> DataFrame:
    """Plain quantiles of the exact cell; no relaxation."""
    d = _candidates(conditions, panel, cid, keys, slot, slots, 0)
    for f, scale in features.items():
        d = d.filter(F.col(f"q_{f}").isNull() | (F.abs(F.col(f) - F.col(f"q_{f}")) <= scale))
    s = d.groupBy(cid).agg(F.countDistinct(day).alias("days"), F.count(F.lit(1)).alias("rows"))
    q = quantiles(d, [cid], target, probs).drop("n_values")
    out = s.join(q, cid, "left")
    return conditions.select(cid).join(out, cid, "left").withColumn(
        "status", F.when(F.col("rows").isNull(), "unavailable").when(F.col("days") >= min_days, "supported_table").otherwise("indicative_table"))


def repeat_counts(rows: DataFrame, links: DataFrame, key: list[str], episodes: str, token: str) -> DataFrame:
    """Independent repeats of a token: distinct canonical ids of the episodes that carry it.
    links: episode, canonical_id, tokens."""
    e = rows.select(*key, token, F.explode(episodes).alias("episode")).distinct()
    hit = e.join(links, "episode").filter(F.array_contains(F.col("tokens"), F.col(token)) & F.col("canonical_id").isNotNull())
    return hit.groupBy(*key, token).agg(F.countDistinct("canonical_id").alias("repeats"))


def condition_settings(train: DataFrame, keys: list[str], features: list[str], target: str) -> DataFrame:
    """Scale (interquartile range), median, range per feature and the restriction threshold."""
    long = train.unpivot([*keys], features, "feature", "x").filter("x is not null")
    q = quantiles(long, [*keys, "feature"], "x", {"q25": 0.25, "median": 0.5, "q75": 0.75, "p20": 0.2, "p80": 0.8})
    r = long.groupBy(*keys, "feature").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    th = quantiles(train.filter(F.col(target) > 0), keys, target, {"_m": 0.5}).select(*keys, (F.col("_m") * 0.5).alias("threshold"))
    d = q.join(r, [*keys, "feature"]).join(th, keys, "left").filter("high > low")
    return d.select(*keys, "feature", "median", F.greatest(F.col("q75") - F.col("q25"), F.lit(1e-3)).alias("scale"), "low", "high", "p20", "p80", "threshold")


def input_eligibility(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows with the list of rules they break; an unknown rule result counts as broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    return df.withColumn("rejected_for", F.array_join(broken, ";")).withColumn("eligible", (F.size(broken) == 0).cast("int"))


def joint_configurations(df: DataFrame, keys: list[str], active: str, k: int) -> DataFrame:
    """Most frequent states with two or more active sets."""
    d = df.filter(F.size(F.split(active, r"\|")) >= 2).groupBy(*keys, active).agg(F.count(F.lit(1)).alias("n"))
    return top_k(d, keys, [F.desc("n"), F.col(active)], k, rank="rank")
