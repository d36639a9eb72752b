"""Outage bookings, invocation state and matched comparison."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import joined
from .lookups import covered
from .ranks import quantiles
from .reshape import hash_order
from .revisions import top_k
from .sequence import merge_intervals, micros, time_chunk


def snapshot_changes(present: DataFrame, row: str, idx: str, first: Column, last: Column) -> DataFrame:
    """Appear and disappear events between consecutive snapshots: two anti-joins of the
    presence rows with themselves shifted by one snapshot."""
    p = present.select(row, idx).distinct()
    before = p.select(row, (F.col(idx) + 1).alias(idx))
    after = p.select(row, (F.col(idx) - 1).alias(idx))
    up = p.join(before, [row, idx], "left_anti").withColumn("present", F.lit(1))
    down = p.join(after, [row, idx], "left_anti").filter(F.col(idx) < last).select(row, (F.col(idx) + 1).alias(idx), F.lit(0).alias("present"))
    return up.filter(F.col(idx) >= first).unionByName(down)


def snapshot_at(changes: DataFrame, row: str, idx: str, at: Column) -> DataFrame:
    """Rows live at the last change up to ``at``."""
    return changes.filter(F.col(idx) <= at).groupBy(row).agg(F.max_by("present", F.col(idx)).alias("present"), F.max(idx).alias("since")).filter("present = 1").drop("present")


def episodes(assets: DataFrame, outage: str, rank: list[Column]) -> DataFrame:
    """One row per outage: window (actual where complete, else scheduled), primary asset by
    rank, number of assets.  assets carry sched_start/end, actual_start/end, asset."""
    ok = F.col("actual_start").isNotNull() & F.col("actual_end").isNotNull() & (F.col("actual_end") > F.col("actual_start"))
    d = assets.withColumns({"_s": F.when(ok, F.col("actual_start")).otherwise(F.col("sched_start")), "_e": F.when(ok, F.col("actual_end")).otherwise(F.col("sched_end")),
                            "_src": F.when(ok, "actual").otherwise("scheduled")}).filter(F.col("_e") > F.col("_s"))
    main = top_k(d, [outage], rank, 1).select(outage, F.col("asset").alias("primary_asset"))
    g = d.groupBy(outage).agg(F.min("_s").alias("start"), F.max("_e").alias("end"), F.min("_src").alias("window_source"), F.countDistinct("asset").alias("n_assets"))
    return g.join(main, outage)


def invocation_spells(df: DataFrame, inv: str, start: str, end: str, lo: Column, hi: Column) -> DataFrame:
    """Unique invocations clipped to the study window; open ends run to its end."""
    d = df.dropDuplicates([inv]).withColumn(end, F.coalesce(end, hi))
    d = d.filter((F.col(end) >= F.col(start)) & (F.col(end) > lo) & (F.col(start) <= hi))
    return d.withColumns({start: F.greatest(F.col(start), lo), end: F.least(F.col(end), hi)})


def family_relevance(leads: DataFrame, spells: DataFrame, family: str, direction: str, t: str, start: str, end: str, total_hours: Column, *, minimum: int = 12,
                     always: float = 0.95, hours: int) -> DataFrame:
    """Families that led while invoked often enough and were not always on."""
    hit = covered(leads, spells, [family], t, start, end, name="on", hours=hours).filter("on = 1")
    n = hit.groupBy(family, direction).agg(F.count(F.lit(1)).alias("_n")).groupBy(family).agg(F.max("_n").alias("max_leads"), F.sum("_n").alias("leads"))
    m = merge_intervals(spells.select(family, start, end), [family], start, end, hours=hours)
    share = m.groupBy(family).agg((F.sum(micros(F.col(end)) - micros(F.col(start))) / 3_600_000_000 / total_hours).alias("invoked_share"))
    d = n.join(share, family)
    reason = (F.when(F.col(family).cast("string").startswith("#"), "discretionary").when(F.col("invoked_share") > always, "always invoked")
              .when(F.col("max_leads") < minimum, "led too seldom").otherwise(""))
    return d.withColumn("reason", reason)


def active_sets(panel: DataFrame, coverage: DataFrame, keys: list[str], t: str, family: str, full: int, known_to: Column) -> DataFrame:
    """Outage state per interval with the fully and partly covered families as sorted text."""
    on, part = F.col("covered") == full, (F.col("covered") > 0) & (F.col("covered") < full)
    s = coverage.groupBy(*keys, t).agg(joined(F.collect_set(F.when(on, F.col(family)))).alias("active"), joined(F.collect_set(F.when(part, F.col(family)))).alias("partial"))
    d = panel.join(s, [*keys, t], "left").fillna("", ["active", "partial"])
    return d.withColumn("state", F.when(F.col(t) > known_to, "unknown").when(F.col("active") != "", "invoked").when(F.col("partial") != "", "partial").otherwise("clear"))


def _matches(treated: DataFrame, controls: DataFrame, unit: list[str], link: str, t: str, days: int, levels: dict[str, list[str]], slot: str, slots: int, k: int, seed: int,
             extra: Column, value: str | None = None) -> tuple[DataFrame, list[str]]:
    """Ranked controls of each treated unit, and the columns that a unit's rows are dealt by.

    The join key is the strata that all levels share plus a time bucket, and it is the controls that are copied into
    the two buckets within reach: all candidates of a unit then meet in one task, and rankings and sums over units need no further shuffle."""
    step = 48 * days
    first = time_chunk(F.col("control_time") - F.make_dt_interval(days=F.lit(days)), step)
    shared = [c for c in next(iter(levels.values())) if all(c in on for on in levels.values())]
    strata = list(dict.fromkeys([link, *[c for on in levels.values() for c in on], "fams"]))
    held = [F.col(value).alias("_cv")] if value else []
    c = controls.select(*[F.col(x).alias(f"_c_{x}") for x in strata], F.col("control_time"), F.col(slot).alias("_cslot"), micros(F.col("control_time")).alias("_cm"), *held,
                        F.explode(F.array(first, first + 1)).alias("_cb"))
    # the text of the unit and a hash of it: sorting compares one number in place of the unit's columns
    text = F.concat_ws("|", *[F.col(x).cast("string") for x in unit])
    t1 = treated.withColumns({"_b": time_chunk(F.col(t), step), "_m": micros(F.col(t)), "_text": text, "_u": F.xxhash64(*unit)})
    cond = F.col("_b") == F.col("_cb")
    for x in dict.fromkeys([link, *shared]):
        cond = cond & (F.col(x) == F.col(f"_c_{x}"))
    off = F.when(F.col(slot) == F.col("_cslot"), 0).when((F.pmod(F.col(slot) + 1, F.lit(slots)) == F.col("_cslot")) | (F.pmod(F.col(slot) - 1, F.lit(slots)) == F.col("_cslot")), 1)
    level = F.coalesce(*[F.when(reduce(Column.__and__, [F.col(x) == F.col(f"_c_{x}") for x in on], F.lit(True)), i) for i, on in enumerate(levels.values())])
    near = F.abs(F.col("_m") - F.col("_cm")) <= days * 86_400_000_000
    # extra may be dear, so it is asked last
    pairs = t1.join(c, cond & near & off.isNotNull() & level.isNotNull() & extra)
    pairs = pairs.withColumns({"_off": off, "_l": level, "_h": hash_order(["_text", "control_time"], seed)})
    keys = list(dict.fromkeys(["_u", link, "_b", *shared, *unit]))
    w = Window.partitionBy(*keys).orderBy("_l", "_off", "_h", "control_time")
    best = pairs.withColumns({"_place": F.row_number().over(w), "_first": F.min("_l").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return best.filter((F.col("_place") <= k) & (F.col("_l") == F.col("_first"))), keys


def _match_type(levels: dict[str, list[str]]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in levels]), F.col("_l")).alias("match_type")


def matched_pairs(treated: DataFrame, controls: DataFrame, unit: list[str], link: str, t: str, days: int, levels: dict[str, list[str]], slot: str, slots: int, k: int, seed: int,
                  extra: Column) -> DataFrame:
    """Up to k controls per treated unit within ``days``, exact strata first, then coarser.

    treated: unit, link, t, slot, strata columns; controls: link, control_time, slot,
    strata columns.  Candidates per unit are bounded by the calendar; a candidate has the first level whose strata
    agree, and a unit keeps those of its first level.  All levels share one join and one ranking."""
    best, _ = _matches(treated, controls, unit, link, t, days, levels, slot, slots, k, seed, extra)
    return best.select(*dict.fromkeys([*unit, link, t]), "control_time", _match_type(levels))


def matched_effects(treated: DataFrame, controls: DataFrame, unit: list[str], link: str, t: str, days: int, levels: dict[str, list[str]], slot: str, slots: int, k: int, seed: int,
                    extra: Column, value: str) -> DataFrame:
    """``unit_effects`` of ``matched_pairs`` where both sides carry the value: no pair is written or joined again.
    unit names link and t."""
    best, keys = _matches(treated, controls, unit, link, t, days, levels, slot, slots, k, seed, extra, value)
    places = [F.max(F.when(F.col("_place") == i, F.col("_cv"))).alias(f"_v{i}") for i in range(1, k + 1)]
    g = best.groupBy(*keys).agg(*places, F.count(F.lit(1)).alias("n_controls"), F.max("_l").alias("_l"), F.max(value).alias("treated"))
    g = g.withColumn("_vs", F.array_sort(F.array_compact(F.array(*[F.col(f"_v{i}") for i in range(1, k + 1)]))))
    last = F.size("_vs") - 1
    low, high = (F.get("_vs", F.floor(x / 2).cast("int")) for x in (last, last + 1))
    g = g.withColumn("control", F.when(last >= 0, F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)).cast("double"))
    return g.select(link, t, *[x for x in unit if x not in (link, t)], "control", "n_controls", _match_type(levels), "treated", (F.col("treated") - F.col("control")).alias("effect"))


def unit_effects(pairs: DataFrame, values: DataFrame, unit: list[str], link: str, t: str, value: str) -> DataFrame:
    """Treated value less the median of its (at most k) controls."""
    v = values.select(link, F.col(t).alias("_t"), F.col(value).alias("_v"))
    c = pairs.join(v.withColumnRenamed("_t", "control_time"), [link, "control_time"])
    med = c.groupBy(*unit, link, t).agg(F.percentile("_v", F.lit(0.5)).alias("control"), F.count(F.lit(1)).alias("n_controls"), F.max("match_type").alias("match_type"))
    return med.join(v.withColumnRenamed("_t", t).withColumnRenamed("_v", "treated"), [link, t]).withColumn("effect", F.col("treated") - F.col("control"))


def effect_summary(units: DataFrame, treated: DataFrame, keys: list[str]) -> DataFrame:
    """Match rate, median effect and match quality per key."""
    n = treated.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_treated"))
    m = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_matched"), F.avg((F.col("match_type") == "exact").cast("double")).alias("exact_share"))
    q = quantiles(units, keys, "effect", {"effect": 0.5}).drop("n_values")
    return n.join(m, keys, "left").join(q, keys, "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0))).withColumn("match_rate", F.col("n_matched") / F.col("n_treated"))


def evidence_tier(episodes_: Column, hours: Column, match_rate: Column, placebo_clean: Column, matched: Column) -> Column:
    ok = (match_rate >= 0.6) & placebo_clean
    return (F.when((episodes_ >= 5) & (hours >= 24) & ok, "supported")
            .when(((episodes_ >= 5) & ok) | (episodes_.between(3, 4) & (matched > 0)), "indicative").otherwise("unsupported"))


def balance(treated: DataFrame, pool: DataFrame, matched: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Standardised mean difference before and after matching, on the before scale.
    matched: keys, x (treated), control_x."""
    a = treated.groupBy(*keys).agg(F.avg(x).alias("_ta"), F.var_pop(x).alias("_tv"))
    b = pool.groupBy(*keys).agg(F.avg(x).alias("_pa"), F.var_pop(x).alias("_pv"))
    m = matched.groupBy(*keys).agg(F.avg(F.col(x) - F.col(f"control_{x}")).alias("_d"))
    s = F.sqrt((F.col("_tv") + F.col("_pv")) / 2)
    d = a.join(b, keys).join(m, keys, "left")
    return d.select(*keys, F.try_divide(F.col("_ta") - F.col("_pa"), s).alias("smd_before"), F.try_divide(F.col("_d"), s).alias("smd_after"))


def family_shares(pairs: DataFrame, layer: DataFrame, unit: list[str], keys: list[str], link: str, t: str, eq: str, share: str, k: int) -> DataFrame:
    """Mean share of each equation in treated intervals against the mean of the controls'
    means; the top movers per key."""
    y = layer.select(link, F.col(t).alias("_t"), eq, F.col(share).alias("_s"))
    n = pairs.groupBy(*unit, *[c for c in keys if c not in unit]).agg(F.count(F.lit(1)).alias("_nc"))
    units = n.groupBy(*keys).agg(F.count(F.lit(1)).alias("_units"))
    tr = pairs.select(*dict.fromkeys([*unit, *keys, link, t])).distinct().join(y.withColumnRenamed("_t", t), [link, t]).groupBy(*keys, eq).agg(F.sum("_s").alias("_ts"))
    ct = pairs.join(n, list(dict.fromkeys([*unit, *keys]))).join(y.withColumnRenamed("_t", "control_time"), [link, "control_time"]).groupBy(*keys, eq).agg(F.sum(F.col("_s") / F.col("_nc")).alias("_cs"))
    d = tr.join(ct, [*keys, eq], "full_outer").join(units, keys)
    d = d.select(*keys, eq, (F.coalesce("_ts", F.lit(0.0)) / F.col("_units")).alias("treated_share"), (F.coalesce("_cs", F.lit(0.0)) / F.col("_units")).alias("control_share"))
    d = d.withColumn("diff_pp", (F.col("treated_share") - F.col("control_share")) * 100)
    return top_k(d, keys, [F.desc(F.round(F.abs("diff_pp"), 7)), F.col(eq)], k)


def key_levels(units: DataFrame, levels: dict[str, Column], episode: str, minimum: int) -> DataFrame:
    """Effects for every level and key in one job; fewer episodes than minimum is unsupported."""
    tags = F.array(*[F.struct(F.lit(n).alias("level"), c.cast("string").alias("key")) for n, c in levels.items()])
    d = units.withColumn("_k", F.explode(tags)).select(*units.columns, "_k.*")
    s = d.groupBy("level", "key").agg(F.count(F.lit(1)).alias("units"), F.countDistinct(episode).alias("episodes"))
    return s.join(quantiles(d, ["level", "key"], "effect", {"effect": 0.5}).drop("n_values"), ["level", "key"]).withColumn(
        "tier", F.when(F.col("episodes") >= minimum, "estimated").otherwise("unsupported"))


def offset_profile(anchors: DataFrame, series: DataFrame, keys: list[str], t: str, value: str, lo: int, hi: int, step: str, by: list[str]) -> DataFrame:
    """Mean value by offset around anchors.  The planner sizes the anchors without their offsets, so a broadcast of them is ruled out."""
    a = anchors.withColumn("offset", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn(t, F.col("anchor_time") + F.col("offset") * F.expr(f"interval {step}"))
    d = a.hint("merge").join(series.select(*keys, t, value), [*keys, t])
    return d.groupBy(*by, "offset").agg(F.avg(value).alias("share"), F.count(value).alias("n"))


def inferred_families(bookings: DataFrame, history: DataFrame, bid: str, levels: dict[str, list[str]], episode: str, family: str, minimum: int, k: int) -> DataFrame:
    """Family distribution of past bookings on the finest level with enough episodes."""
    parts = []
    for i, (name, on) in enumerate(levels.items()):
        n = history.groupBy(*on).agg(F.countDistinct(episode).alias("_n")).filter(F.col("_n") >= minimum)
        f = history.select(*on, episode, family).distinct().groupBy(*on, family).agg(F.count(F.lit(1)).alias("_f"))
        top = top_k(f.join(n, on), on, [F.desc("_f"), F.col(family)], k)
        parts.append(bookings.join(top, on).select(bid, F.lit(i).alias("_l"), F.lit(name).alias("level"), family, (F.col("_f") / F.col("_n")).alias("probability"), F.col("_n").alias("episodes")))
    c = reduce(DataFrame.unionByName, parts)
    best = c.groupBy(bid).agg(F.min("_l").alias("_l"))
    return c.join(best, [bid, "_l"]).drop("_l")


def planned_hours(sets: DataFrame, periods: DataFrame, key: list[str], known: str, start: str, end: str) -> DataFrame:
    """Hours of sets planned before each period's cut-off, clipped to the period.
    periods is a calendar-sized table: period, cutoff, p_start, p_end."""
    first, last = (F.date_trunc("quarter", c).cast("timestamp_ntz") for c in (start, end))
    p = sets.withColumn("period", F.explode(F.sequence(first, last, F.expr("interval 3 months"))))
    d = p.join(periods, "period").filter((F.col(known) <= F.col("cutoff")) & (F.col(end) > F.col("p_start")) & (F.col(start) < F.col("p_end")))
    hours = (micros(F.least(F.col(end), F.col("p_end"))) - micros(F.greatest(F.col(start), F.col("p_start")))) / 3_600_000_000
    return d.groupBy(*key, "period").agg(F.sum(hours).alias("hours"), F.count(F.lit(1)).alias("sets"))


def network_flags(rows: DataFrame, versions: DataFrame, eq: str, version: str, as_of: Column, new_days: int, reversion_days: int) -> DataFrame:
    """Equation first seen, or re-versioned, shortly before as_of."""
    v = versions.groupBy(eq, version).agg(F.min("time").alias("_f")).groupBy(eq).agg(F.min("_f").alias("_first"), F.max("_f").alias("_last"))
    d = rows.join(v, eq, "left")
    return d.withColumns({"is_new": F.coalesce(F.col("_first") > as_of - F.expr(f"interval {new_days} days"), F.lit(False)).cast("int"),
                          "reversioned": F.coalesce((F.col("_last") > F.col("_first")) & (F.col("_last") > as_of - F.expr(f"interval {reversion_days} days")), F.lit(False)).cast("int")}).drop("_first", "_last")


def brier_skill(df: DataFrame, keys: list[str], outcome: str, forecast: str, baselines: list[str]) -> DataFrame:
    def se(c):
        return F.avg((F.col(c) - F.col(outcome)) ** 2)
    d = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), se(forecast).alias("brier"), *[se(b).alias(f"brier_{b}") for b in baselines])
    return d.withColumns({f"skill_{b}": 1 - F.try_divide("brier", f"brier_{b}") for b in baselines})


def isolated_effects(bookings: DataFrame, series: DataFrame, bid: str, keys: list[str], start: str, end: str, t: str, value: str, step: str, before: int, after: int, cycle: str,
                     cycles: int, needed: int) -> DataFrame:
    """After-less-before change at isolated booking starts against the same clock windows
    of earlier cycles; at least ``needed`` control windows.  Step and cycle have a fixed length.

    Series are cut into chunks as long as all windows of a booking together, so a booking has two rows at most, however
    many steps and cycles it has; the steps are told apart where the rows are joined."""
    from .lookups import overlapping
    w = F.expr(f"interval {step}")
    reach = bookings.select(F.col(bid).alias("_other"), *keys, F.col(start).alias("_os"), F.col(end).alias("_oe"))
    mine = bookings.withColumns({"_ws": F.col(start) - w * before, "_we": F.col(start) + w * after})
    busy = overlapping(mine.select(bid, *keys, "_ws", "_we"), reach, keys, ("_ws", "_we"), ("_os", "_oe"), hours=24 * 30, extra=F.col(bid) != F.col("_other")).select(bid).distinct()
    lone = bookings.join(busy, bid, "left_anti").select(bid, *[F.col(k).alias(f"_k_{k}") for k in keys], micros(F.col(start)).alias("_s"))
    one, turn = (micros(F.lit("1970-01-01").cast("timestamp_ntz") + F.expr(f"interval {x}")) for x in (step, cycle))
    wide = turn * cycles + one * (before + after)
    chunks = F.sequence(F.floor((F.col("_s") - turn * cycles - one * before) / wide), F.floor((F.col("_s") + one * (after - 1)) / wide))
    lone = lone.withColumn("_kb", F.explode(chunks))
    rows = series.select(*keys, micros(F.col(t)).alias("_m"), value).withColumn("_b", F.floor(F.col("_m") / wide))
    # the cycles back in whose window a row lies
    low = F.greatest(F.ceil((F.col("_s") - F.col("_m") - one * before) / turn), F.lit(0).cast("long"))
    high = F.least(F.floor((F.col("_s") - F.col("_m") + one * (after - 1)) / turn), F.lit(cycles).cast("long"))
    on = F.col("_b") == F.col("_kb")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    d = lone.hint("merge").join(rows, on & (low <= high))      # sized without its chunks, so never broadcast
    d = d.withColumn("lag", F.explode(F.sequence(low, high))).withColumn("_o", F.col("_m") - F.col("_s") + F.col("lag") * turn).filter(F.pmod("_o", one) == 0)
    pre, post = F.when(F.col("_o") < 0, F.col(value)), F.when(F.col("_o") >= 0, F.col(value))
    win = d.groupBy(bid, "lag").agg(F.avg(pre).alias("_a"), F.avg(post).alias("_b")).filter("_a is not null and _b is not null").withColumn("_d", F.col("_b") - F.col("_a"))
    own = win.filter("lag = 0").select(bid, F.col("_d").alias("change"))
    ctl = win.filter("lag > 0").groupBy(bid).agg(F.avg("_d").alias("control_change"), F.count(F.lit(1)).alias("controls")).filter(F.col("controls") >= needed)
    return own.join(ctl, bid).withColumn("effect", F.col("change") - F.col("control_change"))


