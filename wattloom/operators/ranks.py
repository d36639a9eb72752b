"""Exact order statistics that survive one group holding a third of all rows.

Spark's ``percentile`` keeps every distinct value of a group in one buffer and a
plain window sorts a whole group in one task.  Here a large group is cut into
value ranges first:

1. collapse equal (group, value) rows to one row with a weight (map-side combine);
2. for the 1,000 largest groups take about 256 split points each, picked by a
   hash of the value, so a recomputed task finds the same splits;
3. sum weights per (group, range), carry the sums forward over the few ranges,
   and run the ordered window only inside (group, range).

By pigeonhole every group outside the 1,000 largest holds under 1/1,000 of the
rows, and the split table has at most 1,000 rows of about 256 values, which is
why broadcasting it is safe at any input size.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

LARGEST_GROUPS = 1000
SPLITS = 256
SPLIT_FROM = 100_000


def _find_range(splits: Column, value: Column, steps: int = 10) -> Column:
    """Number of split points at or below value, by binary search in the array."""
    jumps = F.array(*[F.lit(1 << k) for k in reversed(range(steps))])
    return F.when(splits.isNull(), F.lit(0)).otherwise(F.aggregate(
        jumps, F.lit(0),
        lambda at, jump: F.when(F.get(splits, at + jump - 1) <= value, at + jump).otherwise(at)))


def value_ranges(df: DataFrame, keys: list[str], value: str, *, split_from: int = SPLIT_FROM,
                 splits: int = SPLITS, name: str = "_range") -> DataFrame:
    """Add an order-preserving range number inside each large group (0 elsewhere)."""
    large = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
             .filter(F.col("_n") > split_from)
             .orderBy(F.desc("_n"), *keys).limit(LARGEST_GROUPS))
    renamed = large.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_n")
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    tag = [f"_k{i}" for i in range(len(keys))]
    points = (df.join(F.broadcast(renamed), match)
              .filter(F.pmod(F.xxhash64(F.col(value), F.lit(17)), F.col("_n")) < splits)
              .groupBy(*tag).agg(F.sort_array(F.collect_list(value)).alias("_splits")))
    return (df.join(F.broadcast(points), match, "left")
            .withColumn(name, _find_range(F.col("_splits"), F.col(value)))
            .drop("_splits", *tag))


def prefix_weights(df: DataFrame, keys: list[str], order: list[str], weight: Column | None = None,
                   *, split_from: int = SPLIT_FROM, steady: bool = False) -> DataFrame:
    """One row per distinct (keys, order) with its weight, the weight strictly
    before it (``below``) and the group total (``total``).  Rows whose first
    order column is null are left out.  With steady, totals are summed in the stated order
    too, for one more shuffle: reruns and other layouts then give the same last digits."""
    w = F.count(F.lit(1)) if weight is None else F.sum(weight)
    flat = (df.filter(F.col(order[0]).isNotNull()).groupBy(*keys, *order).agg(w.alias("weight"))
            .withColumn("_o", F.col(order[0]) if len(order) == 1 else F.struct(*order)))
    held = list(keys)
    if not held:
        flat, held = flat.withColumn("_all", F.lit(0)), ["_all"]
    ranged = value_ranges(flat, held, "_o", split_from=split_from)
    over_ranges = Window.partitionBy(*held).orderBy("_range")
    inside = Window.partitionBy(*held, "_range").orderBy("_o")
    if steady:      # a range's sum is the end of its running sum
        run = ranged.withColumn("_run", F.sum("weight").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        sums = run.groupBy(*held, "_range").agg(F.max_by("_run", "_o").alias("_rw"))
    else:
        sums = ranged.groupBy(*held, "_range").agg(F.sum("weight").alias("_rw"))
    carried = (sums
               .withColumn("_before", F.coalesce(
                   F.sum("_rw").over(over_ranges.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0) * F.col("_rw")))
               .withColumn("total", F.sum("_rw").over(over_ranges.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
               .drop("_rw"))
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    out = null_safe_join(ranged, carried, held + ["_range"])
    return (out.withColumn("below", F.col("_before") + F.coalesce(
                F.sum("weight").over(inside), F.lit(0) * F.col("weight")))
            .drop("_o", "_range", "_before", "_all"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key."""
    other = right.select(*[F.col(c).alias(f"_j_{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(F.col(f"_j_{k}"))
    return left.join(other, on, how).drop(*[f"_j_{k}" for k in keys])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], *,
              weight: Column | None = None, split_from: int = SPLIT_FROM) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of probs."""
    d = prefix_weights(df, keys, [value], weight, split_from=split_from)
    aggs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("total") - 1)
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("below") <= pos) & (pos < F.col("below") + F.col("weight"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_{name}_f"))
    out = d.groupBy(*keys).agg(F.max("total").alias("_n"), *aggs)
    return out.select(*keys, F.col("_n").alias("n_values"), *[
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n)
        for n in probs])


def quantile_table(df: DataFrame, keys: list[str], measures: dict[str, dict[str, float]], *,
                   split_from: int = SPLIT_FROM) -> DataFrame:
    """Quantiles of several columns at once: measures maps column -> {name: p}.  The
    columns become rows first, so all of them share one pass."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in measures]).unpivot(list(keys), list(measures), "_measure", "_x")
    names = [(c, n) for c, probs in measures.items() for n in probs]
    if len({n for _, n in names}) != len(names):
        raise ValueError("quantile names must differ")
    d = prefix_weights(long, [*keys, "_measure"], ["_x"], split_from=split_from)
    aggs = []
    for c, n in names:
        at = F.lit(float(measures[c][n])) * (F.col("total") - 1)
        mine = F.col("_measure") == c
        for side, pos in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = mine & (F.col("below") <= pos) & (pos < F.col("below") + F.col("weight"))
            aggs.append(F.max(F.when(hit, F.col("_x"))).alias(f"_{n}_{side}"))
        aggs.append(F.max(F.when(mine, at - F.floor(at))).alias(f"_{n}_f"))
    out = d.groupBy(*keys).agg(*aggs)
    return out.select(*keys, *[(F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")).alias(n) for _, n in names])


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, tie: str,
                       probs: dict[str, float], *, split_from: int = SPLIT_FROM, steady: bool = False) -> DataFrame:
    """Quantiles by interpolating between the mid-points of cumulative weight.  Fractions of which many are lost in the
    sum need steady: rows share a mid-point there, and its last digit decides on which side of a probability they are."""
    d = (prefix_weights(df, keys, [value, tie], F.col(weight), split_from=split_from, steady=steady)
         .withColumn("_mid", (F.col("below") + F.col("weight") / 2) / F.col("total")))
    aggs = [F.min(value).alias("_min"), F.max(value).alias("_max")]
    for name, p in probs.items():
        left, right = F.col("_mid") <= p, F.col("_mid") >= p
        aggs += [F.max(F.when(left, F.struct("_mid", value))).alias(f"_{name}_l"),
                 F.min(F.when(right, F.struct("_mid", value))).alias(f"_{name}_r")]
    out = d.groupBy(*keys).agg(*aggs)
    cols = []
    for name, p in probs.items():
        l, r = F.col(f"_{name}_l"), F.col(f"_{name}_r")
        step = r["_mid"] - l["_mid"]
        cols.append(F.when(l.isNull(), F.col("_min")).when(r.isNull(), F.col("_max"))
                    .when(step == 0, r[value])
                    .otherwise(l[value] + (r[value] - l[value]) * (F.lit(p) - l["_mid"]) / step).alias(name))
    return out.select(*keys, *cols)


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str, *,
                  split_from: int = SPLIT_FROM) -> DataFrame:
    """(keys, value) -> rank with ties averaged."""
    d = prefix_weights(df, keys, [value], split_from=split_from)
    return d.select(*keys, value, (F.col("below") + (F.col("weight") + 1) / 2).alias(name))


def rank_correlation(df: DataFrame, keys: list[str], x: str, y: str, *, minimum: int = 20,
                     name: str = "rho", split_from: int = SPLIT_FROM) -> DataFrame:
    """Spearman correlation per group; null below the row gate or without variation.

    Rows are collapsed to distinct (keys, x, y) before the rank tables join, so a
    popular pair travels once; a popular x alone is left to the adaptive skew join.
    """
    pairs = (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
             .groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_c")))
    base = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = null_safe_join(null_safe_join(
        pairs, average_ranks(base, keys, x, "_rx", split_from=split_from), keys + [x]),
        average_ranks(base, keys, y, "_ry", split_from=split_from), keys + [y])
    c, a, b = F.col("_c"), F.col("_rx"), F.col("_ry")
    s = ranked.groupBy(*keys).agg(
        F.sum(c).alias("n_pairs"), F.sum(c * a).alias("_a"), F.sum(c * b).alias("_b"),
        F.sum(c * a * a).alias("_aa"), F.sum(c * b * b).alias("_bb"), F.sum(c * a * b).alias("_ab"))
    n = F.col("n_pairs")
    va, vb = n * F.col("_aa") - F.col("_a") ** 2, n * F.col("_bb") - F.col("_b") ** 2
    rho = (n * F.col("_ab") - F.col("_a") * F.col("_b")) / F.sqrt(va * vb)
    return s.select(*keys, "n_pairs",
                    F.when((n >= minimum) & (va > 0) & (vb > 0), rho).alias(name))


def quantile_grid(df: DataFrame, keys: list[str], value: str, cells: int, *, split_from: int = SPLIT_FROM) -> DataFrame:
    """cells + 1 equally spaced exact quantiles per group as rows (keys, knot, value).

    Every distinct value emits only the knots whose bracketing ranks it covers, in
    integer arithmetic, so the work is the group's distinct values plus cells."""
    d = prefix_weights(df, keys, [value], split_from=split_from)
    b, m, one = F.col("below"), cells, F.col("total") == 1
    lo_a = F.when(one, 0).otherwise(F.expr(f"(below * {m} + total - 2) div (total - 1)"))
    lo_b = F.when(one, m).otherwise(F.expr(f"((below + weight) * {m} + total - 2) div (total - 1)") - 1)
    hi_a = F.when(one, 0).otherwise(F.when(b == 0, 0).otherwise(F.expr(f"((below - 1) * {m}) div (total - 1)") + 1))
    hi_b = F.when(one, m).otherwise(F.expr(f"((below + weight - 1) * {m}) div (total - 1)"))

    def emit(a, z, side):
        z = F.least(z, F.lit(m))
        return d.filter(a <= z).select(*keys, F.explode(F.sequence(a.cast("long"), z.cast("long"))).alias("knot"),
                                       "total", F.col(value).alias(side))
    both = emit(lo_a, lo_b, "_lo").unionByName(emit(hi_a, hi_b, "_hi"), True)
    g = both.groupBy(*keys, "knot").agg(F.max("total").alias("n_values"), F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    frac = F.pmod(F.col("knot") * (F.col("n_values") - 1), F.lit(m)) / m
    return g.select(*keys, "knot", "n_values", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac).alias(value))


def interpolated_cdf(knots: Column, x: Column, cells: int) -> Column:
    """Share of an equally spaced quantile array at or below x, linear between knots."""
    i = _find_range(knots, x)
    left, right = F.get(knots, i - 1), F.get(knots, i)
    return (F.when(i == 0, 0.0).when(i > cells, 1.0)
            .otherwise((i - 1 + (x - left) / (right - left)) / cells))
