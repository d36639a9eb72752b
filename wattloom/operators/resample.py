"""Block bootstraps and multiple-test rules.

Losses collapse to one row per day (or cluster) before anything is drawn; the draw
tables come from a text hash, so every engine and every retry draws the same days.
The fan-out is replicates x days of summary rows and does not grow with the data."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .forecast import draw_below, uniform


def day_index(days: DataFrame, keys: list[str], day: str, sums: list[str]) -> DataFrame:
    """Dense day rows 0..n-1 per key; missing days stay as zero rows so that blocks never
    join distant days."""
    span = days.groupBy(*keys).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    grid = span.select(*keys, "_a", F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))
    d = grid.join(days, [*keys, day], "left").fillna(0, sums)
    return d.withColumn("idx", F.datediff(F.col(day).cast("date"), F.col("_a").cast("date"))).drop("_a")


def block_draws(sizes: DataFrame, keys: list[str], n: str, block: int | Column, reps: int, seed: int, circular: bool = False) -> DataFrame:
    """(keys, rep, idx): contiguous blocks of days, ``n`` days per replicate."""
    b = F.lit(block) if isinstance(block, int) else block
    d = sizes.withColumn("_block", b).filter(F.col(n) >= F.col("_block"))
    d = d.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    d = d.withColumn("_slot", F.explode(F.sequence(F.lit(0), (F.ceil(F.col(n) / F.col("_block")) - 1).cast("int"))))
    choices = F.col(n) if circular else F.col(n) - F.col("_block") + 1
    d = d.withColumn("_start", F.floor(uniform(F.col("rep"), F.col("_slot"), F.lit(seed)) * choices).cast("int"))
    d = d.withColumn("_off", F.explode(F.sequence(F.lit(0), (F.col("_block") - 1).cast("int")))).filter(
        F.col("_slot") * F.col("_block") + F.col("_off") < F.col(n))
    idx = F.col("_start") + F.col("_off")
    return d.select(*keys, *(["_block"] if not isinstance(block, int) else []), "rep", (F.pmod(idx, F.col(n)) if circular else idx).cast("int").alias("idx"))


def block_bootstrap(days: DataFrame, keys: list[str], sums: list[str], statistic: Column, block: int, reps: int, seed: int, *, circular: bool = False,
                    low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Interval of a ratio statistic (written over summed columns) from resampled days.
    ``days`` is indexed by ``day_index``; per key at most ``reps`` values are ranked."""
    n = days.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_n"), *[F.sum(c).alias(c) for c in sums])
    draws = block_draws(n.select(*keys, "_n"), keys, "_n", block, reps, seed, circular)
    rep = draws.join(days, [*keys, "idx"]).groupBy(*keys, "rep").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("_s", statistic)
    ci = rep.groupBy(*keys).agg(F.percentile("_s", F.lit(low)).alias("ci_low"), F.percentile("_s", F.lit(high)).alias("ci_high"), F.count("_s").alias("replicates"))
    return n.select(*keys, F.col("_n").alias("n_days"), statistic.alias("estimate")).join(ci, keys, "left")


def cluster_bootstrap(clusters: DataFrame, keys: list[str], cluster: str, sums: list[str], statistic: Column, reps: int, seed: int) -> DataFrame:
    """Whole clusters drawn with replacement.  ``clusters`` has one row per cluster."""
    idx = F.row_number().over(Window.partitionBy(*keys).orderBy(cluster)) - 1
    return block_bootstrap(clusters.withColumn("idx", idx), keys, sums, statistic, 1, reps, seed)


def weighted_median_ci(units: DataFrame, keys: list[str], day: str, value: str, reps: int, seed: int) -> DataFrame:
    """Interval of the median when whole days are drawn with replacement: each replicate
    weights its units by the number of times their day was drawn."""
    days = units.select(*keys, day).distinct().withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy(day)) - 1)
    n = days.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    w = block_draws(n, keys, "_n", 1, reps, seed).groupBy(*keys, "rep", "idx").agg(F.count(F.lit(1)).alias("w"))
    per = units.groupBy(*keys, day, value).agg(F.count(F.lit(1)).alias("_c"))
    d = per.join(days, [*keys, day]).join(w, [*keys, "idx"]).groupBy(*keys, "rep", value).agg(F.sum(F.col("w") * F.col("_c")).alias("_w"))
    run = Window.partitionBy(*keys, "rep").orderBy(value)
    d = d.withColumns({"_cum": F.sum("_w").over(run), "_tot": F.sum("_w").over(Window.partitionBy(*keys, "rep"))})
    med = d.filter(F.col("_cum") >= F.col("_tot") / 2).groupBy(*keys, "rep").agg(F.min(value).alias("_m"))
    return med.groupBy(*keys).agg(F.percentile("_m", F.lit(0.025)).alias("ci_low"), F.percentile("_m", F.lit(0.975)).alias("ci_high"))


def numbered_draws(df: DataFrame, keys: list[str], n: str, reps: int, seed: int) -> DataFrame:
    """A row for each replicate and number from 1 to n, with the text its draw is hashed from.  The rows before the numbers are few bytes
    and all of the work, so they are dealt over a given number of tasks, which adaptive planning leaves alone."""
    d = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    d = d.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *[F.col(k) for k in keys], F.col("rep"))
    d = d.withColumn("_head", F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("rep"), F.lit("")))
    d = d.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return d.withColumn("_text", F.concat("_head", F.col("_i").cast("string"), F.lit(f"|{seed}")))


def binomial_interval(df: DataFrame, keys: list[str], n: str, hits: str, reps: int, seed: int) -> DataFrame:
    """Recall interval: each replicate draws every incident's outcome by its hit rate."""
    d = numbered_draws(df, keys, n, reps, seed)
    r = d.groupBy(*keys, "rep").agg(F.avg(draw_below(F.col("_text"), F.col(hits) / F.col(n)).cast("double")).alias("_r"))
    ci = r.groupBy(*keys).agg(F.percentile("_r", F.lit(0.025)).alias("ci_low"), F.percentile("_r", F.lit(0.975)).alias("ci_high"))
    return df.withColumn("recall", F.col(hits) / F.col(n)).join(ci, keys)


def holm(df: DataFrame, keys: list[str], p: str, tie: list[str]) -> DataFrame:
    """Step-down adjusted p-values per family; unknown values stay unknown.  A family is a
    report's list of cells, so its window is small."""
    w = Window.partitionBy(*keys).orderBy(F.col(p).asc_nulls_last(), *tie)
    n = F.count(p).over(Window.partitionBy(*keys))
    step = (n - F.row_number().over(w) + 1) * F.col(p)
    d = df.withColumn("_s", step)
    return d.withColumn("adjusted", F.when(F.col(p).isNotNull(), F.least(F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1.0)))).drop("_s")


def block_evidence(days: DataFrame, keys: list[str], idx: str, values: list[str], block: int, reps: int, seed: int) -> DataFrame:
    """Means of day means inside fixed blocks, resampled over blocks: one-sided p of the
    first value being negative and the upper limits of the others."""
    blocks = days.groupBy(*keys, F.floor(F.col(idx) / block).alias("_b")).agg(*[F.avg(v).alias(v) for v in values])
    pos = F.row_number().over(Window.partitionBy(*keys).orderBy("_b")) - 1
    blocks = blocks.withColumn("idx", pos)
    n = blocks.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("_n"), *[F.avg(v).alias(f"_m_{v}") for v in values]).filter("_n >= 4")
    draws = block_draws(n.select(*keys, "_n"), keys, "_n", 1, reps, seed)
    rep = draws.join(blocks, [*keys, "idx"]).groupBy(*keys, "rep").agg(*[F.avg(v).alias(v) for v in values]).join(n, keys)
    v0 = values[0]
    hit = F.count(F.when(F.round(F.col(v0) - F.col(f"_m_{v0}") - F.col(f"_m_{v0}"), 12) <= 0, 1))
    return rep.groupBy(*keys).agg(F.max("_n").alias("blocks"), ((hit + 1) / (F.count(F.lit(1)) + 1)).alias("pvalue"),
                                  *[F.max(f"_m_{v}").alias(v) for v in values], *[F.percentile(v, F.lit(0.95)).alias(f"{v}_upper") for v in values])


def confidence_set(days: DataFrame, models: list[str], block: int, reps: int, seed: int, level: float = 0.9) -> DataFrame:
    """Sequential elimination of the worst model until equal ability is not rejected.

    Replicate means of every model are Spark sums over day losses; the elimination then
    works on reps x models numbers, whose size is fixed by its arguments."""
    import numpy as np
    d = days.withColumn("_k", F.lit(0))
    n = d.groupBy("_k").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    rep = block_draws(n, ["_k"], "_n", block, reps, seed).join(d, ["_k", "idx"]).groupBy("rep").agg(*[F.avg(m).alias(m) for m in models])
    boot = np.array([[r[m] for m in models] for r in rep.orderBy("rep").collect()])
    mean = np.array([d.agg(*[F.avg(m).alias(m) for m in models]).first()[m] for m in models])
    active, rows = list(range(len(models))), []
    while len(active) > 1:
        a, b = mean[active], boot[:, active]
        diff = a[:, None] - a[None, :]
        dev = (b[:, :, None] - b[:, None, :]) - diff
        scale = np.maximum(dev.std(axis=0, ddof=1), 1e-12)
        seen = np.abs(diff / scale).max()
        p = float((1 + (np.abs(dev / scale).max(axis=(1, 2)) >= seen).sum()) / (1 + len(dev)))
        worst = active[int(np.argmax(a))]
        rows.append((len(rows), "|".join(models[i] for i in active), p, models[worst], int(p <= 1 - level)))
        if p > 1 - level:
            break
        active.remove(worst)
    return days.sparkSession.createDataFrame(rows, "step int, members string, p_equal double, worst string, removed int")


