"""Model fits on pyspark.ml and closed-form ridges on grouped sums."""
from __future__ import annotations

import numpy as np

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .ranks import prefix_weights, quantiles


def winsorised(df: DataFrame, train: DataFrame, features: list[str], low: float = 0.001, high: float = 0.999) -> DataFrame:
    """Clip to training quantiles, fill with the clipped training median, mark what was missing."""
    long = train.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "x").filter("x is not null")
    q = quantiles(long, ["feature"], "x", {"lo": low, "mid": 0.5, "hi": high}).drop("n_values")
    flat = q.groupBy().pivot("feature", features).agg(F.first("lo").alias("lo"), F.first("mid").alias("mid"), F.first("hi").alias("hi"))
    d = df.join(F.broadcast(flat))      # one row of limits
    out = {}
    for f in features:
        clip = F.least(F.greatest(F.col(f), F.col(f"{f}_lo")), F.col(f"{f}_hi"))
        out[f"{f}_missing"] = F.col(f).isNull().cast("int")
        out[f] = F.coalesce(F.when(F.col(f).isNotNull(), clip), F.col(f"{f}_mid"))
    return d.withColumns({k: v for k, v in out.items() if k.endswith("_missing")}).withColumns({k: v for k, v in out.items() if not k.endswith("_missing")}).drop(
        *[f"{f}_{s}" for f in features for s in ("lo", "mid", "hi")])


def _matrix(features: list[str], scale: bool = False) -> list:
    a = VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip")
    return [a, StandardScaler(inputCol="_v", outputCol="_x", withMean=True, withStd=True)] if scale else [a.setOutputCol("_x")]


def _scored(model, rows: DataFrame, features: list[str], drop: list[str], scored: list[str]) -> DataFrame:
    """rows with the model's columns; a row with an unknown feature keeps its place, with null scores and the
    status ``unknown feature``."""
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    known = F.coalesce(known, F.lit(False))
    out = model.transform(rows.filter(known)).drop(*drop).withColumn("status", F.lit("scored"))
    rest = rows.filter(~known).withColumns({c: F.lit(None).cast("double") for c in scored} | {"status": F.lit("unknown feature")})
    return out.select(*rows.columns, *scored, "status").unionByName(rest)


def boosted_regressor(train: DataFrame, rows: DataFrame, features: list[str], target: str, trees: int = 20, depth: int = 4) -> DataFrame:
    m = Pipeline(stages=[*_matrix(features), GBTRegressor(featuresCol="_x", labelCol=target, lossType="absolute", maxIter=trees, maxDepth=depth, seed=741, predictionCol="prediction")]).fit(train)
    return _scored(m, rows, features, ["_x"], ["prediction"])


def ridge(train: DataFrame, rows: DataFrame, features: list[str], target: str, alpha: float, weight: str | None = None) -> DataFrame:
    lr = LinearRegression(featuresCol="_x", labelCol=target, regParam=alpha, elasticNetParam=0.0, predictionCol="prediction")
    if weight:
        lr = lr.setWeightCol(weight)
    return _scored(Pipeline(stages=[*_matrix(features, True), lr]).fit(train), rows, features, ["_v", "_x"], ["prediction"])


def anchored_ridge(train: DataFrame, rows: DataFrame, features: list[str], target: str, anchor: str, alpha: float) -> DataFrame:
    """Ridge on the change from an anchor forecast; the anchor is added back."""
    d = ridge(train.withColumn("_chg", F.col(target) - F.col(anchor)), rows, features, "_chg", alpha)
    return d.withColumn("prediction", F.col(anchor) + F.col("prediction"))


def group_line(train: DataFrame, keys: list[str], x: str, y: str, alpha: float) -> DataFrame:
    """Ridge line per group from sums: slope = Sxy / (Sxx + alpha), intercept through the means."""
    a, b = F.col(x), F.col(y)
    s = train.filter(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(a).alias("_mx"), F.avg(b).alias("_my"), (F.covar_pop(a, b) * F.count(F.lit(1))).alias("_sxy"), (F.var_pop(a) * F.count(F.lit(1))).alias("_sxx"))
    slope = F.col("_sxy") / (F.col("_sxx") + alpha)
    return s.select(*keys, "n", slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"))


def shrunk_experts(train: DataFrame, rows: DataFrame, key: str, x: str, y: str, alpha: float, minimum: int, pull: float) -> DataFrame:
    """Per-cluster line shrunk toward the pooled line by n / (n + pull); small clusters use the pool."""
    own = group_line(train, [key], x, y, alpha).select(key, "n", F.col("slope").alias("_s"), F.col("intercept").alias("_i"))
    pool = group_line(train.withColumn("_g", F.lit(0)), ["_g"], x, y, alpha).select(F.col("slope").alias("_ps"), F.col("intercept").alias("_pi"))
    w = F.when(F.coalesce("n", F.lit(0)) >= minimum, F.col("n") / (F.col("n") + pull)).otherwise(0.0)
    d = rows.join(own, key, "left").join(F.broadcast(pool)).withColumn("_w", w)      # one pooled row
    mix = lambda a, b: F.col("_w") * F.coalesce(a, F.lit(0.0)) + (1 - F.col("_w")) * F.col(b)
    return d.withColumn("prediction", mix("_s", "_ps") * F.col(x) + mix("_i", "_pi")).drop("n", "_s", "_i", "_ps", "_pi", "_w")


def normal_ridge(train: DataFrame, features: list[str], target: str, alpha: float) -> tuple[list[float], float]:
    """Slopes and intercept of a ridge through the means, from sums over the rows without unknowns: one aggregate of (features + 2) ** 2 / 2 numbers."""
    names = [*features, target]
    known = F.lit(True)
    for c in names:
        known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    x = [F.col(c).cast("double") for c in names]
    got = train.filter(known).agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[(F.covar_pop(x[i], x[j]) * F.count("*")).alias(f"s{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]).first()
    k = len(features)
    if got["m0"] is None:
        return [0.0] * k, 0.0
    s = np.array([[got[f"s{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    slopes = np.linalg.lstsq(s[:k, :k] + alpha * np.eye(k), s[:k, k], rcond=None)[0].tolist() if k else []
    return slopes, got[f"m{k}"] - sum(b * got[f"m{i}"] for i, b in enumerate(slopes))


def residual_stage(train: DataFrame, rows: DataFrame, origin: str, base: list[str], correction: list[str], target: str, alpha: float, *, early: float = 0.75, gap: str = "8 days") -> DataFrame:
    """rows with a prediction in two stages: a base, and a correction of what it leaves.

    The base is first fitted on origins that end ``gap`` before the one at the ``early`` share of all different origins, so that no target
    of it reaches the later ones; the correction is fitted on its residuals at that origin and later; then the base is refitted on all.  A row
    with an unknown feature gets a null prediction.  Without training rows the prediction is 0."""
    line = lambda fit, names: sum((F.col(c) * float(b) for c, b in zip(names, fit[0])), F.lit(float(fit[1])))      # noqa: E731
    known = train.filter(F.col(target).isNotNull() & F.col(origin).isNotNull())
    n = known.select(origin).distinct().count()
    if not n:
        return rows.withColumn("prediction", F.lit(0.0))
    order = prefix_weights(known.select(origin).distinct().withColumn("_g", F.lit(0)), ["_g"], [origin])
    split = order.filter(F.col("below") == int(n * early)).select(F.col(origin).alias("_split"))               # one row
    dated = known.join(F.broadcast(split))
    first = normal_ridge(dated.filter(F.col(origin) < F.col("_split") - F.expr(f"interval {gap}")), base, target, alpha)
    late = dated.filter(F.col(origin) >= F.col("_split")).withColumn("_left", F.col(target) - line(first, base))
    second = normal_ridge(late, correction, "_left", alpha)
    return rows.withColumn("prediction", line(normal_ridge(known, base, target, alpha), base) + line(second, correction))


def event_probability(train: DataFrame, calibrate: DataFrame, rows: DataFrame, features: list[str], label: str) -> DataFrame:
    """Logistic warning then logistic recalibration of its logit; a one-class training set
    gives its constant rate."""
    rate = train.agg(F.avg(F.col(label).cast("double")).alias("r")).first()["r"]
    if rate in (0.0, 1.0):
        return rows.withColumn("probability", F.lit(rate))
    first = Pipeline(stages=[*_matrix(features, True), LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.01, rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_c")]).fit(train)

    def logit(d):
        return first.transform(d).withColumn("_l", F.element_at(vector_to_array("_raw"), 2)).drop("_v", "_x", "_raw", "_p", "_c")
    second = Pipeline(stages=[VectorAssembler(inputCols=["_l"], outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol=label, rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_c")]).fit(logit(calibrate))
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    known = F.coalesce(known, F.lit(False))
    out = second.transform(logit(rows)).withColumn("probability", F.element_at(vector_to_array("_p"), 2)).drop("_x", "_raw", "_p", "_c", "_l")
    # a row with an unknown feature stays, with a null probability
    return out.unionByName(rows.filter(~known).withColumn("probability", F.lit(None).cast("double")))


def cross_fitted(df: DataFrame, folds: list[tuple[Column, Column]], features: list[str], label: str) -> DataFrame:
    """Out-of-fold probabilities over chronological (train, test) pairs."""
    out = None
    for train, test in folds:
        d = event_probability(df.filter(train), df.filter(train), df.filter(test), features, label)
        out = d if out is None else out.unionByName(d)
    return out


def expanding_lines(df: DataFrame, keys: list[str], period: str, x: str, y: str, alpha: float) -> DataFrame:
    """Out-of-fold forecast of each period from a ridge line on all earlier periods, by
    running sums over the periods of a key (a calendar-sized table)."""
    a, b = F.col(x), F.col(y)
    s = df.filter(a.isNotNull() & b.isNotNull()).groupBy(*keys, period).agg(F.count(F.lit(1)).alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(a * b).alias("sxy"))
    w = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    s = s.select(*keys, period, *[F.sum(c).over(w).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    n = F.col("n")
    slope = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / (F.col("sxx") - F.col("sx") ** 2 / n + alpha)
    fit = s.select(*keys, period, slope.alias("_b"), ((F.col("sy") - slope * F.col("sx")) / n).alias("_a"))
    return df.join(fit, [*keys, period]).withColumn("prediction", F.col("_a") + F.col("_b") * a).drop("_a", "_b")


def block_permutation(df: DataFrame, keys: list[str], t: str, features: dict[str, float], intercept: float, actual: str, group: list[str], days: int) -> DataFrame:
    """Loss increase when a feature group is taken from ``days`` earlier; the score is a
    fixed linear rule (features maps name to coefficient)."""
    moved = df.select(*keys, (F.col(t) + F.expr(f"interval {days} days")).alias(t), *[F.col(f).alias(f"_s_{f}") for f in group])
    d = df.join(moved, [*keys, t])
    base = sum((F.col(f) * c for f, c in features.items()), F.lit(intercept))
    alt = sum((F.col(f"_s_{f}" if f in group else f) * c for f, c in features.items()), F.lit(intercept))
    d = d.filter(base.isNotNull() & alt.isNotNull() & F.col(actual).isNotNull())
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col(actual) - base)).alias("base_mae"), F.avg(F.abs(F.col(actual) - alt)).alias("moved_mae")).withColumn(
        "increase", F.col("moved_mae") - F.col("base_mae"))


def chronological_search(train: DataFrame, select: DataFrame, features: list[str], target: str, alphas: list[float]) -> DataFrame:
    """A small fixed grid scored on the next time window; no search engine."""
    lr = LinearRegression(featuresCol="_x", labelCol=target, predictionCol="prediction")
    prep = Pipeline(stages=_matrix(features, True)).fit(train)
    grid = ParamGridBuilder().addGrid(lr.regParam, alphas).build()
    a, b = (cut(prep.transform(d).select("_x", target), "search") for d in (train, select))
    ev = RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="mae")
    rows = [(float(p[lr.regParam]), float(ev.evaluate(lr.copy(p).fit(a).transform(b)))) for p in grid]
    best = min(rows, key=lambda r: (r[1], r[0]))
    return train.sparkSession.createDataFrame([(x, m, int((x, m) == best)) for x, m in rows], "alpha double, mae double, chosen int")


def pooled_transfer(df: DataFrame, link: str, train: Column, features: list[str], target: str, alpha: float) -> DataFrame:
    """One ridge over all links on targets divided by each link's own spread."""
    s = df.filter(train).groupBy(link).agg(F.nullif(F.stddev_pop(target), F.lit(0.0)).alias("_sd"))
    d = df.join(s, link).filter("_sd is not null").withColumn("_y", F.col(target) / F.col("_sd"))
    out = ridge(d.filter(train), d, features, "_y", alpha)
    return out.withColumn("prediction", F.col("prediction") * F.col("_sd")).drop("_y", "_sd")
