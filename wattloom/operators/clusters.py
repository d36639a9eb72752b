"""State clusters and unit groups with pyspark.ml, and agreement measures."""
from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .ranks import quantiles


def state_clusters(train: DataFrame, rows: DataFrame, features: list[str], k: int, *, clip: float = 10.0, seed: int = 741, ood: float = 0.99) -> DataFrame:
    """Median-imputed, robust-scaled, clipped features to k-means clusters with canonical
    labels (centres in lexicographic order), distance to the centre and an out-of-range
    flag from the training distances."""
    filled = [f"_i_{f}" for f in features]
    prep = Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_v"),
                            RobustScaler(inputCol="_v", outputCol="_z", withCentering=True)]).fit(train)

    def ready(d):
        z = F.transform(vector_to_array("_z"), lambda x: F.greatest(F.least(x, F.lit(clip)), F.lit(-clip)))
        from pyspark.ml.functions import array_to_vector
        return prep.transform(d).withColumn("_a", z).withColumn("_x", array_to_vector("_a"))
    model = KMeans(k=k, seed=seed, featuresCol="_x", predictionCol="_c").fit(ready(train))
    centres = [[float(v) for v in c] for c in model.clusterCenters()]      # k x features numbers
    order = sorted(range(len(centres)), key=lambda i: centres[i])
    rank = F.create_map(*[F.lit(x) for new, old in enumerate(order) for x in (old, new)])
    table = F.array(*[F.array(*[F.lit(v) for v in c]) for c in centres])

    def assigned(d):
        c = F.element_at(table, F.col("_c") + 1)
        dist = F.sqrt(F.aggregate(F.zip_with("_a", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        return model.transform(ready(d)).withColumns({"cluster": F.element_at(rank, F.col("_c")), "distance": dist})
    limit = quantiles(assigned(train).withColumn("_g", F.lit(0)), ["_g"], "distance", {"_lim": ood}).select("_lim")
    out = assigned(rows).join(F.broadcast(limit))     # one row
    return out.withColumn("out_of_range", (F.col("distance") > F.col("_lim")).cast("int")).select(*rows.columns, "cluster", "distance", "out_of_range")


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labelings from their contingency counts."""
    n2 = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    c = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    ra = c.groupBy(a).agg(F.sum("n").alias("n")).agg(n2("n").alias("_a"))
    rb = c.groupBy(b).agg(F.sum("n").alias("n")).agg(n2("n").alias("_b"))
    s = c.agg(n2("n").alias("_ab"), F.sum("n").alias("_n")).join(F.broadcast(ra)).join(F.broadcast(rb))     # one row each
    expected = F.col("_a") * F.col("_b") / (F.col("_n") * (F.col("_n") - 1) / 2)
    top = (F.col("_a") + F.col("_b")) / 2
    return s.select(F.when(top == expected, 1.0).otherwise((F.col("_ab") - expected) / (top - expected)).alias("ari"))


def cluster_support(df: DataFrame, cluster: str, day: str, distance: str, flag: str) -> DataFrame:
    """Rows, days, out-of-range share and distance quantiles per cluster."""
    g = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(day).alias("days"), F.avg(F.col(flag).cast("double")).alias("ood_share"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    q = quantiles(df, [cluster], distance, {"median_distance": 0.5, "p95_distance": 0.95}).drop("n_values")
    return g.join(q, cluster).join(F.broadcast(total)).withColumn("row_share", F.col("rows") / F.col("_n")).drop("_n")


def centroid_distance(df: DataFrame, rid: str, vector: str, label: str) -> DataFrame:
    """Distance of each vector to the mean vector of its label, dimension by dimension."""
    long = df.select(rid, label, F.posexplode(vector).alias("_i", "_x"))
    c = long.groupBy(label, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    return long.join(c, [label, "_i"]).groupBy(rid, label).agg(F.sqrt(F.sum((F.col("_x") - F.col("_m")) ** 2)).alias("distance"))


def unit_groups(sens: DataFrame, exposure: DataFrame, unit: str, eq: str, dims: int, k: int, seed: int = 741) -> DataFrame:
    """k-means groups of units over exposure-weighted sensitivities, hashed to ``dims``
    columns so that the vector length does not follow the number of equations."""
    d = sens.join(exposure, eq).withColumn("_x", F.col("sensitivity") * F.col("weight")).withColumn("_j", F.pmod(F.xxhash64(F.col(eq)), F.lit(dims)).cast("int"))
    v = cut(d.groupBy(unit).pivot("_j", list(range(dims))).agg(F.sum("_x")).fillna(0.0), "unit_columns")      # the fit and its result both read it
    x = VectorAssembler(inputCols=[str(i) for i in range(dims)], outputCol="_v").transform(v)
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="group").fit(x).transform(x).select(unit, "group")


def signed_pressure(groups: DataFrame, moves: DataFrame, sens: DataFrame, unit: str, t: str, delta: str) -> DataFrame:
    """Positive and negative movement times mean sensitivity per unit group."""
    s = sens.groupBy(unit).agg(F.avg("sensitivity").alias("_s"))
    x = F.col(delta) * F.col("_s")
    d = moves.filter(F.col(delta).isNotNull()).join(s, unit).join(groups, unit)
    return d.groupBy("group", t).agg(F.sum(F.greatest(x, F.lit(0.0))).alias("relief"), F.sum(F.greatest(-x, F.lit(0.0))).alias("tightening"))
