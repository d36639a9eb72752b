"""Signed components of a sparse unit-by-equation table, by block power iteration on joins.

The table stays as rows (unit, equation, value).  A round multiplies a block of ``components`` + EXTRA vectors by the table and by its
transpose, each a join and a grouped sum; the block is made orthonormal from its Gram matrix, a few numbers on the driver.
The last round's projection gives singular values and vectors (Rayleigh-Ritz)."""
from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame, functions as F

from ..session import cut

EXTRA = 4


def _times(table: DataFrame, block: DataFrame, over: str, by: str, width: int) -> DataFrame:
    """(by, c0 ...): sums of value times the block's rows of ``over``."""
    return table.join(block, over).groupBy(by).agg(*[F.sum(F.col("_v") * F.col(f"c{k}")).alias(f"c{k}") for k in range(width)])


def _gram(block: DataFrame, width: int) -> np.ndarray:
    got = block.agg(*[F.sum(F.col(f"c{a}") * F.col(f"c{b}")).alias(f"g{a}_{b}") for a in range(width) for b in range(a, width)]).first()
    g = np.zeros((width, width))
    for a in range(width):
        for b in range(a, width):
            g[a, b] = g[b, a] = got[f"g{a}_{b}"] or 0.0
    return g


def _turned(block: DataFrame, key: str, turn: np.ndarray) -> DataFrame:
    """The block's rows times a matrix."""
    width, out = turn.shape
    return block.select(key, *[sum((F.col(f"c{a}") * float(turn[a, k]) for a in range(width)), F.lit(0.0)).alias(f"c{k}") for k in range(out)])


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """The matrix that makes a block of this Gram matrix orthonormal; directions without length are left out."""
    values, vectors = np.linalg.eigh(gram)
    keep = values > max(values.max(initial=0.0), 0.0) * 1e-14
    return vectors[:, keep] / np.sqrt(values[keep]) if keep.any() else np.zeros((len(gram), 0))


def signed_components(table: DataFrame, unit: str, eq: str, value: str, components: int, *, rounds: int = 12, seed: int = 741) -> DataFrame:
    """(unit, component, loading, singular_value) of the first components by singular value, fewer if the table has a lower rank.

    loading is the unit's entry of the left singular vector, whose entry of largest size (ties to the smaller unit) is positive.  Rows with
    a null value or key count as absent and repeated cells add up."""
    t = table.filter(F.col(value).isNotNull() & F.col(unit).isNotNull() & F.col(eq).isNotNull()).groupBy(unit, eq).agg(F.sum(value).alias("_v")).filter("_v <> 0")
    t = cut(t, "table")
    width = components + EXTRA
    # unlike starts: signs by hash, the same in every run
    block = t.select(eq).distinct().select(eq, *[(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.col(eq).cast("string")), F.lit(2001)) / 1000.0 - 1.0).alias(f"c{k}") for k in range(width)])
    turn = None
    for _ in range(rounds):
        left = cut(_times(t, block, eq, unit, width), "left")
        turn = _orthonormal(_gram(left, width))
        width = turn.shape[1]
        if not width:
            return t.sparkSession.createDataFrame([], f"{unit} {dict(t.dtypes)[unit]}, component int, loading double, singular_value double")
        block = cut(_times(t, _turned(left, unit, turn), unit, eq, width), "right")
    # left is spanned by U = left turn; the table's transpose times U has the singular values
    values, vectors = np.linalg.eigh(_gram(block, width))
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > 1e-12 * max(values.max(), 1e-300)]
    own = cut(_turned(_turned(left, unit, turn), unit, vectors[:, order]), "components")
    n = len(order)
    top = own.agg(*[F.max(F.round(F.abs(f"c{k}"), 9)).alias(f"t{k}") for k in range(n)]).first()
    first = own.agg(*[F.min(F.when(F.round(F.abs(f"c{k}"), 9) == F.lit(top[f"t{k}"]), F.struct(F.col(unit), F.col(f"c{k}").alias("c")))).alias(f"f{k}") for k in range(n)]).first()
    sign = [1.0 if first[f"f{k}"]["c"] >= 0 else -1.0 for k in range(n)]
    rows = F.array(*[F.struct(F.lit(k).alias("component"), (F.col(f"c{k}") * sign[k]).alias("loading"), F.lit(float(np.sqrt(values[j]))).alias("singular_value")) for k, j in enumerate(order)])
    return own.select(unit, F.explode(rows).alias("_r")).select(unit, "_r.*")


def component_pressure(moves: DataFrame, loadings: DataFrame, sens: DataFrame, unit: str, eq: str, at: list[str], delta: str, value: str) -> DataFrame:
    """(at, eq, component, relief, tightening): the equation's score on each component times the movement's, split by sign.

    sens: (unit, eq, value); moves: (at, unit, delta)."""
    scores = sens.filter(F.col(value).isNotNull()).join(loadings, unit).groupBy(eq, "component").agg(F.sum(F.col(value) * F.col("loading")).alias("_e"))
    moved = moves.filter(F.col(delta).isNotNull()).join(loadings, unit).groupBy(*at, "component").agg(F.sum(F.col(delta) * F.col("loading")).alias("_m"))
    x = F.col("_e") * F.col("_m")
    return moved.join(scores, "component").select(*at, eq, "component", F.greatest(x, F.lit(0.0)).alias("relief"), F.greatest(-x, F.lit(0.0)).alias("tightening"))


def manual_groups(units: DataFrame, named: DataFrame, unit: str, group: str, other: str = "other") -> DataFrame:
    """(unit, group): each unit's named group, else ``other``; the least name where a unit has several."""
    own = named.groupBy(unit).agg(F.min(group).alias(group))
    return units.select(unit).distinct().join(own, unit, "left").withColumn(group, F.coalesce(group, F.lit(other)))
