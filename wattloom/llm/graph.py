"""Connected components of an edge table, by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hangs its larger (large star) or its smaller (small star) neighbours on the least of its neighbourhood.

    The least neighbour is a partial aggregate; the join back is a plain equi-join, so that a node with
    very many neighbours is split by adaptive execution and never gathered."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.col("w")).alias("m"))
    if large:
        out = near.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        hung = near.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = hung.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the edges (u, v), which are long, the least node that it reaches.

    Rounds end when a round changes nothing, after about log(longest path) of them; each round is written
    to the shared folder.  Loops and repeated edges do no harm; no edges give no rows.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    mark = [F.count("*"), F.bit_xor(F.xxhash64("u", "v"))]
    before = tuple(e.agg(*mark).first())
    while before[0]:
        e = cut(_star(_star(e, True), False), "edges")
        now = tuple(e.agg(*mark).first())
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
