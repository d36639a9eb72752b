"""Choosing the right revision of a record.

``row_number() <= k`` filters are planned with a group limit *before* the
shuffle, so at most k rows per key and map task are exchanged however large a
key is; that is why they are used here and not a sort of whole groups.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _desc(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_last()


def top_k(df: DataFrame, keys: list, order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return out.withColumnRenamed("_rn", rank) if rank else out.drop("_rn")


def latest(df: DataFrame, keys: list, newest: list) -> DataFrame:
    """One row per key: the highest by the columns in newest, nulls lowest.
    The last entry should be unique inside a key."""
    return top_k(df, keys, [_desc(c) for c in newest], 1)


def run_selection(df: DataFrame, keys: list[str], intervention: str, run: str, changed: str,
                  tie: str, pricing: bool = False) -> DataFrame:
    """Physical run: last by (intervention, run, changed).  The pricing run keeps
    only rows outside an intervention."""
    if pricing:
        df = df.filter(F.coalesce(F.col(intervention), F.lit(0)) == 0)
    return latest(df, keys, [intervention, run, changed, tie])


def latest_version(df: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """All rows of the newest version per id (rank, so every member row stays)."""
    w = Window.partitionBy(*key).orderBy(*[_desc(c) for c in version])
    return df.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")


def conflict_count(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose revisions disagree in any of the value columns."""
    lows = [F.min(v).alias(f"_lo{i}") for i, v in enumerate(values)]
    highs = [F.max(v).alias(f"_hi{i}") for i, v in enumerate(values)]
    differs = F.lit(False)
    for i in range(len(values)):
        differs = differs | (F.col(f"_lo{i}") != F.col(f"_hi{i}"))
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *lows, *highs)
            .filter(differs).select(*keys, "n_rows"))


def explicit_or_latest(requests: DataFrame, history: DataFrame, key: str, version: str,
                       newest: list[str], payload: list[str]) -> DataFrame:
    """Use the recorded version when a request names one, else the newest row."""
    named = (requests.filter(F.col(version).isNotNull())
             .join(history.select(key, version, *payload), [key, version], "left")
             .withColumn("branch", F.lit("explicit")))
    newest_rows = latest(history, [key], newest).select(key, F.col(version).alias("_v"), *payload)
    open_ = (requests.filter(F.col(version).isNull()).drop(version)
             .join(newest_rows, key, "left").withColumnRenamed("_v", version)
             .withColumn("branch", F.lit("latest")))
    return named.unionByName(open_)


def replace_revisions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Newer ids replace older rows."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
