"""Top-k, fallback levels, set operations, reshaping and systematic samples."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .revisions import top_k


def tagged_union(parts: dict[str, DataFrame], key: list[str], tag: str) -> DataFrame:
    """Union of selections with the sorted list of reasons per row key."""
    both = reduce(DataFrame.unionByName, [d.select(*key).withColumn("_w", F.lit(n)) for n, d in parts.items()])
    return both.groupBy(*key).agg(F.array_join(F.sort_array(F.collect_set("_w")), ";").alias(tag))


def hash_order(columns: list[str], seed: int) -> Column:
    """Repeatable pseudo-random order of rows: a text hash, the same in any engine."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def one_per_stratum(df: DataFrame, strata: list[str], unique: list[str], seed: int) -> DataFrame:
    """A repeatable pick: lowest seeded hash of the row id."""
    return top_k(df, strata, [hash_order(unique, seed), *[F.col(c) for c in unique]], 1)


def fallback_levels(requests: DataFrame, table: DataFrame, levels: dict[str, list[str]], payload: list[str], fixed: tuple[str, ...] = ()) -> DataFrame:
    """Distinct requests with the row of the finest key set that has one, level 'none' where there is none.
    ``table`` has one row per (level, key columns of that level), other keys null.

    Requests are dealt once, by the finest keys: repeats meet there, and so do the rows of the first level.  The levels
    named in ``fixed`` have a size that does not grow with the input and are broadcast, since few keys would share all requests."""
    d = requests.repartition(*next(iter(levels.values()))).distinct()
    for name, keys in levels.items():
        rows = table.filter(F.col("level") == name).select(*keys, F.struct(*payload).alias(f"_{name}"))
        d = d.join(F.broadcast(rows) if name in fixed else rows, keys, "left")
    found = F.coalesce(*[F.col(f"_{n}") for n in levels])
    level = F.coalesce(*[F.when(F.col(f"_{n}").isNotNull(), n) for n in levels], F.lit("none"))
    return d.withColumns({"_found": found, "level": level}).select(*requests.columns, *[F.col(f"_found.{p}").alias(p) for p in payload], "level")


def backoff_lookup(requests: DataFrame, effects: DataFrame, rid: list[str], levels: dict[str, list[str]], tiers: list[str],
                   value: str) -> DataFrame:
    """First supported effect by level order, then by the weaker tiers; among equals the
    largest absolute effect.  One candidate union and a top-1, no loop over requests."""
    rank = F.create_map(*[F.lit(x) for i, n in enumerate(tiers) for x in (n, i)])
    parts = []
    for i, (name, keys) in enumerate(levels.items()):
        rows = effects.filter(F.col("level") == name).select(*keys, value, "tier")
        parts.append(requests.join(rows, keys).select(*rid, F.lit(name).alias("level"), F.lit(i).alias("_l"), value, "tier"))
    c = reduce(DataFrame.unionByName, parts).withColumn("_t", F.try_element_at(rank, F.col("tier"))).filter(F.col("_t").isNotNull())
    best = top_k(c, rid, [F.col("_t"), F.col("_l"), F.desc(F.abs(F.col(value))), F.col(value)], 1).drop("_t", "_l")
    return requests.select(*rid).join(best, rid, "left")


def appeared_and_removed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    a = new.select(*keys).join(old.select(*keys), keys, "left_anti").distinct().withColumn("change", F.lit("appeared"))
    b = old.select(*keys).join(new.select(*keys), keys, "left_anti").distinct().withColumn("change", F.lit("removed"))
    return a.unionByName(b)


def wide(df: DataFrame, keys: list[str], column: str, values: list, agg: Column, absent=None) -> DataFrame:
    """Pivot over a stated list of values, so no extra job looks for them."""
    d = df.groupBy(*keys).pivot(column, values).agg(agg)
    return d if absent is None else d.fillna(absent, [str(v) for v in values])


def one_row_per_origin(df: DataFrame, origin: list[str], order: list, constant: list[str]) -> DataFrame:
    """First row per origin with a flag where a column that must not vary does."""
    varies = reduce(lambda a, b: a | b, [F.min(c) != F.max(c) for c in constant], F.lit(False))
    flag = df.groupBy(*origin).agg(varies.cast("int").alias("varies"))
    return top_k(df, origin, order, 1).join(flag, origin)


def systematic_sample(df: DataFrame, keys: list[str], order: list[str], share_of: int, size: int) -> DataFrame:
    """About ``size`` evenly spaced rows per group: positions come from per-range counts,
    so no group is sorted in one task."""
    from .ranks import prefix_weights
    d = prefix_weights(df, keys, order)
    step = F.greatest(F.floor(F.col("total") / size), F.lit(share_of))
    return d.filter(F.pmod(F.col("below"), step) == 0).drop("weight", "below", "total")


def hashed_sample(df: DataFrame, keys: list[str], unique: list[str], size: int, seed: int) -> DataFrame:
    """size rows per group with the lowest seeded hash."""
    return top_k(df, keys, [hash_order(unique, seed), *[F.col(c) for c in unique]], size)


def ranked_controls(pairs: DataFrame, unit: list[str], offset: str, unique: list[str], k: int, seed: int) -> DataFrame:
    """Up to k controls per unit by slot offset, then a seeded hash."""
    return top_k(pairs, unit, [F.col(offset), hash_order(unique, seed), *[F.col(c) for c in unique]], k, rank="rank")


def token_counts(df: DataFrame, keys: list[str], array: Column, name: str) -> DataFrame:
    return df.select(*keys, F.explode(array).alias(name)).groupBy(*keys, name).agg(F.count(F.lit(1)).alias("n"))
