"""Ordered operators on time series that do not need a whole key in one task.

A key's series is cut into time chunks and windows run inside (key, chunk):

* bounded reach (lag k steps, rolling windows, look-ahead labels): rows close to
  a chunk edge are copied into the neighbouring chunk (``with_halo``) and only
  the chunk's own rows are kept afterwards;
* unbounded reach (previous row, running sum or maximum, last known value): a
  per-chunk summary is carried forward over the chunks of the key, which are few.

A null key is a key of its own; rows with a null stamp are kept and stand in a chunk of their own, before all
others.  The order must be total (add an id column).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK_HOURS = 24 * 7


def hour_number(t: Column) -> Column:
    """Whole hours since 1970 of a zone-free timestamp."""
    return F.unix_date(t.cast("date")).cast("long") * 24 + F.hour(t)


def time_chunk(t: Column, hours: int = CHUNK_HOURS) -> Column:
    return F.floor(hour_number(t) / hours)


def seconds(t: Column) -> Column:
    """Seconds since 1970 of a zone-free timestamp, as a double with microseconds."""
    return (F.unix_date(t.cast("date")).cast("double") * 86400 + F.hour(t) * 3600
            + F.minute(t) * 60 + F.date_format(t, "s.SSSSSS").cast("double"))


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), t)


def with_halo(df: DataFrame, t: str, *, before: str | None = None, after: str | None = None,
              hours: int = CHUNK_HOURS) -> DataFrame:
    """Copy rows into neighbouring chunks: a chunk then sees every row within
    ``before`` ahead of its start and ``after`` beyond its end (interval text)."""
    c = F.col(t)
    last = time_chunk(c + F.expr(f"interval {before}"), hours) if before else time_chunk(c, hours)
    first = time_chunk(c - F.expr(f"interval {after}"), hours) if after else time_chunk(c, hours)
    return (df.withColumn("_chunk", F.explode_outer(F.sequence(first, last)))
            .withColumn("_own", F.col("_chunk").eqNullSafe(time_chunk(c, hours))))


def windowed(df: DataFrame, keys: list[str], t: str, columns, *, tie: list[str] = (),
             before: str | None = None, after: str | None = None, hours: int = CHUNK_HOURS) -> DataFrame:
    """Evaluate bounded-reach window columns.  ``columns(w)`` maps an ordered
    window specification to {name: Column}."""
    d = with_halo(df, t, before=before, after=after, hours=hours)
    w = Window.partitionBy(*keys, "_chunk").orderBy(t, *tie)
    return d.withColumns(columns(w)).filter("_own").drop("_own", "_chunk")


def dense_grid(df: DataFrame, keys: list[str], t: str, step: str) -> DataFrame:
    """Reindex every key to a complete grid from its first to its last stamp."""
    span = df.groupBy(*keys).agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    grid = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step}"))).alias(t))
    return grid.join(df, [*keys, t], "left")


def _with_heads(d: DataFrame, keys: list[str], carried: DataFrame, flag: int) -> DataFrame:
    """d and one row for each (key, chunk) that something is carried into; it stands before (-1) or after (1) the
    chunk's rows.  A union with a window needs one shuffle and no join, and takes null keys as they are."""
    return d.withColumn("_head", F.lit(0)).unionByName(carried.withColumn("_head", F.lit(flag)), allowMissingColumns=True)


def previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str], *,
             hours: int = CHUNK_HOURS, forward: bool = False) -> DataFrame:
    """Previous (or, with forward, next) row's values on an irregular series;
    columns maps new name -> source."""
    d = df.withColumn("_chunk", time_chunk(F.col(order[0]), hours)).withColumns({f"_s_{n}": F.col(s) for n, s in columns.items()})
    pack = F.struct(*[F.col(s).alias(f"_s_{n}") for n, s in columns.items()])
    pick = F.min_by if forward else F.max_by
    edge = d.groupBy(*keys, "_chunk").agg(pick(pack, F.struct(*order)).alias("_edge"))
    step = F.lead if forward else F.lag
    carried = edge.select(*keys, "_chunk", step("_edge").over(
        Window.partitionBy(*keys).orderBy("_chunk")).alias("_carry")).filter("_carry is not null").select(*keys, "_chunk", "_carry.*")
    w = Window.partitionBy(*keys, "_chunk").orderBy("_head", *order)
    out = _with_heads(d, keys, carried, 1 if forward else -1).withColumns({n: step(f"_s_{n}").over(w) for n in columns})
    return out.filter("_head = 0").drop("_chunk", "_head", *[f"_s_{n}" for n in columns])


_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, *,
            how: str = "sum", inclusive: bool = True, hours: int = CHUNK_HOURS) -> DataFrame:
    """Running sum, max or min per key in the given order."""
    f = _COMBINE[how]
    d = df.withColumn("_chunk", time_chunk(F.col(order[0]), hours)).withColumn("_val", F.col(value))
    part = d.groupBy(*keys, "_chunk").agg(f(value).alias("_part"))
    carried = part.select(*keys, "_chunk", f("_part").over(
        Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("_val")).filter("_val is not null")
    w = (Window.partitionBy(*keys, "_chunk").orderBy("_head", *order)
         .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return _with_heads(d, keys, carried, -1).withColumn(name, f("_val").over(w)).filter("_head = 0").drop("_chunk", "_val", "_head")


def last_known(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column], *,
               hours: int = CHUNK_HOURS, forward: bool = False) -> DataFrame:
    """Last (or, with forward, next) non-null value at or before the row."""
    d = df.withColumn("_chunk", time_chunk(F.col(order[0]), hours)).withColumns(
        {f"_v_{n}": c for n, c in columns.items()})
    key = F.struct(*order)
    pick = F.min_by if forward else F.max_by
    part = d.groupBy(*keys, "_chunk").agg(*[
        pick(F.col(f"_v_{n}"), F.when(F.col(f"_v_{n}").isNotNull(), key)).alias(f"_p_{n}") for n in columns])
    w = Window.partitionBy(*keys).orderBy(F.col("_chunk").desc() if forward else F.col("_chunk"))
    carried = part.select(*keys, "_chunk", *[
        F.last(f"_p_{n}", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_v_{n}")
        for n in columns])
    order_by = [F.col(c).desc() for c in order] if forward else order
    inside = (Window.partitionBy(*keys, "_chunk").orderBy("_head", *order_by)
              .rowsBetween(Window.unboundedPreceding, 0))
    out = _with_heads(d, keys, carried, -1).withColumns({n: F.last(f"_v_{n}", True).over(inside) for n in columns})
    return out.filter("_head = 0").drop("_chunk", "_head", *[f"_v_{n}" for n in columns])


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island", *,
            hours: int = CHUNK_HOURS) -> DataFrame:
    """Number runs from 1: ``starts`` is true on the first row of each run."""
    d = df.withColumn("_new", F.when(F.coalesce(starts, F.lit(False)), 1).otherwise(0).cast("long"))
    d = d.withColumn("_later", 1 - F.col("_new"))      # among equal stamps the start comes first
    return running(d, keys, [*order, "_later"], "_new", name, hours=hours).drop("_new", "_later")


def gap_islands(df: DataFrame, keys: list[str], order: list[str], gap: str, name: str = "island", *,
                hours: int = CHUNK_HOURS) -> DataFrame:
    """Runs separated by more than ``gap`` between consecutive stamps."""
    d = previous(df, keys, order, {"_prev": order[0]}, hours=hours)
    start = F.col("_prev").isNull() | (F.col(order[0]) > F.col("_prev") + F.expr(f"interval {gap}"))
    return islands(d, keys, order, start, name, hours=hours).drop("_prev")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, tie: list[str] = (), *,
                    gap: str = "0 seconds", aggs: list[Column] = (), hours: int = CHUNK_HOURS) -> DataFrame:
    """Union of overlapping or nearly adjacent spells, with payload aggregates."""
    if not tie and not aggs:
        df = df.select(*keys, start, end).distinct()
    order = [start, end, *tie]
    d = running(df, keys, order, end, "_reach", how="max", inclusive=False, hours=hours)
    first = F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + F.expr(f"interval {gap}"))
    d = islands(d, keys, order, first, "_spell", hours=hours)
    return d.groupBy(*keys, "_spell").agg(
        F.min(start).alias(start), F.max(end).alias(end), *aggs).drop("_spell")
