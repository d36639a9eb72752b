"""Shared pieces of the training-data operators: text rules, exact global order, scratch names."""
from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

import wattloom
from ..session import cut

# Functions that run in Python workers travel with their code, so that workers need no copy of the package.
cloudpickle.register_pickle_by_value(wattloom)

# What stands between words; words are the longest runs of all other characters.
SPACES = r"[\x20\x09-\x0D]+"
NO_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII takes the quick way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column, between: str) -> Column:
    """All words in text order; null gives an empty array.  (A split is many times quicker than extracting matches.)"""
    return F.coalesce(F.array_remove(F.split(text, between), ""), F.array().cast("array<string>"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of df has them (columns compare without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def positions(df: DataFrame, order: list[Column], name: str = "_pos", purpose: str = "order") -> DataFrame:
    """Adds the 0-based place of each row in one exact global order.

    Rows are range-partitioned by the order and written, which fixes the partition of each row; the
    counts of the partitions (one row each) give the offsets, and the rows are numbered inside their
    partition.  The order should be total up to equal rows.  Keep df narrow: it is written whole.
    """
    part, = free_names(df, "_part")
    fixed = cut(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), purpose)
    counts = fixed.groupBy(part).count()
    offset, = free_names(df, "_offset")
    # one row for each partition of the exchange above
    ahead = counts.select(part, (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias(offset))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1
    return (fixed.withColumn(name, inside.cast("long")).join(F.broadcast(ahead), part)
            .withColumn(name, F.col(name) + F.col(offset)).drop(part, offset))


