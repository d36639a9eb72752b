"""Line deduplication by overlapping three-line windows.

Every three consecutive lines of a document are a window; windows are compared over the whole corpus by
a 128-bit hash, and every occurrence after the first (by document id, text, place) is taken out: the
covered line positions of a document are merged and its other lines are joined again.

A window of white space alone counts as none.  Documents of fewer than three lines stay as they are, a
null text stays null.  Where a later occurrence overlaps the first in the same document, the first keeps its lines.  Rows equal
in id and text are one document and are cut alike.  A window in a third of all rows is first reduced to
one row in each map task; the join back is a plain equi-join that adaptive execution splits.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import free_names

LINES = 3


def line_windows(docs: DataFrame, *, lines: int = LINES) -> DataFrame:
    """(doc_id, digest, place, hash) of every window of docs(doc_id, text)."""
    d = docs.select("doc_id", F.md5("text").alias("digest"), F.split("text", "\n").alias("l")).filter(F.size("l") >= lines)
    d = d.withColumn("place", F.explode(F.sequence(F.lit(0), F.size("l") - lines)))
    text = F.concat_ws("\n", *[F.get("l", F.col("place") + k) for k in range(lines)])
    return d.select("doc_id", "digest", "place", text.alias("t")).filter(F.col("t").rlike(r"\S")).select("doc_id", "digest", "place", F.unhex(F.md5("t")).alias("hash"))


def repeated_spans(docs: DataFrame, *, lines: int = LINES) -> DataFrame:
    """(doc_id, digest, spans): for each document with later occurrences, the line spans they cover."""
    w = line_windows(docs, lines=lines).distinct()
    place = F.struct(F.col("doc_id"), F.col("digest"), F.col("place"))
    first = w.groupBy("hash").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = w.join(first, "hash").filter(place != F.col("first"))
    own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.digest") == F.col("digest"))
    start = F.when(own, F.greatest(F.col("place"), F.col("first.place") + lines)).otherwise(F.col("place"))
    later = later.select("doc_id", "digest", start.alias("start"), (F.col("place") + lines - start).alias("length"))
    return later.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("spans"))


def merged(spans: Column) -> Column:
    """Sorted (start, length) spans as disjoint (start, end) runs."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    def step(a, s):
        one = F.struct(s["start"].cast("int").alias("start"), (s["start"] + s["length"]).cast("int").alias("end"))
        last = F.element_at(a, -1)
        joins = (F.size(a) > 0) & (last["end"] >= one["start"])
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], one["end"]).alias("end"))
        return F.when(F.size(a) == 0, F.array(one)).when(joins, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(grown))).otherwise(F.concat(a, F.array(one)))
    return F.aggregate(spans, none, step)


def line_dedup(docs: DataFrame, *, lines: int = LINES) -> DataFrame:
    """docs with repeated line windows cut out of text, and n_lines, n_removed, runs (the merged spans)."""
    d, g, spans, key, parts = free_names(docs, "_d", "_g", "_spans", "_digest", "_lines")
    found = repeated_spans(docs.select("doc_id", "text"), lines=lines).toDF(d, g, spans)
    both = docs.withColumn(key, F.md5("text")).join(found, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(key) == F.col(g)), "left")
    runs = F.coalesce(merged(F.col(spans)), F.array().cast("array<struct<start:int,end:int>>"))
    both = both.withColumn("runs", runs).withColumn(parts, F.split("text", "\n"))
    # the lines between the runs, one slice for each gap
    edges = F.sequence(F.lit(0), F.size("runs"))
    def gap(i):
        start = F.when(i == 0, 0).otherwise(F.get(F.col("runs.end"), i - 1))
        end = F.when(i == F.size("runs"), F.size(parts)).otherwise(F.get(F.col("runs.start"), i))
        return F.slice(F.col(parts), start + 1, end - start)
    kept = F.flatten(F.transform(edges, gap))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts))
    removed = F.aggregate("runs", F.lit(0), lambda a, r: a + r["end"] - r["start"])
    return (both.withColumns({"n_lines": n.cast("long"), "n_removed": removed.cast("long"),
                              "text": F.when(F.size("runs") == 0, F.col("text")).otherwise(F.array_join(kept, "\n"))})
            .drop(d, g, spans, key, parts))
