"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled queue that may be gone through ``limit`` times.  An entry's
virtual finish time is the source's cumulative tokens after it, divided by the source's target; all
entries are sorted by that time over the whole corpus and the mix is cut where its total reaches the
budget.  As virtual time passes 1 every source has had its target, so each source ends within about
one document of it.

A source may hold any share of the rows: running sums are taken in (source, slice of the shuffle) groups
with carried slice totals.  The shuffle is the MD5 of seed and id, so reruns agree.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut
from .common import SPACES, free_names, positions, words_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
LIMIT = 2
SEED = "mix-1"
SLICES = 4096      # slices of a source's queue, and of a unit of virtual time
TAIL = 4           # virtual times from here on share one slice; the cut lies near 1


def word_count(text: Column) -> Column:
    return F.size(words_of(text, SPACES)).cast("long")


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) of a table (source, size); null is a source.

    Weights repeat over the sources by code point, null last.  The budget is shared by weight; a source
    stops at limit x its size and the rest is shared again.  Each round is one sum over the sources; only
    scalars reach the driver, and the set of stopped sources only grows, so the rounds end.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = positions(per, [F.col("source").asc_nulls_last()], "_rank", "sources")
    by_rank = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    src = cut(ranked.withColumn("_w", by_rank), "weights")
    cap = F.lit(limit).cast("long") * F.col("source_size")
    level, stopped = None, -1
    while True:
        full = F.lit(False) if level is None else cap <= F.col("_w") * F.lit(level)
        row = src.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)),
                      F.coalesce(F.sum(F.when(~full, F.col("_w"))), F.lit(0)), F.count(F.when(full, 1))).first()
        if row[3] == stopped or row[2] == 0:
            break
        stopped, level = row[3], (share * row[0] - row[1]) / row[2]
    level = 0.0 if level is None else level
    target = F.when(cap <= F.col("_w") * F.lit(level), cap.cast("double")).otherwise(F.col("_w") * F.lit(level))
    return src.select("source", "_rank", "source_size", target.alias("target"))


def fair_queue(docs: DataFrame, *, seed: str = SEED, weights=WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs(doc_id, source, size, any key columns): with source_size, target and
    ``copies``, how often the mix takes it.

    Rows of size 0 are taken 0 times; a null id is an id of its own; repeated rows are entries of their
    own; an empty table gives no rows.
    """
    docs = cut(docs.withColumn("_mix", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))), "mix")
    targets = source_targets(docs.select("source", "size"), weights=weights, share=share, limit=limit)
    slice_of = F.conv(F.substring("_mix", 1, 3), 16, 10).cast("int")     # SLICES values
    rows = docs.withColumn("_slice", slice_of)
    totals = rows.groupBy("source", "_slice").agg(F.sum("size").alias("_total"))
    carried = totals.select(F.col("source").alias("_s"), F.col("_slice").alias("_sl"),
                            (F.sum("_total").over(Window.partitionBy("source").orderBy("_slice")) - F.col("_total")).alias("_carried"))
    order = [F.col(c).asc_nulls_first() for c in ("_mix", "doc_id", "size")]
    here = F.sum("size").over(Window.partitionBy("source", "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = (rows.withColumn("_here", here)
            .join(carried, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_sl")), "left").drop("_s", "_sl"))
    t = targets.select(F.col("source").alias("_s"), "_rank", "source_size", "target")
    rows = rows.join(t, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("_after", F.col("_carried") + F.col("_here"))
    rows = cut(rows.drop("_here", "_carried", "_slice"), "queue")

    def entry(i):
        return (F.col("_after") + F.lit(i) * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0))

    def slice_at(finish):
        return F.least(F.floor(finish * SLICES), F.lit(TAIL * SLICES)).cast("long")

    entries = (rows.filter("size > 0").select("size", "_rank", F.explode(F.array(*[entry(i) for i in range(limit)])).alias("_finish"))
               .withColumn("_vt", slice_at(F.col("_finish"))))
    budget = rows.agg((F.sum("size") * F.lit(share)).alias("_budget"))
    # at most TAIL x SLICES + 1 rows; the slice in which the mix reaches its budget
    time = entries.groupBy("_vt").agg(F.sum("size").alias("_sum"))
    time = time.withColumn("_ahead", F.sum("_sum").over(Window.orderBy("_vt")) - F.col("_sum"))
    last = (time.join(F.broadcast(budget)).filter("_ahead <= _budget")
            .agg(F.max(F.struct("_vt", "_ahead", "_budget")).alias("_last")).select("_last._vt", "_last._ahead", "_last._budget")
            .toDF("_cut", "_ahead", "_budget"))
    running = F.sum("size").over(Window.orderBy("_finish", "_rank").rowsBetween(Window.unboundedPreceding, 0))   # the rows of one slice
    end = (entries.join(F.broadcast(last)).filter("_vt = _cut").withColumn("_in", running + F.col("_ahead"))
           .agg(F.max("_cut").alias("_cut"), F.max(F.when(F.col("_in") <= F.col("_budget"), F.struct("_finish", "_rank"))).alias("_end")))
    end = end.select("_cut", F.coalesce("_end._finish", F.lit(-1.0)).alias("_ef"), F.coalesce("_end._rank", F.lit(-1)).alias("_er"))

    def taken(i):
        f = entry(i)
        inside = (f < F.col("_ef")) | ((f == F.col("_ef")) & (F.col("_rank") <= F.col("_er")))
        return F.when((F.col("size") > 0) & ((slice_at(f) < F.col("_cut")) | inside), 1).otherwise(0)

    copies = taken(0)
    for i in range(1, limit):
        copies = copies + taken(i)
    # end is one row
    return (rows.join(F.broadcast(end), how="left").withColumn("copies", F.coalesce(copies, F.lit(0)))
            .drop("_cut", "_ef", "_er", "_mix", "_after", "_rank"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes it; columns as they are.  Rows equal in id, source and
    text are one document standing in the queue more than once."""
    digest, d, g, s, n = free_names(docs, "_digest", "_d", "_g", "_s", "_n")
    keyed = docs.withColumn(digest, F.md5("text"))
    queue = fair_queue(keyed.select("doc_id", "source", word_count(F.col("text")).alias("size"), digest), **options)
    taken = queue.groupBy("doc_id", "source", digest).agg(F.sum("copies").cast("int").alias(n)).filter(F.col(n) > 0).toDF(d, s, g, n)
    same = F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(s)) & (F.col(digest) == F.col(g))
    kept = keyed.join(taken, same).dropDuplicates(["doc_id", "source", digest])
    return kept.withColumn(d, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(digest, d, g, s, n)
