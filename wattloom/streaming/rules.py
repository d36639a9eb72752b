"""Stream rules: each takes a streaming DataFrame whose event time is TIMESTAMP
(watermarks reject the zone-free type; the session zone is UTC, so the cast is exact).

``availableNow`` runs without a limit on files put all input there is into one batch, so the result of a
backfill does not depend on how the table is cut into files or in which order they are listed.
Rules that need time order are run by ``in_order``, which holds rows until they can no longer be preceded.
"""
from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.lookups import recently
from ..operators.revisions import latest
from ..operators.sequence import last_known, previous
from ..session import cut, shared_folder

BUCKETS = 64
MERGE = 16               # epochs of a bucket that is appended to, before they become one


def table_stream(spark: SparkSession, folder: str, table: str, per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream, with their schema.  The last letter is a glob, which matches a
    single file and a folder of part files alike."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(f"{folder}/{table}.parque[t]")


def run_available(df: DataFrame, purpose: str) -> DataFrame:
    """Run a stream over all input there is into a file sink in the shared folder."""
    spark = df.sparkSession
    out = shared_folder(spark, purpose)
    q = (df.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_folder(spark, f"{purpose}-state"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def tumbling(df: DataFrame, keys: list[str], t: str, value: str, width: str, step_seconds: int, expected: int, late: str) -> DataFrame:
    """Complete-interval mean: null unless every small step of the window was seen."""
    step = F.floor(F.unix_seconds(t) / step_seconds)
    g = df.withWatermark(t, late).groupBy(*keys, F.window(t, width).alias("w")).agg(F.avg(value).alias("mean"), F.size(F.collect_set(step)).alias("n"))
    return g.select(*keys, F.col("w.end").alias("end"), "n", F.when(F.col("n") == expected, F.col("mean")).alias("mean"))


def sliding(df: DataFrame, keys: list[str], t: str, value: str, width: str, slide: str, late: str) -> DataFrame:
    g = df.withWatermark(t, late).groupBy(*keys, F.window(t, width, slide).alias("w")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return g.select(*keys, F.col("w.end").alias("end"), "n", "mean")


def sessions(df: DataFrame, keys: list[str], t: str, gap: str, late: str) -> DataFrame:
    g = df.withWatermark(t, late).groupBy(*keys, F.session_window(t, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


Rule = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def in_order(df: DataFrame, t: str, late: int, rule: Rule, kept: str, purpose: str, root: str | None = None, *, keys: list[str], append: bool = False,
             buckets: int = BUCKETS) -> DataFrame:
    """Apply ``rule`` to the rows of a stream in the order of the long column t, however they arrive.

    Each batch joins the rows still waiting; those at most ``late`` below the newest stamp seen go on
    waiting, the rest are ready.  rule(ready, kept rows) gives output rows and the rows to keep (schema
    ``kept``), which are one or few a key.  A row at or below the horizon of an earlier batch is too late
    and goes to the folder ``late``; rows with a null stamp too.  At the end of the input the waiting rows are flushed.

    The cost of a batch follows the batch.  Waiting rows are written once, by the epoch they came in, and read
    again only while the horizon passes them.  Kept rows lie in buckets of the hash of ``keys``; a batch reads and rewrites the
    buckets that its ready rows touch.  With ``append`` the rule gives only what is new to keep, and a bucket's rows are those of its
    epochs together; after MERGE of them they become one.

    Horizon, waiting epochs and the epochs of the buckets (one small row) are written by epoch in the shared folder; an epoch that is
    run again starts from its forerunner's, so a restart with the same ``root`` changes nothing.
    """
    spark = df.sparkSession
    root = root or shared_folder(spark, purpose)
    empty = spark.createDataFrame([], kept)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def state(epoch: int) -> tuple[int | None, dict[int, int], dict[int, list[int]]]:
        """Horizon, newest stamp by waiting epoch, epochs by bucket."""
        if epoch < 0:
            return None, {}, {}
        row = spark.read.schema("horizon long, waiting string, places string").parquet(f"{root}/state/epoch={epoch}").first()
        return row[0], {int(k): v for k, v in json.loads(row[1]).items()}, {int(k): v for k, v in json.loads(row[2]).items()}

    def carried(places: dict[int, list[int]], touched: list[int]) -> DataFrame:
        paths = [f"{root}/kept/epoch={e}/_bucket={b}" for b in touched for e in places.get(b, [])]
        return spark.read.schema(kept).parquet(*paths) if paths else empty

    def advance(rows: DataFrame, epoch: int, flush: bool) -> None:
        horizon, waiting, places = state(epoch - 1)
        past = F.lit(False) if horizon is None else F.col(t) <= horizon
        late_rows = F.col(t).isNull() | past
        rows.filter(late_rows).write.mode("overwrite").parquet(f"{root}/late/epoch={epoch}")
        rows = rows.filter(~F.coalesce(late_rows, F.lit(True)))
        newest = max([x for x in (rows.agg(F.max(t)).first()[0], *waiting.values()) if x is not None], default=None)
        if newest is None:
            until = horizon
        else:
            until = newest if flush else max(newest - late, horizon) if horizon is not None else newest - late
        ready = rows.filter(F.lit(False) if until is None else F.col(t) <= until)
        rest = rows.filter(F.lit(True) if until is None else F.col(t) > until)
        if waiting and until is not None:
            old = spark.read.schema(df.schema).parquet(*[f"{root}/waiting/epoch={e}" for e in waiting])
            ready = ready.unionByName(old.filter((F.col(t) <= until) & (F.lit(True) if horizon is None else F.col(t) > horizon)))
        ready = cut(ready, f"{purpose}-ready")
        touched = sorted(r[0] for r in ready.select(bucket).distinct().collect())                  # at most ``buckets`` numbers
        out, keep = rule(ready, carried(places, touched))
        out.write.mode("overwrite").parquet(f"{root}/out/epoch={epoch}")
        merge = [b for b in touched if append and len(places.get(b, [])) >= MERGE]
        if merge:
            keep = keep.unionByName(carried(places, merge))
        keep.withColumn("_bucket", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{root}/kept/epoch={epoch}")
        written = {r[0] for r in spark.read.schema(f"{kept}, _bucket int").parquet(f"{root}/kept/epoch={epoch}").select("_bucket").distinct().collect()}
        for b in touched:
            before = places.get(b, []) if append and b not in merge else []
            places[b] = before + [epoch] * (b in written)
        rest.write.mode("overwrite").parquet(f"{root}/waiting/epoch={epoch}")
        top = spark.read.schema(df.schema).parquet(f"{root}/waiting/epoch={epoch}").agg(F.max(t)).first()[0]
        waiting = {e: x for e, x in {**waiting, epoch: top}.items() if x is not None and (until is None or x > until)}
        row = [(until, json.dumps(waiting), json.dumps(places))]
        spark.createDataFrame(row, "horizon long, waiting string, places string").write.mode("overwrite").parquet(f"{root}/state/epoch={epoch}")
        seen["last"] = max(seen["last"], epoch)

    seen = {"last": -1}
    q = (df.writeStream.foreachBatch(lambda batch, epoch: advance(batch, epoch, False)).option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if seen["last"] >= 0:
        advance(spark.createDataFrame([], df.schema), seen["last"] + 1, True)
        return spark.read.parquet(f"{root}/out").drop("epoch")
    return rule(spark.createDataFrame([], df.schema), empty)[0]


def first_receipts(keys: list[str], t: str, received: str, stale_us: int, tie: str) -> Rule:
    """The first receipt of a key stands, by (received, tie); receipts of the future or older than
    ``stale_us`` when received are left out.  Kept, by appending: the keys that have one."""
    def rule(ready, kept):
        ok = ready.filter((F.col(t) <= F.col(received)) & (F.col(t) >= F.col(received) - stale_us))
        firsts = latest(ok.withColumns({"_r": -F.col(received), "_i": -F.col(tie)}), keys, ["_r", "_i"]).drop("_r", "_i")
        new = firsts.join(kept, keys, "left_anti")
        return new, new.select(*keys)
    return rule


def refractory(key: str, t_us: str, wait_us: int) -> Rule:
    """Alarms at least ``wait`` apart.  Kept: the last alarm of a key.  Equal stamps of a key are one row before
    they meet, so a key's task holds at most as many rows as there are stamps in the calendar."""
    def spaced(a: pa.Table, b: pa.Table) -> pa.Table:
        stamps = np.sort(a.column(t_us).to_numpy()) if a.num_rows else np.zeros(0, np.int64)
        last = b.column("last").to_numpy().max() if b.num_rows else None
        name = (a if a.num_rows else b).column(key)[0].as_py()
        out, at = [], 0 if last is None else int(np.searchsorted(stamps, last + wait_us))
        while at < len(stamps):
            last = stamps[at]
            out.append(int(last))
            at = int(np.searchsorted(stamps, last + wait_us))
        rows = [(name, v, False) for v in out] + ([(name, int(last), True)] if last is not None else [])
        return pa.table([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_())], names=[key, t_us, "kept"])

    def rule(ready, kept):
        both = (ready.select(key, t_us).distinct().groupBy(key).cogroup(kept.groupBy(key))
                .applyInArrow(spaced, f"{key} string, {t_us} long, kept boolean"))
        return both.filter("not kept").drop("kept"), both.filter("kept").select(key, F.col(t_us).alias("last"))
    return rule


def presence_changes(key: str, idx: str) -> Rule:
    """Appear / disappear events of a row id from its snapshot numbers.  Kept: the last number seen; a row
    still present has no disappear event yet."""
    def rule(ready, kept):
        rows = ready.select(key, idx).distinct().withColumn("_old", F.lit(False)).unionByName(kept.select(key, F.col("last").alias(idx)).withColumn("_old", F.lit(True)))
        d = rows.withColumn("_p", F.lag(idx).over(Window.partitionBy(key).orderBy(idx, F.desc("_old"))))
        fresh = d.filter(~F.col("_old") & (F.col("_p").isNull() | (F.col(idx) > F.col("_p") + 1)))
        appear = F.struct(F.col(idx).alias("i"), F.lit(1).alias("present"))
        vanish = F.when(F.col("_p").isNotNull(), F.struct((F.col("_p") + 1).alias("i"), F.lit(0).alias("present")))
        events = fresh.select(key, F.explode(F.array(appear, vanish)).alias("e")).filter("e is not null")
        return events.select(key, F.col("e.i").alias(idx), F.col("e.present").alias("present")), rows.groupBy(key).agg(F.max(idx).alias("last"))
    return rule


def switch_age(key: str, t_us: str, setter: str) -> Rule:
    """Microseconds since the setter last changed.  Kept: setter of a key and time of its change."""
    def rule(ready, kept):
        old = kept.select(key, F.col("since").alias(t_us), setter).withColumn("_old", F.lit(1))
        rows = ready.select(key, t_us, setter).distinct().withColumn("_old", F.lit(0)).unionByName(old)
        rows = rows.withColumns({"_t": F.timestamp_micros(t_us).cast("timestamp_ntz"), "_new": 1 - F.col("_old")})
        order = ["_t", "_new", setter]
        d = previous(rows, [key], order, {"_p": setter})
        d = d.withColumn("_switch", F.col("_p").isNull() | (F.col("_p") != F.col(setter)))
        d = last_known(d, [key], order, {"_since": F.when(F.col("_switch"), F.col(t_us))})
        keep = d.groupBy(key).agg(F.max_by(F.struct(setter, F.col("_since").alias("since")), F.struct(*order)).alias("s")).select(key, f"s.{setter}", "s.since")
        return d.filter("_old = 0").select(key, t_us, setter, (F.col(t_us) - F.col("_since")).alias("age_us")), keep
    return rule


def upserted(df: DataFrame, keys: list[str], newest: list[str], purpose: str, root: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Newer revisions replace older ones.  The table is kept in buckets of the key's hash; a micro-batch
    rewrites only the buckets that it touches, under its epoch, and a bucket's rows are those of its newest epoch.

    What there was before an epoch is read from storage, so a restart with the same ``root`` goes on from there."""
    spark = df.sparkSession
    root = root or shared_folder(spark, purpose)
    table = f"{root}/table"
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    from pyspark.sql.types import IntegerType, LongType, StructField, StructType
    schema = StructType([*df.schema.fields, StructField("_epoch", LongType()), StructField("_bucket", IntegerType())])

    def current(before: int | None = None) -> DataFrame:
        d = spark.read.schema(schema).parquet(table)
        d = d if before is None else d.filter(F.col("_epoch") < before)
        # partition columns only; at most one row for each bucket
        top = d.groupBy("_bucket").agg(F.max("_epoch").alias("_epoch"))
        return d.join(F.broadcast(top), ["_bucket", "_epoch"], "left_semi")

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = latest(batch, keys, newest).withColumn("_bucket", bucket)
        if epoch > 0:
            touched = rows.select("_bucket").distinct()                     # at most ``buckets`` rows
            old = current(epoch).join(F.broadcast(touched), "_bucket", "left_semi").drop("_epoch")
            rows = latest(old.unionByName(rows), keys, newest)
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{table}/_epoch={epoch}")

    q = df.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return current().drop("_epoch", "_bucket")


def fresh_only(df: DataFrame, reports: DataFrame, t: str, at: str, limit_us: int, purpose: str) -> DataFrame:
    """Rows with a report at most ``limit`` old; of the static reports a micro-batch reads the span that can matter to it."""
    spark = df.sparkSession
    out = shared_folder(spark, purpose)

    def check(batch: DataFrame, epoch: int) -> None:
        low, high = batch.agg(F.min(t), F.max(t)).first()
        span = reports.filter(F.col(at).between(F.lit(low) - F.make_interval(secs=F.lit(limit_us / 1e6)), F.lit(high))) if low is not None else reports.limit(0)
        recently(batch, span, t, at, limit_us, "fresh").withColumn("fresh", F.col("fresh").cast("int")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    q = df.writeStream.foreachBatch(check).option("checkpointLocation", shared_folder(spark, f"{purpose}-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).drop("epoch")
