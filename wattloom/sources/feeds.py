"""Feeds with their own row rules: forecasts, availability, weather, snapshots, maps, prices."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import quarter_in_text, region_in_text


def forecast_runs(df: DataFrame, keep: Column, keys: list[str], fields: dict[str, list[str]]) -> DataFrame:
    """Long forecast rows from one run type; a field may have alias columns, which must agree."""
    d = df.filter(keep)
    d = d.select(*keys, *[F.coalesce(*[F.col(a).cast("double") for a in alias]).alias(f) for f, alias in fields.items()])
    return d.unpivot(keys, list(fields), "variable", "value").filter("value is not null")


def alias_conflicts(df: DataFrame, keys: list[str], fields: dict[str, list[str]]) -> DataFrame:
    """Rows whose alias columns carry different values."""
    bad = [F.col(a[0]) != F.col(b) for a in fields.values() for b in a[1:]]
    return df.filter(reduce(lambda x, y: x | F.coalesce(y, F.lit(False)), bad, F.lit(False))).select(*keys)


def unit_availability(df: DataFrame, horizon_days: int) -> DataFrame:
    """Daily availability rows (issue, day, region, unit, mw) inside the horizon, rolled up per region."""
    d = df.filter(F.col("day") <= F.col("issue") + F.expr(f"interval {horizon_days} days"))
    return d.groupBy("issue", "day", "region").agg(F.sum("mw").alias("mw"), F.countDistinct("unit").alias("units"), F.avg((F.col("mw") > 0).cast("double")).alias("online_share"))


def weather_rows(spark: SparkSession, path: str, variables: list[str], unit: str) -> DataFrame:
    """Hourly JSON arrays per site to rows, shifted to UTC+10; sites in another unit are left out."""
    arrays = ", ".join(f"{v}: array<double>" for v in variables)
    d = spark.read.schema(f"site string, unit string, hourly struct<time: array<string>, {arrays}>").json(path)
    z = F.explode(F.arrays_zip(F.col("hourly.time").alias("time"), *[F.col(f"hourly.{v}").alias(v) for v in variables]))
    d = d.filter(F.col("unit") == unit).select("site", z.alias("_z")).select("site", "_z.*")
    t = F.to_timestamp_ntz(F.col("time"), F.lit("yyyy-MM-dd'T'HH:mm")) + F.expr("interval 10 hours")
    return d.withColumn("time", t).unpivot(["site", "time"], variables, "variable", "value")


def snapshot_rows(df: DataFrame, report: str, fields: list[str], expected: int, part: str) -> DataFrame:
    """Content-addressed rows of complete snapshots: a report lacking any part is rejected."""
    full = df.groupBy(report).agg(F.countDistinct(part).alias("_n")).filter(F.col("_n") >= expected).select(report)
    return df.join(full, report, "left_semi").select(report, F.sha2(F.to_json(F.struct(*fields)), 256).alias("row_id"), *fields).dropDuplicates([report, "row_id"])


def map_points(spark: SparkSession, path: str) -> DataFrame:
    """Named points of a map extract: nodes carry lat/lon, areas a centre."""
    schema = "elements array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string,string>>>"
    d = spark.read.schema(schema).json(path).select(F.explode("elements").alias("e"))
    d = d.select(F.concat_ws("/", "e.type", "e.id").alias("osm_id"), F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lon"),
                 F.try_element_at("e.tags", F.lit("name")).alias("name"), F.try_element_at("e.tags", F.lit("power")).alias("kind"))
    return d.filter("lat is not null and name is not null")


def long_prices(df: DataFrame, region: str, contract: str, date: str, price: str) -> DataFrame:
    """Long price export to (region, quarter, date, price); unreadable rows are left out."""
    d = df.select(region_in_text(F.col(region)).alias("region"), quarter_in_text(F.col(contract)).alias("quarter"),
                  F.try_to_timestamp(F.col(date), F.lit("dd/MM/yyyy")).cast("timestamp_ntz").alias("date"), F.col(price).try_cast("double").alias("price"))
    return d.filter("region is not null and quarter is not null and date is not null and price is not null")


def wide_prices(df: DataFrame, date: str) -> DataFrame:
    """Wide export: one column per region and contract, named in its header."""
    cols = [c for c in df.columns if c != date]
    d = df.select(date, *[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot([date], [f"`{c}`" for c in cols], "_label", "_price")
    d = d.withColumns({"_region": F.col("_label"), "_contract": F.col("_label")})
    return long_prices(d, "_region", "_contract", date, "_price")
