"""Sources and sinks: files are derived from the driver tables, written to the shared
folder and read back through the scans."""
from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F, types as T

from ..functions import calendar as cal
from ..sources import feeds, files, records
from ..session import shared_folder
from .aggregates import rounded
from .registry import query
from .standins import r6


def tagged_folder(t, lines_per_file=250_000):
    """Record-tagged text: one folder per nation group and table versions with different columns.  A group is cut into
    files of about ``lines_per_file`` lines, each with its own headers, so that no task holds a whole group."""
    v1 = "concat_ws(',', 'D', 'DISPATCH', 'LINE', '1', l_orderkey, l_linenumber, concat('\"', l_partkey, ',x\"'), l_quantity)"
    v2 = "concat_ws(',', 'D', 'DISPATCH', 'LINE', '2', l_quantity, l_orderkey, l_suppkey)"
    files_ = (t.lineitem.count() + t.orders.count()) // (4 * lines_per_file) + 1
    d = t.lineitem.selectExpr("l_suppkey % 4 as part", f"pmod(xxhash64(l_orderkey, l_linenumber), {files_}) as piece", "2 as ord", f"case when l_linenumber <= 4 then {v1} else {v2} end as value")
    other = t.orders.selectExpr("o_custkey % 4 as part", f"pmod(xxhash64(o_orderkey), {files_}) as piece", "2 as ord", "concat_ws(',', 'D', 'PRICE', 'REGION', '1', o_orderkey, o_totalprice) as value")
    lines = [(0, "C,EXPORT"), (1, "I,DISPATCH,LINE,1,ORDERKEY,LINENO,PART,QTY"), (1, "I,DISPATCH,LINE,2,QTY,ORDERKEY,SUPPLIER"), (1, "I,PRICE,REGION,1,ORDERKEY,PRICE"), (9, "C,END OF REPORT")]
    heads = t.spark.createDataFrame([(p, o, s) for p in range(4) for o, s in lines], "part long, ord int, value string")
    heads = heads.select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(files_ - 1).cast("long"))).alias("piece"), "ord", "value")
    path = shared_folder(t.spark, "tagged")
    d.union(other).union(heads).repartition(4 * files_, "part", "piece").sortWithinPartitions("part", "piece", "ord").drop("ord").write.partitionBy("part", "piece").text(path)
    return path


@query("s1_tagged_csv_scan", """
select l_orderkey as orderkey, l_quantity as qty, case when l_linenumber <= 4 then l_partkey || ',x' end as part, case when l_linenumber > 4 then l_suppkey end as supplier, case when l_linenumber <= 4 then '1' else '2' end as version from lineitem""")
def tagged_csv_scan(t):
    d = records.tagged_scan(records.tagged_lines(t.spark, tagged_folder(t)), "DISPATCH_LINE", ["ORDERKEY", "QTY", "PART", "SUPPLIER"])
    return d.select(F.col("ORDERKEY").try_cast("long").alias("orderkey"), F.col("QTY").try_cast("double").alias("qty"), F.col("PART").alias("part"), F.col("SUPPLIER").try_cast("long").alias("supplier"), "version")


@query("x49_all_table_split", """
select 'DISPATCH_LINE' as "table", case when l_linenumber <= 4 then '1' else '2' end as version, count(*) as n, sum(l_orderkey)::bigint as keys from lineitem group by 2 union all select 'PRICE_REGION', '1', count(*), sum(o_orderkey)::bigint from orders""")
def all_table_split(t):
    d = records.all_tables(records.tagged_lines(t.spark, tagged_folder(t)))
    out = shared_folder(t.spark, "split")
    files.write_parquet(d, out, ["table"])
    return t.spark.read.parquet(out).groupBy("table", F.col("version").cast("string").alias("version")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.element_at("record", F.lit("ORDERKEY")).cast("long")).alias("keys"))


@F.pandas_udf(T.BinaryType())
def _zipped(html: pd.Series) -> pd.Series:
    """Test archive of one page: the page and the same page inside a nested archive."""
    def pack(text):
        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w") as z:
            z.writestr("inner.txt", text)
        with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("page.txt", text)
            z.writestr("more.zip", inner.getvalue())
        return outer.getvalue()
    return html.map(pack)


@query("s2_archive_expand", """
select page_id::varchar as path, unnest(['page.txt', 'more.zip/inner.txt']) as member, md5(html) as fp, length(html) as n from pages""")
def archive_expand(t):
    z = t.pages.select(F.col("page_id").cast("string").alias("path"), _zipped("html").alias("content"))
    parts = records.expand_archives(z).groupBy("path", "member").agg(F.sort_array(F.collect_list(F.struct("part", "text"))).alias("p"))
    whole = F.array_join("p.text", "")
    return parts.select("path", "member", F.md5(whole).alias("fp"), F.length(whole).alias("n"))


@query("s3_filtered_scan", """
select l_orderkey, l_shipdate, l_quantity from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal > 5000) and l_shipdate in (select o_orderdate from orders where o_orderpriority = '1-URGENT')""")
def filtered_scan(t):
    ids = t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("l_suppkey"))
    times = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").alias("l_shipdate"))
    return records.filtered_scan(t.lineitem, ["l_orderkey", "l_shipdate", "l_quantity"], ids, times)


@query("x50_offer_scan", """
select l_orderkey, l_suppkey, l_shipdate, l_extendedprice from lineitem where year(l_shipdate) = 1998 and l_suppkey in (select s_suppkey from supplier where s_nationkey < 8)""")
def offer_scan(t):
    ids = t.supplier.filter("s_nationkey < 8").select(F.col("s_suppkey").alias("l_suppkey"))
    d = t.lineitem.filter("l_shipdate >= timestamp_ntz'1998-01-01' and l_shipdate < timestamp_ntz'1999-01-01'")   # reaches the parquet scan
    return records.filtered_scan(d, ["l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice"], ids)


@query("x53_registration_history", """
select distinct l_suppkey as unit, date_trunc('month', l_shipdate) as month, l_linenumber as revision from lineitem where l_suppkey in (select s_suppkey from supplier where s_acctbal < 3000)""")
def registration_history(t):
    ids = t.supplier.filter("s_acctbal < 3000").select(F.col("s_suppkey").alias("l_suppkey"))
    d = records.filtered_scan(t.lineitem, ["l_suppkey", "l_shipdate", "l_linenumber"], ids)
    return d.select(F.col("l_suppkey").alias("unit"), cal.month_start(F.col("l_shipdate")).alias("month"), F.col("l_linenumber").alias("revision")).dropDuplicates()


@query("s4_columns_present_scan", """
select o_orderkey as id, case when o_orderstatus <> 'P' then o_totalprice end as price, case when o_orderstatus = 'P' then o_orderpriority end as priority, null::varchar as absent from orders""")
def columns_present_scan(t):
    path = shared_folder(t.spark, "present")
    t.orders.filter("o_orderstatus <> 'P'").selectExpr("o_orderkey as id", "o_totalprice as price").write.parquet(f"{path}/a")
    t.orders.filter("o_orderstatus = 'P'").selectExpr("o_orderkey as id", "o_orderpriority as priority").write.parquet(f"{path}/b")
    return files.read_present(t.spark, path, {"id": "long", "price": "double", "priority": "string", "absent": "string"})


@query("s5_forecast_run_parse", """
select l_orderkey, l_partkey, l_suppkey, l_linenumber, unnest(['demand', 'wind']) as variable, unnest([l_quantity, coalesce(case when l_linestatus = 'O' then l_discount end, l_tax)]) as value from lineitem where l_returnflag = 'R'""")
def forecast_run_parse(t):
    d = t.lineitem.withColumn("wind_new", F.when(F.col("l_linestatus") == "O", F.col("l_discount")))
    return feeds.forecast_runs(d, F.col("l_returnflag") == "R", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], {"demand": ["l_quantity"], "wind": ["wind_new", "l_tax"]})


@query("s5_alias_conflicts", "select l_orderkey, l_partkey, l_suppkey, l_linenumber from lineitem where l_discount <> l_tax")
def alias_conflicts(t):
    return feeds.alias_conflicts(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], {"wind": ["l_discount", "l_tax"]})


@query("s6_unit_availability_parse", """
select date_trunc('month', o_orderdate) as issue, l_shipdate as day, l_returnflag as region, round(sum(l_quantity - 10), 2) as mw, count(distinct l_suppkey) as units, round(avg((l_quantity > 10)::int), 6) as online_share
from lineitem join orders on l_orderkey = o_orderkey where l_shipdate <= date_trunc('month', o_orderdate) + interval 60 days group by 1, 2, 3""")
def unit_availability_parse(t):
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        cal.month_start(F.col("o_orderdate")).alias("issue"), F.col("l_shipdate").alias("day"), F.col("l_returnflag").alias("region"), F.col("l_suppkey").alias("unit"), (F.col("l_quantity") - 10).alias("mw"))
    return rounded(rounded(feeds.unit_availability(d, 60), ["mw"], 2), ["online_share"])


@query("s7_weather_json_scan", """
with h as (select user_id, time_bucket(interval '1 hour', ts) as t, round(sum(value), 2) as a, count(*)::double as b from events where user_id % 10 <> 3 group by 1, 2)
select 'site' || user_id as site, t + interval 10 hours as time, unnest(['temperature', 'wind']) as variable, unnest([a, b]) as value from h""")
def weather_json_scan(t):
    h = t.events.groupBy("user_id", cal.floor_time(F.col("ts"), 3600).alias("t")).agg(F.round(F.sum("value"), 2).alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    rows = F.array_sort(F.collect_list(F.struct("t", "a", "b")))   # one site and day: at most 24 hours
    d = h.groupBy("user_id", F.to_date("t").alias("day")).agg(rows.alias("r"))
    hourly = F.struct(F.transform("r", lambda x: F.date_format(x["t"], "yyyy-MM-dd'T'HH:mm")).alias("time"), F.col("r.a").alias("temperature"), F.col("r.b").alias("wind"))
    path = shared_folder(t.spark, "weather")
    d.select(F.concat(F.lit("site"), "user_id").alias("site"), F.when(F.col("user_id") % 10 == 3, "F").otherwise("C").alias("unit"), hourly.alias("hourly")).write.json(path)
    return feeds.weather_rows(t.spark, path, ["temperature", "wind"], "C")


@query("s8_snapshot_parse", """
with c as (select source from documents group by 1 having count(distinct lang) >= 4)
select source, sha256('{"lang":"' || lang || '","n_chars":' || n_chars || '}') as row_id, lang, n_chars from (select distinct source, lang, n_chars from documents) where source in (select source from c)""")
def snapshot_parse(t):
    return feeds.snapshot_rows(t.documents.select("source", "lang", "n_chars"), "source", ["lang", "n_chars"], 4, "lang")


@query("s9_map_points_scan", """
select case when c_custkey % 2 = 0 then 'node/' else 'way/' end || c_custkey as osm_id, c_acctbal / 100 as lat, 130.0::double + c_nationkey as lon, c_name as name, lower(c_mktsegment) as kind from customer where c_custkey % 5 <> 0""")
def map_points_scan(t):
    even, lat, lon = F.col("c_custkey") % 2 == 0, F.col("c_acctbal") / 100, F.lit(130.0) + F.col("c_nationkey")
    tags = F.when(F.col("c_custkey") % 5 == 0, F.create_map(F.lit("power"), F.lower("c_mktsegment"))).otherwise(F.create_map(F.lit("name"), F.col("c_name"), F.lit("power"), F.lower("c_mktsegment")))
    e = F.struct(F.when(even, "node").otherwise("way").alias("type"), F.col("c_custkey").alias("id"), F.when(even, lat).alias("lat"), F.when(even, lon).alias("lon"),
                 F.when(~even, F.struct(lat.alias("lat"), lon.alias("lon"))).alias("center"), tags.alias("tags"))
    path = shared_folder(t.spark, "map")
    t.customer.select(F.col("c_custkey") % 8, F.array(e).alias("elements")).select("elements").write.json(path)
    return feeds.map_points(t.spark, path)


@query("s10_loose_price_table_scan", """
select ['NSW1', 'VIC1', 'QLD1', 'SA1'][o_custkey % 4 + 1] as region, '20' || lpad((o_orderkey % 20 + 10)::varchar, 2, '0') || 'Q' || quarter(o_orderdate) as quarter, o_orderdate as date, o_totalprice as price from orders where o_orderkey % 9 <> 0""")
def loose_price_table_scan(t):
    names = F.array(*[F.lit(s) for s in ("New South Wales", "VIC", "Qld base", "South Australia")])
    d = t.orders.select(F.element_at(names, (F.col("o_custkey") % 4 + 1).cast("int")).alias("Region"), F.concat(F.lit("Q"), F.quarter("o_orderdate"), F.lit("-"), (F.col("o_orderkey") % 20 + 10)).alias("Contract"),
                        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), F.when(F.col("o_orderkey") % 9 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string")).alias("Price"))
    path = shared_folder(t.spark, "prices")
    d.write.option("header", "true").csv(path)
    return feeds.long_prices(t.spark.read.option("header", "true").csv(path), "Region", "Contract", "Date", "Price")


@query("s10_wide_price_scan", """
with d as (select o_orderdate as date, max(o_totalprice) as a, min(o_totalprice) as b from orders group by 1) select unnest(['NSW1', 'VIC1']) as region, unnest(['2025Q1', '2026Q3']) as quarter, date, unnest([a, b]) as price from d""")
def wide_price_scan(t):
    d = t.orders.groupBy(F.date_format("o_orderdate", "dd/MM/yyyy").alias("Trade Date")).agg(F.max("o_totalprice").alias("NSW Q1 2025"), F.min("o_totalprice").alias("VIC 2026 Q3"))
    return feeds.wide_prices(d, "Trade Date")


@query("s11_csv_or_parquet_scan", """
select 'csv' as kind, count(*) as n, round(sum(s_acctbal), 2) as total from supplier union all select 'parquet', count(*), round(sum(s_acctbal), 2) from supplier""")
def csv_or_parquet_scan(t):
    path = shared_folder(t.spark, "either")
    files.write_csv(t.supplier.select("s_suppkey", "s_acctbal"), f"{path}.csv")
    files.write_parquet(t.supplier.select("s_suppkey", "s_acctbal"), f"{path}.parquet")
    read = {k: files.read_table(t.spark, f"{path}.{k}", "s_suppkey long, s_acctbal double") for k in ("csv", "parquet")}
    out = [d.agg(F.count(F.lit(1)).alias("n"), r6(F.sum("s_acctbal"), 2).alias("total")).select(F.lit(k).alias("kind"), "n", "total") for k, d in read.items()]
    return out[0].union(out[1])


@query("k1_parquet_sink", "select l_returnflag, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem group by 1")
def parquet_sink(t):
    path = shared_folder(t.spark, "sink")
    files.write_parquet(t.lineitem.select("l_orderkey", "l_extendedprice", "l_returnflag"), path, ["l_returnflag"])
    return t.spark.read.parquet(path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("l_extendedprice"), 2).alias("total"))


@query("k2_csv_sink", "select p_partkey, round(p_retailprice / 7, 3) as price from part")
def csv_sink(t):
    path = shared_folder(t.spark, "evidence")
    files.write_csv(t.part.select("p_partkey", (F.col("p_retailprice") / 7).alias("price")), path, 3)
    return t.spark.read.option("header", "true").schema("p_partkey long, price double").csv(path)


@query("k3_content_addressed_sink", "select c_custkey, c_name, c_acctbal, 1 as folders from customer")
def content_addressed_sink(t):
    """The same rows in another order land in the same folder and are written once."""
    base = shared_folder(t.spark, "content")
    a = files.write_by_content(t.customer, base)
    b = files.write_by_content(t.customer.orderBy(F.desc("c_acctbal")), base)
    return t.spark.read.parquet(a).select("c_custkey", "c_name", "c_acctbal", F.lit(len({a, b})).alias("folders"))


@query("k4_source_manifest", "select 'supplier.parquet' as file, count(*) as rows, 2 as columns from supplier")
def source_manifest(t):
    return files.manifest(t.supplier.select("s_suppkey", "s_name"))
