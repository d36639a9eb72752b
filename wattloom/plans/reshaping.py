"""Sort, top-k, set operations and reshaping on the driver tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..operators import reshape as op
from ..operators import revisions as rev
from .registry import query
from .standins import r6


@query("t1_top_k_per_group", """
select l_suppkey, l_partkey, qty, rn from (select *, row_number() over (partition by l_suppkey order by qty desc, l_partkey) as rn
  from (select l_suppkey, l_partkey, sum(l_quantity) as qty from lineitem group by 1, 2)) where rn <= 5""")
def top_k_per_group(t):
    d = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return rev.top_k(d, ["l_suppkey"], [F.desc("qty"), F.col("l_partkey")], 5, rank="rn")


@query("t2_selection_union", """
with e as (select o_orderkey, o_orderpriority as s, date_trunc('month', o_orderdate) as m, o_totalprice as x from orders),
u as (select o_orderkey, 'near_cap' as w from e where x >= 499000 union select o_orderkey, 'monthly_largest' from (select *, row_number() over (partition by m, s order by x desc, o_orderkey) as rn from e) where rn = 1
  union select o_orderkey, 'top_absolute' from (select * from e order by x desc, o_orderkey limit 12))
select o_orderkey, string_agg(w, ';' order by w) as reasons from u group by 1""")
def selection_union(t):
    e = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("s"), cal.month_start(F.col("o_orderdate")).alias("m"), F.col("o_totalprice").alias("x"))
    parts = {"near_cap": e.filter("x >= 499000"), "monthly_largest": rev.top_k(e, ["m", "s"], [F.desc("x"), F.col("o_orderkey")], 1),
             "top_absolute": e.orderBy(F.desc("x"), "o_orderkey").limit(12)}
    return op.tagged_union(parts, ["o_orderkey"], "reasons")


@query("t2_representative_pick", """
select y, o_orderpriority, o_orderkey from (select *, year(o_orderdate) as y, row_number() over (partition by year(o_orderdate), o_orderpriority
  order by md5(concat_ws('|', o_orderkey, 741)), o_orderkey) as rn from orders) where rn = 1""")
def representative_pick(t):
    """One repeatable case per stratum."""
    return op.one_per_stratum(t.orders.withColumn("y", F.year("o_orderdate")), ["y", "o_orderpriority"], ["o_orderkey"], 741).select(
        "y", "o_orderpriority", "o_orderkey")


@query("t3_ranked_k_controls", """
with p as (select a.l_partkey as key, a.l_orderkey as tk, a.l_linenumber as tl, b.l_orderkey as ck, b.l_linenumber as cl, abs(date_diff('day', a.l_shipdate, b.l_shipdate))::int as off
  from lineitem a join lineitem b on a.l_partkey = b.l_partkey and b.l_shipdate between a.l_shipdate - interval 21 days and a.l_shipdate + interval 21 days
  where a.l_returnflag = 'R' and b.l_returnflag = 'N')
select * from (select *, row_number() over (partition by key, tk, tl order by off, md5(concat_ws('|', ck, cl, 17)), ck, cl) as rank from p) where rank <= 5""")
def ranked_k_controls(t):
    """At most five controls per treated unit: same part, shipped within 21 days, by closeness and seeded hash."""
    from ..operators.lookups import points_in_intervals
    a = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("tk"), F.col("l_linenumber").alias("tl"), F.col("l_shipdate").alias("tt"),
                                                       (F.col("l_shipdate") - F.expr("interval 21 days")).alias("lo"), (F.col("l_shipdate") + F.expr("interval 21 days")).alias("hi"))
    b = t.lineitem.filter("l_returnflag = 'N'").select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("ck"), F.col("l_linenumber").alias("cl"), F.col("l_shipdate").alias("ct"))
    pairs = points_in_intervals(b, a, ["key"], "ct", "lo", "hi", hours=24 * 42).withColumn("off", F.abs(F.datediff("ct", "tt")))
    return op.ranked_controls(pairs, ["key", "tk", "tl"], "off", ["ck", "cl"], 5, 17).select("key", "tk", "tl", "ck", "cl", "off", "rank")


LEVELS = """t as (select l_suppkey, l_partkey % 20 as fam, l_returnflag, avg(l_quantity) as v, count(*) as n from lineitem group by 1, 2, 3),
e as (select 'K1' as level, l_suppkey, fam, l_returnflag, v from t where n >= 3 union all
  select 'K2', null, fam, l_returnflag, avg(l_quantity) from (select *, l_partkey % 20 as fam from lineitem where l_linestatus = 'O') group by 3, 4 having count(*) >= 22 union all
  select 'K3', null, null, l_returnflag, avg(l_quantity) from lineitem where l_returnflag <> 'R' group by 4)"""


def level_table(t):
    li = t.lineitem.withColumn("fam", F.col("l_partkey") % 20)
    n = F.count(F.lit(1)).alias("n")
    v = F.avg("l_quantity").alias("v")
    k1 = li.groupBy("l_suppkey", "fam", "l_returnflag").agg(v, n).filter("n >= 3").withColumn("level", F.lit("K1"))
    k2 = li.filter("l_linestatus = 'O'").groupBy("fam", "l_returnflag").agg(v, n).filter("n >= 22").withColumn("level", F.lit("K2"))
    k3 = li.filter("l_returnflag <> 'R'").groupBy("l_returnflag").agg(v, n).withColumn("level", F.lit("K3"))
    return k1.unionByName(k2, True).unionByName(k3, True).drop("n")


def level_rows(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") % 20).alias("fam"), "l_returnflag")


def level_requests(t):
    return level_rows(t).distinct()


RID = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"]
KEYS = {"K1": ["l_suppkey", "fam", "l_returnflag"], "K2": ["fam", "l_returnflag"], "K3": ["l_returnflag"]}


@query("t4_fallback_levels", f"""with {LEVELS}, q as (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 20 as fam, l_returnflag from lineitem)
select l_orderkey, l_linenumber, l_partkey, q.l_suppkey, q.l_returnflag, case when a.v is not null then 'K1' when b.v is not null then 'K2' when c.v is not null then 'K3' else 'none' end as level,
  round(coalesce(a.v, b.v, c.v), 6) as v from q left join (select * from e where level = 'K1') a on a.l_suppkey = q.l_suppkey and a.fam = q.fam and a.l_returnflag = q.l_returnflag
  left join (select * from e where level = 'K2') b on b.fam = q.fam and b.l_returnflag = q.l_returnflag left join (select * from e where level = 'K3') c on c.l_returnflag = q.l_returnflag""")
def fallback_levels(t):
    # K2 has 20 families for each return flag, K3 one row for each
    d = op.fallback_levels(level_rows(t), level_table(t).filter("v is not null"), KEYS, ["v"], ("K2", "K3"))
    return d.select(*RID, "level", r6("v").alias("v"))


@query("t5_backoff_lookup", f"""with {LEVELS}, g as (select *, case when level = 'K1' and v < 20 then 'indicative' when v > 27 then 'none' else 'supported' end as tier from e),
q as (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 20 as fam, l_returnflag from lineitem),
c as (select q.l_orderkey, q.l_linenumber, q.l_partkey, q.l_suppkey, q.l_returnflag, level, v, tier from q join g on g.l_returnflag = q.l_returnflag and (g.fam is null or g.fam = q.fam) and (g.l_suppkey is null or g.l_suppkey = q.l_suppkey) where tier <> 'none'),
r as (select *, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag order by (tier <> 'supported')::int, level, abs(v) desc) as rn from c)
select q.l_orderkey, q.l_linenumber, q.l_partkey, q.l_suppkey, q.l_returnflag, r.level, round(r.v, 6) as v, r.tier from q left join (select * from r where rn = 1) r using (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag)""")
def backoff_lookup(t):
    e = level_table(t).withColumn("tier", F.when((F.col("level") == "K1") & (F.col("v") < 20), "indicative").when(F.col("v") > 27, "none").otherwise("supported"))
    d = op.backoff_lookup(level_requests(t), e, RID, KEYS, ["supported", "indicative"], "v")
    return d.withColumn("v", r6("v"))


@query("t6_replace_revisions", """
with n as (select o_custkey as key, max(o_totalprice) as bal from orders where o_orderdate >= '2001-01-01' group by 1)
select c_custkey as key, c_acctbal as bal from customer where c_custkey not in (select key from n) union all select key, bal from n""")
def replace_revisions(t):
    old = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("bal"))
    new = t.orders.filter(F.col("o_orderdate") >= "2001-01-01").groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("bal"))
    return rev.replace_revisions(old, new, ["key"])


@query("t7_set_difference", """
with a as (select distinct o_custkey as k from orders where year(o_orderdate) = 1999), b as (select distinct o_custkey as k from orders where year(o_orderdate) = 2000)
select k, 'appeared' as change from b where k not in (select k from a) union all select k, 'removed' from a where k not in (select k from b)""")
def set_difference(t):
    def year(y):
        return t.orders.filter(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("k"))
    return op.appeared_and_removed(year(1999), year(2000), ["k"])


@query("t8_set_intersection", """
select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 45 intersect select l_partkey from lineitem where l_returnflag = 'A' and l_quantity > 45""")
def set_intersection(t):
    big = t.lineitem.filter("l_quantity > 45").select("l_partkey", "l_returnflag")
    return big.filter("l_returnflag = 'R'").select("l_partkey").intersect(big.filter("l_returnflag = 'A'").select("l_partkey"))


@query("t9_distinct_full_row", "select distinct l_partkey, l_suppkey, l_returnflag, l_linestatus from lineitem")
def distinct_full_row(t):
    return t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").dropDuplicates()


@query("t10_union_all_parts", """
select c_custkey as id, c_acctbal as bal, c_mktsegment as segment, null::bigint as nation from customer union all select s_suppkey, s_acctbal, null, s_nationkey from supplier""")
def union_all_parts(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").cast("long").alias("nation"))
    return a.unionByName(b, allowMissingColumns=True)


@query("t11_pivot_wide", """
select l_partkey, coalesce(sum(l_quantity) filter (l_linenumber = 1), 0) as "1", coalesce(sum(l_quantity) filter (l_linenumber = 2), 0) as "2", coalesce(sum(l_quantity) filter (l_linenumber = 3), 0) as "3",
  coalesce(sum(l_quantity) filter (l_linenumber = 4), 0) as "4", coalesce(sum(l_quantity) filter (l_linenumber = 5), 0) as "5", coalesce(sum(l_quantity) filter (l_linenumber = 6), 0) as "6",
  coalesce(sum(l_quantity) filter (l_linenumber = 7), 0) as "7" from lineitem group by 1""")
def pivot_wide(t):
    return op.wide(t.lineitem, ["l_partkey"], "l_linenumber", [1, 2, 3, 4, 5, 6, 7], F.sum("l_quantity"), 0.0)


@query("t12_unpivot_long", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest(['upper', 'lower', 'flow']) as side, unnest([l_discount, l_tax, l_quantity]) as value from lineitem""")
def unpivot_long(t):
    d = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_discount").alias("upper"), F.col("l_tax").alias("lower"), F.col("l_quantity").alias("flow"))
    return d.unpivot(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["upper", "lower", "flow"], "side", "value")


@query("t13_one_row_per_origin", """
with r as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as rn from lineitem),
v as (select l_orderkey, (min(l_returnflag) <> max(l_returnflag))::int as varies from lineitem group by 1)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, varies from r join v using (l_orderkey) where rn = 1""")
def one_row_per_origin(t):
    return op.one_row_per_origin(t.lineitem, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_returnflag"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "varies")


@query("t14_systematic_sample", """
with d as (select distinct event_type, ts, event_id from events), r as (select *, row_number() over (partition by event_type order by ts, event_id) - 1 as pos, count(*) over (partition by event_type) as n from d)
select event_type, ts, event_id from r where pos % greatest(n // 100, 1) = 0""")
def systematic_sample(t):
    return op.systematic_sample(t.events, ["event_type"], ["ts", "event_id"], 1, 100)


@query("t14_hashed_sample", """
select event_type, event_id from (select *, row_number() over (partition by event_type order by md5(concat_ws('|', event_id, 260921)), event_id) as rn from events) where rn <= 30""")
def hashed_sample(t):
    """A fixed number of rows per group by seeded hash (the reference's seeded sample)."""
    return op.hashed_sample(t.events, ["event_type"], ["event_id"], 30, 260921).select("event_type", "event_id")


@query("t15_explode_tokens", """
select p_brand, tok, count(*) as n from (select p_brand, unnest(string_split(p_name, ' ')) as tok from part) group by 1, 2""")
def explode_tokens(t):
    return op.token_counts(t.part, ["p_brand"], F.split("p_name", " "), "tok")


@query("t16_total_order_sort", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber, l_partkey, l_suppkey limit 500""")
def total_order_sort(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").orderBy(
        F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(500)
