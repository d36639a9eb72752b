"""Stream rules give the same rows for any cut of the table into files and any order of them."""
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from wattloom.plans import ORACLE, QUERIES
from wattloom.streaming import rules

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in QUERIES if n[0] == "r" and n[1].isdigit())


@pytest.fixture(scope="module")
def layouts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("layouts")
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(130, F.xxhash64("event_id")).write.parquet(f"{root}/shuffled/events.parquet")
    events.orderBy(F.desc("ts")).coalesce(1).write.option("maxRecordsPerFile", 150).parquet(f"{root}/backward/events.parquet")
    return {"file": SF, "shuffled": f"{root}/shuffled", "backward": f"{root}/backward"}


@pytest.mark.parametrize("layout", ["file", "shuffled", "backward"])
@pytest.mark.parametrize("name", NAMES)
def test_any_layout(spark, layouts, name, layout):
    assert compare(QUERIES[name](spark, layouts[layout]), connect(SF), ORACLE[name]) == ""


def alarms(spark, folder, per_trigger, late, root=None):
    half = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_800_000_000) * 1_800_000_000
    d = rules.table_stream(spark, folder, "events", per_trigger).filter("value > 20").select(F.col("event_type").alias("key"), half.alias("us"))
    out = rules.in_order(d, "us", late, rules.refractory("key", "us", 7_200_000_000), "key string, last long", "alarms", root, keys=["key"])
    return sorted((r.key, r.us) for r in out.collect())


def test_many_batches_hold_rows_back(spark, layouts, tmp_path):
    """Files in reverse order, a few a batch: with room for the disorder nothing changes; without it rows are named late."""
    whole = alarms(spark, layouts["backward"], None, 0)
    month = 40 * 86_400_000_000
    assert alarms(spark, layouts["backward"], 2, month) == whole
    alarms(spark, layouts["backward"], 2, 0, str(tmp_path / "tight"))
    assert spark.read.parquet(str(tmp_path / "tight" / "late")).count() > 0


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    schema = "k long, v long, n long"
    for i, rows in enumerate([[(k, 0, 1) for k in range(100)], [(5, 50, 3), (200, 1, 1)], [(5, 7, 2), (6, 60, 2)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet")
        # each turn is a new query on the same folder, as after a restart
        d = rules.table_stream(spark, f"{tmp_path}/in", "events", 1)
        out = rules.upserted(d, ["k"], ["n"], "up", str(tmp_path / "table"))
    got = {r.k: r.v for r in out.collect()}
    assert got == {**{k: 0 for k in range(100)}, 5: 50, 6: 60, 200: 1}


def test_a_batch_costs_what_it_touches(spark, tmp_path, monkeypatch):
    """First receipts of a growing table, one file a batch: waiting rows are written once, kept rows only in the buckets touched, and a restart goes on."""
    monkeypatch.setattr(rules, "MERGE", 3)
    schema, want, root = "k long, received long, id long", {}, str(tmp_path / "run")
    for e in range(8):
        rows = [(k, 1000 * e + k, 10 * e) for k in ([*range(200)] if e == 0 else [e, 300 + e])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet")
        for k, r, _ in rows:
            want.setdefault(k, r)
    d = rules.table_stream(spark, f"{tmp_path}/in", "events", 1).withColumn("us", F.col("received"))
    rule = rules.first_receipts(["k"], "us", "received", 10 ** 9, "id")
    out = rules.in_order(d, "received", 1500, rule, "k long", "cost", root, keys=["k"], append=True)
    assert {r.k: r.received for r in out.collect()} == want and out.count() == len(want)
    waiting = [spark.read.parquet(f"{root}/waiting/epoch={e}").count() for e in range(9)]
    assert sum(waiting) <= 200 + 2 * 7
    kept = [spark.read.schema("k long").parquet(f"{root}/kept/epoch={e}").count() for e in range(9)]
    assert sum(kept) <= len(want) + 60 and spark.read.schema("k long").parquet(f"{root}/late/epoch=7").count() == 0
    row = spark.read.parquet(f"{root}/state/epoch=8").first()
    assert row.waiting == "{}"
