"""Headline queries on one data folder; prints one JSON line."""
import json
import os
import time

from wattloom.plans import QUERIES
from wattloom.session import session

HEADLINE = ["p2_run_selection", "j1_asof_backward", "j2_asof_run", "j10_interval_overlap", "j11_point_in_interval", "w5_islands", "w6_merge_intervals", "w12_cumulative_curve",
            "a3_seasonal_reference", "a5_constraint_population", "a13_diurnal_profile", "a21_effect_ranking", "c2_limit_envelope", "c4_generator_pressure",
            "e1_contraction_detector", "o8_matched_effect", "f12_point_metrics", "b1_moving_block", "m1_asset_residue", "m7_net_trade", "g1_analogue_select"]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()   # start the executors
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                      "cpus": int(cpus)}), flush=True)


if __name__ == "__main__":
    main()
